"""Segment, window-function and voice-activity queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxquarry.functions import text as X
from voxquarry.operators import segments as S
from voxquarry.operators import vad as VAD
from voxquarry.plans.manifest import SEG, segments
from voxquarry.plans.registry import query, table


@query("pack_segments", f"""
WITH RECURSIVE s AS (SELECT conv_id, turn, duration, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {SEG}),
f AS (SELECT conv_id, turn, r, 1::BIGINT AS pack, 0.0::DOUBLE AS start, duration AS "end" FROM s WHERE r = 1
      UNION ALL SELECT s.conv_id, s.turn, s.r,
        f.pack + CASE WHEN f."end" >= 40 OR f."end" + s.duration > 40 THEN 1 ELSE 0 END,
        CASE WHEN f."end" >= 40 OR f."end" + s.duration > 40 THEN 0 ELSE f."end" END,
        CASE WHEN f."end" >= 40 OR f."end" + s.duration > 40 THEN 0 ELSE f."end" END + s.duration
      FROM f JOIN s ON s.conv_id = f.conv_id AND s.r = f.r + 1)
SELECT conv_id, turn, pack, start, "end" FROM f""")
def pack_segments(spark, d):
    """Next-fit packing of each recording's segments into 40 s."""
    return S.pack(segments(spark, d), ["conv_id"], "turn", "duration", 40.0)


@query("expand_and_merge", f"""
WITH t AS (SELECT conv_id, max(start + duration) OVER (PARTITION BY conv_id) AS total, start, start + duration * 0.75 AS e FROM {SEG}),
x AS (SELECT conv_id, greatest(start - 0.5, 0) AS start, least(e + 0.5, total) AS "end" FROM t),
n AS (SELECT *, coalesce((lag("end") OVER (PARTITION BY conv_id ORDER BY start, "end") <= start)::INT, 1) AS n FROM x),
i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM n)
SELECT conv_id, min(start) AS start, arg_max("end", (start, "end")) AS "end" FROM i GROUP BY conv_id, i""")
def expand_and_merge(spark, d):
    s = segments(spark, d)
    total = F.max(F.col("start") + F.col("duration")).over(Window.partitionBy("conv_id"))
    t = s.select("conv_id", "start", (F.col("start") + F.col("duration") * 0.75).alias("end"), total.alias("total"))
    return S.expand_and_merge(t, "conv_id", "start", "end", F.col("total"), 0.5)


@query("chunk_segments", f"""
WITH RECURSIVE s AS (SELECT conv_id, start, start + duration AS e, row_number() OVER (PARTITION BY conv_id ORDER BY start, start + duration) AS r FROM {SEG}),
f AS (SELECT conv_id, r, 0::BIGINT AS chunk, start AS first, e FROM s WHERE r = 1
      UNION ALL SELECT s.conv_id, s.r, f.chunk + CASE WHEN s.e - f.first <= 30 THEN 0 ELSE 1 END, CASE WHEN s.e - f.first <= 30 THEN f.first ELSE s.start END, s.e FROM f JOIN s ON s.conv_id = f.conv_id AND s.r = f.r + 1)
SELECT conv_id, chunk, min(first) AS start, max(e) AS "end", count(*)::BIGINT AS n FROM f GROUP BY conv_id, chunk""")
def chunk_segments(spark, d):
    s = segments(spark, d).select("conv_id", "start", (F.col("start") + F.col("duration")).alias("end"))
    return S.chunk(s, ["conv_id"], "start", "end", 30.0)


@query("trim_to_supervisions", f"SELECT conv_id, turn, start, duration FROM {SEG} WHERE role = 'user'")
def trim_to_supervisions(spark, d):
    """A recording with its list of segments, cut into its segments."""
    cuts = segments(spark, d).groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "start", "duration")).alias("sup"))
    return cuts.select("conv_id", F.explode(F.filter("sup", lambda s: s["role"] == "user")).alias("s")).select("conv_id", "s.turn", "s.start", "s.duration")


@query("merge_overlapped_chunks", """
SELECT conv_id, turn, ((i - 1) // 40)::BIGINT AS chunk, (i - 1)::DOUBLE AS at, w[i] AS symbol FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS w FROM conversations))""")
def merge_overlapped_chunks(spark, d):
    """Words of windows of 60 with cores of 40, put together again."""
    t = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("rec"), X.words(F.col("text")).alias("w")).withColumn("n", F.size("w").cast("long"))
    ch = t.select("rec", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / 40) - 1, F.lit(0)))).alias("chunk"))
    ch = ch.select("rec", "chunk", "n", F.greatest(F.col("chunk") * 40 - 10, F.lit(0)).alias("offset"))
    ch = ch.withColumn("left", F.col("chunk") * 40 - F.col("offset")).withColumn("right", F.least(F.col("chunk") * 40 + 40, F.col("n")) - F.col("offset"))
    covering = F.sequence(F.greatest(F.ceil((F.col("p") - 49) / 40), F.lit(0)), F.floor((F.col("p") + 10) / 40))
    sym = t.select("rec", F.posexplode("w").alias("p", "symbol")).select("rec", "p", "symbol", F.explode(covering).alias("chunk"))
    sym = sym.withColumn("at", F.col("p") - F.greatest(F.col("chunk") * 40 - 10, F.lit(0))).where("at < 60").drop("p")
    return S.merge_chunks(sym, ch, "rec").select("rec.conv_id", "rec.turn", "chunk", F.col("at").cast("double").alias("at"), "symbol")


@query("tick_mask", f"SELECT conv_id, count(*)::BIGINT AS ticks FROM (SELECT DISTINCT conv_id, unnest(range(greatest(round_even(start, 0), 0)::BIGINT, round_even(start + duration / 2, 0)::BIGINT)) AS t FROM {SEG}) GROUP BY conv_id")
def tick_mask(spark, d):
    """Covered seconds of half of each segment; boundaries round half to even."""
    s = segments(spark, d).select("conv_id", "start", (F.col("start") + F.col("duration") / 2).alias("end"))
    return S.ticks(s, "conv_id", "start", "end", 1.0).groupBy("conv_id").agg(F.count(F.lit(1)).alias("ticks"))


@query("running_offsets", "SELECT conv_id, turn, coalesce(sum(len(regexp_extract_all(text, '\\S+'))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word FROM conversations")
def running_offsets(spark, d):
    """Word offset of each segment in its recording."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.size(X.words(F.col("text")))).over(w), F.lit(0)).cast("long").alias("first_word"))


@query("moving_average_edge", """
WITH s AS (SELECT user_id, event_id, value, row_number() OVER w AS r, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER w AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
 sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round((s + greatest(3 - r, 0) * f + greatest(r + 2 - n, 0) * l) / 5, 9) AS mean FROM s""")
def moving_average_edge(spark, d):
    """Five values, the ends repeated."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole, part = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.partitionBy("user_id")
    r, n = F.row_number().over(w), F.count(F.lit(1)).over(part)
    s = F.sum("value").over(w.rowsBetween(-2, 2)) + F.greatest(3 - r, F.lit(0)) * F.first("value").over(whole) + F.greatest(r + 2 - n, F.lit(0)) * F.last("value").over(whole)
    return table(spark, d, "events").select("event_id", F.round(s / 5, 9).alias("mean"))


@query("moving_average_zero", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 9) AS mean FROM events")
def moving_average_zero(spark, d):
    """Five values, zeros beyond the ends."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w) / 5, 9).alias("mean"))


@query("lag_smoothing", "SELECT event_id, round(coalesce(0.3 * lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 0.7 * value, value), 9) AS x FROM events")
def lag_smoothing(spark, d):
    """Smoothing with the raw value before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.coalesce(F.lag("value").over(w) * 0.3 + F.col("value") * 0.7, F.col("value")), 9).alias("x"))


@query("edges_to_segments", """
WITH b AS (SELECT user_id, value > 10 AS on_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
e AS (SELECT *, (on_ <> coalesce(lag(on_) OVER (PARTITION BY user_id ORDER BY r), false))::INT AS c FROM b), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY r) AS g FROM e)
SELECT user_id, min(r)::INT AS first, max(r)::INT AS last FROM g WHERE on_ GROUP BY user_id, g""")
def edges_to_segments(spark, d):
    """Runs of a binary series."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").select("user_id", (F.col("value") > 10).alias("on"), F.row_number().over(w).alias("r"))
    v = Window.partitionBy("user_id").orderBy("r")
    t = t.withColumn("c", (F.col("on") != F.coalesce(F.lag("on").over(v), F.lit(False))).cast("int")).withColumn("g", F.sum("c").over(v))
    return t.where("on").groupBy("user_id", "g").agg(F.min("r").alias("first"), F.max("r").alias("last")).drop("g")


@query("word_frames", """
WITH s AS (SELECT user_id, event_id, ts, event_type IN ('click', 'purchase') AS begins, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events),
g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY f) AS g FROM s)
SELECT user_id, g::BIGINT AS word, min(f)::INT AS start, max(f)::INT AS "end" FROM g WHERE g > 0 GROUP BY user_id, g""")
def word_frames(spark, d):
    """First and last frame of words from pieces, of which some begin a word."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").select("user_id", F.row_number().over(w).alias("f"), F.col("event_type").isin("click", "purchase").cast("int").alias("b"))
    t = t.withColumn("word", F.sum("b").over(Window.partitionBy("user_id").orderBy("f")))
    return t.where("word > 0").groupBy("user_id", "word").agg(F.min("f").alias("start"), F.max("f").alias("end"))


@query("last_header_fill", """
WITH l AS (SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
SELECT doc_id, line_no, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS header FROM l""")
def last_header_fill(spark, d):
    """The last header (a short line) at or above each line."""
    from voxquarry.plans.text import lines

    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines(spark, d).select("doc_id", "line_no", F.last(F.when(F.length("line") < 40, F.col("line")), ignorenulls=True).over(w).alias("header"))


@query("speaker_turns", """
WITH s AS (SELECT user_id, ts, event_id, event_type, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM events)
SELECT user_id, turn::BIGINT AS turn, string_agg(event_type, ' ' ORDER BY ts, event_id) AS text FROM s WHERE turn > 0 GROUP BY user_id, turn""")
def speaker_turns(spark, d):
    """A header starts a turn, other lines append; what is before the first header goes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, d, "events").withColumn("turn", F.sum((F.col("event_type") == "click").cast("int")).over(w)).where("turn > 0")
    g = t.groupBy("user_id", "turn").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))
    return g.select("user_id", "turn", F.array_join(F.transform("l", lambda x: x["event_type"]), " ").alias("text"))


@query("turn_finals", """
SELECT user_id, turn::BIGINT AS turn, arg_max(event_id, (ts, event_id)) AS final, arg_max(event_type, (ts, event_id)) = 'view' AS pending FROM (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn0 FROM events) x, LATERAL (SELECT coalesce(turn0, 0) AS turn) GROUP BY user_id, turn""")
def turn_finals(spark, d):
    """Batch twin of turn assembly: the last message of each turn, and whether it is only interim."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    t = table(spark, d, "events").withColumn("turn", F.coalesce(F.sum((F.col("event_type") == "purchase").cast("int")).over(w), F.lit(0)))
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("m")
    return t.groupBy("user_id", "turn").agg(last).select("user_id", "turn", F.col("m.event_id").alias("final"), (F.col("m.event_type") == "view").alias("pending"))


@query("dynamic_batches", f"""
WITH RECURSIVE l AS (SELECT conv_id, turn, floor(duration)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM {SEG}),
b AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS batch FROM l WHERE i = 0 UNION ALL SELECT b.conv_id, b.i + least(8 // (n // 10 + 1) + 1, 8), batch + 1 FROM b JOIN l USING (conv_id, i))
SELECT l.conv_id, turn, max(batch) AS batch FROM l JOIN b ON b.conv_id = l.conv_id AND b.i <= l.i GROUP BY ALL""")
def dynamic_batches(spark, d):
    t = segments(spark, d).withColumn("n", F.floor("duration").cast("long"))
    return S.batches_by_length(t, ["conv_id"], "turn", "n", 8, 10)


@query("duration_buckets", f"""SELECT ((duration > 5)::INT + (duration > 10)::INT + (duration > 20)::INT) AS bucket, count(*)::BIGINT AS n, round(sum(duration), 6) AS total FROM {SEG} GROUP BY 1""")
def duration_buckets(spark, d):
    """Duration buckets with batches inside, summed up by bucket."""
    t = S.bucket_batches(segments(spark, d).withColumn("id", F.concat_ws("-", "conv_id", "turn")), "duration", "id", [5.0, 10.0, 20.0], 60.0)
    return t.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 6).alias("total"))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: an exclusive-or for each byte, then eight shifts with the reversed polynomial."""
    steps = f"list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"


@query("sampler_batches", f"""
WITH RECURSIVE p AS (SELECT p_partkey AS id, p_retailprice::DOUBLE AS l FROM part), q AS (SELECT quantile_disc(l, [{', '.join(f'{k}/30.0' for k in range(1, 30))}]) AS q FROM p),
d AS (SELECT id, l, len(list_filter(list_distinct(q), lambda e: l > e)) AS bucket, {crc32_sql("'batch|shard|' || id")} % 2 AS shard, {crc32_sql("'batch|order|' || id")} AS h FROM p, q),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bucket, shard ORDER BY h, id) AS k FROM d),
b AS (SELECT bucket, shard, k, id, l AS total, 0 AS batch FROM o WHERE k = 1
  UNION ALL SELECT o.bucket, o.shard, o.k, o.id, CASE WHEN b.total > 0 AND b.total + o.l > 6000 THEN o.l ELSE b.total + o.l END, CASE WHEN b.total > 0 AND b.total + o.l > 6000 THEN b.batch + 1 ELSE b.batch END FROM b JOIN o ON o.bucket = b.bucket AND o.shard = b.shard AND o.k = b.k + 1)
SELECT id, bucket::INT AS bucket, shard::BIGINT AS shard, batch::BIGINT AS batch FROM (SELECT *, max(batch) OVER (PARTITION BY bucket, shard) AS last FROM b) WHERE batch < last""")
def sampler_batches(spark, d):
    """Thirty buckets of prices as lengths, two shards, batches of 6000, incomplete ones dropped."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("l"))
    return S.sampled_batches(t, "id", "l", S.quantile_edges(t, "l", 30, 1_000_000), 6000.0, 2)


@query("concatenation_offsets", f'SELECT conv_id, turn, coalesce(sum(duration + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS "offset" FROM {SEG}')
def concatenation_offsets(spark, d):
    return S.concatenate(segments(spark, d), ["conv_id"], "turn", "duration", 1.0).select("conv_id", "turn", "offset")


@query("noise_plan", f"""
WITH t AS (SELECT conv_id || '-' || turn AS id FROM {SEG}), x AS (SELECT id, {crc32_sql("'noise|pick|' || id")} % 1048576 / 1048576.0::DOUBLE AS p, {crc32_sql("'noise|snr|' || id")} % 1048576 / 1048576.0::DOUBLE AS s FROM t)
SELECT id, p < 0.5 AS noisy, CASE WHEN p < 0.5 THEN 10.0::DOUBLE + s * 10.0::DOUBLE END AS snr FROM x""")
def noise_plan(spark, d):
    t = segments(spark, d).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return S.noise_plan(t, "id", 0.5, 10.0, 20.0).select("id", "noisy", "snr")


@query("seeds_from_names", f"""SELECT n_name, {crc32_sql("'noise|' || n_name")} AS seed FROM nation""")
def seeds_from_names(spark, d):
    """Seeds by checksum of joined names."""
    return table(spark, d, "nation").select("n_name", F.crc32(F.concat(F.lit("noise|"), "n_name").cast("binary")).alias("seed"))


#: Frames of recordings with two channels: values in order of time, and a band of their own from the event's number.
FRAMES = "f AS (SELECT user_id % 6 AS rec, user_id // 6 % 2 AS ch, row_number() OVER (PARTITION BY user_id % 6, user_id // 6 % 2 ORDER BY ts, event_id) - 1 AS fr, [value, (event_id * 7919 % 97)::DOUBLE] AS x FROM events)"
CLUSTER = """k{j} AS (SELECT * EXCLUDE (lo, hi), len(l) AS nl, len(h) AS nh, list_sum(list_transform(l, lambda v: v * v)) AS ql, list_sum(list_transform(h, lambda v: v * v)) AS qh, coalesce(list_avg(l), lo) AS lo, coalesce(list_avg(h), hi) AS hi
  FROM (SELECT * {drop}, list_filter(xs, lambda v: NOT abs(v - hi) < abs(v - lo)) AS l, list_filter(xs, lambda v: abs(v - hi) < abs(v - lo)) AS h FROM k{i}))"""
SHARE = "CASE WHEN weak THEN greatest(part, 0.5) ELSE part END"
BLEND = "(1 - s) * {a} + s * {b}"
PROBS = f"""{FRAMES}, n AS (SELECT rec, ch, count(*) AS n FROM f GROUP BY ALL),
iv AS (SELECT rec, ch, fr // 100 AS iv, band, list(x[band] ORDER BY fr) AS xs FROM f, (SELECT unnest([1, 2]) AS band) GROUP BY ALL),
k0 AS (SELECT *, list_min(xs) AS lo, list_max(xs) AS hi FROM iv),
{CLUSTER.format(i=0, j=1, drop="")}, {CLUSTER.format(i=1, j=2, drop="EXCLUDE (l, h, nl, nh, ql, qh)")}, {CLUSTER.format(i=2, j=3, drop="EXCLUDE (l, h, nl, nh, ql, qh)")},
st AS MATERIALIZED (SELECT k3.*, iv * 100 + 10 < n AS counts, row_number() OVER (PARTITION BY rec, band ORDER BY ch, iv) AS k FROM k3 JOIN n USING (rec, ch)),
e AS (SELECT rec, band, 0::BIGINT AS k, NULL::BIGINT AS ch, NULL::BIGINT AS iv, 0.0::DOUBLE AS on_, 1.0::DOUBLE AS onv, 0.0::DOUBLE AS off, 1.0::DOUBLE AS offv, 0 AS u, 0.0::DOUBLE AS shares FROM st WHERE k = 1
  UNION ALL
  SELECT rec, band, k, ch, iv, CASE WHEN counts THEN {BLEND.format(a="on_", b="hi")} ELSE on_ END, CASE WHEN NOT counts THEN onv WHEN nh > 0 THEN greatest(qh / nh - hi * hi, 0.5) ELSE {BLEND.format(a="onv", b="0.5")} END,
         CASE WHEN counts THEN {BLEND.format(a="off", b="lo")} ELSE off END, CASE WHEN NOT counts THEN offv WHEN nl > 0 THEN greatest(ql / nl - lo * lo, 0.5) ELSE {BLEND.format(a="offv", b="0.5")} END,
         CASE WHEN counts THEN u + 1 ELSE u END, CASE WHEN counts THEN shares + s ELSE shares END
  FROM (SELECT *, {SHARE} AS s FROM (SELECT st.rec, st.band, st.k, st.ch, st.iv, st.counts, st.lo, st.hi, st.nl, st.nh, st.ql, st.qh, e.on_, e.onv, e.off, e.offv, e.u, e.shares,
          CASE WHEN e.u > 0 AND st.hi - st.lo < e.on_ - e.off THEN pow(10.0::DOUBLE, 0.1::DOUBLE * ((st.hi - st.lo) - (e.on_ - e.off))) ELSE 1.0::DOUBLE END AS part, e.u = 1 OR (e.u > 1 AND (e.shares - 1) / (e.u - 1) < 0.5) AS weak
        FROM e JOIN st ON st.rec = e.rec AND st.band = e.band AND st.k = e.k + 1))),
x AS (SELECT rec, ch, fr, fr // 100 AS iv, unnest([1, 2]) AS band, unnest(CASE WHEN lag(x) OVER w IS NULL THEN x ELSE [0.5 * lag(x) OVER w [1] + 0.5 * x[1], 0.5 * lag(x) OVER w [2] + 0.5 * x[2]] END) AS v FROM f WINDOW w AS (PARTITION BY rec, ch ORDER BY fr)),
p AS (SELECT x.rec, x.ch, x.fr, x.band, v, off, CASE WHEN v < off THEN 0 WHEN v < on_ THEN 1 ELSE 0.5 * (exp(-((v - on_) * (v - on_)) / (2 * onv)) + (1 - exp(-((v - off) * (v - off)) / (2 * offv)))) END::DOUBLE AS p FROM x JOIN e USING (rec, band, ch, iv)),
q AS (SELECT rec, ch, fr, pow(max(p) FILTER (WHERE band = 1) * max(p) FILTER (WHERE band = 2) * max(p) FILTER (WHERE band = 2), 0.3333333::DOUBLE) AS p, max(v) FILTER (WHERE band = 1) AS power, max(off) FILTER (WHERE band = 1) AS background FROM p GROUP BY ALL),
pr AS MATERIALIZED (SELECT rec, ch, fr, p * pow(10.0::DOUBLE, 0.1::DOUBLE * (power - max(power) OVER (PARTITION BY rec, fr))) AS prob, power, background FROM q)"""
SPEECH = VAD.Settings(interval=100, margin=1, shortest=1, longest=12, environment=1, enter=2, leave=2, high=0.3, low=0.1)


def channel_frames(spark, d):
    """(rec, ch, fr, x): frames of six recordings with two channels and two bands."""
    w = Window.partitionBy("rec", "ch").orderBy("ts", "event_id")
    e = table(spark, d, "events").select((F.col("user_id") % 6).alias("rec"), (F.floor(F.col("user_id") / 6) % 2).alias("ch"), "ts", "event_id", "value")
    return e.select("rec", "ch", (F.row_number().over(w) - 1).cast("long").alias("fr"), F.array("value", (F.col("event_id") * 7919 % 97).cast("double")).alias("x"))


@query("activity_probabilities", f"WITH RECURSIVE {PROBS} SELECT rec, ch, fr, round(prob + 1e-9, 6) AS prob, round(power + 1e-9, 6) AS power, round(background + 1e-9, 6) AS background FROM pr")
def activity_probabilities(spark, d):
    """Each frame's probability under estimates that carry over intervals and channels."""
    t = VAD.probabilities(channel_frames(spark, d), "rec", "ch", "fr", "x", SPEECH)
    return t.select("rec", "ch", "fr", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("prob", "power", "background")])


@query("hysteresis_segments", """WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT user_id, -1::BIGINT AS i, false AS inside, 0 AS pending, -1::BIGINT AS since, NULL::BIGINT AS entered, NULL::BIGINT AS left_ FROM s WHERE i = 0
  UNION ALL
  SELECT user_id, i, CASE WHEN hit THEN NOT inside ELSE inside END, CASE WHEN hit OR back THEN 0 WHEN toward THEN pending + 1 ELSE pending END, since,
         CASE WHEN hit AND NOT inside THEN since END, CASE WHEN hit AND inside THEN since END
  FROM (SELECT *, toward AND pending + 1 = CASE WHEN inside THEN 3 ELSE 2 END AS hit FROM (
    SELECT s.user_id, s.i, r.inside, r.pending, CASE WHEN toward AND r.pending = 0 THEN s.i ELSE r.since END AS since, toward, back
    FROM (SELECT r.*, s.value, s.i AS at, CASE WHEN r.inside THEN s.value <= 20 ELSE s.value >= 50 END AS toward, CASE WHEN r.inside THEN s.value >= 50 ELSE s.value <= 20 END AS back FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1) r JOIN s ON s.user_id = r.user_id AND s.i = r.at))),
m AS (SELECT user_id, entered, lead(left_) OVER (PARTITION BY user_id ORDER BY i) AS left_ FROM r WHERE entered IS NOT NULL OR left_ IS NOT NULL)
SELECT user_id, entered AS start, coalesce(left_, (SELECT max(i) + 1 FROM s WHERE s.user_id = m.user_id))::BIGINT AS "end" FROM m WHERE entered IS NOT NULL""")
def hysteresis_segments(spark, d):
    """Stretches of high values by runs; the SQL walks value by value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("i"), "value")
    return VAD.hysteresis_runs(t, ["user_id"], "i", "value", 50.0, 20.0, 2, 3)


@query("voice_activity", f"""WITH RECURSIVE {PROBS},
a AS (SELECT rec, ch, fr, prob, power, background, row_number() OVER w AS r, count(*) OVER (PARTITION BY rec, ch) AS n,
  (sum(prob) OVER (PARTITION BY rec, ch ORDER BY fr ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + CASE WHEN fr = 0 THEN prob ELSE 0 END + CASE WHEN fr = max(fr) OVER (PARTITION BY rec, ch) THEN prob ELSE 0 END) / 3 AS m FROM pr WINDOW w AS (PARTITION BY rec, ch ORDER BY fr)),
o AS (SELECT rec, ch, fr, m >= 0.3 AS on_ FROM a WHERE m >= 0.3 OR m <= 0.1), o1 AS (SELECT *, CASE WHEN lag(on_) OVER w = on_ THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY rec, ch ORDER BY fr)),
o2 AS (SELECT *, sum(new) OVER (PARTITION BY rec, ch ORDER BY fr) AS run FROM o1), ru AS (SELECT rec, ch, run, any_value(on_) AS on_, min(fr) AS start FROM o2 GROUP BY ALL HAVING count(*) >= 2),
tu AS (SELECT *, lead(start) OVER (PARTITION BY rec, ch ORDER BY run) AS next FROM (SELECT *, lag(on_, 1, false) OVER (PARTITION BY rec, ch ORDER BY run) AS was FROM ru) WHERE was <> on_),
c AS MATERIALIZED (SELECT tu.rec, tu.ch, start, coalesce(next, n) AS finish, n, row_number() OVER (PARTITION BY tu.rec, tu.ch ORDER BY start) AS k FROM tu JOIN n ON n.rec = tu.rec AND n.ch = tu.ch WHERE on_),
g AS (SELECT rec, ch, k, 1 AS gid, greatest(start - 1, 0) AS a, least(finish + 1, n) AS z, finish AS own_end, NULL::BIGINT AS cut FROM c WHERE k = 1
  UNION ALL SELECT c.rec, c.ch, c.k, CASE WHEN greatest(c.start - 1, 0) > g.z OR least(c.finish + 1, n) - g.a > 12 THEN g.gid + 1 ELSE g.gid END,
    CASE WHEN greatest(c.start - 1, 0) > g.z THEN greatest(c.start - 1, 0) WHEN least(c.finish + 1, n) - g.a > 12 THEN (g.own_end + c.start) // 2 ELSE g.a END, least(c.finish + 1, n), c.finish,
    CASE WHEN greatest(c.start - 1, 0) <= g.z AND least(c.finish + 1, n) - g.a > 12 THEN (g.own_end + c.start) // 2 END
  FROM g JOIN c ON c.rec = g.rec AND c.ch = g.ch AND c.k = g.k + 1),
w AS (SELECT rec, ch, gid, min(g.a) AS a, max(g.z) AS z FROM g GROUP BY ALL), w1 AS (SELECT w.rec, w.ch, w.gid, w.a, coalesce(any_value(cut), w.z) AS z FROM w LEFT JOIN g ON g.rec = w.rec AND g.ch = w.ch AND g.gid = w.gid + 1 AND cut IS NOT NULL GROUP BY w.rec, w.ch, w.gid, w.a, w.z),
v AS (SELECT g.rec, g.ch, g.gid, sum(c.finish - c.start) AS frames, sum(prob) AS prob, sum(power) AS power, sum(power - background) AS snr FROM g JOIN c USING (rec, ch, k) JOIN a ON a.rec = c.rec AND a.ch = c.ch AND a.fr >= c.start AND a.fr < c.finish GROUP BY ALL),
v1 AS (SELECT rec, ch, gid, prob / fr AS prob, power / fr AS power, snr / fr AS snr FROM (SELECT v.* EXCLUDE (frames), len_.fr FROM v JOIN (SELECT g.rec, g.ch, g.gid, sum(c.finish - c.start) AS fr FROM g JOIN c USING (rec, ch, k) GROUP BY ALL) len_ USING (rec, ch, gid))),
y AS (SELECT w1.*, CASE WHEN z - a >= 24 THEN 1 + floor((z - a) / 18.0)::BIGINT ELSE 1 END AS pieces FROM w1 WHERE z - a >= 3),
u AS (SELECT *, a + i * ((z - a) // pieces) AS s, CASE WHEN i + 1 = pieces THEN z ELSE a + (i + 1) * ((z - a) // pieces) END AS f FROM (SELECT *, unnest(range(0, pieces)) AS i FROM y))
SELECT rec, ch, row_number() OVER (PARTITION BY rec, ch ORDER BY s) - 1 AS seg, round(s * 0.01::DOUBLE, 6) AS start, round(f * 0.01::DOUBLE, 6) AS "end", round(sqrt(prob) + 1e-9, 6) AS confidence, round(power + 1e-9, 6) AS power, round(snr + 1e-9, 6) AS snr FROM u JOIN v1 USING (rec, ch, gid)""")
def voice_activity(spark, d):
    """Segments of two-channel recordings."""
    t = VAD.segment(channel_frames(spark, d), "rec", "ch", "fr", "x", SPEECH)
    # averages of halves end on ties of the sixth digit, which the order of a sum would decide
    return t.select("rec", "ch", "seg", *[F.round(c, 6).alias(c) for c in ("start", "end")], *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("confidence", "power", "snr")])


@query("split_segments", """
WITH RECURSIVE e AS (SELECT user_id % 4 AS rec, list(value ORDER BY ts, event_id) AS e FROM events GROUP BY 1),
r AS (SELECT rec, e, 0.0::DOUBLE AS a, len(e) / 2.0::DOUBLE AS z FROM e
  UNION ALL
  SELECT rec, e, CASE WHEN side = 1 THEN a ELSE mid END, CASE WHEN side = 1 THEN mid ELSE z END FROM (
    SELECT rec, e, a, z, side, CASE WHEN away IS NULL OR spot = lo OR spot = hi THEN middle ELSE spot END / 2.0::DOUBLE AS mid FROM (
      SELECT *, middle + CASE WHEN away % 2 = 1 THEN -(away // 2) ELSE away // 2 END AS spot FROM (
        SELECT *, CASE WHEN e[middle + 1] > lim THEN list_min(list_transform(list_filter(range(lo, hi), lambda i: e[i + 1] < lim), lambda i: 2 * abs(i - middle) + (i < middle)::INT)) END AS away FROM (
          SELECT *, lo + (hi - lo) // 2 AS middle, list_min(e[lo + 1:hi]) + 0.05::DOUBLE * (list_max(e[lo + 1:hi]) - list_min(e[lo + 1:hi])) AS lim FROM (
            SELECT *, floor(a * 2)::BIGINT AS lo, least(floor(z * 2)::BIGINT, len(e)) AS hi FROM r WHERE z - a > 30) WHERE hi - lo >= 2))), (SELECT unnest([1, 2]) AS side)))
SELECT rec, a AS start, z AS "end" FROM r WHERE NOT (z - a > 30 AND least(floor(z * 2)::BIGINT, len(e)) - floor(a * 2)::BIGINT >= 2)""")
def split_segments(spark, d):
    """Whole recordings split at quiet values near their middles until no part has more than 30 seconds, two values a second."""
    w = Window.partitionBy("rec").orderBy("ts", "event_id")
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("rec"), "ts", "event_id", "value")
    f = e.select("rec", (F.row_number().over(w) - 1).cast("long").alias("fr"), "value")
    whole = f.groupBy("rec").agg(F.lit(0.0).alias("a"), (F.count(F.lit(1)) / 2).alias("z"))
    return S.split_levels(whole, S.energy_tiles(f, "rec", "fr", "value"), "rec", "a", "z", 2.0)


@query("channel_weights", "SELECT event_id, round(pow(10.0::DOUBLE, 0.1::DOUBLE * (value - max(value) OVER (PARTITION BY event_type, floor(epoch(ts) / 3600)))), 9) AS prob FROM events")
def channel_weights(spark, d):
    """Relative power of channels in a frame (an hour here)."""
    t = table(spark, d, "events").withColumn("frame", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)).withColumn("prob", F.lit(1.0))
    return VAD.relative_weight(t, ["event_type", "frame"], "value", "prob").select("event_id", F.round("prob", 9).alias("prob"))
