"""Manifest, join, aggregate and set queries."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from voxquarry.functions import text as X
from voxquarry.operators import relational as R
from voxquarry.plans.registry import query, table

SEG = "(SELECT conv_id, turn, role, length(text) / 16.0::DOUBLE AS duration, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 16.0::DOUBLE AS start FROM conversations)"


def segments(spark: SparkSession, d: str):
    """(conv_id, turn, role, start, duration): turns one after the other, 16 characters a second."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("text")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", (n / F.lit(16.0)).alias("duration"), (F.coalesce(F.sum(n).over(w), F.lit(0)) / F.lit(16.0)).alias("start"))


@query("parquet_scan", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def parquet_scan(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


@query("file_row_counts", "SELECT 'orders' AS name, count(*)::BIGINT AS n FROM orders")
def file_row_counts(spark, d):
    """Rows per table from one column."""
    t = table(spark, d, "orders").select("o_orderkey", F.regexp_extract(F.input_file_name(), r"/(\w+)\.parquet(/[^/]*)?$", 1).alias("name"))
    return t.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("global_row_index", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1)::BIGINT AS idx, lpad(((row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1) // 1000)::VARCHAR, 7, '0') AS shard FROM orders")
def global_row_index(spark, d):
    """Rows numbered over ordered files (priorities stand for files), and the name of their shard."""
    t = R.global_index(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])
    return t.select("o_orderkey", F.col("idx").cast("long").alias("idx"), R.shard_name(F.col("idx"), 1000).alias("shard"))


@query("manifest_split", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1) // (SELECT ceil(count(*) / 7.0)::BIGINT FROM orders))::BIGINT AS part FROM orders")
def manifest_split(spark, d):
    t = R.global_index(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])
    return R.split_parts(t, 7).select("o_orderkey", F.col("part").cast("long").alias("part"))


@query("test_dev_train", "SELECT c_custkey, CASE WHEN r <= 10 THEN 'test' WHEN r <= 20 THEN 'dev' ELSE 'train' END AS split FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS r FROM customer)")
def test_dev_train(spark, d):
    return R.rank_split(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"]).select("c_custkey", "split")


@query("segment_ordinals", "SELECT conv_id, turn, conv_id::VARCHAR || '-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id FROM conversations WHERE trim(text) <> ''")
def segment_ordinals(spark, d):
    """Segment ids by recording, blank ones not counted."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").where("trim(text) <> ''").select("conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), n.cast("string")).alias("id"))


@query("stm_lines", f"SELECT conv_id, turn, printf('%d 1 %d %.2f %.2f <NA> %s', conv_id, conv_id, start, start + duration, role) AS line FROM (SELECT conv_id, turn, role, round(start * 4) / 4 AS start, round(duration * 4) / 4 AS duration FROM {SEG})")
def stm_lines(spark, d):
    """Segment lines; times are quarters of a second here, which every engine prints alike."""
    q = lambda c: F.round(F.col(c) * 4) / 4
    s = segments(spark, d).withColumn("start", q("start")).withColumn("duration", q("duration"))
    return s.select("conv_id", "turn", F.format_string("%d 1 %d %.2f %.2f <NA> %s", "conv_id", "conv_id", "start", F.col("start") + F.col("duration"), "role").alias("line"))


@query("stm_parse", f"SELECT conv_id, turn, round(start * 4) / 4 AS start, round(start * 4) / 4 + round(duration * 4) / 4 AS end, role AS text FROM {SEG}")
def stm_parse(spark, d):
    """Reads segment lines back."""
    from voxquarry.sources import stm

    return stm.parse(stm_lines(spark, d), "line").select("conv_id", "turn", "start", "end", "text")


@query("inner_join_on_keys", "SELECT o_orderkey, c_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join_on_keys(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_mktsegment", "o_totalprice")


@query("left_join_empty_default", "SELECT c_custkey, (count(o_orderkey))::INT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_join_empty_default(spark, d):
    """Left join to a list per key; a missing list is empty."""
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("l"))
    return table(spark, d, "customer").join(lists, "c_custkey", "left").select("c_custkey", F.size(F.coalesce("l", F.array().cast("array<bigint>"))).alias("n"))


@query("positional_zip", "SELECT a.conv_id, a.turn AS user_turn, b.turn AS assistant_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant') b USING (conv_id, r)")
def positional_zip(spark, d):
    t = table(spark, d, "conversations")
    a = t.where("role = 'user'").select("conv_id", F.col("turn").alias("user_turn"))
    b = t.where("role = 'assistant'").select("conv_id", F.col("turn").alias("assistant_turn"))
    return R.zip_rows(a, b, ["conv_id"], ["user_turn"], ["assistant_turn"]).select("conv_id", "user_turn", "assistant_turn")


@query("strict_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def strict_lookup(spark, d):
    """A lookup whose missing keys fail."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return R.strict_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_name")


@query("lookup_with_default", "SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_with_default(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


@query("anti_join_todo", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_todo(spark, d):
    return R.anti_join(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("semi_join_wanted", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_wanted(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("id_selection_ordered", "SELECT c_custkey, list_position([30::BIGINT, 10, 20, 5], c_custkey)::BIGINT AS pos FROM customer WHERE c_custkey IN (30, 10, 20, 5)")
def id_selection_ordered(spark, d):
    """Selected ids in the order of the list."""
    wanted = F.array(*[F.lit(x).cast("long") for x in (30, 10, 20, 5)])
    return table(spark, d, "customer").where(F.array_contains(wanted, F.col("c_custkey"))).select("c_custkey", F.array_position(wanted, F.col("c_custkey")).alias("pos")).orderBy("pos")


@query("interval_join", f"SELECT s.conv_id, s.turn, p.turn AS point FROM {SEG} s JOIN (SELECT conv_id, turn, start + duration / 2 AS at FROM {SEG}) p ON p.conv_id = s.conv_id AND p.at >= s.start AND p.at < s.start + s.duration * 1.5")
def interval_join(spark, d):
    """Midpoints of turns in half-open windows of turns."""
    s = segments(spark, d)
    i = s.select("conv_id", "turn", "start", (F.col("start") + F.col("duration") * 1.5).alias("end"))
    p = s.select("conv_id", F.col("turn").alias("point"), (F.col("start") + F.col("duration") / 2).alias("at"))
    return R.interval_join(p, i, "conv_id", "at", "start", "end", 8.0).select("conv_id", "turn", "point")


TICKS = """WITH a AS (SELECT DISTINCT user_id AS k, unnest(range(s, s + n)) AS t FROM (SELECT user_id, (floor(epoch(ts))::BIGINT // 60) % 20000 AS s, 1 + (value::BIGINT % 40) AS n FROM events WHERE event_type IN ('click', 'view'))),
b AS (SELECT DISTINCT user_id AS k, unnest(range(s, s + n)) AS t FROM (SELECT user_id, (floor(epoch(ts))::BIGINT // 60) % 20000 AS s, 1 + (value::BIGINT % 25) AS n FROM events WHERE event_type NOT IN ('click')))
SELECT k, (count(a.t))::BIGINT AS total, (count(*) FILTER (WHERE a.t IS NOT NULL AND b.t IS NOT NULL))::BIGINT AS covered, (count(*) FILTER (WHERE a.t IS NULL))::BIGINT AS extra FROM a FULL JOIN b USING (k, t) GROUP BY k"""


@query("segment_coverage", TICKS.replace("SELECT k, (count", "SELECT k, (count"))
def segment_coverage(spark, d):
    """Two segment sets: time covered and time in excess, from interval boundaries (the oracle counts ticks)."""
    e = table(spark, d, "events")
    s = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60) % 20000).alias("start")
    # halves round to even on both sides
    n = F.rint("value").cast("long")
    a = e.where("event_type IN ('click', 'view')").select(F.col("user_id").alias("k"), s, (1 + n % 40).alias("n")).withColumn("end", F.col("start") + F.col("n"))
    b = e.where("event_type NOT IN ('click')").select(F.col("user_id").alias("k"), s, (1 + n % 25).alias("n")).withColumn("end", F.col("start") + F.col("n"))
    return R.coverage(a, b, "k")


@query("asof_backward", "SELECT event_id, (SELECT arg_max(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_purchase FROM events e")
def asof_backward(spark, d):
    e = table(spark, d, "events")
    p = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    p = p.groupBy("user_id", "ts").agg(F.max("last_purchase").alias("last_purchase"))
    return R.asof_backward(e.select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "last_purchase").select("event_id", "last_purchase")


@query("cross_grid", "SELECT r.r_name AS rt60, n.q AS snr, k.k AS draw FROM region r, (SELECT DISTINCT quality AS q FROM labels) n, (SELECT unnest([0, 1, 2]) AS k) k WHERE NOT (r.r_name = 'ASIA' AND n.q = 0)")
def cross_grid(spark, d):
    """The grid of conditions without the clean one: a product of three short lists of settings."""
    r = table(spark, d, "region").select(F.col("r_name").alias("rt60"))
    q = table(spark, d, "labels").select(F.col("quality").alias("snr")).distinct()
    k = spark.range(3).select(F.col("id").cast("int").alias("draw"))
    return r.crossJoin(q).crossJoin(k).where("NOT (rt60 = 'ASIA' AND snr = 0)")


@query("grid_with_gaps", """
WITH g AS (SELECT DISTINCT l_returnflag AS a, x AS b FROM lineitem, (SELECT unnest(['F', 'O', 'X']) AS x))
SELECT a, b, coalesce(n::VARCHAR, '—') AS cell FROM g LEFT JOIN (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) USING (a, b)""")
def grid_with_gaps(spark, d):
    li = table(spark, d, "lineitem")
    g = li.select(F.col("l_returnflag").alias("a")).distinct().withColumn("b", F.explode(F.array(*map(F.lit, "FOX"))))
    n = li.groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return g.join(n, ["a", "b"], "left").select("a", "b", F.coalesce(F.col("n").cast("string"), F.lit("—")).alias("cell"))


@query("normalised_id_join", "SELECT d.doc_id, l.label FROM documents d JOIN (SELECT doc_id, source || '-' || doc_id || '-x-sp' || (doc_id % 3) AS label FROM documents) l ON array_to_string(string_split(l.label, '-')[1:2], '-') = d.source || '-' || d.doc_id")
def normalised_id_join(spark, d):
    """Derived rows back to their manifest by the first parts of their id."""
    t = table(spark, d, "documents").select("doc_id", "source")
    derived = t.select(F.concat_ws("-", "source", "doc_id", F.lit("x"), F.concat(F.lit("sp"), F.col("doc_id") % 3)).alias("label"))
    derived = derived.withColumn("key", F.array_join(F.slice(F.split("label", "-"), 1, 2), "-"))
    return R.strict_join(derived, t.select("doc_id", F.concat_ws("-", "source", "doc_id").alias("key")), ["key"]).select("doc_id", "label")


@query("speed_perturbation", f"SELECT id, duration FROM (SELECT conv_id || '-' || turn AS id, duration FROM {SEG} UNION ALL SELECT 'sp0.9-' || conv_id || '-' || turn, duration / 0.9::DOUBLE FROM {SEG} UNION ALL SELECT 'sp1.1-' || conv_id || '-' || turn, duration / 1.1::DOUBLE FROM {SEG})")
def speed_perturbation(spark, d):
    s = segments(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "duration")
    fast = lambda x: s.select(F.concat(F.lit(f"sp{x}-"), "id").alias("id"), (F.col("duration") / F.lit(x)).alias("duration"))
    return s.unionAll(fast(0.9)).unionAll(fast(1.1))


@query("union_distinct_specials", "SELECT c_mktsegment AS symbol FROM customer UNION SELECT r_name FROM region UNION SELECT '<UNK>'")
def union_distinct_specials(spark, d):
    a = table(spark, d, "customer").select(F.col("c_mktsegment").alias("symbol"))
    return a.union(table(spark, d, "region").select("r_name")).union(spark.createDataFrame([("<UNK>",)], "symbol string")).distinct()


@query("set_difference", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def set_difference(spark, d):
    """Orders of which nothing came back."""
    return table(spark, d, "orders").select("o_orderkey").subtract(table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey"))


@query("key_intersection", "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def key_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("manifest_union", "SELECT 'c' AS kind, c_nationkey AS nationkey, c_name AS name FROM customer UNION ALL SELECT 's', s_nationkey, s_name FROM supplier")
def manifest_union(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name")))


@query("duration_filter", f"SELECT conv_id, turn FROM {SEG} WHERE duration BETWEEN 1 AND 20")
def duration_filter(spark, d):
    return segments(spark, d).where(F.col("duration").between(1, 20)).select("conv_id", "turn")


@query("utterance_filter", """
WITH u AS (SELECT conv_id, turn, length(text) / 16.0::DOUBLE AS dur, len(regexp_extract_all(text, '\\S+'))::BIGINT AS tokens, (length(text) * 100) // 16 AS n FROM conversations)
SELECT count(*)::BIGINT AS total, (count(*) FILTER (WHERE NOT (dur BETWEEN 1 AND 20 AND ((n - 1) // 2 - 1) // 2 >= tokens)))::BIGINT AS removed FROM u""")
def utterance_filter(spark, d):
    """Utterances that are too short, too long, or have fewer frames after subsampling than tokens."""
    n = F.floor(F.length("text") * 100 / 16)
    frames = F.floor((F.floor((n - 1) / 2) - 1) / 2)
    keep = (F.length("text") / 16.0).between(1, 20) & (frames >= F.size(X.words(F.col("text"))))
    return table(spark, d, "conversations").agg(F.count(F.lit(1)).alias("total"), F.count_if(~keep).alias("removed"))


@query("long_windows", f"SELECT conv_id, turn, off::DOUBLE AS off FROM (SELECT conv_id, turn, duration, unnest(range(0, ceil(duration)::BIGINT, 10)) AS off FROM {SEG}) WHERE least(duration - off, 10) > 5")
def long_windows(spark, d):
    """Windows of ten seconds; those of five or less go."""
    t = segments(spark, d).select("conv_id", "turn", "duration", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil("duration") - 1, F.lit(0)), F.lit(10).cast("long"))).alias("off"))
    return t.where((F.least(F.col("duration") - F.col("off"), F.lit(10)) > 5) & (F.col("off") < F.col("duration"))).select("conv_id", "turn", F.col("off").cast("double").alias("off"))


@query("overlapped_windows", f"SELECT conv_id, off FROM (SELECT conv_id, unnest(range(0, greatest(ceil(total), 1)::BIGINT, 24)) AS off FROM (SELECT conv_id, sum(duration) AS total FROM {SEG} GROUP BY conv_id))")
def overlapped_windows(spark, d):
    """Windows of 30 s that overlap by 3 s on each side: a hop of 24 s."""
    t = segments(spark, d).groupBy("conv_id").agg(F.sum("duration").alias("total"))
    return t.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil("total"), F.lit(1)) - 1, F.lit(24).cast("long"))).alias("off"))


@query("validation_report", f"SELECT conv_id, turn, 'bounds' AS problem FROM {SEG} s WHERE start + duration > 60 UNION ALL SELECT conv_id, turn, 'empty' FROM conversations WHERE trim(text) = '' UNION ALL SELECT conv_id, turn, 'double' FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1")
def validation_report(spark, d):
    """Violations instead of exceptions: out of bounds, empty, more than one supervision."""
    c = table(spark, d, "conversations")
    say = lambda df, p: df.select("conv_id", "turn", F.lit(p).alias("problem"))
    return say(segments(spark, d).where("start + duration > 60"), "bounds").unionAll(say(c.where("trim(text) = ''"), "empty")).unionAll(say(c.groupBy("conv_id", "turn").count().where("count > 1"), "double"))


@query("sanity_filter", "SELECT event_id FROM events WHERE value > 0 AND json_extract(props, '$.k') IS NOT NULL AND (json_extract(props, '$.k'))::BIGINT > value")
def sanity_filter(spark, d):
    """Segments (value, k) with both fields and the end after the start."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").where((F.col("value") > 0) & k.isNotNull() & (k > F.col("value"))).select("event_id")


@query("json_fallback", "SELECT event_id, coalesce(json_extract_string(props, '$.reason'), 'blocked:' || json_extract_string(props, '$.k')) AS finish FROM events")
def json_fallback(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.reason"), F.concat(F.lit("blocked:"), F.get_json_object("props", "$.k"))).alias("finish"))


@query("custom_field_move", "SELECT doc_id, lang, source, n_chars FROM documents")
def custom_field_move(spark, d):
    """A nested field moves up a level."""
    t = table(spark, d, "documents").select(F.struct("doc_id", F.struct("lang", F.struct("source", "n_chars").alias("custom")).alias("sup")).alias("cut"))
    moved = t.select(F.col("cut").withField("custom", F.col("cut.sup.custom")).withField("sup", F.col("cut.sup").dropFields("custom")).alias("cut"))
    return moved.select("cut.doc_id", "cut.sup.lang", "cut.custom.source", "cut.custom.n_chars")


@query("uneven_batches", "SELECT o_orderkey, l_linenumber FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, l_suppkey, floor(120 / max(l_quantity) OVER (PARTITION BY l_orderkey)) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE k = 0 OR k >= n OR r <= k")
def uneven_batches(spark, d):
    t = table(spark, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return R.uneven_batch(t, "l_orderkey", "l_quantity", "o", 120).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")


@query("total_hours", f"SELECT round(sum(coalesce(duration, 0)) / 3600, 9) AS hours, count(*)::BIGINT AS n FROM {SEG}")
def total_hours(spark, d):
    return segments(spark, d).agg(F.round(F.sum(F.coalesce("duration", F.lit(0.0))) / 3600, 9).alias("hours"), F.count(F.lit(1)).alias("n"))


@query("manifest_statistics", f"SELECT count(*)::BIGINT AS n, round(avg(duration), 9) AS mean, round(stddev_samp(duration), 9) AS std, min(duration) AS shortest, quantile_cont(duration, 0.25) AS p25, quantile_cont(duration, 0.5) AS p50, quantile_cont(duration, 0.75) AS p75, round(quantile_cont(duration, 0.995), 9) AS p995, round(quantile_cont(duration, 0.999), 9) AS p999, max(duration) AS longest FROM {SEG}")
def manifest_statistics(spark, d):
    p = F.percentile("duration", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.995, 0.999))))
    t = segments(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 9).alias("mean"), F.round(F.stddev_samp("duration"), 9).alias("std"), F.min("duration").alias("shortest"), p.alias("p"), F.max("duration").alias("longest"))
    return t.select("n", "mean", "std", "shortest", F.col("p")[0].alias("p25"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p75"), F.round(F.col("p")[3], 9).alias("p995"), F.round(F.col("p")[4], 9).alias("p999"), "longest")


@query("finite_metrics", "SELECT user_id, round(sum(value) FILTER (WHERE event_type <> 'error'), 6) AS total, round((sum(value) FILTER (WHERE event_type <> 'error')) / count(*), 6) AS per_event FROM events GROUP BY user_id")
def finite_metrics(spark, d):
    """Sums of finite values only (errors become NaN first), normalised by count."""
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    ok = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(ok), 6).alias("total"), F.round(F.sum(ok) / F.count(F.lit(1)), 6).alias("per_event"))


@query("tensor_statistics", """
WITH v AS (SELECT vec_id, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
SELECT dim::INT AS dim, round(avg(x), 9) AS mean, round(avg(abs(x)), 9) AS mean_abs, round(avg((x > 0)::INT), 9) AS positive, round(sqrt(avg(x * x)), 9) AS rms, max(x) AS most, min(x) AS least FROM v GROUP BY dim""")
def tensor_statistics(spark, d):
    x = F.col("x")
    t = table(spark, d, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    return t.groupBy("dim").agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.avg(F.abs(x)), 9).alias("mean_abs"), F.round(F.avg((x > 0).cast("int")), 9).alias("positive"), F.round(F.sqrt(F.avg(x * x)), 9).alias("rms"), F.max("x").alias("most"), F.min("x").alias("least"))


@query("vector_norms", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 9) AS l1, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 9) AS l2, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS linf FROM embeddings")
def vector_norms(spark, d):
    """Sum of magnitudes, sum of squares (no root), largest magnitude."""
    x = F.col("embedding").cast("array<double>")
    total = lambda f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
    return table(spark, d, "embeddings").select("vec_id", F.round(total(F.abs), 9).alias("l1"), F.round(total(lambda v: v * v), 9).alias("l2"), F.array_max(F.transform(x, F.abs)).alias("linf"))


@query("weighted_average", "SELECT label, round(sum(x * (vec_id + 1)) / sum(vec_id + 1), 9) AS x FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label")
def weighted_average(spark, d):
    """Weighted mean of parameters over checkpoints (labels stand for parameters)."""
    w = F.col("vec_id") + 1
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.sum(F.col("embedding")[0].cast("double") * w) / F.sum(w), 9).alias("x"))


@query("log_sum_exp", "SELECT user_id, round(max(v) + ln(sum(exp(v - m))), 9) AS score FROM (SELECT user_id, value / 10 AS v, max(value / 10) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def log_sum_exp(spark, d):
    """Scores of equal prefixes merged."""
    t = table(spark, d, "events").select("user_id", (F.col("value") / 10).alias("v"))
    t = t.join(t.groupBy("user_id").agg(F.max("v").alias("m")), "user_id")
    return t.groupBy("user_id").agg(F.round(F.max("v") + F.log(F.sum(F.exp(F.col("v") - F.col("m")))), 9).alias("score"))


@query("best_of_group", "SELECT o_custkey, max(o_totalprice) AS best, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def best_of_group(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("token_confidence", """
SELECT user_id, round(avg(value) FILTER (WHERE event_type <> 'error'), 9) AS mean, min(value) FILTER (WHERE event_type <> 'error') AS least,
       CASE WHEN count(*) FILTER (WHERE event_type <> 'error') = 0 THEN 1.0 ELSE round((min(value) FILTER (WHERE event_type <> 'error') + quantile_cont(value, 0.05) FILTER (WHERE event_type <> 'error') + quantile_cont(value, 0.1) FILTER (WHERE event_type <> 'error') + quantile_cont(value, 0.2) FILTER (WHERE event_type <> 'error')) / 4, 9) END::DOUBLE AS q0_20
FROM events GROUP BY user_id""")
def token_confidence(spark, d):
    """Mean, minimum and low quantiles of scores, blanks (errors here) left out; without any the mean of the parts is 1."""
    v = F.when(F.col("event_type") != "error", F.col("value"))
    t = table(spark, d, "events").groupBy("user_id").agg(F.avg(v).alias("m"), F.min(v).alias("least"), F.percentile(v, F.array(F.lit(0.05), F.lit(0.1), F.lit(0.2))).alias("q"), F.count(v).alias("n"))
    return t.select("user_id", F.round("m", 9).alias("mean"), "least", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.round((F.col("least") + F.col("q")[0] + F.col("q")[1] + F.col("q")[2]) / 4, 9)).alias("q0_20"))


@query("sub_audio_commands", f"SELECT conv_id, turn, 'trim ' || conv_id || '.wav ' || conv_id || '_' || turn || '.wav ' || (round(start * 1000))::BIGINT || ' ' || (round(duration * 1000))::BIGINT AS command FROM {SEG}")
def sub_audio_commands(spark, d):
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return segments(spark, d).select("conv_id", "turn", F.concat(F.lit("trim "), "conv_id", F.lit(".wav "), "conv_id", F.lit("_"), "turn", F.lit(".wav "), ms("start"), F.lit(" "), ms("duration")).alias("command"))


@query("transcript_store", "SELECT conv_id, turn, kind, conv_id || '-' || turn || ':' || chr(9) || kind || '=' || w AS line FROM (SELECT conv_id, turn, 'ref' AS kind, regexp_extract(text, '\\S+') AS w FROM conversations UNION ALL SELECT conv_id, turn, 'hyp', upper(replace(regexp_extract(text, '\\S+'), 'ß', 'SS')) FROM conversations)")
def transcript_store(spark, d):
    w = F.regexp_extract("text", r"\S+", 0)
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.create_map(F.lit("ref"), w, F.lit("hyp"), F.upper(w))).alias("kind", "w"))
    return t.select("conv_id", "turn", "kind", F.concat(F.concat_ws("-", "conv_id", "turn"), F.lit(":\t"), "kind", F.lit("="), "w").alias("line"))


@query("ctm_lines", f"SELECT conv_id, turn, printf('%d A %.2f %.2f %s %.1f', conv_id, round(start * 4) / 4, 0.5::DOUBLE, role, 1.0::DOUBLE) AS line FROM {SEG}")
def ctm_lines(spark, d):
    from voxquarry.sources import stm

    s = segments(spark, d).select("conv_id", "turn", (F.round(F.col("start") * 4) / 4).alias("t"), F.lit(0.5).alias("dur"), F.lit(1.0).alias("score"), "role")
    return s.select("conv_id", "turn", stm.ctm_line(F.col("conv_id"), F.col("t"), F.col("dur"), F.col("role"), F.col("score")).alias("line"))


@query("newest_k", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def newest_k(spark, d):
    """The k newest of each run."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id")


@query("multi_column_sort", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey))::INT AS rank FROM orders QUALIFY rank <= 200")
def multi_column_sort(spark, d):
    """A sorted report's first 200 rows."""
    t = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(200)
    return t.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")).alias("rank"))


@query("natural_sort", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey))::INT AS rank FROM orders")
def natural_sort(spark, d):
    """File names with numbers in natural order, within a folder."""
    from voxquarry.sources import text as T

    name = F.concat(F.lit("wave_"), F.col("o_orderkey"), F.lit(".wav"))
    w = Window.partitionBy("o_orderpriority").orderBy(T.natural_key(F.col("name")))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", name.alias("name")).select("o_orderkey", F.row_number().over(w).alias("rank"))


@query("rollup_extra", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_extra(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
