"""Alignment, error scoring and grid queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxquarry.functions import text as X
from voxquarry.operators import align as A
from voxquarry.operators import grid as G
from voxquarry.plans.registry import query, table


def turn_pairs(spark, d):
    """(conv_id, turn, ref, hyp): words of a user turn and of the assistant turn after it."""
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", X.words(F.lower("text")).alias("ref"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), X.words(F.lower("text")).alias("hyp"))
    return u.join(a, ["conv_id", "turn"])


def positional_pairs(spark, d):
    """(conv_id, turn, pos, ref, hyp): word i with word i, the longer side's rest alone. An alignment that SQL can follow."""
    z = F.arrays_zip(F.transform(F.sequence(F.lit(0), F.greatest(F.size("ref"), F.size("hyp")) - 1), lambda i: F.struct(F.get("ref", i).alias("ref"), F.get("hyp", i).alias("hyp"))).alias("p"))
    t = turn_pairs(spark, d).where(F.greatest(F.size("ref"), F.size("hyp")) > 0)
    return t.select("conv_id", "turn", F.posexplode(z).alias("pos", "z")).select("conv_id", "turn", "pos", "z.p.ref", "z.p.hyp")


TURN_PAIRS = """tp AS (SELECT u.conv_id, u.turn, regexp_extract_all(lower(u.text), '\\S+') AS r, regexp_extract_all(lower(a.text), '\\S+') AS h
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
SPANS = """t AS (SELECT *, coalesce(ref = hyp, false) AS ok FROM p),
s0 AS (SELECT *, (ok OR coalesce(lag(ok) OVER (PARTITION BY conv_id, turn ORDER BY pos), true))::INT AS o FROM t),
s AS (SELECT *, (sum(o) OVER (PARTITION BY conv_id, turn ORDER BY pos))::BIGINT AS span FROM s0),
sp AS (SELECT conv_id, turn, span, coalesce(string_agg(ref, ' ' ORDER BY pos), '') AS ref_text, coalesce(string_agg(hyp, ' ' ORDER BY pos), '') AS hyp_text,
       (count(*) FILTER (WHERE ok))::BIGINT AS m, (count(*) FILTER (WHERE NOT ok AND ref IS NOT NULL AND hyp IS NOT NULL))::BIGINT AS s,
       (count(*) FILTER (WHERE ref IS NULL))::BIGINT AS i, (count(*) FILTER (WHERE hyp IS NULL))::BIGINT AS d FROM s GROUP BY conv_id, turn, span)"""
PAIRS = f"""{TURN_PAIRS},
p AS (SELECT conv_id, turn, i - 1 AS pos, r[i] AS ref, h[i] AS hyp FROM (SELECT *, unnest(range(1, greatest(len(r), len(h)) + 1)) AS i FROM tp)),
{SPANS}"""


@query("runaway_guard", f"WITH {TURN_PAIRS} SELECT conv_id, turn, CASE WHEN len(h) > 60 THEN 'runaway' ELSE 'scored' END AS status, CASE WHEN len(h) <= 60 THEN greatest(len(r), len(h)) <= 0 END AS empty FROM tp")
def runaway_guard(spark, d):
    """Hypotheses beyond the limit are labelled and never reach the aligner, whose pairs are null for them."""
    t = A.guarded(turn_pairs(spark, d), "ref", "hyp", max_words=60)
    return t.select("conv_id", "turn", "status", (F.size("pairs") == 0).alias("empty"))


@query("reference_cleaning", "SELECT conv_id, string_agg(t, ' ' ORDER BY turn) AS text FROM (SELECT conv_id, turn, trim(regexp_replace(replace(text, '<unk>', ''), '[ \\t\\n\\f\\r]+', ' ', 'g')) AS t FROM conversations) GROUP BY conv_id")
def reference_cleaning(spark, d):
    """Cleaned lines of a recording as one sequence."""
    t = table(spark, d, "conversations").select("conv_id", "turn", X.clean_reference(F.col("text")).alias("t"))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), " ").alias("text"))


@query("error_spans", f"WITH {PAIRS} SELECT * FROM sp")
def error_spans(spark, d):
    return A.spans(positional_pairs(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", "span", "ref_text", "hyp_text", "m", "s", "i", "d")


ALLOWED = """, al AS (SELECT *, (m = 0 AND ref_text <> '' AND hyp_text <> '' AND abs(length(ref_text) - length(hyp_text)) <= 2) AS mixed,
  (m = 0 AND ref_text = '' AND length(hyp_text) < 8) OR (m = 0 AND hyp_text = '' AND length(ref_text) < 8) AS loose FROM sp),
c AS (SELECT conv_id, turn, span, ref_text, hyp_text, mixed OR loose AS allowed, CASE WHEN mixed THEN 1 ELSE m END AS m, CASE WHEN mixed OR loose THEN 0 ELSE s END AS s, CASE WHEN mixed OR loose THEN 0 ELSE i END AS i, CASE WHEN mixed OR loose THEN 0 ELSE d END AS d FROM al)"""


def allowed_spans(pairs):
    """Spans with allow-lists derived from the data: near-equal lengths may replace each other, short texts may come and go."""
    sp = A.spans(pairs, ["conv_id", "turn"])
    mixed = sp.where("m = 0 AND ref_text <> '' AND hyp_text <> '' AND abs(length(ref_text) - length(hyp_text)) <= 2").select(F.col("ref_text").alias("a"), F.col("hyp_text").alias("b"))
    ins = sp.where("m = 0 AND ref_text = '' AND length(hyp_text) < 8").select(F.col("hyp_text").alias("text"))
    dels = sp.where("m = 0 AND hyp_text = '' AND length(ref_text) < 8").select(F.col("ref_text").alias("text"))
    return A.apply_allow_lists(sp, mixed, ins, dels)


@query("allow_list_scoring", f"WITH {PAIRS}{ALLOWED} SELECT conv_id, turn, span, allowed, m::BIGINT AS m, s::BIGINT AS s, i::BIGINT AS i, d::BIGINT AS d FROM c")
def allow_list_scoring(spark, d):
    return allowed_spans(positional_pairs(spark, d)).select("conv_id", "turn", "span", "allowed", "m", "s", "i", "d")


@query("error_rates", f"""WITH {PAIRS}{ALLOWED}, g AS (SELECT conv_id, sum(m)::BIGINT AS m, sum(s)::BIGINT AS s, sum(i)::BIGINT AS i, sum(d)::BIGINT AS d FROM c GROUP BY conv_id),
r AS (SELECT *, CASE WHEN m + s + d = 0 THEN 0 ELSE (s + i + d) / (m + s + d)::DOUBLE END AS wer, CASE WHEN m + s + d = 0 THEN 0 ELSE m / (m + s + d)::DOUBLE END AS recall, CASE WHEN m + s + i = 0 THEN 0 ELSE m / (m + s + i)::DOUBLE END AS precision FROM g)
SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r""")
def error_rates(spark, d):
    return A.totals(allowed_spans(positional_pairs(spark, d)), ["conv_id"])


@query("error_counters", f"WITH {PAIRS}{ALLOWED} SELECT CASE WHEN ref_text = '' THEN 'insertion' WHEN hyp_text = '' THEN 'deletion' ELSE 'substitution' END AS kind, ref_text, hyp_text, count(*)::BIGINT AS n FROM c WHERE NOT allowed AND s + i + d > 0 GROUP BY ALL")
def error_counters(spark, d):
    return A.counters(allowed_spans(positional_pairs(spark, d)))


@query("word_error_stats", f"""WITH {PAIRS}, w AS (SELECT ref AS word, ref, hyp, 'ref' AS side FROM p WHERE ref IS NOT NULL UNION ALL SELECT hyp, ref, hyp, 'hyp' FROM p WHERE hyp IS NOT NULL)
SELECT word, (count(*) FILTER (WHERE side = 'ref' AND ref = hyp))::BIGINT AS corr, (count(*) FILTER (WHERE side = 'ref' AND ref <> hyp))::BIGINT AS ref_sub, (count(*) FILTER (WHERE side = 'hyp' AND ref <> hyp))::BIGINT AS hyp_sub,
       (count(*) FILTER (WHERE ref IS NULL))::BIGINT AS ins, (count(*) FILTER (WHERE hyp IS NULL))::BIGINT AS del FROM w GROUP BY word""")
def word_error_stats(spark, d):
    return A.word_stats(positional_pairs(spark, d))


@query("utterance_attribution", f"""WITH {PAIRS}, q AS (SELECT *, ok AS mt, (sum((ref IS NOT NULL)::INT) OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1) // 5 AS u FROM s)
SELECT conv_id, turn, greatest(coalesce(u, 0), 0)::BIGINT AS utt, (count(*) FILTER (WHERE mt))::BIGINT AS m, (count(*) FILTER (WHERE NOT mt AND ref IS NOT NULL AND hyp IS NOT NULL))::BIGINT AS s,
       (count(*) FILTER (WHERE ref IS NULL))::BIGINT AS i, (count(*) FILTER (WHERE hyp IS NULL))::BIGINT AS d FROM q GROUP BY ALL""")
def utterance_attribution(spark, d):
    """Errors by utterance of five reference words; an insertion goes to the last reference word's."""
    p = positional_pairs(spark, d)
    n = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("pos")) - 1
    utt = p.where("ref IS NOT NULL").select("conv_id", "turn", n.cast("long").alias("ref_pos"))
    utt = utt.withColumn("utt", F.floor(F.col("ref_pos") / 5))
    return A.attribute(p, ["conv_id", "turn"], utt)


@query("character_error_rate", """
WITH x AS (SELECT u.conv_id, u.turn, regexp_replace(lower(u.text), '[^a-z ]', '', 'g') AS r, regexp_replace(lower(a.text), '[^a-z ]', '', 'g') AS h FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, CASE WHEN length(r) = 0 THEN CASE WHEN length(h) = 0 THEN 0 ELSE 1 END ELSE levenshtein(r, h) / length(r)::DOUBLE END::DOUBLE AS cer FROM x""")
def character_error_rate(spark, d):
    c = table(spark, d, "conversations")
    plain = F.regexp_replace(F.lower("text"), "[^a-z ]", "")
    u = c.where("role = 'user'").select("conv_id", "turn", plain.alias("r"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), plain.alias("h"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", A.cer(F.col("r"), F.col("h")).alias("cer"))


@query("cer_gate", """
WITH x AS (SELECT u.conv_id, u.turn, regexp_replace(lower(u.text), '[^a-z ]', '', 'g') AS r, regexp_replace(lower(a.text), '[^a-z ]', '', 'g') AS h FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn FROM x WHERE CASE WHEN length(r) = 0 THEN CASE WHEN length(h) = 0 THEN 0 ELSE 1 END ELSE levenshtein(r, h) / length(r)::DOUBLE END < 0.8""")
def cer_gate(spark, d):
    """Training data below a character error rate (0.8 here, as the turns are no transcripts of each other)."""
    return character_error_rate(spark, d).where("cer < 0.8").select("conv_id", "turn")


# ---- grid: cell = (l_returnflag, l_linestatus), draw = l_linenumber, utterance = l_suppkey % 101 -----------------------

COUNTS = "counts AS (SELECT l_returnflag AS rt60, l_linestatus AS snr, l_linenumber AS draw, l_suppkey % 101 AS utt, 40 + l_partkey % 23 AS m, l_quantity::BIGINT % 7 AS s, l_partkey % 3 AS i, l_quantity::BIGINT % 5 AS d FROM lineitem)"


def counts(spark, d):
    q, p = F.col("l_quantity").cast("long"), F.col("l_partkey")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("rt60"), F.col("l_linestatus").alias("snr"), F.col("l_linenumber").alias("draw"), (F.col("l_suppkey") % 101).alias("utt"), (40 + p % 23).alias("m"), (q % 7).alias("s"), (p % 3).alias("i"), (q % 5).alias("d"))


CELLS = "cells AS (SELECT rt60, snr, sum(s + i + d)::BIGINT AS err, sum(m + s + d)::BIGINT AS ref, sum(s + i + d) / sum(m + s + d)::DOUBLE AS wer FROM counts GROUP BY 1, 2)"


@query("grid_cells", f"WITH {COUNTS}, {CELLS} SELECT rt60, snr, err, ref, round(wer, 12) AS wer FROM cells")
def grid_cells(spark, d):
    return G.cells(counts(spark, d), ["rt60", "snr"]).withColumn("wer", F.round("wer", 12))


@query("grid_draws", f"WITH {COUNTS}, k AS (SELECT rt60, snr, draw, sum(s + i + d) / sum(m + s + d)::DOUBLE AS wer FROM counts GROUP BY 1, 2, 3) SELECT rt60, snr, count(*)::BIGINT AS k, round(avg(wer), 12) AS mean, round(coalesce(stddev_samp(wer), 0), 12) AS sd FROM k GROUP BY 1, 2")
def grid_draws(spark, d):
    t = G.draws(counts(spark, d), ["rt60", "snr"], "draw")
    return t.withColumn("mean", F.round("mean", 12)).withColumn("sd", F.round("sd", 12))


@query("grid_runs", f"WITH {COUNTS} SELECT rt60 || '_' || snr || '_d' || draw AS id, sum(m)::BIGINT AS m, sum(s)::BIGINT AS s, sum(i)::BIGINT AS i, sum(d)::BIGINT AS d, round(sum(s + i + d) / sum(m + s + d)::DOUBLE, 12) AS wer FROM counts GROUP BY rt60, snr, draw")
def grid_runs(spark, d):
    e, n = G.errors()
    t = counts(spark, d).groupBy("rt60", "snr", "draw").agg(*[F.sum(c).cast("long").alias(c) for c in "msid"])
    return t.select(F.concat("rt60", F.lit("_"), "snr", F.lit("_d"), "draw").alias("id"), *"msid", F.round(e / n, 12).alias("wer"))


@query("grid_marginals", f"WITH {COUNTS}, {CELLS} SELECT 'rt60' AS axis, rt60 AS level, round(avg(wer), 12) AS wer FROM cells GROUP BY rt60 UNION ALL SELECT 'snr', snr, round(avg(wer), 12) FROM cells GROUP BY snr")
def grid_marginals(spark, d):
    """Unweighted means of cell rates along each axis."""
    c = G.cells(counts(spark, d), ["rt60", "snr"])
    one = lambda axis: G.marginal(c, axis).select(F.lit(axis).alias("axis"), F.col(axis).alias("level"), F.round("wer", 12).alias("wer"))
    return one("rt60").unionAll(one("snr"))


REPS = "w AS (SELECT r AS rep, u AS utt, (u * 7919 + r * 104729) % 4 AS w FROM (SELECT unnest(range(0, 200)) AS r), (SELECT unnest(range(0, 101)) AS u)), reps AS (SELECT rt60, snr, rep, sum(w * e) / sum(w * n)::DOUBLE AS wer FROM (SELECT rt60, snr, utt, sum(s + i + d) AS e, sum(m + s + d) AS n FROM counts GROUP BY 1, 2, 3) JOIN w USING (utt) GROUP BY 1, 2, 3)"


def replicate_table(spark, d):
    """Replicates under weights that both engines compute alike."""
    r, u = spark.range(200).withColumnRenamed("id", "rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"))).alias("utt")
    w = r.select("rep", u).select("rep", "utt", ((F.col("utt") * 7919 + F.col("rep") * 104729) % 4).alias("w"))
    return G.replicates(counts(spark, d), w, ["rt60", "snr"])


@query("bootstrap_replicates", f"WITH {COUNTS}, {REPS} SELECT rt60, snr, rep, round(wer, 12) AS wer FROM reps")
def bootstrap_replicates(spark, d):
    return replicate_table(spark, d).withColumn("wer", F.round("wer", 12))


@query("bootstrap_intervals", f"WITH {COUNTS}, {REPS} SELECT rt60, snr, round(quantile_cont(wer, 0.025), 10) AS lo, round(quantile_cont(wer, 0.975), 10) AS hi FROM reps GROUP BY 1, 2")
def bootstrap_intervals(spark, d):
    return G.intervals(replicate_table(spark, d), ["rt60", "snr"]).select("rt60", "snr", F.round("lo", 10).alias("lo"), F.round("hi", 10).alias("hi"))


@query("paired_deltas", f"WITH {COUNTS}, {REPS}, b AS (SELECT rep, wer AS b FROM reps WHERE rt60 = 'A' AND snr = 'F'), x AS (SELECT rt60, snr, rep, wer - b AS delta FROM reps JOIN b USING (rep)) SELECT rt60, snr, round(quantile_cont(delta, 0.025), 10) AS lo, round(quantile_cont(delta, 0.975), 10) AS hi, (quantile_cont(delta, 0.025) > 0 OR quantile_cont(delta, 0.975) < 0) AS significant FROM x GROUP BY 1, 2")
def paired_deltas(spark, d):
    """Paired differences from one condition, and whether their interval excludes 0."""
    reps = replicate_table(spark, d)
    x = G.deltas(reps, ["rt60", "snr"], reps.where("rt60 = 'A' AND snr = 'F'"))
    t = G.intervals(x, ["rt60", "snr"], "delta")
    return t.select("rt60", "snr", F.round("lo", 10).alias("lo"), F.round("hi", 10).alias("hi"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))


@query("numpy_bootstrap")
def numpy_bootstrap(spark, d):
    """Intervals under NumPy's multinomial weights."""
    w = G.bootstrap_weights(spark, 101, 1000, 0)
    return G.intervals(G.replicates(counts(spark, d), w, ["rt60", "snr"]), ["rt60", "snr"])


@query("two_level_bootstrap")
def two_level_bootstrap(spark, d):
    """Intervals under NumPy's weights of utterances and of each cell's draws."""
    c = counts(spark, d)
    w, own = G.two_level_weights(c, ["rt60", "snr"], "draw", 101, 400, 0)
    return G.intervals(G.two_level_replicates(c, w, own, ["rt60", "snr"], "draw"), ["rt60", "snr"])


@query("settings_by_rate", f"WITH {COUNTS}, {CELLS} SELECT rt60, snr, round(wer, 12) AS wer, (row_number() OVER (ORDER BY wer, rt60, snr))::INT AS rank, row_number() OVER (ORDER BY wer, rt60, snr) = 1 AS best FROM cells")
def settings_by_rate(spark, d):
    r = F.row_number().over(Window.orderBy("wer", "rt60", "snr"))
    return G.cells(counts(spark, d), ["rt60", "snr"]).select("rt60", "snr", F.round("wer", 12).alias("wer"), r.alias("rank"), (r == 1).alias("best"))


@query("best_system_per_row", f"WITH {COUNTS}, {CELLS} SELECT rt60, round(max(wer) FILTER (WHERE snr = 'F'), 12) AS f, round(max(wer) FILTER (WHERE snr = 'O'), 12) AS o, round(min(wer), 12) AS least FROM cells GROUP BY rt60")
def best_system_per_row(spark, d):
    """Systems side by side with the least of each row."""
    p = G.cells(counts(spark, d), ["rt60", "snr"]).groupBy("rt60").pivot("snr", ["F", "O"]).agg(F.max("wer"))
    return p.select("rt60", F.round("F", 12).alias("f"), F.round("O", 12).alias("o"), F.round(F.least("F", "O"), 12).alias("least"))


@query("display_deltas", f"WITH {COUNTS}, {CELLS} SELECT rt60, snr, (CASE WHEN wer >= 0.5 THEN '+' ELSE '-' END) || (floor(abs(wer - 0.5) * 1000))::BIGINT AS shown FROM cells")
def display_deltas(spark, d):
    """Signed display strings (in thousandths, cut)."""
    x = F.col("wer") - 0.5
    return G.cells(counts(spark, d), ["rt60", "snr"]).select("rt60", "snr", F.concat(F.when(x >= 0, "+").otherwise("-"), F.floor(F.abs(x) * 1000).cast("string")).alias("shown"))
