"""Multi-talker scores, delays, lexicon graphs, hours and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxquarry.functions import text as X
from voxquarry.operators import multitalker as M
from voxquarry.operators import vocab as V
from voxquarry.plans.manifest import SEG, segments
from voxquarry.plans.registry import query, table
from voxquarry.plans.text import WORDS, lines


@query("multi_talker_wer")
def multi_talker_wer(spark, d):
    """User turns of each conversation against its assistant turns as two channels, best assignment."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", X.words(F.lower("text")).alias("w"))
    order = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", "w")))), lambda x: x["w"])
    user, odd = F.col("role") == "user", F.col("turn") % 4 == 1
    t = c.groupBy("conv_id").agg(order(user).alias("refs"), F.flatten(order(~user & odd)).alias("a"), F.flatten(order(~user & ~odd)).alias("b"))
    t = t.select("conv_id", M.assign_channels(F.col("refs"), F.array("a", "b")).alias("r"))
    return t.select("conv_id", "r.errors", "r.words", F.array_join(F.transform("r.assignment", lambda x: x.cast("string")), " ").alias("assignment"))


@query("symbol_delay", """
WITH p AS (SELECT user_id, event_type AS ref, lag(event_type) OVER w AS hyp, event_id AS rt, lag(event_id) OVER w AS ht FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, (count(*) FILTER (WHERE ref = hyp))::BIGINT AS n, coalesce(round(avg(ht - rt) FILTER (WHERE ref = hyp), 6), 'inf'::DOUBLE) AS mean, coalesce(round(var_pop(ht - rt) FILTER (WHERE ref = hyp), 4), 'inf'::DOUBLE) AS var FROM p GROUP BY user_id""")
def symbol_delay(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, d, "events").select("user_id", F.col("event_type").alias("ref"), F.lag("event_type").over(w).alias("hyp"), F.col("event_id").alias("rt"), F.lag("event_id").over(w).alias("ht"))
    t = M.symbol_delay(p, ["user_id"], "rt", "ht")
    return t.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"))


@query("lexicon_arcs", """
WITH l AS (SELECT n_name AS word, string_split(n_name, '') AS t FROM nation), b AS (SELECT *, coalesce(sum(len(t) - 1) OVER (ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l),
x AS (SELECT word, b, len(t) AS n, i - 1 AS pos, t[i] AS token FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM b))
SELECT word, pos::INT AS pos, CASE WHEN pos = 0 THEN 0 ELSE b + pos END::BIGINT AS src, CASE WHEN pos = n - 1 THEN 0 ELSE b + pos + 1 END::BIGINT AS dst, token, CASE WHEN pos = 0 THEN word ELSE '<eps>' END AS out FROM x""")
def lexicon_arcs(spark, d):
    lex = table(spark, d, "nation").select(F.col("n_name").alias("word"), F.filter(F.split("n_name", ""), lambda c: c != "").alias("tokens"))
    return M.lexicon_arcs(lex, "word")


@query("flexible_lexicon", f"SELECT word, array_to_string(string_split(word, ''), ' ') AS tokens FROM (SELECT DISTINCT word FROM {WORDS}) UNION ALL SELECT '<star>', '<star>'")
def flexible_lexicon(spark, d):
    lex = V.distinct_words(lines(spark, d)).select("word", F.filter(F.split("word", ""), lambda c: c != "").alias("tokens"))
    return M.with_flexible_token(lex).select("word", F.array_join("tokens", " ").alias("tokens"))


@query("hours_until_blank", f"""
WITH s AS (SELECT conv_id, turn, duration, min(CASE WHEN duration < 2 THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM {SEG})
SELECT conv_id, round(coalesce(sum(duration), 0) / 3600, 12) AS hours FROM s WHERE stop IS NULL OR turn < stop GROUP BY conv_id""")
def hours_until_blank(spark, d):
    """Durations up to the line that ends a file (here: a very short segment)."""
    stop = F.min(F.when(F.col("duration") < 2, F.col("turn"))).over(Window.partitionBy("conv_id"))
    t = segments(spark, d).withColumn("stop", stop).where("stop IS NULL OR turn < stop")
    return t.groupBy("conv_id").agg(F.round(F.coalesce(F.sum("duration"), F.lit(0.0)) / 3600, 12).alias("hours"))
