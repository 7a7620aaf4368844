"""N-best, CTC and phrase queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxquarry.operators import ranking as R
from voxquarry.plans.registry import query, table

TOKENS = "list(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END ORDER BY ts, event_id)"


def token_lists(spark, d):
    """(user_id, tokens, scores): event types as tokens in order, errors as blanks."""
    code = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 3).otherwise(0)
    t = table(spark, d, "events").select("user_id", F.struct("ts", "event_id", code.alias("t"), "value").alias("s")).groupBy("user_id").agg(F.array_sort(F.collect_list("s")).alias("l"))
    return t.select("user_id", F.transform("l", lambda x: x["t"]).alias("tokens"), F.transform("l", lambda x: x["value"]).alias("scores"))


@query("ctc_collapse", """
WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS t FROM events),
l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e)
SELECT user_id, coalesce(string_agg(t::VARCHAR, ' ' ORDER BY ts, event_id) FILTER (WHERE t <> 0 AND (p IS NULL OR p <> t)), '') AS tokens FROM l GROUP BY user_id""")
def ctc_collapse(spark, d):
    t = token_lists(spark, d)
    return t.select("user_id", F.array_join(F.transform(R.collapse(F.col("tokens")), lambda x: x.cast("string")), " ").alias("tokens"))


@query("top_k_hypotheses", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INT AS rank FROM orders QUALIFY rank <= 3")
def top_k_hypotheses(spark, d):
    return R.top_k(table(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice"), 3, "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("top_k_per_frame", "SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(0, len(embedding)), lambda i: {'x': -(embedding[i + 1]), 'i': i}))[1:4], lambda s: s.i::VARCHAR), ' ') AS top FROM embeddings")
def top_k_per_frame(spark, d):
    """The four largest of each frame's scores."""
    z = F.transform("embedding", lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(F.slice(F.array_sort(z), 1, 4), lambda s: s["i"].cast("string")), " ").alias("top"))


@query("hypothesis_threshold", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice > m - 50000")
def hypothesis_threshold(spark, d):
    m = F.max("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").withColumn("m", m).where(F.col("o_totalprice") > F.col("m") - 50000).select("o_orderkey")


@query("nbest_dedupe", "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def nbest_dedupe(spark, d):
    """One hypothesis for each distinct word sequence."""
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("nbest_rescoring", """
WITH t AS (SELECT o_custkey, o_orderkey, w, o_totalprice / 1000 + w * (o_orderkey % 97)::DOUBLE AS score FROM orders, (SELECT unnest([0.0::DOUBLE, 0.5, 1.0, 2.0]) AS w))
SELECT o_custkey, w AS w_lm, o_orderkey, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey, w ORDER BY score DESC, o_orderkey) = 1""")
def nbest_rescoring(spark, d):
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("am"), (F.col("o_orderkey") % 97).cast("double").alias("lm"))
    return R.rescore(t, ["o_custkey"], "o_orderkey", {"lm": [0.0, 0.5, 1.0, 2.0]}).withColumn("score", F.round("score", 6))


@query("two_weight_rescoring", """
WITH t AS (SELECT o_custkey, o_orderkey, a, b, o_totalprice / 1000 + a * (o_orderkey % 97)::DOUBLE + b * (o_orderkey % 31)::DOUBLE AS score FROM orders, (SELECT unnest([0.5::DOUBLE, 1.0]) AS a), (SELECT unnest([-0.5::DOUBLE, -0.1]) AS b))
SELECT o_custkey, a AS w_nnlm, b AS w_ngram, o_orderkey, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey, a, b ORDER BY score DESC, o_orderkey) = 1""")
def two_weight_rescoring(spark, d):
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("am"), (F.col("o_orderkey") % 97).cast("double").alias("nnlm"), (F.col("o_orderkey") % 31).cast("double").alias("ngram"))
    return R.rescore(t, ["o_custkey"], "o_orderkey", {"nnlm": [0.5, 1.0], "ngram": [-0.5, -0.1]}).withColumn("score", F.round("score", 6))


CODES = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END"


@query("phrase_boosting", f"""
WITH t AS (SELECT user_id, {CODES} AS t, lead({CODES}) OVER w AS t1, lead({CODES}, 2) OVER w AS t2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, sum(2 * coalesce(t = 1 AND t1 = 2, false)::INT + 3 * coalesce(t = 1 AND t1 = 2 AND t2 = 3, false)::INT + (t = 3)::INT + 2 * coalesce(t = 2 AND t1 = 2, false)::INT)::DOUBLE AS bonus FROM t GROUP BY user_id""")
def phrase_boosting(spark, d):
    t = token_lists(spark, d)
    return t.select("user_id", R.boost(t, "tokens", [(1, 2), (1, 2, 3), (3,), (2, 2)]).alias("bonus"))


@query("keyword_spotting", f"""
WITH t AS (SELECT user_id, {CODES} AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
r AS (SELECT *, lag(t) OVER w AS t0, lag(value) OVER w AS v0 FROM t WHERE t <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, CASE WHEN t = 2 THEN 0 ELSE 1 END::BIGINT AS phrase, i AS "end" FROM r WHERE ((t0 = 1 AND t = 2) OR (t0 = 3 AND t = 3)) AND (v0 + value) / 2 >= 12""")
def keyword_spotting(spark, d):
    return R.keywords(token_lists(spark, d), ["user_id"], "tokens", "scores", [(1, 2), (3, 3)], 12.0)


@query("inverse_cdf_sampling", """
WITH p AS (SELECT p_brand, p_partkey, p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand) AS p FROM part), c AS (SELECT *, sum(p) OVER (PARTITION BY p_brand ORDER BY p DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS cum FROM p)
SELECT p_brand, arg_min(p_partkey, (cum, p_partkey)) AS pick FROM c WHERE cum > 0.37 GROUP BY p_brand""")
def inverse_cdf_sampling(spark, d):
    """The first item by falling probability whose running sum passes a number."""
    w = Window.partitionBy("p_brand")
    t = table(spark, d, "part").withColumn("p", F.col("p_retailprice") / F.sum("p_retailprice").over(w))
    t = t.withColumn("cum", F.sum("p").over(w.orderBy(F.desc("p"), "p_partkey").rowsBetween(Window.unboundedPreceding, 0)))
    return t.where("cum > 0.37").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("cum", "p_partkey")).alias("pick"))


def uniform_sql(seed: str, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query("corrupt_transcripts", f"""
WITH t AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS w FROM conversations)),
o AS (SELECT word FROM t GROUP BY word ORDER BY count(*) DESC, word LIMIT 1000), pool AS (SELECT list(word ORDER BY word) AS pool FROM o),
x AS (SELECT conv_id, turn, pos, word, list_filter(pool, lambda y: y <> word) AS own, {uniform_sql("corrupt", "conv_id", "turn", "pos")} AS u, {uniform_sql("corrupt|pick", "conv_id", "turn", "pos")} AS pick FROM t, pool),
n AS (SELECT *, own[floor(pick * len(own))::INT + 1] AS new FROM x)
SELECT conv_id, turn, coalesce(string_agg(CASE WHEN u < 0.05::DOUBLE THEN NULL WHEN u < 0.05::DOUBLE + 0.1::DOUBLE THEN new WHEN u < 0.05::DOUBLE + 0.1::DOUBLE + 0.05::DOUBLE THEN word || ' ' || new ELSE word END, ' ' ORDER BY pos), '') AS text FROM n GROUP BY conv_id, turn""")
def corrupt_transcripts(spark, d):
    from voxquarry.operators import sampling as P

    return P.corrupt(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], "text", 0.1, 0.05, 0.05)


@query("weighted_interleave", f"""
SELECT c_name AS name, 0 AS source, round(-ln(1 - {uniform_sql("mux|0", "c_name")}) / 3, 9) AS place FROM customer UNION ALL SELECT s_name, 1, round(-ln(1 - {uniform_sql("mux|1", "s_name")}), 9) FROM supplier""")
def weighted_interleave(spark, d):
    from voxquarry.operators import sampling as P

    a = table(spark, d, "customer").select(F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return P.interleave([(a, 3.0), (b, 1.0)], "name").withColumn("place", F.round("place", 9))


@query("one_hot_alignment", "SELECT vec_id, c::INT AS class, CASE WHEN c = label THEN 0.0 ELSE -10.0 END::DOUBLE AS score FROM embeddings, (SELECT unnest(range(0, 10)) AS c)")
def one_hot_alignment(spark, d):
    """A mask of 0 on the aligned class and a low score elsewhere."""
    t = table(spark, d, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("class"))
    return t.select("vec_id", "class", F.when(F.col("class") == F.col("label"), 0.0).otherwise(-10.0).alias("score"))


@query("prefix_beam_search")
def prefix_beam_search(spark, d):
    """The best prefix of each utterance: vectors as sixteen frames of four symbols' scores; SQL has no beam to follow with."""
    frame = lambda k: F.slice("embedding", 4 * k + 1, 4)
    normal = lambda f: F.transform(f, lambda x: (x - F.log(F.aggregate(f, F.lit(0.0), lambda a, y: a + F.exp(y.cast("double"))))).cast("double"))
    frames = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 4).cast("int") - 1), lambda k: normal(F.transform(frame(k), lambda x: 8 * x)))
    t = R.prefix_beams(table(spark, d, "embeddings").select("vec_id", frames.alias("f")), ["vec_id"], "f", 6, best=1)
    return t.select("vec_id", F.array_join(F.col("prefix").cast("array<string>"), " ").alias("prefix"), F.round("log_p", 6).alias("log_p"))


@query("ngram_state_costs", """
WITH RECURSIVE e AS (SELECT user_id, event_id * 7919 % 23 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s FROM events),
tok AS MATERIALIZED (SELECT user_id || '-' || s // 6 AS utt, s % 6 AS pos, t FROM e), pr AS (SELECT t, lag(t) OVER (PARTITION BY user_id ORDER BY s) AS p FROM e),
arcs AS MATERIALIZED (SELECT p::VARCHAR AS src, t, t::VARCHAR AS dst, -ln(n / sum(n) OVER (PARTITION BY p)::DOUBLE) AS cost, n FROM (SELECT p, t, count(*) AS n FROM pr WHERE p IS NOT NULL GROUP BY ALL) QUALIFY n >= 2
  UNION ALL SELECT 'root', t, t::VARCHAR, -ln(count(*) / sum(count(*)) OVER ()::DOUBLE), count(*) FROM e GROUP BY t),
reach AS (SELECT DISTINCT dst AS src, dst, 0.0::DOUBLE AS c FROM arcs UNION ALL SELECT DISTINCT dst, 'root', ln(2.0::DOUBLE) FROM arcs UNION ALL SELECT 'root', 'root', 0.0::DOUBLE),
st AS (SELECT DISTINCT utt, 0::BIGINT AS k, 'root' AS state, 0.0::DOUBLE AS cost FROM tok
  UNION ALL SELECT s.utt, s.k + 1, a.dst, min(s.cost + r.c + a.cost) FROM st s JOIN tok t ON t.utt = s.utt AND t.pos = s.k JOIN reach r ON r.src = s.state JOIN arcs a ON a.src = r.dst AND a.t = t.t GROUP BY ALL)
SELECT st.utt, round(min(cost), 6) AS cost FROM st JOIN (SELECT utt, max(pos) + 1 AS n FROM tok GROUP BY utt) n ON n.utt = st.utt AND n.n = st.k GROUP BY st.utt""")
def ngram_state_costs(spark, d):
    """Least costs of six tokens at a time under a bigram model whose states back off to the root."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", (F.col("event_id") * 7919 % 23).alias("t"), (F.row_number().over(w) - 1).cast("long").alias("s"), F.lag(F.col("event_id") * 7919 % 23).over(w).alias("p"))
    two = e.where("p IS NOT NULL").groupBy("p", "t").agg(F.count(F.lit(1)).alias("n"))
    two = two.withColumn("cost", -F.log(F.col("n") / F.sum("n").over(Window.partitionBy("p")))).where("n >= 2").select(F.col("p").cast("string").alias("src"), F.col("t").alias("token"), F.col("t").cast("string").alias("dst"), "cost")
    one = e.groupBy("t").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("all"))))  # one row
    one = one.select(F.lit("root").alias("src"), F.col("t").alias("token"), F.col("t").cast("string").alias("dst"), (-F.log(F.col("n") / F.col("all"))).alias("cost"))
    back = one.select(F.col("dst").alias("src"), F.lit("root").alias("dst"), F.log(F.lit(2.0)).alias("cost"))
    tokens = e.select(F.concat("user_id", F.lit("-"), F.floor(F.col("s") / 6)).alias("utt"), (F.col("s") % 6).alias("pos"), F.col("t").alias("token"))
    return R.read_tokens(two.unionByName(one), back, tokens, "root", 1, 6).select("utt", F.round("cost", 6).alias("cost"))
