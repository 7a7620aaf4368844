"""Language-model queries over the first lines' words of documents' languages: sentences are conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxquarry.functions import text as X
from voxquarry.operators import archive as R
from voxquarry.operators import ngram_lm as L
from voxquarry.plans.registry import query, table
from voxquarry.scratch import materialise

ORDER = 3


def sentences(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.words(F.lower("text")).alias("w"))


def step(df):
    return materialise(df, "grams")


def model(spark, d, order=ORDER):
    """The estimated model as a written step: scoring joins it several times."""
    return materialise(L.estimate(sentences(spark, d), "w", order, step), "model")


def grams_sql(order: int) -> str:
    """CTEs of a model of `order` over the turns: z (words with neighbours), g, c, dd, p and lm."""
    gram = [("''", "x", "ctx"), ("x", "x1", "ctx"), ("x || ' ' || x1", "x2", "NULL")]
    parts = [f"SELECT {n}::INT AS n, {h} AS hist, {w} AS word, {'ctx' if n < order else 'NULL::VARCHAR'} AS ctx FROM z WHERE {w} IS NOT NULL" for n, (h, w, _) in enumerate(gram[:order], 1)]
    return f"""sent AS (SELECT row_number() OVER () AS k, list_concat(['<s>'], regexp_extract_all(lower(text), '\\S+'), ['</s>']) AS w FROM conversations),
tok AS (SELECT k, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM sent),
z AS MATERIALIZED (SELECT x, lag(x) OVER o AS ctx, lead(x) OVER o AS x1, lead(x, 2) OVER o AS x2 FROM tok WINDOW o AS (PARTITION BY k ORDER BY i)),
g AS ({" UNION ALL ".join(parts)}),
c AS MATERIALIZED (SELECT n, hist, word, count(*)::BIGINT AS c, count(DISTINCT ctx)::BIGINT AS n_ctx FROM g GROUP BY 1, 2, 3),
dd AS MATERIALIZED (SELECT n, CASE WHEN n = 1 THEN 0.0 ELSE greatest(0.1, count(*) FILTER (WHERE c = 1))::DOUBLE / (count(*) FILTER (WHERE c = 1) + 2 * count(*) FILTER (WHERE c = 2)) END::DOUBLE AS d FROM c GROUP BY n),
p AS MATERIALIZED (SELECT c.n, c.hist, c.word, c.c, c.n_ctx, CASE WHEN c.n = {order} OR sum(c.n_ctx) OVER w = 0 THEN greatest(c.c - d, 0.0::DOUBLE) / (sum(c.c) OVER w)::DOUBLE ELSE greatest(c.n_ctx - d, 0.0::DOUBLE) / (sum(c.n_ctx) OVER w)::DOUBLE END AS f
      FROM c JOIN dd USING (n) WINDOW w AS (PARTITION BY c.n, c.hist)),
sh AS (SELECT *, n - 1 AS n1, CASE WHEN contains(hist, ' ') THEN substr(hist, strpos(hist, ' ') + 1) ELSE '' END AS h1 FROM p WHERE n > 1),
ab AS MATERIALIZED (SELECT sh.n, sh.hist, sum(sh.f) AS a, sum(lo.f) AS b FROM sh JOIN p lo ON lo.n = sh.n1 AND lo.hist = sh.h1 AND lo.word = sh.word GROUP BY 1, 2),
pk AS (SELECT *, n + 1 AS n2, CASE WHEN hist = '' THEN word ELSE hist || ' ' || word END AS gram FROM p),
lm AS MATERIALIZED (SELECT pk.n, pk.hist, pk.word, pk.c, pk.n_ctx, pk.f, pk.gram, CASE WHEN pk.word <> '</s>' AND ab.b < 1 THEN (1 - a) / (1 - b) END AS bow FROM pk LEFT JOIN ab ON ab.n = pk.n2 AND ab.hist = pk.gram)"""


GRAMS = grams_sql(ORDER)


@query("ngram_counts", f"WITH {GRAMS} SELECT n, hist, word, c, n_ctx FROM c")
def ngram_counts(spark, d):
    return L.counts(sentences(spark, d), "w", ORDER, step)


@query("ngram_discounts", f"WITH {GRAMS} SELECT n, round(d, 12) AS d FROM dd")
def ngram_discounts(spark, d):
    return L.discounts(L.counts(sentences(spark, d), "w", ORDER, step), ORDER).select("n", F.round("d", 12).alias("d"))


@query("kneser_ney", f"WITH {GRAMS} SELECT n, hist, word, round(f, 10) AS f, round(bow, 8) AS bow FROM lm")
def kneser_ney(spark, d):
    return L.estimate(sentences(spark, d), "w", ORDER, step).select("n", "hist", "word", F.round("f", 10).alias("f"), F.round("bow", 8).alias("bow"))


ONE, TWO, THREE = (f"(SELECT * FROM lm WHERE n = {n})" for n in (1, 2, 3))


@query("backoff_scores", f"""
WITH {GRAMS}, q AS MATERIALIZED (SELECT DISTINCT word AS hist, hist AS word, word || ' ' || hist AS gram FROM p WHERE n = 2 AND word <> '</s>' AND hist <> '<s>'),
two AS MATERIALIZED (SELECT gram, log10(f) AS two FROM lm WHERE n = 2), one AS MATERIALIZED (SELECT word, log10(f) AS one, coalesce(log10(bow), 0) AS w FROM lm WHERE n = 1)
SELECT q.hist, q.word, round(coalesce(two, coalesce(h.w, 0) + o.one), 8) AS log_p FROM q LEFT JOIN two USING (gram) LEFT JOIN one o ON o.word = q.word LEFT JOIN one h ON h.word = q.hist""")
def backoff_scores(spark, d):
    """Scores of every word pair of the corpus turned around: most were never seen and back off."""
    m = model(spark, d)
    q = m.where("n = 2 AND word <> '</s>' AND hist <> '<s>'").select(F.col("word").alias("hist"), F.col("hist").alias("word"))  # distinct, as the model's are
    return L.score(m, q, 2).select("hist", "word", F.round("log_p", 8).alias("log_p"))  # histories of one word


SCORED = f"""sp AS (SELECT conv_id, turn, w, unnest(range(1, len(w))) AS i FROM (SELECT conv_id, turn, list_concat(['<s>'], regexp_extract_all(lower(text), '\\S+'), ['</s>']) AS w FROM conversations)),
q AS (SELECT conv_id, turn, i, w[i + 1] AS word, w[i] AS h1, CASE WHEN i >= 2 THEN w[i - 1] || ' ' || w[i] END AS h2 FROM sp),
scored AS (SELECT conv_id, turn, count(*)::BIGINT AS n, sum(CASE WHEN h2 IS NOT NULL AND t3.f IS NOT NULL THEN log10(t3.f)
  ELSE (CASE WHEN h2 IS NOT NULL THEN coalesce(log10(b2.bow), 0) ELSE 0 END) + coalesce(log10(t2.f), coalesce(log10(b1.bow), 0) + log10(t1.f)) END) AS log_p
FROM q LEFT JOIN {THREE} t3 ON t3.hist = h2 AND t3.word = q.word LEFT JOIN {TWO} t2 ON t2.hist = h1 AND t2.word = q.word LEFT JOIN {ONE} t1 ON t1.word = q.word
LEFT JOIN {ONE} b1 ON b1.word = h1 LEFT JOIN {TWO} b2 ON b2.gram = h2 GROUP BY conv_id, turn)"""


@query("sentence_log_probability", f"WITH {GRAMS}, {SCORED} SELECT conv_id, turn, n, round(log_p, 6) AS log_p FROM scored")
def sentence_log_probability(spark, d):
    s = sentences(spark, d)
    t = L.sentence_scores(model(spark, d), s, ["conv_id", "turn"], "w", ORDER)
    return t.select("conv_id", "turn", "n", F.round("log_p", 6).alias("log_p"))


@query("perplexity", f"WITH {GRAMS}, {SCORED} SELECT round(pow(10.0::DOUBLE, -sum(log_p) / sum(n)), 6) AS perplexity FROM scored")
def perplexity(spark, d):
    s = sentences(spark, d)
    t = L.perplexity(L.sentence_scores(model(spark, d), s, ["conv_id", "turn"], "w", ORDER))
    return t.select(F.round("perplexity", 6).alias("perplexity"))


@query("lm_validation", f"""
WITH {GRAMS}, a AS (SELECT n, hist, sum(f) AS a FROM lm GROUP BY 1, 2), b AS (SELECT sh.n, sh.hist, sum(lo.f) AS b FROM sh LEFT JOIN p lo ON lo.n = sh.n1 AND lo.hist = sh.h1 AND lo.word = sh.word GROUP BY 1, 2),
m AS (SELECT a.n, a.hist, a + CASE WHEN a.n > 1 THEN coalesce(lm.bow, 0) * (1 - b) ELSE 0 END AS total FROM a LEFT JOIN b USING (n, hist) LEFT JOIN lm ON lm.n = a.n - 1 AND lm.gram = a.hist)
SELECT count(*)::BIGINT AS histories, (count(*) FILTER (WHERE abs(total - 1) > 1e-6))::BIGINT AS unsound FROM m""")
def lm_validation(spark, d):
    """Histories whose probabilities don't sum to 1 (a weight that is undefined leaves its history to itself)."""
    m = L.mass(model(spark, d), ORDER)
    return m.agg(F.count(F.lit(1)).alias("histories"), F.count_if(F.abs(F.col("total") - 1) > 1e-6).alias("unsound"))


@query("entropy_pruning", f"""
WITH {grams_sql(2)}, one AS (SELECT word, f, bow FROM lm WHERE n = 1), t AS (SELECT two.hist, two.word, two.f, one.f AS low FROM lm two JOIN one USING (word) WHERE two.n = 2),
per AS (SELECT hist, 1 - sum(f) AS num, 1 - sum(low) AS den FROM t GROUP BY hist),
x AS (SELECT t.*, num, den, j.f AS joint, coalesce(log10(nullif(b.bow, 0)), 0) AS old, CASE WHEN num + t.f > 0 AND den + low > 0 THEN log10(num + t.f) - log10(den + low) END AS new
      FROM t JOIN per USING (hist) JOIN one j ON j.word = CASE WHEN t.hist = '<s>' THEN '</s>' ELSE t.hist END LEFT JOIN one b ON b.word = t.hist),
e AS (SELECT *, -joint * (f * (log10(nullif(low, 0)) + new - log10(nullif(f, 0))) + num * (new - old)) AS entropy FROM x)
SELECT 1 AS n, count(*)::BIGINT AS ngrams FROM one UNION ALL SELECT 2, count(*)::BIGINT FROM e WHERE NOT coalesce(pow(10.0::DOUBLE, entropy) - 1 < 1e-6, false)""")
def entropy_pruning(spark, d):
    """What is left of each order after pruning."""
    return L.prune(model(spark, d, 2), 2, 1e-6, keep=lambda df: materialise(df, "pruned")).groupBy("n").agg(F.count(F.lit(1)).alias("ngrams"))


@query("training_archive", "SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+'))::INT AS words, length(replace(replace(text, ' ', ''), chr(10), ''))::INT AS tokens FROM conversations")
def training_archive(spark, d):
    """Sentence lengths in words and in character tokens."""
    w = X.words(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(w).alias("words"), F.size(F.flatten(F.transform(w, lambda x: F.filter(F.split(x, ""), lambda c: c != "")))).alias("tokens"))


WORD_TABLE = """w AS (SELECT conv_id, turn, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS ws FROM conversations)),
f AS (SELECT word, row_number() OVER (ORDER BY min((conv_id, turn, i))) - 1 AS word_id, list_transform(string_split(word, ''), lambda c: unicode(c)) AS pieces FROM w GROUP BY word)"""


def archive(spark, d):
    """Sentences (conv_id, turn, words) and the table of words; pieces are the code points of a word's characters."""
    t = table(spark, d, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("words"))
    points = lambda w: F.transform(F.filter(F.split(w, ""), lambda c: c != ""), F.ascii)
    return t, R.words_table(t, ["conv_id", "turn"], "words", points)


@query("archive_words", f"WITH {WORD_TABLE} SELECT word_id::BIGINT AS word_id, word, pieces, coalesce(sum(len(pieces)) OVER (ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM f")
def archive_words(spark, d):
    """Words by first appearance with their pieces as one ragged table."""
    return archive(spark, d)[1].select("word_id", "word", "pieces", "begin")


@query("archive_sentences", f"""WITH {WORD_TABLE}, s AS (SELECT conv_id, turn, list(word_id ORDER BY i)::BIGINT[] AS word_ids FROM w JOIN f USING (word) GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(word_ids, []) AS word_ids, coalesce(sum(coalesce(len(word_ids), 0)) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM conversations LEFT JOIN s USING (conv_id, turn)""")
def archive_sentences(spark, d):
    """Sentences as word ids, one ragged table."""
    t, words = archive(spark, d)
    return R.sentences_table(t, ["conv_id", "turn"], "words", words).select("conv_id", "turn", "word_ids", "begin")


@query("archive_lengths", "SELECT conv_id, turn, length(regexp_replace(text, '\\s', '', 'g'))::BIGINT AS length FROM conversations")
def archive_lengths(spark, d):
    """Sentence lengths in pieces."""
    t, words = archive(spark, d)
    return R.lengths_table(t, ["conv_id", "turn"], "words", words)
