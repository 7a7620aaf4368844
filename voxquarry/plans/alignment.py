"""Scoring on real alignments; the SQL aligns by a recursion over the reference words, with a running maximum a row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxquarry.functions import text as X
from voxquarry.operators import align as A
from voxquarry.plans.registry import query, table
from voxquarry.plans.scoring import ALLOWED, SPANS, TURN_PAIRS, allowed_spans, turn_pairs

KEYS = ["conv_id", "turn"]


def aligned_sql(match: int, substitution: int, gap: int) -> str:
    """CTEs `paths` (conv_id, turn, r, h, path of P, D and I) and `p` (conv_id, turn, pos, ref, hyp) of the best alignments of tp (conv_id, turn, r, h).

    Ties prefer a pair, then a deletion, then an insertion. Scores are whole numbers.
    """
    pair = f"lag(d.v) OVER w + CASE WHEN a.r[d.i + 1] = a.h[d.j] THEN {match} ELSE {substitution} END"
    return f"""al0 AS MATERIALIZED (SELECT conv_id, turn, r, h, row_number() OVER () AS k FROM tp),
dp AS (
  SELECT k, 0 AS i, j, ({gap} * j)::BIGINT AS v, repeat('I', j::INT) AS path FROM (SELECT k, unnest(range(0, len(h) + 1)) AS j FROM al0)
  UNION ALL
  SELECT k, i, j, o.v - {-gap} * j AS v, o.path || repeat('I', (j - o.j)::INT) FROM (
    SELECT k, i, j, max({{'v': b + {-gap} * j, 'j': j, 'path': path}}) OVER (PARTITION BY k ORDER BY j ROWS UNBOUNDED PRECEDING) AS o FROM (
      SELECT d.k, d.i + 1 AS i, d.j, CASE WHEN d.j > 0 AND {pair} >= d.v + {gap} THEN {pair} ELSE d.v + {gap} END AS b,
             CASE WHEN d.j > 0 AND {pair} >= d.v + {gap} THEN lag(d.path) OVER w || 'P' ELSE d.path || 'D' END AS path
      FROM dp d JOIN al0 a USING (k) WHERE d.i < len(a.r) WINDOW w AS (PARTITION BY d.k ORDER BY d.j)))),
paths AS MATERIALIZED (SELECT a.conv_id, a.turn, a.r, a.h, d.path FROM dp d JOIN al0 a ON a.k = d.k AND d.i = len(a.r) AND d.j = len(a.h)),
p AS MATERIALIZED (SELECT conv_id, turn, pos - 1 AS pos, CASE WHEN op <> 'I' THEN r[length(replace(path[1:pos], 'I', ''))] END AS ref, CASE WHEN op <> 'D' THEN h[length(replace(path[1:pos], 'D', ''))] END AS hyp
  FROM (SELECT *, path[pos] AS op FROM (SELECT *, unnest(range(1, length(path) + 1)) AS pos FROM paths)))"""


SCORE, EDIT = aligned_sql(8, -4, -3), aligned_sql(0, -1, -1)
BY_SCORE = f"WITH RECURSIVE {TURN_PAIRS}, {SCORE}, {SPANS}"
RATES = """r AS (SELECT *, CASE WHEN m + s + d = 0 THEN 0 ELSE (s + i + d) / (m + s + d)::DOUBLE END AS wer, CASE WHEN m + s + d = 0 THEN 0 ELSE m / (m + s + d)::DOUBLE END AS recall, CASE WHEN m + s + i = 0 THEN 0 ELSE m / (m + s + i)::DOUBLE END AS precision FROM g)
SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r"""


def score_pairs(spark, d, method="score"):
    """(conv_id, turn, pos, ref, hyp) of the best alignments, whatever the length of the turns."""
    runs = turn_pairs(spark, d).withColumn("pairs", A.aligned(F.col("ref"), F.col("hyp"), method))
    return A.explode_pairs(runs, KEYS)


@query("wer_by_conversation", f"""{BY_SCORE}, gone AS (SELECT conv_id, (count(*) FILTER (WHERE len(h) > {A.MAX_WORDS}))::BIGINT AS runaway FROM tp GROUP BY conv_id),
g AS (SELECT conv_id, sum(m)::BIGINT AS m, sum(s)::BIGINT AS s, sum(i)::BIGINT AS i, sum(d)::BIGINT AS d, any_value(runaway) AS runaway FROM gone LEFT JOIN sp USING (conv_id) GROUP BY conv_id), {RATES}""")
def wer_by_conversation(spark, d):
    """Global score alignment, spans and rates of each conversation; turns that ran away are counted, not scored."""
    runs = A.guarded(turn_pairs(spark, d), "ref", "hyp")
    sp = A.spans(A.explode_pairs(runs, KEYS), KEYS)
    gone = runs.groupBy("conv_id").agg(F.count_if(F.col("status") == "runaway").alias("runaway"))
    return gone.join(A.totals(A.apply_allow_lists(sp), ["conv_id"]), "conv_id", "left")


@query("minimum_edit_alignment", f"WITH RECURSIVE {TURN_PAIRS}, {EDIT} SELECT conv_id, turn, pos::INT AS pos, ref, hyp FROM p")
def minimum_edit_alignment(spark, d):
    return score_pairs(spark, d, "edit")


@query("legacy_alignment", f"WITH RECURSIVE {TURN_PAIRS}, {SCORE} SELECT conv_id, turn, length(ltrim(path, 'D'))::BIGINT AS pairs, (length(path) - length(ltrim(path, 'D')))::BIGINT AS dropped FROM paths")
def legacy_alignment(spark, d):
    """The older traceback, which stops at column 0: leading reference words are dropped."""
    t = turn_pairs(spark, d).select(*KEYS, A.aligned(F.col("ref"), F.col("hyp"), "legacy").alias("old"), A.aligned(F.col("ref"), F.col("hyp")).alias("new"))
    return t.select(*KEYS, F.size("old").cast("long").alias("pairs"), (F.size("new") - F.size("old")).cast("long").alias("dropped"))


@query("aligned_spans", f"{BY_SCORE} SELECT * FROM sp")
def aligned_spans(spark, d):
    return A.spans(score_pairs(spark, d), KEYS).select(*KEYS, "span", "ref_text", "hyp_text", *"msid")


@query("aligned_error_rates", f"{BY_SCORE}{ALLOWED}, g AS (SELECT conv_id, sum(m)::BIGINT AS m, sum(s)::BIGINT AS s, sum(i)::BIGINT AS i, sum(d)::BIGINT AS d FROM c GROUP BY conv_id), {RATES}")
def aligned_error_rates(spark, d):
    """Rates after allow-lists, on the best alignment."""
    return A.totals(allowed_spans(score_pairs(spark, d)), ["conv_id"])


@query("aligned_error_counters", f"{BY_SCORE}{ALLOWED} SELECT CASE WHEN ref_text = '' THEN 'insertion' WHEN hyp_text = '' THEN 'deletion' ELSE 'substitution' END AS kind, ref_text, hyp_text, count(*)::BIGINT AS n FROM c WHERE NOT allowed AND s + i + d > 0 GROUP BY ALL")
def aligned_error_counters(spark, d):
    return A.counters(allowed_spans(score_pairs(spark, d)))


@query("aligned_word_stats", f"""WITH RECURSIVE {TURN_PAIRS}, {EDIT}, w AS (SELECT ref AS word, ref, hyp, 'ref' AS side FROM p WHERE ref IS NOT NULL UNION ALL SELECT hyp, ref, hyp, 'hyp' FROM p WHERE hyp IS NOT NULL)
SELECT word, (count(*) FILTER (WHERE side = 'ref' AND ref = hyp))::BIGINT AS corr, (count(*) FILTER (WHERE side = 'ref' AND ref <> hyp))::BIGINT AS ref_sub, (count(*) FILTER (WHERE side = 'hyp' AND ref <> hyp))::BIGINT AS hyp_sub,
       (count(*) FILTER (WHERE ref IS NULL))::BIGINT AS ins, (count(*) FILTER (WHERE hyp IS NULL))::BIGINT AS del FROM w GROUP BY word""")
def aligned_word_stats(spark, d):
    """Per word: correct, substituted either way, inserted, deleted, on the minimum-edit alignment."""
    return A.word_stats(score_pairs(spark, d, "edit"))


@query("aligned_attribution", f"""{BY_SCORE}, q AS (SELECT *, ok AS mt, (sum((ref IS NOT NULL)::INT) OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1) // 5 AS u FROM s)
SELECT conv_id, turn, greatest(coalesce(u, 0), 0)::BIGINT AS utt, (count(*) FILTER (WHERE mt))::BIGINT AS m, (count(*) FILTER (WHERE NOT mt AND ref IS NOT NULL AND hyp IS NOT NULL))::BIGINT AS s,
       (count(*) FILTER (WHERE ref IS NULL))::BIGINT AS i, (count(*) FILTER (WHERE hyp IS NULL))::BIGINT AS d FROM q GROUP BY ALL""")
def aligned_attribution(spark, d):
    """Errors by utterance of five reference words; an insertion goes to that of the last reference word before it."""
    p = score_pairs(spark, d)
    n = F.row_number().over(Window.partitionBy(*KEYS).orderBy("pos")) - 1
    utt = p.where("ref IS NOT NULL").select(*KEYS, n.cast("long").alias("ref_pos"))
    return A.attribute(p, KEYS, utt.withColumn("utt", F.floor(F.col("ref_pos") / 5)))


@query("corpus_wer", f"WITH RECURSIVE {TURN_PAIRS}, {EDIT} SELECT count(*) FILTER (WHERE ref IS DISTINCT FROM hyp)::BIGINT AS edits, count(ref)::BIGINT AS words, count(*) FILTER (WHERE ref IS DISTINCT FROM hyp) / count(ref)::DOUBLE AS wer FROM p")
def corpus_wer(spark, d):
    """Word errors over reference words of the whole corpus, by minimum edit distance."""
    t = turn_pairs(spark, d).select(A.word_distance(F.col("ref"), F.col("hyp")).alias("e"), F.size("ref").alias("n"))
    return t.agg(F.sum("e").alias("edits"), F.sum("n").alias("words"), (F.sum("e") / F.sum("n")).alias("wer"))


@query("segment_projection", f"""WITH RECURSIVE {TURN_PAIRS}, {SCORE},
n AS (SELECT conv_id, turn, ref, hyp, sum((ref IS NOT NULL)::INT) OVER w - 1 AS rp, sum((hyp IS NOT NULL)::INT) OVER w - 1 AS hp FROM p WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos))
SELECT conv_id, turn, (hp // 7)::BIGINT AS seg, min(rp)::BIGINT AS ref_start, max(rp)::BIGINT AS ref_end FROM n WHERE ref IS NOT NULL AND hyp IS NOT NULL GROUP BY ALL""")
def segment_projection(spark, d):
    """Hypothesis segments of seven words carried over to the reference through the alignment."""
    runs = turn_pairs(spark, d)
    seg = runs.where(F.size("hyp") > 0).select(*KEYS, F.size("hyp").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.size("hyp") - 1) / 7))).alias("seg"))
    seg = seg.select(*KEYS, "seg", (F.col("seg") * 7).alias("first_hyp"), F.least(F.col("seg") * 7 + 6, F.col("n") - 1).alias("last_hyp"))
    return A.project_segments(score_pairs(spark, d), seg, KEYS)


@query("nbest_oracle", f"""WITH RECURSIVE one AS (SELECT conv_id, arg_min(regexp_extract_all(text, '\\S+'), turn) AS r FROM conversations WHERE role = 'user' GROUP BY conv_id),
tp AS (SELECT conv_id, turn, r, regexp_extract_all(text, '\\S+') AS h FROM conversations JOIN one USING (conv_id) WHERE role = 'assistant'), {EDIT},
e AS (SELECT conv_id, turn, count(*) FILTER (WHERE ref IS DISTINCT FROM hyp)::BIGINT AS edits FROM p GROUP BY ALL)
SELECT conv_id, arg_min(turn, (edits, turn)) AS path_id, min(edits) AS edits FROM e GROUP BY conv_id""")
def nbest_oracle(spark, d):
    """The assistant turn with the fewest word edits to the first user turn of each conversation."""
    c = table(spark, d, "conversations")
    ref = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by(X.words(F.col("text")), F.col("turn")).alias("ref"))
    paths = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("path_id"), X.words(F.col("text")).alias("hyp")).join(ref, "conv_id")
    return A.best_path(paths, ["conv_id"], "ref", "hyp")


@query("translation_bleu", f"""WITH {TURN_PAIRS},
g AS (SELECT conv_id, turn, n, side, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT conv_id, turn, side, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT conv_id, turn, 'r' AS side, r AS w FROM tp UNION ALL SELECT conv_id, turn, 'h', h FROM tp), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n)),
k AS (SELECT conv_id, turn, n, g, count(*) FILTER (WHERE side = 'h') AS h, count(*) FILTER (WHERE side = 'r') AS r FROM g GROUP BY ALL),
o AS (SELECT conv_id, n, sum(least(h, r)) AS ok, sum(h) AS a FROM k GROUP BY ALL HAVING sum(h) > 0),
l AS (SELECT conv_id, count(*) AS orders, min(ok) AS least, avg(CASE WHEN ok > 0 THEN ln(ok / a::DOUBLE) END) AS log_p FROM o GROUP BY conv_id),
z AS (SELECT conv_id, sum(len(r)) AS r, sum(len(h)) AS h FROM tp GROUP BY conv_id)
SELECT conv_id, round(CASE WHEN coalesce(orders, 0) < 4 OR least = 0 THEN 0 ELSE CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h::DOUBLE) END * exp(log_p) END, 10)::DOUBLE AS bleu FROM z LEFT JOIN l USING (conv_id)""")
def translation_bleu(spark, d):
    t = turn_pairs(spark, d).withColumn("_id", F.col("turn"))
    return A.bleu(t, ["conv_id"], "ref", "hyp", order=4).select("conv_id", F.round("bleu", 10).alias("bleu"))


def recordings(spark, d):
    """(doc_id, ref, hyp): the words of each document, and the same with every 13th word lost, every 17th changed and every 29th said twice."""
    changed = lambda w, k: F.when(k % 13 == 5, F.array()).when(k % 17 == 3, F.array(F.reverse(w))).when(k % 29 == 7, F.array(w, w)).otherwise(F.array(w))
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.words(F.lower("text")).alias("ref"))
    return t.select("doc_id", "ref", F.flatten(F.transform("ref", changed)).alias("hyp"))


@query("anchored_error_rates")
def anchored_error_rates(spark, d):
    """Rates of whole recordings that are cut at words both sides share once, so that one recording is many rows; SQL can't follow."""
    parts = A.anchored(recordings(spark, d), ["doc_id"], "ref", "hyp", numbers=True)
    return A.pair_totals(parts, ["doc_id"])


@query("character_mode_errors", """WITH x AS (SELECT u.conv_id, u.turn, regexp_replace(lower(u.text), '[^a-z]', '', 'g') AS r, regexp_replace(lower(a.text), '[^a-z]', '', 'g') AS h FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, sum(levenshtein(r, h))::BIGINT AS edits, sum(length(r))::BIGINT AS chars, CASE WHEN sum(length(r)) = 0 THEN 0 ELSE sum(levenshtein(r, h)) / sum(length(r))::DOUBLE END::DOUBLE AS rate FROM x GROUP BY conv_id""")
def character_mode_errors(spark, d):
    """The report's character mode: words run together and aligned letter by letter."""
    letters = lambda c: F.filter(F.split(F.regexp_replace(F.array_join(c, ""), "[^a-z]", ""), ""), lambda x: x != "")
    t = turn_pairs(spark, d).select("conv_id", letters("ref").alias("r"), letters("hyp").alias("h"))
    t = t.select("conv_id", A.word_distance(F.col("r"), F.col("h")).alias("e"), F.size("r").alias("n")).groupBy("conv_id").agg(F.sum("e").alias("edits"), F.sum("n").cast("long").alias("chars"))
    return t.withColumn("rate", F.when(F.col("chars") == 0, F.lit(0.0)).otherwise(F.col("edits") / F.col("chars")))
