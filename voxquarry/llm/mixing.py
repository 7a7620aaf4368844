"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxquarry.llm.common import SPACE, materialise, renamed, small, table
from voxquarry.operators.relational import running

WEIGHTS = (5, 2, 1)


def word_count(text):
    """Number of words (runs of non-space characters); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Sources in code-point order, null last, weigh `weights`, repeating. They share `share` times all sizes; a target
    stops at `max_epochs` times its source's size and the excess is reshared by weight until none is above: each round
    clamps what the level overflows and sums up the others, so the driver holds three numbers and no task all sources.
    """
    t = running(sources.select("source", "source_size", F.col("source").isNull().alias("_null")), ["_null", "source"], name="_n")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    t = materialise(t.select("source", "source_size", w.alias("weight"), (max_epochs * F.col("source_size")).alias("cap")), "mix-weights")
    total, rest, per = (x or 0 for x in t.agg(F.sum("source_size"), (share * F.sum("source_size")), F.sum("weight")).first())
    whole, clamped = rest, -1
    while True:
        over = F.col("weight") * F.lit(float(rest)) > F.col("cap") * F.lit(float(per))
        held, n, left = t.agg(F.sum(F.when(over, F.col("cap"))), F.count_if(over), F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped or left is None:
            break
        clamped, rest, per = n, whole - (held or 0), left
    if left is None:
        target = F.col("cap").cast("double")
    else:
        target = F.when(over, F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(rest)) / F.lit(float(per))))
    return t.select("source", "source_size", "weight", target.alias("target"))


def _filled(slim: DataFrame, key, s: DataFrame) -> tuple:
    """(`s` with the rounds and the last document of each source, whether a document is taken in a round).

    A round takes documents in order up to the first that does not fit; those longer than what remains are set aside, and
    the next round goes on behind. Rows that repeat a document are one, as they draw together.
    """
    at = F.struct("_h", "doc_id", "size")
    slim = slim.where("size > 0").withColumn("_k", key).groupBy("_k", "_b", "_h", "doc_id", "size").agg(F.sum("size").alias("w"))
    slim = materialise(slim, "mix-units")
    none = F.lit(None).cast(slim.select(at.alias("a")).schema["a"].dataType)
    state = s.select("_k", none.alias("from"), F.col("_rest").alias("rest"))
    done = []
    while True:
        state = materialise(state, "mix-state")
        here = slim.join(small(state), "_k").where((F.col("from").isNull() | (at > F.col("from"))) & (F.col("w") <= F.col("rest")))
        run = Window.partitionBy("_k").orderBy("_b")
        sums = here.groupBy("_k", "_b", "rest").agg(F.sum("w").alias("s")).withColumn("before", F.sum("s").over(run) - F.col("s"))
        sums = materialise(sums, "mix-ranges")
        ends = materialise(sums.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("s") > F.col("rest"))).select("_k", "_b", "before"), "mix-ends")
        within = Window.partitionBy("_k", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        last = here.join(small(ends), ["_k", "_b"]).withColumn("run", F.col("before") + F.sum("w").over(within)).where("run <= rest")
        last = last.groupBy("_k").agg(F.max(at).alias("last"), F.max("run").alias("got"))
        total = sums.groupBy("_k").agg(F.sum("s").alias("all"))
        edge = F.struct(F.col("_b").alias("_h"), F.lit(None).cast(slim.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("size"))
        cut = state.join(total, "_k").join(ends, "_k", "left").join(last, "_k", "left")
        # without an end all fit; with none that fits in the end's range, the round goes up to that range
        cut = cut.withColumn("to", F.when(F.col("_b").isNotNull(), F.coalesce("last", edge))).withColumn("got", F.coalesce("got", "before", "all"))
        cut = materialise(cut.select("_k", "from", "to", "rest", "got"), "mix-round")
        done.append(cut)
        state = cut.where("to IS NOT NULL AND rest - got >= 1").select("_k", F.col("to").alias("from"), (F.col("rest") - F.col("got")).alias("rest"))
        if state.isEmpty():
            break
    rounds = done[0]
    for x in done[1:]:
        rounds = rounds.unionByName(x)
    rounds = rounds.groupBy("_k").agg(F.collect_list(F.struct("from", "to", "rest")).alias("_rounds"), F.sum("got").alias("_got"))
    s = materialise(s.join(rounds, "_k", "left").withColumn("_got", F.coalesce("_got", F.lit(0))), "mix-cut")

    def taken():
        def inside(r):
            return (r["from"].isNull() | (at > r["from"])) & (r["to"].isNull() | (at <= r["to"])) & (F.col("w") <= r["rest"])

        return F.coalesce(F.exists("_rounds", inside), F.lit(False))

    left = F.col("_rest") - F.col("_got")
    gap = F.abs(F.col("w") - left)
    extra = slim.join(small(s), "_k").where(~taken() & (gap < left)).groupBy("_k").agg(F.min(F.struct(gap.alias("g"), "_h", "doc_id", "size")).alias("_x"))
    return small(materialise(s.join(extra, "_k", "left"), "mix-extra")), slim, taken


def _with_copies(sized: DataFrame, columns: list, cut: DataFrame, units: DataFrame, taken, key, max_epochs: int) -> DataFrame:
    """The rows of `sized` with the copies that _filled gives them."""
    same = (F.col("_h") == F.col("_x._h")) & F.col("doc_id").eqNullSafe(F.col("_x.doc_id")) & (F.col("size") == F.col("_x.size"))
    more = units.join(cut, "_k").where(taken() | F.coalesce(same, F.lit(False))).select("_k", "_h", F.col("doc_id").alias("_d"), F.col("size").alias("_s"), F.lit(True).alias("_more"))
    out = sized.withColumn("_k", key).join(cut.select("_k", "source_size", "target", "_whole"), "_k", "left")
    out = out.join(more, (out["_k"] == more["_k"]) & (out["_h"] == more["_h"]) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_s")), "left")
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.when(F.col("_more") & (F.col("_whole") < max_epochs), 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*columns, "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, seed: str = "mix", buckets: int = 4, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Adds size, source_size, target, copies and taken to each row of `docs` (doc_id, text, source, ...).

    Every document of a source is taken floor(target / size) times; for the rest, documents follow in order of a seeded
    hash of doc_id, each that still fits; then one more comes in if that brings the source nearer its target (the nearest
    in size; ties by hash, doc_id). Running sums go over `16 ** buckets` hash ranges per source first, and over single
    documents in the range that a sum ends in, so that no task holds a source. No document exceeds max_epochs times its
    size: whole copies are at most max_epochs, and exactly that many only when nothing is left over.

    Null text has size 0, null source is a source of its own, null doc_id is drawn by its text's size. Repeated rows
    draw together, in arbitrary order among themselves. Columns with the names of added ones are replaced.
    """
    docs, names = renamed(docs.drop("size", "source_size", "target", "copies", "taken"), "doc_id", "text", "source")
    row = [F.col(n).alias(c) for c, n in names.items()]
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn("_h", h).withColumn("_b", F.substring("_h", 1, buckets))
    slim = materialise(sized.select("source", "_b", "_h", "doc_id", "size"), "mix-sizes")
    sums = slim.groupBy("source", "_b").agg(F.sum("size").alias("s"))
    sources = water_fill(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    sources = sources.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    sources = sources.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    s = small(materialise(sources.select(key.alias("_k"), "source_size", "target", "_whole", "_rest"), "mix-sources"))

    return _with_copies(sized, row, *_filled(slim, key, s), key, max_epochs)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || doc_id::VARCHAR) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT source, source_size, 2 * source_size AS cap,
              [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s0),
s2 AS (SELECT *, row_number() OVER o AS n,
              coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c,
              sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w,
              1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS t
       FROM s1 WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
f AS (SELECT n AS fn, t - c AS rest, w AS fw FROM s2 WHERE weight * (t - c) <= cap * w ORDER BY n LIMIT 1),
s3 AS (SELECT source, source_size, CASE WHEN fn IS NULL OR n < fn THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * rest / fw) END AS target
       FROM s2 LEFT JOIN f ON true),
s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
             target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END) * source_size AS rest FROM s3),
r AS MATERIALIZED (SELECT d.doc_id, d.source, coalesce(d.source, '') AS src, d.source IS NULL AS none, d.size, d.h, s.source_size, s.target, s.whole, s.rest,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size = 0, d.h, d.doc_id, d.size) AS i
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
-- document by document: each that still fits
t AS (SELECT src, none, i, CASE WHEN size <= rest THEN size ELSE 0 END::BIGINT AS got, size <= rest AS fits FROM r WHERE i = 1
  UNION ALL
  SELECT r.src, r.none, r.i, t.got + CASE WHEN t.got + r.size <= r.rest THEN r.size ELSE 0 END, t.got + r.size <= r.rest FROM t JOIN r ON r.src = t.src AND r.none = t.none AND r.i = t.i + 1),
g AS (SELECT src, none, max(got) AS got FROM t GROUP BY ALL),
x AS (SELECT r.*, t.fits AS byhash,
             CASE WHEN NOT t.fits AND r.size > 0 AND abs(r.size - (r.rest - g.got)) < r.rest - g.got THEN abs(r.size - (r.rest - g.got)) END AS gap
      FROM r JOIN t USING (src, none, i) JOIN g USING (src, none)),
y AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gap NULLS LAST, h, doc_id) AS k FROM x)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN whole < 2 AND (byhash OR (gap IS NOT NULL AND k = 1)) THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM y
"""
