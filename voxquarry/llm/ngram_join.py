"""Exact self-join of documents on Jaccard similarity of their word n-gram sets, by vertical partitioning.

All n-grams have one global order, rare ones first. The order is cut into fragments of about equal mass, and so is
every set: a row for each set and fragment. The order's front of each set (its prefix) proposes pairs; every fragment
counts a pair's partial overlap by itself, and the counts are summed per pair. Documents with equal sets are one class;
only classes are joined. In large groups of near copies, pairs with a few leaders come first; classes that those already
connect are not paired again, all others are, so that no link between different components is lost and no group gets
all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxquarry.llm import arrays, membership, sketch
from voxquarry.llm.common import discard, materialise, release, table
from voxquarry.llm.components import connected_components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
FRAGMENTS = 8
#: Pairs of one set and fragment that meet in a task; a set with more is repeated for each so many.
HUB_PAIRS = 4096


def _classes(k: int):
    """Per row its id, set size and 128-bit set digest; per task the table of n-gram counts, sets that the task has met once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, once = np.zeros(1 << sketch.BITS, np.int64), arrays.Once()
        names = ["doc_id", "n", "d", "d2", "part", "blob"]
        for batch in batches:
            ids = batch.column(0)
            for i, n, buf, offsets in arrays.chunks(batch.column(1)):
                r, h, sizes = arrays.shingle_sets(buf, offsets, k)
                d, d2 = arrays.set_digests(r, h, sizes)
                np.add.at(counts, sketch.cell(h[once.new(d)[r]]), 1)
                yield pa.RecordBatch.from_arrays([ids.slice(i, n), arrays.i64(sizes), pa.array(d), pa.array(d2), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)
        for part, blob in sketch.rows(counts):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([part], pa.int64()), pa.array([blob], pa.binary())], names)

    return run


def _order(level: np.ndarray, cuts: int = FRAGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(level, fragment) of each cell of the n-gram hashes: the global order (level, hash), cut where it has equal shares of all n-grams."""
    by = np.argsort(level, kind="stable")
    mass = np.cumsum(np.exp2(level[by] / 4) - 1)
    fragment = np.zeros(len(level), np.uint8)
    if mass[-1] > 0:
        fragment[by] = np.minimum(mass * (cuts / mass[-1]), cuts - 1).astype(np.uint8)
    return level, fragment


def _prefixes(k: int, percent: int, order):
    """(n-gram, class, size and position) of the first n-grams in the global order (level, hash), sets that the task has met once.

    Sets of n and more n-grams that are similar enough share one of the first n - ceil(percent * n / 100) + 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (level, _), once = order.value, arrays.Once()
        for batch in batches:
            for _, _, buf, offsets in arrays.chunks(batch.column(0)):
                r, h, sizes = arrays.shingle_sets(buf, offsets, k)
                d, _ = arrays.set_digests(r, h, sizes)
                keep = once.new(d)[r]
                r, h = r[keep], h[keep]
                by = np.lexsort((h, level[sketch.cell(h)], r))
                r, h = r[by], h[by]
                pos = np.arange(len(r)) - np.searchsorted(r, r, side="left")
                n = sizes[r]
                front = pos < n - (percent * n + 99) // 100 + 1
                yield pa.RecordBatch.from_arrays([arrays.i64(h[front]), pa.array(d[r[front]]), arrays.i64((n[front] << 32) | pos[front])], ["tok", "rec", "np"])

    return run


def _fragments(k: int, order, wanted):
    """(class, set size, fragment, its n-grams): a row for each fragment that a set has part in, of rows whose id the bitmap `wanted` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, fragment), packed, once = order.value, wanted.value, arrays.Once()
        for batch in batches:
            text = batch.column(0).filter(pa.array(membership.may_hold(packed, batch.column(1).to_numpy())))
            for _, _, buf, offsets in arrays.chunks(text):
                r, h, sizes = arrays.shingle_sets(buf, offsets, k)
                d, d2 = arrays.set_digests(r, h, sizes)
                keep = once.new(d)[r]
                r, h = r[keep], h[keep]
                f = fragment[sketch.cell(h)]
                by = np.lexsort((f, r))
                r, h, f = r[by], h[by], f[by]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (f[1:] != f[:-1])
                at = np.flatnonzero(new)
                toks = pa.ListArray.from_arrays(pa.array(np.append(at, len(r)).astype(np.int32)), arrays.i64(h))
                yield pa.RecordBatch.from_arrays([pa.array(d[r[at]]), pa.array(d2[r[at]]), arrays.i64(sizes[r[at]]), pa.array(f[at].astype(np.int32)), toks], ["rec", "rec2", "size", "frag", "toks"])

    return run


def _alpha(n1, n2, percent: int):
    """Least overlap of similar sets of these sizes."""
    return F.floor((percent * (n1 + n2) + 99 + percent) / (100 + percent))


def _may_link(x: str, y: str, percent: int):
    """Sizes near enough, and an overlap that can still be reached from the positions of the shared n-gram."""
    n1, n2 = F.shiftright(F.col(f"{x}.np"), 32), F.shiftright(F.col(f"{y}.np"), 32)
    p1, p2 = F.col(f"{x}.np").bitwiseAND(0xFFFFFFFF), F.col(f"{y}.np").bitwiseAND(0xFFFFFFFF)
    need = _alpha(n1, n2, percent)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (n1 - p1 >= need) & (n2 - p2 >= need)


def _pairs(met: DataFrame, hub: str, leaf: str) -> DataFrame:
    """(a, b, hub): each pair once, smaller digest first; the hub is the end that may have many partners."""
    ends = met.select(F.least(hub, leaf).alias("a"), F.greatest(hub, leaf).alias("b"), F.col(hub).alias("hub"))
    return ends.groupBy("a", "b").agg(F.min("hub").alias("hub"))


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, order) -> DataFrame:
    """(a, b): the pairs that are similar, as (d, d2) of both. Partial overlaps are counted for each pair and fragment and summed per pair.

    Pairs name classes by 64 bits; all classes of these are told apart by 128. The hub's fragments go to its pairs, in
    salted shares, and from there to the leaves, so that no task reads a hub's whole neighbourhood of sets.
    """
    spark = docs.sparkSession
    recs = pairs.select(F.col("a").alias("d")).unionByName(pairs.select(F.col("b").alias("d"))).distinct()
    ids = classes.join(recs, "d", "left_semi").groupBy("d", "d2").agg(F.min("doc_id").alias("doc_id")).select(F.xxhash64("doc_id").alias("id"))
    wanted = spark.sparkContext.broadcast(membership.bitmap(ids, "id"))  # of fixed size
    texts = docs.select("text", F.xxhash64("doc_id").alias("id"))
    sets = materialise(texts.mapInArrow(_fragments(k, order, wanted), "rec long, rec2 long, size long, frag int, toks array<long>"), "ngram-fragments")
    wanted.unpersist()
    release(spark)

    many = pairs.groupBy(F.col("hub").alias("rec")).agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("salts")).where("salts > 1")
    many = materialise(many, "ngram-hubs")
    each = pairs.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("leaf"))
    each = each.join(many.withColumnRenamed("rec", "hub"), "hub", "left").withColumn("salt", F.pmod(F.xxhash64("leaf"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    each = each.withColumn("frag", F.explode(F.array(*[F.lit(f) for f in range(FRAGMENTS)])))
    own = sets.join(many, "rec", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    # rows that repeat a doc_id and its text give a set more than once
    own = own.repartition("rec", "frag", "salt").dropDuplicates(["rec", "frag", "salt", "rec2"])
    hubs = own.select(*[F.col(c).alias(c + "x") for c in ("rec", "rec2", "size", "frag", "salt", "toks")])
    leaves = own.select(*[F.col(c).alias(c + "y") for c in ("rec", "rec2", "size", "frag", "salt", "toks")])
    left = each.join(hubs, (F.col("hub") == F.col("recx")) & (F.col("frag") == F.col("fragx")) & (F.col("salt") == F.col("saltx")))
    left = left.select("recx", "rec2x", "sizex", "frag", "toksx", "leaf", F.lit(0).alias("zero"))
    both = left.join(leaves, (F.col("leaf") == F.col("recy")) & (F.col("frag") == F.col("fragy")) & (F.col("zero") == F.col("salty")))
    parts = both.select("recx", "rec2x", "recy", "rec2y", (F.col("sizex") + F.col("sizey")).alias("n"), F.size(F.array_intersect("toksx", "toksy")).cast("long").alias("o"))
    whole = parts.groupBy("recx", "rec2x", "recy", "rec2y", "n").agg(F.sum("o").alias("o")).where(100 * F.col("o") >= percent * (F.col("n") - F.col("o")))
    end = lambda side: F.struct(F.col("rec" + side).alias("d"), F.col("rec2" + side).alias("d2"))
    links = materialise(whole.select(end("x").alias("a"), end("y").alias("b")), "ngram-links")
    discard(sets, many)
    return links


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each row of docs (doc_id, text): see the module.

    A set is a text's distinct k-word shingles, A-Z lower-cased; a text of fewer words is one shingle; without words
    (null, empty, blank) the set is empty, links with nothing and component_id is the row's own doc_id. Repeated rows
    and equal texts share a class. A null doc_id links as others do and names no component unless all of it is null.
    n-grams are told apart by 64-bit hashes, classes by 128.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = materialise(docs.mapInArrow(_classes(k), "doc_id long, n long, d long, d2 long, part long, blob binary"), "ngram-classes")
    classes = first.where(F.col("part").isNull()).select("doc_id", "n", "d", "d2")
    order = spark.sparkContext.broadcast(_order(sketch.levels(first.where(F.col("part").isNotNull()).select("part", "blob"))))  # of fixed size

    entries = docs.select("text").mapInArrow(_prefixes(k, percent, order), "tok long, rec long, np long")
    shared = materialise(entries.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("tok"), "ngram-shared")
    release(spark)
    some = materialise(entries.join(shared, "tok", "left_semi"), "ngram-entries")
    discard(shared)
    distinct = some.distinct()
    mixed = distinct.groupBy("tok").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").select("tok")
    entries = materialise(distinct.join(mixed, "tok", "left_semi"), "ngram-entries")
    discard(some)

    # stars: each shared n-gram's classes with a leader, the one with fewest rarer n-grams and so the most central;
    # ties go by one of four random orders
    draw = F.xxhash64("rec", F.pmod("tok", F.lit(4)))
    lead = entries.groupBy("tok").agg(F.min(F.struct(F.col("np").bitwiseAND(0xFFFFFFFF).alias("p"), draw.alias("o"), "rec", "np")).alias("l")).select("tok", "l.rec", "l.np")
    star = entries.alias("x").join(lead.alias("y"), "tok").where((F.col("x.rec") != F.col("y.rec")) & _may_link("x", "y", percent))
    star = materialise(_pairs(star, "y.rec", "x.rec"), "ngram-star")
    release(spark)
    near = _links(star, docs, classes, k, percent, order)

    # all other pairs of different components
    comp = connected_components(near)
    held = entries.join(comp.select(F.col("node.d").alias("rec"), F.col("component.d").alias("comp")), "rec", "left")
    held = held.select("tok", "rec", "np", F.coalesce("comp", "rec").alias("comp"))
    # the shared n-gram before this one: a pair that has it in common too is proposed there or earlier
    held = held.withColumn("prev", F.lag("tok").over(Window.partitionBy("rec").orderBy("np")))
    held = materialise(held, "ngram-held")
    discard(entries, comp)
    open_ = held.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok")
    held, whole = materialise(held.join(open_, "tok", "left_semi"), "ngram-open"), held
    discard(whole)
    n = F.shiftright("np", 32)
    reach = n - F.col("np").bitwiseAND(0xFFFFFFFF)  # the overlap that an n-gram's position still allows
    groups = held.groupBy("tok", "comp").agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.max(reach).alias("reach"), F.count(F.lit(1)).alias("m"))
    groups = materialise(groups, "ngram-groups")
    names = ("comp", "lo", "hi", "reach", "m")
    gx, gy = (groups.select("tok", *[F.col(c).alias(c + side) for c in names]) for side in "xy")
    need = _alpha(F.col("lox"), F.col("loy"), percent)
    may = (100 * F.col("hix") >= percent * F.col("loy")) & (100 * F.col("hiy") >= percent * F.col("lox")) & (F.col("reachx") >= need) & (F.col("reachy") >= need)
    across = gx.join(gy, (gx["tok"] == gy["tok"]) & (F.col("compx") < F.col("compy")) & may)
    small = F.col("mx") <= F.col("my")  # members of the smaller component first, and only pairs that may link of the two
    across = across.select(gx["tok"].alias("tok"), F.when(small, F.col("compx")).otherwise(F.col("compy")).alias("c1"), F.when(small, F.col("compy")).otherwise(F.col("compx")).alias("c2"))
    x = held.select("tok", F.col("comp").alias("c1"), F.struct("rec", "np", "prev").alias("x"))
    y = held.select(F.col("tok").alias("t"), "comp", F.struct("rec", "np", "prev").alias("y"))
    once = F.col("x.prev").isNull() | F.col("y.prev").isNull() | (F.col("x.prev") != F.col("y.prev"))
    rest = across.join(x, ["tok", "c1"]).join(y, (F.col("tok") == F.col("t")) & (F.col("c2") == F.col("comp")) & once & _may_link("x", "y", percent))
    rest = materialise(_pairs(rest, "x.rec", "y.rec").join(star, ["a", "b"], "left_anti"), "ngram-rest")
    discard(held, groups, star)
    links = near.unionByName(_links(rest, docs, classes, k, percent, order))
    comp = connected_components(links)
    order.unpersist()

    by_class = classes.where("n > 0").groupBy("d", "d2").agg(F.min("doc_id").alias("low"))
    by_class = by_class.join(comp, F.struct("d", "d2") == F.col("node"), "left").select("d", "d2", "low", F.coalesce("component", F.struct("d", "d2")).alias("c"))
    lows = by_class.groupBy("c").agg(F.min("low").alias("component_id"))
    named = materialise(by_class.join(lows, "c").select("d", "d2", "component_id"), "ngram-named")
    out = classes.join(named, ["d", "d2"], "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in ("d", "d2")])).alias("class_id"),
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
