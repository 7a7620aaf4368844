"""Row indexes, shards, splits and joins of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxquarry.scratch import materialise

def running(df: DataFrame, order: list[str], weight: Column | None = None, name: str = "before") -> DataFrame:
    """Adds `name`: the sum of `weight` (1 by default) over all rows that come earlier in `order`; equal rows go in any order.

    Rows are range-partitioned by `order` and written with the number of their range, so that ranges and their sums are
    read from the same rows; each range is then summed by itself and moved by the ranges before it. No task holds more.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    t = df.withColumn("_w", w).repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    t = materialise(t, "ranges")
    sums = t.groupBy("_p").agg(F.sum("_w").alias("_s"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offset = sums.select("_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"))
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_r", F.coalesce(F.sum("_w").over(own), F.lit(0)))
    return t.join(F.broadcast(offset), "_p").withColumn(name, F.col("_o") + F.col("_r")).drop("_p", "_o", "_r", "_w")


def global_index(df: DataFrame, file: str, order: list[str]) -> DataFrame:
    """Adds idx: rows numbered over files in order of name."""
    return running(df, [file, *order], name="idx")


def shard_name(idx: Column, size: int = 100_000, width: int = 7) -> Column:
    return F.lpad(F.floor(idx / size).cast("string"), width, "0")


def split_parts(df: DataFrame, parts: int, idx: str = "idx") -> DataFrame:
    """Adds part: consecutive pieces of ceil(rows / parts) rows."""
    n = df.agg(F.ceil(F.count(F.lit(1)) / parts).alias("_c"))
    return df.crossJoin(F.broadcast(n)).withColumn("part", F.floor(F.col(idx) / F.greatest("_c", F.lit(1)))).drop("_c")  # one row


def rank_split(df: DataFrame, order: list[str], test: int = 10, dev: int = 10) -> DataFrame:
    """Adds split: the first rows in order are test, the next dev, the rest train. Only the first are ranked by a sort of all."""
    first = df.select(*order).distinct().orderBy(*order).limit(test + dev)
    first = first.withColumn("split", F.when(F.row_number().over(Window.orderBy(*order)) <= test, "test").otherwise("dev"))
    return df.join(F.broadcast(first), order, "left").withColumn("split", F.coalesce("split", F.lit("train")))  # test + dev rows


def zip_rows(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """Row i of each group of one side with row i of the other's; the shorter side ends it."""
    x = a.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_a)))
    y = b.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_b)))
    return x.join(y, [*keys, "row"])


def strict_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A lookup in which a missing key fails the query."""
    found = right.withColumn("_found", F.lit(True))
    out = left.join(found, on, "left")
    return out.where(F.assert_true(F.coalesce("_found", F.lit(False)), F.lit("a key has no match")).isNull()).drop("_found")


def anti_join(todo: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return todo.join(done.select(*on), on, "left_anti")


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points in half-open intervals of their key. Both go into buckets of `width`, so that the join is by equality."""
    b = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.greatest(F.floor(F.col(start) / width), F.ceil(F.col(end) / width) - 1))))
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    return p.join(b, [key, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def merged_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Union of the intervals of each key: overlapping or touching ones become one."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = df.select(key, start, end).withColumn("_n", F.coalesce((F.col(start) > before).cast("int"), F.lit(1)))
    t = t.withColumn("_i", F.sum("_n").over(w))
    return t.groupBy(key, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def coverage(oracle: DataFrame, found: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, total, covered, extra): time of `oracle` covered by `found`, and of `found` outside it, in whole ticks.

    The boundaries of both merged sets are swept in order, with a running count of open intervals on either side: rows grow
    with the intervals, not with their length.
    """
    def edges(df: DataFrame, side: str) -> DataFrame:
        m = merged_intervals(df.where(F.col(end) > F.col(start)), key, start, end)
        one = lambda c, v: m.select(key, F.col(c).alias("at"), F.lit(v if side == "o" else 0).alias("o"), F.lit(v if side == "f" else 0).alias("f"))
        return one(start, 1).unionByName(one(end, -1))

    e = edges(oracle, "o").unionByName(edges(found, "f")).groupBy(key, "at").agg(F.sum("o").alias("o"), F.sum("f").alias("f"))
    w = Window.partitionBy(key).orderBy("at")
    t = e.withColumn("length", F.lead("at").over(w) - F.col("at")).withColumn("in_o", F.sum("o").over(w) > 0).withColumn("in_f", F.sum("f").over(w) > 0)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0)).cast("long")
    return t.groupBy(key).agg(total(F.col("in_o")).alias("total"), total(F.col("in_o") & F.col("in_f")).alias("covered"), total(~F.col("in_o") & F.col("in_f")).alias("extra"))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Adds to each left row the right side's `value` of the last row at or before it; one union and window, no range join."""
    x = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_s", F.lit(1))
    cols = [c for c in left.columns]
    y = right.select(*keys, at, F.col(value).alias("_v")).withColumn("_s", F.lit(0))
    both = x.unionByName(y, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_s").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_s = 1").select(*cols, value)


def uneven_batch(df: DataFrame, batch: str, length: str, order: str, max_frames: int) -> DataFrame:
    """The first max_frames // longest rows of a batch; all of it if that is none or not fewer."""
    w = Window.partitionBy(batch)
    keep = F.floor(F.lit(max_frames) / F.max(length).over(w))
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order))
    return df.withColumn("_k", keep).withColumn("_n", n).withColumn("_r", r).where("_k = 0 OR _k >= _n OR _r <= _k").drop("_k", "_n", "_r")


def log_sum_exp(x: Column, w: Window) -> Column:
    m = F.max(x).over(w)
    return m + F.log(F.sum(F.exp(x - m)).over(w))
