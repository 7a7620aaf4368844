"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxquarry.llm.common import delete, discard, materialise


def _print(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges: two numbers, whatever its size."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component) for every node of `links`; component is the smallest node that links reach.

    Each step is a group-by with a map-side minimum and an equi-join, written to the shared folder; rounds grow with
    the logarithm of the longest path; the result is materialised. Ids are of any type that orders. Null ends and loops are left out; repeated links count once.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    edges = edges.where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v").distinct()
    edges = materialise(edges, "components")
    seen = _print(edges)
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where(F.col("u") != F.col("v")).distinct(), "components")
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        old, edges = edges, materialise(small.where(F.col("u") != F.col("v")).distinct(), "components")
        delete(old, large)
        now = _print(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = materialise(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(edges)
    return out
