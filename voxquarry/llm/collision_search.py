"""Nearest neighbours by collision counting over single-projection sorted arrays.

Each block of vectors keeps, for every random line, its vectors in order of their projection. A query opens a window
around its own projection on every line and widens all windows by virtual rehashing; a vector that falls into the
windows of enough lines is verified by its exact inner product. Windows widen until they are so wide that vectors as
near as the k-th verified one would have collided. Vectors in clusters end the search that way; where a set share of the
block has reached the threshold before, the windows tell nothing apart and the whole block is verified by one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxquarry.llm.common import table

#: Lines, share of them that must collide, widening factor, share of a block beyond which all of it is verified, and the first
#: half window in standard deviations of the projections.
LINES, COLLISIONS, WIDEN, VERIFY, START = 32, 0.8, 1.2, 0.1, 0.05
#: Half windows of so many distances hold 0.915 of a vector's projections, 1.64 standard deviations of the collisions of 32
#: lines above COLLISIONS: a vector at that distance has been found with probability 0.95.
REACHED = 1.72
#: Rows of a block of vectors and of a block of queries. A pair of blocks is a task, so each row moves once for each block
#: of the other kind; results do not depend on the number of tasks that run at once.
BLOCK_ROWS, QUERY_ROWS = 1 << 14, 1 << 14


class Block:
    """Sorted projections of one block. Equal vectors are held once, with their ids in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int = LINES, seed: int = 17, start: float = START):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        raw = vectors.view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
        _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
        self.x = vectors[first].astype(np.float64)
        by = np.argsort(inverse, kind="stable")
        self.ids, self.ends = ids[by], np.cumsum(np.bincount(inverse.ravel(), minlength=len(first)))
        n, d = self.x.shape
        # inner products become distances: one more coordinate brings all vectors to the largest norm
        unit = self.x / _size(self.x)  # so that squares stay finite
        norms = (unit**2).sum(1)
        self.norm = np.sqrt(norms.max())
        self.line = np.random.default_rng(seed).normal(size=(d + 1, lines))
        p = unit @ self.line[:d] + np.sqrt(np.maximum(norms.max() - norms, 0))[:, None] * self.line[d]
        self.order = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.take_along_axis(p, self.order.T, 0).T)
        # all lines one after the other in one sorted array, so that one search finds every window
        self.span = 4 * float(np.abs(p).max()) + 1
        self.shift = self.span * np.arange(lines)
        self.flat = (self.sorted + self.shift[:, None]).ravel()
        self.unit, self.step = unit, (float(np.median(p.std(0))) or self.norm) * start
        self.verified = 0  # vectors whose inner product was computed, over all searches

    def search(self, q: np.ndarray, own: int, k: int, collisions: float = COLLISIONS, widen: float = WIDEN, verify: float = VERIFY) -> list[tuple[int, float]]:
        """The k nearest found other than id `own`: (id, inner product), nearest first, ties to the smaller id."""
        n, lines = len(self.unit), len(self.sorted)
        way = q / _size(q)
        way = way * (self.norm / np.sqrt((way**2).sum()))  # a query's length doesn't change its order of neighbours
        at = way @ self.line[: len(q)]
        need, enough = max(1, int(np.ceil(collisions * lines))), min(n, int(np.ceil(verify * n)) + 2 * k)
        base, edge = np.arange(lines) * n, self.span / 4  # windows end where the projections do
        at = np.clip(at, -edge, edge)
        lo = np.searchsorted(self.flat, at + self.shift) - base
        hi, counts, half = lo.copy(), np.zeros(n, np.int64), self.step
        found, near = np.zeros(0, np.int64), np.zeros(0)
        while True:
            a = np.searchsorted(self.flat, np.maximum(at - half, -edge) + self.shift) - base
            b = np.searchsorted(self.flat, np.minimum(at + half, edge) + self.shift, side="right") - base
            # so many collisions at least are needed for k vectors to reach the threshold
            if (b - a).sum() >= need * min(n, k):
                fresh = [self.order[j, a[j] : lo[j]] for j in np.flatnonzero(a < lo)] + [self.order[j, hi[j] : b[j]] for j in np.flatnonzero(b > hi)]
                lo, hi = np.minimum(a, lo), np.maximum(b, hi)
                if fresh:
                    counts += np.bincount(np.concatenate(fresh), minlength=n)
                    new = np.flatnonzero(counts >= need)
                    if len(found) + len(new) >= enough:  # the windows are no help: the block is searched exactly
                        found, near = np.arange(n), self.unit @ way
                        break
                    counts[new] -= lines + 1  # verified ones never come again
                    # where many are new, one product over the block in memory order is quicker than picking rows
                    score = (self.unit @ way)[new] if 8 * len(new) > n else self.unit[new] @ way
                    found, near = np.append(found, new), np.append(near, score)
                if (hi - lo).min() == n:
                    break
                if len(found) > k:  # one of them may be the query's own
                    kth = np.partition(near, -k - 1)[-k - 1]
                    if REACHED * np.sqrt(max(0.0, 2 * self.norm**2 - 2 * kth)) <= half:
                        break
            half *= widen if len(found) else 2
        self.verified += len(found)
        if len(found) > 4 * k:  # exact scores only where rounding could matter
            found = found[near >= np.partition(near, -k - 1)[-k - 1] - 1e-9 * self.norm**2]
        with np.errstate(over="ignore", invalid="ignore"):
            score = (self.x[found] * q).sum(1)
        found, score = found[~np.isnan(score)], score[~np.isnan(score)]
        by = np.argsort(-score, kind="stable")
        out: list[tuple[int, float]] = []
        kth = None
        for i in by:
            if kth is not None and score[i] < kth:
                break
            u = found[i]
            mine = self.ids[(self.ends[u - 1] if u else 0) : self.ends[u]]
            out += [(int(v), float(score[i])) for v in mine[: k + 1] if v != own]
            if len(out) >= k:
                kth = score[i]
        out.sort(key=lambda x: (-x[1], x[0]))
        return out[:k]


def _size(x: np.ndarray) -> float:
    """The power of two next to the largest component."""
    return float(np.exp2(np.round(np.log2(np.abs(x).max()))))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector takes part: not null, not zero, without null or non-finite components, with an id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k nearest found in `vectors`, both (vec_id, embedding).

    Vectors go into blocks of about `block_rows` rows by a hash of their id, queries into blocks of about `query_rows`;
    each pair of blocks is one bounded task that indexes its vectors and answers its queries, and the answers are merged.
    Candidates have another vec_id and as many components; rows that share a vec_id are candidates each, and query rows
    that share one are answered each. Unusable vectors (see `usable`) take no part. No queries or no candidates: no rows.
    Scores beyond the range of doubles are infinite and tie; those that are no number are left out.
    """
    rows, asked = usable(vectors), usable(queries)
    blocks = max(1, -(-rows.count() // block_rows))
    parts = max(1, -(-asked.count() // query_rows))
    split = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "embedding"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dim = F.size("embedding").alias("dim")
    x = rows.select("vec_id", "embedding", dim, split(1, blocks).alias("block"), each(parts).alias("part"))
    # query rows that are equal are answered once
    asked = asked.groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies"))
    y = asked.select("vec_id", "embedding", "copies", F.xxhash64("embedding").alias("row"), dim, split(2, parts).alias("part"), each(blocks).alias("block"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        out: list[tuple[int, int, int, int, float]] = []
        if len(left) and len(right):
            block = Block(left["vec_id"].to_numpy(np.int64), np.stack(left["embedding"].to_numpy()))
            for own, q, row, copies in zip(right["vec_id"], right["embedding"], right["row"], right["copies"], strict=True):
                out += [(own, row, copies, v, s) for v, s in block.search(np.asarray(q, np.float64), own, k)]
        kinds = {"query_id": "int64", "row": "int64", "copies": "int64", "vec_id": "int64", "score": "float64"}
        return pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    keys = ["dim", "block", "part"]
    found = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(run, "query_id long, row long, copies long, vec_id long, score double")
    order = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return best.select("query_id", "rank", "vec_id", "score", copies.alias("copy")).drop("copy")


def op6_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
