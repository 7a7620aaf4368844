"""Whitening of integer embeddings by cyclic Jacobi rotations.

Sums and the centred scatter are gathered in two passes over the distinct vectors, a matrix a task, merged by matrix row;
the driver holds one matrix of the vectors' dimension and rotates it until nothing is left beside the diagonal, which
keeps small eigenvalues accurate. Sorted and scaled, the eigenvectors are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxquarry.llm.common import materialise, table

#: Rows whose products are formed at once.
ROWS = 4096
PARTIAL = "i int, n long, row array<double>"


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, of a symmetric matrix.

    Each sweep rotates every pair of coordinates once; it ends when each entry beside the diagonal is below the rounding
    of its two diagonal entries. Each vector's largest entry is positive. Equal values stand in any order.
    """
    a = np.array(matrix, np.float64)
    d = len(a)
    v = np.eye(d)
    tiny = np.finfo(np.float64).tiny
    for _ in range(sweeps):
        rotated = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                apq = a[p, q]
                if abs(apq) <= 1e-17 * np.sqrt(abs(a[p, p]) * abs(a[q, q])) + tiny:
                    continue
                rotated = True
                theta = (a[q, q] - a[p, p]) / (2 * apq)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                app, aqq = a[p, p] - t * apq, a[q, q] + t * apq
                rows = np.array([[c, -s], [s, c]]) @ a[[p, q]]
                a[[p, q]] = rows
                a[:, [p, q]] = rows.T
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                v[[p, q]] = np.array([[c, -s], [s, c]]) @ v[[p, q]]
        if not rotated:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[order]
    v /= np.sqrt((v**2).sum(1, keepdims=True))
    v *= np.where(v[np.arange(d), np.abs(v).argmax(1)] < 0, -1.0, 1.0)[:, None] if d else 1.0
    return np.diag(a)[order], v


def rounded(vector: Column, scale: float = 256.0) -> Column:
    """The long vector floor(scale * entry); null for a null vector or one with a null or non-finite entry."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(F.forall(vector, ok), F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), d)


def _merged(parts: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Sums of the tasks' rows, by row number, on the driver: a matrix of the vectors' dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            rows = batch.column(2)
            for k, (i, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                row = rows[k].values.to_numpy()
                m, s = held.get(i, (0, 0.0))
                held[i] = (m + n, s + row)
        for i, (n, row) in held.items():
            yield _row(i, n, row)

    merged = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32))).repartition("i", "part").drop("part").mapInArrow(add, PARTIAL).repartition("i").mapInArrow(add, PARTIAL)
    return {x["i"]: (x["n"], np.array(x["row"])) for x in merged.collect()}


def _row(i: int, n: int, row: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([row.tolist()], pa.list_(pa.float64()))], ["i", "n", "row"])


def _sums(d: int):
    """Row 0 holds the sums' high parts, row 1 their low 24 bits, so that sums of longs stay whole numbers in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 24).sum(0), low + (x & 0xFFFFFF).sum(0)
        yield _row(0, n, high.astype(float))
        yield _row(1, 0, low.astype(float))

    return run


def _scatter(d: int, mean: np.ndarray, turn: np.ndarray | None = None):
    """Sums of products of the centred vectors, or of their images under `turn`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                y = _matrix(batch.column(0).slice(k, ROWS), d) - mean
                y = y if turn is None else y @ turn.T
                n, total = n + len(y), total + y.T @ y
        for i in range(len(total) if n else 0):
            yield _row(i, n if i == 0 else 0, total[i])

    return run


class Whitening:
    """n vectors with sums S (whole numbers), eigenvalues and unit eigenvectors of their covariance, the trace, and the largest
    entry of the whitened covariance minus the identity over the components that are kept."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, kept: int):
        self.n, self.sums, self.values, self.vectors = n, sums, np.maximum(values, 0), vectors
        self.dim, self.trace = len(sums), float(values.sum())
        self.mean = np.array([s / n for s in sums])
        self.kept = min(kept, self.dim)
        self.identity_error = 0.0

    @property
    def matrix(self) -> np.ndarray:
        """Projections on the kept components over their standard deviations; zeros for a component without any spread."""
        e = self.values[: self.kept, None]
        return np.divide(self.vectors[: self.kept], np.sqrt(e), out=np.zeros((self.kept, self.dim)), where=e > 0)


def fit(vectors: DataFrame, x: str = "x", components: int = 4) -> Whitening | None:
    """Learns from each distinct long vector of column x once; None without any.

    Vectors shorter than the longest and empty ones are left out. The driver gets matrices of the dimension's size only.
    """
    given = vectors.where(F.size(x) > 0).select(x)
    d = given.agg(F.max(F.size(x))).first()[0]
    if not d:
        return None
    distinct = materialise(given.where(F.size(x) == d).distinct(), "whitening-fit")
    rows = _merged(distinct.mapInArrow(_sums(d), PARTIAL))
    n = rows[0][0]
    sums = [(int(h) << 24) + int(low) for h, low in zip(rows[0][1], rows[1][1], strict=True)]
    mean = np.array([s / n for s in sums])
    scatter = _merged(distinct.mapInArrow(_scatter(d, mean), PARTIAL))
    cov = np.array([scatter[i][1] for i in range(d)]) / n
    out = Whitening(n, sums, *jacobi((cov + cov.T) / 2), components)
    white = _merged(distinct.mapInArrow(_scatter(d, mean, out.matrix), PARTIAL))
    out.identity_error = float(max(np.abs(white[i][1] / n - np.eye(out.kept)[i]).max() for i in range(out.kept)))
    return out


def _deviation(w: Whitening, x: np.ndarray) -> list[int | None]:
    """Sums of (n * x - S)^2, exactly; null where they pass the range of a long."""
    most = 1 << 63
    wide = w.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, w.sums))
    if w.dim * wide * wide < most:
        return (((w.n * x - np.array(w.sums, np.int64)) ** 2).sum(1)).tolist()
    exact = [sum((w.n * c - s) ** 2 for c, s in zip(row, w.sums, strict=True)) for row in x.tolist()]
    return [v if v < most else None for v in exact]


def whiten(vectors: DataFrame, model: Whitening | None, x: str = "x") -> DataFrame:
    """A row for each row of `vectors` of the model's length and each kept component: the other columns, component (from 1), n,
    deviation, whitened, explained and identity_error. Components without spread have whitened 0. No model: no rows.
    """
    own = [c for c in vectors.columns if c != x and c.lower() not in ("component", "n", "deviation", "whitened", "explained", "identity_error")]
    fields = [vectors.schema[c] for c in own]
    fields += [T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    held = vectors.sparkSession.sparkContext.broadcast((model, model.matrix) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held.value is None:
            return
        w, turn = held.value
        share = w.values[: w.kept] / w.trace if w.trace > 0 else np.zeros(w.kept)
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                some = batch.slice(k, ROWS)
                m = _matrix(some.column(x), w.dim)
                each = np.repeat(np.arange(len(m)), w.kept)
                columns = [some.column(c).take(pa.array(each)) for c in own]
                columns += [pa.array(np.tile(np.arange(1, w.kept + 1, dtype=np.int32), len(m))), pa.array(np.full(len(each), w.n))]
                columns += [pa.array(_deviation(w, m), pa.int64()).take(pa.array(each)), pa.array(((m - w.mean) @ turn.T).ravel())]
                columns += [pa.array(np.tile(share, len(m))), pa.array(np.full(len(each), w.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    rows = vectors.select(*own, x).where(F.size(x) == model.dim if model else F.lit(False))
    return rows.mapInArrow(run, T.StructType(fields))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every embedding; null and non-finite vectors take no part."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", rounded(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    return whiten(x, fit(x))
