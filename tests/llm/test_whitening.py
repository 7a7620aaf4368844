"""Whitening against numpy and plain loops."""

import math

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from voxquarry.llm import whitening


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    scales = 10.0 ** -np.arange(0, 12, 1.0)
    a = np.diag(scales) @ (np.eye(12) + 0.05 * (lambda m: m + m.T)(rng.normal(size=(12, 12)))) @ np.diag(scales)
    from fractions import Fraction

    e, v = whitening.jacobi(a)
    assert np.abs(v @ v.T - np.eye(12)).max() < 1e-14
    assert (np.diff(e) <= 0).all() and (e > 0).all()
    det = Fraction(1)  # the product of eigenvalues is the determinant, exactly by elimination in fractions
    m = [[Fraction(x) for x in row] for row in a.tolist()]
    for i in range(12):
        det *= m[i][i]
        for j in range(i + 1, 12):
            f = m[j][i] / m[i][i]
            m[j] = [x - f * y for x, y in zip(m[j], m[i], strict=True)]
    assert math.isclose(math.fsum(map(math.log, e)), math.log(det), rel_tol=1e-13)


@pytest.mark.parametrize("matrix", [np.zeros((3, 3)), np.eye(4), np.ones((5, 5)), np.array([[2.0]])])
def test_jacobi_on_special_matrices(matrix):
    e, v = whitening.jacobi(matrix)
    assert np.allclose(v.T @ np.diag(e) @ v, matrix) and np.allclose(v @ v.T, np.eye(len(matrix)))


def check(rows, vectors, components=4):
    """Every returned row against numpy's eigenvectors of the distinct rounded vectors."""
    x = {i: np.floor(np.array(v, np.float32).astype(float) * 256).astype(int) for i, v in vectors}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), fit.sum(0)
    cov = (fit - s / n).T @ (fit - s / n) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u.T[::-1]
    sign = {}
    assert len(rows) == len(vectors) * min(components, len(s))
    for r in rows:
        v, k = x[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s, strict=True))
        want = (v - s / n) @ u[k] / math.sqrt(e[k])
        if abs(want) > 1e-3:
            sign.setdefault(k, math.copysign(1, want * r["whitened"]))
            assert math.isclose(r["whitened"] * sign[k], want, rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(r["explained"], e[k] / e.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9


def test_query_equals_numpy(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(whitening.op12_whitening(spark, DATA).collect(), [tuple(r) for r in rows])


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(20)]
    good += [(100, good[0][1]), (100, good[0][1]), (None, good[1][1])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 0.0, 0.0]), (53, [0.0, float("-inf"), 0.0]), (54, [1.0]), (55, [])]
    df = spark.createDataFrame([(i, v, 7, "y") for i, v in good + bad], "vec_id long, embedding array<float>, n int, extra string")
    x = df.withColumn("x", whitening.rounded(F.col("embedding"))).where("x IS NOT NULL")
    out = whitening.whiten(x, whitening.fit(x))
    assert out.columns == ["vec_id", "embedding", "extra", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), good)
    none = x.where("false")
    assert whitening.whiten(none, whitening.fit(none)).collect() == []
    assert whitening.whiten(x, None).collect() == []


def test_vectors_without_spread(spark):
    df = spark.createDataFrame([(1, [3, 4]), (2, [3, 4])], "vec_id long, x array<long>")
    rows = whitening.whiten(df, whitening.fit(df)).collect()
    assert len(rows) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in rows} == {(1, 0, 0.0, 0.0)}


def test_huge_values(spark):
    big = 1 << 62
    df = spark.createDataFrame([(1, [big, 0]), (2, [-big, 1]), (3, [0, 5])], "vec_id long, x array<long>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, whitening.fit(df)).where("component = 1").collect()}
    assert got == {1: None, 2: None, 3: 81}
    assert whitening.fit(df).sums == [0, 6]
