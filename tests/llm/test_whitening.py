"""Whitening against exact moments and a dense eigensolver."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from trainlake.llm import queries, whitening

SMALL_DIR = "/root/testdata/sf0.001"


def exact(vectors):
    """Whole numbers, sums and the covariance by fractions of whole numbers."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    apart = np.array([[n * v - s for v, s in zip(r, sums, strict=True)] for r in x], object)
    products = apart.T @ apart
    return x, sums, apart, np.array([[products[i, j] / n**3 for j in range(dims)] for i in range(dims)], float)


def check(rows, vectors, ids, wanted=8):
    x, sums, apart, covariance = exact(vectors)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(wanted, int((values > 1e-12 * values[0]).sum()))
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == set(ids) and len(rows) == count * len(ids)
    got = np.array([[by_id[i][c].whitened for c in range(1, count + 1)] for i in ids])
    centred = apart.astype(float) / len(x)
    for c in range(count):
        want = centred @ axes[:, c] / math.sqrt(values[c])
        alone = min(abs(values[c] - v) for k, v in enumerate(values) if k != c) > 1e-6 * values[0] if len(values) > 1 else True
        if alone:
            assert min(np.abs(got[:, c] - want).max(), np.abs(got[:, c] + want).max()) < 1e-8 * max(1, np.abs(want).max())
    for k, i in enumerate(ids):
        for c, r in by_id[i].items():
            assert r.n == len(x) and r.deviation == sum(v * v for v in apart[k])
            assert r.explained == pytest.approx(values[c - 1] / np.trace(covariance), rel=1e-9)
            assert r.identity_error < 1e-9
    assert np.abs(got.T @ got / len(x) - np.eye(count)).max() < 1e-9


def test_query(spark):
    read = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL_DIR}/embeddings.parquet' ORDER BY vec_id").fetchall()
    rows = queries.QUERIES["op12_whitening"](spark, SMALL_DIR).collect()
    check(rows, [v for _, v in read], [i for i, _ in read])


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, vector string, component int")


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    vectors = [list(map(float, v)) for v in rng.standard_normal((40, 5)) * [9, 5, 2, 1, 0.1]]
    odd = [None, [1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 0.0, 0.0]]
    rows = [(k, v, 1, "x", 2) for k, v in enumerate(vectors)] + [(100 + k, v, None, None, None) for k, v in enumerate(odd)]
    check(whitening.whiten(frame(spark, rows)).collect(), vectors, list(range(40)))


def test_short_vectors_and_repeated_rows(spark):
    vectors = [[1.0, 2.0], [1.0], [0.5, -3.0], [], [1.0, 2.0]]
    rows = [(k % 4, v, 0, "", 0) for k, v in enumerate(vectors)]
    out = whitening.whiten(frame(spark, rows)).collect()
    assert len(out) == 10 and sum(r.vec_id == 0 for r in out) == 4
    filled = [v + [0.0] * (2 - len(v)) for v in vectors]
    check([r for r in whitening.whiten(frame(spark, [(k, v, 0, "", 0) for k, v in enumerate(vectors)])).collect()], filled, list(range(5)))


def test_edges(spark):
    empty = frame(spark, [(1, [1.0, 2.0], 0, "", 0)]).limit(0)
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(frame(spark, [(k, [1.0, 2.0], 0, "", 0) for k in range(3)])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [], 0, "", 0), (2, None, 0, "", 0)])).collect() == []


def test_large_entries(spark):
    """Products beyond 2**53 stay exact; a deviation beyond a long is null."""
    vectors = [[2.0**30 + k, float(k * k)] for k in range(6)] + [[-(2.0**30), 1.0]]
    rows = whitening.whiten(frame(spark, [(k, v, 0, "", 0) for k, v in enumerate(vectors)])).collect()
    _, _, apart, covariance = exact(vectors)
    assert {r.deviation for r in rows} == {None}
    first = [r for r in rows if r.component == 1]
    assert first[0].explained == pytest.approx(np.linalg.eigvalsh(covariance)[-1] / np.trace(covariance), rel=1e-9)


@pytest.mark.parametrize("spectrum", [[5] * 3 + [4] * 9 + [1] * 52, [1e6, 1e3, 1, 1e-3] + [0] * 60, [3] * 64, list(np.linspace(1, 1.05, 64))])
def test_spectra(spark, spectrum):
    """Ties, gaps, lost rank and close eigenvalues: nothing missed, residuals at rounding."""
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((64, 64)))
    matrix = q @ np.diag(spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2
    want = np.linalg.eigvalsh(matrix)[::-1]
    count = min(8, int((want > 1e-12 * want[0]).sum()))
    values, axes = whitening.components(spark, matrix, 8)
    assert len(values) == count and np.abs(values - want[:count]).max() < 1e-13 * want[0] * 64
    assert np.abs(matrix @ axes - axes * values).max() < 1e-13 * want[0]
    assert np.abs(axes.T @ axes - np.eye(count)).max() < 1e-13


def test_inertia():
    rng = np.random.default_rng(4)
    for dims in (1, 2, 3, 12):
        for _ in range(10):
            matrix = rng.standard_normal((dims, dims))
            matrix, shift = matrix + matrix.T, rng.standard_normal()
            assert whitening.inertia_above(*whitening.tridiagonal(matrix), shift) == (np.linalg.eigvalsh(matrix) > shift).sum()
