"""Whitening against a plain eigendecomposition; factor and rotations by definition; odd rows."""

import numpy as np
import pytest

from pressdesk.llm import whitening
from pressdesk.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, component string, n string, `a.b` string"


def frame(spark, vectors):
    rows = [(i, v, None, "x", "x", "x") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(vectors):
    """Sorted rows (id, component, n, deviation, |whitened|, explained)."""
    x = np.floor(1024 * np.array([v for _, v in vectors], np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    z = x - s / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(8, int((e > 1e-9 * e[0]).sum()))
    w = z @ u[:, :k] / np.sqrt(e[:k])
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return w, e / v.trace(), dev, k


def check(spark, vectors, rows=None):
    w, explained, dev, k = plain(vectors)
    got = sorted(map(tuple, whitening.whiten(frame(spark, rows or vectors)).collect()), key=lambda r: (r[0], r[1]))
    assert [(r[0], r[1]) for r in got] == [(i, c) for i, _ in vectors for c in range(1, k + 1)]
    white = np.array([r[4] for r in got]).reshape(len(vectors), k)
    sign = np.sign((white * w).sum(0))
    assert np.abs(white * sign - w).max() < 1e-8
    assert [r[3] for r in got[::k]] == dev and {r[2] for r in got} == {len(vectors)}
    assert np.allclose([r[5] for r in got[:k]], explained[:k], rtol=1e-9)
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-8


def some(n, d, seed=3):
    r = np.random.default_rng(seed)
    return [(i, v) for i, v in enumerate((r.normal(size=(n, d)) @ r.normal(size=(d, d)) / d).tolist())]


@pytest.mark.parametrize("n, d", [(50, 5), (300, 16), (4, 9), (2, 3), (40, 1)])
def test_against_eigenvectors(spark, n, d):
    check(spark, some(n, d))


def test_odd_rows_are_dropped(spark):
    good = some(30, 4)
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan")] * 4), (103, [float("inf"), 0.0, 0.0, 0.0]),
           (104, []), (105, [1.0, 2.0]), (106, [1.0, 2.0, 3.0, 4.0, 5.0])]
    check(spark, good, rows=[*odd[:3], *good, *odd[3:]])


def test_repeated_rows_and_null_ids(spark):
    good = some(20, 3)
    rows = whitening.whiten(frame(spark, [*good, *good, (None, good[0][1])])).collect()
    assert len(rows) == 41 * 3 and sum(r.vec_id is None for r in rows) == 3
    assert len({(r.component, r.whitened) for r in rows if r.vec_id == 4}) == 3


def test_no_variance(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    assert whitening.whiten(frame(spark, [(1, [])] * 5)).count() == 0


def test_very_large_entries(spark):
    rows = whitening.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 0.0])])).collect()
    assert {r.component for r in rows} == {1} and {r.deviation for r in rows if r.vec_id < 3} == {None}
    assert np.allclose(sorted(r.whitened for r in rows), [-(1.5**0.5), 0, 1.5**0.5], atol=1e-6)
    middling = whitening.whiten(frame(spark, [(1, [1e9, 0.0]), (2, [0.0, 0.0])])).collect()
    assert {r.deviation for r in middling} == {(int(np.float32(1e9)) * 1024) ** 2 if (1e9 * 1024) ** 2 < 2**63 else None}


@pytest.mark.parametrize("shape, rank", [((6, 6), 6), ((7, 7), 3), ((1, 1), 1), ((4, 4), 0)])
def test_factor_and_rotations(shape, rank):
    r = np.random.default_rng(1)
    half = r.normal(size=(shape[0], rank))
    matrix = half @ half.T
    factor = whitening.pivoted_cholesky(matrix)
    assert factor.shape == (shape[0], rank) and np.allclose(factor @ factor.T, matrix)
    values, vectors = whitening.jacobi(factor)
    assert np.allclose(vectors.T @ vectors, np.eye(rank))
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:rank])
    assert np.allclose(vectors * values @ vectors.T, matrix)


def test_equal_eigenvalues():
    values, vectors = whitening.jacobi(whitening.pivoted_cholesky(2 * np.eye(8)))
    assert np.allclose(values, 2) and np.allclose(vectors.T @ vectors, np.eye(8))


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    w, explained, dev, k = plain([(r.vec_id, r.embedding) for r in rows])
    got = QUERIES["op13_embedding_whitening"](spark, sf_dir).orderBy("vec_id", "component").collect()
    white = np.array([r.whitened for r in got]).reshape(len(rows), 8)
    assert np.abs(white * np.sign((white * w).sum(0)) - w).max() < 1e-9
    assert [r.deviation for r in got[::8]] == dev and got[0].identity_error <= 1e-9
    assert np.allclose([r.explained for r in got[:8]], explained[:8], rtol=1e-12)
