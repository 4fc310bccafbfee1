"""Whitening against numpy's eigenvalues and plain integer arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from shotspark.llm.whitening import count_above, leading_pairs, whiten


def matrix(values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    v = q @ np.diag(values) @ q.T
    return (v + v.T) / 2


SPECTRA = [
    np.arange(30, 0, -1.0), [5.0, 5, 5, 2, 2, 1, 0, 0], [1e6, 1e6 - 1e-7, 3, 1e-3, 1e-9, 0], [1.0], [0.0, 0.0], [7.0, 7.0],
    [4.0, 4 - 1e-12, 4 - 1e-5, 1, 1, 1, 1, 1],
]


@pytest.mark.parametrize("values", SPECTRA)
def test_counts_are_those_of_the_eigenvalues(values):
    v = matrix(values)
    true = np.linalg.eigvalsh(v)
    for s in [*(true[:-1] + np.diff(true) / 2), true[0] - 1, true[-1] + 1]:
        if np.abs(true - s).min() > 1e-9 * max(1, np.abs(true).max()):
            assert count_above(v, s) == (true > s).sum()


@pytest.mark.parametrize("values", SPECTRA)
def test_pairs_are_eigenpairs_in_falling_order(values):
    v = matrix(values)
    true = np.linalg.eigvalsh(v)[::-1]
    tiny = len(v) * 2.3e-16 * max(np.abs(v).sum(axis=1).max(), 1e-300)
    pairs = leading_pairs(v, 5)
    assert len(pairs) == min(5, (true > tiny).sum())
    x = np.array([p for _, p in pairs]).reshape(-1, len(v))
    assert np.allclose([e for e, _ in pairs], true[: len(pairs)], rtol=1e-9, atol=4 * tiny)
    assert np.abs(x @ x.T - np.eye(len(pairs))).max(initial=0) < 1e-12
    for e, p in pairs:
        assert np.linalg.norm(v @ p - e * p) <= 20 * tiny


def table(spark, rows):
    schema = T.StructType(
        [
            T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("x", T.StringType()), T.StructField("n", T.LongType()), T.StructField("key", T.LongType()),
        ]
    )
    return spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], schema)


def plain(rows, k=16):
    """Whitened values by numpy's eigenvectors, and exact deviations."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if good(v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    out = []
    for i, x in kept:
        d = [n * c - s for c, s in zip(x, sums)]
        out.append((i, sum(c * c for c in d), (np.array(d) / n) @ q / np.sqrt(e)))
    return n, e / np.trace(v), out


def good(v):
    return v is not None and len(v) == 20 and all(c is not None and math.isfinite(c) for c in v)


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(300, 20)) * np.geomspace(3, 0.2, 20)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    hot = rows[7][1]
    rows += [(1000 + i, hot) for i in range(200)] + [(5, rows[5][1]), (None, rows[6][1])]
    bad = [None, [], [1.0] * 3, [None] * 20, [*hot[:19], None], [*hot[:19], math.nan], [*hot[:19], math.inf]]
    return rows + [(9000 + i, v) for i, v in enumerate(bad)]


def test_rows_are_those_of_plain_arithmetic(spark, rows):
    got = {}
    for r in whiten(table(spark, rows).repartition(5)).collect():
        got.setdefault(r["key"], []).append(r)
    n, explained, want = plain(rows)
    assert sum(map(len, got.values())) == 16 * len(want)
    for i, deviation, values in want:
        mine = sorted(got[i], key=lambda r: r["component"])
        assert {r["component"] for r in mine} == set(range(1, 17))
        assert {(r["n"], r["deviation"]) for r in mine if len(mine) == 16} <= {(n, deviation)}
        if len(mine) == 16:
            assert np.allclose(np.abs([r["whitened"] for r in mine]), np.abs(values), rtol=1e-6, atol=1e-6)
        assert np.allclose(sorted({r["explained"] for r in mine})[::-1], explained, rtol=1e-9)
        assert mine[0]["identity_error"] < 1e-9


def test_signs_are_the_same_for_all_rows(spark, rows):
    n, _, want = plain(rows)
    w = {}
    for r in whiten(table(spark, rows)).filter("key < 300").collect():
        w.setdefault(r["key"], {})[r["component"]] = r["whitened"]
    one = np.array([[w[i][c] for c in range(1, 17)] for i in range(300) if len(w[i]) == 16])
    other = np.array([v for i, _, v in want if i is not None and i < 300])[: len(one)]
    signs = np.sign((one * other).sum(axis=0))
    assert np.allclose(one * signs, other, rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize(
    "rows", [[], [(1, None)], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])], [(1, [])]]
)
def test_nothing_to_whiten(spark, rows):
    assert whiten(table(spark, rows)).collect() == []


def test_rank_below_the_number_of_components(spark):
    """Vectors on a line have one component."""
    got = whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(6)])).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12


def test_large_entries_keep_exact_deviations(spark):
    rows = [(i, [float(i * 1_000_000), 1.0 * (i % 3)]) for i in range(50)]
    got = {r["key"]: r["deviation"] for r in whiten(table(spark, rows)).collect()}
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((50 * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    assert [got[i] for i in range(50)] == [d if d < 1 << 63 else None for d in want]
