"""Clusters against plain integer arithmetic over all pairs of vector and centroid."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from shotspark.llm.centroids import choose_pivots, cluster, nearest, squared, _distances


def table(spark, rows):
    schema = T.StructType(
        [
            T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("x", T.StringType()), T.StructField("cluster", T.LongType()), T.StructField("key", T.LongType()),
        ]
    )
    return spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], schema)


def plain(rows, k=16, rounds=3, dim=64):
    kept = [
        (i, tuple(math.floor(64 * float(np.float32(c))) for c in v))
        for i, v in rows
        if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)
    ]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [x for _, x in sorted((name(i), x) for i, x in kept)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            mine = [x for (_, x), (_, c) in zip(kept, found) if c == n]
            if mine:
                centroids[n] = tuple(sum(col) // len(mine) for col in zip(*mine))
    return sorted(((i is not None, i or 0, c, d) for (i, _), (d, c) in zip(kept, assign()))), centroids


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(11)
    centers = rnd.normal(size=(9, 64))
    rows = [(i, [float(c) for c in centers[i % 9] + rnd.normal(size=64) * 0.3]) for i in range(250)]
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(120)] + [(4, rows[4][1]), (4, rows[5][1]), (None, rows[6][1]), (None, hot)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] * 64, [*hot[:63], None], [*hot[:63], math.nan], [*hot[:63], -math.inf]]
    return rows + [(9000 + i, v) for i, v in enumerate(bad)]


def check(spark, rows):
    found, centroids = cluster(table(spark, rows).repartition(5))
    got = sorted((r["key"] is not None, r["key"] or 0, r["cluster"], r["distance"]) for r in found.collect())
    want, means = plain(rows)
    assert got == want and [tuple(c) for c in centroids.tolist()] == means


def test_clusters_are_those_of_all_distances(spark, rows):
    check(spark, rows)


def test_ties_and_few_values(spark):
    rnd = np.random.default_rng(2)
    check(spark, [(i, [float(c) for c in rnd.integers(-1, 2, 64) / 64]) for i in range(80)])
    check(spark, [(i, [0.25 * (i % 2)] * 64) for i in range(40)])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 3)]])
def test_nothing_to_cluster(spark, rows):
    found, centroids = cluster(table(spark, rows))
    assert found.collect() == [] and len(centroids) == 0


def test_fewer_vectors_than_clusters(spark):
    check(spark, [(i, [float(i)] * 64) for i in range(5)])


def test_large_entries_raise(spark):
    with pytest.raises(Exception, match="too large"):
        cluster(table(spark, [(1, [1e30] * 64)]))


def test_bounds_spare_distances_and_lose_none():
    rnd = np.random.default_rng(4)
    centers = rnd.integers(-500, 500, (16, 64))
    x = (centers[rnd.integers(0, 16, 3000)] + rnd.integers(-20, 20, (3000, 64))).astype(np.int64)
    pivots = choose_pivots(x[:256], 16)
    number, best, measured = nearest(x, _distances(x, pivots), centers, _distances(pivots, centers))
    every = np.stack([squared(x, c) for c in centers], axis=1)
    assert (number == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert measured < 0.5 * every.size
