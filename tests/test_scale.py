"""The way taken for hot keys gives the same rows as the ordinary one."""

import random

import pytest
from pyspark.sql import functions as F

from shotspark import scale
from shotspark.operators import actions as ops
from shotspark.operators import match


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(scale, "CHUNK_ROWS", 7)


def skewed(spark, n=600):
    rng = random.Random(3)
    rows = [(1 if i % 3 else rng.randrange(2, 9), rng.randrange(40), i) for i in range(n)]
    return spark.createDataFrame(rows, "k long, t long, id long")


def test_hot_keys(spark):
    df = skewed(spark)
    assert [r.k for r in scale.hot_keys(df, ["k"], 100).collect()] == [1]
    assert scale.hot_keys(df, ["k"]) is None


def test_numbering(spark):
    df = skewed(spark)
    plain = scale.number_rows(df, ["k"], ["t", "id"], "pos")
    hot = scale.number_rows(df, ["k"], ["t", "id"], "pos", scale.hot_keys(df, ["k"], 100))
    assert sorted(plain.collect()) == sorted(hot.select(*plain.columns).collect())


def test_number_all_and_prefix_sums(spark):
    df = skewed(spark)
    numbered = {r.id: r.pos for r in scale.number_all(df, ["t", "id"], "pos").collect()}
    assert numbered == {r.id: i for i, r in enumerate(df.orderBy("t", "id").collect())}
    sums = {(r.t, r.id): r.s for r in scale.prefix_sums(df, ["t", "id"], {"s": "k"}, partitions=5).collect()}
    total = 0
    for r in df.orderBy("t", "id").collect():
        assert sums[(r.t, r.id)] == total
        total += r.k


def test_states_of_hot_games(spark, data, small_chunks):
    plain = ops.gamestates(data.actions, 4, None)
    hot = ops.gamestates(data.actions, 4, scale.hot_keys(data.actions, ["game_id"], 60))
    assert hot.count() == plain.count()
    assert plain.exceptAll(hot.select(*plain.columns)).count() == 0


def test_quantiles(spark):
    import numpy as np

    values = [random.Random(5).choice([0.1, 0.25, 0.5, 0.9, i / 500]) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    probs = [0, 0.1, 0.25, 0.5, 0.77, 1]
    assert scale.exact_quantiles(df, "p", probs) == pytest.approx(list(np.percentile(values, [100 * q for q in probs])))


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_nearest_in_time_against_all_pairs(spark, small_chunks, hot_rows):
    rng = random.Random(11)
    left = [(rng.choice([1, 1, 1, 2, 3]), float(rng.randrange(400)) / 4, i) for i in range(150)]
    right = [(rng.choice([1, 1, 1, 2, 4]), float(rng.randrange(400)) / 4, 500 + i) for i in range(120)]
    lt = spark.createDataFrame(left, "k long, time_seconds double, _id long")
    rt = spark.createDataFrame(right, "k long, time_seconds double, action_id long")
    hot = scale.hot_keys(lt.select("k").union(rt.select("k")), ["k"], hot_rows) if hot_rows else None
    got = {r._id: r.match.action_id if r.match else None for r in match.nearest_in_time(lt, rt, ["k"], 3.0, hot).collect()}
    want = {}
    for k, t, i in left:
        near = min(((abs(t - s), a) for kk, s, a in right if kk == k), default=(9.0, None))
        want[i] = near[1] if near[0] < 3.0 else None
    assert got == want


def test_chunked_halo(spark, small_chunks):
    df = spark.createDataFrame([(1, i) for i in range(30)], "k long, id long")
    rows = scale.chunked(df, ["k"], ["id"], halo=2).collect()
    assert sum(r._home for r in rows) == 30
    assert sorted(r.id for r in rows if not r._home) == [5, 6, 12, 13, 19, 20, 26, 27]


def test_null_and_many_hot_keys(spark, small_chunks):
    """NULL keys may be hot like any other, and no hot key is left out."""
    rows = [(None if i % 2 else i % 31, i % 40, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, t long, id long")
    hot = scale.hot_keys(df, ["k"], 10)
    assert {r.k for r in hot.collect()} == {None, *range(31)}
    cold, wide = scale.split_hot(df, hot)
    assert (cold.count(), wide.count()) == (0, 900)
    want = {r.id: r.pos for r in scale.number_rows(df, ["k"], ["t", "id"], "pos").collect()}
    assert {r.id: r.pos for r in scale.number_rows(df, ["k"], ["t", "id"], "pos", hot).collect()} == want


def test_slices_follow_the_number_of_rows(spark, small_chunks):
    sliced = scale.ordered_slices(skewed(spark), ["t", "id"])
    sizes = [r["count"] for r in sliced.groupBy(scale.SLICE).count().collect()]
    assert len(sizes) > 60 and max(sizes) < 60


def test_shared_folder_needs_a_setting_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        scale.shared_folder(Session())


def test_materialize_keeps_rows(spark):
    df = skewed(spark)
    assert scale.materialize(df).agg(F.sum("id")).first() == df.agg(F.sum("id")).first()
