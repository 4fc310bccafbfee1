import math

import pytest
from pyspark.sql import functions as F

from shotspark.functions import features as fs
from shotspark.functions import filters
from shotspark.functions.filters import field_of
from shotspark.functions.vocab import Vocabulary, id_of, name_of
from shotspark.operators import actions as ops
from shotspark.plans import dataset
from shotspark.sources import tables


def points(spark, *xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, start_x double, start_y double")


def one(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def test_goal_angle(spark):
    df = points(spark, (105, 34), (105, 0), (94, 34), (104, 34), (106, 34))
    got = one(fs.on_table(df, [fs.goalangle], ["id"]), "shot_angle_a0")
    assert got[0] == pytest.approx(math.pi)
    assert got[1] == 0 and got[4] == 0
    assert got[2] == pytest.approx(math.atan(7.3 * 11 / (121 - 3.65**2)))
    assert math.pi / 2 < got[3] < math.pi


def test_polar_on_the_goal_line(spark):
    df = points(spark, (105, 34), (105, 30), (95, 34), (95, 24))
    out = fs.on_table(df, [fs.startpolar], ["id"])
    assert one(out, "start_dist_to_goal_a0") == pytest.approx([0, 4, 10, math.sqrt(200)])
    assert one(out, "start_angle_to_goal_a0") == pytest.approx([0, math.pi / 2, 0, math.pi / 4])


NINE = [(102, 34), (102, 28), (95, 34), (90, 16), (104, 16), (80, 34), (50, 34), (90, 5), (90, 60)]


def test_location_zones(spark):
    df = points(spark, *NINE)
    assert one(fs.on_table(df, [fs.location_zone], ["id"]), "caley_zone_a0") == [1, 2, 3, 4, 5, 6, 7, 8, 0]
    fixed = fs.custom_grid("z", fs.shot_location_zones(fix_zone8=True))
    assert one(fs.on_table(df, [fixed], ["id"]), "z_a0") == [1, 2, 3, 4, 5, 6, 7, 8, 8]


def test_grids_count_edges_and_drop_high_zones(spark):
    df = points(spark, (10, 10), (50, 40), (104, 67))
    grid = fs.rectangular_grid("g", [0, 20, 40], [0, 30], symmetrical=True)
    # edges passed: x 1, 3, 3 and y 1, 1 (40 folds to 6), 2 (67 folds to 33)
    assert one(fs.on_table(df, [grid], ["id"]), "g_a0") == [2, 4, None]
    assert one(fs.on_table(df, [fs.custom_grid("none", [])], ["id"]), "none_a0") == [0, 0, 0]


def two_states(spark, shot, before):
    fields = "time_seconds double, team_id long, start_x double, start_y double, end_x double, end_y double"
    return spark.createDataFrame([(shot, before)], f"a0 struct<{fields.replace(' ', ':').replace(',:', ', ')}>, a1 struct<{fields.replace(' ', ':').replace(',:', ', ')}>")


def test_speed_and_deltas(spark):
    df = two_states(spark, (10.2, 1, 90.0, 30.0, 0.0, 0.0), (10.0, 2, 80.0, 20.0, 93.0, 26.0))
    columns = [c for g in (fs.speed, fs.space_delta, fs.time_delta, fs.team) for c in g([field_of("a0"), field_of("a1")])]
    row = df.select(*columns).first()
    assert (row.speedx_a01, row.speedy_a01, row.speed_a01) == (3, 4, 5)  # at least one second
    assert (row.dx_a01, row.dy_a01, row.mov_a01) == (3, -4, 5)
    assert row.time_delta_1 == pytest.approx(0.2) and row.team_1 is False


def test_vocabulary_lookup(spark):
    vocab = Vocabulary()
    df = spark.createDataFrame([(0,), (6,), (7,), (None,)], "i int")
    assert [r[0] for r in df.select(name_of(F.col("i"), vocab.types)).collect()] == ["pass", "shot_freekick", None, None]
    names = spark.createDataFrame([("head",), ("knee",), (None,)], "n string")
    assert [r[0] for r in names.select(id_of(F.col("n"), vocab.bodyparts)).collect()] == [1, None, None]
    assert vocab.table(spark, "result").count() == 4


def test_states_at_the_start_of_a_period(spark):
    fields = [(1, a, p, float(t), 10, 20, None, 0, 0, 1.0, 2.0, 3.0, 4.0) for a, p, t in [(0, 1, 0), (1, 1, 5), (2, 1, 9), (3, 2, 0)]]
    df = spark.createDataFrame(
        fields,
        "game_id long, action_id long, period_id long, time_seconds double, team_id long, player_id long, "
        "type_id long, result_id long, bodypart_id long, start_x double, start_y double, end_x double, end_y double",
    )
    rows = ops.gamestates(df, 3).orderBy("action_id").collect()
    assert [(r.a0.action_id, r.a1.action_id, r.a2.action_id) for r in rows] == [(0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 3, 3)]
    # a missing field of the previous action stays missing
    assert rows[2].a1.type_id is None


def test_masked_columns_do_not_vary(data):
    table = dataset.shot_features(data)
    dropped = set(table.columns) - set(ops.drop_constant(table).columns)
    assert dropped == {
        "end_x_a0", "end_y_a0", "result_id_a0", "dx_a0", "dy_a0", "movement_a0", "end_dist_to_goal_a0", "end_angle_to_goal_a0",
    }


def test_features_and_labels_have_the_same_keys(data):
    labels = dataset.shot_labels(data)
    features = dataset.shot_features(data, [fs.startpolar])
    assert features.count() == labels.count() == features.join(labels, dataset.KEY).count()
    frame = dataset.training_frame(data, [fs.startpolar])
    assert frame.join(labels.withColumnRenamed("goal", "g"), dataset.KEY).filter("goal <> g").count() == 0


def test_user_filter_and_no_generators(data):
    def headers(a):
        return filters.any_shot(a) & (a("bodypart_name") == "head")

    keys = dataset.shot_features(data, [], headers)
    assert keys.columns == dataset.KEY and 0 < keys.count() < dataset.shot_labels(data).count()


def test_pitch_grid_size(spark):
    grid = dataset.pitch_grid(spark.createDataFrame([("foot",)], "bodypart_id string"))
    assert grid.count() == 106 * 69


def test_temporal_split(spark):
    from datetime import date

    games = spark.createDataFrame([(i, date(2018, 1, 1 + i)) for i in range(10)], "game_id int, game_date date")

    def sizes(mode):
        split = tables.sample_temporal(games, 0.2, 0.3, mode)
        return {r["split"]: r["count"] for r in split.filter("split is not null").groupBy("split").count().collect()}

    assert sizes("contiguous") == {"train": 5, "val": 2, "test": 3}
    assert sizes("reference") == {"train": 5, "val": 2, "test": 1}
