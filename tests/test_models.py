from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from shotspark.functions import features as fs
from shotspark.functions import filters
from shotspark.plans import calibrate, dataset, models, prep, search, treelr
from shotspark.scale import materialize, scratch_path

NUMERIC = ["start_dist_to_goal_a0", "start_angle_to_goal_a0"]


@pytest.fixture(scope="module")
def openplay(data):
    frame = dataset.training_frame(data, [fs.startpolar, fs.bodypart, fs.actiontype], filters.openplay, 1)
    return materialize(frame.withColumn("label", F.col("goal").cast("double")))


def newton(x, y, penalty, weights=None):
    """Minimum of sum(w * logloss) + penalty/2 * |b|^2, per-coefficient penalty."""
    w = np.ones(len(y)) if weights is None else weights
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        g = x.T @ (w * (p - y)) + penalty * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        b -= np.linalg.solve(h, g)
    return b


def design(openplay):
    pdf = openplay.toPandas()
    z = (pdf[NUMERIC] - pdf[NUMERIC].mean()) / pdf[NUMERIC].std(ddof=0)
    hot = np.column_stack([(pdf["bodypart_id_a0"] == v).astype(float) for v in ("foot", "head", "other")])
    return np.column_stack([hot, z.values]), pdf["label"].values


def test_openplay_matches_newton(spark, openplay):
    x, y = design(openplay)
    model = models.OpenplayModel().train(openplay)
    assert list(model.fitted.stages[-1].coefficients) == pytest.approx(list(newton(x, y, np.ones(5))), abs=1e-4)
    table = models.coefficients(spark, model.fitted, openplay).collect()
    assert [r.coefficient for r in table] == sorted(r.coefficient for r in table)
    assert {r.feature for r in table} == {"bodypart_id_a0__h_foot", "bodypart_id_a0__h_head", "bodypart_id_a0__h_other", *[f"{c}__z" for c in NUMERIC]}


def test_balanced_weights_and_intercept(openplay):
    x, y = design(openplay)
    ready = prep.prep_linear(NUMERIC, []).fit(openplay).transform(openplay)
    fitted = models.SkLogistic(C=0.5, classWeight="balanced").fit(ready)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    xs = np.column_stack([x[:, 3:], np.ones(len(y))])
    want = newton(xs, y, np.array([2.0, 2.0, 0.0]), w)
    assert [*fitted.coefficients, fitted.intercept] == pytest.approx(list(want), abs=1e-4)


def test_not_fitted(data):
    for model in (models.OpenplayModel(), models.CompositeModel()):
        with pytest.raises(models.NotFitted):
            model.estimate(data)
        with pytest.raises(models.NotFitted):
            model.validate(data)


def test_penalty(spark, data):
    model = models.PenaltyModel()
    rows = model.estimate(data).collect()
    assert rows and all(r.xG == 0.792453 for r in rows)


def test_composite_and_store(spark, data):
    pairs = [(c, "1718") for c in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]
    model = models.CompositeModel().train(data, pairs)
    assert model.training_seasons == pairs
    assert set(model.column_descriptions) == {"OpenplayModel", "FreekickModel", "PenaltyModel"}
    scored = materialize(model.estimate(data))
    assert scored.count() == scored.select(*dataset.KEY).distinct().count()
    scalars, curve = model.validate(data, [(c, "1819") for c, _ in pairs])
    assert 0 < scalars["brier"] < 1 and curve.count() == 99
    folder = scratch_path(spark, "models")
    model.save(spark, folder)
    loaded = models.ShotModel.load(spark, folder)
    assert isinstance(loaded, models.CompositeModel) and loaded.training_seasons == pairs
    both = scored.join(loaded.estimate(data).withColumnRenamed("xG", "x2"), dataset.KEY)
    assert both.count() == scored.count() and both.filter("abs(xG - x2) > 1e-12").count() == 0
    model.save(spark, folder, "named")  # overwrites silently on the second time
    model.save(spark, folder, "named")
    assert models.ShotModel.load(spark, folder, "named").trained


def test_composite_reads_the_actions_once(data):
    model = models.CompositeModel().train(data)
    plan = model.estimate(data)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "start_x#" in line for line in plan.splitlines()) == 1
    single = [models.OpenplayModel().train(data), models.FreekickModel().train(data), models.PenaltyModel()]
    want = sorted((r.game_id, r.action_id, round(r.xG, 6)) for m in single for r in m.estimate(data).collect())
    assert sorted((r.game_id, r.action_id, round(r.xG, 6)) for r in model.estimate(data).collect()) == want


def test_composite_on_a_table_scores_every_row_once(data):
    table = dataset.training_frame(data, [fs.startpolar, fs.bodypart, fs.actiontype], n=1)
    model = models.CompositeModel().train(table)
    scored = model.estimate(table)
    assert scored.count() == table.count()
    with pytest.raises(ValueError):
        model.estimate(table.drop("type_id_a0"))
    scalars, _ = model.validate(table)
    assert scalars["roc"] > 0.5


def test_default_models_read_no_earlier_actions(data):
    plan = dataset.shot_features(data, [fs.startpolar], filters.openplay, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_user_pipeline_sees_all_features(spark, data):
    from pyspark.ml.classification import RandomForestClassifier

    pipeline = Pipeline(stages=[prep.prep_tree(["speed_a01", *NUMERIC], ["type_id_a1"]), RandomForestClassifier(numTrees=3, seed=1)])
    model = models.OpenplayModel(pipeline).train(data)
    folder = scratch_path(spark, "models")
    model.save(spark, folder)
    loaded = models.ShotModel.load(spark, folder, default=models.OpenplayModel)
    assert loaded.estimate(data).count() == model.estimate(data).count() > 0


class Mine(models.OpenplayModel):
    default_name = "mine"


def test_own_class_in_a_stored_model(spark, data):
    folder = scratch_path(spark, "models")
    model = models.CompositeModel([Mine(), models.PenaltyModel()]).train(data)
    model.save(spark, folder)
    loaded = models.ShotModel.load(spark, folder, classes=[Mine])
    assert type(loaded.models[0]) is Mine
    assert loaded.estimate(data).count() == model.estimate(data).count()
    assert type(models.ShotModel.load(spark, folder).models[0]).__name__ == "Mine"  # from its module

    class Local(models.PenaltyModel):
        default_name = "local"

    Local().save(spark, folder)
    with pytest.raises(ValueError, match="classes"):
        models.ShotModel.load(spark, folder, "local")


def test_given_games(data):
    ids = [r.game_id for r in data.games.limit(5).collect()]
    shots = dataset.shot_labels(data, game_ids=ids)
    assert {r.game_id for r in shots.collect()} <= set(ids) and shots.count() > 0
    assert dataset.shot_features(data, [fs.startpolar], game_ids=ids).count() == shots.count()
    assert dataset.training_frame(data, [fs.startpolar], game_ids=ids).count() == shots.count()
    assert models.PenaltyModel().estimate(data, ids).count() <= models.PenaltyModel().estimate(data).count()


def test_shot_filter_reaches_the_scan(spark, data):
    path = scratch_path(spark, "actions")
    data.actions.write.parquet(path)
    stored = replace(data, actions=spark.read.parquet(path))
    plan = dataset.shot_features(stored, [fs.startpolar], filters.any_shot, 1)._jdf.queryExecution().executedPlan().toString()
    assert "In(type_id, [4,5,6])" in plan and "In(result_id, [0,1])" in plan


def test_surface(data):
    model = models.OpenplayModel().train(data)
    part = data.games.sparkSession.createDataFrame([("foot",)], "bodypart_id string")
    grid = models.surface(model, part)
    assert grid.count() == 106 * 69
    near, far = [grid.filter(f"x = {x} and y = 34").first().xG for x in (100, 20)]
    # on the axis of the goal only the distance changes
    slope = list(model.fitted.stages[-1].coefficients)[3]
    assert 0 < near < 1 and 0 < far < 1 and (near - far) * slope < 0


def test_tree_lr_round_trip(spark, openplay):
    forest = Pipeline(stages=[prep.prep_tree(NUMERIC, ["bodypart_id_a0"]), search.BoostedTrees(maxIter=3, maxDepth=2)])
    model = treelr.TreeLR(forest).fit(openplay)
    path = scratch_path(spark, "treelr")
    model.save(path)
    p = models.positive_probability().alias("p")
    first = model.transform(openplay).select(*dataset.KEY, p)
    again = treelr.TreeLR.load(path).transform(openplay).select(*dataset.KEY, p.alias("q"))
    joined = first.join(again, dataset.KEY)
    assert joined.count() == openplay.count() and joined.filter("abs(p - q) > 1e-12").count() == 0
    assert first.select("p").distinct().count() > 1


def test_search(openplay):
    found = search.logreg_search(NUMERIC, ["bodypart_id_a0"], n_iter=2, folds=2, scoring="brier")
    fitted = found.fit(openplay)
    scores = [r.score for r in found.table(fitted).collect()]
    assert len(scores) == 2 and all(0 < s < 0.5 for s in scores)
    model = models.OpenplayModel.from_pipeline(fitted.bestModel, ["1718"])
    assert model.training_seasons == ["1718"] and model.estimate(openplay).count() == openplay.count()
    with pytest.raises(ValueError):
        search.scorer("accuracy")


# --- calibration ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(8)
    s = np.round(rng.beta(2, 4, 800), 3)
    y = (rng.random(800) < 1 / (1 + np.exp(-(1.4 * np.log(s + 1e-9) - 0.6 * np.log(1 - s) + 0.8)))).astype(int)
    return spark.createDataFrame([(float(a), int(b), float(i % 3 + 1)) for i, (a, b) in enumerate(zip(s, y))], "score double, y int, w double"), s, y


def fit_plain(x, y, weights=None):
    return newton(x, y, np.zeros(x.shape[1]), weights)


def test_sigmoid(scores):
    df, s, y = scores
    got = calibrate.Calibrator("sigmoid").fit(df).parameters
    assert got == pytest.approx(tuple(fit_plain(np.column_stack([s, np.ones(len(s))]), y)), abs=1e-3)


def test_beta(scores):
    df, s, y = scores
    ones = np.ones(len(s))
    a, b, c = calibrate.Calibrator("beta").fit(df).parameters
    assert (a, b, c) == pytest.approx(tuple(fit_plain(np.column_stack([np.log(s), -np.log1p(-s), ones]), y)), abs=1e-2)
    a, b, c = calibrate.Calibrator("beta_am").fit(df).parameters
    assert a == b and (a, c) == pytest.approx(tuple(fit_plain(np.column_stack([np.log(s / (1 - s)), ones]), y)), abs=1e-3)
    a, b, _ = ab = calibrate.Calibrator("beta_ab").fit(df).parameters
    assert (a, b) == pytest.approx(tuple(fit_plain(np.column_stack([np.log(2 * s), -np.log(2 * (1 - s))]), y)), abs=1e-2)
    half = df.select(F.lit(0.5).alias("score")).limit(1)
    assert calibrate.Calibrator("beta_ab", ab).transform(half).first()["p"] == pytest.approx(0.5)


def test_beta_weights(scores):
    df, s, y = scores
    w = np.array([i % 3 + 1.0 for i in range(len(s))])
    got = calibrate.Calibrator("beta_am").fit(df, weight="w").parameters
    want = fit_plain(np.column_stack([np.log(s / (1 - s)), np.ones(len(s))]), y, w)
    assert (got[0], got[2]) == pytest.approx(tuple(want), abs=1e-3)


def test_negative_slope_is_held_at_zero(spark):
    df = spark.createDataFrame([(i / 50, int(i < 20)) for i in range(1, 50)], "score double, y int")
    a, b, _ = calibrate.Calibrator("beta").fit(df).parameters
    assert a >= 0 and b >= 0


def test_isotonic_against_pooling(scores):
    df, s, y = scores
    blocks = []
    for v in sorted(set(s)):
        blocks.append([y[s == v].mean(), (s == v).sum(), [v]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (m1, n1, v1), (m2, n2, v2) = blocks[-2:]
            blocks[-2:] = [[(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2, v1 + v2]]
    want = {v: m for m, _, vs in blocks for v in vs}
    out = calibrate.Calibrator("isotonic").fit(df).transform(df)
    for r in out.collect():
        assert r.p == pytest.approx(want[r.score], abs=1e-9)
    outside = df.sparkSession.createDataFrame([(-1.0,), (2.0,)], "score double")
    got = [r.p for r in calibrate.Calibrator("isotonic").fit(df).transform(outside).orderBy("score").collect()]
    assert got == pytest.approx([want[min(s)], want[max(s)]])


def test_extreme_scores(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "score double")
    got = [r.p for r in calibrate.Calibrator("beta", (1.0, 1.0, 0.0)).transform(df).orderBy("score").collect()]
    assert got == pytest.approx([0, 1], abs=1e-9)
    with pytest.raises(ValueError):
        calibrate.Calibrator("platt")


def test_cross_validated_calibration(openplay):
    base = Pipeline(stages=[prep.prep_linear(NUMERIC, ["bodypart_id_a0"]), models.SkLogistic()])
    calibrated = calibrate.CalibratedClassifier(base, "sigmoid", folds=2).fit(openplay)
    out = calibrated.predict(openplay).collect()
    assert all(sum(r.proba) == pytest.approx(1) for r in out)
    assert all(r.prediction == float(r.proba[1] > r.proba[0]) for r in out)
    bare = openplay.sparkSession.createDataFrame([(0.1,), (0.9,)], "score double")
    got = [r.proba[1] for r in calibrated.calibrate_scores(bare).orderBy("score").collect()]
    lines = [c.parameters for _model, (c,) in calibrated.parts]
    want = [np.mean([1 / (1 + np.exp(-(a * s + c))) for a, c in lines]) for s in (0.1, 0.9)]
    assert got == pytest.approx(want)
    few = openplay.filter("label = 0").limit(20).unionByName(openplay.filter("label = 1").limit(1))
    with pytest.raises(ValueError):
        calibrate.CalibratedClassifier(base, "sigmoid", folds=2).fit(few)


def test_score_type(openplay):
    base = Pipeline(stages=[prep.prep_linear(NUMERIC, []), models.SkLogistic()]).fit(openplay)
    with pytest.raises(ValueError):
        calibrate.CalibratedClassifier(base, "sigmoid", score_type="margin").fit(openplay)
    # on the margin of a logistic model, the sigmoid is close to the identity
    out = calibrate.CalibratedClassifier(base, "sigmoid").fit(openplay).predict_proba(openplay)
    p = base.transform(openplay).select(*dataset.KEY, models.positive_probability().alias("p"))
    assert out.join(p, dataset.KEY).filter(F.abs(F.col("proba")[1] - F.col("p")) > 0.02).count() == 0


@pytest.mark.parametrize("chunk, levels", [(100_000, 10_000), (9, 10_000), (9, 0), (100_000, 0)])
def test_isotonic_in_slices(spark, monkeypatch, chunk, levels):
    """Against pooling in one place, with falling runs that reach over many slices."""
    from shotspark import scale

    monkeypatch.setattr(scale, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(5)
    x = np.round(rng.random(400), 2)
    y = (rng.random(400) < np.where(x < 0.5, 0.9 - x, x)).astype(int)  # falls over the first half
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "score double, y int")
    fitted = calibrate.Calibrator("isotonic", max_levels=levels).fit(rows)
    assert (fitted.model is None) == (levels == 0)
    blocks = []
    for v in np.unique(x):
        block = [y[x == v].sum(), (x == v).sum(), v, v]
        while blocks and blocks[-1][0] / blocks[-1][1] >= block[0] / block[1]:
            last = blocks.pop()
            block = [last[0] + block[0], last[1] + block[1], last[2], block[3]]
        blocks.append(block)
    xs = [e for b in blocks for e in (b[2], b[3])]
    qs = [b[0] / b[1] for b in blocks for _ in range(2)]
    probe = [-1.0, 0.0, 0.111, 0.4999, 0.655, 0.9, 2.0, *x[:50].tolist()]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(probe)] + [(99, None)], "i int, score double")
    got = {r.i: r.p for r in fitted.transform(df).collect()}
    assert got.pop(99) is None
    assert [got[i] for i in range(len(probe))] == pytest.approx(np.interp(probe, xs, qs).tolist())
