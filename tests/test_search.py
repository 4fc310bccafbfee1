"""Shared-scan searches against plain numpy fits of single candidates."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from shotspark.plans import boosting, models, neural, prep, search, shared
from shotspark.scale import materialize, scratch_path

NUMERIC, CATEGORIC, FOLDS = ["u", "v"], ["c"], 3


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 400
    u, v = rng.normal(size=n).round(2), (rng.normal(size=n) * 3 + 1).round(1)
    c = rng.choice(["x", "y", "z"], n)
    z = 1.2 * u - 0.4 * v + (c == "x") * 0.8
    label = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(float)
    value = 2 * u - v + (c == "y") + rng.normal(size=n)
    return [(i, float(a), float(b), str(k), float(y), float(t)) for i, (a, b, k, y, t) in enumerate(zip(u, v, c, label, value))]


@pytest.fixture(scope="module")
def df(spark, rows):
    return materialize(spark.createDataFrame(rows, "id long, u double, v double, c string, label double, value double").repartition(3), "rows")


@pytest.fixture(scope="module")
def folds(df):
    return shared.fold_rows(df, prep.prep_linear(NUMERIC, CATEGORIC), FOLDS, F.col("id") % FOLDS, ["id"])[0]


def design(rows, fold):
    """Features and labels of all rows as encoders without the fold give them."""
    ids = np.array([r[0] for r in rows])
    seen = ids % FOLDS != fold
    c = np.array([r[3] for r in rows])
    columns = [(c == k).astype(float) for k in "xyz"]
    for i in (1, 2):
        x = np.array([r[i] for r in rows])
        columns.append((x - x[seen].mean()) / x[seen].std())
    return np.column_stack(columns), seen


def test_logistic_fits_reach_the_minimum(rows, df, folds):
    y = np.array([r[4] for r in rows])
    candidates = [(f, p, s, b) for f in range(FOLDS) for p, s in (("l2", 1e-4), ("l2", 3.0), ("l1", 0.5), ("l1", 20.0), ("l1", 1e6)) for b in (True, False)]
    fits = shared.LogisticFits(folds, FOLDS, candidates)
    for (f, penalty, strength, balanced), w in zip(candidates, fits.weights):
        x, seen = design(rows, f)
        x, t = x[seen], y[seen]
        own = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum()))) if balanced else np.ones(len(t))
        gradient = x.T @ (own * (1 / (1 + np.exp(-(x @ w))) - t))
        if penalty == "l2":
            assert np.abs(gradient + strength * w).max() < 1e-4
        else:
            # at the minimum the loss pulls each weight off zero no harder than the penalty holds it
            assert np.abs(gradient[w != 0] + strength * np.sign(w[w != 0])).max(initial=0) < 1e-2
            assert np.abs(gradient).max() <= strength + 1e-2
    assert not fits.weights[8].any()


def test_intercept_bears_no_penalty(rows, folds):
    y = np.array([r[4] for r in rows])
    fits = shared.LogisticFits(folds, FOLDS, [(1, "l2", 5.0, False), (1, "l1", 8.0, False)], intercept=True)
    x, seen = design(rows, 1)
    x, t = np.column_stack([np.ones(seen.sum()), x[seen]]), y[seen]
    for w, penalty in zip(fits.weights, (5.0, 8.0)):
        gradient = x.T @ (1 / (1 + np.exp(-(x @ w))) - t)
        assert abs(gradient[0]) < 1e-2
        assert np.abs(gradient[1:] + 5.0 * w[1:]).max() < 1e-4 if penalty == 5.0 else np.abs(gradient).max() <= 8.01


def test_folds_together_are_folds_one_by_one(df):
    fold = F.col("id") % FOLDS
    for options in ({"fitIntercept": False, "C": 0.5}, {"classWeight": "balanced"}, {"alpha": 0.01, "penalty": "l1"}):
        estimator = Pipeline(stages=[prep.prep_linear(NUMERIC, CATEGORIC), models.SkLogistic(**options)])
        together = shared.leave_one_out(df, estimator, FOLDS, fold, ["id"], whole=True)
        for k, model in enumerate(together):
            single = estimator.fit(df.filter(fold != k) if k < FOLDS else df)
            p = models.positive_probability()
            got, want = ([r["p"] for r in m.transform(df).select("id", p.alias("p")).orderBy("id").collect()] for m in (model, single))
            assert got == pytest.approx(want, abs=2e-3)


def test_several_scans_when_candidates_are_many(folds, monkeypatch):
    candidates = [(f, "l2", s, False) for f in range(FOLDS) for s in (0.1, 1.0, 10.0)]
    at_once = shared.LogisticFits(folds, FOLDS, candidates).weights
    monkeypatch.setattr(shared, "NUMBERS", 70)
    again = shared.LogisticFits(folds, FOLDS, candidates).weights
    assert all(np.allclose(a, b, atol=1e-8) for a, b in zip(at_once, again))


def test_scores_of_models(spark):
    rng = np.random.default_rng(1)
    rows = [(int(m), float(rng.integers(0, 2)), float(rng.integers(0, 30) / 30)) for m in range(4) for _ in range(100)]
    scored = spark.createDataFrame(rows, "model int, label double, p double")
    for m in range(4):
        y, p = np.array([(b, c) for a, b, c in rows if a == m]).T
        pairs = p[y == 1][:, None] - p[y == 0][None, :]
        assert shared.auc_scores(scored)[m] == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean())
        assert shared.brier_scores(scored)[m] == pytest.approx(((p - y) ** 2).mean())


def test_logistic_search(rows, df):
    found = search.logreg_search(NUMERIC, CATEGORIC, n_iter=30, folds=FOLDS, scoring="brier", key=("id",), fold=f"id % {FOLDS}")
    fitted = found.fit(df)
    assert len(fitted.avgMetrics) == 30 == found.table(fitted).count()
    best = min(range(30), key=lambda i: fitted.avgMetrics[i])
    errors = []
    for f in range(FOLDS):
        part = df.filter(f"id % {FOLDS} <> {f}")
        model = Pipeline(stages=[found.prep(), models.SkLogistic(fitIntercept=False, **found.draws[best])]).fit(part)
        scored = model.transform(df.filter(f"id % {FOLDS} = {f}"))
        errors.append(scored.agg(F.avg((models.positive_probability() - F.col("label")) ** 2)).first()[0])
    assert fitted.avgMetrics[best] == pytest.approx(np.mean(errors), abs=1e-6)
    with pytest.raises(ValueError):
        search.logreg_search(NUMERIC, CATEGORIC, scoring="rmse")


def test_least_squares_search(rows, df):
    target = df.drop("label").withColumnRenamed("value", "label")
    found = search.linear_regression_search(NUMERIC, CATEGORIC, n_iter=100, folds=FOLDS, key=("id",), fold=f"id % {FOLDS}")
    fitted = found.fit(target)
    y = np.array([r[5] for r in rows])
    for draw, got in zip(found.draws, fitted.avgMetrics):
        errors = []
        for f in range(FOLDS):
            x, seen = design(rows, f)
            z = np.column_stack([np.ones(len(x)), x])
            a, b = z[seen].T @ z[seen] / seen.sum(), z[seen].T @ y[seen] / seen.sum()
            if draw["penalty"] == "l2":
                w = np.linalg.lstsq(a + draw["alpha"] * np.diag([0, 1, 1, 1, 1, 1]), b, rcond=None)[0]
            else:
                w = np.zeros(6)
                for _ in range(3000):  # proximal steps
                    w = w - (a @ w - b) / np.linalg.eigvalsh(a)[-1]
                    w[1:] = np.sign(w[1:]) * np.maximum(np.abs(w[1:]) - draw["alpha"] / np.linalg.eigvalsh(a)[-1], 0)
            errors.append(np.sqrt(((z @ w - y)[~seen] ** 2).mean()))
        assert got == pytest.approx(np.mean(errors), abs=1e-4)
    best = fitted.bestModel.transform(target)
    assert best.agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0] ** 0.5 < min(fitted.avgMetrics) * 1.1


# --- boosted trees ----------------------------------------------------------------------


def plain_trees(x, y, s, trees, logistic):
    """Scores of all rows by trees over every distinct value."""
    z = np.full(len(y), np.log(s.base_score / (1 - s.base_score)) if logistic else s.base_score)

    def soft(g):
        return np.sign(g) * max(abs(g) - s.reg_alpha, 0.0)

    def part(g, h):
        return soft(g) ** 2 / (h + s.reg_lambda)

    def grow(rows, g, h, depth, out):
        out[rows] = -s.learning_rate * soft(g[rows].sum()) / (h[rows].sum() + s.reg_lambda)
        if depth == s.max_depth:
            return
        best = (max(s.gamma, 1e-12), None)
        for j in range(x.shape[1]):
            for limit in np.unique(x[:, j])[1:]:
                left, right = rows[x[rows, j] < limit], rows[x[rows, j] >= limit]
                if min(h[left].sum(), h[right].sum()) < s.min_child_weight:
                    continue
                gain = (part(g[left].sum(), h[left].sum()) + part(g[right].sum(), h[right].sum()) - part(g[rows].sum(), h[rows].sum())) / 2
                if gain > best[0] + 1e-9:
                    best = (gain, (left, right))
        if best[1]:
            for side in best[1]:
                grow(side, g, h, depth + 1, out)

    for _ in range(trees):
        if logistic:
            p = 1 / (1 + np.exp(-z))
            w = np.where(y == 1, s.scale_pos_weight, 1.0)
            g, h = w * (p - y), w * p * (1 - p)
        else:
            g, h = z - y, np.ones(len(y))
        out = np.zeros(len(y))
        grow(np.arange(len(y)), g, h, 0, out)
        z = z + out
    return z


@pytest.fixture(scope="module")
def few_values(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] * (x[:, 2] > 4))))).astype(float)
    rows = spark.createDataFrame(
        [(float(t), int(i % 3), int(i * 7919), *[[float(v) for v in r]] * 3) for i, (r, t) in enumerate(zip(x, y))],
        "label double, fold int, h long, x0 array<double>, x1 array<double>, x2 array<double>",
    )
    return materialize(rows.repartition(4), "few"), x, y


def test_trees_are_those_of_plain_python(few_values, monkeypatch):
    rows, x, y = few_values
    settings = [
        boosting.Settings(max_depth=3, min_child_weight=2, gamma=0.1, reg_alpha=0.3, reg_lambda=2.0, base_score=0.3, scale_pos_weight=3.0),
        boosting.Settings(max_depth=1, reg_lambda=0.5, learning_rate=0.3),
        boosting.Settings(max_depth=5, min_child_weight=0.5, reg_lambda=1.5),
    ]
    candidates = [(f, s) for s in settings for f in range(3)]
    monkeypatch.setattr(boosting, "RENEW", 2)
    monkeypatch.setattr(boosting, "CELLS", 2000)
    fitted = boosting.Boosting(rows, 3, candidates, 3)
    fold = np.arange(len(y)) % 3
    for i, (f, s) in enumerate(candidates):
        seen = fold != f
        want = plain_trees(x[seen], y[seen], s, 3, True)
        assert boosting.evaluate(fitted.export(i), x[seen]) == pytest.approx(want, abs=1e-9)
    got = fitted.scores().groupBy("model").agg(F.sum("p").alias("p"), F.count("*").alias("n")).collect()
    for r in got:
        own = x[fold == candidates[r["model"]][0]]
        assert r["n"] == len(own)
        assert r["p"] == pytest.approx((1 / (1 + np.exp(-boosting.evaluate(fitted.export(r["model"]), own)))).sum())


def test_regression_trees(few_values):
    rows, x, y = few_values
    s = boosting.Settings(max_depth=3, reg_lambda=0.0, base_score=0.7, learning_rate=0.5)
    fitted = boosting.Boosting(rows, 3, [(1, s)], 4, logistic=False)
    seen = np.arange(len(y)) % 3 != 1
    assert boosting.evaluate(fitted.export(0), x[seen]) == pytest.approx(plain_trees(x[seen], y[seen], s, 4, False), abs=1e-9)


def test_samples_of_rows_and_columns(few_values):
    rows, x, y = few_values
    s = boosting.Settings(max_depth=2, colsample_bytree=0.34)
    one = boosting.Boosting(rows, 3, [(0, s)], 6).export(0)
    used = [{f for f in t["feature"] if f >= 0} for t in one["trees"]]
    assert all(len(u) == 1 for u in used) and len(set.union(*used)) > 1
    by_level = boosting.Boosting(rows, 3, [(0, boosting.Settings(max_depth=2, colsample_bylevel=0.34))], 6).export(0)
    assert all(len({t["feature"][i] for i in (1, 2) if len(t["feature"]) > 2 and t["feature"][i] >= 0}) <= 1 for t in by_level["trees"])
    half = boosting.Settings(max_depth=2, subsample=0.5)
    a, b = boosting.Boosting(rows, 3, [(0, half)], 2).export(0), boosting.Boosting(rows.repartition(1), 3, [(0, half)], 2).export(0)
    assert a["trees"][0]["feature"] == b["trees"][0]["feature"]
    assert a["trees"][0]["value"] == pytest.approx(b["trees"][0]["value"])
    assert a["trees"][0]["value"] != boosting.Boosting(rows, 3, [(0, boosting.Settings(max_depth=2))], 1).export(0)["trees"][0]["value"]


def test_rows_of_equal_bins_are_summed_for_all_trees_at_once(few_values, monkeypatch):
    rows, x, y = few_values
    settings = [
        # nodes of many rows, as equally good splits of few rows differ for rows that are not drawn
        boosting.Settings(max_depth=3, min_child_weight=8, subsample=0.7, colsample_bytree=0.7, reg_alpha=0.2, scale_pos_weight=2.5, base_score=0.4),
        boosting.Settings(max_depth=6, colsample_bylevel=0.7, gamma=0.05),
    ]
    candidates = [(f, s) for s in settings for f in range(3)]
    for logistic in (True, False):
        with monkeypatch.context() as m:
            m.setattr(boosting, "CELLS", 2000)
            m.setattr(boosting.Boosting, "_scan", lambda *a: pytest.fail("a scan for a level of a tree"))
            summed = boosting.Boosting(rows, 3, candidates, 5, logistic)
        with monkeypatch.context() as m:
            m.setattr(boosting, "GROUPS", 10)
            m.setattr(boosting, "RENEW", 2)
            by_rows = boosting.Boosting(rows, 3, candidates, 5, logistic)
        assert by_rows.groups is None and len(summed.groups[0]) <= len(rows.select("x0").distinct().collect())
        for i, (f, _) in enumerate(candidates):
            seen = x[np.arange(len(y)) % 3 != f]
            assert boosting.evaluate(summed.export(i), seen) == pytest.approx(boosting.evaluate(by_rows.export(i), seen), abs=1e-9)
        got = {r["model"]: r["p"] for r in summed.scores().groupBy("model").agg(F.sum("p").alias("p")).collect()}
        for i, (f, _) in enumerate(candidates):
            z = boosting.evaluate(summed.export(i), x[np.arange(len(y)) % 3 == f])
            assert got[i] == pytest.approx((1 / (1 + np.exp(-z)) if logistic else z).sum())


@pytest.mark.parametrize("kind", ["boosted", "mlp"])
def test_searches_keep_the_best_and_store_it(spark, df, kind):
    options = {"trees": 4} if kind == "boosted" else {"epochs": 6}
    make = {"boosted": search.boosted_search, "mlp": search.mlp_search}[kind]
    found = make(NUMERIC, CATEGORIC, n_iter=3, folds=2, scoring="roc_auc", key=("id",), **options)
    fitted = found.fit(df)
    assert len(fitted.avgMetrics) == 3 and max(fitted.avgMetrics) > 0.7
    path = scratch_path(spark, "best")
    fitted.bestModel.write().overwrite().save(path)
    p = models.positive_probability().alias("p")
    first = {r["id"]: r["p"] for r in fitted.bestModel.transform(df).select("id", p).collect()}
    again = {r["id"]: r["p"] for r in PipelineModel.load(path).transform(df).select("id", p).collect()}
    assert first == pytest.approx(again) and len(set(first.values())) > 3


def test_rows_of_a_search_are_computed_once(spark, df):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = search.boosted_search(NUMERIC, CATEGORIC, n_iter=2, folds=2, trees=2, key=("id",))
    found.fit(df.mapInArrow(counted, df.schema))
    assert seen.value == df.count()


# --- perceptrons ------------------------------------------------------------------------


@pytest.mark.parametrize("activation", ["logistic", "tanh", "relu"])
@pytest.mark.parametrize("logistic", [True, False])
def test_gradient_is_that_of_finite_differences(activation, logistic):
    rng = np.random.default_rng(5)
    x, y, hidden = rng.normal(size=(11, 4)), rng.integers(0, 2, 11).astype(float), (5, 3)
    layout = neural.Layout(hidden=hidden, activation=activation)
    flat = np.stack([neural.first_weights(4, layout, np.random.default_rng(i)) for i in range(2)])
    alpha = np.array([0.3, 0.0])
    _, gradient = neural.loss_and_gradient(flat, x, y, hidden, activation, alpha, logistic)
    for m in range(2):
        for i in range(flat.shape[1]):
            step = np.zeros_like(flat)
            step[m, i] = 1e-6
            high, low = (neural.loss_and_gradient(flat + d, x, y, hidden, activation, alpha, logistic)[0][m] for d in (step, -step))
            assert gradient[m, i] == pytest.approx((high - low) / 2e-6, abs=1e-6)


def test_networks_learn_what_no_line_can_and_bear_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(neural, "SLICE", 200)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    rows = spark.createDataFrame(
        [(float(t), int(i % 2), int(i * 104729), *[[float(v) for v in r]] * 2) for i, (r, t) in enumerate(zip(x, y))],
        "label double, fold int, h long, x0 array<double>, x1 array<double>",
    )
    layouts = [neural.Layout(hidden=(12, 12), activation=a, batch_size=32, schedule="adaptive") for a in ("tanh", "relu")]
    candidates = [(f, m) for m in layouts for f in (0, 1)]
    nets = neural.Networks(materialize(rows.repartition(5), "xor"), 2, candidates, 25)
    assert all(s > 0.9 for s in shared.auc_scores(nets.scores()).values())
    one = neural.Networks(materialize(rows.repartition(1), "xor"), 2, candidates[:1], 3).weights[0]
    other = neural.Networks(materialize(rows.repartition(7), "xor"), 2, candidates[:1], 3).weights[0]
    assert one == pytest.approx(other, abs=1e-9)


@pytest.mark.parametrize("logistic", [True, False])
def test_slices_side_by_side_are_trained_as_one_by_one(spark, monkeypatch, logistic):
    monkeypatch.setattr(neural, "SLICE", 40)
    monkeypatch.setattr(neural, "SIDE", 100)
    rng = np.random.default_rng(10)
    x, fold, h = rng.normal(size=(330, 3)), rng.integers(0, 2, 330), np.arange(330) * 104729
    y = (x[:, 0] > x[:, 1]).astype(float)
    rows = spark.createDataFrame(
        [(float(t), int(f), int(n), *[[float(v) for v in r]] * 2) for r, t, f, n in zip(x, y, fold, h)],
        "label double, fold int, h long, x0 array<double>, x1 array<double>",
    )
    layouts = [neural.Layout((5,), "relu", 16, 0.1), neural.Layout((4, 3), "logistic", 32, 0.3), neural.Layout((20,), "tanh", 512, 0.0)]
    candidates = [(f, m) for m in layouts for f in (0, 1)]
    nets = neural.Networks(materialize(rows.repartition(3), "sliced"), 2, candidates, 2, logistic)
    for i, (f, m) in enumerate(candidates):
        flat = neural.first_weights(3, m, np.random.default_rng([7, i]))[None]
        for epoch in range(2):
            total, seen = 0.0, 0
            for number in range(330 // 40 + 1):
                own = np.flatnonzero(h % (330 // 40 + 1) == number)
                own = own[np.random.default_rng([7, epoch, number]).permutation(len(own))]
                own, net, speed = own[fold[own] != f], flat, 0.0
                for at in range(0, len(own), m.batch_size):
                    batch = own[at : at + m.batch_size]
                    _, g = neural.loss_and_gradient(net, x[batch], y[batch], m.hidden, m.activation, np.array([m.alpha]), logistic)
                    speed = 0.9 * speed - m.step_size / max(np.sqrt((g**2).sum()), 1.0) * g
                    net = net + speed
                total, seen = total + net * len(own), seen + len(own)
            flat = total / seen
        assert nets.weights[i] == pytest.approx(flat[0], abs=1e-9)


def test_rows_that_fill_a_batch_up_do_not_count():
    rng = np.random.default_rng(11)
    flat, x, y, alpha = rng.normal(size=(3, 2, 21)), rng.normal(size=(3, 1, 8, 3)), rng.normal(size=(3, 1, 8)), np.array([0.2, 0.4])
    held = (np.arange(8) < np.array([8, 5, 1])[:, None]).astype(float)[:, None]
    loss, gradient = neural.loss_and_gradient(flat, x, y, (4,), "tanh", alpha, False, held)
    for s, n in enumerate((8, 5, 1)):
        one = neural.loss_and_gradient(flat[s], x[s, 0, :n], y[s, 0, :n], (4,), "tanh", alpha, False)
        assert loss[s] == pytest.approx(one[0]) and gradient[s] == pytest.approx(one[1])


def test_blocks_hold_whole_slices(monkeypatch):
    monkeypatch.setattr(neural, "BLOCK", 50)
    number = np.sort(np.random.default_rng(12).integers(0, 9, 200))
    x = np.arange(600.0).reshape(200, 3)
    names = ["slice", "x", "label", "fold"]
    whole = pa.RecordBatch.from_arrays([pa.array(number), shared.packed(x), pa.array(x[:, 0]), pa.array(number % 2)], names)
    found = list(neural._slices([whole.slice(at, 30) for at in range(0, 200, 30)], 3))
    assert len(found) > 2 and np.array_equal(np.concatenate([b[1] for b in found]), x)
    assert all(a[0][-1] < b[0][0] for a, b in zip(found, found[1:]))


def test_adaptive_steps_shrink_when_the_loss_stays(spark):
    rows = spark.createDataFrame([(0.5, i % 2, i, [0.0], [0.0]) for i in range(40)], "label double, fold int, h long, x0 array<double>, x1 array<double>")
    layouts = [neural.Layout(hidden=(2,), schedule=s, step_size=1.0) for s in ("adaptive", "constant")]
    nets = neural.Networks(materialize(rows, "flat"), 2, [(0, m) for m in layouts], 25)
    assert nets.steps[0] < 0.3 and nets.steps[1] == 1.0
