import numpy as np
import pytest
from pyspark.sql import functions as F

from shotspark.operators import metrics as m


def scored(spark, pairs):
    return spark.createDataFrame([(float(p), int(y)) for p, y in pairs], "p double, y int")


@pytest.mark.parametrize("p, y, expected", [(0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.0), (0, 0, 0.0)])
def test_ece_all_wrong_or_right(spark, p, y, expected):
    assert m.ece(scored(spark, [(p, y)] * 10), 90).first()[0] == pytest.approx(expected)


def test_ece_ordering(spark):
    rng = np.random.default_rng(1)
    p = np.repeat(np.linspace(0, 1, 100), 30)
    y = rng.random(len(p)) < p
    good = m.ece(scored(spark, zip(p, y))).first()[0]
    bad = m.ece(scored(spark, zip(p / 2, y))).first()[0]
    assert 0 < good < bad < 1


def test_against_numpy(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    df = scored(spark, zip(p, y))
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert m.roc_auc(df).first()[0] == pytest.approx(auc)
    assert m.brier(df).first()[0] == pytest.approx(np.mean((p - y) ** 2))
    edges = np.percentile(p, np.linspace(0, 100, 11))
    edges[-1] += 1e-8
    ace = 0.0
    for low, high in zip(edges, edges[1:]):
        inside = (p >= low) & (p < high)
        if inside.any():
            acc = np.mean((p[inside] >= 0.5) == (y[inside] == 1))
            ace += inside.sum() * abs(acc - np.mean(np.maximum(p[inside], 1 - p[inside]))) / len(p)
    assert m.ece(df, 10, "quantile").first()[0] == pytest.approx(ace)
    grid = np.arange(1, 100) / 100
    k = np.exp(-0.5 * ((p[:, None] - grid) * 100) ** 2)
    k_pos, k_all = k[y == 1].sum(0), k.sum(0)
    predicted = 100 * (k_pos * y.sum() / k_pos.sum()) / (k_all * len(p) / k_all.sum())
    curve = m.kde_curve(df).orderBy("sample").collect()
    assert [r.predicted for r in curve] == pytest.approx(list(predicted))
    area = np.trapezoid(np.abs(predicted - 100 * grid), 100 * grid)
    scalars, kept = m.validate_scores(df)
    assert scalars["residual_area"] == pytest.approx(area) and kept.count() == 99
    assert scalars["max_dev"] == pytest.approx(np.max(np.abs(predicted - 100 * grid)))
    assert set(scalars) == {"max_dev", "residual_area", "roc", "brier", "ece", "ace"}


def test_histogram_closes_the_last_bin(spark):
    rows = {r.bin: r.density for r in m.score_histogram(scored(spark, [(1.0, 1), (0.999, 1), (0.0, 0), (0.5, 0)])).collect()}
    assert len(rows) == 100 and rows[99] == 0.5 and rows[0] == rows[50] == 0.25


def test_curve_without_rows_nearby_is_zero(spark):
    curve = {r.sample: r.predicted for r in m.kde_curve(scored(spark, [(0.0, 0), (0.0, 1)])).collect()}
    assert curve[99.0] == 0.0


def test_checks(spark):
    with pytest.raises(ValueError):
        m.check_scored(scored(spark, [(1.2, 1), (0.1, 0)]))
    with pytest.raises(ValueError):
        m.check_scored(scored(spark, [(0.2, 1), (0.1, 0), (0.1, 2)]))
    with pytest.raises(ValueError):
        m.check_scored(scored(spark, [(0.2, 1)]), both_labels=True)
    with pytest.raises(ValueError):
        m.check_scored(scored(spark, [(0.2, 1), (float("nan"), 0)]))
    with pytest.raises(ValueError):
        m.ece(scored(spark, [(0.2, 1)]), 5, "other")
    with pytest.raises(ValueError):
        m.calibration_curve(scored(spark, [(1.2, 1), (0.1, 0)]))
    assert m.calibration_curve(scored(spark, [(1.2, 1), (0.1, 0)]), normalize=True).count() == 5


def test_mask(spark):
    curve = spark.createDataFrame([(1.0, 5.0, 10.0), (2.0, 9.0, 1.0), (3.0, 3.5, 10.0)], "sample double, predicted double, n_smoothed double")
    masked = m.mask_curve(curve, 5)
    assert masked.filter(F.col("predicted").isNull()).count() == 1
    assert m.max_deviation(masked).first()[0] == 4.0


@pytest.mark.parametrize("rows", [[(None, 1)], [(float("nan"), 1)], [(1.7, 1)], [(-0.1, 0)], [(0.5, None)], [(0.1, 0), (0.2, 1), (0.3, 2)]])
@pytest.mark.parametrize("metric", [m.ece, lambda d: m.ece(d, strategy="quantile"), m.brier, lambda d: m.reliability(d, [0, 1])])
def test_bad_scores_raise(spark, metric, rows):
    df = spark.createDataFrame([(0.2, 0), (0.9, 1), *rows], "p double, y int")
    with pytest.raises(ValueError):
        metric(df).collect()
