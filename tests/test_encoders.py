import numpy as np
import pytest
from pyspark.sql import functions as F

from shotspark.operators import encoders as e
from shotspark.plans import prep


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, v {kind}")


def codes(df, name="v"):
    return [r[name] for r in df.orderBy("id").collect()]


def test_ordinal(spark):
    train = column(spark, ["a"] * 3 + ["b"] * 5 + ["c"] + [None])
    test = column(spark, ["a", "b", "c", None, "d"])
    fitted = e.OrdinalEncoder(2).fit(train, "v")
    assert codes(fitted.transform(test)) == [1, 0, -1, -2, -3]
    with pytest.raises(ValueError):
        fitted.transform(test.union(test), key=["id"])


def test_missing_takes_a_rank(spark):
    fitted = e.OrdinalEncoder(1).fit(column(spark, [None] * 4 + ["a"]), "v")
    assert codes(fitted.transform(column(spark, ["a"]))) == [1]


def test_count_frequency(spark):
    train = column(spark, ["a"] * 6 + ["b"] * 2 + ["c"] + [None] * 7)
    test = column(spark, ["a", "b", "z", None])
    assert codes(e.CountFrequencyEncoder(5).fit(train, "v").transform(test)) == [6, 3, 3, 3]
    assert codes(e.CountFrequencyEncoder(5, count_na=True).fit(train, "v").transform(test)) == [6, 3, 3, 7]


def test_tolerant_labels_and_back(spark):
    train = column(spark, ["a"] * 3 + ["b"] * 4 + ["c"] * 2)
    fitted = e.TolerantLabelEncoder(2).fit(train, "v")
    coded = fitted.transform(column(spark, ["a", "b", "c", "x"]), "code")
    assert codes(coded, "code") == [2, 1, 0, 0]
    assert codes(fitted.inverse_transform(coded, "code", "back"), "back") == ["a", "b", None, None]


def test_insertion_position(spark):
    fitted = e.TolerantLE().fit(column(spark, ["b", "d", "d", "f"]), "v")
    assert codes(fitted.transform(column(spark, ["a", "b", "c", "f", "g"]))) == list(np.searchsorted(["b", "d", "f"], list("abcfg")))


def test_unique_counts(spark):
    df = spark.createDataFrame([(i, i % 2, None if i % 3 else 1, 7) for i in range(12)], "a int, b int, c int, d int")
    assert e.unique_count_select(df, ["a", "b", "c", "d"], 2, 3) == ["b", "c"]
    assert e.unique_count_select(df, ["a", "b", "c", "d"], 1, 1) == ["b", "c", "d"]  # upper + 1 counts


def test_numbers(spark):
    df = column(spark, [1.0, 2.0, None, 6.0], "double")
    filled = e.ImputeMean().fit(df, ["v"]).transform(df)
    assert codes(filled) == [1, 2, 3, 6]
    values = np.array([1, 2, 3, 6.0])
    assert codes(e.StandardScale().fit(filled, ["v"]).transform(filled)) == pytest.approx(list((values - 3) / values.std()))
    assert codes(e.Logify().fit(filled, "v").transform(filled)) == pytest.approx(list(np.log10(values - 1 + 2)))
    assert codes(e.fill_missing(column(spark, [1.0, float("nan"), None], "double"), ["v"], 9.0)) == [1, 9, 9]
    assert codes(e.to_1d(spark.createDataFrame([([1, 2],)], "v array<int>"), "v").withColumn("id", F.col("value")), "value") == [1, 2]


def test_boxcox_likelihood(spark):
    x = np.exp(np.random.default_rng(4).normal(size=400))
    fitted = e.BoxCox().fit(column(spark, [float(v) for v in x], "double"), "v")
    s = (x - x.min()) / (x.max() - x.min()) + 1e-4

    def likelihood(k):
        y = np.log(s) if k == 0 else (s**k - 1) / k
        return (k - 1) * np.log(s).sum() - len(s) / 2 * np.log(y.var())

    grid = np.linspace(-2, 2, 4001)
    assert fitted.lmbda == pytest.approx(grid[np.argmax([likelihood(k) for k in grid])], abs=2e-3)


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(f"r{i}", f"c{j}", float(rng.integers(1, 50))) for i in range(8) for j in range(5) for _ in range(3)]
    df = spark.createDataFrame(rows, "r string, c string, v double")
    fitted = e.SVDEmbedding("r", "c", "v", k=3, min_count=2).fit(df)
    pairs = fitted.pairs(df).collect()
    dense = np.zeros((9, 6))
    for p in pairs:
        dense[p["row"], p["col"]] = p["value"]
    u, s, _ = np.linalg.svd(dense)
    assert fitted.singular_values == pytest.approx(list(s[:3]))
    table = {r.code: r.embedding for r in fitted.embedding.collect()}
    for code, vector in table.items():
        assert np.abs(vector) == pytest.approx(np.abs(u[code, :3] * s[:3]), abs=1e-6)
    # without a value column, the cells are counts; an unseen value has no row
    counts = e.SVDEmbedding("r", "c", k=2, min_count=2)
    assert {r["value"] for r in counts.pairs(df).collect()} == {3.0}
    unseen = fitted.transform(spark.createDataFrame([("zzz",)], "r string")).first()
    assert unseen.embedding == [0.0, 0.0, 0.0]


def vectors(df):
    return [list(r["features"].toArray()) for r in df.orderBy("id").collect()]


def test_prep_linear(spark):
    train = spark.createDataFrame([(0, "a", 1.0), (1, "b", 3.0), (2, None, None)], "id int, c string, x double")
    test = spark.createDataFrame([(0, "b", 1.0), (1, "q", None), (2, None, 3.0)], "id int, c string, x double")
    model = prep.prep_linear(["x"], ["c"]).fit(train)
    std = np.array([1, 3, 2.0]).std()
    assert vectors(model.transform(test)) == [
        pytest.approx([0, 1, 0, -1 / std]), pytest.approx([0, 0, 0, 0]), pytest.approx([0, 0, 1, 1 / std]),
    ]


def test_prep_tree(spark):
    train = spark.createDataFrame([(i, "a" if i < 6 else "b", float(i)) for i in range(8)], "id int, c string, x double")
    test = spark.createDataFrame([(0, "a", 3.5), (1, "b", 3.5), (2, "z", 3.5), (3, None, 3.5)], "id int, c string, x double")
    model = prep.prep_tree(["x"], ["c"]).fit(train)
    assert [v[0] for v in vectors(model.transform(test))] == [0, -1, -3, -2]
    with pytest.raises(ValueError):
        prep.prep_tree([], [])


def test_stacked_rows_are_scored_by_other_folds(spark):
    class Mean:
        """Predicts the label mean of its training rows."""

        def fit(self, df):
            self.value = df.agg(F.avg("label")).first()[0]
            return Fitted(self.value)

    class Fitted:
        def __init__(self, value):
            self.value = value

        def transform(self, df):
            return df.withColumn("p", F.lit(self.value))

    df = spark.createDataFrame([(i, float(i)) for i in range(40)], "id int, label double")
    stacked = e.StackedModel(Mean(), ["id"], 4)
    out = stacked.fit_transform(df).withColumn("fold", e.fold_of(["id"], 4)).toPandas()
    for fold, part in out.groupby("fold"):
        assert part["p"].iloc[0] == pytest.approx(out[out["fold"] != fold]["label"].mean())
    assert stacked.transform(df).first()["p"] == pytest.approx(19.5)


def test_one_hot_refuses_a_column_per_row(spark):
    df = spark.range(50).selectExpr("cast(id as string) as v")
    with pytest.raises(ValueError, match="more than 20"):
        e.OneHot(max_values=20).fit(df, "v")


def test_svd_of_a_larger_matrix(spark):
    rng = np.random.default_rng(8)
    dense = rng.normal(size=(60, 25)) @ np.diag(0.8 ** np.arange(25)) @ rng.normal(size=(25, 25))
    cells = [(f"r{i:02d}", f"c{j:02d}", float(v)) for (i, j), v in np.ndenumerate(dense)]
    df = spark.createDataFrame(cells, "r string, c string, v double")
    fitted = e.SVDEmbedding("r", "c", "v", k=4, min_count=2).fit(df)
    u, s, _ = np.linalg.svd(dense)
    assert fitted.singular_values == pytest.approx(s[:4], rel=1e-6)
    got = {r.r: r.embedding for r in fitted.transform(df.select("r").distinct()).collect()}
    points = np.array([got[f"r{i:02d}"] for i in range(60)])
    want = u[:, :4] * s[:4]
    assert points @ points.T == pytest.approx(want @ want.T, rel=1e-5, abs=1e-5)  # free of signs


def test_ordinal_codes_of_a_model_are_limited(spark):
    df = spark.range(50).selectExpr("cast(id as string) as v")
    with pytest.raises(ValueError, match="more than 20"):
        prep.OrdinalCodes(["v"], max_levels=20).fit(df)
