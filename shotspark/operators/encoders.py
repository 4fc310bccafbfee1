"""Encoders and preprocessing. ``fit`` is an aggregate, ``transform`` an expression or a join.

Fitted value tables are written once and counted, so that joins against them are broadcast
only when the optimizer knows them to be small.
"""

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotspark.scale import materialize, number_all, prefix_sums


def select_columns(df: DataFrame, columns) -> DataFrame:
    return df.select(*columns)


def as_string(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def fill_missing(df: DataFrame, columns, value) -> DataFrame:
    """Replace NULL, and NaN in floating columns."""
    types = dict(df.dtypes)

    def filled(c):
        present = F.nanvl(F.col(c), F.lit(None)) if types[c] in ("double", "float") else F.col(c)
        return F.coalesce(present, F.lit(value))

    return df.withColumns({c: filled(c) for c in columns})


def to_1d(df: DataFrame, column: str) -> DataFrame:
    """One column as a flat column of values; arrays are taken apart in order."""
    if dict(df.dtypes)[column].startswith("array"):
        return df.select(F.explode(column).alias("value"))
    return df.select(F.col(column).alias("value"))


def melted(df: DataFrame, columns) -> DataFrame:
    """(column, value) rows of several columns, values as strings."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (column, value)")


def unique_count_select(df: DataFrame, columns, lower: int, upper: int) -> list[str]:
    """Columns with lower <= number of distinct values <= upper + 1; missing counts as a value."""
    distinct = melted(df, columns).groupBy("column", "value").agg(F.lit(1).alias("one"))
    counts = {r["column"]: r["n"] for r in distinct.groupBy("column").agg(F.count("*").alias("n")).collect()}
    return [c for c in columns if lower <= counts.get(c, 0) <= upper + 1]


class ColumnApplier:
    """One independent fit per column of an encoder for one column."""

    def __init__(self, make_encoder):
        self.make_encoder = make_encoder

    def fit(self, df: DataFrame, columns) -> "ColumnApplier":
        self.stages = {c: self.make_encoder().fit(df, c) for c in columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages.values():
            df = stage.transform(df)
        return df


# --- categories -------------------------------------------------------------------------


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def _ranked(counts: DataFrame) -> tuple[DataFrame, int]:
    """Value counts with the 0-based ``rank`` by falling frequency, then value; and their number."""
    counts = materialize(counts.withColumn("_minus_n", -F.col("n")), "values")
    rows = counts.count()
    return number_all(counts, ["_minus_n", "value"], "rank").drop("_minus_n"), rows


@dataclass
class _ValueTable:
    """A fitted (value, code) table and what to do with values outside of it."""

    column: str
    table: DataFrame
    rows: int

    def _joined(self, df: DataFrame, key: Column | None = None) -> DataFrame:
        key = F.col(self.column) if key is None else key
        table = self.table.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        return df.join(table, key == F.col("_value"), "left")


class OrdinalEncoder:
    """Frequency rank 0, 1, ... of a value as string; rare -1, missing -2, not seen -3."""

    def __init__(self, min_support: int):
        self.min_support = min_support

    def fit(self, df: DataFrame, column: str) -> "OrdinalEncoder":
        # missing values take part in the ranking as 'nan'
        text = df.select(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value"))
        counts = text.groupBy("value").agg(F.count("*").alias("n"))
        ranked, rows = _ranked(counts)
        code = F.when(F.col("value") == "nan", -2).when(F.col("n") >= self.min_support, F.col("rank")).otherwise(-1)
        table = materialize(ranked.select("value", code.cast("int").alias("code")), "ordinal")
        self.fitted = _ValueTable(column, table, rows)
        return self

    def transform(self, df: DataFrame, key=None) -> DataFrame:
        """Codes in place of the column. With ``key``, duplicate row keys are an error."""
        if key is not None:
            check_unique(df, key)
        column = self.fitted.column
        joined = self.fitted._joined(df, F.col(column).cast("string"))
        missing = F.col(column).isNull() | (F.col(column).cast("string") == "nan")
        code = F.when(missing, -2).otherwise(F.coalesce("_code", F.lit(-3)))
        return joined.withColumn(column, code).drop("_value", "_code")


def check_unique(df: DataFrame, key) -> None:
    twice = df.groupBy(*key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate row key {tuple(twice[0][k] for k in key)}")


class CountFrequencyEncoder:
    """Training frequency of a value. Rare and unseen values get the total of the rare ones,
    missing values the same or, with ``count_na``, their own number."""

    def __init__(self, min_card: int = 5, count_na: bool = False):
        self.min_card, self.count_na = min_card, count_na

    def fit(self, df: DataFrame, column: str) -> "CountFrequencyEncoder":
        counts = materialize(value_counts(df, column), "counts")
        rare = F.col("value").isNotNull() & (F.col("n") < self.min_card)
        sums = counts.agg(
            F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("others"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("na"),
            F.count("*").alias("rows"),
        ).first()
        frequent = counts.filter(F.col("n") >= self.min_card).select("value", F.col("n").alias("code"))
        self.others, self.missing = sums["others"], sums["na"] if self.count_na else sums["others"]
        self.fitted = _ValueTable(column, frequent.filter("value is not null"), sums["rows"])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        column = self.fitted.column
        code = F.when(F.col(column).isNull(), F.lit(self.missing)).otherwise(F.coalesce("_code", F.lit(self.others)))
        return self.fitted._joined(df).withColumn(column, code.cast("long")).drop("_value", "_code")


class TolerantLabelEncoder:
    """1 + frequency rank of values with more than ``min_count`` rows, 0 for all others."""

    def __init__(self, min_count: int = 10):
        self.min_count = min_count

    def fit(self, df: DataFrame, column: str) -> "TolerantLabelEncoder":
        counts = value_counts(df.filter(F.col(column).isNotNull()), column)
        ranked, rows = _ranked(counts.filter(F.col("n") > self.min_count))
        table = materialize(ranked.select("value", (F.col("rank") + 1).cast("int").alias("code")), "labels")
        self.fitted = _ValueTable(column, table, rows)
        return self

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        code = F.coalesce("_code", F.lit(0))
        return self.fitted._joined(df).withColumn(output or self.fitted.column, code).drop("_value", "_code")

    def inverse_transform(self, df: DataFrame, code: str, output: str) -> DataFrame:
        """Value of a code; 0 becomes missing."""
        table = self.fitted.table.select(F.col("value").alias(output), F.col("code").alias("_code"))
        return df.join(table, F.col(code) == F.col("_code"), "left").drop("_code")


class TolerantLE:
    """Position of a value in the sorted classes; an unseen value gets its insertion position."""

    def fit(self, df: DataFrame, column: str) -> "TolerantLE":
        self.column = column
        classes = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
        self.classes = materialize(classes, "classes")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        column = self.column
        values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
        marked = (
            self.classes.withColumn("known", F.lit(1))
            .unionByName(values.withColumn("known", F.lit(0)))
            .groupBy("value")
            .agg(F.max("known").cast("long").alias("known"))
        )
        codes = materialize(prefix_sums(marked, ["value"], {"code": "known"}).select("value", "code"), "codes")
        table = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        joined = df.join(table, F.col(column) == F.col("_value"), "left")
        return joined.withColumn(column, F.col("_code")).drop("_value", "_code")


class OneHot:
    """Indicator column per value seen, for values as strings; all zeros for an unseen value. One
    output column per value is the feature, so more than ``max_values`` of them are an error."""

    def __init__(self, max_values: int = 1_000):
        self.max_values = max_values

    def fit(self, df: DataFrame, column: str) -> "OneHot":
        self.column = column
        text = df.select(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value"))
        found = text.distinct().limit(self.max_values + 1).collect()
        if len(found) > self.max_values:
            raise ValueError(f"{column} has more than {self.max_values} values; encode it by rank or embedding instead")
        self.values = sorted(r["value"] for r in found)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(self.column).cast("string"), F.lit("nan"))
        return df.withColumns(
            {f"{self.column}_{i}": (text == v).cast("double") for i, v in enumerate(self.values, start=1)}
        ).drop(self.column)


# --- numbers ----------------------------------------------------------------------------


class ImputeMean:
    """Missing numbers become the training mean."""

    def fit(self, df: DataFrame, columns) -> "ImputeMean":
        self.means = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in columns]).first().asDict()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)) for c, m in self.means.items()}
        )


class StandardScale:
    """(x - mean) / population standard deviation; a constant column is only centred."""

    def fit(self, df: DataFrame, columns) -> "StandardScale":
        stats = [s for c in columns for s in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
        row = df.agg(*stats).first()
        self.stats = {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.stats.items()})


class Logify:
    """log10(x - training minimum + 2)."""

    def fit(self, df: DataFrame, column: str) -> "Logify":
        self.column, self.low = column, df.agg(F.min(column)).first()[0]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        # a value two or more below the training minimum has no logarithm
        shifted = F.col(self.column).cast("double") - F.lit(float(self.low)) + 2.0
        return df.withColumn(self.column, F.when(shifted > 0, F.log10(shifted)))


SMALL_POWER = 0.01  # exponents nearer to zero than that take series


def _moments(k: float, low: float, high: float) -> list[Column]:
    """u, d, u * u and u * d, where u is the transformed value up to a shift and a factor, and d its
    derivative by the exponent: the slope of log(variance) / 2 is cov(u, d) / var(u), less 1 / k for
    powers. Powers are scaled by the largest one, so no exponent overflows."""
    x = F.col("l")
    if abs(k) < SMALL_POWER:
        u = sum((x ** (j + 1) * (k**j / math.factorial(j + 1)) for j in range(10)), F.lit(0.0))
        d = sum((x ** (j + 2) * ((j + 1) * k**j / math.factorial(j + 2)) for j in range(10)), F.lit(0.0))
    else:
        u = F.exp(F.lit(k) * x - max(k * low, k * high))
        d = u * x
    return [u, d, u * u, u * d]


class BoxCox:
    """Min-max scaling to [0.0001, 1.0001] and the Box-Cox transformation, with the lambda of
    the largest profile likelihood unless one is given."""

    SHIFT = 1e-4

    def __init__(self, lmbda: float | None = None):
        self.lmbda = lmbda

    def fit(self, df: DataFrame, column: str) -> "BoxCox":
        self.column = column
        row = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
        self.low, self.width = float(row["low"]), float(row["high"] - row["low"]) or 1.0
        if self.lmbda is None:
            self.lmbda = self._search(df.select(self._scaled().alias("x")))
        return self

    def _scaled(self) -> Column:
        return F.greatest(F.lit(self.SHIFT), (F.col(self.column) - self.low) / self.width + self.SHIFT)

    @staticmethod
    def _power(x: Column, lmbda: float) -> Column:
        return F.log(x) if lmbda == 0 else (F.pow(x, F.lit(lmbda)) - 1.0) / F.lit(lmbda)

    def _search(self, scaled: DataFrame) -> float:
        """Root of the derivative of the profile likelihood. Equal values are counted first; a round is
        one aggregate over the distinct values. The bracket doubles until the derivative changes its
        sign, however far that is; then each round looks around the secant of the bracket."""
        counted = materialize(scaled.groupBy("x").agg(F.count("*").alias("n")).withColumn("l", F.log("x")), "scaled")
        head = counted.agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("l")).alias("logs"), F.min("l").alias("low"), F.max("l").alias("high")
        ).first()
        if not head["n"]:
            raise ValueError("there are no values to fit")
        if head["low"] == head["high"]:
            raise ValueError("a single value has no likeliest exponent")
        n, logs = head["n"], head["logs"]

        def slopes(grid):
            sums = [F.sum(F.col("n") * m).alias(f"m{i}_{j}") for i, k in enumerate(grid) for j, m in enumerate(_moments(k, head["low"], head["high"]))]
            row = counted.agg(*sums).first()
            out = []
            for i, k in enumerate(grid):
                u, d, uu, ud = (row[f"m{i}_{j}"] / n for j in range(4))
                # the likelihood is (k - 1) * logs - n / 2 * log(variance)
                out.append(logs - n * ((ud - u * d) / (uu - u * u) - (0.0 if abs(k) < SMALL_POWER else 1 / k)))
            return out

        reach = 2.0
        while True:
            low, high = -reach, reach
            at_low, at_high = slopes([low, high])
            if at_low >= 0 >= at_high:
                break
            reach *= 2
        while high - low > 1e-10 * max(1.0, abs(low), abs(high)):
            width, secant = high - low, low + (high - low) * at_low / (at_low - at_high or 1.0)
            near = [secant - width / 500, secant, secant + width / 500, low + width / 4, (low + high) / 2, high - width / 4]
            grid = sorted(g for g in {*near} if low < g < high)
            if not grid:
                break
            for g, slope in zip(grid, slopes(grid)):
                if slope >= 0:
                    low, at_low = g, slope
                else:
                    high, at_high = g, slope
                    break
        return (low + high) / 2

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, self._power(self._scaled(), self.lmbda))


class YToLog:
    """Fit a regressor on log(y + shift) and take its predictions back."""

    def __init__(self, estimator, shift: float = 0.0, label: str = "label", prediction: str = "prediction"):
        self.estimator, self.shift, self.label, self.prediction = estimator, shift, label, prediction

    def fit(self, df: DataFrame) -> "YToLog":
        self.model = self.estimator.fit(df.withColumn(self.label, F.log(F.col(self.label) + self.shift)))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        return out.withColumn(self.prediction, F.exp(F.col(self.prediction)) - self.shift)


# --- models as features -----------------------------------------------------------------


def fold_of(key, folds: int) -> Column:
    """Stable fold of a row from its key; needs no shuffle."""
    return F.pmod(F.xxhash64(*key), F.lit(folds)).cast("int")


class StackedModel:
    """Predictions of a model as a feature. Training rows get the prediction of a model that
    has not seen their fold, other rows that of a model fitted on all training rows."""

    def __init__(self, estimator, key, folds: int = 5, fold: str | None = None):
        """``fold`` is an SQL expression for the fold of a row; by default the key tells."""
        self.estimator, self.key, self.folds, self.fold = estimator, list(key), folds, fold

    def fit_transform(self, df: DataFrame) -> DataFrame:
        from shotspark.plans.shared import leave_one_out

        fold = F.expr(self.fold) if self.fold else fold_of(self.key, self.folds)
        df, out = materialize(df, "training"), None
        *models, self.model = leave_one_out(df, self.estimator, self.folds, fold, self.key, whole=True)
        for k, model in enumerate(models):
            part = model.transform(df.filter(fold == k))
            out = part if out is None else out.unionByName(part)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


OVERSAMPLING = 10  # further directions of the iteration, which make it converge sooner
RESIDUAL = 1e-7  # of the largest singular value, where the iteration has converged


class SVDEmbedding:
    """Embedding of the values of a row column: truncated SVD of the matrix of pair counts, or
    of pair means of a value column. Rare and unseen values share code 0."""

    def __init__(self, row: str, col: str, value: str | None = None, k: int = 10, min_count: int = 10):
        self.row, self.col, self.value, self.k = row, col, value, k
        self.rows, self.cols = TolerantLabelEncoder(min_count), TolerantLabelEncoder(min_count)

    def pairs(self, df: DataFrame) -> DataFrame:
        """(row, col, value) with one row per pair of codes."""
        coded = self.cols.fit(df, self.col).transform(self.rows.fit(df, self.row).transform(df, "_row"), "_col")
        cell = F.count("*").cast("double") if self.value is None else F.avg(self.value)
        return coded.groupBy(F.col("_row").alias("row"), F.col("_col").alias("col")).agg(cell.alias("value"))

    def fit(self, df: DataFrame) -> "SVDEmbedding":
        """Subspace iteration from a random start: the matrix is multiplied through joins and
        sums, and only products of its few columns (width x width numbers) reach the driver."""
        pairs = materialize(self.pairs(df).filter("value is not null"), "pairs")
        sizes = pairs.agg(F.count_distinct("row").alias("r"), F.count_distinct("col").alias("c")).first()
        least = min(sizes["r"], sizes["c"])
        k, width = min(self.k, least), min(self.k + OVERSAMPLING, least)

        def uniform(j):
            return F.shiftrightunsigned(F.xxhash64("col", F.lit(j)), 11) / float(1 << 52) - 1.0

        def product(side, other, basis):
            """Row sums of the matrix (or its transpose) times the basis at ``other``."""
            sums = [F.sum(F.col("value") * F.col(f"v{j}")).alias(f"v{j}") for j in range(basis)]
            return lambda table: materialize(pairs.join(table, other).groupBy(side).agg(*sums), "product")

        def turned(table, side, turn):
            """``table`` times a small matrix."""
            cells = [
                sum((F.col(f"v{i}") * float(turn[i, j]) for i in range(turn.shape[0])), F.lit(0.0)).alias(f"v{j}")
                for j in range(turn.shape[1])
            ]
            return table.select(side, *cells)

        def spectrum(table, basis):
            """Eigenvalues, largest first, and eigenvectors of the table's products of columns."""
            cells = [(i, j) for i in range(basis) for j in range(i, basis)]
            row = table.agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"g{i}_{j}") for i, j in cells]).first()
            gram = np.zeros((basis, basis))
            for i, j in cells:
                gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
            values, vectors = np.linalg.eigh(gram)
            values, vectors = values[::-1], vectors[:, ::-1]
            return values, vectors

        def kept(values):
            """Directions that are more than rounding errors."""
            return max(1, int((values > max(values[0], 0.0) * 1e-13).sum()))

        start = pairs.select("col").distinct().select("col", *[uniform(j).alias(f"v{j}") for j in range(width)])
        basis, table, first = width, materialize(start, "start"), True
        while True:
            rows = product("row", "col", basis)(table)
            values, vectors = spectrum(rows, basis)
            n = kept(values)
            scale = np.sqrt(np.maximum(values[:n], 1e-300))
            columns = product("col", "row", n)(turned(rows, "row", vectors[:, :n] / scale))
            lengths = columns.agg(*[F.sum(F.col(f"v{j}") * F.col(f"v{j}")).alias(f"s{j}") for j in range(n)]).first()
            # the matrix turns a pair's left vector into its value times the right one, but for this rest
            rest = np.sqrt(np.maximum(np.array([lengths[j] or 0.0 for j in range(n)]) - scale**2, 0.0))
            values, vectors = spectrum(columns, n)
            basis = kept(values)
            sigma = np.sqrt(np.maximum(values[:basis], 0.0))
            table = materialize(turned(columns, "col", vectors[:, :basis] / np.maximum(sigma, 1e-300)), "basis")
            # the start is not orthonormal, so the first rest says nothing
            if not first and rest[:k].max(initial=0.0) <= RESIDUAL * max(scale[0], 1e-300):
                break
            first = False
        k = min(k, basis)
        self.singular_values = [float(v) for v in sigma[:k]]
        out = product("row", "col", basis)(table)
        embedding = F.array(*[F.col(f"v{j}") for j in range(k)])
        self.embedding = materialize(out.select(F.col("row").cast("int").alias("code"), embedding.alias("embedding")), "embedding")
        return self

    def transform(self, df: DataFrame, output: str = "embedding") -> DataFrame:
        coded = self.rows.transform(df, "_code0")
        table = self.embedding.select(F.col("code").alias("_code1"), F.col("embedding").alias(output))
        zero = F.array(*[F.lit(0.0)] * len(self.singular_values))
        joined = coded.join(table, F.col("_code0") == F.col("_code1"), "left")
        return joined.withColumn(output, F.coalesce(output, zero)).drop("_code0", "_code1")
