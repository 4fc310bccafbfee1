"""Calibration of classifier scores."""

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotspark.operators.encoders import fold_of
from shotspark.operators.metrics import validate_scores
from shotspark.plans.isotonic import fit_blocks, interpolate, points_of
from shotspark.plans.shared import leave_one_out
from shotspark.scale import materialize

METHODS = [None, "sigmoid", "isotonic", "beta", "beta_am", "beta_ab"]
MAX_LEVELS = 10_000  # points of a monotone fit that are also held as a model
EDGE = 1e-12  # probabilities are kept this far from 0 and 1 before taking logarithms


def _logistic(x: Column) -> Column:
    # written so that exp never overflows
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


class Calibrator:
    """Maps one score column to probabilities.

    ``sigmoid``: logistic(a s + c). ``beta``: logit = a ln p - b ln(1-p) + c with a, b >= 0;
    ``beta_am`` has a = b, ``beta_ab`` has its midpoint at 1/2. ``isotonic``: monotone
    piecewise linear; its blocks stay a table, and a fit of at most ``max_levels`` points is also
    held as a Spark ML model, which scores without a join and gives the same values.
    ``None``: the score itself.
    """

    def __init__(self, method: str | None = "beta", parameters: tuple | None = None, max_levels: int = MAX_LEVELS):
        if method not in METHODS:
            raise ValueError(f"method is one of {METHODS}")
        self.method, self.parameters, self.max_levels = method, parameters, max_levels
        self.points = self.model = None

    # -- fit

    def fit(self, df: DataFrame, score: str = "score", label: str = "y", weight: str | None = None) -> "Calibrator":
        if self.method is None:
            return self
        rows = df.select(
            F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("label"),
            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        )
        if self.method == "isotonic":
            self.points = points_of(fit_blocks(rows))
            if self.points.count() <= self.max_levels:
                # the points rise already, so the model takes them as they are
                self.model = IsotonicRegression(featuresCol="x", labelCol="q").fit(self.points)
            return self
        p = F.least(F.greatest(F.col("s"), F.lit(EDGE)), F.lit(1 - EDGE))
        inputs = {
            "sigmoid": [F.col("s")],
            "beta": [F.log(p), -F.log1p(-p)],
            "beta_am": [F.log(p) - F.log1p(-p)],
            "beta_ab": [F.log(2 * p), -F.log(2 * (1 - p))],
        }[self.method]
        names = [f"x{i}" for i in range(len(inputs))]
        table = VectorAssembler(inputCols=names, outputCol="x").transform(
            rows.select("label", "w", *[c.alias(n) for c, n in zip(inputs, names)])
        )
        common = {"featuresCol": "x", "labelCol": "label", "weightCol": "w", "regParam": 0.0, "fitIntercept": self.method != "beta_ab"}
        # two or three parameters without penalty: a few reweighted least squares passes
        fitted = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50, tol=1e-8, **common).fit(table)
        if self.method.startswith("beta") and min(fitted.coefficients) < 0:
            bounds = DenseMatrix(1, len(names), [0.0] * len(names))
            fitted = LogisticRegression(lowerBoundsOnCoefficients=bounds, maxIter=500, tol=1e-8, **common).fit(table)
        w, c = [float(v) for v in fitted.coefficients], float(fitted.intercept)
        if self.method == "sigmoid":
            self.parameters = (w[0], c)
        elif self.method == "beta_ab":
            # the factors 2 make up an intercept
            self.parameters = (w[0], w[1], (w[0] - w[1]) * math.log(2.0))
        else:
            self.parameters = (w[0], w[-1], c)
        return self

    # -- apply

    def column(self, s: Column) -> Column:
        """Calibrated score as an expression; not for isotonic."""
        if self.method is None:
            return s
        if self.method == "sigmoid":
            slope, shift = self.parameters
            return _logistic(slope * s + shift)
        a, b, c = self.parameters
        p = F.least(F.greatest(s, F.lit(EDGE)), F.lit(1 - EDGE))
        return _logistic(a * F.log(p) - b * F.log1p(-p) + c)

    def transform(self, df: DataFrame, score: str = "score", output: str = "p") -> DataFrame:
        if self.method != "isotonic":
            value = self.column(F.col(score).cast("double"))
            retried = self.column(F.col(score).cast("double") + 1e-300)
            present = F.nanvl(value, F.lit(None).cast("double"))
            return df.withColumn(output, F.coalesce(present, retried))
        if self.model is None:
            return interpolate(df, self.points, score, output)
        model = self.model.copy().setFeaturesCol("_s").setPredictionCol("_p")
        scored = model.transform(df.withColumn("_s", F.col(score).cast("double")))
        return scored.withColumn(output, F.col("_p")).drop("_s", "_p")


def _score_array(columns, score_type, method, n_classes) -> Column:
    """Scores per class: the raw margin where there is one, else the probability. Two classes
    have one score, that of the positive class. Beta calibration needs probabilities."""
    beta = method is not None and method.startswith("beta")
    if score_type is None:
        margin = "rawPrediction" in columns and not beta and method is not None
        score_type = "rawPrediction" if margin else "probability"
    if score_type not in columns:
        raise ValueError(f"the classifier has no column {score_type}")
    scores = vector_to_array(score_type)
    return F.slice(scores, 2, 1) if n_classes == 2 else scores


class CalibratedClassifier:
    """A classifier with calibrated probabilities.

    ``folds='prefit'``: ``base`` is a fitted model, calibrated on the rows given to ``fit``.
    ``folds=k``: ``base`` is an estimator; for each fold a model is fitted on the other rows and
    calibrated on the fold, and predictions are the mean over the k of them.
    """

    def __init__(self, base, method="beta", folds="prefit", score_type=None, key=("game_id", "action_id"), label="label", weight=None, fold=None):
        """``fold`` is an SQL expression for the fold of a row; by default the key tells."""
        self.base, self.method, self.folds, self.score_type, self.fold = base, method, folds, score_type, fold
        self.key, self.label, self.weight = list(key), label, weight

    def fit(self, df: DataFrame) -> "CalibratedClassifier":
        sizes = {r[0]: r[1] for r in df.groupBy(self.label).count().collect()}
        self.classes = sorted(sizes)
        if self.folds == "prefit":
            self.parts = [(self.base, self._calibrators(self.base, df))]
            return self
        if min(sizes.values()) < self.folds:
            raise ValueError(f"{self.folds} folds need as many rows of every class")
        fold = F.expr(self.fold) if self.fold else fold_of(self.key, self.folds)
        df = materialize(df, "training")
        models = leave_one_out(df, self.base, self.folds, fold, self.key)
        self.parts = [(model, self._calibrators(model, df.filter(fold == k))) for k, model in enumerate(models)]
        return self

    def _calibrators(self, model, df):
        scored = model.transform(df)
        scores = _score_array(scored.columns, self.score_type, self.method, len(self.classes))
        keep = [F.col(self.weight).alias("w")] if self.weight else []
        table = materialize(scored.select(scores.alias("scores"), F.col(self.label).alias("label"), *keep), "scores")
        out = []
        for i, c in enumerate(self.classes[1:] if len(self.classes) == 2 else self.classes):
            one = table.select(F.col("scores")[i].alias("score"), (F.col("label") == c).cast("int").alias("y"), *(["w"] if self.weight else []))
            out.append(Calibrator(self.method).fit(one, weight="w" if self.weight else None))
        return out

    def _probabilities(self, df, scores: Column, calibrators) -> DataFrame:
        """Add ``_proba``: calibrated and normalised class probabilities."""
        n = len(self.classes)
        names = [f"_c{i}" for i in range(len(calibrators))]
        out = df.withColumn("_scores", scores)
        for i, (name, calibrator) in enumerate(zip(names, calibrators)):
            out = calibrator.transform(out.withColumn("_one", F.col("_scores")[i]), "_one", name).drop("_one")
        if n == 2:
            proba = F.array(1.0 - F.col("_c0"), F.col("_c0"))
        else:
            total = sum((F.col(c) for c in names), F.lit(0.0))
            proba = F.array(*[F.try_divide(F.col(c), total) for c in names])

        def tidy(p):
            known = F.coalesce(F.nanvl(p, F.lit(None).cast("double")), F.lit(1.0 / n))
            return F.when((known > 1) & (known <= 1 + 1e-5), 1.0).otherwise(known)

        return out.withColumn("_proba", F.transform(proba, tidy)).drop("_scores", *names)

    def _mean(self, df, score_of) -> DataFrame:
        """Add ``proba``: mean over the parts of their calibrated class probabilities."""
        kept, sums = list(df.columns), []
        for i, (model, calibrators) in enumerate(self.parts):
            scored, scores = score_of(model, df)
            df = self._probabilities(scored, scores, calibrators).select(*kept, *sums, F.col("_proba").alias(f"_p{i}"))
            sums.append(f"_p{i}")
        mean = F.array(
            *[sum((F.col(s)[c] for s in sums), F.lit(0.0)) / len(sums) for c in range(len(self.classes))]
        )
        return df.select(*kept, mean.alias("proba"))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Add ``proba``, an array with one probability per class."""

        def score_of(model, rows):
            scored = model.transform(rows)
            return scored, _score_array(scored.columns, self.score_type, self.method, len(self.classes))

        return self._mean(df, score_of)

    def calibrate_scores(self, df: DataFrame, score: str = "score") -> DataFrame:
        """The same for a column of bare scores of the positive class."""
        if len(self.classes) != 2:
            raise ValueError("bare scores need two classes")
        return self._mean(df, lambda model, rows: (rows, F.array(F.col(score).cast("double"))))

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``proba`` and ``prediction``, the class with the highest probability."""
        classes = F.array(*[F.lit(c) for c in self.classes])
        best = F.array_position("proba", F.array_max("proba")).cast("int")
        return self.predict_proba(df).withColumn("prediction", F.element_at(classes, best))


class _AsScored:
    """Stands for a model on rows that it has scored before."""

    def transform(self, df):
        return df


def compare(model, val: DataFrame, test: DataFrame, label: str = "label", methods=METHODS) -> DataFrame:
    """Metrics on ``test`` of a fitted model calibrated on ``val`` by each method, best ACE first.
    The model scores both tables once; the methods work on the written scores."""

    def scored_once(df):
        scored = model.transform(df)
        return materialize(scored.select(label, *[c for c in ("rawPrediction", "probability") if c in scored.columns]), "scored")

    val, test = scored_once(val), scored_once(test)
    rows, names = [], ["max_dev", "residual_area", "roc", "brier", "ece", "ace"]
    for method in methods:
        calibrated = CalibratedClassifier(_AsScored(), method, label=label).fit(val)
        scored = calibrated.predict_proba(test).select(F.col("proba")[1].alias("p"), F.col(label).cast("int").alias("y"))
        scalars, _curve = validate_scores(scored)
        rows.append((method or "base", *[scalars[n] for n in names]))
    schema = "method string, " + ", ".join(f"{n} double" for n in names)
    return test.sparkSession.createDataFrame(rows, schema).orderBy("ace", "method")
