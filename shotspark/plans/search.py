"""Random hyperparameter search with cross validation. Linear models, boosted trees and perceptrons fit
all draws and folds in the same scans (``shared``, ``boosting``, ``neural``); a search over any other
pipeline fits its candidates by Spark ML's CrossValidator. Folds come from the row key, so they are stable and need no shuffle."""

import random

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, RegressionEvaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.operators.encoders import fold_of
from shotspark.operators.metrics import brier
from shotspark.plans import boosting, neural, shared
from shotspark.plans.models import SkLogistic, positive_probability
from shotspark.plans.prep import prep_linear, prep_tree
from shotspark.scale import materialize


class BrierEvaluator(Evaluator):
    """Mean squared error of the probability; smaller is better."""

    def __init__(self, label: str = "label"):
        super().__init__()
        self.label = label

    def _evaluate(self, df):
        return brier(df.select(positive_probability().alias("p"), F.col(self.label).alias("y"))).first()[0]

    def isLargerBetter(self):
        return False


def scorer(name: str, label: str = "label") -> Evaluator:
    if name == "roc_auc":
        return BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol=label, metricName="areaUnderROC", numBins=0)
    if name == "brier":
        return BrierEvaluator(label)
    if name == "rmse":
        return RegressionEvaluator(labelCol=label, metricName="rmse")
    raise ValueError(f"unknown scoring {name}")


class BoostedTrees(Estimator):
    """Gradient-boosted trees with a fraction of the features per split and a weight of the
    positive class; fits Spark ML's GBTClassifier."""

    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows per leaf", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows per tree", TypeConverters.toFloat)
    featureFraction = Param(Params._dummy(), "featureFraction", "share of the features per split", TypeConverters.toFloat)
    minInfoGain = Param(Params._dummy(), "minInfoGain", "gain of a split", TypeConverters.toFloat)
    posWeight = Param(Params._dummy(), "posWeight", "weight of the positive class", TypeConverters.toFloat)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "number of trees", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, maxDepth=5, minInstancesPerNode=1, subsamplingRate=1.0, featureFraction=1.0,
        minInfoGain=0.0, posWeight=1.0, stepSize=0.08, maxIter=100,
    ):
        super().__init__()
        self._setDefault(
            maxDepth=5, minInstancesPerNode=1, subsamplingRate=1.0, featureFraction=1.0,
            minInfoGain=0.0, posWeight=1.0, stepSize=0.08, maxIter=100,
        )
        self._set(**self._input_kwargs)

    def _fit(self, df):
        weighted = df.withColumn("_weight", F.when(F.col("label") == 1, self.getOrDefault("posWeight")).otherwise(1.0))
        return GBTClassifier(
            labelCol="label", featuresCol="features", weightCol="_weight", seed=7,
            maxDepth=self.getOrDefault("maxDepth"), minInstancesPerNode=self.getOrDefault("minInstancesPerNode"),
            subsamplingRate=self.getOrDefault("subsamplingRate"), featureSubsetStrategy=str(self.getOrDefault("featureFraction")),
            minInfoGain=self.getOrDefault("minInfoGain"), stepSize=self.getOrDefault("stepSize"), maxIter=self.getOrDefault("maxIter"),
        ).fit(weighted)


# --- parameter spaces -------------------------------------------------------------------


def _log_steps(low, high, count):
    return [10 ** (low + (high - low) * i / (count - 1)) for i in range(count)]


def _draws(space: dict, n_iter: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    return [{p: (rng.choice(s) if isinstance(s, list) else s(rng)) for p, s in space.items()} for _ in range(n_iter)]


class RandomSearch:
    """``n_iter`` random draws of ``space`` (parameter to a list, or to a function of a random
    generator), scored by ``folds``-fold cross validation."""

    def __init__(self, pipeline, space, n_iter=100, scoring="roc_auc", folds=5, parallelism=4, seed=7, key=("game_id", "action_id")):
        self.pipeline, self.scoring, self.folds, self.parallelism, self.key = pipeline, scoring, folds, parallelism, list(key)
        self.draws = _draws(space, n_iter, seed)
        self.seed = seed

    def fit(self, df: DataFrame) -> CrossValidatorModel:
        """The fitted CrossValidatorModel; ``bestModel`` is refitted on all rows."""
        validator = CrossValidator(
            estimator=self.pipeline, estimatorParamMaps=self.draws, evaluator=scorer(self.scoring),
            numFolds=self.folds, parallelism=self.parallelism, seed=self.seed, foldCol="_fold",
        )
        return validator.fit(materialize(df.withColumn("_fold", fold_of(self.key, self.folds)), "training"))

    def table(self, fitted: CrossValidatorModel) -> DataFrame:
        """(draw, parameters, score) of all candidates."""
        rows = [
            (i, ", ".join(f"{p.name}={v}" for p, v in sorted(d.items(), key=lambda item: item[0].name)), float(s))
            for i, (d, s) in enumerate(zip(self.draws, fitted.avgMetrics))
        ]
        return SparkSession.active().createDataFrame(rows, "draw int, parameters string, score double")


class SearchResult:
    """``avgMetrics``: the score of each draw; ``bestModel``: the best one fitted on all rows."""

    def __init__(self, avgMetrics: list[float], bestModel: PipelineModel):
        self.avgMetrics, self.bestModel = avgMetrics, bestModel


class SharedSearch:
    """``n_iter`` random draws of ``space`` (name to a list), scored by ``folds``-fold cross
    validation, where a scan of the rows serves all draws and folds. ``fold`` is an SQL expression for
    the fold of a row, 0 to folds - 1; by default its ``key`` tells."""

    larger_is_better = {"roc_auc": True, "brier": False, "rmse": False}
    scorings: tuple = ()

    def __init__(self, numeric, categoric, space, n_iter, scoring, folds=5, seed=7, key=("game_id", "action_id"), fold=None):
        if scoring not in self.scorings:
            raise ValueError(f"unknown scoring {scoring}")
        self.numeric, self.categoric, self.scoring, self.folds = list(numeric), list(categoric), scoring, folds
        self.key, self.fold, self.draws = list(key), fold, _draws(space, n_iter, seed)

    def prep(self):
        return prep_linear(self.numeric, self.categoric)

    def fit(self, df: DataFrame) -> SearchResult:
        fold = F.expr(self.fold) if self.fold else fold_of(self.key, self.folds)
        df = materialize(df, "training")  # the best draw is fitted on the same rows
        rows, _ = shared.fold_rows(df, self.prep(), self.folds, fold, self.key, stored=True)
        # equal draws are fitted once
        names = sorted(self.draws[0])
        distinct = sorted({tuple((n, d[n]) for n in names) for d in self.draws}, key=str)
        per_fold = self._scores(rows, [dict(d) for d in distinct])
        mean = {d: sum(s) / len(s) for d, s in zip(distinct, per_fold)}
        metrics = [mean[tuple((n, d[n]) for n in names)] for d in self.draws]
        best = (max if self.larger_is_better[self.scoring] else min)(range(len(metrics)), key=lambda i: metrics[i])
        return SearchResult(metrics, Pipeline(stages=[self.prep(), self._estimator(self.draws[best], df)]).fit(df))

    def _per_fold(self, scored: DataFrame, draws: int) -> list[list[float]]:
        """Scores of each draw, from (model, label, p) with the models of a draw in order of the folds."""
        found = {"brier": shared.brier_scores, "roc_auc": shared.auc_scores, "rmse": shared.rmse_scores}[self.scoring](scored)
        return [[found[i] for i in range(k * self.folds, (k + 1) * self.folds) if i in found] for k in range(draws)]

    def table(self, fitted: SearchResult) -> DataFrame:
        """(draw, parameters, score) of all candidates."""
        rows = [(i, parameter_text(d), float(s)) for i, (d, s) in enumerate(zip(self.draws, fitted.avgMetrics))]
        return SparkSession.active().createDataFrame(rows, "draw int, parameters string, score double")


def parameter_text(draw: dict) -> str:
    return ", ".join(f"{k}={draw[k]}" for k in sorted(draw))


class LogisticSearch(SharedSearch):
    """Logistic regression without intercept; draws have C or (alpha, penalty), and classWeight."""

    scorings = ("roc_auc", "brier")

    def _scores(self, rows, draws):
        # alpha weighs the penalty in the mean loss, so its share of a sum depends on the rows of a fold
        counts = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        candidates = [
            (f, d.get("penalty", "l2"), 1 / d["C"] if "C" in d else d["alpha"] * (total - counts.get(f, 0)), d["classWeight"] == "balanced")
            for d in draws
            for f in range(self.folds)
        ]
        return self._per_fold(shared.scores(rows, shared.LogisticFits(rows, self.folds, candidates)), len(draws))

    def _estimator(self, draw, df):
        return SkLogistic(fitIntercept=False, **draw)


class LeastSquaresSearch(SharedSearch):
    """Linear regression; draws have alpha, the weight of the penalty (l1 or l2) beside half the mean
    squared error."""

    scorings = ("rmse",)

    def _scores(self, rows, draws):
        grams = shared.gram_matrices(rows, self.folds)
        training = [sum(g for f, g in enumerate(grams[k]) if f != k) for k in range(self.folds)]
        return [
            [
                shared.squared_error(grams[k][k], shared.least_squares(training[k], d["alpha"], d["penalty"] == "l1")) ** 0.5
                for k in range(self.folds)
                if grams[k][k][0, 0]
            ]
            for d in draws
        ]

    def _estimator(self, draw, df):
        # Spark ML takes an l2 weight in units of the label's deviation
        unit = 1.0 if draw["penalty"] == "l1" else df.agg(F.stddev_samp("label")).first()[0] or 1.0
        return LinearRegression(
            labelCol="label", featuresCol="features", standardization=False, regParam=draw["alpha"] * unit,
            elasticNetParam=1.0 if draw["penalty"] == "l1" else 0.0, maxIter=1000, tol=1e-9,
        )


def logreg_search(numeric, categoric, learning_rate=None, n_iter=100, scoring="roc_auc", **options) -> LogisticSearch:
    """Logistic regression without intercept. The exact solver searches C, the gradient one
    (any ``learning_rate``) the penalty and its weight; both search the class weights. Both are
    fitted to the minimum by Newton steps, so the step size itself has no influence."""
    space = {"classWeight": ["balanced", "none"]}
    if learning_rate is None:
        space["C"] = _log_steps(-5, 5, 100)
    else:
        space["penalty"] = ["l1", "l2"]
        space["alpha"] = _log_steps(-5, 5, 100)
    return LogisticSearch(numeric, categoric, space, n_iter, scoring, **options)


class BoostedSearch(SharedSearch):
    """Boosted trees over histograms; draws are ``boosting.Settings``. ``logistic`` is False for a
    numeric target."""

    scorings = ("roc_auc", "brier", "rmse")

    def __init__(self, *args, trees=100, logistic=True, learning_rate=0.08, bins=boosting.BINS, **options):
        super().__init__(*args, **options)
        self.trees, self.logistic, self.learning_rate, self.bins = trees, logistic, learning_rate, bins

    def prep(self):
        return prep_tree(self.numeric, self.categoric)

    def _settings(self, draw):
        return boosting.Settings(**draw, learning_rate=self.learning_rate)

    def _scores(self, rows, draws):
        models = [(f, self._settings(d)) for d in draws for f in range(self.folds)]
        fitted = boosting.Boosting(rows, self.folds, models, self.trees, self.logistic, bins=self.bins)
        return self._per_fold(fitted.scores(), len(draws))

    def _estimator(self, draw, df):
        return boosting.BoostedTrees(self._settings(draw), self.trees, self.logistic)


class PerceptronSearch(SharedSearch):
    """Perceptrons; draws are ``neural.Layout``."""

    scorings = ("roc_auc", "brier", "rmse")

    def __init__(self, *args, epochs=200, logistic=True, learning_rate=0.08, **options):
        super().__init__(*args, **options)
        self.epochs, self.logistic, self.learning_rate = epochs, logistic, learning_rate

    def _layout(self, draw):
        return neural.Layout(**draw, step_size=self.learning_rate)

    def _scores(self, rows, draws):
        models = [(f, self._layout(d)) for d in draws for f in range(self.folds)]
        return self._per_fold(neural.Networks(rows, self.folds, models, self.epochs, self.logistic).scores(), len(draws))

    def _estimator(self, draw, df):
        return neural.Perceptron(self._layout(draw), self.epochs, self.logistic)


BOOSTED_SPACE = {
    "max_depth": list(range(2, 11)),
    "min_child_weight": list(range(1, 11)),
    "subsample": lambda r: r.uniform(0.5, 1.0),
    "colsample_bytree": lambda r: r.uniform(0.5, 1.0),
    "colsample_bylevel": lambda r: r.uniform(0.5, 1.0),
    "gamma": lambda r: r.uniform(0.0, 1.0),
    "reg_alpha": lambda r: r.uniform(0.0, 1.0),
    "reg_lambda": lambda r: r.uniform(0.0, 10.0),
}

PERCEPTRON_SPACE = {
    "hidden": [(24,), (12, 12), (6,) * 4, (4,) * 6, (12, 6, 3, 3)],
    "activation": ["relu", "logistic", "tanh"],
    "batch_size": [16, 32, 64, 128, 256, 512],
    "alpha": lambda r: r.uniform(0.0001, 0.9001),
    "schedule": ["constant", "adaptive"],
}


def boosted_search(numeric, categoric, learning_rate=0.08, n_iter=100, scoring="roc_auc", **options) -> BoostedSearch:
    space = BOOSTED_SPACE | {
        # probabilities of a base score lie below one
        "base_score": lambda r: r.uniform(0.1, 0.999),
        "scale_pos_weight": lambda r: r.uniform(0.1, 10.0),
    }
    return BoostedSearch(numeric, categoric, space, n_iter, scoring, learning_rate=learning_rate, **options)


def boosted_regression_search(numeric, categoric, learning_rate=0.08, n_iter=100, scoring="rmse", **options) -> BoostedSearch:
    space = BOOSTED_SPACE | {"base_score": lambda r: r.uniform(0.1, 1.0)}
    return BoostedSearch(numeric, categoric, space, n_iter, scoring, learning_rate=learning_rate, logistic=False, **options)


def mlp_search(numeric, categoric, learning_rate=0.08, n_iter=100, scoring="roc_auc", **options) -> PerceptronSearch:
    return PerceptronSearch(numeric, categoric, PERCEPTRON_SPACE, n_iter, scoring, learning_rate=learning_rate, **options)


def mlp_regression_search(numeric, categoric, learning_rate=0.08, n_iter=100, scoring="rmse", **options) -> PerceptronSearch:
    return PerceptronSearch(numeric, categoric, PERCEPTRON_SPACE, n_iter, scoring, learning_rate=learning_rate, logistic=False, **options)


def linear_regression_search(numeric, categoric, n_iter=100, scoring="rmse", **options) -> LeastSquaresSearch:
    space = {"penalty": ["l1", "l2"], "alpha": _log_steps(-5, 5, 100)}
    return LeastSquaresSearch(numeric, categoric, space, n_iter, scoring, **options)
