"""Models that give each shot the probability of becoming a goal."""

import importlib
import json
from dataclasses import replace
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.functions import features as fs
from shotspark.functions import filters
from shotspark.operators.metrics import validate_scores
from shotspark.plans.dataset import KEY, pitch_grid, shot_features
from shotspark.plans.prep import prep_linear
from shotspark.scale import materialize
from shotspark.sources.tables import ShotData, of_games, select_games

PENALTY_XG = 0.792453  # fixed value: share of penalties that are scored


class NotFitted(RuntimeError):
    pass


class SkLogistic(Estimator):
    """Logistic regression with the penalty given as ``C`` (weight of the loss, as in sum of
    losses times C plus half the squared weights) or as ``alpha`` (weight of the penalty in the
    mean loss, l1 or l2), and optional balanced class weights. Fitting counts the rows and
    returns Spark ML's LogisticRegressionModel."""

    C = Param(Params._dummy(), "C", "weight of the loss", TypeConverters.toFloat)
    alpha = Param(Params._dummy(), "alpha", "weight of the penalty; overrides C", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "l1 or l2", TypeConverters.toString)
    classWeight = Param(Params._dummy(), "classWeight", "balanced or none", TypeConverters.toString)
    fitIntercept = Param(Params._dummy(), "fitIntercept", "fit an intercept", TypeConverters.toBoolean)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "features column", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weights, empty for none", TypeConverters.toString)

    @keyword_only
    def __init__(
        self, *, C=1.0, alpha=None, penalty="l2", classWeight="none", fitIntercept=True,
        labelCol="label", featuresCol="features", weightCol="",
    ):
        super().__init__()
        self._setDefault(
            C=1.0, penalty="l2", classWeight="none", fitIntercept=True, labelCol="label", featuresCol="features", weightCol=""
        )
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df):
        label, weight = self.getOrDefault("labelCol"), self.getOrDefault("weightCol")
        own = F.col(weight) if weight else F.lit(1.0)
        sums = {r["y"]: r["w"] for r in df.groupBy(F.col(label).alias("y")).agg(F.sum(own).alias("w")).collect()}
        total = sum(sums.values())
        if self.getOrDefault("classWeight") == "balanced":
            factor = F.lit(None).cast("double")
            for y, w in sums.items():
                factor = F.when(F.col(label) == y, total / (len(sums) * w)).otherwise(factor)
            df, weight = df.withColumn("_weight", own * factor), "_weight"
        alpha = self.getOrDefault("alpha") if self.isSet("alpha") else 1.0 / (self.getOrDefault("C") * total)
        estimator = LogisticRegression(
            labelCol=label, featuresCol=self.getOrDefault("featuresCol"), regParam=alpha,
            elasticNetParam=1.0 if self.getOrDefault("penalty") == "l1" else 0.0,
            standardization=False, fitIntercept=self.getOrDefault("fitIntercept"), maxIter=1000, tol=1e-7,
        )
        return (estimator.setWeightCol(weight) if weight else estimator).fit(df)


def positive_probability():
    return vector_to_array("probability")[1]


class ShotModel:
    """One pipeline for one kind of shots. ``pipeline`` is any Spark ML estimator whose model
    writes a ``probability`` vector; it reads the feature columns and the label ``label``."""

    kind: str | None = None  # shot type, None for all counted shots
    default_name = "model"
    shot_filter = staticmethod(filters.any_shot)
    column_descriptions: dict[str, str] = {}
    generators = fs.all_features
    n_states = 3

    def __init__(self, pipeline=None):
        # the generators of the default pipeline cover what it reads, any other gets all features
        self.custom = pipeline is not None
        self.pipeline = pipeline if self.custom else self.default_pipeline()
        self.fitted = None
        self.training_seasons = None
        self.validation_seasons = None

    def default_pipeline(self):
        numeric = ["start_dist_to_goal_a0", "start_angle_to_goal_a0"]
        self.column_descriptions = self.column_descriptions or {
            "bodypart_id_a0": "Foot, head or another part of the body",
            numeric[0]: "Metres from the ball to the middle of the goal",
            numeric[1]: "Angle between the axis of the pitch and the line to the middle of the goal",
        }
        return Pipeline(stages=[prep_linear(numeric, ["bodypart_id_a0"]), SkLogistic(fitIntercept=False)])

    @classmethod
    def from_pipeline(cls, fitted, training_seasons=None) -> "ShotModel":
        """Wrap a fitted pipeline, for example the best one of a search."""
        model = cls(fitted)
        model.fitted, model.training_seasons = fitted, training_seasons or []
        return model

    # -- data

    def _frame(self, source, keep=()) -> DataFrame:
        """Feature rows of a provider, or the given table of feature rows."""
        if not isinstance(source, ShotData):
            return source
        generators, n = (fs.all_features, 3) if self.custom else (self.generators, self.n_states)
        return shot_features(source, generators, self.shot_filter, n, keep)

    @staticmethod
    def _labelled(source: ShotData) -> ShotData:
        goal = F.col("result_id") == source.vocab.results.index("success")
        return replace(source, actions=source.actions.withColumn("goal", goal))

    @staticmethod
    def _restricted(source, seasons):
        if seasons is None or not isinstance(source, ShotData):
            return source
        return replace(source, games=select_games(source.games, seasons))

    # -- the three steps

    def train(self, source, seasons=None, target: str = "goal") -> "ShotModel":
        """Fit on the shots of the given (competition, season) pairs, or on a table of feature
        rows with the label column ``target``."""
        self.training_seasons = []
        if isinstance(source, ShotData):
            frame = self._frame(self._labelled(self._restricted(source, seasons)), ["goal"])
            self.training_seasons, target = seasons or [], "goal"
        else:
            frame = self._of_kind(source)
        frame = frame.withColumn("label", F.col(target).cast("double"))
        if not self.custom:
            frame = frame.select(*self.column_descriptions, "label")
        # a fit runs many jobs; a written table spares each of them the lineage of the features
        self.fitted = self.pipeline.fit(materialize(frame, "training"))
        return self

    def _of_kind(self, table: DataFrame) -> DataFrame:
        return table

    def score(self, source, keep=()) -> DataFrame:
        """Keys, the columns ``keep`` and xG."""
        if self.fitted is None:
            raise NotFitted("the model must be trained first")
        frame = self._frame(source, keep)
        key = [c for c in KEY if c in frame.columns]
        return self.fitted.transform(frame).select(*key, *keep, positive_probability().alias("xG"))

    def add_xg(self, frame: DataFrame, name: str) -> DataFrame:
        """Feature rows with one more column, the probability."""
        return self.fitted.transform(frame).select(*frame.columns, positive_probability().alias(name))

    def estimate(self, source, games=None, keep=()) -> DataFrame:
        """(game_id, action_id, xG) of the shots of all or the given games (a list of ids or a
        table), with the columns ``keep`` of the actions."""
        if games is not None and not isinstance(source, ShotData):
            source = of_games(source, source, games)
        return self.score(source.only(games) if isinstance(source, ShotData) else source, keep)

    def validate(self, source, seasons=None, target: str = "goal") -> tuple[dict, DataFrame]:
        """Scalar metrics and the smoothed calibration curve."""
        self._check_fitted()
        if isinstance(source, ShotData):
            source, target = self._labelled(self._restricted(source, seasons)), "goal"
            self.validation_seasons = seasons or []
        else:
            self.validation_seasons = []
        scored = self.score(source, [target])
        return validate_scores(scored.select(F.col("xG").alias("p"), F.col(target).cast("int").alias("y")))

    def _check_fitted(self):
        if self.fitted is None:
            raise NotFitted("the model must be trained first")

    # -- storage

    def _manifest(self) -> dict:
        return {
            "class": type(self).__qualname__, "module": type(self).__module__, "custom": self.custom, "fitted": self.fitted is not None,
            "training_seasons": self.training_seasons, "validation_seasons": self.validation_seasons,
            "columns": self.column_descriptions,
        }

    def save(self, spark: SparkSession, folder: str, name: str | None = None) -> str:
        """Store below ``folder``, by default under the name of the class; overwrites."""
        path = f"{folder.rstrip('/')}/{name or self.default_name}"
        spark.createDataFrame([(json.dumps(self._manifest()),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/manifest"
        )
        self._save_parts(spark, path)
        return path

    def _save_parts(self, spark, path):
        if isinstance(self.fitted, PipelineModel):
            self.fitted.write().overwrite().save(f"{path}/pipeline")
        elif self.fitted is not None:
            raise TypeError("only pipeline models can be stored; store other models with their own writer")

    def _load_parts(self, spark, path, manifest, classes=()):
        if manifest["fitted"]:
            self.fitted = PipelineModel.load(f"{path}/pipeline")
            if self.custom:
                self.pipeline = self.fitted

    @staticmethod
    def load(
        spark: SparkSession, folder: str, name: str | None = None, default: type | None = None, classes=()
    ) -> "ShotModel":
        """Load any stored model; without a name the default one of the class ``default``. Own
        classes are imported from their module, or named in ``classes`` where that cannot be."""
        path = f"{folder.rstrip('/')}/{name or (default or CompositeModel).default_name}"
        manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
        model = _class_of(manifest, classes)()
        model.custom = manifest.get("custom", False)
        model.column_descriptions = manifest["columns"]
        pairs = {k: [tuple(p) for p in manifest[k]] if manifest[k] is not None else None for k in ("training_seasons", "validation_seasons")}
        model.training_seasons, model.validation_seasons = pairs["training_seasons"], pairs["validation_seasons"]
        model._load_parts(spark, path, manifest, classes)
        return model


def _class_of(manifest: dict, classes=()) -> type:
    known = {c.__qualname__: c for c in (ShotModel, OpenplayModel, FreekickModel, PenaltyModel, CompositeModel, *classes)}
    if manifest["class"] in known:
        return known[manifest["class"]]
    try:
        found = importlib.import_module(manifest["module"])
        for part in manifest["class"].split("."):
            found = getattr(found, part)
    except (KeyError, ImportError, AttributeError) as e:
        raise ValueError(f"the stored model is of the class {manifest['class']}, which is not known here: give it in classes") from e
    return found


class _OneKind(ShotModel):
    def _of_kind(self, table):
        """Rows of this model's kind, where a table of feature rows tells the kind."""
        return table.filter(F.col("type_id_a0") == self.kind) if "type_id_a0" in table.columns else table


class OpenplayModel(_OneKind):
    kind = "shot"
    default_name = "default-openplay"
    shot_filter = staticmethod(filters.openplay)
    # the defaults look at the shot only, so no earlier actions are needed
    generators = [fs.startpolar, fs.bodypart]
    n_states = 1


class FreekickModel(_OneKind):
    kind = "shot_freekick"
    default_name = "default-freekick"
    shot_filter = staticmethod(filters.freekick)
    generators = [fs.startpolar]
    n_states = 1

    def default_pipeline(self):
        self.column_descriptions = {
            "start_dist_to_goal_a0": "Metres from the ball to the middle of the goal",
            "start_angle_to_goal_a0": "Angle between the axis of the pitch and the line to the middle of the goal",
        }
        return Pipeline(stages=[prep_linear(list(self.column_descriptions), []), SkLogistic(fitIntercept=True)])


class PenaltyModel(_OneKind):
    """Every penalty has the same probability. Always fitted."""

    kind = "shot_penalty"
    default_name = "default-penalty"
    shot_filter = staticmethod(filters.penalty)
    generators: list = []

    def default_pipeline(self):
        return None

    def train(self, source, seasons=None, target="goal"):
        return self

    def score(self, source, keep=()):
        frame = self._frame(source, keep)
        key = [c for c in KEY if c in frame.columns]
        return frame.select(*key, *keep, F.lit(PENALTY_XG).alias("xG"))

    def add_xg(self, frame, name):
        return frame.withColumn(name, F.lit(PENALTY_XG))

    def _check_fitted(self):
        pass

    def _save_parts(self, spark, path):
        pass

    def _load_parts(self, spark, path, manifest, classes=()):
        pass


class CompositeModel(ShotModel):
    """One model per kind of shot. Every shot is scored by the model of its kind."""

    default_name = "default"

    def __init__(self, models=None):
        self.models = list(models) if models is not None else [OpenplayModel(), FreekickModel(), PenaltyModel()]
        self.custom = False
        self.column_descriptions = {type(m).__name__: m.column_descriptions for m in self.models}
        self.training_seasons = self.validation_seasons = None
        self.trained = False

    def _routed(self) -> bool:
        """Whether the sub-models are default ones, each for a kind of its own. Then one scan serves
        them all; other models may need rows or columns of their own and are asked one by one."""
        kinds = [type(m) for m in self.models]
        return len(set(kinds)) == len(kinds) and set(kinds) <= {OpenplayModel, FreekickModel, PenaltyModel} and not any(m.custom for m in self.models)

    def _shared_frame(self, source: ShotData, keep) -> DataFrame:
        """Feature rows for all sub-models, with a column ``_for<i>`` that tells whose row it is."""
        generators = list(dict.fromkeys(g for m in self.models for g in m.generators))
        flags = {f"_for{i}": m.shot_filter for i, m in enumerate(self.models)}

        def any_kind(a):
            return reduce(lambda x, y: x | y, [m.shot_filter(a) for m in self.models])

        return shot_features(source, generators, any_kind, max([m.n_states for m in self.models if m.generators], default=1), keep, flags=flags)

    def train(self, source, seasons=None, target="goal"):
        if isinstance(source, ShotData) and self._routed():
            frame = materialize(self._shared_frame(self._labelled(self._restricted(source, seasons)), ["goal"]), "training")
            for i, model in enumerate(self.models):
                model.train(frame.filter(F.col(f"_for{i}")))
                model.training_seasons = seasons or []
        else:
            for model in self.models:
                model.train(source, seasons, target)
        self.training_seasons = (seasons or []) if isinstance(source, ShotData) else []
        self.trained = True
        return self

    def _check_fitted(self):
        for model in self.models:
            model._check_fitted()

    def score(self, source, keep=()):
        self._check_fitted()
        if not isinstance(source, ShotData) and "type_id_a0" not in source.columns:
            raise ValueError("feature rows need type_id_a0, which tells the kind of a shot")
        if isinstance(source, ShotData) and self._routed():
            frame, value = self._shared_frame(source, keep), F.lit(None).cast("double")
            for i, model in enumerate(self.models):
                frame = model.add_xg(frame, f"_xg{i}")
                value = F.when(F.col(f"_for{i}"), F.col(f"_xg{i}")).otherwise(value)
            return frame.select(*KEY, *keep, value.alias("xG"))
        parts = [m.score(source if isinstance(source, ShotData) else m._of_kind(source), keep) for m in self.models]
        scored = parts[0]
        for part in parts[1:]:
            scored = scored.unionByName(part)
        return scored

    def _manifest(self):
        return {
            "class": type(self).__qualname__, "module": type(self).__module__, "fitted": self.trained, "parts": [m.default_name for m in self.models],
            "training_seasons": self.training_seasons, "validation_seasons": self.validation_seasons,
            "columns": self.column_descriptions,
        }

    def _save_parts(self, spark, path):
        for i, model in enumerate(self.models):
            model.save(spark, path, f"{i}-{model.default_name}")

    def _load_parts(self, spark, path, manifest, classes=()):
        self.models = [ShotModel.load(spark, path, f"{i}-{n}", classes=classes) for i, n in enumerate(manifest["parts"])]
        self.trained = manifest["fitted"]


def coefficients(spark: SparkSession, fitted: PipelineModel, sample: DataFrame) -> DataFrame:
    """(feature, coefficient) of the linear model that ends a pipeline; ``sample`` gives the
    schema from which the names of the vector slots are read."""
    model = fitted.stages[-1]
    schema = fitted.transform(sample).schema[model.getFeaturesCol()]
    slots = [a for group in schema.metadata["ml_attr"]["attrs"].values() for a in group]
    names = {a["idx"]: a.get("name", str(a["idx"])) for a in slots}
    rows = [(names[i], float(v)) for i, v in enumerate(model.coefficients.toArray())]
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy("coefficient")


def surface(model: ShotModel, bodyparts: DataFrame) -> DataFrame:
    """Probability at every whole metre of the pitch: bodypart_id_a0, x, y, xG."""
    model._check_fitted()
    scored = model.fitted.transform(pitch_grid(bodyparts))
    return scored.select(
        "bodypart_id_a0", F.col("start_x_a0").alias("x"), F.col("start_y_a0").alias("y"), positive_probability().alias("xG")
    )
