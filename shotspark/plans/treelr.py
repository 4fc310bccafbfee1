"""Logistic regression on the leaves of boosted trees."""

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.plans.models import SkLogistic
from shotspark.scale import materialize


class TreeLR:
    """``forest`` is a pipeline that ends in boosted trees; each tree's leaf is an indicator
    for the logistic regression ``lr``. A leaf without training rows adds nothing."""

    def __init__(self, forest=None, lr=None):
        self.forest, self.lr = forest, lr or SkLogistic()

    def _leaves(self, df: DataFrame) -> DataFrame:
        trees = self.forest_model.stages[-1].copy()
        trees.setLeafCol("_leaves")
        prepared = PipelineModel(self.forest_model.stages[:-1]).transform(df)
        kept = trees.transform(prepared).select(*df.columns, vector_to_array("_leaves").alias("_leaves"))
        tokens = F.transform("_leaves", lambda leaf, i: F.concat_ws(":", i.cast("string"), leaf.cast("int").cast("string")))
        return kept.withColumn("_tokens", tokens).drop("_leaves")

    def fit(self, df: DataFrame) -> "TreeLR":
        self.forest_model = self.forest.fit(df)
        leaves = materialize(self._leaves(df), "leaves")
        # all leaves are kept: inner nodes have two children, so half of the nodes are leaves
        total = sum((t.numNodes + 1) // 2 for t in self.forest_model.stages[-1].trees)
        self.encoder = CountVectorizer(inputCol="_tokens", outputCol="_onehot", binary=True, vocabSize=total).fit(leaves)
        self.lr_model = self.lr.copy({self.lr.featuresCol: "_onehot"}).fit(self.encoder.transform(leaves))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` and the other columns of the logistic regression."""
        return self.lr_model.transform(self.encoder.transform(self._leaves(df))).drop("_tokens", "_onehot")

    def save(self, path: str) -> None:
        for name, stage in (("forest", self.forest_model), ("encoder", self.encoder), ("lr", self.lr_model)):
            stage.write().overwrite().save(f"{path}/{name}")

    @classmethod
    def load(cls, path: str) -> "TreeLR":
        out = cls()
        out.forest_model = PipelineModel.load(f"{path}/forest")
        out.encoder = CountVectorizerModel.load(f"{path}/encoder")
        out.lr_model = LogisticRegressionModel.load(f"{path}/lr")
        return out
