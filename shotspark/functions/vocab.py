"""Pitch size and vocabularies. The id of a name is its position in the list."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pitch in metres, origin in a corner, goal centre at (105, 34)
LENGTH = 105.0
WIDTH = 68.0
GOAL_WIDTH = 7.3
SIX_YARD_LENGTH = 5.5
SIX_YARD_WIDTH = 18.3
BOX_LENGTH = 16.5
BOX_WIDTH = 40.3

# Names used for shots, results and body parts
TYPES = ["pass", "cross", "dribble", "tackle", "shot", "shot_penalty", "shot_freekick"]
RESULTS = ["fail", "success", "offside", "owngoal"]
BODYPARTS = ["foot", "head", "other"]


@dataclass(frozen=True)
class Vocabulary:
    types: list[str] = field(default_factory=lambda: list(TYPES))
    results: list[str] = field(default_factory=lambda: list(RESULTS))
    bodyparts: list[str] = field(default_factory=lambda: list(BODYPARTS))

    def levels(self, kind: str) -> list[str]:
        return {"type": self.types, "result": self.results, "bodypart": self.bodyparts}[kind]

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        """(id, name) rows of one vocabulary."""
        return spark.createDataFrame(
            list(enumerate(self.levels(kind))), f"{kind}_id long, {kind}_name string"
        )


def name_of(id_col: Column, levels: list[str]) -> Column:
    """Name for an id, NULL outside the vocabulary. Vocabularies are short and fixed, so the
    lookup is a literal array inside the projection instead of a join."""
    return F.get(F.array(*[F.lit(v) for v in levels]), id_col.cast("int"))


def id_of(name_col: Column, levels: list[str]) -> Column:
    """Id for a name, NULL outside the vocabulary."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), name_col)
    return F.when(position > 0, position - 1)
