"""Stored features and labels, one directory per competition and season."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ["competition_id", "season_id"]


def write_features(df: DataFrame, games: DataFrame, path: str) -> None:
    """Store feature (and label) rows, partitioned by competition and season. Only the seasons
    that are written are replaced, so a store may grow season by season."""
    tagged = df.join(games.select("game_id", *PARTITIONS), "game_id")
    (
        tagged.write.partitionBy(*PARTITIONS)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def read_features(spark: SparkSession, path: str, pairs=None) -> DataFrame:
    """Read back all or the given (competition, season) pairs; others are pruned by directory.
    Directory names are read as text, so a season '0910' stays one."""
    found = spark.read.option("basePath", path).parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name in PARTITIONS else f for f in found]
    stored = spark.read.schema(T.StructType(fields)).option("basePath", path).parquet(path)
    if pairs is None:
        return stored
    wanted = F.lit(False)
    for competition, season in pairs:
        wanted = wanted | ((F.col(PARTITIONS[0]) == str(competition)) & (F.col(PARTITIONS[1]) == str(season)))
    return stored.filter(wanted)


def openplay_subset(features: DataFrame) -> DataFrame:
    return features.filter(F.col("type_id_a0") == "shot")
