"""Aggregates over predictions and feature tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_players(xg: DataFrame, players: DataFrame, n: int = 10) -> DataFrame:
    """Players with the largest sum of xG; ``xg`` holds player_id and xG, for example from
    ``model.score(data, keep=["player_id"])``."""
    totals = xg.groupBy("player_id").agg(F.sum("xG").alias("xG"))
    named = totals.join(players.select("player_id", "player_name"), "player_id", "left")
    return named.orderBy(F.desc("xG"), "player_id").limit(n)


def shapes(df: DataFrame, by: str, ignore=()) -> DataFrame:
    """Rows per value of ``by`` and the number of columns."""
    columns = len([c for c in df.columns if c not in ignore])
    return df.groupBy(by).agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(columns))
