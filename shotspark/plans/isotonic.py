"""Monotone regression on any number of distinct scores, without gathering them in one place.

Neighbouring values that fall are pooled into blocks. Pooling may be done in any order, so range
slices of the scores are pooled side by side, and the remaining blocks are dealt again with other
borders until no block falls below its neighbour. The blocks stay a table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotspark import scale
from shotspark.scale import SLICE, materialize, ordered_slices

_SCHEMA = "low double, high double, wy double, w double"


def _pool(batches):
    """Pool the ascending blocks of one slice; a falling step joins its blocks."""
    blocks: list[list[float]] = []
    for batch in batches:
        for block in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "wy", "w"))):
            low, high, wy, w = block
            while blocks and blocks[-1][2] * w >= wy * blocks[-1][3]:
                low, _, wy0, w0 = blocks.pop()
                wy, w = wy + wy0, w + w0
            blocks.append([low, high, wy, w])
    columns = np.array(blocks, float).reshape(-1, 4).T
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["low", "high", "wy", "w"])


def fit_blocks(rows: DataFrame) -> DataFrame:
    """Blocks (low, high, wy, w) of ``rows`` (s, label, w): ranges of scores with one level wy / w.
    Rows without a score are left out; rows of equal score act together."""
    s, w = F.col("s"), F.col("w")
    merged = rows.filter(s.isNotNull() & ~F.isnan(s)).groupBy("s").agg(F.sum(F.col("label") * w).alias("wy"), F.sum("w").alias("w"))
    blocks = materialize(merged.filter("w > 0").select(s.alias("low"), s.alias("high"), "wy", "w"), "blocks")
    turn = 0
    while True:
        # borders move from round to round, so what fell across one is pooled in the next
        slices = -(-blocks.count() // scale.CHUNK_ROWS) or 1
        dealt = blocks.repartitionByRange(slices + (turn % 2 if slices > 1 else 0), "low").sortWithinPartitions("low")
        blocks = materialize(
            dealt.mapInArrow(_pool, _SCHEMA).withColumn(SLICE, F.spark_partition_id()), "blocks"
        )
        level = F.col("wy") / F.col("w")
        ends = blocks.groupBy(SLICE).agg(
            F.min("low").alias("at"), F.min_by(level, "low").alias("first"), F.max_by(level, "low").alias("last")
        )
        ends = sorted(ends.select("at", "first", "last").collect())  # a row per slice
        blocks = blocks.drop(SLICE)
        if all(a["last"] < b["first"] for a, b in zip(ends, ends[1:])):
            return blocks
        turn += 1


def points_of(blocks: DataFrame) -> DataFrame:
    """(x, q): the ends of each block with its level; between them the fit is linear."""
    ends = F.array_distinct(F.array("low", "high"))
    return blocks.select(F.explode(ends).alias("x"), (F.col("wy") / F.col("w")).alias("q"))


def interpolate(df: DataFrame, points: DataFrame, score: str, output: str) -> DataFrame:
    """Add ``output``: the fit at ``score``. Distinct scores and points are sorted together; each
    score lies between the last point before and the first point behind it. NULL stays NULL."""
    scores = df.select(F.col(score).cast("double").alias("v")).filter("v is not null and not isnan(v)").distinct()
    none = F.lit(None).cast("struct<x: double, q: double>")
    both = points.select(F.col("x").alias("v"), F.lit(0).alias("kind"), F.struct("x", "q").alias("point")).unionByName(
        scores.select("v", F.lit(1).alias("kind"), none.alias("point"))
    )
    sliced = ordered_slices(both, ["v", "kind"])
    inside = Window.partitionBy(SLICE).orderBy("v", "kind")
    before = F.last("point", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first("point", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    # one row per slice: the nearest points in other slices
    order = Window.orderBy(SLICE)
    borders = sliced.groupBy(SLICE).agg(F.min("point").alias("low"), F.max("point").alias("high")).select(
        SLICE,
        F.last("high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("low", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    near = sliced.withColumns({"_a": before, "_b": behind}).filter("kind = 1").join(borders, SLICE).select(
        "v", F.coalesce("_a", "_earlier").alias("a"), F.coalesce("_b", "_later").alias("b")
    )
    a, b, v = F.col("a"), F.col("b"), F.col("v")
    value = (
        F.when(a.isNull(), b["q"])
        .when(b.isNull() | (a["x"] == v), a["q"])
        .otherwise(a["q"] + (b["q"] - a["q"]) * (v - a["x"]) / (b["x"] - a["x"]))
    )
    table = near.select(v.alias("_v"), value.alias(output))
    return df.join(table, F.col(score).cast("double") == F.col("_v"), "left").drop("_v")
