"""Helpers that keep ordered work distributed when one key holds a large share of the rows.

A window with ``partitionBy(key)`` sorts every row of a key in one task. That is the
right plan for ordinary keys. Keys with more than ``HOT_ROWS`` rows are counted out
first and take another way: their rows are range-partitioned by key and order together,
so that one key spreads over many slices, and what crosses a slice border is carried in a
small table (one row per slice and key).
"""

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000  # rows of one key that a single task may sort
CHUNK_ROWS = 100_000  # rows of a hot key handled together after numbering

_local_folders: list = []  # temporary folders of local sessions, removed at exit

SLICE = "_slice"
POS = "_pos"


def shared_folder(spark: SparkSession) -> str:
    """The folder for materialised intermediates: the session's checkpoint folder.

    Only a local session without one gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    _local_folders.append(tempfile.TemporaryDirectory(prefix="shotspark-", ignore_cleanup_errors=True))
    sc.setCheckpointDir(_local_folders[-1].name)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, survives lost
    executors, and columns that are generated during execution (slice numbers) stay fixed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same_keys(df: DataFrame, other: DataFrame, keys) -> tuple[DataFrame, F.Column]:
    """``other`` with its key columns renamed, and the condition that the keys are equal; NULL
    keys equal each other."""
    renamed = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    return renamed, reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_other_{k}"]) for k in keys])


# --- hot keys ---------------------------------------------------------------------------


def hot_keys(df: DataFrame, keys, hot_rows: int | None = None) -> DataFrame | None:
    """Keys (also NULL) with more than ``hot_rows`` rows, or None; the counting reads the key
    columns only."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    table = materialize(df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys), "hot-keys")
    return None if table.isEmpty() else table


def split_hot(df: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, rows of hot keys. How the list is joined is left to the optimizer,
    which knows its size."""
    other, same = same_keys(df, hot, hot.columns)
    return df.join(other, same, "left_anti"), df.join(other, same, "left_semi")


def ordered_slices(df: DataFrame, by, partitions: int | None = None) -> DataFrame:
    """Range-partition by ``by`` and record the slice number; slices are in order of ``by`` and
    hold CHUNK_ROWS rows on average, so a slice does not grow with the table."""
    count = partitions or df.count() // CHUNK_ROWS + 1
    return materialize(
        df.repartitionByRange(count, *by).withColumn(SLICE, F.spark_partition_id()), "slices"
    )


def prefix_sums(df: DataFrame, by, sums: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Add ``{new: column}`` exclusive running totals over the whole table in order of ``by``
    (which must be unique). No task sees more than one slice."""
    sliced = ordered_slices(df, by, partitions)
    # one row per slice, so the window without partition is over few rows
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(SLICE)
        .agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
        .select(SLICE, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    )
    inside = Window.partitionBy(SLICE).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.join(offsets, SLICE)
        .withColumns({n: F.col(f"_o_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
        .drop(SLICE, *[f"_o_{n}" for n in sums])
    )


# --- numbering --------------------------------------------------------------------------


def _number_sliced(df: DataFrame, keys, order, name: str) -> DataFrame:
    sliced = ordered_slices(df, [*keys, *order])
    # a key has one row per slice it touches
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, SLICE)
        .agg(F.count("*").alias("_n"))
        .select(*keys, SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    other, same = same_keys(sliced, offsets, [*keys, SLICE])
    return (
        sliced.join(other, same)
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .select(*df.columns, name)
    )


def number_rows(df: DataFrame, keys, order, name: str, hot: DataFrame | None = None) -> DataFrame:
    """0-based position of a row within its key. ``order`` must be unique within the key;
    ``hot`` is the result of ``hot_keys`` on a subset of ``keys``."""

    def windowed(part):
        w = Window.partitionBy(*keys).orderBy(*order)
        return part.withColumn(name, (F.row_number().over(w) - 1).cast("long"))

    if hot is None:
        return windowed(df)
    cold, wide = split_hot(df, hot)
    return windowed(cold).unionByName(_number_sliced(wide, keys, order, name))


def number_all(df: DataFrame, order, name: str) -> DataFrame:
    """0-based position in the whole table, in order of the (unique) ``order`` columns."""
    return prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}).drop("_one")


def chunked(df: DataFrame, keys, order, halo: int = 0) -> DataFrame:
    """Rows of hot keys with their position and a ``_chunk`` of at most CHUNK_ROWS positions.
    With ``halo`` the last rows of a chunk are repeated at the head of the next one, where
    ``_home`` is false for them."""
    numbered = _number_sliced(df, keys, order, POS)
    own = F.floor(F.col(POS) / F.lit(CHUNK_ROWS))
    if not halo:
        return numbered.withColumn("_chunk", own)
    chunks = F.when(F.col(POS) % CHUNK_ROWS >= CHUNK_ROWS - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return numbered.withColumn("_chunk", F.explode(chunks)).withColumn("_home", F.col("_chunk") == own)


# --- distribution of values -------------------------------------------------------------


def exact_quantiles(df: DataFrame, column: str, probs) -> list[float]:
    """Linear-interpolated quantiles. Equal values are counted together, the counts are
    summed in order of the value, and only the two rows around each rank are collected."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    ranked = materialize(prefix_sums(counted, [column], {"_before": "_n"}), "ranks")
    return quantiles_of_ranks(ranked, column, probs)


def quantiles_of_ranks(ranked: DataFrame, column: str, probs) -> list[float]:
    """The same for distinct values with their number ``_n`` and the number ``_before`` them."""
    total = ranked.agg(F.sum("_n")).first()[0]
    if not total:
        raise ValueError(f"no values in {column}")
    spots = [(total - 1) * q for q in probs]
    ranks = sorted({int(s) for s in spots} | {min(int(s) + 1, total - 1) for s in spots})
    hit = F.exists(
        F.array(*[F.lit(r) for r in ranks]),
        lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_n")),
    )
    found = sorted((r["_before"], r["_n"], r[column]) for r in ranked.filter(hit).collect())

    def at(rank):
        return next(v for before, n, v in found if before <= rank < before + n)

    out = []
    for s in spots:
        low, high = at(int(s)), at(min(int(s) + 1, total - 1))
        out.append(float(low) + (float(high) - float(low)) * (s - int(s)))
    return out
