"""Small helpers that the operators share."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.scale import scratch_path

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` below the session's checkpoint folder and read it back; also the path."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def key_crc(column) -> F.Column:
    """Unsigned crc32 of a key written as text; null keys count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000):
    """Row ranges of a batch whose ``column`` holds about ``limit`` bytes, one row at least."""
    offsets = _offsets(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = start + 1
        while end < batch.num_rows and offsets[end + 1] - offsets[start] <= limit:
            end += 1
        yield batch.slice(start, end - start)
        start = end


def _offsets(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    out = [0]
    for s in sizes:
        out.append(out[-1] + s)
    return out
