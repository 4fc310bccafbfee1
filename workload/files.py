"""JSON files in the layout of the providers, written from tables."""

import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(df: DataFrame, root: str, file, order: str, skip=()) -> None:
    """One indented array per file; ``file`` gives the path below ``root``, without ``.json``, and
    the unique ``order`` column the order of the records; it and the columns of ``skip`` are not
    written. Lines are streamed, so that no file is gathered in memory."""
    record = F.to_json(F.struct(*[c for c in df.columns if c != order and c not in skip]), {"pretty": "true"})
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
    store = hadoop.Path(root).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    write = _write_mounted if store.getScheme() == "file" else _write_stored
    write(df.select(file.alias("file"), F.col(order).alias("at"), record.alias("value")), root)


def _write_mounted(rows: DataFrame, root: str) -> None:
    """Tasks write each file of a mounted folder themselves, in one pass over the rows; a file appears when it is whole."""
    folder = re.sub(r"^file:/+", "/", root)

    def put(batches):
        name, out, part, files = None, None, None, 0

        def finish():
            out.write("\n]\n")
            out.close()
            os.replace(part, f"{folder}/{name}.json")

        for batch in batches:
            for own, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                if own == name:
                    out.write(",\n")
                else:
                    if out:
                        finish()
                    name, files = own, files + 1
                    top, last = os.path.split(f"{folder}/{name}")
                    os.makedirs(top, exist_ok=True)
                    part = f"{top}/.{last}-{uuid.uuid4().hex}"  # Spark reads no names with a dot in front
                    out = open(part, "w", encoding="utf-8", newline="\n")
                    out.write("[\n")
                out.write(value)
        if out:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    sorted_rows = rows.repartition("file").sortWithinPartitions("file", "at").select("file", "value")
    sorted_rows.mapInArrow(put, "files long").agg(F.sum("files")).collect()


def _write_stored(rows: DataFrame, root: str) -> None:
    """The same in a store that only Hadoop's file systems reach."""
    # the number of a file is no text, so that the writer keeps the order of the lines as it is
    rows = rows.withColumn("number", F.xxhash64("file"))
    ends = rows.groupBy("file", "number").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    body = rows.join(ends.drop("file"), "number").select(
        "number", "at", F.concat(F.col("value"), F.when(F.col("at") < F.col("high"), ",").otherwise("\n]")).alias("value")
    )
    body = body.unionByName(ends.select("number", (F.col("low") - 1).alias("at"), F.lit("[").alias("value")))
    folder = f"{root}/by-number"
    body.repartition("number").sortWithinPartitions("number", "at").select("number", "value").write.partitionBy("number").text(folder)
    # the writer names folders after the column; the providers' names are given afterwards
    names = {str(r["number"]): r["file"] for r in ends.select("file", "number").collect()}
    spark, hadoop = rows.sparkSession, rows.sparkSession._jvm.org.apache.hadoop.fs
    here = hadoop.Path(folder)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.globStatus(hadoop.Path(f"{folder}/number=*/part-*")):
        target = hadoop.Path(f"{root}/{names[part.getPath().getParent().getName().removeprefix('number=')]}.json")
        fs.mkdirs(target.getParent())
        fs.rename(part.getPath(), target)
    fs.delete(here, True)
