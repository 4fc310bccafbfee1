"""A local session for tests, checks and the benchmark."""

import os

from pyspark.sql import SparkSession


def session(cpus=None, memory="12g"):
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shotspark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # larger methods are not compiled by the JVM; wide feature projections exceed that
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # no call sites in error messages; recording them for each column slows down plan building
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
