import pytest
from odd_rows import ODD
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with further columns whose names clash with those of the operators."""

    def make(rows):
        schema = T.StructType(
            [
                T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                T.StructField("ids", T.StringType()), T.StructField("row", T.LongType()),
                T.StructField("score", T.DoubleType()), T.StructField("n_chars", T.LongType()),
            ]
        )
        return spark.createDataFrame([(i, t, "x", 1, 0.5, 3) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)
