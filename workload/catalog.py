"""Registry of queries and of the SQL texts they are checked against."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a (spark, sf_dir) -> DataFrame function, with its SQL if there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df, digits=6, skip=()):
    """Round double columns of a final result."""
    from pyspark.sql import functions as F

    doubles = {c: F.round(F.col(c), digits) for c, t in df.dtypes if t == "double" and c not in skip}
    return df.withColumns(doubles) if doubles else df
