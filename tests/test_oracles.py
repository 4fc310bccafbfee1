"""Every query that has an SQL text agrees with it; every other one returns rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.check import compare, duck

# searches fit dozens of models and have their own tests
SLOW = {n for n in queries() if n.startswith(("search_", "regress_"))}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_sql(spark, sf, con, name):
    problem, _rows = compare(con, queries()[name](spark, sf), oracle_sql()[name])
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_query_returns_rows(spark, sf, name):
    assert queries()[name](spark, sf).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["player_id", "xG", "player_name"] and 0 < df.count() <= 10
