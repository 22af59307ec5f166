"""Every query with SQL gives the same rows in Spark and in DuckDB, on the smallest data."""

import os

import pytest
from compare import same, views

from tessera.plans import core_queries, core_sql

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = core_queries(), core_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return views(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        assert same(df, con, SQL[name]) == ""
    if df.isEmpty():  # a query that never gives a row would prove nothing
        assert not QUERIES[name](spark, DATA.replace("0.001", "0.01")).isEmpty()
