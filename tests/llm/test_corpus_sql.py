"""Corpus queries with SQL give the same rows in Spark and in DuckDB; all others run, and none is without rows."""

import os

import pytest
from compare import same, views

from tessera.llm.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


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
    assert not df.isEmpty()


def test_sql_encodes_odd_texts(spark, tmp_path):
    """The SQL's own encoding agrees with the tokenizer on blanks, long runs and other scripts."""
    from tessera.llm import encode
    from test_encode import ODD

    rows = [(k, t, "s") for k, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert same(encode.encode(spark.read.parquet(str(tmp_path / "documents.parquet"))), views(str(tmp_path)), SQL["p8_ids"]) == ""
