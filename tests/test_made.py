"""Judgements of made calls: in place, and the same as claims() and decide() say of repeated calls and of calls of which a number is not known."""

import os

import duckdb
import pytest

from tessera.operators import evidence
from tessera.plans import core_queries, made

DATA = "/root/testdata/sf0.001"
JUDGED = ("made_claims", "made_verdicts", "made_rivals", "made_shadowed")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    folder = str(tmp_path_factory.mktemp("odd"))
    for name in ("supplier", "part", "orders", "nation"):
        duckdb.sql(f"COPY (FROM '{DATA}/{name}.parquet') TO '{folder}/{name}.parquet'")
    rows = f"FROM '{DATA}/lineitem.parquet' WHERE l_orderkey < 150"
    nulls = " UNION ALL ".join(f"(SELECT * REPLACE (NULL AS {n}) {rows} AND l_orderkey % 3 = {k % 3})" for k, n in enumerate(made._NUMBERS))
    duckdb.sql(f"COPY ((SELECT * {rows}) UNION ALL (SELECT * {rows} AND l_orderkey % 2 = 0) UNION ALL {nulls}) TO '{folder}/lineitem.parquet'")
    return folder


@pytest.mark.parametrize("name", JUDGED)
def test_calls_are_not_shuffled_by_site(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    df = core_queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().toString()
    assert "made_placed" in plan and "hashpartitioning(site" not in plan and "SortMergeJoin" not in plan
    assert df.count() > 0


def test_repeated_and_nameless_calls(spark, odd, rows):
    sites = made.calls(spark, odd)
    typed = evidence.receiver_types(sites, made._around(spark, odd), made._views(spark, odd, made._VARIABLES))
    claimed = core_queries()["made_claims"](spark, odd)
    assert rows(claimed) == rows(made._claims(spark, odd, sites, typed)) and claimed.where("site IS NULL").count() == 1
    assert rows(core_queries()["made_verdicts"](spark, odd)) == rows(made._verdicts(spark, odd, sites, typed))


def test_calls_of_which_numbers_are_not_known(spark, odd):
    calls = made.calls(spark, odd)
    assert calls.where("site IS NULL").count() == calls.where("site IS NULL").distinct().count() > 0
    named = calls.where("site IS NOT NULL")
    assert named.count() == named.select("site").distinct().count()
