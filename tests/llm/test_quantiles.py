import datetime as dt
import random

import pytest
from tessera.llm import quantiles

LOG = "id string, timestamp timestamp_ntz, workspace_name string, tool string, duration_ms bigint, day string, n string, bucket string"  # the last three clash with names used inside
T = dt.datetime(2026, 3, 1, 10, 0, 0)


def log(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[3], r[4], r[5], "x", "y", "z") for r in rows], LOG)


def call(i, at=T, root="/w", name="w", tool="t", ms=1):
    return (i, at, root, name, tool, ms)


def test_percentiles_within_the_stated_error(spark):
    rng = random.Random(3)
    rows = [call(f"i{k}", T + dt.timedelta(days=k % 5), name=rng.choice(["p", None]), tool=rng.choice(["x", "Y"]), ms=rng.choice([0, -1, None, 2147483647, int(rng.paretovariate(0.5)), rng.randrange(100)])) for k in range(3000)]
    df = log(spark, rows + rows[:50])
    daily = quantiles.daily_sketches(df)
    got = quantiles.duration_percentiles(daily).collect()
    for r in got:
        v = sorted(x[5] for x in rows if x[5] is not None and x[5] >= 0 and x[5] != 2147483647 and (r.level == "workspace" or x[4].lower() == r.tool) and (r.level == "tool" or x[3] == r.workspace_name))
        assert r.n == len(v)
        for p in (50, 90, 95, 99):
            true = v[-(-p * len(v) // 100) - 1]
            assert abs(r[f"p{p}"] - true) <= r.max_relative_error * true
    assert {r.level for r in got} == {"tool", "workspace", "tool_workspace"} and len(got) == 2 + 2 + 4


def test_signed_sketch(spark):
    df = spark.createDataFrame([("k", float(x)) for x in (-100, -3, 0, 2, 50)] + [("k", None)], "k string, v double")
    r = quantiles.percentiles(quantiles.sketch(df, ["k"], "v"), ["k"], (0.2, 0.4, 0.6, 0.8, 1.0)).first()
    assert [round(r[c]) for c in ("p20", "p40", "p60", "p80", "p100")] == [-100, -3, 0, 2, 50]


def test_summaries_of_parts_add_up(spark):
    rng = random.Random(4)
    rows = [call(f"i{k}", T + dt.timedelta(days=k % 3), ms=rng.randrange(10**6)) for k in range(900)]
    whole = quantiles.duration_percentiles(quantiles.daily_sketches(log(spark, rows))).collect()
    parts = quantiles.daily_sketches(log(spark, rows[:300])).unionByName(quantiles.daily_sketches(log(spark, rows[300:])))
    assert sorted(map(tuple, quantiles.duration_percentiles(parts).collect()), key=repr) == sorted(map(tuple, whole), key=repr)


@pytest.mark.parametrize("op", [quantiles.daily_sketches, lambda d: quantiles.duration_percentiles(quantiles.daily_sketches(d))])
def test_empty_log(spark, op):
    assert op(log(spark, [])).collect() == []
