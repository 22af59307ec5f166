import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import rolling, sessions
from tessera.operators.calls import distinct_calls
from tessera.functions.paths import canonical_root

LOG = ("id string, timestamp timestamp_ntz, workspace_root string, workspace_name string, tool string, duration_ms bigint, est_tokens_saved bigint, est_tokens_saved_known boolean, "
       "us string, day string, n string, tools string")  # the last four clash with names used inside
T = dt.datetime(2026, 3, 1, 10, 0, 0)


def log(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], LOG)


def call(i, at=T, root="/w", name="w", tool="t", ms=1, saved=1, known=True):
    return (i, at, root, name, tool, ms, saved, known)


@given(st.lists(st.integers(-50, 50), max_size=40), st.integers(1, 9))
def test_two_stack_queue(values, n):
    q = rolling.TwoStackQueue(max, -1000)
    for i, v in enumerate(values):
        q.push(i, v)
        q.evict_before(i - n + 1)
        assert q.total() == max(values[max(0, i - n + 1): i + 1])


@given(st.sets(st.integers(0, 300), max_size=30), st.integers(1, 60))
def test_close_gaps(slots, gap):
    bits = sum(1 << s for s in slots)
    a, b = sessions.runs(sessions.close_gaps(bits, gap), 320)
    want, order = [], sorted(slots)
    for s in order:
        if want and s - want[-1][1] <= gap:
            want[-1][1] = s
        else:
            want.append([s, s])
    assert [[int(x), int(y)] for x, y in zip(a, b)] == want


def test_canonical_root(spark):
    cases = {"\\\\?\\d:\\work\\a\\": "D:/work/a", "d:/work//a/": "D:/work/a", "/srv/./a/././b/": "/srv/a/b", "/": "/", "  ": None, None: None, "": None, "./x": "x", "/Srv/A": "/Srv/A", "C:/work/a": "C:/work/a", "a/.": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "r string").select("r", canonical_root(__import__("pyspark").sql.functions.col("r")).alias("c"))
    assert {r.r: r.c for r in df.collect()} == cases


def test_rolling_by_brute_force(spark):
    rng = random.Random(1)
    rows = [call(f"i{k}", T + dt.timedelta(days=rng.randrange(70), hours=rng.randrange(10)), rng.choice(["/a", "/a/", "/b"]), saved=rng.choice([None, 0, 3, 50]), known=rng.choice([True, False, None])) for k in range(300)]
    rows += rows[:20] + [call("n1", None), call("n2", root=None), call("n3", root=" "), (None, T, "/a", "w", "t", 1, 9, True)]
    got = {(r.workspace_root, r.day): r for r in rolling.trailing_totals(log(spark, rows)).collect()}
    seen, days = set(), {}
    for r in rows:
        if r[0] is None or r[0] in seen or r[1] is None or not (r[2] or "").strip():
            continue
        seen.add(r[0])
        root, day = r[2].rstrip("/"), (r[1].date() - dt.date(1970, 1, 1)).days
        days.setdefault(root, {}).setdefault(day, []).append((r[6] or 0) if r[7] else None)
    n = 0
    for root, d in days.items():
        for day in range(min(d), max(d) + 1):
            n += 1
            for p in (7, 30):
                v = [x for k in range(day - p + 1, day + 1) for x in d.get(k, [])]
                known = [x for x in v if x is not None]
                r = got[root, day].asDict()
                assert (r[f"total_{p}d"], r[f"calls_{p}d"], r[f"greatest_{p}d"], r[f"average_{p}d"]) == (sum(known), len(v), max(known, default=None), sum(known) / p)
    assert n == len(got)


def test_copies_with_nulls_and_other_spellings_count_once(spark):
    rows = [call("a", root=None, saved=5), call("a", root="/w/", saved=5), call("a", root="/w", saved=None)]
    r = rolling.trailing_totals(log(spark, rows)).collect()
    assert len(r) == 1 and r[0].total_7d == 5 and r[0].calls_7d == 1


def test_sessions_by_brute_force(spark):
    rng = random.Random(2)
    rows, at = [], T
    for k in range(400):
        at += dt.timedelta(seconds=rng.choice([0, 1, 600, 1799, 1800, 1801, 4000]), microseconds=rng.choice([0, 0, 1, 500000]))
        rows.append(call(f"i{rng.randrange(10**6)}-{k}", at, rng.choice(["/a", "/b"]), tool=rng.choice(["x", "X ", "y-z", None])))
    rng.shuffle(rows)
    got = {r.first_id: r for r in sessions.sessions(log(spark, rows + rows[:30] + [call("n", None), call("m", root="")])).collect()}
    want = {}
    for root in ("/a", "/b"):
        open_ = []
        for r in sorted((r for r in rows if r[2] == root), key=lambda r: (r[1], r[0])):
            if open_ and r[1] - open_[-1][1] > dt.timedelta(minutes=30):
                want[min(open_, key=lambda r: (r[1], r[0]))[0]] = open_
                open_ = []
            open_.append(r)
        want[min(open_, key=lambda r: (r[1], r[0]))[0]] = open_
    assert set(got) == set(want)
    for k, calls in want.items():
        g = got[k]
        assert (g.session_start, g.session_end, g.calls) == (calls[0][1], calls[-1][1], len(calls))
        assert sum(t["calls"] for t in g.tool_calls) == len(calls)
        assert len(g.tool_calls) == len({None if c[4] is None else c[4].strip().lower().replace("-", "_") for c in calls})


def test_session_over_midnight_and_exact_pause(spark):
    m = dt.datetime(2026, 3, 1, 23, 50)
    rows = [call("a", m), call("b", m + dt.timedelta(minutes=30)), call("c", m + dt.timedelta(minutes=60, microseconds=1))]
    assert sorted(r.first_id for r in sessions.sessions(log(spark, rows)).collect()) == ["a", "c"]


@pytest.mark.parametrize("op", [rolling.trailing_totals, sessions.sessions])
def test_empty_log(spark, op):
    assert op(log(spark, [])).collect() == []


def test_distinct_calls_takes_the_known_value(spark):
    from pyspark.sql import functions as F

    d = distinct_calls(log(spark, [call("a", name=None), call("a", name="n")]), workspace_name=F.col("workspace_name"))
    assert [tuple(r) for r in d.collect()] == [("a", "n")]


settings.register_profile("quick", max_examples=60, deadline=None)
settings.load_profile("quick")
