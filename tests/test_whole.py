"""Queries over all of their tables, against brute force and the SQL of the narrower query without its filter."""

import os

import pytest
from compare import same, views

from tessera.plans import core_queries, core_sql

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return views(DATA)


def test_ancestor_chains_of_all_languages(spark, con):
    from tessera.plans import facts

    df = core_queries()["ancestor_chain"](spark, DATA)
    up = {r.symbol_id: r.parent_symbol_id for r in facts.symbols(spark, DATA).collect()}
    want = []
    for start in up:
        at, depth = up[start], 1
        while at in up and depth <= 31:
            want.append((start, at, depth))
            if at == start:
                break
            at, depth = up[at], depth + 1
    assert sorted(tuple(r) for r in df.select("symbol_id", "ancestor_id", "depth").collect()) == sorted(want)


def test_calls_take_the_first_identifier_left(spark):
    import random

    from tessera.operators import report

    rng = random.Random(6)
    edges, uses, want = [], [], set()
    for c in range(60):
        end = rng.choice([None, 12, 20])
        e = sorted((rng.randrange(20), f"e{c}-{k:02}") for k in range(rng.randrange(8)))
        u = sorted((rng.randrange(25), f"u{c}-{k:02}") for k in range(rng.randrange(8)))
        edges += [(i, f"c{c}", "n", line, end) for line, i in e]
        uses += [(i, f"c{c}", "n", line) for line, i in u]
        left = list(u)
        for line, i in e:
            last = max(end, line) if end is not None else 99
            hit = next((x for x in left if line <= x[0] <= last), None)
            if hit:
                left.remove(hit)
                want.add((i, hit[1]))
    got = report.pair_greedily(spark.createDataFrame(edges, "edge string, caller string, name string, line int, caller_end int"), spark.createDataFrame(uses, "use string, caller string, name string, line int")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_search_finds_words_outside_the_two_rarest(spark):
    from tessera.operators import lookup

    cols = "symbol_id string, name string, kind string, signature string, doc_comment string"
    s = spark.createDataFrame([("a", "parseConfigFile", "function", None, None), ("b", "readThing", "function", None, "parse the config of a file"), ("c", "parsedLine", "function", None, None),
                               ("d", "reparsed", "function", None, None), ("e", "fileConfigOther", "function", None, None), ("f", "alone", "function", None, None), ("g", None, "function", "parse(x)", None)], cols)
    q = spark.createDataFrame([("parseConfigFile",), ("parsing",)], "query string")
    found = {(r.query, r.symbol_id): r.score for r in lookup.search_all_fields(s, q).collect()}
    assert {i for x, i in found if x == "parseConfigFile"} == {"a", "b", "c", "d", "e", "g"}
    assert {i for x, i in found if x == "parsing"} == {"a", "c"}  # by stem alone
    import math

    w = {"parse": math.log1p(7 / 4), "config": math.log1p(7 / 4), "file": math.log1p(7 / 4)}  # each in three symbols
    assert found["parseConfigFile", "a"] == pytest.approx(3 * sum(w.values()) + 160, abs=1e-5)
    assert found["parseConfigFile", "b"] == pytest.approx(sum(w.values()), abs=1e-5)
    assert found["parseConfigFile", "c"] == pytest.approx(2 * w["parse"], abs=1e-5)
    assert found["parseConfigFile", "d"] == pytest.approx(w["parse"], abs=1e-5)
    assert {r.symbol_id for r in lookup.search(s, q).where("query = 'parseConfigFile'").collect()} < {"a", "b", "c", "d", "e", "g"}


def test_files_within_two_edits(spark):
    import random

    from tessera.operators import lookup

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(3)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    stems = {"a", "ab", "main", "mian", "aaaaaaaaaa", "aaaaaaaaaaaa", "configuration_loader", "configuraton_laoder"} | {word(r.randint(1, 14)) for _ in range(150)}
    asked = {"b", "maim", "aaaaaaaaaab", "bbbbbbbbbb", "configuration_lodr"} | {word(r.randint(1, 14)) for _ in range(60)}
    files = spark.createDataFrame([(f"src/{s}.py",) for s in sorted(stems)], "path string")
    want = {(f"lib/{a}.py", f"src/{s}.py", distance(a, s)) for a in asked for s in stems if distance(a, s) <= 2}
    got = lookup.near_files(files, spark.createDataFrame([(f"lib/{a}.py",) for a in sorted(asked)], "asked string")).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
