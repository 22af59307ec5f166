import random

import pytest

from tessera.operators import hierarchy

SCHEMA = "symbol_id string, parent_symbol_id string, file_id string, start_byte int, component string, chain string"


def table(spark, links):
    return spark.createDataFrame([(s, p, f, b, "clash", "clash") for s, p, f, b in links], SCHEMA)


def brute(links):
    parent = {}
    for s, p, *_ in links:
        if s is not None:
            parent[s] = parent.get(s) or (p if p and p.strip() else None)
    parent = {s: p if p in parent else None for s, p in parent.items()}
    out = {}
    for s in parent:
        line, x = [s], s
        while parent[x] is not None and parent[x] not in line:
            x = parent[x]
            line.append(x)
        if parent[x] is None:
            out[s] = (line[-1], len(line) - 1, line[::-1], None, False)
        else:
            ring = line[line.index(parent[x]):]
            out[s] = (None, None, None, min(ring), s in ring)
    return out


def forest(rng, n, files):
    links = []
    for k in range(n):
        p = rng.choice([None, "", "gone", f"s{rng.randrange(n)}", f"s{max(0, k - 1)}", f"s{max(0, k - 1)}"])
        links.append((f"s{k}", p, f"f{rng.randrange(files)}", rng.randrange(10**6)))
    return links + links[: n // 10] + [(s, None, f, b) for s, p, f, b in links[: n // 20]]


@pytest.mark.parametrize("bound", [hierarchy.MAX_COMPONENT, 3])
def test_against_brute_force(spark, bound):
    rng = random.Random(5)
    links = forest(rng, 150, 12) + [("self", "self", "f", 1), ("a", "b", "f", 1), ("b", "c", "g", 1), ("c", "a", "h", 1), ("below", "c", "z", 2), (None, "a", "f", 1)]
    got = {r.symbol_id: r for r in hierarchy.hierarchy(table(spark, links), bound).collect()}
    want = brute(links)
    assert set(got) == set(want)
    below = {s: 0 for s in want}
    for s, (_, _, chain, *_) in want.items():
        for a in (chain or [])[:-1]:
            below[a] += 1
    for s, (root, depth, chain, cycle, on) in want.items():
        r = got[s]
        assert (r.root_symbol_id, r.depth, r.chain, r.cycle_symbol_id, r.on_cycle) == (root, depth, chain, cycle, on), s
        assert r.descendants == (None if root is None else below[s])


def test_deep_chain_and_star(spark):
    deep = [(f"d{k:04}", f"d{k - 1:04}" if k else None, f"f{k % 7}", k) for k in range(700)]
    star = [("hub", None, "f", 0)] + [(f"leaf{k}", "hub", f"f{k % 5}", k) for k in range(2000)]
    for bound in (hierarchy.MAX_COMPONENT, 100):
        got = {r.symbol_id: r for r in hierarchy.hierarchy(table(spark, deep + star), bound).collect()}
        assert got["d0699"].depth == 699 and got["d0000"].descendants == 699 and got["hub"].descendants == 2000 and got["leaf7"].chain == ["hub", "leaf7"]


def test_large_circle_in_parts(spark):
    ring = [(f"r{k:03}", f"r{(k + 1) % 150:03}", f"f{k}", 0) for k in range(150)] + [("tail", "r003", "x", 0)]
    for bound in (hierarchy.MAX_COMPONENT, 10):
        got = hierarchy.hierarchy(table(spark, ring), bound).collect()
        assert {r.cycle_symbol_id for r in got} == {"r000"} and sum(r.on_cycle for r in got) == 150


def test_contraction_chunks(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "CHUNK_ROWS", 10)
    links = [(f"d{k:04}", f"d{k - 1:04}" if k else None, f"f{k // 3}", k) for k in range(90)]
    got = hierarchy.hierarchy(table(spark, links)).collect()
    assert max(r.depth for r in got) == 89


def test_descendants_and_empty(spark, rows):
    t = table(spark, [("a", None, "f", 0), ("b", "a", "f", 1), ("c", "b", "g", 2), ("x", "x", "g", 2)])
    assert rows(hierarchy.descendants(hierarchy.hierarchy(t))) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert hierarchy.hierarchy(table(spark, [])).collect() == []


def test_symbols_without_a_place(spark):
    links = [(f"s{k}", f"s{k - 1}" if k % 50 else None, None if k % 3 else "f", None) for k in range(300)]
    nodes = hierarchy.nodes_of(table(spark, links))
    assert nodes.where("window IS NULL OR file_id IS NULL").count() == 0 and nodes.select("window").distinct().count() > 200
    got = {r.symbol_id: (r.root_symbol_id, r.depth, r.chain, r.cycle_symbol_id, r.on_cycle) for r in hierarchy.hierarchy(table(spark, links)).collect()}
    assert got == brute(links)
