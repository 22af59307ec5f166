import pytest
from pyspark.sql import functions as F

from tessera.functions import names, stem
from tessera.functions.paths import folder, normal_path, shared_segments
from tessera.operators import diff, lookup, report, scan, walk

SYM = "symbol_id string, name string, kind string, path string, start_line int, is_test boolean, parent_symbol_id string, visibility string, seed string, depth int"


def symbols(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r)), "clash", 9) for r in rows], SYM)


def fn(i, name=None, kind="function", path="a.py", line=1, test=False, parent=None, vis=None):
    return (i, name or i, kind, path, line, test, parent, vis)


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed string")


def test_walk_over_hops_with_tests(spark, rows):
    s = symbols(spark, fn("base"), fn("service"), fn("api"), fn("test_base", test=True))
    e = edges(spark, ("service", "base"), ("api", "service"), ("test_base", "base"), ("api", "service"), (None, "base"), ("x", None))
    got = rows(walk.impact(e, s, seeds(spark, "base"), 3).select("symbol_id", "depth", "is_test", "reason", "place"))
    assert got == [("api", 2, False, "indirect caller [depth 2]", 2), ("service", 1, False, "direct caller", 1), ("test_base", 1, True, "direct caller", 1)]


def test_walk_on_a_cycle_and_depth_clamp(spark, rows):
    e = edges(spark, ("a", "b"), ("b", "a"))
    assert rows(walk.reach(e, seeds(spark, "a", "a"), 2)) == [("a", "b", 1)]
    assert [walk.clamp_depth(d) for d in (0, 1, 100)] == [2, 1, 5]
    assert walk.reach(e, seeds(spark), 2).count() == 0


def test_walk_flags(spark):
    s = symbols(spark, *[fn(x) for x in "abcd"], fn("test_b", test=True), fn("test_dd", test=True))
    e = edges(spark, ("b", "a"), ("c", "b"), ("d", "c"), ("test_b", "b"), ("test_dd", "d"))
    f = walk.impact_flags(e, s, seeds(spark, "a"), 2, 1).first()
    assert (f.impacted, f.tests, f.impacted_truncated, f.tests_truncated, f.stopped_at_depth, f.tests_past_depth, f.ceiling_reached) == (2, 1, True, False, 2, 1, False)


@pytest.mark.parametrize("n, reached", [(200, False), (201, True)])
def test_ceiling(spark, n, reached):
    s = symbols(spark, fn("a"), *[fn(f"c{k}") for k in range(n)])
    e = edges(spark, *[(f"c{k}", "a") for k in range(n)])
    assert walk.impact_flags(e, s, seeds(spark, "a"), 1).first().ceiling_reached is reached
    assert walk.impact(e, s, seeds(spark, "a"), 1, 500).count() == 200


def test_low_signal_kinds_are_hidden(spark):
    s = symbols(spark, fn("a"), fn("f", kind="field"), fn("g"))
    e = edges(spark, ("f", "a"), ("g", "a"))
    assert walk.impact(e, s, seeds(spark, "a"), 1).count() == 1 and walk.impact(e, s, seeds(spark, "a"), 1, low_signal=True).count() == 2


def test_ancestors_locals_and_hidden(spark, rows):
    s = symbols(spark, fn("m", kind="module"), fn("c", kind="class", parent="m", vis="private"), fn("f", parent="c"), fn("v", kind="variable", parent="f"), fn("w", kind="variable", parent="v"),
                fn("g", kind="variable", parent="m"), fn("x", kind="variable", parent="x"), fn("o", parent="gone"))
    up = walk.ancestors(s)
    assert ("w", "m", 4) in rows(up) and ("x", "x", 1) in rows(up) and not [r for r in rows(up) if r[0] == "o"]
    assert rows(walk.local_variables(s)) == [("v",), ("w",)]
    assert rows(walk.hidden_symbols(s, up)) == [("c",), ("f",), ("v",), ("w",)]
    assert rows(walk.namespace_of(up, s)) == []
    n = symbols(spark, fn("n1", kind="namespace", path="a"), fn("n2", kind="namespace", parent="n1", path="a"), fn("k", kind="class", parent="n2", path="a"), fn("free", path="a"), fn("n3", kind="namespace", path="b"), fn("alone", path="b"))
    assert rows(walk.namespace_of(walk.ancestors(n), n)) == [("alone", "n3"), ("k", "n2"), ("n1", "n1"), ("n2", "n2"), ("n3", "n3")]
    deep = symbols(spark, fn("top"), *[fn(f"d{k}", kind="variable", parent=f"d{k - 1}" if k else "top") for k in range(70)], fn("r1", kind="variable", parent="r2"), fn("r2", kind="variable", parent="r1"))
    assert walk.local_variables(deep).count() == 70


def test_paths_and_names(spark):
    df = spark.createDataFrame([("A\\b/C.py", "a/b/c.py")], "p string, q string")
    r = df.select(folder("p" and F.col("p")).alias("f"), normal_path(F.col("p")).alias("n"), shared_segments(F.lit("a/b/x"), F.lit("a/b/c/y")).alias("s"), shared_segments(F.lit("x"), F.lit("y")).alias("z"),
                  names.tokens(F.lit("parseSha256Sidecar_HTTPServer")).alias("t"), scan.excluded(F.lit("x/node_modules/y.js")).alias("e"), scan.excluded(F.lit("x/nodes/y.min.js")).alias("m"), scan.excluded(F.lit("x/y.js")).alias("o"),
                  names.is_test_path(F.lit("a/tests/b.py")).alias("t1"), names.is_test_path(F.lit("a/FooTests.cs")).alias("t2"), names.is_test_path(F.lit("a/contests.py")).alias("t3")).first()
    assert (r.f, r.n, r.s, r.z) == ("A\\b", "a/b/c.py", 2, 0)
    assert r.t == ["parse", "sha", "256", "sidecar", "http", "server"]
    assert (r.e, r.m, r.o, r.t1, r.t2, r.t3) == (True, True, False, True, True, False)


def test_whole_words(spark, rows):
    texts = ["get", "target", "x.get()", "get_all", "$get", "forget", "a get b get", "Get", "get1"]
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(texts)] + [("f", 1, "get"), ("g", 1, None)], "path string, line int, text string")
    assert rows(scan.find_word(lines, "get")) == [("f", 1), ("f", 3), ("f", 7)]


def test_slices(spark):
    t = spark.createDataFrame([("f", "é = 1\r\nzwei\ndrei")], "file_id string, content string")
    s = spark.createDataFrame([("a", "f", 0, 6, 1, 1), ("b", "f", None, None, 2, 3), ("c", "g", 0, 1, 1, 1)], "symbol_id string, file_id string, start_byte int, end_byte int, start_line int, end_line int")
    assert {r.symbol_id: r.text for r in scan.symbol_text(s, t).collect()} == {"a": "é = 1", "b": "zwei\ndrei"}


def test_reconcile(spark, rows):
    disk = spark.createDataFrame([("new", 1, "h", 5), ("same", 2, "h", 5), ("big", 3, "h", 5), ("hash", 4, "x", 5), ("skip", 9, "h", 7), ("skip2", 9, "h", 8)], "path string, bytes bigint, hash string, mtime_ns bigint")
    files = spark.createDataFrame([("same", 2, "h"), ("big", 2, "h"), ("hash", 4, "h"), ("gone", 1, "h"), ("locked/x", 1, "h")], "path string, content_bytes bigint, content_hash string")
    skipped = spark.createDataFrame([("skip", 9, 7), ("skip2", 9, 7)], "path string, content_bytes bigint, mtime_ns bigint")
    assert rows(scan.reconcile(disk, files, skipped, ("locked",))) == [("big", "modified"), ("gone", "deleted"), ("hash", "modified"), ("new", "added"), ("skip2", "added")]


def test_lookup(spark, rows):
    s = symbols(spark, fn("1", "Parse"), fn("2", "parse_file"), fn("3", "reparse"), fn("4", "other"), fn("5", None), fn("6", "p"))
    q = spark.createDataFrame([("parse",), ("p",), ("nothing",), ("",), (None,)], "query string")
    assert rows(lookup.by_name(s, q)) == [("p", "1", "prefix", 2), ("p", "2", "prefix", 3), ("p", "3", "contains", 4), ("p", "6", "exact", 1), ("parse", "1", "exact", 1), ("parse", "2", "prefix", 2), ("parse", "3", "contains", 3)]


def test_qualified_and_suggestions(spark, rows):
    s = symbols(spark, fn("o", "Outer", "class"), fn("i", "Inner", "class", parent="o"), fn("r", "run", parent="i"), fn("r2", "run"))
    q = spark.createDataFrame([("Outer::Inner::run",), ("Inner.run",), ("Bogus::Inner::run",), ("run",)], "query string")
    assert rows(lookup.qualified(s, q)) == [("Inner.run", "r", 1), ("Outer::Inner::run", "r", 1)]
    known = symbols(spark, fn("a", "format_symbol_body"), fn("b", "format_symbol_outline"))
    asked = spark.createDataFrame([("format_sybmol_body",), ("format_symbol_body",)], "asked string")
    assert rows(lookup.suggestions(known, asked)) == [("format_sybmol_body", "format_symbol_body", 2)]


def test_routes(spark, rows):
    f = spark.createDataFrame([("/api/users/{id}",), ("server.port",), ("/health",)], "fact string")
    q = spark.createDataFrame([("/users/:id",), ("port",), ("/nope",)], "query string")
    assert rows(lookup.routes(f, q)) == [("/users/:id", "/api/users/{id}"), ("port", "server.port")]


def test_porter_stems():
    # fixed values: examples of the published algorithm
    for a, b in {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "sized": "size", "hopping": "hop", "falling": "fall",
                 "happy": "happi", "sky": "sky", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "controlling": "control", "probate": "probat", "cease": "ceas"}.items():
        assert stem.stem(a) == b


def test_arity_and_merge_access(spark):
    sig = {"a": "def f(self, x, y=1)", "b": "fn g(&self, a: &str) -> R", "c": "def h(*args)", "d": "function k(a: string, b?: number)", "e": "int m()", "n": None, "v": "value"}
    s = spark.createDataFrame([(k, "n", "f", "function", None, v) for k, v in sig.items()], "symbol_id string, name string, file_id string, kind string, parent_symbol_id string, signature string")
    got = {r.symbol_id: (r.least, r.most) for r in report.arity(s).collect()}
    assert got == {"a": (1, 2), "b": (1, 1), "c": (0, None), "d": (1, 2), "e": (0, 0)}
    g = report.arity_of_groups(report.arity(s), s).first()
    assert (g.least, g.most, g.members) == (0, None, 5)
    r = spark.range(1).select(*[report.merge_access(F.array(*map(F.lit, x)).cast("array<string>")).alias(n) for n, x in (("a", [None]), ("b", ["read", "read"]), ("c", ["read", "write"]))]).first()
    assert tuple(r) == (None, "read", "read_write")


def test_nearest_owner_refuses_ties(spark, rows):
    o = spark.createDataFrame([("x", "n", "a/b"), ("y", "n", "a/c"), ("z", "n", "q")], "owner_id string, name string, folder string")
    w = spark.createDataFrame([("1", "n", "a/b/d"), ("2", "n", "a/d"), ("3", "m", "a"), ("4", "n", "q/r")], "id string, name string, folder string")
    assert rows(report.nearest_owner(w, o)) == [("1", "x"), ("4", "z")]


def test_page_limits(spark):
    df = spark.range(5)
    assert [tuple(r) for r in report.page(df, ["id"], 1, 2).collect()] == [(1, 5), (2, 5)] and report.page(df, ["id"], 0, 0).count() == 0
    with pytest.raises(ValueError):
        report.page(df, ["id"], 0, 201)


SNAP = "symbol_id string, path string, owner string, kind string, name string, signature string, visibility string, body_hash string, start_line int, start_byte int"


def snap(spark, *rows):
    return spark.createDataFrame([(i, "p", "", "function", n, s, None, h, k, k) for k, (i, n, s, h) in enumerate(rows)], SNAP)


def test_a_new_overload_shifts_no_other(spark, rows):
    b = snap(spark, ("b1", "f", "f(int a)", "x"), ("b2", "f", "f(str a)", "y"))
    c = snap(spark, ("c0", "f", "f(bool z)", "z"), ("c1", "f", "f(int a)", "x"), ("c2", "f", "f(str a)", "y"))
    assert rows(diff.pair(b, c)) == [("b1", "c1"), ("b2", "c2"), (None, "c0")]


def test_renames_need_a_unique_body(spark, rows):
    b = snap(spark, ("b1", "old", "(a)", "h1"), ("b2", "one", "()", "h2"), ("b3", "two", "()", "h2"), ("b4", "same", "(x)", "h4"))
    c = snap(spark, ("c1", "new", "(a)", "h1"), ("c2", "uno", "()", "h2"), ("c4", "same", "(y)", "h4"))
    p = diff.pair(b, c)
    assert rows(diff.renames(b, c, p)) == [("b1", "c1")]
    assert rows(diff.changes(b, c, p)) == [("b4", "c4", "signature")]
    assert diff.pair(snap(spark), snap(spark)).count() == 0


def test_imports(spark, rows):
    from tessera.operators import imports

    lines = spark.createDataFrame([("p/a.py", "import b"), ("p/b.py", "from x import y"), ("p/c.ts", "import { q } from './d';"), ("p/e.rs", "use crate::f;"), ("p/g.c", '#include "x/h.h"'), ("p/i.cs", "using App.J;"), ("p/k", None)], "path string, text string")
    assert rows(imports.imported_stems(lines)) == [("p/a.py", "b"), ("p/c.ts", "d"), ("p/e.rs", "f"), ("p/g.c", "h"), ("p/i.cs", "j")]
    files = spark.createDataFrame([("p/a.py",), ("p/sub/b.py",), ("q/b.py",)], "path string")
    e = imports.import_edges(spark.createDataFrame([("p/a.py", "b")], "path string, stem string"), files)
    assert rows(e) == [("p/a.py", "p/sub/b.py")]
    chain = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))
    assert rows(imports.follow_imports(chain, seeds(spark, "a"), 4, 2)) == [("a", "b", 1), ("a", "c", 2)]


def test_types_and_overrides(spark, rows):
    from tessera.operators import imports

    t = spark.createDataFrame([("1", "Base", "class", "class Base"), ("2", "Sub", "class", "class Sub extends Base implements Odd"), ("3", "Leaf", "class", "public class Leaf : Sub"), ("4", "Odd", "class", ""), ("5", "Odd", "class", None)], "symbol_id string, name string, kind string, signature string")
    e = imports.type_edges(t)
    assert rows(e) == [("2", "1"), ("3", "2")]
    above = imports.hierarchy(e, seeds(spark, "3"))
    assert rows(above) == [("3", "1", 2), ("3", "2", 1)]
    m = spark.createDataFrame([("m1", "run", "1"), ("m2", "run", "2"), ("m3", "run", "3"), ("m4", "stop", "3")], "symbol_id string, name string, owner_id string")
    assert rows(imports.overrides(m, above)) == [("m3", "m2", 1)]


def test_placing_and_small_reports(spark, rows):
    j = spark.createDataFrame([("p", 1, "n", "proven", "t"), ("p", 9, "n", "proven", "t"), ("q", 1, "m", "likely", "t")], "path string, line int, name string, label string, target string")
    h = spark.createDataFrame([("p", 1, 3), ("p", 2, 4)], "path string, start_line int, end_line int")
    placed = report.place_sites(j, h)
    assert sorted(r.place for r in placed.collect()) == ["in_diff", "likely", "proven"] and rows(report.blocking(placed)) == [("t", "p", 9, 1)]
    f = spark.createDataFrame([("sql.select",), ("sql.select",), ("route/get",), ("odd",)], "pattern_id string")
    assert rows(report.fact_counts(f, {"sql": "sql", "route": "routes"})) == [("odd", 1, 1), ("routes", 1, 1), ("sql", 1, 2)]
    assert rows(report.uncovered(spark.createDataFrame([("go",), ("go",)], "language string"), {"go": "x", "r": "y"})) == [("go", "x")]
    assert spark.range(1).select(report.is_lambda_name(F.lit("lambda_12")).alias("a"), report.is_lambda_name(F.lit(None).cast("string")).alias("b")).first() == (True, False)


def test_logs(spark, rows, tmp_path):
    from tessera.sources import log

    p = f"file://{tmp_path}/log"
    schema = "workspace_root string, session_id string, diff_hash string, timestamp int, followed boolean, base string"
    for r in (("w", "s", "d", 1, None, "b1"), ("w", "s", "d", 2, None, "b2"), ("w", "s", "e", 1, None, None)):
        log.append(spark.createDataFrame([r], schema), p)
    checks = spark.read.parquet(p)
    got = log.follow_up(checks, spark.createDataFrame([("w", "s", "d")], "workspace_root string, session_id string, diff_hash string"))
    assert sorted((r.diff_hash, r.timestamp, r.followed) for r in got.collect()) == [("d", 2, True), ("e", 1, False)]
    assert rows(log.session_base(checks)) == [("s", "b2")]


def test_search_and_stop_words(spark):
    s = spark.createDataFrame([("1", "parse_config", "function", "def parse_config()", None), ("2", "ParseConfigFile", "class", None, "Reads it."), ("3", "config_parse_all", "function", None, None), ("4", "other", "function", "parse config", None), ("5", None, "function", None, None)],
                              "symbol_id string, name string, kind string, signature string, doc_comment string")
    q = spark.createDataFrame([("parse config",), ("how to parse the config",), ("zzz",), ("",), (None,), ("all",)], "query string")
    got = lookup.search(s, q).orderBy("query", "place").collect()
    assert [r.symbol_id for r in got if r["query"] == "parse config"] == ["1", "2", "3"] and [r.symbol_id for r in got if r["query"] == "all"] == ["3"]
    assert {r["query"] for r in got} >= {"parse config", "all"} and not [r for r in got if r["query"] in ("zzz", "")]
