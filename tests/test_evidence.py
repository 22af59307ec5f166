import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence, imports, walk

SYM = "symbol_id string, name string, kind string, path string, language string, parent_symbol_id string, start_line int, end_line int, signature string, site string, n string"
SITE = "site string, from_symbol_id string, name string, path string, language string, receiver string, namespace array<string>, args int, owner string"


def table(spark, *rows):
    """symbols: (id, name, kind, path, language, parent); two columns clash with names used inside."""
    return spark.createDataFrame([(*r, 1, 9, None, "clash", "clash") for r in rows], SYM)


def sites(spark, *rows):
    """(site, from, name, path, language, receiver, namespace, args)"""
    return spark.createDataFrame([(*r, "clash") for r in rows], SITE)


@pytest.fixture(scope="module")
def code(spark):
    s = table(spark,
              ("A", "Alpha", "class", "p/a.py", "python", None), ("A.run", "run", "method", "p/a.py", "python", "A"), ("A.go", "go", "method", "p/a.py", "python", "A"),
              ("B", "Beta", "class", "p/b.py", "python", None), ("B.stop", "stop", "method", "p/b.py", "python", "B"), ("B.run", "run", "method", "p/b.py", "python", "B"),
              ("f", "free", "function", "p/a.py", "python", None), ("g", "outer", "function", "p/c.py", "python", None), ("h", "inner", "function", "p/c.py", "python", "g"),
              ("J", "Jay", "class", "q/J.java", "java", None), ("J.m", "make", "method", "q/J.java", "java", "J"), ("J.c", "callIt", "method", "q/J.java", "java", "J"),
              ("G1", "shared", "function", "r/x.go", "go", None), ("G2", "user", "function", "r/y.go", "go", None), ("far", "lonely", "function", "z/far.py", "python", None),
              ("t1", "twice", "function", "p/u.py", "python", None), ("t2", "twice", "function", "p/v.py", "python", None), ("nul", None, "function", None, None, None))
    types = s.where("kind = 'class'").select("symbol_id", "name")
    edges = spark.createDataFrame([("A", "B"), ("B", "A")], "src string, dst string")  # a circle
    pending = spark.createDataFrame([("J", "Gone"), ("J", "Alpha")], "src string, name string")
    around = evidence.scopes(walk.ancestors(s), s)
    above = evidence.ancestor_names(edges, pending, types)
    return s, around, above


def test_ancestor_names(code, rows):
    assert rows(code[2].where("symbol_id = 'A'")) == [("A", "Alpha", 0), ("A", "Beta", 1)]
    assert rows(code[2].where("symbol_id = 'J'")) == [("J", "Alpha", 1), ("J", "Beta", 2), ("J", "Gone", 1), ("J", "Jay", 0)]


CASES = [
    (("qualified", "g", "run", "p/c.py", "python", None, ["Alpha"], None), "qualified path", "A.run"), (("module path", "g", "lonely", "p/c.py", "python", None, ["some"], None), "qualified path", "far"),
    (("self", "A.go", "run", "p/a.py", "python", "self", [], None), "class chain", "A.run"), (("base", "A.go", "stop", "p/a.py", "python", "self", [], None), "class chain", "B.stop"),
    (("named owner", "g", "run", "p/c.py", "python", "Beta", [], None), "qualified path", "B.run"), (("module", "g", "free", "p/c.py", "python", "a", [], None), "import", "f"),
    (("typed", "g", "run", "p/c.py", "python", "x", [], None), "receiver type", "A.run"), (("typed base", "g", "stop", "p/c.py", "python", "x", [], None), "receiver type", "B.stop"),
    (("file", "A.go", "free", "p/a.py", "python", None, [], None), "same file", "f"), (("scope", "h", "inner", "p/c.py", "python", None, [], None), "enclosing scope", "h"),
    (("implicit", "J.c", "make", "q/J.java", "java", None, [], None), "class chain", "J.m"), (("bare import", "g", "free", "p/c.py", "python", None, [], None), "import", "f"),
    (("package", "G2", "shared", "r/y.go", "go", None, [], None), "same package", "G1"),
]


def judged(spark, code, *more):
    s, around, above = code
    calls = sites(spark, *[c[0] for c in CASES], *more)
    variables = spark.createDataFrame([("g", "x", "Alpha"), ("g", "y", "Alpha"), ("g", "y", "Beta"), ("A", "x", "Beta")], "scope string, name string, type string")
    typed = evidence.receiver_types(calls, around, variables)
    seen = spark.createDataFrame([("p/c.py", "p/a.py"), ("p/c.py", "p/a.py")], "path string, imported string")
    claimed = evidence.claims(calls, s, around, above, typed, seen)
    return calls, typed, claimed, evidence.decide(calls, s, claimed, typed), seen


def test_every_basis(spark, code):
    _, _, claimed, decided, _ = judged(spark, code)
    got = {r.site: r for r in claimed.collect()}
    assert {c[0][0]: (c[1], c[2]) for c in CASES} == {k: (r.basis, r.target) for k, r in got.items()} and {c[1] for c in CASES} == set(evidence.BASES)
    assert {r.label for r in decided.collect()} == {"proven"}


def test_verdicts_without_claims(spark, code):
    more = [("gone", "g", "nowhere", "p/c.py", "python", None, [], None), ("other", "g", "make", "p/c.py", "python", None, [], None), ("many", "g", "twice", "p/c.py", "python", None, [], None),
            ("untyped", "g", "lonely", "p/c.py", "python", "w", [], None), ("only", "g", "lonely", "p/c.py", "python", None, [], None), ("foreign", "g", "lonely", "p/c.py", "python", "x", [], None),
            ("two types", "g", "go", "p/c.py", "python", "y", [], None), ("nulls", None, "lonely", None, None, None, None, None)]
    calls, typed, _, decided, seen = judged(spark, code, *more)
    got = {r.site: (r.label, r.basis, r.target) for r in decided.collect()}
    assert len(got) == len(CASES) + len(more)
    assert got["gone"] == ("external", "no definition", None) and got["other"] == ("excluded", "other language", None) and got["many"] == ("unresolved", "2 definitions", None)
    assert got["untyped"] == ("likely", "receiver not typed", "far") and got["only"] == ("likely", "name only", "far") and got["foreign"] == ("excluded", "receiver is Alpha", None)
    assert got["two types"] == ("likely", "receiver not typed", "A.go") and got["nulls"][0] == "excluded"
    r = {x.site: x.rivals for x in evidence.rivals(calls, code[0], decided, seen).collect()}
    assert r["typed"] == 1 and r["file"] == 0 and r["many"] == 2 and r["only"] == 0


def test_exclusions(spark, code):
    more = [("few", "g", "lonely", "p/c.py", "python", None, [], 0), ("fits", "g", "lonely", "p/c.py", "python", None, [], 2), ("all", "g", "twice", "p/c.py", "python", None, [], 9), ("bound", "g", "twice", "p/c.py", "python", "lib", [], None),
            ("go one", "G2", "lonely2", "r/y.go", "go", None, [], 1)]
    calls, _, _, decided, _ = judged(spark, code, *more)
    ranges = spark.createDataFrame([("far", 1, 3), ("t1", 0, 1), ("t2", 0, 2)], "symbol_id string, least int, most int")
    groups = spark.createDataFrame([("twice", 0, 2), ("lonely2", 5, 5)], "name string, least int, most int")
    by = {r.site: (r.label, r.basis) for r in evidence.exclude_by_count(decided, calls, ranges, groups).collect()}
    assert by["few"] == ("excluded", "argument count") and by["fits"][0] == "likely" and by["all"][0] == "excluded" and by["typed"][0] == "proven" and by["go one"][0] == "external"
    files = spark.createDataFrame([("p/a.py",)], "path string")
    bindings = spark.createDataFrame([("p/c.py", "lib", "outside"), ("p/c.py", "free", "a")], "path string, name string, stem string")
    out = {r.site: (r.label, r.basis) for r in evidence.exclude_external_imports(decided, calls, bindings, files).collect()}
    assert out["bound"] == ("excluded", "external import") and out["bare import"][0] == "proven" and len(out) == len(CASES) + len(more)
    w = {r.symbol_id: (r.least, r.most) for r in evidence.widen(ranges, spark.createDataFrame([("t1", "far"), ("t1", "t2")], "symbol_id string, overridden_id string")).collect()}
    assert w == {"far": (1, 3), "t1": (0, 3), "t2": (0, 2)}


def test_name_rows_and_import_spans(spark):
    s = table(spark, ("a", "run", "function", "p.py", "python", None), ("i", "os", "import", "p.py", "python", None)).withColumn("start_line", F.when(F.col("symbol_id") == "i", 20).otherwise(5)).withColumn("end_line", F.when(F.col("symbol_id") == "i", 22).otherwise(9))
    rel = spark.createDataFrame([("x", "a", "calls", "p.py", 7, 2), ("x", "a", "imports", "p.py", 30, 0)], "from_symbol_id string, to_symbol_id string, kind string, path string, start_line int, start_column int")
    pen = spark.createDataFrame([(1, "x", "go", "calls", "p.py", 8, 1, "", '["A", "B"]'), (2, "x", "go", "calls", "p.py", 21, 1, "r", "broken"), (3, "x", "go", "calls", "p.py", 40, 1, "r", "broken")],
                                "pending_id bigint, from_symbol_id string, target_terminal_name string, kind string, path string, start_line int, start_column int, target_receiver string, target_namespace_json string")
    idn = spark.createDataFrame([("x", "run", "call", "p.py", 5, 4, None), ("x", "run", "call", "p.py", 7, 4, '{"receiver": "self"}'), (None, None, "call", None, None, None, None), ("x", "run", "call", "p.py", 30, 4, "{")],
                                "containing_symbol_id string, name string, kind string, path string, start_line int, start_column int, metadata_json string")
    got = sorted((r.src, r.name, r.line, r.receiver, tuple(r.namespace), r.target_id) for r in evidence.name_rows(s, rel, pen, idn).collect())
    assert got == [("I", "run", 7, "self", (), None), ("P", "go", 8, None, ("A", "B"), None), ("P", "go", 40, "r", (), None), ("R", "run", 7, None, (), "a")]
    assert evidence.import_spans(s, rel, pen, idn).count() == 2
    assert evidence.name_rows(s.limit(0), rel.limit(0), pen.limit(0), idn.limit(0)).count() == 0


def test_owners_hierarchies_and_reach(spark, rows):
    members = spark.createDataFrame([("m1", "T", "a/x.go", "a"), ("m2", "U", "a/x.go", "a"), ("m3", "V", "a/x.go", "a"), ("m4", "T", "b/x.go", "b")], "member string, owner_name string, path string, package string")
    owners = spark.createDataFrame([("t", "T", "a/y.go", "a"), ("u1", "U", "a/y.go", "a"), ("u2", "U", "a/z.go", "a_test"), ("v1", "V", "a/x.go", "a"), ("v2", "V", "a/y.go", "a")], "owner string, name string, path string, package string")
    assert rows(imports.unique_owner(members, owners)) == [("m1", "t"), ("m2", "u1"), ("m3", "v1")]
    edges = spark.createDataFrame([("e1", "Base", "a/b/x.py"), ("e2", "Alias", "a/c/x.py"), ("e3", "Base", "z/x.py")], "src string, name string, path string")
    types = spark.createDataFrame([("b1", "Base", "a/b/y.py"), ("b2", "Base", "a/y.py"), ("b3", "Base", "a/y2.py"), ("r", "Real", "q.py")], "symbol_id string, name string, path string")
    alias = spark.createDataFrame([("a/c/x.py", "Alias", "Real")], "path string, alias string, name string")
    assert rows(imports.nearest_types(edges, types, alias)) == [("e1", "b1"), ("e2", "r"), ("e3", "b1"), ("e3", "b2"), ("e3", "b3")]
    methods = spark.createDataFrame([("p.a", "a", "p"), ("p.b", "b", "p"), ("q.a", "a", "q"), ("q.c", "c", "q"), ("s.b", "b", "s")], "symbol_id string, name string, owner_id string")
    above = spark.createDataFrame([("s", "p", 1), ("s", "q", 2)], "seed string, node string, depth int")
    assert rows(imports.inherited(methods, above, spark.createDataFrame([("s",)], "seed string"))) == [("s", "p.a", 1), ("s", "q.c", 2)]
    assert rows(imports.nearest_depth(spark.createDataFrame([("k", 2, "x"), ("k", 1, "y"), ("k", 1, "z")], "key string, depth int, v string"), "key")) == [("k", 1, "y"), ("k", 1, "z")]
    uses = spark.createDataFrame([("s1", "f", "a.c"), ("s2", "f", "z.c"), ("s3", "f", "h.h")], "site string, name string, path string")
    defs = spark.createDataFrame([("d", "f", "h.h")], "definition string, name string, path string")
    assert rows(imports.reaches(uses, defs, spark.createDataFrame([("a.c", "h.h", 1)], "seed string, node string, depth int"))) == [("s1", "d"), ("s3", "d")]
    chains = spark.createDataFrame([("c1", "T", ["a", "b"]), ("c2", "T", ["a", "x"]), ("c3", "T", ["two"]), ("c4", "T", []), ("c5", "T", ["loop"] * 9)], "chain string, start string, names array<string>")
    m = spark.createDataFrame([("T", "a", "U"), ("U", "b", "V"), ("T", "two", "U"), ("T", "two", "V"), ("T", "loop", "T")], "owner string, name string, type string")
    assert rows(imports.receiver_chain(chains, m)) == [("c1", "V", True), ("c2", None, False), ("c3", None, False), ("c4", "T", True), ("c5", None, False)]


def test_small_helpers(spark):
    r = spark.range(1).select(evidence.type_parameters(F.lit("fn a<T: Clone, const N, 'a>(x: T)")).alias("a"), evidence.type_parameters(F.lit("f(x<y>)")).alias("b"), evidence.related(F.lit("A"), F.lit("B"), F.array(F.lit("B"))).alias("c")).first()
    assert r.a == ["T", "N"] and r.b == [] and r.c is True


def test_reports_and_removed_targets(spark, code):
    s, around, above = code
    calls, typed, _, decided, seen = judged(spark, code, ("few", "g", "lonely", "p/c.py", "python", None, [], 0), ("old", "A.go", "gone", "p/a.py", "python", None, [], None))
    ranges = spark.createDataFrame([("far", 1, 3)], "symbol_id string, least int, most int")
    groups = spark.createDataFrame([("lonely", 1, 3)], "name string, least int, most int")
    plain = {r.site: r.label for r in evidence.report(calls, s, around, above, typed, seen).collect()}
    full = {r.site: r.label for r in evidence.report(calls, s, around, above, typed, seen, ranges, groups).collect()}
    assert plain["few"] == "likely" and full["few"] == "excluded" and plain["old"] == "external" and plain == {r.site: r.label for r in decided.collect()}
    removed = table(spark, ("X", "gone", "function", "p/a.py", "python", None), ("f", "free", "function", "p/a.py", "python", None))
    back = evidence.with_removed(s, removed)
    assert back.count() == s.count() + 1
    again = evidence.report(calls, back, evidence.scopes(walk.ancestors(back), back), above, typed, seen)
    assert {r.site: (r.label, r.target) for r in again.collect()}["old"] == ("proven", "X")
    bound = spark.createDataFrame([("p/a.py", "gone")], "path string, name string")
    r = {x.site: (x.label, x.basis) for x in evidence.rebound(again, calls, removed, bound).collect()}
    assert r["old"] == ("excluded", "imported now") and r["file"] == ("proven", "same file") and len(r) == len(plain)


def test_overloads_by_count_names_and_types(spark, rows):
    cols = "symbol_id string, scope string, name string, least int, most int, names array<string>, types array<string>"
    o = spark.createDataFrame([("a", "f", "run", 1, 1, ["x"], ["int"]), ("b", "f", "run", 1, 1, ["y"], ["String"]), ("c", "f", "run", 2, None, ["x", "rest"], ["int", None])], cols)
    call = "site string, scope string, name string, args int, arg_names array<string>, arg_types array<string>"
    c = spark.createDataFrame([("typed", "f", "run", 1, None, ["String"]), ("named", "f", "run", 1, ["x"], None), ("open", "f", "run", 1, None, [None]), ("many", "f", "run", 7, [None], ["int", "z"]), ("none", "f", "run", 0, None, None), ("wrong", "f", "run", 1, None, ["bool"]), ("other", "g", "run", 1, None, None)], call)
    bound = evidence.bind_overloads(c, o)
    assert rows(bound) == [("many", "c"), ("named", "a"), ("typed", "b")]
    judged_ = spark.createDataFrame([("typed", "proven", "same file", "a"), ("named", "proven", "same file", "a"), ("open", "likely", "name only", "a"), ("many", "likely", "name only", "z"), ("x", "external", "", None)], "site string, label string, basis string, target string")
    groups = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("z", 2)], "symbol_id string, group int")
    assert rows(evidence.exclude_other_overloads(judged_, bound, groups)) == [("many", "likely", "name only", "z"), ("named", "proven", "same file", "a"), ("open", "likely", "name only", "a"), ("typed", "excluded", "binds another overload", None), ("x", "external", "", None)]


def test_shadowed_names_and_type_identity(spark, code, rows):
    calls = sites(spark, ("s", "h", "free", "p/c.py", "python", None, [], None), ("q", "h", "free", "p/c.py", "python", "m", [], None), ("t", "G2", "free", "r/y.go", "go", None, None, None))
    j = spark.createDataFrame([(x, "likely", "name only", "f") for x in "sqt"], "site string, label string, basis string, target string")
    local_names = spark.createDataFrame([("g", "free"), ("g", "free"), ("A", "free")], "scope string, name string")
    assert rows(evidence.exclude_shadowed(j, calls, code[1], local_names)) == [("q", "likely", "name only", "f"), ("s", "excluded", "local name", None), ("t", "likely", "name only", "f")]
    types = spark.createDataFrame([("1", "T", "a/x"), ("2", "T", "a/y"), ("3", "T", "b/z"), ("4", "U", "c/u"), ("5", "V", "d/1"), ("6", "V", "d/2")], "symbol_id string, name string, path string")
    uses = spark.createDataFrame([("own", "T", "a/x"), ("imp", "T", "q/w"), ("fold", "T", "b/k"), ("two", "T", "a/k"), ("only", "U", "z"), ("none", "W", "z"), ("both", "V", "q/w")], "site string, name string, path string")
    seen = spark.createDataFrame([("q/w", "b/z"), ("q/w", "d/1"), ("q/w", "d/2")], "path string, imported string")
    assert rows(evidence.type_identity(uses, types, seen)) == [("fold", "3", "same folder"), ("imp", "3", "import"), ("only", "4", "only one"), ("own", "1", "same file")]
