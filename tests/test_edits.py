import pytest
from pyspark.sql import functions as F

from tessera.operators import checks, impact, report, testing, walk

SYM = "symbol_id string, name string, kind string, path string, language string, parent_symbol_id string, start_line int, end_line int, start_byte int, signature string, is_test boolean, test_container boolean, test_lifecycle boolean, seed string"


def sym(i, name=None, kind="function", path="a.py", parent=None, line=1, test=None, container=None, life=None, signature=None, language="python", end=None):
    return (i, name or i, kind, path, language, parent, line, end or line, line, signature, test, container, life, "clash")


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SYM)


def test_fixtures_serve_their_users(spark, rows):
    fixtures = spark.createDataFrame([("top", "db", "conftest.py"), ("sub", "db", "t/x/conftest.py"), ("own", "db", "t/y/test_a.py"), ("wrap", "db", "t/z/conftest.py"), ("other", "db", "lib/fix.py")], "symbol_id string, name string, path string")
    users = spark.createDataFrame([("u1", "t/test_b.py", ["db", "db"]), ("u2", "t/x/deep/test_c.py", ["db", "none"]), ("u3", "t/y/test_a.py", ["db"]), ("wrap", "t/z/conftest.py", ["db"]), ("u4", "t/z/test_d.py", []), ("u5", None, ["db"]), ("u6", "t/q.py", None)],
                                  "symbol_id string, path string, parameters array<string>")
    assert rows(impact.fixture_edges(fixtures, users)) == [("u1", "top"), ("u2", "sub"), ("u3", "own"), ("wrap", "top")]
    s = table(spark, sym("set", parent="C", life=True), sym("t1", parent="C", test=True), sym("t2", parent="D", test=True), sym("h", parent="C"))
    assert rows(impact.setup_edges(s)) == [("t1", "set")]


def test_report_callers_and_joined_walks(spark, rows):
    s = table(spark, sym("x"), sym("a"), sym("b"), sym("c"), sym("t", test=True), sym("k", container=True), sym("u", "test_u", path="tests/u.py"))
    cols = "target string, from_symbol_id string, label string, basis string, call boolean"
    sites = spark.createDataFrame([("x", "a", "proven", "same file", True), ("x", "a", "likely", "name only", False), ("x", "b", "likely", "name only", True), ("x", "c", "proven", "import", False), ("x", "t", "proven", "import", True), ("x", "k", "proven", "import", True),
                                   ("x", "u", "proven", "import", True), ("x", "gone", "proven", "import", True), ("x", None, "proven", "import", True), (None, "a", "proven", "import", True), ("x", "a", "excluded", "", True), ("x", "x", "proven", "import", True)], cols)
    callers = impact.report_callers(sites, s)
    assert rows(callers) == [("x", "a", "direct caller (report)"), ("x", "b", "direct caller (report, name only)"), ("x", "c", "direct reference (report)")]
    walked = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("x", "z", 3), ("y", "q", 1)], "seed string, node string, depth int")
    j = impact.join_callers(walked, callers)
    assert rows(j) == [("x", "a", 1, "direct caller", False), ("x", "b", 1, "direct caller (report, name only)", True), ("x", "c", 1, "direct reference (report)", True), ("x", "z", 3, "indirect caller [depth 3]", False), ("y", "q", 1, "direct caller", False)]
    edges = spark.createDataFrame([("n1", "b"), ("n2", "n1"), ("n3", "n2"), ("z", "n1"), ("x", "b"), ("b", "n1")], "src string, dst string")
    got = rows(impact.walk_on(j, edges, 3).select("seed", "node", "depth"))
    assert got == [("x", "a", 1), ("x", "b", 1), ("x", "c", 1), ("x", "n1", 2), ("x", "n2", 3), ("x", "z", 3), ("y", "q", 1)]
    assert rows(impact.walk_on(j, edges, 1).select("node")) == [("a",), ("b",), ("c",), ("q",), ("z",)]
    flags = "seed string, impacted bigint, tests bigint, impacted_truncated boolean, tests_truncated boolean, ceiling_reached boolean, stopped_at_depth int, tests_past_depth bigint"
    m = impact.merge_flags(spark.createDataFrame([("x", 1, 2, False, True, False, None, 0), ("w", 1, 1, False, False, False, None, 0)], flags), spark.createDataFrame([("x", 3, 1, True, False, False, 2, 5)], flags))
    assert rows(m) == [("w", 1, 1, 0, False, False, False, None), ("x", 3, 2, 5, True, True, False, 2)]


def test_seeds(spark, rows):
    s = table(spark, sym("A", "Alpha", "class", end=9), sym("A.p", "process", parent="A", line=2, end=4), sym("B", "Beta", "class", path="b.py"), sym("B.p", "process", path="b.py", parent="B"), sym("n", None, path="c.py"))
    q = spark.createDataFrame([("Alpha::process", None), ("process", None), ("process", "b.py"), ("Bogus.process", None), ("nothing", None)], "query string, path string")
    assert rows(impact.seeds_by_name(s, q)) == [("Alpha::process", "A.p", 1), ("process", "A.p", 2), ("process", "B.p", 1), ("process", "B.p", 2)]
    assert rows(impact.seeds_by_hunks(s, spark.createDataFrame([("a.py", 3, 3), ("a.py", 8, 8), ("b.py", 50, 51), ("none.py", 1, 1)], "path string, start_line int, end_line int"))) == [("a.py", "A"), ("a.py", "A.p"), ("b.py", "B"), ("b.py", "B.p")]
    f = impact.file_report(spark.createDataFrame([("A.p", "B", 2), ("A", "A.p", 1)], "seed string, node string, depth int"), s, spark.createDataFrame([("A", "B", "x"), ("A", "n", "x")], "seed string, node string, reason string"))
    assert rows(f) == [("a.py", "B", 1), ("a.py", "n", 1)]


def test_tests_of_helpers(spark, rows):
    chain = [sym("t", test=True)] + [sym(f"h{k}", parent="t" if k == 0 else f"h{k - 1}") for k in range(6)]
    s = table(spark, *chain, sym("set", life=True, test=True), sym("in", parent="set"), sym("cls", kind="class"), sym("m", parent="cls"), sym("test_named", path="tests/a.py"), sym("x", parent="x"))
    assert rows(testing.test_of(s)) == [("h0", "t"), ("h1", "t"), ("h2", "t"), ("h3", "t"), ("t", "t"), ("test_named", "test_named")]
    above = spark.createDataFrame([("A", "A", 0), ("A", "unittest.TestCase", 2), ("MyTestCase", "MyTestCase", 0)], "symbol_id string, name string, depth int")
    assert rows(testing.test_cases(above)) == [("A",)]
    calls = spark.createDataFrame([("f", "h0"), ("f", "t"), ("f", "test_named"), ("t", "t"), ("f", "in")], "symbol_id string, caller string")
    assert rows(testing.related_tests(calls, testing.test_of(s), s)) == [("f", "t", True, 1), ("f", "test_named", False, 2)]
    assert rows(testing.starting_at(spark.createDataFrame([("a.py", 1), ("tests/a.py", 1), ("z", 1)], "path string, line int"), s)) == [("a.py", 1, "set"), ("tests/a.py", 1, "test_named")]


COMMANDS = [
    ("python", "t/a.py", "test_x", "TestA", [], "pytest t/a.py::TestA::test_x"), ("python", "t/a b.py", "test_x", None, [], "pytest 't/a b.py::test_x'"), ("rust", "a.rs", "it's", None, [], "cargo test 'it'\\''s'"), ("go", "a_test.go", "TestX", None, [], "go test ./ -run '^TestX$'"),
    ("tsx", "a.test.tsx", "works well", None, ["vitest.config.ts"], "npx vitest run a.test.tsx -t 'works well'"), ("javascript", "a.test.js", "x", None, [".mocharc.json"], "npx mocha a.test.js -g x"), ("typescript", "a.test.ts", "x", None, [], "npx jest a.test.ts -t x"),
    ("java", "A.java", "x", "ATest", ["pom.xml"], "mvn test -Dtest='ATest#x'"), ("kotlin", "A.kt", "x", "ATest", ["build.gradle.kts"], "gradle test --tests ATest.x"), ("scala", "A.scala", "x", "ASpec", ["build.sbt"], "sbt 'testOnly *ASpec'"), ("scala", "A.scala", "x", "ASpec", [], None),
    ("fsharp", "a.fs", "x", "T", [], "dotnet test --filter 'FullyQualifiedName~T.x'"), ("ruby", "a_spec.rb", "x", None, [], "bundle exec rspec a_spec.rb:7"), ("ruby", "a_test.rb", "test_x", None, [], "ruby -Itest a_test.rb -n test_x"), ("swift", "a.swift", "testX", "T", [], "swift test --filter T/testX"),
    ("dart", "a.dart", "x", None, [], "dart test a.dart --plain-name x"), ("cpp", "a.cc", "x", "S", [], "ctest -R '^S.x$'"), ("zig", "a.zig", "x", None, [], "zig test a.zig --test-filter x"), ("qml", "tst_a.qml", "test_x", "A", [], "qmltestrunner -input tst_a.qml A::test_x"),
    ("php", "ATest.php", "testX", "A", [], "vendor/bin/phpunit --filter '/::testX$/' ATest.php"), ("elixir", "a_test.exs", "x", None, [], "mix test a_test.exs:7"), ("erlang", "src/a_tests.erl", "x", None, [], "rebar3 eunit --module=a_tests"), ("lua", "a_spec.lua", "x", None, [], "busted --filter x a_spec.lua"),
    ("r", "test-a.R", "x", None, [], "Rscript -e 'testthat::test_file(\"test-a.R\")'"), ("powershell", "a.Tests.ps1", "x", None, [], "pwsh -Command 'Invoke-Pester -Path a.Tests.ps1'"), ("bash", "a.bats", "x", None, [], "bats -f '^x$' a.bats"),
    ("gdscript", "test_a.gd", "test_x", None, [], "godot --headless -s addons/gut/gut_cmdln.gd -gtest=test_a.gd -gunit_test_name=test_x"), ("html", "a.html", "x", None, [], None), (None, "a", "x", None, [], None),
]


def test_run_commands(spark):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(COMMANDS)], "k int, language string, path string, name string, owner string, markers array<string>, want string")
    got = df.select("k", "want", testing.run_command(F.col("language"), F.col("path"), F.col("name"), F.col("owner"), F.lit(7), F.col("markers")).alias("got")).orderBy("k").collect()
    for r in got:
        assert r.got == r.want


def test_suite_commands(spark):
    markers = spark.createDataFrame([("Cargo.toml",), ("web/package.json",), ("web/x/README.md",), ("both/pom.xml",), ("both/build.gradle",), ("a b/go.mod",)], "path string").where("path NOT LIKE '%README%'")
    paths = spark.createDataFrame([("src/a.rs",), ("web/x/y.js",), ("both/A.java",), ("a b/c/d.go",)], "path string")
    m = testing.nearest_marker(paths, markers)
    assert {r.path: r.c for r in m.select("path", testing.suite_command(F.col("names"), F.col("folder")).alias("c")).collect()} == {"src/a.rs": "cargo test", "web/x/y.js": "cd web && npm test", "both/A.java": None, "a b/c/d.go": "cd 'a b' && go test ./..."}


def test_shapes_of_an_edit(spark, rows):
    cols = "symbol_id string, name string, kind string, path string, owner string, signature string, visibility string, body_hash string, start_line int, start_byte int"
    base = spark.createDataFrame([("p", "f", "function", "a.py", "", "def f(a)", "public", "h1", 1, 1), ("r", "g", "function", "a.py", "", "def g(a, b)", "public", "h2", 2, 2), ("k", "h", "function", "a.py", "", "def h(a)", "public", "h3", 3, 3), ("x", "gone", "function", "a.py", "", "def gone()", None, None, 4, 4),
                                  ("o", "old", "function", "a.py", "", "def old()", None, "h5", 5, 5), ("m", "mv", "function", "a.py", "", "def mv()", None, "h6", 6, 6), ("v", "vis", "class", "a.py", "", None, "public", "h7", 7, 7), ("s", "t", "function", "a.py", "", "def t(a: int)", "public", "h8", 8, 8), ("same", "same", "function", "a.py", "", "def same()", None, "h9", 9, 9)], cols)
    cur = spark.createDataFrame([("p", "f", "function", "a.py", "", "def f(a, b=1)", "public", "h1", 1, 1), ("r", "g", "function", "a.py", "", "def g(a, c)", "public", "h2", 2, 2), ("k", "h", "function", "a.py", "", "async def h(a)", "public", "h3", 3, 3), ("n", "new", "function", "a.py", "", "def old()", None, "h5", 5, 5),
                                 ("m2", "mv", "function", "b.py", "", "def mv()", None, "h6", 6, 6), ("v", "vis", "class", "a.py", "", None, "private", "h7", 7, 7), ("s", "t", "function", "a.py", "", "def t(a: str)", "public", "h8", 8, 8), ("same", "same", "function", "a.py", "", "def same()", None, "h9", 9, 9)], cols)
    from tessera.operators import diff

    got = rows(checks.shapes(base, cur, diff.pair(base, cur)))
    assert got == [("k", "k", "keywords", ">async"), ("m", "m2", "move", "b.py"), ("o", "n", "rename", "new"), ("p", "p", "parameters", "1>2"), ("r", "r", "renamed", "b>c"), ("s", "s", "signature", ""), ("v", "v", "visibility", ""), ("x", None, "removed", "")]
    assert checks.shapes(base.limit(0), cur.limit(0), diff.pair(base.limit(0), cur.limit(0))).count() == 0


def test_placed_calls(spark, rows):
    cols = "site string, target string, name string, path string, line int, label string, args int"
    s = spark.createDataFrame([("few", "f", "f", "a", 1, "proven", 0), ("ok", "f", "f", "a", 2, "proven", 1), ("in", "f", "f", "a", 50, "proven", 1), ("bad in", "f", "f", "a", 51, "likely", 9), ("unknown", "f", "f", "a", 3, "likely", None), ("out", "f", "f", "a", 4, "excluded", 0), ("none", "z", "z", "a", 4, "proven", 0)], cols)
    ranges = spark.createDataFrame([("f", 1, 2), ("g", 1, None)], "symbol_id string, least int, most int")
    hunks = spark.createDataFrame([("a", 50, 60)], "path string, start_line int, end_line int")
    assert rows(checks.place_calls(s, ranges, hunks)) == [("f", "bad in", "likely", "passes 9 arguments; takes 1 to 2"), ("f", "few", "proven", "passes 0 arguments; takes 1 to 2"), ("f", "in", "in_diff", None), ("f", "unknown", "unresolved", None)]
    left = spark.createDataFrame([("f", 1, 1), ("f", 5, None)], "name string, least int, most int")
    assert rows(checks.removed_overloads(s, left, hunks)) == [("f", "few", "proven", "passes 0 arguments; no remaining overload takes it"), ("f", "unknown", "unresolved", None), ("z", "none", "proven", "passes 0 arguments; no remaining overload takes it")]
    stop = checks.stop_text(checks.place_calls(s, ranges, hunks)).collect()
    assert [(r.target, r.sites, r.found) for r in stop] == [("f", "few", 1)]


def test_imports_fields_and_arms(spark, rows):
    removed = spark.createDataFrame([("f", "f", "lib.py")], "symbol_id string, name string, path string")
    bindings = spark.createDataFrame([("a.py", 3, "f", "lib.py"), ("b.py", 1, "f", "other.py")], "path string, line int, name string, imported string")
    assert rows(checks.import_lines(removed, bindings)) == [("f", "a.py", 3)]
    builds = spark.createDataFrame([("P", "a", 1, "P { x: 1, y: 2 }"), ("P", "a", 2, "P { x: 1, y: 2, z: 3 }"), ("P", "a", 3, "P { x: 1, ..old }"), ("P", "a", 4, "P(x=1)"), ("Q", "a", 5, "Q {}"), ("P", "a", 6, None)], "owner string, path string, line int, text string")
    added = spark.createDataFrame([("P", "z", True), ("P", "w", False)], "owner string, field string, required boolean")
    assert rows(checks.broken_constructions(builds, added)) == [("P", "a", 1, "z"), ("P", "a", 4, "z")]
    arms = spark.createDataFrame([("m1", "E", "A"), ("m1", "E", "B"), ("m2", "E", "A"), ("m2", "E", None), ("m3", "E", "C"), ("m4", "X", "A")], "match string, owner string, variant string")
    assert rows(checks.missing_arms(arms, spark.createDataFrame([("E", "C"), ("E", "D")], "owner string, variant string"))) == [("E", "m1", "C,D"), ("E", "m3", "D")]


def test_pages_budgets_and_candidates(spark, rows):
    r = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 1)], "s string, k int")
    assert rows(checks.sections(r, "s", ["k"], 1, 2)) == [("a", 1, 2, 5, True), ("a", 2, 3, 5, True)] and checks.sections(r, "s", ["k"], 0, 0).count() == 0
    with pytest.raises(ValueError):
        checks.sections(r, "s", ["k"], 0, 201)
    levels = spark.createDataFrame([("x", 0, "long text"), ("x", 1, "short"), ("y", 0, "fits"), ("z", 0, "never fits")], "key string, level int, text string")
    assert rows(checks.fit(levels, 5)) == [("x", 1, "short"), ("y", 0, "fits"), ("z", 0, "never")]
    changes = spark.createDataFrame([("c1", "f", "a", 1), ("c2", "g", "a", 2), ("c3", None, None, None)], "base_id string, name string, path string, start_line int")
    assert [(x.base_id, x.uses, x.found) for x in checks.cap_candidates(changes, spark.createDataFrame([("g", 7)], "name string, uses bigint"), 2).collect()] == [("c2", 7, 3), ("c1", 0, 3)]
    files = spark.createDataFrame([("src/a.py",), ("src/b.rs",)], "path string")
    changed = spark.createDataFrame([("src/a.py",), ("new.PY",), ("notes.txt",), ("vendor/x.py",), ("dir.py/",), ("LICENSE",)], "path string")
    listed, digest = checks.prepare(changed, files, spark.createDataFrame([("src/a.py", "x")], "path string, content string"), most=1)
    assert rows(checks.candidate_files(changed, files)) == [("new.PY",), ("src/a.py",)] and rows(listed) == [("new.PY", 2)] and len(digest.first().digest) == 64
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "path string, line int, text string")
    was = lines.select("path", "line", F.md5("text").alias("digest")).unionByName(spark.createDataFrame([("a", 2, "0"), ("a", 9, "0")], "path string, line int, digest string"))
    assert rows(checks.edited_since(was, lines)) == [("a", 1, False), ("a", 2, False), ("a", 2, True), ("a", 9, True)]


def test_access_of_fields(spark, rows):
    r = spark.createDataFrame([("a", 1, "proven", "write"), ("a", 1, "excluded", "read"), ("a", 2, "likely", "read"), ("a", 2, "likely", "write"), ("a", 3, "excluded", "read"), ("a", 4, "proven", None)], "path string, line int, label string, access string")
    lines = report.line_access(r)
    assert rows(lines) == [("a", 1, "write"), ("a", 2, "read_write"), ("a", 3, "read"), ("a", 4, None)]
    assert tuple(report.access_counts(lines).first()) == (1, 1, 1, 1) and tuple(report.access_counts(lines.limit(0)).first()) == (0, 0, 0, 0)
    s = spark.createDataFrame([("t", "likely", "read", "a", 1, 0, "n"), ("t", "proven", "read", "a", 2, 0, "n"), ("t", "proven", "write", "b", 3, 0, "n")], "target string, label string, access string, path string, line int, column int, name string")
    assert [(x.path, x.line, x.place, x.first) for x in report.report_order(s).orderBy("place").collect()] == [("b", 3, 1, 1), ("a", 2, 2, 2), ("a", 1, 3, 2)]


def test_parent_names(spark, rows):
    s = table(spark, sym("a", "A"), sym("b", "B", parent="a"), sym("c", "C", parent="b"), sym("o", "O", parent="gone"))
    got = checks.parent_names(s, walk.ancestors(s)).select("symbol_id", F.replace("owner", F.lit("\x1f"), F.lit("/")))
    assert rows(got) == [("a", ""), ("b", "A"), ("c", "A/B"), ("o", "")]
