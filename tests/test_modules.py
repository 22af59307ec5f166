from pyspark.sql import functions as F

from tessera.operators import modules, scan


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, line int, text string")


def files(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_joined_paths(spark):
    cases = {("a/b", "../c"): "a/c", ("", "./x"): "x", ("a", "b/./c/"): "a/b/c", ("a", "../../x"): None, ("a", "/r/x"): "r/x"}
    df = spark.createDataFrame(list(cases), "a string, b string").select("a", "b", modules.joined_path(F.col("a"), F.col("b")).alias("c"))
    assert {(r.a, r.b): r.c for r in df.collect()} == cases


def test_script_modules(spark, rows):
    l = lines(spark, ("web/a.ts", 1, "import def, { one, two as zwei } from './lib'"), ("web/a.ts", 2, "import * as all from 'react'"), ("web/a.ts", 3, "const x = 'import y from z'"), ("web/lib/index.ts", 1, "export { eins as one } from '../deep'"),
              ("web/lib/index.ts", 2, "export * from '../more.js'"), ("web/more.ts", 1, "export * from './lib'"), ("web/a.ts", 4, "import { gone } from './gone'"), ("web/a.ts", 5, "import type { T } from './lib'"), ("z", 1, None))
    i = modules.script_imports(l)
    assert ("web/a.ts", 1, "two", "zwei", "./lib", False) in rows(i) and ("web/a.ts", 2, "*", "all", "react", False) in rows(i) and ("web/a.ts", 1, "default", "def", "./lib", False) in rows(i) and i.count() == 9
    r = modules.resolve_modules(i, files(spark, "web/lib/index.ts", "web/deep.ts", "web/more.ts", "web/lib.md"))
    assert rows(r) == [("web/a.ts", "./gone", None, "missing"), ("web/a.ts", "./lib", "web/lib/index.ts", "file"), ("web/a.ts", "react", None, "package"), ("web/lib/index.ts", "../deep", "web/deep.ts", "file"), ("web/lib/index.ts", "../more.js", "web/more.ts", "file"),
                       ("web/more.ts", "./lib", "web/lib/index.ts", "file")]
    n = rows(modules.follow_names(i, r).where("alias IN ('one', 'zwei')"))
    assert n == [("web/a.ts", "one", "web/deep.ts", "eins", 2), ("web/a.ts", "one", "web/lib/index.ts", "one", 1), ("web/a.ts", "one", "web/more.ts", "one", 2), ("web/a.ts", "zwei", "web/lib/index.ts", "two", 1), ("web/a.ts", "zwei", "web/more.ts", "two", 2)]


def test_loaded_files(spark, rows):
    l = lines(spark, ("s/a.sh", 1, "source ./b.sh"), ("s/a.sh", 2, ". \"$DIR/c.sh\""), ("p/a.php", 1, "require_once __DIR__ . '/b.php';"), ("r/a.rb", 1, "require_relative 'b'"), ("c/a.c", 1, '#include "x/b.h"'), ("c/a.c", 2, "#include <stdio.h>"), ("c/a.c", 3, '#include "two.h"'),
              ("d/a.dart", 1, "import 'package:x/y.dart';"), ("d/a.dart", 2, "part 'b.dart';"), ("g/a.gd", 1, 'var x = preload("res://g/b.gd")'), ("w/a.ps1", 1, ". $PSScriptRoot\\b.ps1"), ("q/a.R", 1, 'source("b.R")'), ("x/a.py", 1, "source ./b.sh"))
    langs = spark.createDataFrame([("s/a.sh", "bash"), ("p/a.php", "php"), ("r/a.rb", "ruby"), ("c/a.c", "c"), ("d/a.dart", "dart"), ("g/a.gd", "gdscript"), ("w/a.ps1", "powershell"), ("q/a.R", "r"), ("x/a.py", "python")], "path string, language string")
    known = files(spark, "s/b.sh", "s/c.sh", "p/b.php", "r/b.rb", "include/x/b.h", "m/two.h", "n/two.h", "d/b.dart", "g/b.gd", "w/b.ps1", "q/b.R")
    assert rows(modules.load_edges(l, langs, known)) == [("c/a.c", "include/x/b.h"), ("d/a.dart", "d/b.dart"), ("g/a.gd", "g/b.gd"), ("p/a.php", "p/b.php"), ("q/a.R", "q/b.R"), ("r/a.rb", "r/b.rb"), ("s/a.sh", "s/b.sh"), ("s/a.sh", "s/c.sh"), ("w/a.ps1", "w/b.ps1")]


def test_bound_names(spark, rows):
    l = lines(spark, ("a", 1, "for (const x of xs) { y.map(z => z + 1) }"), ("a", 2, "try {} catch (err) { f((a, ...b) => a) }"), ("a", 3, "list.forEach(function (item, i) {})"), ("a", 4, "plain(call)"))
    assert rows(modules.bound_by_line(l)) == [("a", 1, "x", "loop"), ("a", 1, "z", "callback"), ("a", 2, "a", "callback"), ("a", 2, "b", "callback"), ("a", 2, "err", "catch"), ("a", 3, "i", "callback"), ("a", 3, "item", "callback")]


def test_facts_returns_and_context(spark, rows):
    facts = spark.createDataFrame([("1", "sql.select_query.v1", "a/x", 3), ("2", "sql.insert.v1", "a/x", 1), ("3", "route.get", "b", 1), ("4", "sql.select_query.v1", "b/y", 1), ("5", None, "b", 2)], "structural_fact_id string, pattern_id string, path string, start_line int")
    lits = spark.createDataFrame([("l1", "sql", "a/z", 1), ("l2", "SQL", "b", 1)], "literal_id string, kind string, path string, start_line int")
    assert rows(modules.fact_patterns(facts)) == [("route.get",), ("sql.insert.v1",), ("sql.select_query.v1",)]
    f, l = modules.list_facts(facts, lits, "sql", None, 2)
    assert [r.structural_fact_id for r in f.collect()] == ["2", "1"] and l.count() == 2
    f, l = modules.list_facts(facts, lits, "sql", "A", 1)
    assert [r.structural_fact_id for r in f.collect()] == ["2"] and [r.literal_id for r in l.collect()] == ["l1"]
    assert [r.structural_fact_id for r in modules.list_facts(facts, lits, "sql.select_query.v1", "b", 9)[0].collect()] == ["4"]
    cols = "symbol_id string, name string, kind string, path string, file_id string, parent_symbol_id string, signature string, start_line int, end_line int, start_byte int, end_byte int, is_test boolean, test_lifecycle boolean, language string"
    s = spark.createDataFrame([("f", "run", "function", "a.py", "x", None, "def run()", 1, 2, None, None, None, None, "python"), ("g", "run", "function", "a.py", "x", None, "def run(a) -> Path", 4, 5, None, None, None, None, "python"), ("t", "test_it", "function", "t.py", "y", None, "", 1, 1, None, None, True, None, "python")], cols)
    types = spark.createDataFrame([("f", "Path"), ("g", "Path"), ("t", "A"), ("t", "B"), ("f", None)], "symbol_id string, resolved_type string")
    assert rows(modules.unspelled_returns(s, types)) == [("f", "Path")]
    edges = spark.createDataFrame([("t", "f", 1), ("f", "g", 2), ("f", None, 2)], "from_symbol_id string, to_symbol_id string, line int")
    judged = spark.createDataFrame([("f", "proven", "t.py", 1), ("f", "excluded", "t.py", 2)], "target string, label string, path string, line int")
    from tessera.operators import testing

    c = modules.context("f", s, edges, judged, testing.test_of(s), spark.createDataFrame([("x", "one\ntwo\nthree")], "file_id string, content string"), types)
    assert {k: v.count() for k, v in c.items()} == {"symbol": 1, "body": 1, "members": 0, "overloads": 1, "callers": 1, "callees": 1, "tests": 1, "returns": 1} and c["body"].first().text == "one\ntwo"
    assert all(v.count() == 0 for v in modules.context("none", s, edges, judged, testing.test_of(s), spark.createDataFrame([], "file_id string, content string"), types).values())


def test_roots_and_ignore_rules(spark, rows):
    p = files(spark, "Cargo.toml", "a/b/package.json", "c/.git/HEAD", "d/notgo.mod", "e/go.mod.bak", "x\\y\\pyproject.toml")
    assert rows(scan.project_roots(p)) == [("",), ("a/b",), ("c",), ("x/y",)]
    top = scan.ignore_rules("", "# note\n*.log\n!keep.log\nbuild/\n/only.txt\ndocs/**/tmp\n")
    deep = scan.ignore_rules("sub", "!x.log\nlocal\n")
    r = spark.createDataFrame(top + deep, "folder string, line int, regex string, negated boolean, folders boolean")
    want = {"a.log": True, "keep.log": False, "sub/x.log": False, "sub/y.log": True, "build/x.c": True, "build": False, "only.txt": True, "sub/only.txt": False, "docs/a/b/tmp": True, "sub/local/z": True, "local": False, "build/keep.log": True}
    assert {x.path: x.ignored for x in scan.ignored(files(spark, *want), r).collect()} == want


def test_scan_coverage_and_listing(spark, rows):
    t = spark.createDataFrame([("a", "text"), ("b", "x\x00y"), ("c", None), ("d", "long " * 10), ("e", "")], "path string, content string")
    assert tuple(scan.coverage(t, 20).first()) == (5, 2, 1, 1, 1) and rows(scan.readable_texts(t, 20).select("path")) == [("a",), ("e",)] and tuple(scan.coverage(t.limit(0)).first()) == (0, 0, 0, 0, 0)
    f = files(spark, "a", "b/c", "b/d/e")
    assert rows(scan.listing(f, most=2)) == [("a", True), ("b/c", True)] and rows(scan.listing(f, most=3)) == [("a", False), ("b/c", False), ("b/d/e", False)] and rows(scan.listing(f, depth=1)) == [("a", False)]


def test_search_index_state(spark):
    from tessera.operators import lookup

    m = spark.createDataFrame([("fts_rule", "2")], "key string, value string")
    assert lookup.index_ready(m, "2") and not lookup.index_ready(m, "3") and not lookup.index_ready(m.limit(0), "2")
