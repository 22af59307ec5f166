import re

import pytest

from tessera.llm import handwritten as h
from tessera.llm.evidence import signs

HAND = "use crate::x;\n\n/// Reads it.\npub fn read(a: &str) -> u8 {\n    let b = a.len();\n    if b > 3 { return 1; }\n    0\n}\n" * 6


def found(path, text):
    s = signs(path, text)
    return {k for k in ("generated", "by_hand", "imported", "foreign", "banner", "minified") if s[k]} | ({"data"} if s["data"] > h.DATA_SHARE else set()) | ({"stubs"} if s["stubs"] > h.STUB_SHARE else set())


@pytest.mark.parametrize("text, want", [
    (HAND, set()), ("// Code generated by stubber. DO NOT EDIT.\n" + HAND, {"generated"}), (HAND + "// end of generated code - @generated by x\n", {"generated"}), ("// Edit freely; this one is written by hand.\n" + HAND, {"by_hand"}),
    ("# Diese Datei wurde automatisch erzeugt (x).\n" + HAND, {"generated"}), ("// Copyright the proj-1 contributors.\n" + HAND, set()), ("// otherlib 1.2.3 - (c) the otherlib authors, ISC license\n" + HAND, {"foreign"}),
    ("// Imported unchanged from the otherlib release, see UPSTREAM\n" + HAND, {"imported"}), ('const header = "This file was automatically created by us";\n' + HAND, set()), ("fn f() {\n    /** Auto-generated method stub */\n}\n" + HAND, set()),
    ("const T = [\n" + "    0x1f, 0x2e, 0x03, 0xff, 0x00, 0x10,\n" * 40 + "];\n", {"data"}), ("var a=" + "function(b){return b?b.c(1):void 0};var d=" * 40 + "0;\n", {"minified"}),
    ("\n".join(f"def get_x_{k}():\n    return self._f{k}" for k in range(30)), {"stubs"}), ("", set()), ("x", set()),
])
def test_signs(text, want):
    assert found("proj-1/src/a.rs", text) == want


def test_globs():
    yes = [("", "*.pb.go", "a/b/x.pb.go"), ("", "gen/*", "gen/x.go"), ("a", "gen/**", "a/gen/b/c.go"), ("", "**/out/*.js", "x/y/out/z.js"), ("", "**/out/*.js", "out/z.js"), ("a", "/x.c", "a/x.c"), ("", "f[0-9].c", "d/f3.c"), ("a.b", "x?z", "a.b/c/xyz"), ("", "a/**/z", "a/z")]
    no = [("", "*.pb.go", "x.pb.gox"), ("", "gen/*", "a/gen/x.go"), ("", "gen/*", "gen/a/x.go"), ("a", "gen/**", "gen/c.go"), ("a", "/x.c", "a/b/x.c"), ("", "f[!0-9].c", "f3.c"), ("a.b", "x", "aXb/x")]
    assert all(re.search(h.glob_regex(f, g), p) for f, g, p in yes) and not any(re.search(h.glob_regex(f, g), p) for f, g, p in no)


TEXT = "file_id string, path string, content string, digest string"


def judge(spark, texts, files=None, skipped=()):
    t = spark.createDataFrame([(f"f{k}", p, c, "clash") for k, (p, c) in enumerate(texts)], TEXT)
    f = spark.createDataFrame([(f"f{k}", p, 1) for k, (p, _) in enumerate(texts)] + [(None, p, 1) for p in files or []], "file_id string, path string, evident int")
    s = spark.createDataFrame([(p, b, 1) for p, b in skipped], "path string, content_bytes bigint, mtime_ns bigint")
    return {r.path: r.why for r in h.judged_files(f, t, s).collect()}


def test_attribute_files_decide_by_depth_and_line(spark):
    rules = "*.rs linguist-generated\nlib/** linguist-vendored=true\nlib/own.rs -linguist-vendored\n# x\n\"sp ace.rs\" linguist-generated"
    deep = "a.rs linguist-generated=false\nb.rs !linguist-generated\n"
    got = judge(spark, [("p/.gitattributes", rules), ("p/sub/.gitattributes", deep), ("p/x.rs", HAND), ("p/sub/a.rs", "// @generated by x\n" + HAND), ("p/sub/b.rs", HAND), ("q/x.rs", HAND), ("p/lib/y.py", HAND), ("p/lib/own.rs", HAND)])
    assert got == {"p/x.rs": "declared", "p/sub/a.rs": None, "p/sub/b.rs": None, "q/x.rs": None, "p/lib/y.py": "declared", "p/lib/own.rs": "declared"}


def test_undeclared_repositories(spark):
    gen = "// @generated by x\n" + HAND
    texts = [(f"p{k}/strange/a{k}_zap.rs", gen) for k in range(12)] + [("q/vendor/lib/a.rs", HAND + "//1"), ("q/core/copied.rs", HAND + "//1"), ("q/src/generate/emit_generated.rs", HAND + "//2"), ("q/vendor/own.rs", "// written by hand\n" + HAND), ("q/a.rs", HAND), ("q/a.rs", HAND)]
    texts += [("pr/vendor/b.rs", "// Imported unchanged from the otherlib release, see UPSTREAM\n" + HAND), ("pr/web/l.min.js", "var a=" + "function(b){return b?b.c(1):void 0};var d=" * 40 + "0;\n")]  # evidence for two names
    got = judge(spark, texts, ["z/strange/x.rs", "z/vendor/x.rs", None], [("z/big.py", 5_000_000), ("z/big.py", 1), ("z/small.zig", 50_000), ("z/web/a.min.js", 9), ("z/data.json", 9_000_000), ("z/y.lock", 9_000_000), ("z/n.rs", None), (None, 1)])
    assert {p: w for p, w in got.items() if not p.startswith("p")} == {
        "q/vendor/lib/a.rs": "by_name", "q/core/copied.rs": "copy", "q/src/generate/emit_generated.rs": None, "q/vendor/own.rs": None, "q/a.rs": None, "z/strange/x.rs": "by_name", "z/vendor/x.rs": "by_name", "z/big.py": "size", "z/small.zig": None, "z/web/a.min.js": "by_name", "z/n.rs": None}
    assert {w for p, w in got.items() if p.startswith("p")} == {"evident"}


def test_empty_tables(spark):
    assert judge(spark, []) == {}


def test_no_name_without_evidence(spark):
    got = judge(spark, [("q/vendor/lib/a.rs", HAND + "//1"), ("q/a.rs", HAND)], ["z/vendor/x.rs"], [("z/web/a.min.js", 9), ("z/a.bundle.js", 10), ("y/b.bundle.js", 3_000_000)])
    assert got == {"q/vendor/lib/a.rs": None, "q/a.rs": None, "z/vendor/x.rs": None, "z/web/a.min.js": None, "z/a.bundle.js": "by_name", "y/b.bundle.js": "size"}


def test_declarations_are_mined_for_undeclared_repositories(spark):
    texts = [(f"p{k}/.gitattributes", "zed/** linguist-generated\n") for k in range(9)] + [(f"p{k}/zed/a.rs", HAND + f"//{k}") for k in range(9)] + [("p0/sub/zed/b.rs", HAND + "//b")]
    got = judge(spark, texts + [("own/.gitattributes", "*.x linguist-vendored"), ("own/y.rs", HAND + "//y")], ["q/zed/c.rs", "own/zed/d.rs", "q/other/e.rs"])
    assert {got[f"p{k}/zed/a.rs"] for k in range(9)} == {"declared"} and got["q/zed/c.rs"] == "by_name"
    assert got["own/zed/d.rs"] is None and got["q/other/e.rs"] is None and got["p0/sub/zed/b.rs"] is None  # these repositories declare for themselves


def test_macros_and_names_of_attribute_files(spark):
    rules = "[attr]made linguist-generated=true text\n[attr]twice made\n*.pb.rs made\n*.tw.rs twice\nkeep.pb.rs -linguist-generated\nun.pb.rs -made\n"
    got = judge(spark, [("p/.gitattributes", rules), ("p/a.pb.rs", HAND), ("p/a.tw.rs", HAND + "//1"), ("p/keep.pb.rs", HAND + "//2"), ("p/un.pb.rs", HAND + "//3"), ("q/x.gitattributes", "*.rs linguist-generated"), ("q/b.rs", HAND + "//4"), ("p/x/.gitattributes", "")])
    assert got == {"p/a.pb.rs": "declared", "p/a.tw.rs": "declared", "p/keep.pb.rs": None, "p/un.pb.rs": "declared", "q/b.rs": None}
    assert judge(spark, [(".gitattributes", "/p/gen/* linguist-generated"), ("p/gen/a.rs", HAND), ("p/b.rs", HAND + "//1")]) == {"p/gen/a.rs": "declared", "p/b.rs": None}


LICENCE = [f"// Permission line {k} of a long licence text." for k in range(40)]


@pytest.mark.parametrize("text", [
    "\n".join(LICENCE) + "\n//\n\n// Code generated by stubber. DO NOT EDIT.\n" + HAND,
    "/*\n" + "\n".join(x[3:] for x in LICENCE) + "\n Generated by stubber, do not edit.\n*/\n" + HAND,
    '"""Long docstring.\n\n' + "\n".join(x[3:] for x in LICENCE) + '\n\nThis file was generated by stubber.\n"""\nimport a\n\n\ndef f():\n    return a.b\n',
    "// " + "x" * 3000 + " @generated by x\n" + HAND,
    HAND + "\n".join(LICENCE[:9]) + "\n// @generated by x\n" + "\n".join(LICENCE[:9]) + "\n",
    HAND + "/*\n@generated by x\n" + "\n".join(x[3:] for x in LICENCE) + "\n*/\n",
])
def test_marks_anywhere_in_long_comments(text):
    assert "generated" in found("proj-1/src/a.rs", text)


def test_comments_end_where_code_begins():
    from tessera.llm.evidence import accessors, comments, declared_name

    head, tail = comments("#!/bin/x\n/* a */ // b\n\nuse c; // d\n/* e\n f */\n}\n")
    assert (head, tail) == (["#!/bin/x", "/* a */", "// b"], ["/* e", "f */"])
    assert comments("") == comments("x = 1 /* a */") == ([], []) and comments("// only") == (["// only"], [])
    assert [declared_name(x) for x in ("def get_1(self):", "fn a<T>(x: T) -> B {", "if (x) {", "x = f(1) + g(2) {", "while(a(b)) {", "let f = (x) =>", "} else {", "", "m(" + "a, " * 500 + "b) {")] == ["get_1", "a", None, "g", None, None, None, None, "m"]
    assert accessors("\n".join(f"def get_{k}({'a, ' * 300}):\n    pass" for k in range(8))) == 1.0
    for text in ("/*" * 50_000, "// x\n" * 50_000, "*/\n" * 20_000, '"""' * 30_000, "(" * 100_000 + ") {", "}\n" * 100_000):
        signs("p/a.rs", text)
