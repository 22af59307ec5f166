import json

import pytest

from tessera.llm import docpairs
from tessera.llm.describe import description, metadata_text
from tessera.llm.lexer import functions

GOOD = ["Blocks until the queue is warm", "/** Retries twice. TODO: make it a setting. */", "# Deprecated: call the other one.", '"""索引は次の段階の前に作り直されます。"""', "/// <summary>\n/// Keeps it alive while a reader holds it.\n/// </summary>",
        "@param queue the broken queue to use", ":param a: how many rows to keep", "@deprecated use the cursor instead", "42 is the largest size seen in practice.", "Loads the file.\n\n@return null where it is missing", "/* Panics if the file was moved meanwhile */",
        "Le résultat reste vide.", "Example:\n    load(3)\n\nKeeps the order of the rows."]
BAD = ["", None, "  ", "/** */", "Loads the file.", "load_file", "loadFile method", "Load a file", "TODO", "FIXME: add docs", "XXX describe this", "tbd.", "n/a", "...", "-", "-------", "==== Public API ====", "--- helpers ---", "region Helpers", "#endregion",
       "@param a\n@param b\n@return", ":param a:\n:return:", "@override", "{@inheritDoc}", "<inheritdoc/>", "/// <summary>\n/// </summary>", "noqa: E501", "eslint-disable-next-line no-shadow", "@ts-ignore", "type: ignore", "// nolint:errcheck", "go:noinline", "CHECKSTYLE:OFF", "clang-format off",
       "SPDX-License-Identifier: MIT", "@author team-blue", "@since 1.4", "Created 2022-03-14", "Copyright 2020 the authors", "Author: someone", "if (x != null) return x;", "return load(3);", "x = compute(y)", "Auto-generated method stub", "TODO Auto-generated method stub", "No documentation.",
       "Missing documentation", "Description of the method.", "(undocumented)", "Example:\n    load(3)"]


@pytest.mark.parametrize("doc", GOOD)
def test_descriptions(doc):
    assert description("load_file", "function", doc)


@pytest.mark.parametrize("doc", BAD)
def test_no_descriptions(doc):
    assert description("load_file", "function", doc) is None


@pytest.mark.parametrize("doc", ["Constructor.", "Default constructor.", "Creates a new instance.", "Initializes a new instance of Reader", "ctor", "The constructor"])
def test_constructors_construct(doc):
    assert description("Reader", "constructor", doc) is None
    assert description("Reader", "constructor", doc + " Takes the lock for reading only.")


def test_metadata_texts():
    assert metadata_text('{"doc": {"lines": ["a", "b"], "style": "block"}}') == "a\nb"
    assert metadata_text('{"docs": [{"kind": "comment", "value": "x"}]}') == "x" and metadata_text('{"documentation": {"text": "t", "format": "markdown"}}') == "t"
    assert [metadata_text(m) for m in (None, "", "{}", '{"docs": ', '{"role": "local"}', '{"docstring": ""}', "[1]")] == [None] * 7


SOURCES = {
    "rust": 'use a;\n\n/// Says "{" twice.\npub fn first(a: &\'static str) -> u8 {\n    let s = "}"; // }\n    if a.is_empty() { return b\'{\'; }\n    0\n}\nimpl X {\n    /* gone */\n\n    pub fn new(&self) -> Self { X {} }\n}\n',
    "java": "class A {\n    /** Builds { it. */\n    @Override\n    public A(int x) {\n        for (int i = 0; i < 3; i++) { run(i); }\n    }\n    char c = '{';\n    String name() { return \"}\"; }\n}\n",
    "typescript": "// note\nexport function f(a: string): number {\n  const g = (x) => { return `${x} {`; };\n  while (a) { a = h(a); }\n  return 1;\n}\nclass B {\n  /** Reads. */\n  read(): void {\n  }\n}\n",
    "go": 'package p\n\n// Opens it.\n//\n// Twice.\nfunc (r *R) Open(n string) (*F, error) {\n\tx, err := make(n)\n\tif err != nil { return nil, err }\n\treturn `}`, nil\n}\n\nfunc Close() {\n}\n',
    "python": 'import a\n\n# above\ndef f(x, y=("{", 1)):\n    return """\ndef fake():\n"""\n\nclass C:\n    async def g(self):\n        """Waits.\n\n        Long."""\n        def inner():\n            pass\n        return inner\n\n    def h(self): return 1\n# end\n',
}


@pytest.mark.parametrize("language, want", [
    ("rust", [("first", '/// Says "{" twice.', "0\n}"), ("new", None, "X {} }")]), ("java", [("A", "/** Builds { it. */", "}\n    }"), ("name", None, '"}"; }')]),
    ("typescript", [("f", "// note", "1;\n}"), ("g", None, "{`; };"), ("read", "/** Reads. */", "{\n  }")]), ("go", [("Open", "// Opens it.\n//\n// Twice.", "nil\n}"), ("Close", None, "{\n}")]),
    ("python", [("f", "# above", '"""'), ("g", '"""Waits.\n\n        Long."""', "return inner"), ("inner", None, "pass"), ("h", None, "return 1")]),
])
def test_lexer(language, want):
    text = SOURCES[language]
    got = sorted(functions(text, language), key=lambda f: f.start)
    assert [(f.name, f.comment) for f in got] == [w[:2] for w in want]
    assert all(text[f.start:f.end].endswith(w[2]) for f, w in zip(got, want))


def test_lexer_on_broken_texts():
    for text in ("", "}}}{{{", "/* open", '"open', "def f(", "fn a() {", "`", "'" * 99, "(" * 3000 + "{" * 3000):
        for language in ("rust", "python", "javascript", "java", ""):
            functions(text, language)


SYM = "symbol_id string, file_id string, path string, language string, name string, kind string, doc_comment string, metadata_json string, start_byte int, code string, comment string"


def test_pairs(spark):
    text = "é\n" + SOURCES["go"]
    at = text.encode().index(b"func (r")
    rows = [("a", "f", "x.go", "golang", "Open", "Method", "Opens it twice.", None, at), ("a", "f", "x.go", None, "Open", "method", None, None, at), ("b", "f", "x.go", None, "Close", "function", " ", json.dumps({"doc": "Waits for all readers."}), 0),
            ("c", "g", "y.py", "py", "h", "function", None, '{"docs": ', 1), ("d", "g", "y.py", "py", "h", "class", "Real words here.", None, 1), ("e", "g", None, None, None, "constructor", "Real words here.", None, None), (None, "g", None, None, None, "method", "Real words.", None, 1)]
    s = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SYM)
    t = spark.createDataFrame([("f", "x.go", text), ("n", "y.py", None), (None, "y.py", "def f(): pass")], "file_id string, path string, content string")
    got = {r.symbol_id: r for r in docpairs.documented_functions(s, t).collect()}
    assert set(got) == {"a", "b", "e"} and got["a"].language == "go" and got["b"].language == "go" and got["b"].code is None
    assert got["a"].code.startswith("func (r *R) Open") and got["a"].comment.startswith("// Opens it.")
    assert docpairs.documented_functions(s.limit(0), t.limit(0)).count() == 0


def test_the_lexed_comment_is_what_is_judged(spark):
    """A symbol whose text says TODO is no pair, whatever its row says; one without text is judged by its row."""
    text = "// TODO\nfunc a() {\n}\n\n// Waits for all readers.\nfunc b() {\n}\n\nfunc c() {\n}\n"
    at = {n: text.index(f"func {n}") for n in "abc"}
    rows = [("a", "f", "x.go", "go", "a", "function", "Real words here.", None, at["a"]), ("b", "f", "x.go", "go", "b", "function", "TODO", None, at["b"]), ("c", "f", "x.go", "go", "c", "function", "Counts what is left.", None, at["c"]),
            ("d", "f", "x.go", "go", "d", "function", "Counts what is left.", None, None), ("e", "g", "y.go", "go", "e", "function", "Counts what is left.", None, 3), ("n", "f", "x.go", "go", "b", "function", None, None, at["b"])]
    s = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SYM)
    t = spark.createDataFrame([("f", "x.go", text), ("f", "x.go", text)], "file_id string, path string, content string")
    for with_code in (True, False):
        got = {r.symbol_id: r for r in docpairs.documented_functions(s, t, with_code).collect()}
        assert set(got) == {"b", "c", "d", "e"} and got["b"].description == "Waits for all readers." and got["b"].agrees is False and got["c"].agrees is None
    plan = docpairs.documented_functions(s, t, False).select("symbol_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" in plan


def test_comments_agree_with_the_given_documentation(spark):
    import os

    from tessera.llm.plans import p3_agreement

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    r = p3_agreement(spark, "/root/testdata/sf0.001").collect()
    assert sum(x.lexed for x in r) > 0.9 * sum(x.described for x in r) and sum(x.agreeing for x in r) == sum(x.lexed for x in r)
