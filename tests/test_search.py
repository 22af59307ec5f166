import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import lookup

SYM = "symbol_id string, name string, kind string, signature string, doc_comment string, parent_symbol_id string, file_id string, language string, query string"


def table(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r)), "f" + r[0], "python", "clash") for r in rows], SYM)


def queries(spark, *q):
    return spark.createDataFrame([(x,) for x in q], "query string")


def ranked(df, query):
    return [r.symbol_id for r in df.where(F.col("query") == query).orderBy("place").collect()]


def test_scores_ties_and_coverage(spark):
    s = table(spark, ("a", "load_config", "function", "def load_config(path)", "Load the config of a path."), ("b", "load_config", "function"), ("c", "_load_config", "function"), ("d", "loads", "function"), ("e", "reloaded", "function"),
              ("f", "other", "function", "other(load)"), ("g", "config", "constant"), ("h", None, "function"), ("i", "load_config", "constant"))
    got = {r.symbol_id: r for r in lookup.search_all_fields(s, queries(spark, "load config")).collect()}
    n = {"load": math.log1p(9 / 6), "config": math.log1p(9 / 6)}  # words as they stand: load a b c f i, config a b c g i
    both = sum(n.values())
    want = {"a": 3 * both + 160 + 6, "b": 3 * both + 160, "c": 3 * both + 160, "i": 3 * both + 120, "d": 2 * n["load"], "e": 1 * n["load"], "f": n["load"], "g": 3 * n["config"]}
    assert set(got) == set(want) and all(abs(got[k].score - v) < 1e-5 for k, v in want.items())
    assert [k for k in sorted(got, key=lambda k: got[k].place)][:4] == ["a", "b", "c", "i"]


def test_rows_of_one_word_leave_behind_better_ones(spark):
    s = table(spark, *[(f"x{k}", f"load_config_{'abcdef'[k]}", "function") for k in range(4)], ("one", "load", "function"), ("rare", "config", "function"), *[(f"l{k}", f"load_{'uvwxyz'[k]}", "variable") for k in range(5)])
    df = lookup.search_all_fields(s, queries(spark, "load config"), limit=3)
    assert len(ranked(df, "load config")) == 3
    wide = lookup.search_all_fields(s, queries(spark, "load config"), limit=5)
    assert set(ranked(wide, "load config")) == {"x0", "x1", "x2", "x3", "rare"} or "one" in ranked(wide, "load config")
    narrow = lookup.search_all_fields(s, queries(spark, "load config"), limit=4)
    assert set(ranked(narrow, "load config")) == {"x0", "x1", "x2", "x3"}


def test_members_of_types(spark):
    s = table(spark, ("T", "QueueReader", "class"), ("m", "next", "method", "next(reader)", None, "T"), ("o", "next", "method", "next(reader)", None, None), ("p", "close", "method", None, None, "T"))
    plain = {r.symbol_id: r.score for r in lookup.search_all_fields(s, queries(spark, "queue reader")).collect()}
    more = {r.symbol_id: r.score for r in lookup.search_all_fields(s, queries(spark, "queue reader"), members=True).collect()}
    assert plain["m"] == plain["o"] and more["m"] > more["o"] == plain["o"] and "p" not in more and more["T"] == plain["T"]


def test_recall_against_brute_force(spark):
    """Every symbol that bears a word in any way is among the answers, if the limit allows."""
    import random

    rng = random.Random(4)
    words = ["load", "loads", "config", "file", "reader", "queue", "next", "open", "opened", "state"]
    rows = [(f"s{k}", "_".join(rng.sample(words, rng.randrange(1, 4))), rng.choice(["function", "constant"]), rng.choice([None, f"f({rng.choice(words)})"]), rng.choice([None, f"The {rng.choice(words)}."])) for k in range(80)]
    s = table(spark, *rows)
    asked = ["load file", "open", "state queue next"]
    got = lookup.search_all_fields(s, queries(spark, *asked), limit=200)
    from tessera.functions.stem import stems

    st = {w: spark.range(1).select(stems(F.array(F.lit(w)))[0]).first()[0] for w in words}
    for q in asked:
        terms = q.split()
        bears = {i for i, name, _, sig, doc, *_ in [(*r, None) for r in rows] if any(t in name.split("_") or st[t] in [st[x] for x in name.split("_")] or t in name or t in (sig or "").replace("(", " ").replace(")", " ").split() or t in (doc or "").lower().replace(".", "").split() for t in terms)}
        assert set(ranked(got, q)) == bears


def words_and_symbols(spark, seed=7, n=400):
    import random

    rng = random.Random(seed)
    words = ["load", "loads", "config", "file", "reader", "queue", "next", "open", "opened", "state", "get", "id", "7"]
    some = lambda *k: rng.sample(words, rng.choice(k))
    rows = [(f"s{k:03}", rng.choice(["", "", "_"]) + "_".join(some(1, 2, 3)), rng.choice(["function", "method", "constant", "class", None]), rng.choice([None, f"f({', '.join(some(1, 2, 3))})"]), rng.choice([None, f"The {' '.join(some(1, 2, 4))}."])) for k in range(n)]
    rows += [("null", None, "function", "load(config)", "Open the file."), ("twin", "load_config", "function"), ("twin2", "load_config", "function"), ("odd", "été_load", "function")]
    asked = [" ".join(x) for k in (1, 2, 3, 4) for x in (rng.sample(words, k) for _ in range(8))] + ["load config", "LoadConfig", "nowhere", "nowhere load", "was", "", "été load"]
    return table(spark, *rows), queries(spark, *asked, None)


@pytest.mark.parametrize("limit, most, together", [(1, 8, 50_000), (3, 8, 50_000), (10, 8, 3), (10, 2, 50_000), (500, 8, 50_000)])
def test_first_rows_are_those_of_all_rows(spark, rows, monkeypatch, limit, most, together):
    """Sets of words answered once give what scoring every row gives, whatever the limit, in passes and beside long queries."""
    s, q = words_and_symbols(spark)
    every = lookup._all_rows(s, q.select("query", names.content_words(F.array_distinct(names.tokens(F.col("query")))).alias("terms")).where("size(terms) > 0").distinct(), s.count(), limit, False)
    monkeypatch.setattr(lookup, "MOST_WORDS", most)
    monkeypatch.setattr(lookup, "SETS_TOGETHER", together)
    assert rows(lookup.search_all_fields(s, q, limit)) == rows(every)


def test_queries_score_few_rows(spark, monkeypatch):
    """Rows that are scored grow with the queries' sets of words, not with the symbols that bear a word."""
    s, _ = words_and_symbols(spark)
    scored, rank = [], lookup._ranked
    monkeypatch.setattr(lookup, "_ranked", lambda df, *a: scored.append(df.count()) or rank(df, *a))
    lookup.search_all_fields(s, spark.createDataFrame([("load config",), ("file config",)], "query string"), 2).collect()
    assert sum(scored) <= 2 * 3 * 2  # queries, subsets of their words, limit


def test_steps_of_a_task_do_not_change_its_rows(monkeypatch):
    import random

    import pyarrow as pa

    from tessera.operators import ranked as r

    rng = random.Random(3)
    words = [f"w{c}" for c in "abcdefgh"]
    some = lambda: rng.sample(words, rng.randrange(1, 5))
    data = [{"symbol_id": f"{k:03}", "name": "_".join(n := some()), "kind": "function", "hidden": False, "callable": k % 2 == 0, "strong": True, "low": "_".join(n), "words": n, "sig": some(), "doc": None if k % 3 else some()} for k in range(120)]
    batch = pa.RecordBatch.from_pylist(data, pa.schema([(c, pa.list_(pa.string()) if c in ("words", "sig", "doc") else pa.bool_() if c in ("hidden", "callable", "strong") else pa.string()) for c in data[0]]))
    tree = r.Words([sorted(some()) for _ in range(30)], {w: 1.0 + k / 7 for k, w in enumerate(words)})
    got = []
    for held, step in ((r.HELD, r.STEP), (20, 3)):
        monkeypatch.setattr(r, "HELD", held)
        monkeypatch.setattr(r, "STEP", step)
        run = r.first_rows(tree, 4, (3.0, 2.0, 1.0, 1.0), (100.0, 60.0, 60.0, 6.0))
        got.append(sorted((a["list"], round(a["score"], 6), x["symbol_id"], tuple(x["hits"])) for b in run(iter([batch])) for x in b.to_pylist() for a in x["at"]))
    assert got[0] == got[1] and got[0] and list(run(iter([]))) == [] and list(run(iter([batch.slice(0, 0)]))) == []


def test_answers_by_source(spark):
    s = table(spark, ("1", "parse", "function"), ("2", "parse_file", "function"), ("3", "os", "import"), ("4", "os", "import"), ("5", "fn", "function"), ("6", "parse_local", "variable", None, None, "5"), ("7", "format_symbol_body", "function"), ("8", "readThing", "function", None, "parse things"))
    got = {}
    for r in lookup.answer(s, queries(spark, "parse", "os", "things", "format_sybmol_body", "zzz", None, "")).collect():
        got.setdefault(r.query, []).append((r.source, r.symbol_id, r.name))
    assert got["parse"] == [("name", "1", "parse"), ("name", "2", "parse_file")] and got["os"] == [("name", "3", "os")]
    assert ("search", "8", "readThing") in got["things"] and ("suggestion", None, "format_symbol_body") in got["format_sybmol_body"] or any(x[0] == "search" for x in got["format_sybmol_body"])
    assert set(got) == {"parse", "os", "things", "format_sybmol_body"}


def test_selectors(spark, rows):
    s = table(spark, ("1", "parse", "function"), ("2", "parse", "function"), ("3", "alone", "function"), ("4", "1", "function"))
    files = spark.createDataFrame([("f1", "h1"), ("f3", "h3")], "file_id string, content_hash string")
    asked = spark.createDataFrame([("1", "h1"), ("parse", None), ("alone", "old"), ("3", None), ("gone", None)], "asked string, hash string")
    assert rows(lookup.select(s, asked, files)) == [("1", "1", "found"), ("3", "3", "found"), ("alone", "3", "stale"), ("gone", None, "missing"), ("parse", None, "ambiguous")]
    assert [r.symbol_id for r in lookup.by_id(s, spark.createDataFrame([("1",), ("parse",), (None,)], "asked string")).collect()] == ["1"]
    k = spark.createDataFrame([("a", "class", "html", "x"), ("b", "class", "python", "x"), ("c", "element", "x", "x"), ("d", None, None, None)], "symbol_id string, kind string, language string, name string")
    assert [r.symbol_id for r in lookup.of_kind(k, "element").orderBy("symbol_id").collect()] == ["a", "c"] and lookup.of_kind(k, "class").count() == 2


def test_module_names(spark):
    cases = {("a/b/__init__.py", "python"): "b", ("a/b/c.py", "python"): "c", ("web/index.ts", "typescript"): "web", ("src/mod.rs", "rust"): "src", ("pkg/x_y.go", "go"): "pkg", ("main.go", "go"): None, ("noext", None): "noext"}
    df = spark.createDataFrame([(p, l) for p, l in cases], "p string, l string").select("p", lookup.module_name(F.col("p"), F.col("l")).alias("m"))
    assert {r.p: r.m for r in df.collect()} == {p: m for (p, _), m in cases.items()}


@pytest.mark.parametrize("pattern, yes, no", [("anonymous_class_L[0-9]*", "anonymous_class_L12", "anonymous_class_Lx"), ("*/a.py", "x/y/a.py", "a.py"), ("a?c", "abc", "ac"), ("[^a]b", "cb", "ab"), ("a.b", "a.b", "axb"), ("[x", "[x", "x")])
def test_glob(spark, pattern, yes, no):
    r = spark.range(1).select(names.glob(F.lit(yes), pattern).alias("y"), names.glob(F.lit(no), pattern).alias("n")).first()
    assert (r.y, r.n) == (True, False)


@pytest.mark.parametrize("pattern, yes, no", [("AB%", "abc", "xab"), ("a\\%b", "A%b", "axb"), ("_b", "xb", "xxb"), ("a.b", "a.B", "axb"), ("Äx", "ÄX", "äx")])
def test_like(spark, pattern, yes, no):
    r = spark.range(1).select(names.like(F.lit(yes), pattern).alias("y"), names.like(F.lit(no), pattern).alias("n")).first()
    assert (r.y, r.n) == (True, False)


def test_anonymous_classes_and_lambdas(spark):
    cols = "symbol_id string, name string, kind string, signature string, parent_symbol_id string, metadata_json string"
    meta = '{"type": "anonymous_class"}'
    s = spark.createDataFrame([("f", "make", "method", None, None, None), ("a", "anonymous_class_L3", "class", "new Task() {", "f", meta), ("b", "anonymous_class_L5", "class", "new Inner<T>() {", "a", meta), ("c", "anonymous_class_L9", "class", None, None, meta), ("d", "anonymous_class_L9", "class", "new X()", "f", "{"),
                               ("e", "anonymous_class_L1", "class", "object : Runner {", "gone", meta)], cols)
    got = {r.symbol_id: r.name for r in names.name_anonymous_classes(s).collect()}
    assert got == {"f": "make", "a": "<anonymous Task in make>", "b": "<anonymous Inner in <anonymous Task in make>>", "c": "<anonymous>", "d": "anonymous_class_L9", "e": "<anonymous Runner>"}
    r = spark.range(1).select(*[names.is_generated_lambda(*map(F.lit, x)).alias(k) for k, x in {"a": ("lambda_3", "python", "function", "lambda x: x"), "b": ("lambda_3", "python", "function", "def x"), "c": ("lambdas", "python", "function", "lambda x")}.items()]).first()
    assert tuple(r) == (True, False, False)
