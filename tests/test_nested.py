import datetime as dt
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import nested

settings.register_profile("quick", max_examples=80, deadline=None)
settings.load_profile("quick")
SCHEMA = "record_id bigint, collected_at timestamp_ntz, origin string, payload string, row_id string, kind string"
text = st.text(alphabet='ab"\\{}[],: \n\té\u4e2d', max_size=8)
value = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | text, lambda v: st.lists(v, max_size=3) | st.dictionaries(text, v, max_size=3), max_leaves=12)


def plain(ix, slot):
    """A slot's value, rebuilt from the index."""
    inner = ix.inner[slot]
    if inner < 0:
        return json.loads(ix.raw[ix.value[slot]:ix.value_end[slot]], strict=False)
    return box(ix, int(inner))


def box(ix, token):
    import numpy as np

    _, slots = ix.slots_of(np.array([token]))
    if ix.ch[token] == nested.OPEN[0]:
        return {ix.key_text(int(s)): plain(ix, int(s)) for s in slots}
    return [plain(ix, int(s)) for s in slots]


@given(st.lists(st.tuples(st.dictionaries(text, value, max_size=4), st.sampled_from([None, 1, "\t"])), min_size=1, max_size=4))
def test_index_rebuilds_any_json(docs):
    texts = [json.dumps(d, indent=i, ensure_ascii=bool(len(d) % 2)).encode() for d, i in docs]
    ix = nested.Index(texts)
    assert ix.ok.all()
    for (d, _), root in zip(docs, ix.roots):
        assert box(ix, int(root)) == d


@given(st.dictionaries(text, value, min_size=1, max_size=4), st.integers(1, 60))
def test_cut_off_texts_are_not_ok(doc, n):
    whole = json.dumps(doc).encode()
    ix = nested.Index([whole, whole[: -min(n, len(whole) - 1)], b"", whole + b"}", b"[1]", b"]{", b'{"a": [1}', whole])
    assert ix.ok.tolist() == [True, False, False, False, False, False, False, True]
    assert box(ix, int(ix.roots[7])) == doc


def test_truth():
    assert [nested.truth(x) for x in ("true", " FALSE ", "0", "1", "0.0", "", None, "maybe", "null")] == [True, False, False, True, False, None, None, None, None]


def records(spark, payloads):
    return spark.createDataFrame([(i, dt.datetime(2026, 1, 1), None, p, "clash", "clash") for i, p in payloads], SCHEMA)


def receipt(status="failed", complete=False, **more):
    return {"status": status, "process_cleanup": {"complete": complete}, **more}


def test_places_spellings_and_nesting(spark, rows):
    inner = {"case_id": "x", "repeat": 1, "receipt": receipt("ok", True, added_tests={"observed_names": ["t1", "t2"], "receipt": receipt()},
                                                            runtime_setup=[{"command_id": "c", "process_cleanup": {"complete": False}, "retained_traces": {"log": {"status": "partial"}}}])}
    payloads = [
        (1, json.dumps({"case_id": "a", "repeat": 2, "receipt": receipt(" Failed ", "False")})),
        (2, json.dumps({"cases": [{"case_id": "b", "repeat": 1, "receipt": json.dumps(receipt("FAILED", 0))}, inner, {"case_id": "n", "repeat": 3, "receipt": None}, 5, None]})),
        (3, json.dumps({"campaign": {"groups": [{"attempts": None}, {"attempts": [{"case_id": "c", "repeat": 1, "receipt": receipt(complete=None)}, {"case_id": "d", "repeat": 4, "receipt": receipt()}]}]}})),
        (3, json.dumps({"campaign": {"groups": [{"attempts": None}, {"attempts": [{"case_id": "c", "repeat": 1, "receipt": receipt(complete=None)}, {"case_id": "d", "repeat": 4, "receipt": receipt()}]}]}})),
        (4, None), (5, ""), (6, json.dumps({"case_id": "e", "repeat": 1, "receipt": receipt()})[:-3]), (None, json.dumps({"case_id": "f", "repeat": 1, "receipt": receipt()})),
        (7, json.dumps({"case_id": "g", "repeat": 1, "receipt": {"status": "failed"}})), (8, json.dumps({"cas\\u0065s": 1})), (9, '{"c\\u0061se_id": "h", "repeat": 1, "receipt": {"status": "failed", "process_cleanup": {"complete": "0"}}}'),
    ]
    linked = nested.rows(records(spark, payloads))
    assert rows(nested.failed_without_cleanup(linked)) == [(1, "a", 2), (2, "b", 1), (3, "d", 4), (9, "h", 1)]
    tests = nested.flat_table(linked, "test").collect()
    assert sorted((r.name, r.parent_id, r.receipt_status, r.cleanup_complete) for r in tests) == [("t1", "cases[1].receipt.added_tests", "ok", True), ("t2", "cases[1].receipt.added_tests", "ok", True)]
    assert {r.owner for r in nested.flat_table(linked, "cleanup").collect()} == {"receipt", "command", "tests"}
    trace = nested.flat_table(linked, "trace").first()
    assert (trace.parent_id, trace.owner, trace.status) == ("cases[1].receipt.runtime_setup[0]", "command", "partial")
    ids = {(r.record_id, r.row_id) for r in linked.collect()}
    assert all(r.parent_id == "" or (r.record_id, r.parent_id) in ids for r in linked.collect())


def test_long_payloads_and_empty_table(spark):
    rng = random.Random(0)
    big = {"cases": [{"case_id": f"c{k}", "repeat": k, "receipt": receipt(rng.choice(["failed", "ok"]), rng.choice([True, False]), failure="x" * 50)} for k in range(30_000)]}
    got = nested.failed_without_cleanup(nested.rows(records(spark, [(1, json.dumps(big))]))).count()
    assert got == sum(c["receipt"]["status"] == "failed" and c["receipt"]["process_cleanup"]["complete"] is False for c in big["cases"])
    assert nested.rows(records(spark, [])).count() == 0


def test_steps_and_missing_outputs_are_rows_with_links(spark):
    entry = {"case_id": "x", "repeat": 2**60 + 1, "indexing": {"status": "ok", "process_cleanup": {"complete": True}},
             "receipt": receipt(added_tests={"receipt": receipt("partial")}, runtime_setup=[{"command_id": "c", "expected_output_missing": ["a", None, "b"]}])}
    linked = nested.rows(records(spark, [(1, json.dumps({"cases": [entry, {"case_id": "y", "repeat": "3.0"}, {"case_id": "z", "repeat": "x"}]}))]))
    by = {r.row_id: r for r in linked.collect()}
    assert by["cases[0].indexing.process_cleanup"].parent_id == "cases[0].indexing" and by["cases[0].indexing"].parent_id == "cases[0]"
    assert by["cases[0].receipt.added_tests.receipt.process_cleanup"].parent_id == "cases[0].receipt.added_tests.receipt"
    assert {(r.owner, r.status) for r in nested.flat_table(linked, "step").collect()} == {("indexing", "ok"), ("tests", "partial")}
    assert {(r.parent_id, r.name) for r in nested.flat_table(linked, "output").collect()} == {("cases[0].receipt.runtime_setup[0]", "a"), ("cases[0].receipt.runtime_setup[0]", "b")}
    assert [by[f"cases[{k}]"].repeat for k in range(3)] == [2**60 + 1, 3, None]
    assert {r.kind for r in nested.rows(records(spark, [(1, json.dumps(entry))]), "output", "step").collect()} == {"output", "step"}


def test_receipts_inside_many_strings(spark, rows):
    text = receipt()
    for _ in range(7):
        text = json.dumps(text)
    linked = nested.rows(records(spark, [(1, json.dumps({"case_id": "a", "repeat": 1, "receipt": text}))]), "receipt")
    assert rows(nested.failed_without_cleanup(linked)) == [(1, "a", 1)]
