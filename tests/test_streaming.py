import datetime as dt
import time

import pytest

from tessera.streaming import debounce as d


def ev(kind, path="/w/f", at=0, tracker=None, to=None):
    return {"kind": kind, "time": at, "paths": [path] if to is None else [path, to], "tracker": tracker}


def kinds(q, path="/w/f"):
    return [e["kind"] for e in q.queues.get(path, [])]


@pytest.mark.parametrize("before, after, left", [
    (["create-any"], "remove-any", ["remove-any"]), (["remove-any"], "create-any", ["remove-any", "create-any"]), (["create-file"], "modify-data-content", ["create-file"]), (["create-any"], "create-any", ["create-any"]),
    (["modify-any"], "modify-any", ["modify-any", "modify-any"]), (["create-any", "modify-any"], "remove-any", ["remove-any"]),
])
def test_push(before, after, left):
    q = d.Queues()
    for k in [*before, after]:
        q.add(ev(k))
    assert kinds(q) == left


def test_remove_of_a_folder_drops_queues_below():
    q = d.Queues()
    for p in ("/w/a/x", "/w/a/b/y", "/w/ab"):
        q.add(ev("modify-any", p))
    q.add(ev("remove-any", "/w/a"))
    assert sorted(q.queues) == ["/w/a", "/w/ab"]


def test_rename_halves_meet_by_tracker():
    q = d.Queues()
    q.add(ev("rename-from", "/w/s", tracker=1))
    q.add(ev("rename-to", "/w/t", tracker=1))
    assert kinds(q, "/w/t") == ["rename-both"] and q.queues["/w/t"][0]["paths"] == ["/w/s", "/w/t"] and not q.queues.get("/w/s")
    q = d.Queues()
    q.add(ev("rename-from", "/w/s", tracker=1))
    q.add(ev("rename-to", "/w/t", tracker=2))
    assert kinds(q, "/w/t") == ["rename-to"] and kinds(q, "/w/s") == ["rename-from"]
    q = d.Queues()
    q.add(ev("create-file", "/w/s"))
    q.add(ev("rename-from", "/w/s", tracker=3))
    q.add(ev("rename-to", "/w/t", tracker=3))
    assert kinds(q, "/w/t") == ["create-file"]


def times(q, path):
    return [(e["kind"], e["time"], e["paths"]) for e in q.queues.get(path, [])]


def rename(q, a, b, at, to=None):
    q.add(ev("rename-from", a, at, tracker=at))
    q.add(ev("rename-to", b, to or at + 1, tracker=at))


def test_whole_renames_are_left_to_their_halves():
    q = d.Queues()
    q.add(ev("rename-both", "/w/s", to="/w/t"))
    assert q.queues == {}


def test_rename_after_rename_keeps_the_first_source_and_time():
    q = d.Queues()
    rename(q, "/w/a", "/w/b", 1)
    rename(q, "/w/b", "/w/c", 5)
    assert times(q, "/w/c") == [("rename-both", 1, ["/w/a", "/w/c"])] and list(q.queues) == ["/w/c"]


def test_rename_carries_changes_along():
    q = d.Queues()
    q.add(ev("modify-any", "/w/a", 1))
    rename(q, "/w/a", "/w/b", 3)
    assert times(q, "/w/b") == [("rename-both", 3, ["/w/a", "/w/b"]), ("modify-any", 1, ["/w/b"])]


def test_rename_overrides_what_waits_for_the_target():
    for waiting, info, kinds_ in (("modify-any", "override", ["remove-any", "rename-both"]), ("remove-any", None, ["remove-any", "rename-both"]), ("create-file", None, ["rename-both"])):
        q = d.Queues()
        q.add(ev(waiting, "/w/t", 1))
        rename(q, "/w/s", "/w/t", 3)
        assert kinds(q, "/w/t") == kinds_ and q.queues["/w/t"][0].get("info") == info


def test_removal_before_a_rename_stays_behind():
    q = d.Queues()
    q.add(ev("remove-any", "/w/s", 1))
    q.add(ev("modify-any", "/w/s", 2))
    rename(q, "/w/s", "/w/t", 3)
    assert kinds(q, "/w/s") == ["remove-any"] and kinds(q, "/w/t") == ["rename-both", "modify-any"]


def test_file_ids_and_renames_of_unknown_half():
    q = d.Queues()
    q.add({**ev("rename-any", "/w/s", 1), "exists": False, "file_id": 7})
    q.add({**ev("rename-any", "/w/t", 2), "exists": True, "file_id": 7})
    assert times(q, "/w/t") == [("rename-both", 1, ["/w/s", "/w/t"])]
    q = d.Queues()
    q.add({**ev("rename-from", "/w/s", 1), "file_id": 7})
    q.add({**ev("rename-to", "/w/t", 2), "file_id": 7})
    assert times(q, "/w/t") == [("rename-both", 1, ["/w/s", "/w/t"])]


def test_changes_after_a_creation_are_part_of_it_however_late():
    q = d.Queues()
    for k in ("create-file", "close-write", "modify-any", "create-any"):
        q.add(ev(k))
    assert kinds(q) == ["create-file", "close-write"]


def test_rescans_wait_for_the_timeout():
    q = d.Queues()
    q.add({"kind": "rescan", "time": 10, "paths": []})
    assert q.emit(12, 5) == [] and q.next_due(5) == 15 and [e["kind"] for e in q.emit(15, 5)] == ["rescan"] and q.emit(99, 5) == []


def test_pacing_and_retries():
    assert d.tick(150) == 37.5 and d.next_reconcile(0.0, 0.2) == 1.2 and d.next_reconcile(0.0, 4.0) == 8.0
    delays = d.retry_delays()
    assert [next(delays) for _ in range(7)] == [1, 2, 4, 8, 16, 30, 30]
    tries, waits = [], []

    def start():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("no")
        return "open"

    assert d.with_retries(start, 5, waits.append) == "open" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        d.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, waits.append)


def test_late_functions_evict_their_locals(spark, rows):
    s = spark.createDataFrame([("f", "function", None, "a.py"), ("v", "variable", "f", "a.py"), ("g", "function", None, "a.py"), ("w", "variable", "g", "b.py"), ("k", "class", None, "c.py")], "symbol_id string, kind string, parent_symbol_id string, path string")
    before = spark.createDataFrame([("v", "a.py"), ("old", "a.py"), ("w", "b.py"), ("k", "c.py")], "symbol_id string, path string")
    assert rows(d.affected_locals(spark.createDataFrame([("a.py",)], "path string"), s, before)) == [("f", "indexed"), ("g", "indexed"), ("old", "dropped"), ("v", "dropped"), ("w", "dropped")]


def test_event_without_path_is_ignored():
    q = d.Queues()
    q.add({"kind": "modify-any", "time": 1, "paths": []})
    assert q.queues == {}


def test_emission_over_a_virtual_clock():
    q = d.Queues()
    q.add(ev("modify-any", at=2))
    q.add(ev("modify-any", at=4))
    out = {now: [e["time"] for e in q.emit(now, 3)] for now in range(1, 12)}
    assert {k: v for k, v in out.items() if v} == {7: [4]}
    q = d.Queues()
    for at in (1, 2, 3):
        q.add(ev("modify-data-content", at=at))
    out = {now: [e["time"] for e in q.emit(now, 5)] for now in range(1, 12)}
    assert {k: v for k, v in out.items() if v} == {8: [3]}


def test_emission_in_order_of_time():
    q = d.Queues()
    for p, at in (("/b", 1), ("/a", 2), ("/c", 1)):
        q.add(ev("modify-any", p, at))
    assert [e["paths"][0] for e in q.emit(10, 1)] == ["/b", "/c", "/a"]


SCHEMA = "root string, ts timestamp, kind string, paths array<string>, tracker bigint"


def test_stream(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    ms = lambda n: t + dt.timedelta(milliseconds=n)
    first = [("r", ms(0), "modify-any", ["/w/f"], None), ("r", ms(50), "modify-any", ["/w/f"], None), ("r", ms(60), "create-file", ["/w/g"], None), ("q", ms(10), "modify-any", [], None)]
    later = [("q", ms(5000), "modify-any", ["/w/z"], None)]
    for n, part in enumerate((first, later, [("q", ms(9000), "modify-any", ["/w/z"], None)])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = d.debounce_stream(stream).writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.root, r.kind, r.path) for r in spark.table("debounced").collect())
    assert ("r", "modify-any", "/w/f") in got and ("r", "create-file", "/w/g") in got and len([g for g in got if g[0] == "r"]) == 2


def test_batch_form(spark, rows):
    e = spark.createDataFrame([("p", "m", 0, 1), ("p", "m", 50, 2), ("p", "m", 500, 3), ("p", "c", 60, 4), ("q", "m", 55, 5)], "path string, kind string, us bigint, id bigint")
    assert rows(d.debounce_batch(e, 100).select("id")) == [(2,), (3,), (4,), (5,)]


def test_overflow_switch(spark, tmp_path):
    schema = "kind string, path string"
    few = spark.createDataFrame([("modify", "a")], schema)
    assert not d.needs_full_refresh(few) and d.needs_full_refresh(few.unionByName(spark.createDataFrame([("rescan", None)], schema)))
    assert d.needs_full_refresh(spark.createDataFrame([("modify", str(k)) for k in range(51)], schema))
    few.write.parquet(str(tmp_path / "in"))
    seen = []
    q = d.refresh(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda b, n: seen.append(("one", b.count())), lambda n: seen.append(("all", n)), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert seen == [("one", 1)]
