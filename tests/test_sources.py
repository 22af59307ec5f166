import os
import subprocess

from tessera.sources import git, store, tree
from tessera.sources.tables import with_columns


def test_versions(spark, rows, tmp_path):
    root = f"file://{tmp_path}"
    a = spark.createDataFrame([("p", 1), ("q", 2)], "path string, n int")
    assert store.current_version(spark, root) is None
    v1 = store.write_version(spark, root, {"files": a})
    old = store.read_version(spark, v1, ["files"])["files"]
    changed = store.upsert(old, spark.createDataFrame([("q", 3), ("r", 4)], "path string, n int"), "path")
    v2 = store.write_version(spark, root, {"files": store.without(changed, spark.createDataFrame([("p",)], "path string"), "path")})
    assert store.current_version(spark, root) == v2 != v1
    assert rows(store.read_version(spark, v2, ["files"])["files"]) == [("q", 3), ("r", 4)] and rows(old) == [("p", 1), ("q", 2)]
    assert store.readable(spark, v2, ["files"]) and not store.readable(spark, v2, ["nothing"])


def test_rebuild_guard_and_metadata(spark, rows, tmp_path):
    root = f"file://{tmp_path}"
    build = lambda: {"files": spark.createDataFrame([("p",)], "path string")}
    assert [store.rebuild_if_outdated(spark, root, v, build) for v in ("1", "1", "2")] == [True, False, True]
    m = spark.createDataFrame([("root", "/a"), (None, "x")], "key string, value string")
    assert rows(store.set_key(m, "root", "/b")) == [("root", "/b"), (None, "x")]


def test_latest_and_json(spark, rows, tmp_path):
    t = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False)], "k string, at int, followed boolean")
    assert rows(store.latest(t, ["k"], "at")) == [("a", 2, True), ("b", 1, False)]
    store.write_json(t, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 3


def test_tree(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "src/b.bin": b"\x00\x01", "node_modules/c.js": b"c", ".git/config": b"g", "src/d.min.js": b"d"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r.path: r.content for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": "x = 1\n", "src/b.bin": None}


def test_git(spark, rows, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, env=os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"})
    run("init", "-q")
    (tmp_path / "f.txt").write_text("".join(f"{k}\n" for k in range(20)))
    run("add", ".")
    run("commit", "-qm", "one")
    lines = [f"{k}\n" for k in range(20)]
    lines[4] = "changed\n"
    del lines[10:12]
    (tmp_path / "f.txt").write_text("".join(lines))
    (tmp_path / "new.txt").write_text("a\nb")
    (tmp_path / "t\u00e4b\t.txt").write_text("++ x\n-- y\n")
    assert rows(git.changed_hunks(spark, str(tmp_path))) == [("f.txt", 5, 5), ("new.txt", 1, 2), ("t\u00e4b\t.txt", 1, 2)]
    run("add", ".")
    run("commit", "-qm", "two")
    (tmp_path / "f.txt").rename(tmp_path / "g.txt")
    (tmp_path / "t\u00e4b\t.txt").write_text("++ x\n-- z\n@@ -1 +1 @@\n")
    run("add", "-N", "g.txt")
    got = {(r.path, r.base_path, r.untracked) for r in git.changed_files(spark, str(tmp_path)).collect()}
    assert ("t\u00e4b\t.txt", "t\u00e4b\t.txt", False) in got and ("g.txt", "f.txt", False) in got
    assert ("t\u00e4b\t.txt", 2, 3) in rows(git.changed_hunks(spark, str(tmp_path)))
    cut = "--- a/x\n+++ b/x\n@@ -5,2 +4,0 @@\n-a\n-b\n@@ -1,1 +0,0 @@\n-+++ b/y\n"
    assert git.parse_hunks(cut) == [] and git.parse_hunks(cut, git.touched_range) == [("x", 4, 4), ("x", 1, 1)]
    assert git.base_of(None, None) == "HEAD" and git.base_of(None, "s") == "s" and git.base_of("g", "s") == "g"


def test_versions_are_complete_or_not_there(spark, tmp_path):
    from tessera.sources import store

    root = str(tmp_path / "s")
    one = {"t": spark.range(3).toDF("x")}
    assert store.current_version(spark, root) is None
    first = store.write_version(spark, root, one)
    (tmp_path / "s" / "v-000002").mkdir()  # a writer that died
    assert store.current_version(spark, root) == first
    third = store.write_version(spark, root, {"t": spark.range(5).toDF("x")})
    assert third.endswith("v-000003") and store.current_version(spark, root) == third and store.readable(spark, third, ["t"]) and not store.readable(spark, third, ["u"])
    store.write_version(spark, root, one)
    assert store.compact(spark, root, keep=1) == 3 and [p.name for p in (tmp_path / "s").iterdir()] == ["v-000004"]
    part = next((tmp_path / "s" / "v-000004" / "t").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:200] + b"x" * 50)
    assert not store.readable(spark, root + "/v-000004", ["t"])


def test_scratch_tables_go_and_indexes_are_made_anew(spark, tmp_path):
    from tessera import session

    spark.range(4).write.parquet(str(tmp_path / "a.parquet"))
    made = []
    build = lambda: made.append(1) or spark.read.parquet(str(tmp_path / "a.parquet"))
    get = lambda: session.once(spark, str(tmp_path), "x", ("a",), build)
    with session.scratch():
        assert get().count() == get().count() == 4 and len(made) == 1
        path = session._written[-1][1]
    import os

    assert not os.path.exists(path.removeprefix("file://"))
    assert get().count() == 4 and len(made) == 2
    spark.range(7).write.mode("overwrite").parquet(str(tmp_path / "a.parquet"))
    assert get().count() == 7 and len(made) == 3


def test_missing_columns_are_null(spark):
    df = with_columns(spark.createDataFrame([(1, "x")], "B int, other string"), a="string", b="bigint")
    assert df.columns == ["a", "b"] and tuple(df.first()) == (None, 1)
