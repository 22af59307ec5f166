"""Scans of files and texts: exclusion rules, word search, slices, outlines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import folder, normal_path

# Fixed values that must equal those of the fact format: folders and file name endings that are never indexed. A tool's own
# state folders are passed by the caller.
EXCLUDED_FOLDERS = (".git", ".hg", ".svn", ".worktrees", "worktrees", ".venv", "venv", ".env", ".tox", ".vs", "node_modules", "vendor", "target", "dist", "build", ".cache", "obj", "TestResults", ".idea", ".vscode")
EXCLUDED_ENDINGS = (".min.js", ".bundle.js", ".generated.js", ".generated.jsx", ".generated.ts", ".generated.tsx", ".generated.d.ts", ".tmp", ".swp", "~", ".db-wal", ".db-shm", ".sqlite-wal", ".sqlite-shm")


def excluded(path: Column, own_folders: tuple[str, ...] = ()) -> Column:
    """Whether a part of a path is an excluded folder's name, or the path has an excluded ending; case matters."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    inside = F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, (*EXCLUDED_FOLDERS, *own_folders))))
    ends = F.lit(False)
    for e in EXCLUDED_ENDINGS:
        ends = ends | F.endswith(p, F.lit(e))
    return F.coalesce(inside | ends, F.lit(False))


def is_binary(content: Column) -> Column:
    """A NUL among the first 8,192 characters."""
    return F.instr(F.substring(content, 1, 8192), "\x00") > 0


def find_word(lines: DataFrame, word: str) -> DataFrame:
    """(path, line) of the lines that hold a word as a whole; word characters are ASCII letters, digits, _ and $."""
    w = re.sub(r"([^\w])", r"\\\1", word)
    return lines.where(F.contains("text", F.lit(word)) & F.col("text").rlike(rf"(?<![A-Za-z0-9_$]){w}(?![A-Za-z0-9_$])")).select("path", "line").distinct()


def coverage(texts: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """One row about what a word scan over texts (path, content) can read: files, read, too_large (beyond most_bytes),
    binary, unreadable (null)."""
    size, n = F.octet_length("content"), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    large, bin_ = size > most_bytes, is_binary(F.col("content"))
    return texts.agg(F.count("*").alias("files"), n(F.col("content").isNotNull() & ~large & ~bin_).alias("read"), n(large).alias("too_large"), n(~large & bin_).alias("binary"), F.count_if(F.col("content").isNull()).alias("unreadable"))


def readable_texts(texts: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """The texts that a word scan reads: not null, not beyond most_bytes, not binary."""
    return texts.where(F.col("content").isNotNull() & (F.octet_length("content") <= most_bytes) & ~is_binary(F.col("content")))


def listing(files: DataFrame, depth: int | None = None, most: int = 1000) -> DataFrame:
    """The first `most` files by path, down to a number of path segments if given, each with whether there are more (cut)."""
    f = files if depth is None else files.where(F.size(F.split("path", "/")) <= depth)
    top = f.orderBy("path").limit(most + 1).withColumn("rn", F.row_number().over(Window.orderBy("path")))  # at most `most` + 1 rows
    return top.withColumn("cut", F.max("rn").over(Window.partitionBy(F.lit(1))) > most).where(F.col("rn") <= most).drop("rn")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two offsets in its UTF-8 bytes. An offset inside a character is moved outwards: the start to where
    the character begins, the end to where it ends; offsets beyond the text are cut to its length. Null where an offset is
    null or the start comes after the end."""
    raw, size = F.encode(text, "utf-8"), F.octet_length(text)
    at = lambda i: F.substring(raw, i + 1, F.lit(1))
    inside = lambda i: (i < size) & (at(i) >= F.unhex(F.lit("80"))) & (at(i) <= F.unhex(F.lit("BF")))  # noqa: E731  # not a first byte
    a, b = F.least(start, size), F.least(end, size)
    back = F.when(~inside(a), 0).when(~inside(a - 1), 1).when(~inside(a - 2), 2).otherwise(3)
    on = F.when(~inside(b), 0).when(~inside(b + 1), 1).when(~inside(b + 2), 2).otherwise(3)
    return F.when(start <= end, F.decode(F.substring(raw, a - back + 1, b + on - a + back), "utf-8"))


def hash_matches(content: Column, stored: Column) -> Column:
    """Whether a content has a stored SHA-256, with or without its `sha256:` prefix; null where the stored value is of
    another kind."""
    plain = F.lower(F.regexp_replace(stored, "^sha256:", ""))
    return F.when(plain.rlike("^[0-9a-f]{64}$"), F.sha2(content, 256) == plain)


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """The lines from first to last, counted from 1, both included."""
    return F.array_join(F.slice(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), first, last - first + 1), "\n")


def body_text(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(symbol_id, text): a symbol's body by its bytes or, where those are null, by its lines; symbols without a body have
    no row."""
    one = texts.groupBy("file_id").agg(F.max("content").alias("content"))
    cols = [f"body_{e}_{u}" for u in ("byte", "line") for e in ("start", "end")]
    j = symbols.select("symbol_id", "file_id", *cols).join(one, "file_id")
    bytes_ = byte_slice(F.col("content"), F.col(cols[0]), F.col(cols[1]))
    lines_ = F.when(F.col(cols[2]) <= F.col(cols[3]), line_slice(F.col("content"), F.col(cols[2]), F.col(cols[3])))
    return j.select("symbol_id", F.coalesce(bytes_, lines_).alias("text")).where("text IS NOT NULL")


def symbol_text(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(symbol_id, text): a symbol's byte span of its file's text or, where that is null, its lines."""
    one = texts.groupBy("file_id").agg(F.max("content").alias("content"))
    j = symbols.select("symbol_id", "file_id", "start_byte", "end_byte", "start_line", "end_line").join(one, "file_id")
    cut_ = F.when(F.col("start_byte").isNotNull() & F.col("end_byte").isNotNull(), byte_slice(F.col("content"), F.col("start_byte"), F.col("end_byte")))
    return j.select("symbol_id", F.coalesce(cut_, line_slice(F.col("content"), F.col("start_line"), F.col("end_line"))).alias("text"))


def match_paths(files: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, file_id, path): the files that asked paths mean: exactly that path, else the same but for ASCII case and
    slashes."""
    f = files.select("file_id", "path", normal_path(F.col("path")).alias("key"))
    j = asked.select(F.col("path").alias("asked"), normal_path(F.col("path")).alias("key")).join(f, "key")
    exact = F.col("asked") == F.col("path")
    best = F.max(exact.cast("int")).over(Window.partitionBy("asked"))
    return j.withColumn("best", best).where(exact.cast("int") == F.col("best")).select("asked", "file_id", "path")


def outline(symbols: DataFrame) -> DataFrame:
    """For each file: definitions, tests, callables, private (counts), and the first five names in source order."""
    order = Window.partitionBy("path").orderBy(F.col("start_line").asc_nulls_last(), "symbol_id")
    s = symbols.withColumn("rn", F.row_number().over(order))
    return s.groupBy("path").agg(
        F.count("*").alias("definitions"), F.count_if(F.coalesce("is_test", F.lit(False))).alias("tests"), F.count_if(F.col("kind").isin("function", "method", "constructor")).alias("callables"),
        F.count_if(F.lower("visibility") == "private").alias("hidden"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", "name")))), lambda x: x["name"]), ", ").alias("names"))


def folder_counts(files: DataFrame, depth: int) -> DataFrame:
    """(folder, files, bytes) of every folder down to a depth; a file counts for each folder above it."""
    parts = F.split(folder(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select(F.explode(up).alias("folder"), "content_bytes").groupBy("folder").agg(F.count("*").alias("files"), F.sum("content_bytes").alias("bytes"))


def reconcile(disk: DataFrame, files: DataFrame, skipped: DataFrame, unreadable: tuple[str, ...] = ()) -> DataFrame:
    """(path, change) between what a walk sees and what is indexed: added (not indexed, and not skipped with the same size
    and time), modified (other size or hash), deleted (not seen, and not under a folder that could not be read).

    disk: path, bytes, hash, mtime_ns. files: path, content_bytes, content_hash. skipped: path, content_bytes, mtime_ns.
    """
    known = skipped.select("path", F.col("content_bytes").alias("bytes"), "mtime_ns").distinct().withColumn("skipped", F.lit(True))
    j = disk.join(known, ["path", "bytes", "mtime_ns"], "left").join(files.select("path", "content_bytes", "content_hash").withColumn("indexed", F.lit(True)), "path", "full")
    seen, indexed = F.col("bytes").isNotNull() | F.col("hash").isNotNull(), F.coalesce("indexed", F.lit(False))
    safe = F.lit(True)
    for u in unreadable:
        safe = safe & ~(F.startswith("path", F.lit(u.rstrip("/") + "/")) | (F.col("path") == u))
    change = (F.when(seen & ~indexed & F.col("skipped").isNull(), "added")
              .when(seen & indexed & (~F.col("bytes").eqNullSafe(F.col("content_bytes")) | ~F.col("hash").eqNullSafe(F.col("content_hash"))), "modified")
              .when(~seen & indexed & safe, "deleted"))
    return j.select("path", change.alias("change")).where("change IS NOT NULL")


# What stands in the top folder of a project.
ROOT_MARKS = (".git", "Cargo.toml", "package.json", "go.mod", "pyproject.toml")


def project_roots(paths: DataFrame) -> DataFrame:
    """(folder): the folders that hold one of the files or folders that mark a project's top; '' for the root itself."""
    p = F.replace("path", F.lit("\\"), F.lit("/"))
    mark = "|".join(re.sub(r"([.])", r"\\\1", m) for m in ROOT_MARKS)
    return paths.select(F.regexp_extract(p, rf"^(.*?/)?(?:{mark})(?:/.*)?$", 1).alias("f"), p.rlike(rf"(^|/)(?:{mark})(/|$)").alias("hit")).where("hit").select(F.regexp_replace("f", "/$", "").alias("folder")).distinct()


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored): whether the rules of ignore files leave a path out. rules: (folder, line, regex, negated, folders):
    of a rule's folder and below, the last matching rule holds; a deeper folder's rules come after those above it. A rule
    for folders alone (folders) matches what lies in one. A path in a folder that is left out stays out."""
    parts = F.split("path", "/")
    # every leading part of a path is judged; one that is out takes the path with it
    heads = paths.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), F.size(parts).alias("size")).select("path", F.array_join(F.slice(F.split("path", "/"), 1, F.col("n")), "/").alias("head"), (F.col("n") < F.col("size")).alias("is_folder"))
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("head", "/")) - 1), lambda i: F.array_join(F.slice(F.split("head", "/"), 1, i), "/"))
    hits = heads.select("path", "head", "is_folder", F.explode(above).alias("folder")).join(rules, "folder").where(F.expr("head RLIKE regex AND (NOT folders OR is_folder)"))
    last = hits.groupBy("path", "head").agg(F.max_by("negated", F.struct(F.size(F.split("folder", "/")), F.length("folder"), F.col("line"))).alias("negated"))
    out = last.where("NOT negated").select("path").distinct().withColumn("ignored", F.lit(True))
    return paths.join(out, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


def ignore_rules(folder_: str, text: str) -> list[tuple[str, int, str, bool, bool]]:
    """(folder, line, regex, negated, folders) of an ignore file's lines."""
    out = []
    for n, line in enumerate(text.splitlines()):
        s = line.rstrip()
        if not s or s.startswith("#"):
            continue
        negated, s = s.startswith("!"), s.lstrip("!") if s.startswith("!") else s
        folders, s = s.endswith("/"), s.rstrip("/")
        anchored, s = "/" in s, s.lstrip("/")
        r = ""
        i = 0
        while i < len(s):
            if s.startswith("**/", i):
                r, i = r + "(?:.*/)?", i + 3
            elif s.startswith("/**", i) and i + 3 == len(s):
                r, i = r + "/.*", i + 3
            elif s[i] == "*":
                r, i = r + "[^/]*", i + 1
            elif s[i] == "?":
                r, i = r + "[^/]", i + 1
            else:
                r, i = r + re.sub(r"([^\w/])", r"\\\1", s[i]), i + 1
        base = re.sub(r"([^\w/])", r"\\\1", folder_)
        out.append((folder_, n, "^" + (base + "/" if base else "") + ("" if anchored else "(?:.*/)?") + r + "$", negated, folders))
    return out
