"""Changed files and lines of a working tree against a commit."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

HUNKS = "path string, start_line int, end_line int"
FILES = "path string, base_path string, untracked boolean"
_ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}


def unquote(name: str) -> str:
    """A path as git writes it: in quotes with escapes where it has special characters."""
    if not (len(name) > 1 and name.startswith('"') and name.endswith('"')):
        return name
    byte = lambda m: bytes([int(m.group(1), 8) & 255 if m.group(1).isdigit() else _ESCAPES.get(m.group(1), ord(m.group(1)))]).decode("latin-1")
    inner = name[1:-1].encode().decode("latin-1")
    return re.sub(r"\\([0-7]{3}|.)", byte, inner, flags=re.S).encode("latin-1").decode("utf-8", "replace")


def new_range(start: int, count: int) -> tuple[int, int] | None:
    """The lines that a hunk adds or changes; None where it only removes."""
    return (start, start + count - 1) if count else None


def touched_range(start: int, count: int) -> tuple[int, int]:
    """Like new_range(), but a hunk that only removes lines touches the line before them, at the start of a file line 1."""
    return new_range(start, count) or (max(1, start), max(1, start))


def parse_hunks(diff: str, of=new_range) -> list[tuple[str, int, int]]:
    """(path, first, last) line of each hunk's new side in a unified diff, by a rule of the two above. What a hunk's own
    lines say is not read as headers."""
    rows, path, left = [], None, [0, 0]
    for line in diff.split("\n"):
        if left[0] > 0 or left[1] > 0:
            if line[:1] in ("-", " "):
                left[0] -= 1
            if line[:1] in ("+", " "):
                left[1] -= 1
            continue
        if line.startswith("+++ "):
            name = unquote(line[4:].split("\t")[0])
            path = None if name == "/dev/null" else name[2:] if name.startswith("b/") else name
        m = re.match(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)
        if m:
            left = [int(m.group(1) or 1), int(m.group(3) or 1)]
            found = of(int(m.group(2)), left[1]) if path else None
            if found:
                rows.append((path, *found))
    return rows


def parse_name_status(out: str) -> list[tuple[str, str | None, bool]]:
    """(path, path at the base or None for an added file, False) of `--name-status -z`; a rename or copy names both."""
    parts, rows, i = out.split("\0"), [], 0
    while i < len(parts) and parts[i]:
        status = parts[i]
        if status[0] in "RC":
            rows.append((parts[i + 2], parts[i + 1], False))
            i += 3
        else:
            rows.append((parts[i + 1], None if status[0] == "A" else parts[i + 1], False))
            i += 2
    return rows


def _git(repository: str, *args: str) -> str:
    out = subprocess.run(["git", "-C", repository, *args], capture_output=True, check=True).stdout
    return out.decode("utf-8", "replace")


_PLAIN = ("-M", "--relative", "--no-ext-diff", "--no-textconv")


def _changed(repository: str, base: str) -> list[tuple[str, str | None, bool]]:
    rows = parse_name_status(_git(repository, "diff", "--name-status", "-z", *_PLAIN, base, "--"))
    rows += [(p, None, True) for p in _git(repository, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if p and not p.endswith("/")]
    first = {}
    for r in rows:
        first.setdefault(r[0], r)
    return [first[p] for p in sorted(first)]


def changed_files(spark: SparkSession, repository: str, base: str = "HEAD") -> DataFrame:
    """(path, base_path, untracked) of the files that differ from base, renames paired, and of untracked ones that are not
    ignored."""
    return spark.createDataFrame(_changed(repository, base), FILES)


def changed_hunks(spark: SparkSession, repository: str, base: str = "HEAD", of=new_range) -> DataFrame:
    """(path, start_line, end_line) of a repository's working tree against base, untracked files as a whole; of: new_range
    or touched_range."""
    rows = []
    for path, _, untracked in _changed(repository, base):
        if untracked:
            with open(f"{repository}/{path}", "rb") as f:
                text = f.read()
            rows.append((path, 1, max(1, text.count(b"\n") + (text[-1:] not in (b"", b"\n")))))
    rows += parse_hunks(_git(repository, "diff", "-U0", "--no-color", *_PLAIN, base, "--"), of)
    return spark.createDataFrame(sorted(rows), HUNKS)


def base_of(given: str | None, session_base: str | None) -> str:
    """What a check compares with: the commit that is asked for, else the session's, else HEAD."""
    return given or session_base or "HEAD"
