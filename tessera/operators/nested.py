"""Deeply nested JSON records to linked flat tables, by vectorised structural indexing."""

from __future__ import annotations

import decimal
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

#: Bytes of payload that are indexed together; one longer payload is indexed alone.
CHUNK_BYTES = 2_000_000

QUOTE, SLASH, COMMA, COLON = 34, 92, 44, 58
OPEN, CLOSE = (123, 91), (125, 93)


class Index:
    """The structure of many JSON texts at once: bitmaps of quotes, brackets and delimiters over their joined bytes,
    depths by prefix sums, and from them one slot for each member of each object and array.

    ok[i]: text i is a whole JSON object with balanced brackets. Of a slot: box (token number of the container's opening
    bracket), key and value spans, kind (the value's first byte), inner (token number of the value's own opening bracket
    or -1), text (its text's number), order (number within its container).
    """

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        self.raw = b"\n".join(texts) + b"\n"
        buf = self.buf = np.frombuffer(self.raw, np.uint8)
        place = np.arange(len(buf), dtype=np.int32)
        # a byte is escaped after an odd run of backslashes
        slash = buf == SLASH
        run = place - np.maximum.accumulate(np.where(slash, np.int32(-1), place))
        odd = np.zeros(len(buf), bool)
        odd[1:] = (run[:-1] & 1).astype(bool)
        quote = (buf == QUOTE) & ~odd
        count = np.cumsum(quote, dtype=np.int32)
        before = np.where(starts > 0, count[np.maximum(starts - 1, 0)], 0)
        quotes = count[ends - 1] - before
        inside = ((count - np.repeat(before, sizes)) & 1).astype(bool)
        opening = ((buf == OPEN[0]) | (buf == OPEN[1])) & ~inside
        closing = ((buf == CLOSE[0]) | (buf == CLOSE[1])) & ~inside
        pos = np.flatnonzero(opening | closing | (((buf == COMMA) | (buf == COLON)) & ~inside))
        text = np.searchsorted(ends, pos, side="right")
        is_open, is_close = opening[pos], closing[pos]
        step = is_open.astype(np.int32) - is_close
        total = np.cumsum(step)
        first = np.searchsorted(text, np.arange(n))
        last = np.searchsorted(text, np.arange(n), side="right")
        base = np.where(first > 0, total[np.maximum(first - 1, 0)] if len(total) else 0, 0)
        depth = total - np.repeat(base, last - first)
        level = depth + is_close  # of the container that the token opens, closes or parts
        ok = (quotes % 2 == 0) & (last > first)
        some = np.flatnonzero(ok)
        bad = np.zeros(n, bool)
        bad[text[(level < 1)]] = True
        ok[some] &= (depth[last[some] - 1] == 0) & is_open[first[some]] & (buf[pos[first[some]]] == OPEN[0])
        zero = np.bincount(text[(depth == 0)], minlength=n)
        ok &= ~bad & (zero == 1)
        space = (buf == 32) | (buf == 10) | (buf == 13) | (buf == 9)
        self.next_ = np.minimum.accumulate(np.where(space, np.int32(len(buf)), place)[::-1])[::-1]  # first non-blank from here
        self.prev_ = np.maximum.accumulate(np.where(space, np.int32(-1), place))
        ok[some] &= (self.next_[starts[some]] == pos[first[some]]) & (self.prev_[ends[some] - 1] == pos[last[some] - 1])
        # brackets pair off in the order of level and place
        use = np.flatnonzero(ok[text])
        order = use[np.lexsort((use, level[use], text[use]))]
        ch = buf[pos]
        pairs = order[(is_open | is_close)[order]]
        mixed = ch[pairs[1::2]] != ch[pairs[::2]] + 2
        if mixed.any():
            ok[np.unique(text[pairs[::2][mixed]])] = False
            order = order[ok[text[order]]]
        self.ok, self.pos, self.ch, self.text_of = ok, pos, ch, text
        self.close = np.full(len(pos) + 1, -1, np.int64)
        pairs = order[(is_open | is_close)[order]]
        self.close[pairs[::2]] = pos[pairs[1::2]]
        self.roots = np.full(n, -1, np.int64)
        self.roots[ok] = first[ok]
        # slots: from an opening bracket or comma to the next comma or closing bracket of the same level
        seps = order[ch[order] != COLON]
        colon_after = np.full(len(pos) + 1, -1, np.int64)
        nxt = order[1:]
        has = ch[nxt] == COLON
        colon_after[order[:-1][has]] = pos[nxt[has]]
        begin, finish = seps[:-1], seps[1:]
        live = ~is_close[begin]
        begin, finish = begin[live], finish[live]
        opener = np.where(is_open[begin], begin, -1)
        box = np.maximum.accumulate(np.where(opener >= 0, np.arange(len(begin)), 0)) if len(begin) else np.zeros(0, np.int64)
        box = begin[box] if len(begin) else box
        colon = colon_after[begin]
        lo = np.where(colon >= 0, colon, pos[begin]) + 1
        value, value_end = self.next_[lo], self.prev_[np.maximum(pos[finish] - 1, 0)] + 1
        live = (value < value_end) & ((colon >= 0) == (ch[box] == OPEN[0]))
        self.box, colon, begin, self.value, self.value_end = box[live], colon[live], begin[live], value[live], value_end[live]
        self.key = np.where(colon >= 0, self.next_[pos[begin] + 1] + 1, -1)
        self.key_end = np.where(colon >= 0, self.prev_[np.maximum(colon - 1, 0)], -1)
        self.kind = buf[self.value] if len(self.value) else np.zeros(0, np.uint8)
        at = np.searchsorted(pos, self.value)
        at = np.minimum(at, max(len(pos) - 1, 0))
        container = (self.kind == OPEN[0]) | (self.kind == OPEN[1])
        self.inner = np.where(container, at, -1)
        heads = np.flatnonzero(np.concatenate(([True], self.box[1:] != self.box[:-1]))) if len(self.box) else np.zeros(0, np.int64)
        self.order = np.arange(len(self.box)) - np.repeat(heads, np.diff(np.append(heads, len(self.box))))
        self._by_box = np.argsort(self.box, kind="stable")
        self._boxes = self.box[self._by_box]
        self._named: dict[str, np.ndarray] = {}
        # keys written with escapes are rare and decoded one by one
        n_slash = np.cumsum(slash, dtype=np.int32)
        self._odd_keys = [int(i) for i in np.flatnonzero((self.key >= 0) & (n_slash[np.maximum(self.key_end, 0)] > n_slash[np.maximum(self.key - 1, 0)]))]
        self._slashes = n_slash

    def named(self, key: str) -> np.ndarray:
        """Whether each slot has this key."""
        if key not in self._named:
            want = np.frombuffer(key.encode(), np.uint8)
            hit = self.key_end - self.key == len(want)
            at = np.flatnonzero(hit & (self.key >= 0))
            same = (self.buf[self.key[at][:, None] + np.arange(len(want))] == want).all(axis=1)
            mask = np.zeros(len(self.key), bool)
            mask[at[same]] = True
            for i in self._odd_keys:
                mask[i] = self.key_text(i) == key
            self._named[key] = mask
        return self._named[key]

    def member(self, boxes: np.ndarray, key: str) -> np.ndarray:
        """The slot of each object's member of this key (the last, if it is repeated), -1 where it has none."""
        where = np.full(len(self.pos) + 1, -1, np.int64)
        slots = np.flatnonzero(self.named(key))
        where[self.box[slots]] = slots
        return np.where(boxes >= 0, where[boxes], -1)

    def slots_of(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All slots of these containers: (index into boxes, slot), in order."""
        a, b = np.searchsorted(self._boxes, boxes), np.searchsorted(self._boxes, boxes, side="right")
        n = np.where(boxes >= 0, b - a, 0)
        who = np.repeat(np.arange(len(boxes)), n)
        start = np.repeat(a - (np.cumsum(n) - n), n)
        return who, self._by_box[start + np.arange(len(who))]

    def inner_if(self, slots: np.ndarray, kind: int) -> np.ndarray:
        """The containers that these slots hold, -1 for other values."""
        if not len(self.kind):
            return np.full(len(slots), -1)
        return np.where((slots >= 0) & (self.kind[slots] == kind), self.inner[slots], -1)

    def _string(self, a: int, b: int) -> str:
        if self._slashes[b - 1] == self._slashes[a - 1]:
            return self.raw[a:b].decode("utf-8", "replace")
        try:
            return json.loads(b'"' + self.raw[a:b] + b'"', strict=False)
        except ValueError:
            return self.raw[a:b].decode("utf-8", "replace")

    def key_text(self, slot: int) -> str:
        return self._string(int(self.key[slot]), int(self.key_end[slot]))

    def text(self, slot: int) -> str | None:
        """A scalar as text: strings decoded, null as None, others as written."""
        if slot < 0:
            return None
        a, b = int(self.value[slot]), int(self.value_end[slot])
        if self.kind[slot] == QUOTE:
            return self._string(a + 1, b - 1)
        s = self.raw[a:b].decode("utf-8", "replace")
        return None if s == "null" else s


def truth(text: str | None) -> bool | None:
    """A yes or no that may be written as boolean, text or number; None for anything else."""
    t = (text or "").strip().lower()
    if t in ("true", "false"):
        return t == "true"
    try:
        return float(t) != 0 if t else None
    except ValueError:
        return None


ROW = "record_id bigint, row_id string, parent_id string, entry_id string, kind string, owner string, case_id string, repeat bigint, receipt_status string, cleanup_complete boolean, fields array<struct<name:string,value:string>>"


class _Part:
    """Rows of one kind on their way down: container numbers in an index, with the path and entry that each belongs to."""

    def __init__(self, ix: Index, boxes, paths, entries):
        keep = np.flatnonzero(np.asarray(boxes) >= 0)
        self.ix, self.boxes = ix, np.asarray(boxes)[keep]
        self.paths, self.entries = [paths[i] for i in keep], [entries[i] for i in keep]

    def child(self, key: str, kind: int) -> "_Part":
        slots = self.ix.member(self.boxes, key)
        return _Part(self.ix, self.ix.inner_if(slots, kind), [f"{p}.{key}" if p else key for p in self.paths], self.entries)

    def elements(self, kind: int = OPEN[0]) -> "_Part":
        who, slots = self.ix.slots_of(self.boxes)
        paths = [f"{self.paths[w]}[{o}]" for w, o in zip(who, self.ix.order[slots])]
        return _Part(self.ix, self.ix.inner_if(slots, kind), paths, [self.entries[w] for w in who])

    def members(self, kind: int = OPEN[0]) -> "_Part":
        """Members of any key."""
        who, slots = self.ix.slots_of(self.boxes)
        paths = [f"{self.paths[w]}.{self.ix.key_text(int(s))}" for w, s in zip(who, slots)]
        return _Part(self.ix, self.ix.inner_if(slots, kind), paths, [self.entries[w] for w in who])

    def scalars(self) -> list[list[tuple[str, str]]]:
        out: list[dict[str, str]] = [{} for _ in self.boxes]
        who, slots = self.ix.slots_of(self.boxes)
        flat = self.ix.inner[slots] < 0
        for w, s in zip(who[flat], slots[flat]):
            v = self.ix.text(int(s))
            if v is not None:
                out[w][self.ix.key_text(int(s))] = v
        return [sorted(o.items()) for o in out]


def whole_number(text: str | None) -> int | None:
    """A whole number of any size that may be written with a fraction of zero or an exponent; None for anything else."""
    try:
        return int(text)
    except (TypeError, ValueError):
        pass
    try:
        return int(decimal.Decimal(text))
    except (TypeError, ValueError, OverflowError, decimal.InvalidOperation):
        return None


def shred(ids: list, payloads: list[bytes], kinds: frozenset | None = None) -> list[tuple]:
    """The rows (columns of ROW) of some payloads, of the given kinds or of all."""
    wanted = lambda *k: kinds is None or not kinds.isdisjoint(k)
    ix = Index(payloads)
    roots = _Part(ix, ix.roots, [""] * len(ids), list(range(len(ids))))
    has = (ix.member(roots.boxes, "case_id") >= 0) | (ix.member(roots.boxes, "receipt") >= 0)
    top = _Part(ix, np.where(has, roots.boxes, -1), ["$"] * len(roots.boxes), roots.entries)
    cases = roots.child("cases", OPEN[1]).elements()
    attempts = roots.child("campaign", OPEN[0]).child("groups", OPEN[1]).elements().child("attempts", OPEN[1]).elements()
    rows: list[tuple] = []
    entries: list[tuple] = []  # (record_id, entry path, case_id, repeat)
    todo: list[_Part] = []
    strings: list[tuple[bytes, int]] = []
    for part in (top, cases, attempts):
        numbers = []
        case, rep = ix.member(part.boxes, "case_id"), ix.member(part.boxes, "repeat")
        for k, doc in enumerate(part.entries):
            r = whole_number(ix.text(int(rep[k]))) if rep[k] >= 0 and ix.inner[rep[k]] < 0 else None
            r = r if r is not None and -(1 << 63) <= r < 1 << 63 else None
            c = ix.text(int(case[k])) if case[k] >= 0 and ix.inner[case[k]] < 0 else None
            numbers.append(len(entries))
            entries.append((ids[doc], part.paths[k], c, r))
        slots = ix.member(part.boxes, "receipt")
        todo.append(_Part(ix, ix.inner_if(slots, OPEN[0]), [f"{p}.receipt" for p in part.paths], numbers))
        strings += [(ix.text(int(s)).encode(), numbers[k]) for k, s in enumerate(slots) if s >= 0 and ix.kind[s] == QUOTE]
        part.entries = numbers
        if wanted("entry"):
            fields = part.scalars()
            for k, e in enumerate(numbers):
                rows.append((e, part.paths[k], "", "entry", None, fields[k]))
        if wanted("step", "cleanup"):
            indexing = part.child("indexing", OPEN[0])
            _plain(rows, indexing, "step", "indexing")
            _cleanups(rows, indexing, "indexing")
    while strings:  # a receipt may be written as a JSON string, and that as another; each round strips one of them
        inner = Index([s for s, _ in strings])
        todo.append(_Part(inner, inner.roots, [entries[e][1] + ".receipt" for _, e in strings], [e for _, e in strings]))
        again = []
        for s, e in strings:
            if s[:1] == b'"':
                try:
                    t = json.loads(s)
                except ValueError:
                    continue
                if isinstance(t, str):
                    again.append((t.encode(), e))
        strings = again
    about: dict[int, tuple] = {}
    for part in todo:
        status = part.ix.member(part.boxes, "status")
        cleanup = part.ix.inner_if(part.ix.member(part.boxes, "process_cleanup"), OPEN[0])
        complete = part.ix.member(cleanup, "complete")
        fields = part.scalars() if wanted("receipt") else [[]] * len(part.entries)
        for k, e in enumerate(part.entries):
            s = part.ix.text(int(status[k])) if status[k] >= 0 and part.ix.inner[status[k]] < 0 else None
            c = truth(part.ix.text(int(complete[k]))) if complete[k] >= 0 and part.ix.inner[complete[k]] < 0 else None
            about[e] = (s, c)
            rows.append((e, part.paths[k], entries[e][1], "receipt", None, fields[k]))
        if wanted("cleanup"):
            _cleanups(rows, part, "receipt")
        if wanted("command", "cleanup", "trace", "output"):
            commands = part.child("runtime_setup", OPEN[1]).elements()
            _plain(rows, commands, "command", None)
            _cleanups(rows, commands, "command")
            _texts(rows, commands.child("expected_output_missing", OPEN[1]), "output", "command")
            _plain(rows, commands.child("retained_traces", OPEN[0]).members(), "trace", "command")
        if wanted("trace"):
            for key in ("stdout_redaction", "stderr_redaction"):
                _plain(rows, part.child(key, OPEN[0]), "trace", "receipt")
            _plain(rows, part.child("retained_traces", OPEN[0]).members(), "trace", "receipt")
        if wanted("tests", "step", "cleanup", "test"):
            tests = part.child("added_tests", OPEN[0])
            _plain(rows, tests, "tests", None)
            run_ = tests.child("receipt", OPEN[0])
            _plain(rows, run_, "step", "tests")
            _cleanups(rows, run_, "tests")
            _texts(rows, tests.child("observed_names", OPEN[1]), "test", None)
    out = []
    for e, path, parent, kind, owner, fields in rows:
        if kinds is not None and kind not in kinds:
            continue
        record, entry, case, repeat = entries[e]
        s, c = about.get(e, (None, None))
        out.append((record, path, parent, entry, kind, owner, case, repeat, s, c, fields))
    return out


def _plain(rows: list, part: _Part, kind: str, owner: str | None) -> None:
    for path, e, f in zip(part.paths, part.entries, part.scalars()):
        parent = path.rsplit(".", 1)[0]
        if parent.endswith(".retained_traces"):  # this is no row of its own
            parent = parent.rsplit(".", 1)[0]
        rows.append((e, path, parent, kind, owner, f))


def _texts(rows: list, part: _Part, kind: str, owner: str | None) -> None:
    """A row for each text in arrays of them, below the object that holds the array."""
    who, slots = part.ix.slots_of(part.boxes)
    for w, s in zip(who, slots):
        if part.ix.kind[s] == QUOTE:
            path = part.paths[w]
            rows.append((part.entries[w], f"{path}[{part.ix.order[s]}]", path.rsplit(".", 1)[0], kind, owner, [("name", part.ix.text(int(s)))]))


def _cleanups(rows: list, owners: _Part, owner: str) -> None:
    _plain(rows, owners.child("process_cleanup", OPEN[0]), "cleanup", owner)


def _run(batches: Iterator[pa.RecordBatch], kinds: frozenset | None) -> Iterator[pa.RecordBatch]:
    field = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    types = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.bool_(), field]
    names = [c.strip().split()[0] for c in ROW.split(",")[:11]]

    def emit(ids, texts):
        rows = shred(ids, texts, kinds)
        if rows:
            cols = list(zip(*rows))
            cols[10] = [[{"name": k, "value": v} for k, v in f] for f in cols[10]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    for b in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t is None:
                continue
            t = t.encode() if isinstance(t, str) else bytes(t)
            if texts and size + len(t) > CHUNK_BYTES:
                yield from emit(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
        if texts:
            yield from emit(ids, texts)


def rows(records: DataFrame, *kinds: str) -> DataFrame:
    """All rows that the payloads nest, or those of some kinds, linked: record_id, row_id (the row's place in the payload,
    unique in a record), parent_id (row_id of the row that it belongs to, '' for entries), entry_id, kind (entry, receipt,
    cleanup, command, output: one that a command missed, trace, tests, test, step: indexing or a run of tests with a
    status of its own), owner (whose cleanup, trace or step it is), case_id, repeat, receipt_status and cleanup_complete
    of the entry's own receipt, and the row's own scalar fields.

    Defined results: null, empty and cut-off payloads give no rows; a receipt written as a JSON string is read like any
    other; missing parts give null columns; of a repeated key the last counts; redelivered records count once (rows are
    unique by record_id and row_id; if copies differ the greatest row stays); records with a null id are left out; other
    columns of the table are not touched.

    Scale: each payload is shredded where it is read, in chunks of bounded size; only the flat rows of the kinds asked
    for leave the shredder and are shuffled.
    """
    which = frozenset(kinds) or None
    texts = records.where("record_id IS NOT NULL AND payload IS NOT NULL").select(F.col("record_id").cast("bigint"), F.col("payload").cast("string"))
    flat = spread(texts).mapInArrow(lambda batches: _run(batches, which), ROW)
    rest = [c for c in flat.columns if c not in ("record_id", "row_id")]
    return flat.groupBy("record_id", "row_id").agg(F.max(F.struct(*rest)).alias("r")).select("record_id", "row_id", "r.*")


#: The typed columns of each flat table.
TABLES = {
    "entry": {"case_sha256": "string", "schema": "int", "created_utc": "string"},
    "receipt": {"status": "string", "elapsed_seconds": "double", "exit_status": "bigint", "timed_out": "boolean", "failure": "string",
                "source_digest_before": "string", "source_digest_after": "string"},
    "cleanup": {"attempted": "boolean", "complete": "string", "signal": "string"},
    "command": {"command_id": "string", "elapsed_seconds": "double", "exit_status": "bigint"},
    "trace": {"status": "string", "original_sha256": "string", "redacted_sha256": "string", "changed": "boolean", "original_bytes": "bigint",
              "path": "string", "raw_retained": "boolean"},
    "tests": {"executed": "boolean"},
    "test": {"name": "string"},
    "step": {"status": "string"},
    "output": {"name": "string"},
}


def flat_table(linked: DataFrame, kind: str) -> DataFrame:
    """One kind of rows() as a flat table with typed columns; a value that does not fit its type is null."""
    fields = F.map_from_entries("fields")
    typed = [F.expr(f"try_cast(f['{n}'] AS {t})").alias(n) for n, t in TABLES[kind].items()]
    own = linked.where(F.col("kind") == kind).withColumn("f", fields)
    return own.select("record_id", "entry_id", "row_id", "parent_id", "owner", "case_id", "repeat", "receipt_status", "cleanup_complete", *typed)


def failed_without_cleanup(linked: DataFrame) -> DataFrame:
    """Entries whose own receipt failed and whose cleanup is known to be incomplete."""
    status = F.lower(F.regexp_replace("receipt_status", r"^\s+|\s+$", ""))
    hit = linked.where((F.col("kind") == "receipt") & (status == "failed") & (F.col("cleanup_complete") == F.lit(False)))
    return hit.select("record_id", "case_id", "repeat").distinct()
