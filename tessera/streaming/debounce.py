"""Debouncing of file events: bursts of changes become single ones."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: More events than this in one batch, or a rescan event, call for a full refresh.
OVERFLOW = 50


def due(queue: list[dict], now: int, timeout: int) -> tuple[list[dict], list[dict]]:
    """(events that go out, events that stay) of one path's queue at a time. From the front, events of at least timeout
    age go out, a later one in place of an earlier one of its kind. The first younger event ends the scan; if one of its
    kind was about to go out, that one is dropped, as the change goes on."""
    out: dict[str, dict] = {}
    for at, event in enumerate(queue):
        if now - event["time"] < timeout:
            out.pop(event["kind"], None)
            return list(out.values()), queue[at:]
        out.pop(event["kind"], None)
        out[event["kind"]] = event
    return list(out.values()), []


#: Kinds with which a queue says that its path was made, or went away.
_MADE, _GONE = ("create", "rename-to"), ("remove", "rename-from")


class Queues:
    """Event queues by path.

    The rules: a change or creation is not queued where the queue begins with a creation, as it is part of it. A removal
    replaces its path's queue and drops those below. Of a rename the two halves count, each queued by itself; where they
    carry the same tracker or file id, what waits for the source waits for the target instead, behind one whole rename
    (none, if the source was just made), which keeps the first source and the time of an earlier rename. What the target
    had waiting is dropped; unless that began with a creation, its removal comes first, marked as an override unless the
    target was removed already. A removal that waits for the source stays where it is.
    """

    def __init__(self, queues: dict[str, list[dict]] | None = None, pending: dict | None = None, rescan: dict | None = None):
        self.queues = queues or {}
        self.pending = pending  # a rename-from that waits for its other half
        self.rescan = rescan  # says that events were lost

    def add(self, event: dict) -> None:
        """Takes one event: kind, time, paths, and perhaps tracker, file_id, exists (of a rename whose half is not known:
        whether the path is there). Whole renames are left to their halves; other kinds and events without a path say
        nothing."""
        kind = event["kind"]
        if kind == "rescan":
            self.rescan = event
            return
        if not event.get("paths"):
            return
        if kind == "rename-any":
            kind = "rename-to" if event.get("exists") else "rename-from"
            event = {**event, "kind": kind}
        if kind.startswith("remove"):
            self._remove(event)
        elif kind == "rename-from":
            self.pending = event
            self._append(event)
        elif kind == "rename-to":
            self._rename_to(event)
        elif kind.startswith(("create", "modify", "close", "access")):
            if kind.startswith("close") or kind.startswith("access") or not self._begins(event["paths"][0], _MADE):
                self._append(event)

    def _begins(self, path: str, kinds: tuple[str, ...]) -> bool:
        queue = self.queues.get(path)
        return bool(queue) and queue[0]["kind"].startswith(kinds)

    def _append(self, event: dict) -> None:
        self.queues.setdefault(event["paths"][0], []).append(event)

    def _remove(self, event: dict) -> None:
        path = event["paths"][0]
        for below in [p for p in self.queues if p.startswith(path.rstrip("/") + "/")]:
            del self.queues[below]
        self.queues[path] = [event]

    def _rename_to(self, event: dict) -> None:
        start, self.pending = self.pending, None
        same = start is not None and any(start.get(k) is not None and start.get(k) == event.get(k) for k in ("tracker", "file_id"))
        if same:
            self._stitch(start, event)
        else:
            self._append(event)

    def _stitch(self, start: dict, event: dict) -> None:
        source, target = start["paths"][0], event["paths"][0]
        waiting = self.queues.pop(source, [])[:-1]  # without the half that ends here
        earlier = next((e for e in waiting if e["kind"] == "rename-both"), None)
        origin, time = (earlier["paths"][0], earlier["time"]) if earlier else (source, start["time"])
        waiting = [e for e in waiting if e is not earlier]
        if waiting and waiting[0]["kind"].startswith(_GONE):
            gone = waiting.pop(0)
            self.queues[gone["paths"][0]] = [gone]
        made = bool(waiting) and waiting[0]["kind"].startswith(_MADE)
        moved = [{**e, "paths": [target]} for e in waiting]
        if not made:
            moved.insert(0, {**event, "kind": "rename-both", "paths": [origin, target], "time": time})
        if target in self.queues and not self._begins(target, _MADE):
            gone = {"kind": "remove-any", "paths": [target], "time": time}
            if not self._begins(target, _GONE):
                gone["info"] = "override"
            moved.insert(0, gone)
        self.queues[target] = moved

    def emit(self, now: int, timeout: int) -> list[dict]:
        """What goes out now, in the order of time, of equal times by path, each path's own order kept."""
        rows = []
        if self.rescan and now - self.rescan["time"] >= timeout:
            rows.append((self.rescan["time"], "", 0, self.rescan))
            self.rescan = None
        for path in sorted(self.queues):
            out, rest = due(self.queues[path], now, timeout)
            latest = 0
            for n, e in enumerate(out):
                latest = max(latest, e["time"])
                rows.append((latest, path, n, e))
            if rest:
                self.queues[path] = rest
            else:
                del self.queues[path]
        return [e for *_, e in sorted(rows, key=lambda r: r[:3])]

    def next_due(self, timeout: int) -> int | None:
        waiting = [q[0] for q in self.queues.values()] + ([self.rescan] if self.rescan else [])
        return min((e["time"] + timeout for e in waiting), default=None)


def tick(timeout: float) -> float:
    """How often queues are looked at: four times a timeout."""
    return timeout / 4


def next_reconcile(started: float, ended: float, least: float = 1.0) -> float:
    """When the next full refresh may begin after one that overflowed: not before a second, nor before as long again as
    the last one took."""
    return ended + max(least, ended - started)


def retry_delays(first: float = 1.0, most: float = 30.0) -> Iterator[float]:
    """How long to wait before a failed source is opened again: twice as long each time, up to a bound."""
    delay = first
    while True:
        yield delay
        delay = min(2 * delay, most)


def with_retries(start, attempts: int, wait=time.sleep):
    """start(), tried again after growing delays where it fails; the last failure is raised."""
    delays = retry_delays()
    for n in range(attempts):
        try:
            return start()
        except Exception:
            if n == attempts - 1:
                raise
            wait(next(delays))


OUT = "root string, kind string, path string, time bigint"


def debounce_stream(events: DataFrame, timeout_ms: int = 150, lateness: str = "0 seconds") -> DataFrame:
    """A streaming DataFrame of debounced events (root, kind, path, time in ms) from a stream (root, ts TIMESTAMP, kind,
    paths array, tracker). The state of a root holds the queues of all its paths, so the removal of a folder drops the
    queues below it; roots are independent and spread over the cluster. Time is event time: the watermark moves it."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        queues = Queues(held.get("queues"), held.get("pending"), held.get("rescan"))
        if not state.hasTimedOut:
            for b in batches:
                for r in b.sort_values("ts", kind="stable").itertuples():
                    queues.add({"kind": r.kind, "time": int(r.ts.value // 1_000_000), "paths": list(r.paths) if r.paths is not None else [], "tracker": None if pd.isna(r.tracker) else int(r.tracker)})
        now = state.getCurrentWatermarkMs()
        out = queues.emit(now, timeout_ms)
        if queues.queues or queues.rescan:
            state.update((json.dumps({"queues": queues.queues, "pending": queues.pending, "rescan": queues.rescan}),))
            state.setTimeoutTimestamp(max(queues.next_due(timeout_ms), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(key[0], e["kind"], (e.get("paths") or [None])[-1], e["time"]) for e in out], columns=["root", "kind", "path", "time"])

    own = events.select("root", "ts", "kind", "paths", F.col("tracker").cast("bigint")).withWatermark("ts", lateness)
    return own.groupBy("root").applyInPandasWithState(step, OUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def debounce_batch(events: DataFrame, timeout_us: int) -> DataFrame:
    """The batch form for recorded events (path, kind, us, id): an event stays if no other of its path and kind follows
    within the timeout. Of equal times the greatest id stays."""
    w = Window.partitionBy("path", "kind").orderBy("us", "id")
    return events.withColumn("next", F.lead("us").over(w)).where(F.col("next").isNull() | (F.col("next") - F.col("us") >= timeout_us)).drop("next")


def needs_full_refresh(batch: DataFrame, overflow: int = OVERFLOW) -> bool:
    """Whether a batch of changes is too large, or says that events were lost."""
    return bool(batch.agg((F.count("*") > overflow) | F.coalesce(F.bool_or(F.col("kind") == "rescan"), F.lit(False))).first()[0])


def refresh(stream: DataFrame, one_by_one, all_at_once, checkpoint: str, **trigger):
    """Starts a query that hands each micro-batch of changes to one_by_one(batch, id), or to all_at_once(id) where the
    batch overflows."""

    def each(batch: DataFrame, number: int) -> None:
        if needs_full_refresh(batch):
            all_at_once(number)
        else:
            one_by_one(batch, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch(spark, folder: str, schema: str = "root string, ts timestamp, kind string, paths array<string>, tracker bigint", most_files: int = 32) -> DataFrame:
    """A stream of file events from a folder to which a watcher writes Parquet files of them, at most so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def affected_locals(changed: DataFrame, symbols: DataFrame, before: DataFrame) -> DataFrame:
    """(symbol_id, change) of the index of names after files changed: indexed for symbols of the changed files (path) that
    are no locals, dropped for those that were indexed (before: symbol_id, path) and are gone or are locals now, such as
    a variable whose function came later."""
    from tessera.operators.walk import local_variables

    inside = local_variables(symbols)
    now = symbols.join(changed.select("path").distinct(), "path", "left_semi").select("symbol_id").join(inside, "symbol_id", "left_anti")
    old = before.join(changed.select("path").distinct(), "path", "left_semi").select("symbol_id")
    late = before.select("symbol_id").join(inside, "symbol_id", "left_semi")
    dropped = old.join(now, "symbol_id", "left_anti").unionByName(late).distinct()
    return now.select("symbol_id", F.lit("indexed").alias("change")).unionByName(dropped.select("symbol_id", F.lit("dropped").alias("change")))
