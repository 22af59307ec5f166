"""Sessions of activity, by occupancy bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.times import ntz_from_micros
from tessera.operators.calls import canonical_tool, workspace_calls

DAY = 86400


def close_gaps(bits: int, gap: int) -> int:
    """The bitmap (bit i of a Python integer: slot i is occupied) with all gaps filled whose two ends are at most `gap`
    slots apart: dilation by gap - 1 upwards, then erosion by as much. Both grow their reach by doubling shifts, so they
    take O(log gap) operations on whole machine words."""
    gap -= 1  # neighbouring slots are one apart and need no filling
    grown, reach = bits, 0
    while reach < gap:
        step = min(reach + 1, gap - reach)
        grown |= grown << step
        reach += step
    kept, reach = grown, 0
    while reach < gap:
        step = min(reach + 1, gap - reach)
        kept &= kept >> step
        reach += step
    return kept  # slot i survives if i .. i+gap are all grown: exactly the closing


def runs(bits: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last slots of the runs of set bits."""
    flat = np.unpackbits(np.frombuffer(bits.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")
    edge = np.diff(np.concatenate(([0], flat, [0])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _day_runs(second: np.ndarray, lo: np.ndarray, hi: np.ndarray, gap: int) -> np.ndarray:
    """For the slots of one workspace and day (seconds of the day, ascending; least and greatest microsecond in each):
    the index of the first slot of each run. The bitmap has whole seconds, so two slots exactly `gap` apart are looked
    at again by their microseconds."""
    flags = np.zeros(DAY + 8, np.uint8)
    flags[second] = 1
    bits = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    starts, _ = runs(close_gaps(bits, gap), DAY)
    at = np.searchsorted(second, starts)
    edge = np.flatnonzero((second[1:] - second[:-1] == gap) & (lo[1:] - hi[:-1] > gap * 1000000)) + 1
    return np.unique(np.concatenate((at, edge)))


def _runs_of_days(gap: int):
    """mapInArrow over rows sorted by workspace, day and least time: one row for each workspace, day, run and tool."""
    schema = pa.schema([("workspace_root", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first_us", pa.int64()),
                        ("first_id", pa.string()), ("tool", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            t = t.combine_chunks()
            root = t["workspace_root"].combine_chunks().dictionary_encode()
            code = root.indices.to_numpy(zero_copy_only=False)
            day, lo, width, n = (t[c].to_numpy() for c in ("day", "lo", "width", "n"))
            hi, sec = lo + width, lo // 1000000 % DAY
            tool = t["tool"].combine_chunks().dictionary_encode()
            tools = np.nan_to_num(tool.indices.to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
            cuts = np.flatnonzero((code[1:] != code[:-1]) | (day[1:] != day[:-1])) + 1
            row_run = np.zeros(t.num_rows, np.int64)
            for a, b in zip([0, *cuts], [*cuts, t.num_rows]):
                slot = np.flatnonzero(np.concatenate(([True], sec[a + 1:b] != sec[a:b - 1])))
                slots = sec[a:b][slot]
                low, high = np.minimum.reduceat(lo[a:b], slot), np.maximum.reduceat(hi[a:b], slot)
                first = _day_runs(slots, low, high, gap)
                row_run[a + slot[first]] = 1
            row_run = np.cumsum(row_run)
            # one row for each run and tool
            order = np.lexsort((tools, row_run))
            rr, tt = row_run[order], tools[order]
            head = np.flatnonzero(np.concatenate(([True], (rr[1:] != rr[:-1]) | (tt[1:] != tt[:-1]))))
            count = np.add.reduceat(n[order], head)
            run_head = np.flatnonzero(np.concatenate(([True], row_run[1:] != row_run[:-1])))
            start, end = np.minimum.reduceat(lo, run_head), np.maximum.reduceat(hi, run_head)
            which = rr[head] - 1
            # the first call of the run and tool: the least (time, id) of its slots
            ids = t["first_id"].combine_chunks()
            rank = np.empty(len(ids), np.int64)
            rank[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
            by_first = np.lexsort((rank, lo, tools, row_run))
            least = by_first[head]
            yield from pa.Table.from_arrays([
                root.take(pa.array(order[head])).cast(pa.string()), pa.array(start[which]), pa.array(end[which]),
                pa.array(lo[least]), ids.take(pa.array(least)), tool.take(pa.array(order[head])).cast(pa.string()), pa.array(count),
            ], schema=schema).to_batches()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held.append(t)
            # rows up to the last change of workspace or day are complete
            root, day = batch.column("workspace_root"), batch.column("day").to_numpy()
            last = root[-1].as_py()
            same = np.asarray(pc.equal(root, last)) & (day == day[-1])
            change = np.flatnonzero(~same)
            if len(change):
                whole = pa.concat_tables([*held[:-1], t.slice(0, int(change[-1]) + 1)])
                held = [t.slice(int(change[-1]) + 1)]
                yield from emit(whole)
        if held:
            yield from emit(pa.concat_tables(held))

    return run, "workspace_root string, start bigint, end bigint, first_us bigint, first_id string, tool string, n bigint"


def sessions(log: DataFrame, pause_seconds: int = 1800) -> DataFrame:
    """Sessions of the calls of each workspace: a session ends where the next call comes more than pause_seconds later.

    One row for each session: workspace_root, session_start, session_end (TIMESTAMP_NTZ), duration_ms, calls, first_id
    (of several first calls at one time the smallest id) and tool_calls, an array of (tool, calls) sorted by tool.

    Defined results: each id counts once; calls without time or workspace are left out; exactly pause_seconds apart is
    the same session; a call without tool counts under a null tool; an empty log gives no rows.

    Scale: calls are pre-aggregated to (workspace, second, tool), then to runs of one workspace and day through bitmaps
    of 86,400 slots, so even a workspace with a third of all calls is spread over its days and none of its groups can
    exceed 86,400 slots. Runs (at most 48 a workspace and day) are stitched over midnight by a window.
    """
    calls = workspace_calls(log, tool=canonical_tool(F.col("tool")))
    slots = calls.groupBy("workspace_root", F.floor(F.col("us") / F.lit(1000000)).alias("second"), "tool").agg(
        F.min(F.struct("us", "id")).alias("first"), F.max("us").alias("hi"), F.count("*").alias("n"))
    lo = F.col("first.us")
    slots = slots.select("workspace_root", F.floor(F.col("second") / DAY).cast("int").alias("day"), "tool", lo.alias("lo"),
                         (F.col("hi") - lo).cast("int").alias("width"), F.col("first.id").alias("first_id"), "n")
    run, schema = _runs_of_days(pause_seconds)
    parts = slots.repartition("workspace_root", "day").sortWithinPartitions("workspace_root", "day", "lo").mapInArrow(run, schema)
    day_runs = parts.groupBy("workspace_root", "start", "end").agg(
        F.min(F.struct("first_us", "first_id")).alias("first"), F.sum("n").alias("n"), F.collect_list(F.struct("tool", "n")).alias("tools"))
    w = Window.partitionBy("workspace_root").orderBy("start", "end")
    opens = F.coalesce(F.col("start") - F.lag("end").over(w) > pause_seconds * 1000000, F.lit(True))
    numbered = day_runs.withColumn("opens", opens.cast("int")).withColumn("session", F.sum("opens").over(w))
    joined = numbered.groupBy("workspace_root", "session").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("calls"), F.min("first").alias("first"), F.flatten(F.collect_list("tools")).alias("tools"))
    names = F.array_sort(F.array_distinct(F.transform("tools", lambda t: t["tool"])))
    per_tool = F.transform(names, lambda name: F.struct(name.alias("tool"), F.aggregate(
        F.filter("tools", lambda t: t["tool"].eqNullSafe(name)), F.lit(0).cast("bigint"), lambda s, t: s + t["n"]).alias("calls")))
    return joined.select(
        "workspace_root", ntz_from_micros(F.col("start")).alias("session_start"), ntz_from_micros(F.col("end")).alias("session_end"),
        F.floor((F.col("end") - F.col("start")) / F.lit(1000)).alias("duration_ms"), "calls", F.col("first.first_id").alias("first_id"), per_tool.alias("tool_calls"))
