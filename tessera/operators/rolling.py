"""Totals over trailing periods, by a two-stack monoid queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.calls import workspace_calls


class TwoStackQueue:
    """A queue that always knows the combination of its elements under an associative operation. Nothing is ever
    subtracted, so maxima and the like work as well as sums. Push, pop and query take constant time on average."""

    def __init__(self, combine: Callable, identity):
        self.combine, self.identity = combine, identity
        self.front: list[tuple] = []  # (key, combination of this and everything nearer to the back of the front stack)
        self.back: list[tuple] = []  # (key, value)
        self.back_total = identity

    def push(self, key, value) -> None:
        self.back.append((key, value))
        self.back_total = self.combine(self.back_total, value)

    def evict_before(self, key) -> None:
        """Drops the elements whose key is less."""
        while True:
            if not self.front:
                total = self.identity
                while self.back:
                    k, v = self.back.pop()
                    total = self.combine(v, total)
                    self.front.append((k, total))
                self.back_total = self.identity
            if not self.front or self.front[-1][0] >= key:
                return
            self.front.pop()

    def total(self):
        return self.combine(self.front[-1][1], self.back_total) if self.front else self.back_total


def _add(a: tuple, b: tuple) -> tuple:
    """Days' facts: (total, number of calls, greatest single value or None)."""
    return (a[0] + b[0], a[1] + b[1], b[2] if a[2] is None else a[2] if b[2] is None else max(a[2], b[2]))


def _roll(entity_days: list[tuple], periods: tuple[int, ...]) -> Iterator[tuple]:
    """For the sorted days of one entity, (day, facts): each day from the first to the last with the facts of each
    trailing period."""
    zero = (0, 0, None)
    queues = [TwoStackQueue(_add, zero) for _ in periods]
    first, last = entity_days[0][0], entity_days[-1][0]
    at = 0
    for day in range(first, last + 1):
        active = at < len(entity_days) and entity_days[at][0] == day
        facts = entity_days[at][1] if active else zero
        at += active
        row = [day, first, facts[0], facts[1]]
        for n, q in zip(periods, queues):
            if active:
                q.push(day, facts)
            q.evict_before(day - n + 1)
            row += q.total()
        yield tuple(row)


def trailing_totals(log: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For each workspace and each UTC day from its first call to its last, days without calls included: the day's total
    of est_tokens_saved and number of calls, and for each period the total, the daily average (total / days of the
    period), the number of calls and the greatest single saving of the period that ends that day.

    Defined results: only savings with est_tokens_saved_known true count, null ones as 0; each id counts once; calls
    without time or workspace are left out, also for the first and last day; the greatest saving is null where the period
    has no counted call; an empty log gives no rows; the order and repetition of rows do not matter.

    Scale: the log is shuffled once by id, then aggregated to (workspace, day) before the second shuffle, so a workspace
    with a third of all calls becomes one row a day. The queue runs inside partitions sorted by workspace and day.
    """
    known = F.coalesce(F.col("est_tokens_saved_known"), F.lit(False))
    saved = F.when(known, F.coalesce(F.col("est_tokens_saved"), F.lit(0)))
    calls = workspace_calls(log, saved=saved)
    day = F.floor(F.col("us") / F.lit(86400000000)).cast("int")
    days = calls.groupBy("workspace_root", day.alias("day")).agg(
        F.coalesce(F.sum("saved"), F.lit(0)).alias("total"), F.count("*").alias("calls"), F.max("saved").alias("greatest"))
    days = days.repartition("workspace_root").sortWithinPartitions("workspace_root", "day")

    columns = ["total", "calls", "greatest"]
    names = ["day", "first_day", "day_total", "day_calls"] + [f"{c}_{n}d" for n in periods for c in columns]
    schema = "workspace_root string, " + ", ".join(f"`{n}` {'int' if n in ('day', 'first_day') else 'bigint'}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] + [pa.int32() if n in ("day", "first_day") else pa.int64() for n in names]

        def flush(root, held):
            rows = list(_roll(held, periods))
            cols = [pa.array([root] * len(rows), types[0])] + [pa.array(c, t) for c, t in zip(zip(*rows), types[1:])]
            return pa.RecordBatch.from_arrays(cols, names=["workspace_root", *names])

        root, held = None, []
        for b in batches:
            r, d, *facts = [b.column(c).to_pylist() for c in ("workspace_root", "day", *columns)]
            for i in range(b.num_rows):
                if r[i] != root and held:
                    yield flush(root, held)
                    held = []
                root = r[i]
                held.append((d[i], tuple(f[i] for f in facts)))
        if held:
            yield flush(root, held)

    out = days.mapInArrow(run, schema)
    averages = [(F.col(f"total_{n}d") / F.lit(float(n))).alias(f"average_{n}d") for n in periods]
    return out.select("*", *averages)


def day_text(day) -> F.Column:
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")


def surges(totals: DataFrame) -> DataFrame:
    """Workspace days at least 29 days after the workspace's first, for which twice the 7-day total is greater than the
    30-day total."""
    hit = (F.col("day") >= F.col("first_day") + 29) & (F.col("total_7d") * 2 > F.col("total_30d"))
    return totals.where(hit).select("workspace_root", day_text(F.col("day")).alias("day"))
