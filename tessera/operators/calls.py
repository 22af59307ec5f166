"""The call log, cleaned: each call once, with its canonical workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import canonical_root
from tessera.functions.times import micros


def canonical_tool(tool):
    """Tool names differ in case, outer blanks and `-` for `_`."""
    return F.lower(F.trim(F.replace(tool, F.lit("-"), F.lit("_"))))


def distinct_calls(log: DataFrame, **values) -> DataFrame:
    """Each call id once, with the given columns (name=expression over the log).

    A call may be delivered twice; the copies agree but for spellings and nulls, so each value is the greatest non-null
    one of the copies, whatever their order. Rows with a null id are left out. An empty log gives no rows. Partial
    aggregation runs before the one shuffle by id.
    """
    kept = log.select(F.col("id"), *[e.alias(n) for n, e in values.items()]).where(F.col("id").isNotNull())
    return kept.groupBy("id").agg(*[F.max(n).alias(n) for n in values])


def workspace_calls(log: DataFrame, **values) -> DataFrame:
    """Distinct calls that have both a time and a workspace: id, workspace_root (canonical), us (microseconds) and the
    given columns."""
    calls = distinct_calls(log, workspace_root=canonical_root(F.col("workspace_root")), us=micros(F.col("timestamp")), **values)
    return calls.where("workspace_root IS NOT NULL AND us IS NOT NULL")
