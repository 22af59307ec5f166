"""Percentiles from logarithmic buckets, with a bounded relative error."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.calls import canonical_tool, distinct_calls

#: Values that stand for "not measured".
SENTINELS = (2147483647, 4294967295, 9223372036854775807)


def gamma(error: float) -> float:
    """The ratio of a bucket's ends; a thousandth of the allowed error is kept for rounding."""
    error *= 0.999
    return (1 + error) / (1 - error)


def bucket_of(value, error: float = 0.01):
    """(sign, bucket) of a number: bucket i of sign 1 holds (gamma^(i-1), gamma^i], sign -1 its mirror image, sign 0
    only zero."""
    log = F.ceil(F.log(F.abs(value.cast("double"))) / F.lit(math.log(gamma(error)))).cast("int")
    return F.signum(value.cast("double")).cast("int"), F.when(value == 0, 0).otherwise(log)


def sketch(values: DataFrame, keys: list[str], value: str, error: float = 0.01) -> DataFrame:
    """Bucket counts of each group: keys, sign, bucket, n. Null values are left out. The partial aggregation before the
    shuffle leaves at most a few thousand buckets for each group and task, however many rows the group has."""
    sign, bucket = bucket_of(F.col(value), error)
    rows = values.where(F.col(value).isNotNull()).select(*keys, sign.alias("sign"), bucket.alias("bucket"))
    return rows.groupBy(*keys, "sign", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of parts (days, partitions), added up over everything that is not in keys."""
    return sketches.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: list[str], ranks: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), error: float = 0.01) -> DataFrame:
    """keys, n and p50, p90, ... of each group: the nearest-rank percentile (the value at place ceil(rank * n)), off by at
    most `error` times the true value. Groups are null-safe."""
    order = F.col("sign") * (F.col("bucket") + F.lit(1 << 20))  # negative values by falling magnitude
    by = Window.partitionBy(*keys)
    upto = F.sum("n").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    g = gamma(error)
    estimate = F.col("sign") * 2 * F.pow(F.lit(g), F.col("bucket")) / F.lit(g + 1)
    rows = sketches.select(*keys, "n", upto.alias("upto"), F.sum("n").over(by).alias("total"), estimate.alias("estimate"))
    # percents as whole numbers, so that the place does not depend on rounding
    at = [(r, F.expr(f"(total * {round(r * 10000)} + 9999) div 10000")) for r in ranks]
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.round(F.max(F.when((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k), F.col("estimate"))), 6).alias(f"p{r * 100:g}") for r, k in at])


def valid_durations(log: DataFrame) -> DataFrame:
    """Each call once: day, tool (canonical), workspace_name and duration_ms, where that is neither null, negative nor a
    sentinel."""
    day = F.to_date(F.col("timestamp"))
    calls = distinct_calls(log, day=day, tool=canonical_tool(F.col("tool")), workspace_name=F.col("workspace_name"), duration_ms=F.col("duration_ms"))
    return calls.where((F.col("duration_ms") >= 0) & ~F.col("duration_ms").isin(*SENTINELS))


def daily_sketches(log: DataFrame, error: float = 0.01) -> DataFrame:
    """The summaries of separate days: day, tool, workspace_name, sign, bucket, n."""
    return sketch(valid_durations(log), ["day", "tool", "workspace_name"], "duration_ms", error)


def duration_percentiles(daily: DataFrame, error: float = 0.01) -> DataFrame:
    """From the summaries of separate days, the percentiles over all days for each tool, each workspace name and each
    pair: level ('tool', 'workspace', 'tool_workspace'), tool, workspace_name, n, p50, p90, p95, p99, max_relative_error.

    Defined results: calls without time belong to the null day and count; a null tool or workspace name is a group of
    its own; an empty log gives no rows. The pairs' buckets are merged first, so the three levels expand only those.
    """
    pairs = merge(daily, ["tool", "workspace_name"])
    levels = pairs.select(F.explode(F.array(
        F.struct(F.lit("tool").alias("level"), F.col("tool").alias("tool"), F.lit(None).cast("string").alias("workspace_name")),
        F.struct(F.lit("workspace").alias("level"), F.lit(None).cast("string").alias("tool"), F.col("workspace_name").alias("workspace_name")),
        F.struct(F.lit("tool_workspace").alias("level"), F.col("tool").alias("tool"), F.col("workspace_name").alias("workspace_name")))).alias("k"),
        "sign", "bucket", "n").select("k.*", "sign", "bucket", "n")
    keys = ["level", "tool", "workspace_name"]
    return percentiles(merge(levels, keys), keys, error=error).withColumn("max_relative_error", F.lit(error))
