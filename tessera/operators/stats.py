"""Aggregates over the call log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of time windows and the days that rolling ones go back; None: from the start of the day or month.
WINDOWS = {"today": None, "7d": 7, "week": 7, "30d": 30, "month": None, "this-month": None, "year": 365, "last-year": 365, "all": 0, "all-time": 0}


def in_window(ts: Column, window: str, now: Column) -> Column:
    """Whether a time lies in a named window that ends now."""
    key = window.strip().lower()
    if key not in WINDOWS:
        raise ValueError(f"unknown time window {window!r}; known: {', '.join(WINDOWS)}")
    if key in ("all", "all-time"):
        return F.lit(True)
    if key == "today":
        return ts >= F.date_trunc("day", now)
    if key in ("month", "this-month"):
        return ts >= F.date_trunc("month", now)
    return ts >= now - F.expr(f"INTERVAL {WINDOWS[key]} DAYS")


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))


def totals(log: DataFrame) -> DataFrame:
    """One row of totals; an empty log gives zeros."""
    o = F.col("outcome")
    return log.agg(F.count("*").alias("calls"), _sum(o == "ok").alias("ok"), _sum(o == "empty").alias("empty"), _sum(o == "error").alias("errors"),
                   _sum(F.col("bytes_returned")).alias("bytes_returned"), _sum(F.col("est_tokens")).alias("est_tokens"),
                   _sum(F.when(F.col("est_tokens_saved_known"), F.col("est_tokens_saved"))).alias("tokens_saved"))


def per_tool(log: DataFrame) -> DataFrame:
    """One row for each tool, with exact nearest-rank percentiles of the duration (the value at place ceil(p * n)); a null
    tool is a tool of its own. Calls are counted by tool and duration before the shuffle, and places are running sums over
    the sorted durations of a tool, so no task holds a tool's calls or the table of its values in memory."""
    o = F.col("outcome")
    by = log.groupBy("tool", "duration_ms").agg(F.count("*").alias("calls"), _sum(o == "ok").alias("ok"), _sum(o == "empty").alias("empty"), _sum(o == "error").alias("errors"), F.sum("est_tokens").alias("est_tokens"))
    n = F.when(F.col("duration_ms").isNotNull(), F.col("calls")).otherwise(0)
    tool = Window.partitionBy("tool")
    rows = by.withColumn("n", n).withColumn("upto", F.sum("n").over(tool.orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(tool))
    at = lambda p: F.max(F.when((F.col("upto") >= F.expr(f"(total * {p} + 99) div 100")) & (F.col("upto") - F.col("n") < F.expr(f"(total * {p} + 99) div 100")), F.col("duration_ms")))
    mean = F.sum(F.col("duration_ms").cast("decimal(20,0)") * F.col("n")).cast("double") / F.nullif(F.sum("n"), F.lit(0))
    return rows.groupBy("tool").agg(*[F.sum(c).alias(c) for c in ("calls", "ok", "empty", "errors")], F.round(mean, 6).alias("mean_ms"), F.coalesce(F.sum("est_tokens"), F.lit(0)).alias("est_tokens"), at(50).alias("p50_ms"), at(95).alias("p95_ms"))


def recent_errors(log: DataFrame, n: int = 10) -> DataFrame:
    """The n latest errors; of equal times the greater id first."""
    return log.where("outcome = 'error'").orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc()).limit(n).select("id", "timestamp", "tool", "error_message")


def retained(log: DataFrame, days: int, now: Column) -> DataFrame:
    """Rows that a retention of so many days keeps; rows without time stay."""
    return log.where(F.col("timestamp").isNull() | (F.col("timestamp") >= now - F.expr(f"INTERVAL {days} DAYS")))


def mask_error(text: Column, homes: tuple[str, ...] = (), size: int = 500) -> Column:
    """An error text without the home folders (each in both spellings of its separators becomes ~), in one line, bars
    escaped, cut at size characters and not inside an escaped bar."""
    for home in homes:
        for spelling in dict.fromkeys((home, home.replace("\\", "/"), home.replace("/", "\\"))):
            text = F.replace(text, F.lit(spelling), F.lit("~"))
    for ends in ("\r\n", "\n", "\r"):
        text = F.replace(text, F.lit(ends), F.lit(" "))
    text = F.replace(text, F.lit("|"), F.lit("\\|"))
    short = F.substring(text, 1, size)
    half = F.endswith(short, F.lit("\\")) & ~F.endswith(short, F.lit("\\\\"))
    return F.when(F.length(text) <= size, text).when(half, F.substring(text, 1, size - 1)).otherwise(short)


def saved_tokens(baseline_bytes: Column, est_tokens: Column) -> Column:
    """max(0, baseline / 4 - tokens), whole numbers."""
    return F.greatest(F.lit(0), F.floor(baseline_bytes / F.lit(4)) - est_tokens)
