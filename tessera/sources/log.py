"""Append-only logs: calls and checks of hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import latest


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a log. Appending is atomic for each write; readers see whole writes."""
    rows.write.mode("append").parquet(path)


def follow_up(checks: DataFrame, followed: DataFrame) -> DataFrame:
    """The latest check of each (workspace_root, session_id, diff_hash), with followed set where a later row says so.
    followed: the three keys."""
    keys = ["workspace_root", "session_id", "diff_hash"]
    now = latest(checks, keys, "timestamp").drop("followed")
    return now.join(followed.select(*keys).distinct().withColumn("followed", F.lit(True)), keys, "left").withColumn("followed", F.coalesce("followed", F.lit(False)))


def session_base(checks: DataFrame) -> DataFrame:
    """(session_id, base): the base that each session used last."""
    return checks.where("base IS NOT NULL").groupBy("session_id").agg(F.max_by("base", "timestamp").alias("base"))
