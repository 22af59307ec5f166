"""Queries over the call log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import CANONICAL_ROOT_SQL
from tessera.operators import rolling, sessions
from tessera.sources.tables import table


def p1_rolling(spark: SparkSession, folder: str) -> DataFrame:
    t = rolling.trailing_totals(table(spark, folder, "tool_telemetry"))
    return t.withColumn("day", rolling.day_text(F.col("day"))).drop("first_day")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.surges(rolling.trailing_totals(table(spark, folder, "tool_telemetry")))


def p5_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.sessions(table(spark, folder, "tool_telemetry")).drop("tool_calls")


def p5_session_tools(spark: SparkSession, folder: str) -> DataFrame:
    s = sessions.sessions(table(spark, folder, "tool_telemetry"))
    return s.select("workspace_root", "first_id", F.explode("tool_calls").alias("t")).select("workspace_root", "first_id", "t.tool", "t.calls")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.sessions(table(spark, folder, "tool_telemetry")).select("first_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_rolling, p5_found, p5_sessions, p5_session_tools)}

_CALLS = f"""calls AS (
  SELECT id, max({CANONICAL_ROOT_SQL.format("workspace_root")}) AS ws, max(epoch_us("timestamp")) AS us,
    max(lower(trim(replace(tool, '-', '_')))) AS tool,
    max(CASE WHEN est_tokens_saved_known THEN coalesce(est_tokens_saved, 0) END) AS saved
  FROM tool_telemetry WHERE id IS NOT NULL GROUP BY id),
placed AS (SELECT *, us // 86400000000 AS day FROM calls WHERE ws IS NOT NULL AND us IS NOT NULL)"""

_ROLLING = f"""WITH {_CALLS},
days AS (SELECT ws, day, coalesce(sum(saved), 0) AS total, count(*) AS calls, max(saved) AS greatest FROM placed GROUP BY ALL),
spans AS (SELECT ws, min(day) AS first_day, max(day) AS last_day FROM days GROUP BY ws),
grid AS (SELECT ws, first_day, unnest(generate_series(first_day, last_day)) AS day FROM spans),
full_days AS (SELECT g.ws, g.first_day, g.day, coalesce(d.total, 0) AS total, coalesce(d.calls, 0) AS calls, d.greatest
  FROM grid g LEFT JOIN days d USING (ws, day)),
rolled AS (SELECT ws, first_day, day, total, calls,
  sum(total) OVER a AS t7, sum(calls) OVER a AS c7, max(greatest) OVER a AS g7,
  sum(total) OVER b AS t30, sum(calls) OVER b AS c30, max(greatest) OVER b AS g30
  FROM full_days WINDOW a AS (PARTITION BY ws ORDER BY day ROWS 6 PRECEDING), b AS (PARTITION BY ws ORDER BY day ROWS 29 PRECEDING))"""
_DAY = "strftime(DATE '1970-01-01' + day::INTEGER, '%Y-%m-%d')"

_SESSIONS = f"""WITH {_CALLS},
marked AS (SELECT *, CASE WHEN us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS opens FROM placed WINDOW w AS (PARTITION BY ws ORDER BY us)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY ws ORDER BY us) AS session FROM marked),
found AS (SELECT ws, session, min(us) AS a, max(us) AS b, count(*) AS calls, min(id) FILTER (us = first_us) AS first_id
  FROM (SELECT *, min(us) OVER (PARTITION BY ws, session) AS first_us FROM numbered) GROUP BY ws, session)"""

SQL = {
    "p1_found": f"{_ROLLING} SELECT ws AS workspace_root, {_DAY} AS day FROM rolled WHERE day >= first_day + 29 AND 2 * t7 > t30",
    "p1_rolling": f"""{_ROLLING} SELECT ws AS workspace_root, {_DAY} AS day, total::BIGINT AS day_total, calls::BIGINT AS day_calls,
      t7::BIGINT AS total_7d, c7::BIGINT AS calls_7d, g7 AS greatest_7d, t30::BIGINT AS total_30d, c30::BIGINT AS calls_30d, g30 AS greatest_30d,
      t7 / 7.0::DOUBLE AS average_7d, t30 / 30.0::DOUBLE AS average_30d FROM rolled""",
    "p5_found": f"{_SESSIONS} SELECT first_id FROM found",
    "p5_sessions": f"""{_SESSIONS} SELECT ws AS workspace_root, make_timestamp(a) AS session_start, make_timestamp(b) AS session_end,
      (b - a) // 1000 AS duration_ms, calls, first_id FROM found""",
    "p5_session_tools": f"""{_SESSIONS} SELECT f.ws AS workspace_root, f.first_id, n.tool, count(*) AS calls
      FROM numbered n JOIN found f ON f.ws = n.ws AND f.session = n.session GROUP BY ALL""",
}
