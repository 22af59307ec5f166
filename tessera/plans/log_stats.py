"""Call log statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.operators.calls import canonical_tool
from tessera.sources.tables import table


def _log(spark, folder):
    """One row of each call (all copies have its numbers), by its id."""
    t = table(spark, folder, "tool_telemetry")
    cols = ["timestamp", "outcome", "error_message", "duration_ms", "bytes_returned", "est_tokens", "est_tokens_saved", "est_tokens_saved_known", "workspace_name", "code_version"]
    return t.select("id", *cols, canonical_tool(F.col("tool")).alias("tool")).groupBy("id").agg(*[F.max(c).alias(c) for c in [*cols, "tool"]])


def now():
    return F.expr("TIMESTAMP_NTZ'2026-09-15 12:00:00'")


#: Folders that error texts must not show.
HOMES = ("/srv/checkouts", "/home/dev", "C:\\Users\\dev")


def telemetry_totals(spark, folder):
    return stats.totals(_log(spark, folder))


def telemetry_by_tool(spark, folder):
    return stats.per_tool(_log(spark, folder))


def telemetry_recent_errors(spark, folder):
    return stats.recent_errors(_log(spark, folder))


def telemetry_windows(spark, folder):
    """Calls of each named time window that ends at a fixed time."""
    log = _log(spark, folder).where(F.col("timestamp") <= now())
    out = None
    for w in stats.WINDOWS:
        one = log.where(stats.in_window(F.col("timestamp"), w, now())).agg(F.count("*").alias("calls")).select(F.lit(w).alias("time_window"), "calls")
        out = one if out is None else out.unionByName(one)
    return out


def telemetry_retained(spark, folder):
    return stats.retained(_log(spark, folder), 365, now()).groupBy("code_version").agg(F.count("*").alias("calls"))


def telemetry_errors_masked(spark, folder):
    """With the workspaces' parent folders as homes."""
    return _log(spark, folder).where("outcome = 'error'").select("id", stats.mask_error(F.col("error_message"), HOMES).alias("message"))


def telemetry_saved(spark, folder):
    """What reading whole answers of 4,000 bytes instead would have cost."""
    return _log(spark, folder).select("id", stats.saved_tokens(F.lit(4000), F.col("est_tokens")).alias("saved"))


QUERIES = {f.__name__: f for f in (telemetry_totals, telemetry_by_tool, telemetry_recent_errors, telemetry_windows, telemetry_retained, telemetry_errors_masked, telemetry_saved)}

_LOG = """WITH t AS (SELECT id, max("timestamp") AS "timestamp", max(outcome) AS outcome, max(error_message) AS error_message, max(duration_ms) AS duration_ms, max(bytes_returned) AS bytes_returned,
  max(est_tokens) AS est_tokens, max(est_tokens_saved) AS est_tokens_saved, max(est_tokens_saved_known) AS known, max(code_version) AS code_version, max(lower(trim(replace(tool, '-', '_')))) AS tool FROM tool_telemetry GROUP BY id)"""
_COUNTS = "count(*) AS calls, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'empty') AS empty, count(*) FILTER (outcome = 'error') AS errors"
_NOW = "TIMESTAMP '2026-09-15 12:00:00'"
_HOMELESS = "error_message"
for _home in HOMES:
    for _spelling in dict.fromkeys((_home, _home.replace("\\", "/"), _home.replace("/", "\\"))):
        _HOMELESS = f"replace({_HOMELESS}, '{_spelling}', '~')"
SQL = {
    "telemetry_totals": f"{_LOG} SELECT {_COUNTS}, coalesce(sum(bytes_returned), 0)::BIGINT AS bytes_returned, coalesce(sum(est_tokens), 0)::BIGINT AS est_tokens, coalesce(sum(est_tokens_saved) FILTER (known), 0)::BIGINT AS tokens_saved FROM t",
    "telemetry_by_tool": f"""{_LOG} SELECT tool, {_COUNTS}, round(avg(duration_ms), 6) AS mean_ms, coalesce(sum(est_tokens), 0)::BIGINT AS est_tokens,
      quantile_disc(duration_ms, 0.5)::BIGINT AS p50_ms, quantile_disc(duration_ms, 0.95)::BIGINT AS p95_ms FROM t GROUP BY tool""",
    "telemetry_recent_errors": f"{_LOG} SELECT id, \"timestamp\", tool, error_message FROM t WHERE outcome = 'error' ORDER BY \"timestamp\" DESC NULLS LAST, id DESC LIMIT 10",
    "telemetry_windows": f"{_LOG}, p AS (SELECT \"timestamp\" AS ts FROM t WHERE \"timestamp\" <= {_NOW}) " + " UNION ALL ".join(
        f"SELECT '{w}' AS time_window, count(*) AS calls FROM p WHERE {c}" for w, c in (
            ("today", f"ts >= date_trunc('day', {_NOW})"), ("7d", f"ts >= {_NOW} - INTERVAL 7 DAYS"), ("week", f"ts >= {_NOW} - INTERVAL 7 DAYS"), ("30d", f"ts >= {_NOW} - INTERVAL 30 DAYS"),
            ("month", f"ts >= date_trunc('month', {_NOW})"), ("this-month", f"ts >= date_trunc('month', {_NOW})"), ("year", f"ts >= {_NOW} - INTERVAL 365 DAYS"), ("last-year", f"ts >= {_NOW} - INTERVAL 365 DAYS"),
            ("all", "true"), ("all-time", "true"))),
    "telemetry_retained": f"{_LOG} SELECT code_version, count(*) AS calls FROM t WHERE \"timestamp\" IS NULL OR \"timestamp\" >= {_NOW} - INTERVAL 365 DAYS GROUP BY code_version",
    "telemetry_errors_masked": rf"""{_LOG}, h AS (SELECT id, {_HOMELESS} AS m FROM t WHERE outcome = 'error'),
      o AS (SELECT id, replace(replace(replace(replace(m, chr(13) || chr(10), ' '), chr(10), ' '), chr(13), ' '), '|', '\|') AS m FROM h)
      SELECT id, CASE WHEN len(m) <= 500 THEN m WHEN ends_with(substr(m, 1, 500), '\') AND NOT ends_with(substr(m, 1, 500), '\\') THEN substr(m, 1, 499) ELSE substr(m, 1, 500) END AS message FROM o""",
    "telemetry_saved": f"{_LOG} SELECT id, greatest(0, 1000 - est_tokens) AS saved FROM t",
}
