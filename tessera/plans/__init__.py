"""The registered queries: what each operator gives on the driver's tables, with SQL for comparison."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and SQL.
MODULES = ("telemetry", "trees", "records", "graph", "log_stats", "scans", "search", "reports", "snapshots", "events", "extras", "evidence", "edits", "made")


def _gather(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"tessera.plans.{m}"), what)
    return out


def core_queries() -> dict:
    return _gather("QUERIES")


def core_sql() -> dict:
    return _gather("SQL")
