"""Queries over nested records."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import nested
from tessera.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.failed_without_cleanup(nested.rows(table(spark, folder, "preindex_records"), "receipt"))


def _table(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return nested.flat_table(nested.rows(table(spark, folder, "preindex_records"), kind), kind)


QUERIES = {"p2_found": p2_found} | {
    f"p2_{name}": partial(_table, kind=kind)
    for name, kind in (("entries", "entry"), ("receipts", "receipt"), ("cleanups", "cleanup"), ("setup_commands", "command"),
                       ("traces", "trace"), ("test_runs", "tests"), ("tests", "test"), ("steps", "step"), ("missing_outputs", "output"))
}

_ENTRIES = """WITH r AS (SELECT DISTINCT record_id, payload::JSON AS j FROM preindex_records WHERE json_valid(payload)),
e AS (SELECT record_id, '$' AS entry_id, j AS e FROM r WHERE (j->'case_id') IS NOT NULL OR (j->'receipt') IS NOT NULL
  UNION ALL SELECT record_id, 'cases[' || (i - 1) || ']', j->'cases'->(i - 1)::INTEGER FROM r, generate_series(1, coalesce(json_array_length(j->'cases'), 0)::BIGINT) t(i)
  UNION ALL SELECT record_id, 'campaign.groups[' || (g - 1) || '].attempts[' || (a - 1) || ']', j->'campaign'->'groups'->(g - 1)::INTEGER->'attempts'->(a - 1)::INTEGER
    FROM r, generate_series(1, coalesce(json_array_length(j->'campaign'->'groups'), 0)::BIGINT) t(g),
    generate_series(1, coalesce(json_array_length(j->'campaign'->'groups'->(g - 1)::INTEGER->'attempts'), 0)::BIGINT) u(a)),
x AS (SELECT *, CASE WHEN json_type(e->'receipt') = 'VARCHAR' THEN (e->>'receipt')::JSON ELSE e->'receipt' END AS q FROM e),
y AS (SELECT *, q->>'status' AS receipt_status, CASE lower(trim(q->'process_cleanup'->>'complete')) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'false' THEN false WHEN '0' THEN false END AS cleanup_complete,
  e->>'case_id' AS case_id, (e->>'repeat')::BIGINT AS repeat FROM x)"""

_KEYS = "record_id, entry_id, {row} AS row_id, {parent} AS parent_id, {owner} AS owner, case_id, repeat, receipt_status, cleanup_complete"
# the setup commands, each with its place
_COMMANDS = """, c AS (SELECT *, q->'runtime_setup'->(i - 1)::INTEGER AS c, entry_id || '.receipt.runtime_setup[' || (i - 1) || ']' AS spot FROM y, generate_series(1, coalesce(json_array_length(q->'runtime_setup'), 0)::BIGINT) t(i))"""


def _keys(row: str, parent: str, owner: str = "NULL::VARCHAR") -> str:
    return _KEYS.format(row=row, parent=parent, owner=owner)


_CLEANUP = "lower({0}->>'attempted')::BOOLEAN AS attempted, {0}->>'complete' AS complete, {0}->>'signal' AS signal"
_TRACE = "{0}->>'status' AS status, {0}->>'original_sha256' AS original_sha256, {0}->>'redacted_sha256' AS redacted_sha256, ({0}->>'changed')::BOOLEAN AS changed, ({0}->>'original_bytes')::BIGINT AS original_bytes, {0}->>'path' AS path, ({0}->>'raw_retained')::BOOLEAN AS raw_retained"

SQL = {
    "p2_found": f"{_ENTRIES} SELECT DISTINCT record_id, case_id, repeat FROM y WHERE lower(trim(receipt_status)) = 'failed' AND cleanup_complete = false",
    "p2_entries": f"""{_ENTRIES} SELECT record_id, entry_id, entry_id AS row_id, '' AS parent_id, NULL::VARCHAR AS owner, case_id, repeat, receipt_status, cleanup_complete,
      e->>'case_sha256' AS case_sha256, (e->>'schema')::INTEGER AS schema, e->>'created_utc' AS created_utc FROM y""",
    "p2_receipts": f"""{_ENTRIES} SELECT record_id, entry_id, entry_id || '.receipt' AS row_id, entry_id AS parent_id, NULL::VARCHAR AS owner, case_id, repeat, receipt_status, cleanup_complete,
      receipt_status AS status, (q->>'elapsed_seconds')::DOUBLE AS elapsed_seconds, (q->>'exit_status')::BIGINT AS exit_status, (q->>'timed_out')::BOOLEAN AS timed_out,
      q->>'failure' AS failure, q->>'source_digest_before' AS source_digest_before, q->>'source_digest_after' AS source_digest_after FROM y WHERE json_type(q) = 'OBJECT'""",
    "p2_setup_commands": f"""{_ENTRIES} SELECT record_id, entry_id, entry_id || '.receipt.runtime_setup[' || (i - 1) || ']' AS row_id, entry_id || '.receipt' AS parent_id, NULL::VARCHAR AS owner,
      case_id, repeat, receipt_status, cleanup_complete, c->>'command_id' AS command_id, (c->>'elapsed_seconds')::DOUBLE AS elapsed_seconds, (c->>'exit_status')::BIGINT AS exit_status
      FROM (SELECT *, q->'runtime_setup'->(i - 1)::INTEGER AS c FROM y, generate_series(1, coalesce(json_array_length(q->'runtime_setup'), 0)::BIGINT) t(i))""",
    "p2_tests": f"""{_ENTRIES} SELECT record_id, entry_id, entry_id || '.receipt.added_tests.observed_names[' || (i - 1) || ']' AS row_id, entry_id || '.receipt.added_tests' AS parent_id, NULL::VARCHAR AS owner,
      case_id, repeat, receipt_status, cleanup_complete, q->'added_tests'->'observed_names'->>(i - 1)::INTEGER AS name
      FROM y, generate_series(1, coalesce(json_array_length(q->'added_tests'->'observed_names'), 0)::BIGINT) t(i)""",
    "p2_cleanups": f"""{_ENTRIES}{_COMMANDS},
      o AS (SELECT entry_id || '.receipt' AS spot, 'receipt' AS who, q->'process_cleanup' AS k, y.* FROM y UNION ALL SELECT spot, 'command', c->'process_cleanup', c.* EXCLUDE (spot, c, i) FROM c
        UNION ALL SELECT entry_id || '.receipt.added_tests.receipt', 'tests', q->'added_tests'->'receipt'->'process_cleanup', y.* FROM y UNION ALL SELECT entry_id || '.indexing', 'indexing', e->'indexing'->'process_cleanup', y.* FROM y)
      SELECT {_keys("spot || '.process_cleanup'", "spot", "who")}, {_CLEANUP.format("k")} FROM o WHERE json_type(k) = 'OBJECT'""",
    "p2_traces": f"""{_ENTRIES}{_COMMANDS},
      o AS (SELECT entry_id || '.receipt.stdout_redaction' AS spot, entry_id || '.receipt' AS up, 'receipt' AS who, q->'stdout_redaction' AS k, y.* FROM y UNION ALL SELECT entry_id || '.receipt.stderr_redaction', entry_id || '.receipt', 'receipt', q->'stderr_redaction', y.* FROM y
        UNION ALL SELECT spot || '.retained_traces.' || name, spot, 'command', c->'retained_traces'->name, x.* EXCLUDE (spot, c, i, name) FROM (SELECT c.*, unnest(json_keys(c->'retained_traces')) AS name FROM c) x
        UNION ALL SELECT entry_id || '.receipt.retained_traces.' || name, entry_id || '.receipt', 'receipt', q->'retained_traces'->name, x.* EXCLUDE (name) FROM (SELECT y.*, unnest(json_keys(q->'retained_traces')) AS name FROM y) x)
      SELECT {_keys("spot", "up", "who")}, {_TRACE.format("k")} FROM o WHERE json_type(k) = 'OBJECT'""",
    "p2_test_runs": f"{_ENTRIES} SELECT {_keys("entry_id || '.receipt.added_tests'", "entry_id || '.receipt'")}, (q->'added_tests'->>'executed')::BOOLEAN AS executed FROM y WHERE json_type(q->'added_tests') = 'OBJECT'",
    "p2_steps": f"""{_ENTRIES}, o AS (SELECT entry_id || '.indexing' AS spot, entry_id AS up, 'indexing' AS who, e->'indexing' AS k, y.* FROM y
        UNION ALL SELECT entry_id || '.receipt.added_tests.receipt', entry_id || '.receipt.added_tests', 'tests', q->'added_tests'->'receipt', y.* FROM y)
      SELECT {_keys("spot", "up", "who")}, k->>'status' AS status FROM o WHERE json_type(k) = 'OBJECT'""",
    "p2_missing_outputs": f"""{_ENTRIES}{_COMMANDS} SELECT {_keys("spot || '.expected_output_missing[' || (m - 1) || ']'", "spot", "'command'")}, c->'expected_output_missing'->>(m - 1)::INTEGER AS name
      FROM c, generate_series(1, coalesce(json_array_length(c->'expected_output_missing'), 0)::BIGINT) u(m)""",
}
