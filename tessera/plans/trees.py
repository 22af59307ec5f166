"""Queries over parent links, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import hierarchy
from tessera.sources.tables import table


def p7_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, folder, "symbols")).drop("component")


def p7_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, folder, "symbols")))


def p7_cycle_links(spark: SparkSession, folder: str) -> DataFrame:
    t = hierarchy.hierarchy(table(spark, folder, "symbols"))
    return t.where("on_cycle").select("symbol_id", "cycle_symbol_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    t = hierarchy.hierarchy(table(spark, folder, "symbols"))
    return t.where(F.col("cycle_symbol_id").isNotNull()).select("symbol_id", "cycle_symbol_id")


QUERIES = {f.__name__: f for f in (p7_found, p7_hierarchy, p7_descendants, p7_cycle_links)}

_WALK = """WITH RECURSIVE nodes AS (SELECT symbol_id AS id, max(CASE WHEN trim(parent_symbol_id) <> '' THEN parent_symbol_id END) AS p FROM symbols GROUP BY symbol_id),
links AS (SELECT a.id, b.id AS p FROM nodes a LEFT JOIN nodes b ON a.p = b.id),
walk AS (SELECT id, p AS nxt, [id] AS trail FROM links
  UNION ALL SELECT w.id, l.p, list_append(w.trail, w.nxt) FROM walk w JOIN links l ON l.id = w.nxt WHERE NOT list_contains(w.trail, w.nxt)),
ends AS (SELECT id, nxt, trail FROM walk WHERE nxt IS NULL OR list_contains(trail, nxt)),
found AS (SELECT id, trail, nxt, CASE WHEN nxt IS NOT NULL THEN list_min(trail[list_position(trail, nxt):]) END AS circle,
  coalesce(nxt = id, false) AS on_circle FROM ends)"""
_PAIRS = """, up AS (SELECT id, unnest(trail) AS anc, generate_subscripts(trail, 1) - 1 AS distance FROM found WHERE nxt IS NULL)"""

SQL = {
    "p7_found": f"{_WALK} SELECT id AS symbol_id, circle AS cycle_symbol_id FROM found WHERE circle IS NOT NULL",
    "p7_hierarchy": f"""{_WALK}{_PAIRS}, n AS (SELECT anc, count(*) - 1 AS n FROM up GROUP BY anc)
      SELECT id AS symbol_id, CASE WHEN circle IS NULL THEN trail[-1] END AS root_symbol_id, CASE WHEN circle IS NULL THEN len(trail)::INTEGER - 1 END AS depth,
      CASE WHEN circle IS NULL THEN list_reverse(trail) END AS chain, n.n AS descendants, circle AS cycle_symbol_id, on_circle AS on_cycle
      FROM found LEFT JOIN n ON n.anc = found.id""",
    "p7_descendants": f"{_WALK}{_PAIRS} SELECT anc AS symbol_id, id AS descendant_id, distance::INTEGER AS distance FROM up WHERE distance > 0",
    "p7_cycle_links": f"{_WALK} SELECT id AS symbol_id, circle AS cycle_symbol_id FROM found WHERE on_circle",
}
