"""Walk queries over the code facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import walk
from tessera.plans import facts


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return facts.resolved(spark, folder)


def call_graph(spark, folder):
    """Who calls whom: the edges of all walks. The first query to ask for them derives the facts that all code queries share."""
    return _edges(spark, folder)


def _seeds(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("seed")).distinct()


def impact_walk(spark, folder):
    """All symbols that are called, depth 2."""
    e = _edges(spark, folder)
    return walk.impact(e, facts.symbols(spark, folder), _seeds(e))


def impact_flags(spark, folder):
    """Every twentieth symbol that is called, by the number in its id."""
    e = _edges(spark, folder)
    seeds = _seeds(e).where(F.conv(F.substring("seed", 1, 8), 16, 10).cast("bigint") % 20 == 0)
    return walk.impact_flags(e, facts.symbols(spark, folder), seeds, limit=3)


def impact_open_ends(spark, folder):
    e = _edges(spark, folder)
    return walk.open_ends(e, walk.reach(e, _seeds(e), 2))


def impact_by_file(spark, folder):
    """Files as seeds: all symbols of a file; least depth of each caller in another file."""
    e, s = _edges(spark, folder), facts.symbols(spark, folder)
    found = walk.reach(e, _seeds(e), 2)
    of = s.select(F.col("symbol_id").alias("seed"), F.col("file_id").alias("seed_file"))
    node = s.select(F.col("symbol_id").alias("node"), F.col("file_id").alias("node_file"))
    j = found.join(of, "seed").join(node, "node").where("seed_file <> node_file")
    return j.groupBy("seed_file", "node").agg(F.min("depth").alias("depth"))


def ancestor_chain(spark, folder):
    """Chains of all symbols, also through parents of another or no language."""
    return walk.ancestors(facts.symbols(spark, folder))


def visible_symbols(spark, folder):
    s = facts.symbols(spark, folder)
    hidden = walk.hidden_symbols(s, walk.ancestors(s))
    return s.join(hidden, "symbol_id", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


def local_variables(spark, folder):
    return walk.local_variables(facts.symbols(spark, folder))


def merged_walks(spark, folder):
    e = _edges(spark, folder)
    seeds = _seeds(e)
    return walk.merge_depths(walk.reach(e, seeds, 1), walk.reach(e, seeds, 2), ["seed", "node"])


QUERIES = {f.__name__: f for f in (call_graph, impact_walk, impact_flags, impact_open_ends, impact_by_file, ancestor_chain, visible_symbols, local_variables, merged_walks)}

_E = facts.EDGES_SQL
_WALK = f"""WITH RECURSIVE {_E}, g AS (SELECT DISTINCT from_symbol_id AS src, to_symbol_id AS dst FROM e WHERE to_symbol_id IS NOT NULL),
w AS (SELECT DISTINCT dst AS seed, dst AS node, 0 AS depth FROM g UNION SELECT w.seed, g.src, w.depth + 1 FROM w JOIN g ON g.dst = w.node WHERE w.depth < 5),
best AS (SELECT seed, node, min(depth) AS depth FROM w WHERE seed <> node GROUP BY ALL)"""
_UP = f"""WITH RECURSIVE {facts.SYMBOLS_SQL}, up AS (SELECT a.symbol_id, b.symbol_id AS ancestor_id, 1 AS depth FROM s a JOIN s b ON a.parent_symbol_id = b.symbol_id
  UNION ALL SELECT u.symbol_id, p.symbol_id, u.depth + 1 FROM up u JOIN s c ON c.symbol_id = u.ancestor_id JOIN s p ON p.symbol_id = c.parent_symbol_id WHERE u.depth < 31 AND u.symbol_id <> u.ancestor_id)"""

SQL = {
    "call_graph": f"WITH {_E} SELECT DISTINCT from_symbol_id AS src, to_symbol_id AS dst FROM e WHERE to_symbol_id IS NOT NULL",
    "impact_walk": f"""{_WALK}, r AS (SELECT b.seed, s.symbol_id, s.name, s.kind, s.path, s.start_line, b.depth, coalesce(s.is_test, false) AS is_test FROM best b JOIN s ON s.symbol_id = b.node WHERE b.depth <= 2),
      q AS (SELECT *, row_number() OVER (PARTITION BY seed, is_test ORDER BY depth, path NULLS FIRST, start_line NULLS FIRST, symbol_id)::INTEGER AS place
        FROM r WHERE is_test OR kind NOT IN ('import', 'field', 'property', 'variable', 'parameter', 'module', 'namespace'))
      SELECT seed, symbol_id, name, kind, path, start_line, depth, is_test, CASE WHEN depth = 1 THEN 'direct caller' ELSE 'indirect caller [depth ' || depth || ']' END AS reason, place FROM q WHERE place <= 200""",
    "impact_flags": f"""{_WALK}, r AS (SELECT b.*, coalesce(s.is_test, false) AS t FROM best b JOIN s ON s.symbol_id = b.node WHERE ('0x' || substr(b.seed, 1, 8))::BIGINT % 20 = 0),
      a AS (SELECT seed, count(*) FILTER (depth <= 2 AND NOT t) AS impacted, count(*) FILTER (depth <= 2 AND t) AS tests, count(*) FILTER (depth > 2) AS beyond, count(*) FILTER (depth > 2 AND t) AS tests_past_depth FROM r GROUP BY seed)
      SELECT seed, impacted, tests, impacted > 3 AS impacted_truncated, tests > 3 AS tests_truncated, impacted + tests > 200 AS ceiling_reached,
        CASE WHEN beyond > 0 THEN 2 END AS stopped_at_depth, tests_past_depth FROM a""",
    "impact_open_ends": f"{_WALK} SELECT seed, node FROM best WHERE depth <= 2 AND node NOT IN (SELECT dst FROM g)",
    "impact_by_file": f"""{_WALK} SELECT a.file_id AS seed_file, b.node, min(b.depth) AS depth FROM best b JOIN s a ON a.symbol_id = b.seed JOIN s c ON c.symbol_id = b.node
      WHERE b.depth <= 2 AND a.file_id <> c.file_id GROUP BY ALL""",
    "ancestor_chain": f"{_UP} SELECT symbol_id, ancestor_id, depth FROM up",
    "visible_symbols": f"""{_UP}, low AS (SELECT symbol_id FROM s WHERE lower(visibility) IN ('private', 'protected', 'fileprivate')),
      hid AS (SELECT symbol_id FROM low UNION SELECT symbol_id FROM up WHERE ancestor_id IN (SELECT symbol_id FROM low))
      SELECT kind, count(*) AS n FROM s WHERE symbol_id NOT IN (SELECT symbol_id FROM hid) GROUP BY kind""",
    "local_variables": f"""WITH RECURSIVE {facts.SYMBOLS_SQL}, v AS (SELECT symbol_id, parent_symbol_id AS at, 1 AS d FROM s WHERE kind = 'variable' AND parent_symbol_id IS NOT NULL
      UNION ALL SELECT v.symbol_id, p.parent_symbol_id, d + 1 FROM v JOIN s p ON p.symbol_id = v.at WHERE p.kind = 'variable' AND p.parent_symbol_id IS NOT NULL AND p.parent_symbol_id <> v.symbol_id AND d < 1000)
      SELECT DISTINCT v.symbol_id FROM v JOIN s p ON p.symbol_id = v.at WHERE p.kind IN ('function', 'method', 'constructor')""",
    "merged_walks": f"{_WALK} SELECT seed, node, depth FROM best WHERE depth <= 2",
}
