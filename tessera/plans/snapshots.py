"""Snapshot comparison on two cuts of the symbols, with its SQL: the base lacks every tenth symbol (by the number in its id),
the current one every seventh; every fifth has another signature in the current one, every third of those lacking in the base
another name."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.names import CALLABLE
from tessera.operators import diff, walk
from tessera.plans import facts
from tessera.session import cut
from tessera.sources.tables import table


def _sides(spark, f):
    s = facts.symbols(spark, f).withColumn("no", F.conv(F.substring("symbol_id", 1, 8), 16, 10).cast("bigint"))
    base = diff.keyed(s.where("no % 10 <> 0"))
    changed = F.when(F.col("no") % 5 == 0, F.concat(F.coalesce("signature", F.lit("")), F.lit("(extra)"))).otherwise(F.col("signature"))
    renamed = F.when(F.col("no") % 11 == 0, F.concat("name", F.lit("_renamed"))).otherwise(F.col("name"))
    moved = F.when(F.col("no") % 13 == 0, F.concat("path", F.lit(".moved"))).otherwise(F.col("path"))
    cur = diff.keyed(s.where("no % 7 <> 0").withColumn("signature", changed).withColumn("name", renamed).withColumn("path", moved))
    return base, cur


def snapshot_pairs(spark, f):
    return diff.pair(*_sides(spark, f))


def snapshot_renames(spark, f):
    b, c = _sides(spark, f)
    return diff.renames(b, c, diff.pair(b, c))


def snapshot_moves(spark, f):
    b, c = _sides(spark, f)
    return diff.moves(b, c, diff.pair(b, c))


def snapshot_changes(spark, f):
    b, c = _sides(spark, f)
    return diff.changes(b, c, diff.pair(b, c))


def snapshot_members(spark, f):
    return diff.member_changes(*_sides(spark, f))


def _hunks(spark, f):
    """Ten-line hunks, every 40 lines."""
    h = facts.files(spark, f).where("path IS NOT NULL AND line_count >= 1").select("path", F.explode(F.sequence(F.lit(5), F.greatest(F.col("line_count"), F.lit(5)), F.lit(40))).alias("start_line"))
    return h.select("path", F.col("start_line").cast("int").alias("start_line"), (F.col("start_line") + 9).cast("int").alias("end_line"))


def hunk_symbols(spark, f):
    return diff.touched(facts.symbols(spark, f).where("path IS NOT NULL"), _hunks(spark, f))


def symbol_hunks(spark, f):
    return diff.overlapping(facts.symbols(spark, f).where("path IS NOT NULL"), _hunks(spark, f))


def tests_to_run(spark, f):
    """Tests of the changed callables: direct callers, then what a walk of depth 4 finds."""
    s = facts.symbols(spark, f)
    e = facts.resolved(spark, f)
    changed = s.where((F.conv(F.substring("symbol_id", 1, 8), 16, 10).cast("bigint") % 5 == 0) & F.col("kind").isin(*CALLABLE)).select(F.col("symbol_id").alias("seed"))
    t = s.where(F.coalesce("is_test", F.lit(False))).select(F.col("symbol_id").alias("node"))
    found = walk.reach(e, changed, 4).join(t, "node").select(F.col("seed").alias("change"), F.col("node").alias("test_id"), "depth")
    return diff.tests_to_run(found.where("depth = 1").drop("depth"), found.where("depth > 1").drop("depth"))


def corpus_digest(spark, f):
    t = table(spark, f, "source_texts").groupBy("path").agg(F.max("content").alias("content"))
    return diff.content_digest(t)


QUERIES = {f.__name__: f for f in (snapshot_pairs, snapshot_renames, snapshot_moves, snapshot_changes, snapshot_members, hunk_symbols, symbol_hunks, tests_to_run, corpus_digest)}

_NO = "('0x' || substr(symbol_id, 1, 8))::BIGINT"
_TAIL = r"regexp_replace(regexp_replace(coalesce(signature, ''), '^[^(]*', ''), '\s+', '', 'g')"
_KEY = "path, owner, kind, name"


def _pair_sql() -> str:
    return f"""{facts.SYMBOLS_SQL}, n0 AS (SELECT *, {_NO} AS no FROM s),
b00 AS (SELECT * FROM n0 WHERE no % 10 <> 0),
c00 AS (SELECT * REPLACE (CASE WHEN no % 5 = 0 THEN coalesce(signature, '') || '(extra)' ELSE signature END AS signature, CASE WHEN no % 11 = 0 THEN name || '_renamed' ELSE name END AS name,
  CASE WHEN no % 13 = 0 THEN path || '.moved' ELSE path END AS path) FROM n0 WHERE no % 7 <> 0),
bb AS (SELECT b00.*, coalesce(p.name, '') AS owner FROM b00 LEFT JOIN b00 p ON p.symbol_id = b00.parent_symbol_id),
cc AS (SELECT c00.*, coalesce(p.name, '') AS owner FROM c00 LEFT JOIN c00 p ON p.symbol_id = c00.parent_symbol_id),
bs AS (SELECT coalesce(path, '') AS path, owner, coalesce(kind, '') AS kind, coalesce(name, '') AS name, symbol_id, {_TAIL} AS tail, row_number() OVER (PARTITION BY {_KEY} ORDER BY start_line NULLS FIRST, start_byte NULLS FIRST, symbol_id) AS rn, count(*) OVER (PARTITION BY {_KEY}) AS n FROM bb),
cs AS (SELECT coalesce(path, '') AS path, owner, coalesce(kind, '') AS kind, coalesce(name, '') AS name, symbol_id, {_TAIL} AS tail, row_number() OVER (PARTITION BY {_KEY} ORDER BY start_line NULLS FIRST, start_byte NULLS FIRST, symbol_id) AS rn, count(*) OVER (PARTITION BY {_KEY}) AS n FROM cc),
eq AS (SELECT DISTINCT {_KEY} FROM bs JOIN (SELECT DISTINCT {_KEY}, n FROM cs) USING ({_KEY}, n)),
even AS (SELECT b.symbol_id AS base_id, c.symbol_id AS current_id FROM bs b JOIN cs c USING ({_KEY}, rn) JOIN eq USING ({_KEY})),
ub AS (SELECT *, row_number() OVER (PARTITION BY {_KEY}, tail ORDER BY rn) AS k FROM bs ANTI JOIN eq USING ({_KEY})), uc AS (SELECT *, row_number() OVER (PARTITION BY {_KEY}, tail ORDER BY rn) AS k FROM cs ANTI JOIN eq USING ({_KEY})),
tt AS (SELECT b.symbol_id AS base_id, c.symbol_id AS current_id FROM ub b JOIN uc c USING ({_KEY}, tail, k)),
lb AS (SELECT {_KEY}, symbol_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY rn) AS k FROM ub WHERE symbol_id NOT IN (SELECT base_id FROM tt)), lc AS (SELECT {_KEY}, symbol_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY rn) AS k FROM uc WHERE symbol_id NOT IN (SELECT current_id FROM tt)),
pr AS (SELECT * FROM even UNION ALL SELECT * FROM tt UNION ALL SELECT b.symbol_id, c.symbol_id FROM lb b FULL JOIN lc c USING ({_KEY}, k))"""


def _alone(keys: str) -> str:
    one = "SELECT {0}, min(symbol_id) AS id, min(path) AS pth FROM {1} WHERE symbol_id IN (SELECT {2} FROM pr WHERE {3} IS NULL) AND body_hash <> '' GROUP BY {0} HAVING count(*) = 1"
    return f"x1 AS ({one.format(keys, 'bb', 'base_id', 'current_id')}), x2 AS ({one.format(keys, 'cc', 'current_id', 'base_id')})"


# the innermost symbol of each line of each hunk
_TOUCHED = """hl AS (SELECT DISTINCT path, unnest(generate_series(start_line, start_line + 9))::INTEGER AS line FROM h),
th AS (SELECT hl.path, hl.line, r.symbol_id FROM hl LEFT JOIN (SELECT hl.path, hl.line, s.symbol_id, row_number() OVER (PARTITION BY hl.path, hl.line ORDER BY s.end_line - s.start_line, s.symbol_id) AS rn
  FROM hl JOIN s ON s.path = hl.path AND hl.line BETWEEN s.start_line AND s.end_line) r ON r.path = hl.path AND r.line = hl.line AND rn = 1)"""
_H = "h AS (SELECT path, unnest(generate_series(5, greatest(line_count, 5), 40))::INTEGER AS start_line FROM f WHERE path IS NOT NULL AND line_count >= 1)"
SQL = {
    "snapshot_pairs": f"WITH {_pair_sql()} SELECT * FROM pr",
    "snapshot_renames": f"WITH {_pair_sql()}, {_alone('path, owner, kind, body_hash')} SELECT x1.id AS base_id, x2.id AS current_id FROM x1 JOIN x2 USING (path, owner, kind, body_hash)",
    "snapshot_moves": f"WITH {_pair_sql()}, {_alone('kind, name, owner, body_hash')} SELECT x1.id AS base_id, x2.id AS current_id FROM x1 JOIN x2 USING (kind, name, owner, body_hash) WHERE x1.pth <> x2.pth",
    "snapshot_changes": f"""WITH {_pair_sql()}, j AS (SELECT base_id, current_id, CASE WHEN {_TAIL.replace('signature', 'b.signature')} <> {_TAIL.replace('signature', 'c.signature')} THEN 'signature' WHEN b.visibility IS DISTINCT FROM c.visibility THEN 'visibility'
      WHEN b.body_hash IS DISTINCT FROM c.body_hash THEN 'body' END AS change FROM pr JOIN bb b ON b.symbol_id = base_id JOIN cc c ON c.symbol_id = current_id) SELECT * FROM j WHERE change IS NOT NULL""",
    "snapshot_members": f"""WITH {_pair_sql()}, m1 AS (SELECT path, owner, list_distinct(list(name)) AS b FROM bb WHERE kind IN ('field', 'property', 'enum_member') AND owner <> '' AND path IS NOT NULL GROUP BY ALL), m2 AS (SELECT path, owner, list_distinct(list(name)) AS c FROM cc WHERE kind IN ('field', 'property', 'enum_member') AND owner <> '' AND path IS NOT NULL GROUP BY ALL),
      o AS (SELECT path, owner, array_to_string(list_sort(list_filter(coalesce(c, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS added, array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(c, []), x))), ',') AS removed FROM m1 FULL JOIN m2 USING (path, owner))
      SELECT * FROM o WHERE added <> '' OR removed <> ''""",
    "hunk_symbols": f"WITH {facts.SYMBOLS_SQL}, {_H}, {_TOUCHED} SELECT path, line, symbol_id FROM th",
    "symbol_hunks": f"WITH {facts.SYMBOLS_SQL}, {_H} SELECT s.symbol_id, count(*) AS hunks FROM s JOIN h ON h.path = s.path AND h.start_line <= s.end_line AND s.start_line <= h.start_line + 9 GROUP BY ALL",
    "tests_to_run": f"""WITH RECURSIVE {facts.EDGES_SQL}, g AS (SELECT DISTINCT from_symbol_id AS src, to_symbol_id AS dst FROM e WHERE to_symbol_id IS NOT NULL),
      ch AS (SELECT symbol_id FROM s WHERE {_NO} % 5 = 0 AND kind IN ('function', 'method', 'constructor')), w AS (SELECT symbol_id AS seed, symbol_id AS node, 0 AS depth FROM ch UNION SELECT w.seed, g.src, depth + 1 FROM w JOIN g ON g.dst = w.node WHERE depth < 4),
      fd AS (SELECT seed, node, min(depth) AS depth FROM w WHERE seed <> node AND node IN (SELECT symbol_id FROM s WHERE is_test) GROUP BY ALL),
      dr AS (SELECT node AS test_id, min(turn) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY node) AS turn FROM fd WHERE depth = 1) GROUP BY node),
      al AS (SELECT test_id, 'direct' AS why, 0 AS g, turn FROM dr UNION ALL SELECT DISTINCT node, 'walked', 1, 0 FROM fd WHERE depth > 1 AND node NOT IN (SELECT test_id FROM dr))
      SELECT test_id, why FROM al ORDER BY g, turn, test_id LIMIT 50""",
    "corpus_digest": """WITH t AS (SELECT path, max(content) AS content FROM source_texts GROUP BY path), o AS (SELECT sha256(path) AS p, sha256(sha256(path) || sha256(coalesce(content, ''))) AS h FROM t),
      a AS (SELECT substr(p, 1, 6) AS p, sha256(string_agg(h, '' ORDER BY p, h)) AS h FROM o GROUP BY ALL), b AS (SELECT substr(p, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY p, h)) AS h FROM a GROUP BY ALL) SELECT sha256(string_agg(h, '' ORDER BY p, h)) AS digest FROM b""",
}
