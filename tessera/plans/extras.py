"""Further code queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import diff, imports, report, scan, walk
from tessera.plans import facts, reports, snapshots
from tessera.session import cut
from tessera.sources.tables import table


def import_graph(spark, f):
    return imports.import_edges(imports.imported_stems(facts.lines(spark, f)), facts.files(spark, f).where("path IS NOT NULL"))


def import_closure(spark, f):
    e = cut(import_graph(spark, f), "imports")
    return imports.follow_imports(e, e.select(F.col("src").alias("seed")).distinct())


def part_hierarchy(spark, f):
    """A graph with circles over parts: p -> (13 p + 7) mod n and (31 p + 11) mod n, walked up from every twentieth."""
    n = table(spark, f, "part").count()
    p = table(spark, f, "part").select(F.col("p_partkey").alias("p"))
    e = p.select(F.col("p").alias("src"), ((F.col("p") * 13 + 7) % n).alias("dst")).unionByName(p.select(F.col("p").alias("src"), ((F.col("p") * 31 + 11) % n).alias("dst")))
    return imports.hierarchy(e, p.where("p % 20 = 0").select(F.col("p").alias("seed")), 5, 50)


def related_types(spark, f):
    return imports.related_types(facts.symbols(spark, f))


def placed_sites(spark, f):
    return report.place_sites(reports._judged(spark, f).drop("fam"), snapshots._hunks(spark, f))


def blocking_sites(spark, f):
    return report.blocking(placed_sites(spark, f))


def unique_bodies(spark, f):
    s = facts.symbols(spark, f)
    return report.unique_bodies(s, scan.symbol_text(s, table(spark, f, "source_texts"))).select("name", "symbol_id", F.md5("text").alias("digest"))


def text_snippets(spark, f):
    return report.snippets(scan.symbol_text(facts.symbols(spark, f), table(spark, f, "source_texts")), "batch")


def call_receivers(spark, f):
    return report.receivers(facts.lines(spark, f))


def variant_uses(spark, f):
    """Callables of one container as its variants."""
    s = facts.symbols(spark, f)
    v = s.where("kind = 'method' AND parent_symbol_id IS NOT NULL AND name IS NOT NULL").select(F.col("parent_symbol_id").alias("owner"), "name").distinct()
    return report.variants_used(facts.identifiers(spark, f), v)


def all_name_rows(spark, f):
    return report.name_rows(facts.symbols(spark, f), facts.identifiers(spark, f)).groupBy("name", "source").agg(F.count("*").alias("n"))


def most_used_symbols(spark, f):
    s = facts.symbols(spark, f).where("kind IN ('function', 'method') AND name IS NOT NULL")
    return report.most_used(s, reports.name_uses(spark, f))


def file_sizes(spark, f):
    """Bytes of the files that hold tests."""
    s = facts.symbols(spark, f).where("is_test").select("file_id").distinct()
    return facts.files(spark, f).join(s, "file_id", "left_semi").agg(F.count("*").alias("files"), F.coalesce(F.sum("content_bytes"), F.lit(0)).alias("bytes"))


def callers(spark, f):
    return report.caller_rows(reports._judged(spark, f), facts.identifiers(spark, f))


def impact_of_hunks(spark, f):
    """The walk from the innermost symbols of changed lines."""
    s = facts.symbols(spark, f)
    e = facts.resolved(spark, f)
    seeds = diff.touched(s.where("path IS NOT NULL"), snapshots._hunks(spark, f)).where("symbol_id IS NOT NULL").select(F.col("symbol_id").alias("seed")).distinct()
    return walk.impact(e, s, seeds).select("seed", "symbol_id", "depth", "is_test", "place")


QUERIES = {f.__name__: f for f in (import_graph, import_closure, part_hierarchy, related_types, placed_sites, blocking_sites, unique_bodies, text_snippets, call_receivers, variant_uses, all_name_rows, most_used_symbols, file_sizes, callers, impact_of_hunks)}

_PROJECT = "regexp_extract({0}, '^(monorepo/[^/]+|[^/]+)', 1)"
_IMPORT_EDGES = rf"""im AS (SELECT DISTINCT path, lower(coalesce(nullif(regexp_extract(text, '^\s*import\s.*from\s+[''"][^''"]*?([A-Za-z0-9_]+)[''"]', 1), ''), nullif(regexp_extract(text, '^\s*#include\s+"(?:[^"]*/)?([A-Za-z0-9_]+)\.\w+"', 1), ''),
  nullif(regexp_extract(text, '^\s*(?:import|use|using)\s+(?:[\w.:]*[.:])?([A-Za-z0-9_]+);?\s*$', 1), ''))) AS stem FROM l),
ie AS (SELECT DISTINCT im.path AS src, f.path AS dst FROM im JOIN f ON {_PROJECT.format("im.path")} = {_PROJECT.format("f.path")} AND im.stem = lower(regexp_extract(f.path, '([^/.]*)[^/]*$', 1)) WHERE im.path <> f.path AND im.stem IS NOT NULL)"""
_IMPORTS = f"{facts.FILES_SQL}, {facts.LINES_SQL}, {_IMPORT_EDGES}"
_TEXTS = r"""tx AS (SELECT file_id, max(content) AS content FROM source_texts GROUP BY file_id),
st AS (SELECT s.symbol_id, CASE WHEN start_byte IS NOT NULL AND end_byte IS NOT NULL THEN decode(array_slice(encode(content), start_byte + 1, end_byte))
  ELSE array_to_string(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))[start_line:end_line], chr(10)) END AS text FROM s JOIN tx USING (file_id))"""
_PLACED = f"""{reports._V}, {snapshots._H}, pl AS (SELECT v.*, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.path = v.path AND v.line BETWEEN h.start_line AND h.start_line + 9) THEN 'in_diff' ELSE label END AS place FROM v)"""
SQL = {
    "import_graph": f"WITH {_IMPORTS} SELECT src, dst FROM ie",
    "import_closure": f"""WITH RECURSIVE {_IMPORTS}, w AS (SELECT DISTINCT src AS seed, src AS node, 0 AS depth FROM ie UNION SELECT w.seed, ie.dst, w.depth + 1 FROM w JOIN ie ON ie.src = w.node WHERE w.depth < 4),
      b AS (SELECT seed, node, min(depth) AS depth FROM w WHERE seed <> node GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS rn FROM b) SELECT seed, node, depth FROM r WHERE rn <= 64""",
    "part_hierarchy": """WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), e AS (SELECT p_partkey AS src, (p_partkey * 13 + 7) % n AS dst FROM part, n UNION SELECT p_partkey, (p_partkey * 31 + 11) % n FROM part, n),
      w AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS depth FROM part WHERE p_partkey % 20 = 0 UNION SELECT w.seed, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 5),
      b AS (SELECT seed, node, min(depth) AS depth FROM w WHERE seed <> node GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS rn FROM b) SELECT seed, node, depth FROM r WHERE rn <= 50""",
    "related_types": rf"""WITH {facts.SYMBOLS_SQL}, t AS (SELECT name, min(symbol_id) AS type_id FROM s WHERE kind IN ('class', 'struct', 'interface', 'trait', 'record', 'enum') AND name IS NOT NULL GROUP BY name HAVING count(*) = 1),
      x AS (SELECT DISTINCT symbol_id, unnest(regexp_extract_all(signature, '\b([A-Z]\w*)\b', 1)) AS name FROM s WHERE kind IN ('function', 'method', 'constructor')) SELECT DISTINCT symbol_id, type_id FROM x JOIN t USING (name)""",
    "placed_sites": f"WITH {_PLACED} SELECT path, line, file_id, name, label, basis, target, place FROM pl",
    "blocking_sites": f"WITH {_PLACED}, r AS (SELECT target, path, line, row_number() OVER (PARTITION BY target ORDER BY path, line, name)::INTEGER AS rn FROM pl WHERE place = 'proven' AND target IS NOT NULL) SELECT * FROM r WHERE rn <= 15",
    "unique_bodies": f"""WITH {facts.SYMBOLS_SQL}, {_TEXTS}, o AS (SELECT name, min(symbol_id) AS symbol_id FROM s WHERE kind IN ('function', 'method', 'constructor') AND name IS NOT NULL GROUP BY name HAVING count(*) = 1)
      SELECT name, symbol_id, md5(text) AS digest FROM o JOIN st USING (symbol_id) WHERE len(text) <= 8000""",
    "text_snippets": f"""WITH {facts.SYMBOLS_SQL}, {_TEXTS}, a AS (SELECT symbol_id, text, strpos(lower(text), 'batch') AS p FROM st) SELECT symbol_id, substr(text, greatest(1, p - 20), p - greatest(1, p - 20) + 25) AS snippet FROM a WHERE p > 0""",
    "call_receivers": rf"""WITH {facts.LINES_SQL}, x AS (SELECT path, line, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS receiver, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)\(', 2)) AS name FROM l)
      SELECT path, line, receiver, name, count(*) AS uses FROM x GROUP BY ALL""",
    "variant_uses": f"""WITH {facts.IDENTIFIERS_SQL}, v AS (SELECT min(parent_symbol_id) AS owner, name FROM s WHERE kind = 'method' AND parent_symbol_id IS NOT NULL AND name IS NOT NULL GROUP BY name HAVING count(DISTINCT parent_symbol_id) = 1)
      SELECT owner, containing_symbol_id, count(DISTINCT name) AS variants, min(line) AS first_line FROM i JOIN v USING (name) WHERE containing_symbol_id IS NOT NULL GROUP BY ALL""",
    "all_name_rows": f"""WITH {facts.IDENTIFIERS_SQL}, x AS (SELECT name, 'definition' AS source FROM s WHERE name IS NOT NULL AND path IS NOT NULL UNION ALL SELECT name, 'use' FROM i) SELECT name, source, count(*) AS n FROM x GROUP BY ALL""",
    "most_used_symbols": f"""WITH {facts.IDENTIFIERS_SQL}, nu AS (SELECT name, sum(uses)::BIGINT AS uses FROM i GROUP BY name) SELECT symbol_id, name, path, coalesce(uses, 0) AS uses FROM s LEFT JOIN nu USING (name)
      WHERE kind IN ('function', 'method') AND name IS NOT NULL ORDER BY coalesce(uses, 0) DESC, path NULLS FIRST, symbol_id LIMIT 30""",
    "callers": f"""WITH {reports._V}, j AS (SELECT v.*, i.containing_symbol_id AS caller, {reports._RANK} AS r FROM v JOIN i USING (file_id, line, name) WHERE target IS NOT NULL AND containing_symbol_id IS NOT NULL)
      SELECT target, caller, count(*) AS sites, min(line) AS first_line, arg_min(label, r) AS surest FROM j GROUP BY ALL""",
    "impact_of_hunks": f"""WITH RECURSIVE {facts.EDGES_SQL}, {snapshots._H}, {snapshots._TOUCHED}, g AS (SELECT DISTINCT from_symbol_id AS src, to_symbol_id AS dst FROM e WHERE to_symbol_id IS NOT NULL),
      w AS (SELECT DISTINCT symbol_id AS seed, symbol_id AS node, 0 AS depth FROM th WHERE symbol_id IS NOT NULL UNION SELECT w.seed, g.src, w.depth + 1 FROM w JOIN g ON g.dst = w.node WHERE w.depth < 2),
      best AS (SELECT seed, node, min(depth) AS depth FROM w WHERE seed <> node GROUP BY ALL),
      r AS (SELECT best.seed, s.symbol_id, s.path, s.start_line, s.kind, best.depth, coalesce(s.is_test, false) AS is_test FROM best JOIN s ON s.symbol_id = best.node),
      q AS (SELECT seed, symbol_id, depth, is_test, row_number() OVER (PARTITION BY seed, is_test ORDER BY depth, path NULLS FIRST, start_line NULLS FIRST, symbol_id)::INTEGER AS place FROM r
        WHERE is_test OR kind NOT IN ('import', 'field', 'property', 'variable', 'parameter', 'module', 'namespace')) SELECT * FROM q WHERE place <= 200""",
    "file_sizes": f"WITH {facts.SYMBOLS_SQL} SELECT count(*) AS files, coalesce(sum(content_bytes), 0)::BIGINT AS bytes FROM f WHERE file_id IN (SELECT file_id FROM s WHERE is_test)",
}
