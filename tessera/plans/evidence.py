"""Evidence for calls, with its SQL: the SQL judges each pair of a call and a definition of its name by one CASE."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.names import TYPES
from tessera.operators import evidence, imports, report, walk
from tessera.plans import extras, facts, reports
from tessera.session import once

_SOURCES = ("symbols", "files", "source_texts")


def _around(spark, f):
    return once(spark, f, "scopes", _SOURCES, lambda: evidence.scopes(walk.ancestors(facts.symbols(spark, f)), facts.symbols(spark, f)))


def _above(spark, f):
    s = facts.symbols(spark, f)
    types = s.where(F.col("kind").isin(*TYPES) & F.col("name").isNotNull()).select("symbol_id", "name")
    edges, pending = imports.type_edges(s), imports.pending_type_edges(s)
    return once(spark, f, "above", _SOURCES, lambda: evidence.ancestor_names(edges, pending, types))


def _typed(spark, f):
    return evidence.receiver_types(facts.calls(spark, f), _around(spark, f), facts.variables(spark, f))


def _imports(spark, f):
    return once(spark, f, "imports", ("source_texts", "files"), lambda: extras.import_graph(spark, f)).select(F.col("src").alias("path"), F.col("dst").alias("imported"))


def call_claims(spark, f):
    claims = lambda: evidence.claims(facts.calls(spark, f), facts.symbols(spark, f), _around(spark, f), _above(spark, f), _typed(spark, f), _imports(spark, f))
    return once(spark, f, "claims", _SOURCES, claims)


def call_verdicts(spark, f):
    return evidence.decide(facts.calls(spark, f), facts.symbols(spark, f), call_claims(spark, f), _typed(spark, f))


def call_verdicts_by_count(spark, f):
    """The verdicts, with calls excluded whose arguments no definition takes."""
    s = facts.symbols(spark, f)
    r = report.arity(s)
    groups = r.join(s.select("symbol_id", "name"), "symbol_id").groupBy("name").agg(F.min("least").alias("least"), F.when(~F.bool_or(F.col("most").isNull()), F.max("most")).alias("most"))
    return evidence.exclude_by_count(call_verdicts(spark, f), facts.calls(spark, f), r, groups)


def call_rivals(spark, f):
    return evidence.rivals(facts.calls(spark, f), facts.symbols(spark, f), call_verdicts(spark, f), _imports(spark, f))


def member_accesses(spark, f):
    return evidence.member_access(facts.calls(spark, f))


def type_ancestors(spark, f):
    return _above(spark, f)


QUERIES = {q.__name__: q for q in (call_claims, call_verdicts, call_verdicts_by_count, call_rivals, member_accesses, type_ancestors)}

_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_SELF, _KINDS = _LIST(evidence.SELF), _LIST(TYPES)
_FAM = facts.family_sql
_CALL = "('function', 'method', 'constructor')"
_TYPES_SQL = rf"""ty AS (SELECT symbol_id, name FROM s WHERE kind IN {_KINDS} AND name IS NOT NULL),
bn AS (SELECT DISTINCT symbol_id AS src, unnest(regexp_extract_all({imports.BASES_SQL}, '([A-Z]\w*)', 1)) AS name FROM s WHERE kind IN {_LIST(imports.EXTENDING)}),
t1 AS (SELECT name, min(symbol_id) AS id, count(*) AS n FROM s WHERE kind IN {_LIST(imports.EXTENDING)} AND name IS NOT NULL GROUP BY name),
a0 AS (SELECT symbol_id, name, symbol_id AS at, 0 AS depth FROM ty UNION SELECT a0.symbol_id, bn.name, CASE WHEN t1.n = 1 THEN t1.id END, a0.depth + 1 FROM a0 JOIN bn ON bn.src = a0.at LEFT JOIN t1 ON t1.name = bn.name WHERE a0.depth < 8 AND (t1.n IS DISTINCT FROM 1 OR t1.id <> bn.src)),
ab AS (SELECT symbol_id, name, min(depth) AS depth FROM a0 GROUP BY ALL)"""
_UP = """up AS (SELECT a.symbol_id, b.symbol_id AS scope, 1 AS depth FROM s a JOIN s b ON a.parent_symbol_id = b.symbol_id
  UNION ALL SELECT u.symbol_id, p.symbol_id, u.depth + 1 FROM up u JOIN s x ON x.symbol_id = u.scope JOIN s p ON p.symbol_id = x.parent_symbol_id WHERE u.depth < 31 AND u.symbol_id <> u.scope),
sc AS (SELECT symbol_id, symbol_id AS scope, 0 AS depth FROM s UNION ALL SELECT * FROM up)"""
_TYPED = """rt AS (SELECT site, min(type) AS type FROM (SELECT c.site, vr.type, sc.depth, min(sc.depth) OVER (PARTITION BY c.site) AS least FROM c JOIN sc ON sc.symbol_id = c.from_symbol_id JOIN vr ON vr.scope = sc.scope AND vr.name = c.receiver)
  WHERE depth = least GROUP BY site HAVING count(DISTINCT type) = 1)"""
_JUDGING = f"""nt AS (SELECT symbol_id, arg_min(sc.scope, depth) AS type_id FROM sc WHERE sc.scope IN (SELECT symbol_id FROM s WHERE kind IN {_KINDS}) GROUP BY symbol_id),
de AS (SELECT s.symbol_id, s.name, s.path, s.language, s.parent_symbol_id, {_FAM("s.language")} AS fam, {reports._FOLDER.format("s.path")} AS folder, o.name AS owner FROM s LEFT JOIN s o ON o.symbol_id = s.parent_symbol_id WHERE s.kind IN {_CALL} AND s.name IS NOT NULL),
pairs AS (SELECT c.*, nt.type_id, rt.type, d.symbol_id AS def, d.path AS dpath, d.parent_symbol_id AS dparent, d.owner, d.language AS dlang, d.folder AS dfolder,
    coalesce(c.receiver IN {_SELF}, false) OR list_contains(c.namespace, 'Self') AS own, len(c.namespace) = 0 AND c.receiver IS NULL AS bare
  FROM c JOIN de d ON d.name = c.name AND d.fam = {_FAM("c.language")} LEFT JOIN nt ON nt.symbol_id = c.from_symbol_id LEFT JOIN rt USING (site)),
judged AS (SELECT site, def, CASE
    WHEN dparent IS NOT NULL AND list_contains(namespace, owner) THEN 1 WHEN len(namespace) > 0 AND dparent IS NULL THEN 2 WHEN own AND dparent = type_id THEN 3
    WHEN own AND dparent IS NOT NULL AND EXISTS (SELECT 1 FROM ab WHERE ab.symbol_id = type_id AND ab.name = owner AND ab.depth > 0) THEN 4
    WHEN receiver IS NOT NULL AND NOT own AND dparent IS NOT NULL AND owner = receiver THEN 5
    WHEN receiver IS NOT NULL AND NOT own AND dparent IS NULL AND EXISTS (SELECT 1 FROM ie WHERE ie.src = path AND ie.dst = dpath AND lower(regexp_extract(dpath, '([^/.]*)[^/]*$', 1)) = lower(receiver)) THEN 6
    WHEN type IS NOT NULL AND dparent IS NOT NULL AND (owner = type OR EXISTS (SELECT 1 FROM ab JOIN ty ON ty.symbol_id = ab.symbol_id WHERE ty.name = type AND ab.name = owner)) THEN 7
    WHEN bare AND dparent IS NULL AND dpath = path THEN 8
    WHEN bare AND EXISTS (SELECT 1 FROM sc WHERE sc.symbol_id = from_symbol_id AND sc.scope = dparent AND sc.scope NOT IN (SELECT symbol_id FROM s WHERE kind IN {_KINDS})) THEN 9
    WHEN bare AND language IN {_LIST(evidence.IMPLICIT)} AND dparent = type_id THEN 10
    WHEN bare AND dparent IS NULL AND EXISTS (SELECT 1 FROM ie WHERE ie.src = path AND ie.dst = dpath) THEN 11
    WHEN bare AND dparent IS NULL AND language IN {_LIST(evidence.PACKAGES)} AND dlang = language AND dfolder = {reports._FOLDER.format("path")} THEN 12 END AS rank,
    CASE WHEN own AND dparent IS DISTINCT FROM type_id AND NOT list_contains(namespace, owner) THEN (SELECT min(depth) FROM ab WHERE ab.symbol_id = type_id AND ab.name = owner AND ab.depth > 0) END AS d4,
    (SELECT min(depth) FROM ab JOIN ty ON ty.symbol_id = ab.symbol_id WHERE ty.name = type AND ab.name = owner) AS d7, (SELECT min(depth) FROM sc WHERE sc.symbol_id = from_symbol_id AND sc.scope = dparent) AS d9 FROM pairs),
ranked AS (SELECT site, def, rank, CASE rank WHEN 4 THEN d4 WHEN 7 THEN coalesce(d7, 0) WHEN 9 THEN d9 ELSE 0 END AS depth FROM judged WHERE rank IS NOT NULL),
first_ AS (SELECT *, min(rank * 1000 + depth) OVER (PARTITION BY site) AS least FROM ranked),
cl AS (SELECT site, CASE any_value(rank) WHEN 3 THEN 'class chain' WHEN 4 THEN 'class chain' WHEN 6 THEN 'import' WHEN 7 THEN 'receiver type' WHEN 8 THEN 'same file' WHEN 9 THEN 'enclosing scope' WHEN 10 THEN 'class chain'
    WHEN 11 THEN 'import' WHEN 12 THEN 'same package' ELSE 'qualified path' END AS basis, count(*) AS n, CASE WHEN count(*) = 1 THEN min(def) END AS target FROM first_ WHERE rank * 1000 + depth = least GROUP BY site),
n0 AS (SELECT name, count(*) AS n FROM de GROUP BY name), n1 AS (SELECT name, fam, count(*) AS n, min(symbol_id) AS one FROM de GROUP BY ALL),
vd AS (SELECT c.site, CASE WHEN n0.n IS NULL THEN 'external' WHEN n1.n IS NULL THEN 'excluded' WHEN cl.n = 1 THEN 'proven' WHEN cl.n > 1 THEN 'unresolved' WHEN rt.type IS NOT NULL THEN 'excluded' WHEN n1.n > 1 THEN 'unresolved' ELSE 'likely' END AS label,
    CASE WHEN n0.n IS NULL THEN 'no definition' WHEN n1.n IS NULL THEN 'other language' WHEN cl.n = 1 THEN cl.basis WHEN cl.n > 1 THEN cl.n || ' definitions' WHEN rt.type IS NOT NULL THEN 'receiver is ' || rt.type WHEN n1.n > 1 THEN n1.n || ' definitions'
      WHEN c.receiver IS NOT NULL OR len(c.namespace) > 0 THEN 'receiver not typed' ELSE 'name only' END AS basis,
    CASE WHEN n1.n IS NULL THEN NULL WHEN cl.n = 1 THEN cl.target WHEN cl.n > 1 OR rt.type IS NOT NULL OR n1.n > 1 THEN NULL ELSE n1.one END AS target
  FROM c LEFT JOIN n0 ON n0.name = c.name LEFT JOIN n1 ON n1.name = c.name AND n1.fam = {_FAM("c.language")} LEFT JOIN cl USING (site) LEFT JOIN rt USING (site))"""
_BASE = f"WITH RECURSIVE {facts.CALLS_SQL}, {_TYPES_SQL}, {_UP}, {_TYPED}, {extras._IMPORT_EDGES}, {_JUDGING}"
SQL = {
    "call_claims": f"{_BASE} SELECT site, basis, n, target FROM cl",
    "call_verdicts": f"{_BASE} SELECT site, label, basis, target FROM vd",
    "call_verdicts_by_count": rf"""{_BASE}, {reports._PARAMS}, g AS (SELECT name, min(least) AS least, CASE WHEN NOT bool_or(most IS NULL) THEN max(most) END AS most FROM ar GROUP BY name),
      w AS (SELECT vd.*, coalesce(c.args IS NOT NULL AND NOT (c.language = 'go' AND c.args = 1) AND CASE label WHEN 'likely' THEN c.args < ar.least OR coalesce(c.args > ar.most, false) WHEN 'unresolved' THEN c.args < g.least OR coalesce(c.args > g.most, false) END, false) AS wrong
        FROM vd JOIN c USING (site) LEFT JOIN ar ON ar.symbol_id = vd.target LEFT JOIN g ON g.name = c.name)
      SELECT site, CASE WHEN wrong THEN 'excluded' ELSE label END AS label, CASE WHEN wrong THEN 'argument count' ELSE basis END AS basis, CASE WHEN NOT wrong THEN target END AS target FROM w""",
    "call_rivals": f"""{_BASE}, tops AS (SELECT * FROM de WHERE parent_symbol_id IS NULL)
      SELECT c.site, greatest(0, (SELECT count(*) FROM de d WHERE d.parent_symbol_id IS NOT NULL AND d.name = c.name AND d.fam = {_FAM("c.language")}) + (SELECT count(*) FROM tops d WHERE d.name = c.name AND d.fam = {_FAM("c.language")} AND d.folder = {reports._FOLDER.format("c.path")})
        + (SELECT count(*) FROM tops d JOIN ie ON ie.dst = d.path AND ie.src = c.path WHERE d.name = c.name AND d.fam = {_FAM("c.language")} AND d.folder <> {reports._FOLDER.format("c.path")}) - CASE WHEN vd.target IS NOT NULL THEN 1 ELSE 0 END) AS rivals FROM c JOIN vd USING (site)""",
    "member_accesses": f"WITH {facts.CALLS_SQL} SELECT path, name, count(*) AS rows FROM c WHERE receiver IS NOT NULL GROUP BY ALL",
    "type_ancestors": f"WITH RECURSIVE {facts.SYMBOLS_SQL}, {_TYPES_SQL} SELECT symbol_id, name, depth FROM ab",
}
