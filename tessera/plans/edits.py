"""Impact with report callers, tests and their commands, and what an edit breaks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import checks, impact, report, testing, walk
from tessera.plans import evidence, facts, reports, scans, snapshots
from tessera.session import cut, once
from tessera.sources.tables import table

_SOURCES = ("symbols", "files", "source_texts")


def _judged_calls(spark, f):
    """The calls with their verdicts, in the columns of a report's sites."""
    c = facts.calls(spark, f).select("site", "from_symbol_id", "name", "path", "line", "language", "args")
    return evidence.call_verdicts(spark, f).join(c, "site").withColumn("call", F.lit(True))


def _twentieth(column):
    return F.conv(F.substring(column, 1, 8), 16, 10).cast("bigint") % 20 == 0


def report_callers(spark, f):
    """The callers that the reports of all symbols know."""
    return once(spark, f, "report_callers", _SOURCES, lambda: impact.report_callers(_judged_calls(spark, f), facts.symbols(spark, f)))


def _joined(spark, f, depth):
    callers = report_callers(spark, f).where(_twentieth("seed"))
    e = facts.resolved(spark, f)
    seeds = callers.select("seed").union(e.select("dst").where(_twentieth("dst"))).distinct()
    return impact.join_callers(walk.reach(e, seeds, depth), callers)


def joined_callers(spark, f):
    """Walks of depth 2 from every twentieth symbol, joined with its report's callers."""
    return _joined(spark, f, 2)


def walked_on(spark, f):
    """The same, walked on from the callers that the report added."""
    return impact.walk_on(cut(_joined(spark, f, 2), "joined"), facts.resolved(spark, f), 2).select("seed", "node", "depth")


def impact_all_edges(spark, f):
    """Walks over resolved edges and calls that evidence ties to one definition, from every twentieth symbol."""
    e = cut(impact.all_edges(facts.resolved(spark, f), _judged_calls(spark, f).where("label = 'proven'"), impact.setup_edges(facts.symbols(spark, f))), "all_edges")
    return walk.reach(e, e.select(F.col("dst").alias("seed")).where(_twentieth("seed")).distinct(), 2)


def impact_of_files(spark, f):
    """Who is affected by each file as a whole."""
    e, callers = facts.resolved(spark, f), report_callers(spark, f)
    return impact.file_report(walk.reach(e, e.select(F.col("dst").alias("seed")).distinct(), 2), facts.symbols(spark, f), callers)


def seeds_of_hunks(spark, f):
    return impact.seeds_by_hunks(facts.symbols(spark, f).where("path IS NOT NULL"), snapshots._hunks(spark, f))


def seeds_of_names(spark, f):
    """Names and owner-qualified names of every twentieth symbol as seeds."""
    s = facts.symbols(spark, f)
    p = s.select(F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("owner"))
    asked = s.where(_twentieth("symbol_id") & F.col("name").isNotNull()).join(p, "parent_symbol_id", "left")
    none = F.lit(None).cast("string").alias("path")
    q = asked.select(F.col("name").alias("query"), none).unionByName(asked.where("owner IS NOT NULL").select(F.concat_ws("::", "owner", "name").alias("query"), none)).distinct()
    return impact.seeds_by_name(s, q)


def owning_tests(spark, f):
    return testing.test_of(facts.symbols(spark, f))


def related_tests(spark, f):
    callers = _judged_calls(spark, f).where("target IS NOT NULL AND label IN ('proven', 'likely')").select(F.col("target").alias("symbol_id"), F.col("from_symbol_id").alias("caller")).distinct()
    return testing.related_tests(callers, testing.test_of(facts.symbols(spark, f)), facts.symbols(spark, f))


def run_commands(spark, f):
    """How each test is run; no project files are known, so the usual runner of its language is taken."""
    s = facts.symbols(spark, f)
    owner = s.where("kind IN ('class', 'struct', 'interface')").select(F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("owner"))
    t = s.where(testing.reads_as_test(s) & F.col("name").isNotNull() & F.col("path").isNotNull()).join(owner, "parent_symbol_id", "left")
    none = F.array().cast("array<string>")
    return t.select("symbol_id", testing.run_command(F.col("language"), F.col("path"), F.col("name"), F.col("owner"), F.col("start_line"), none).alias("command"))


def _sides(spark, f):
    b, c = snapshots._sides(spark, f)
    return cut(b, "base"), cut(c, "current")


def edit_shapes(spark, f):
    b, c = _sides(spark, f)
    return checks.shapes(b, c, cut(snapshots.diff.pair(b, c), "pairs"))


def edit_calls(spark, f):
    """The calls of all callables against the ranges that their signatures have in the current snapshot."""
    _, c = snapshots._sides(spark, f)
    sites = _judged_calls(spark, f).where("target IS NOT NULL").select("site", "target", "path", "line", "label", "args")
    return checks.place_calls(sites, report.arity(c), snapshots._hunks(spark, f))


def edit_overloads(spark, f):
    """The calls of all names against the ranges of the definitions that are left in the current snapshot."""
    _, c = snapshots._sides(spark, f)
    left = report.arity(c).join(c.select("symbol_id", "name"), "symbol_id").select("name", "least", "most").distinct()
    sites = _judged_calls(spark, f).join(left.select("name").distinct(), "name", "left_semi").select("site", "name", "path", "line", "label", "args")
    return checks.removed_overloads(sites, left, snapshots._hunks(spark, f))


def edit_candidates(spark, f):
    """Indexed and skipped files as changed ones."""
    changed = facts.files(spark, f).select("path").unionByName(table(spark, f, "skipped_files").select("path")).where("path IS NOT NULL").distinct()
    return checks.candidate_files(changed, facts.files(spark, f))


def edited_lines(spark, f):
    """Every tenth line of the texts as a blocked site, each twentieth with another content than it has."""
    at = facts.lines(spark, f).where("line % 10 = 0").select("path", "line", F.md5(F.when(F.col("line") % 20 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("digest"))
    return checks.edited_since(at, facts.lines(spark, f))


def symbol_sections(spark, f):
    """The second page of each kind of symbols."""
    return checks.sections(facts.symbols(spark, f).where("kind IS NOT NULL").select("kind", "symbol_id"), "kind", ["symbol_id"], 20, 20)


def fitted_outlines(spark, f):
    """An outline of each project in 2,000 characters."""
    s = facts.symbols(spark, f)
    project = F.regexp_extract("path", r"^(monorepo/[^/]+|[^/]+)", 1)
    return checks.fit(checks.outline_levels(s, project), 2000)


def parent_chains(spark, f):
    s = facts.symbols(spark, f)
    return checks.parent_names(s, walk.ancestors(s)).select("symbol_id", F.replace("owner", F.lit("\x1f"), F.lit("/")).alias("owner"))


QUERIES = {q.__name__: q for q in (report_callers, joined_callers, walked_on, impact_all_edges, impact_of_files, seeds_of_hunks, seeds_of_names, owning_tests, related_tests, run_commands, edit_shapes, edit_calls, edit_overloads,
                                   edit_candidates, edited_lines, symbol_sections, fitted_outlines, parent_chains)}

_CALL = "('function', 'method', 'constructor')"
_TESTPATH = r"(regexp_matches({0}, '(^|/)(test|tests|__tests__|autotests)/') OR regexp_matches(regexp_extract({0}, '([^/]*)$', 1), '^test_.*\.(py|rb)$|_test\.|\.test\.|\.spec\.|^tests?\.rs$|^tst_|Tests\.cs$'))"
_READS = f"(kind IN {_CALL} AND (coalesce(is_test, false) OR coalesce({_TESTPATH.format('path')} AND regexp_matches(name, '^(test_|Test[A-Z_]|test[A-Z])'), false)))"
_REPORT = f"""{evidence._BASE}, jc AS (SELECT vd.*, c.from_symbol_id, c.name, c.path, c.line, c.args FROM vd JOIN c USING (site)),
rc AS (SELECT target AS seed, from_symbol_id AS node, 'direct caller (report' || CASE WHEN bool_and(label = 'likely' AND starts_with(basis, 'name only')) THEN ', name only' ELSE '' END || ')' AS reason FROM jc
  WHERE label IN ('proven', 'likely') AND target IS NOT NULL AND target <> from_symbol_id AND from_symbol_id IN (SELECT symbol_id FROM s WHERE NOT coalesce(is_test, false) AND NOT coalesce(test_container, false)
    AND NOT coalesce({_TESTPATH.format('path')} AND regexp_matches(name, '^(test_|Test[A-Z_]|test[A-Z])'), false)) GROUP BY ALL),
g AS (SELECT DISTINCT to_symbol_id AS dst, from_symbol_id AS src FROM (SELECT i.containing_symbol_id AS from_symbol_id, CASE WHEN dn.candidates = 1 THEN dn.one END AS to_symbol_id FROM i JOIN s ON s.symbol_id = i.containing_symbol_id
  JOIN (SELECT name, {facts.family_sql("language")} AS fam, count(*) AS candidates, min(symbol_id) AS one FROM s WHERE kind IN {_CALL} AND name IS NOT NULL GROUP BY ALL) dn ON dn.name = i.name AND dn.fam = {facts.family_sql("s.language")}) WHERE to_symbol_id IS NOT NULL)"""
_20 = "('0x' || substr({0}, 1, 8))::BIGINT % 20 = 0"
_JOINED = f"""{_REPORT}, sd AS (SELECT DISTINCT seed FROM (SELECT seed FROM rc UNION ALL SELECT dst FROM g) WHERE {_20.format("seed")}),
w AS (SELECT seed, seed AS node, 0 AS depth FROM sd UNION SELECT w.seed, g.src, w.depth + 1 FROM w JOIN g ON g.dst = w.node WHERE w.depth < 2),
wk AS (SELECT seed, node, min(depth) AS depth FROM w WHERE seed <> node GROUP BY ALL),
jo AS (SELECT coalesce(wk.seed, rc.seed) AS seed, coalesce(wk.node, rc.node) AS node, CASE WHEN rc.node IS NOT NULL THEN 1 ELSE wk.depth END AS depth, rc.node IS NOT NULL AND coalesce(wk.depth > 1, true) AS added, rc.reason AS said
  FROM wk FULL JOIN (SELECT * FROM rc WHERE {_20.format("seed")}) rc ON rc.seed = wk.seed AND rc.node = wk.node)"""


def _q(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[A-Za-z0-9_./:=@%+,-]+$') THEN {x} ELSE '''' || replace({x}, '''', '''\\''''') || '''' END"


_DOTTED = "coalesce(owner || '.', '') || name"
_RUN = f"""CASE WHEN language = 'python' THEN 'pytest ' || {_q("path || '::' || coalesce(owner || '::', '') || name")} WHEN language = 'rust' THEN 'cargo test ' || {_q("name")}
  WHEN language = 'go' THEN 'go test ' || {_q("'./' || fo")} || ' -run ' || {_q("'^' || name || '$'")} WHEN language IN ('javascript', 'typescript', 'tsx', 'jsx') THEN 'npx jest ' || {_q("path")} || ' -t ' || {_q("name")}
  WHEN language IN ('java', 'kotlin') THEN 'mvn test -Dtest=' || {_q("coalesce(owner || '#', '') || name")} WHEN language IN ('csharp', 'fsharp', 'vbnet') THEN 'dotnet test --filter ' || {_q(f"'FullyQualifiedName~' || {_DOTTED}")}
  WHEN language IN ('c', 'cpp') THEN 'ctest -R ' || {_q(f"'^' || {_DOTTED} || '$'")} END"""
_ARITY_NOW = reports._PARAMS.replace("FROM s WHERE", "FROM cc WHERE")
_TOUCH = "EXISTS (SELECT 1 FROM h WHERE h.path = {0}.path AND {0}.line BETWEEN h.start_line AND h.start_line + 9)"
_CC = """n0_ AS (SELECT *, ('0x' || substr(symbol_id, 1, 8))::BIGINT AS no FROM s),
cc AS (SELECT * REPLACE (CASE WHEN no % 5 = 0 THEN coalesce(signature, '') || '(extra)' ELSE signature END AS signature, CASE WHEN no % 11 = 0 THEN name || '_renamed' ELSE name END AS name) FROM n0_ WHERE no % 7 <> 0)"""
_NOTE = "'passes ' || args || CASE WHEN args = 1 THEN ' argument' ELSE ' arguments' END || '; '"
_PNAMES = r"""list_filter(list_transform(list_filter(list_transform(string_split(regexp_extract(coalesce({0}, ''), '\(([^()]*)\)', 1), ','), lambda x: trim(regexp_replace(regexp_replace(string_split(x, '=')[1], ':.*$', ''), '^[\s*&.]+', ''))), lambda x: x <> ''),
  lambda x: regexp_extract(x, '([A-Za-z_$][\w$]*)\??\s*$', 1)), lambda x: x <> '' AND x NOT IN ('self', 'this', 'cls'))"""
_KEYW = r"list_sort(list_filter(['static', 'async', 'abstract', 'const', 'unsafe', 'override', 'virtual', 'final', 'suspend'], lambda k: list_contains(regexp_split_to_array(lower(regexp_extract(coalesce({0}, ''), '^([^(]*)', 1)), '\W+'), k)))"
_TAIL = snapshots._TAIL
SQL = {
    "report_callers": f"{_REPORT} SELECT seed, node, reason FROM rc",
    "joined_callers": f"{_JOINED} SELECT seed, node, depth, CASE WHEN added THEN said WHEN depth = 1 THEN 'direct caller' ELSE 'indirect caller [depth ' || depth || ']' END AS reason, added FROM jo",
    "walked_on": f"""{_JOINED}, fo AS (SELECT jo.seed, g.src AS node, 2 AS d FROM jo JOIN g ON g.dst = jo.node WHERE jo.added AND g.src <> jo.seed AND g.src <> jo.node GROUP BY ALL)
      SELECT coalesce(jo.seed, fo.seed) AS seed, coalesce(jo.node, fo.node) AS node, least(jo.depth, fo.d) AS depth FROM jo FULL JOIN fo ON fo.seed = jo.seed AND fo.node = jo.node""",
    "impact_all_edges": f"""{_REPORT}, al AS (SELECT src, dst FROM g UNION SELECT from_symbol_id, target FROM jc WHERE label = 'proven' AND target IS NOT NULL
        UNION SELECT a.symbol_id, b.symbol_id FROM s a JOIN s b ON a.parent_symbol_id = b.parent_symbol_id WHERE b.test_lifecycle AND a.is_test AND NOT coalesce(a.test_lifecycle, false)),
      w AS (SELECT DISTINCT dst AS seed, dst AS node, 0 AS depth FROM al WHERE {_20.format("dst")} UNION SELECT w.seed, al.src, w.depth + 1 FROM w JOIN al ON al.dst = w.node WHERE w.depth < 2)
      SELECT seed, node, min(depth) AS depth FROM w WHERE seed <> node GROUP BY ALL""",
    "impact_of_files": f"""{_REPORT}, w AS (SELECT DISTINCT dst AS seed, dst AS node, 0 AS depth FROM g UNION SELECT w.seed, g.src, w.depth + 1 FROM w JOIN g ON g.dst = w.node WHERE w.depth < 2),
      b AS (SELECT seed, node, depth FROM w WHERE seed <> node UNION ALL SELECT seed, node, 1 FROM rc)
      SELECT a.path, b.node, min(b.depth) AS depth FROM b JOIN s a ON a.symbol_id = b.seed JOIN s n ON n.symbol_id = b.node WHERE a.path IS NOT NULL AND a.path IS DISTINCT FROM n.path GROUP BY ALL""",
    "seeds_of_hunks": f"""WITH {facts.SYMBOLS_SQL}, {snapshots._H}, {snapshots._TOUCHED} SELECT path, symbol_id AS seed FROM th WHERE symbol_id IS NOT NULL
      UNION SELECT s.path, s.symbol_id FROM s WHERE s.path IN (SELECT path FROM th WHERE symbol_id IS NULL)""",
    "seeds_of_names": f"""WITH {facts.SYMBOLS_SQL}, a AS (SELECT s.name, p.name AS owner FROM s LEFT JOIN s p ON p.symbol_id = s.parent_symbol_id WHERE {_20.format("s.symbol_id")} AND s.name IS NOT NULL),
      q AS (SELECT DISTINCT query, n, o FROM (SELECT name AS query, name AS n, NULL AS o FROM a UNION ALL SELECT owner || '::' || name, name, owner FROM a WHERE owner IS NOT NULL)),
      hit AS (SELECT DISTINCT query, s.symbol_id AS seed FROM q JOIN s ON s.name = q.n LEFT JOIN s p ON p.symbol_id = s.parent_symbol_id WHERE q.o IS NULL OR p.name = q.o)
      SELECT query, seed, count(*) OVER (PARTITION BY query) AS candidates FROM hit""",
    "owning_tests": f"""WITH RECURSIVE {facts.SYMBOLS_SQL}, k AS (SELECT symbol_id, parent_symbol_id, {_READS} AS hit, coalesce(test_lifecycle, false) AS stop FROM s WHERE kind IN {_CALL}),
      u AS (SELECT symbol_id, symbol_id AS at, 0 AS d FROM k UNION ALL SELECT u.symbol_id, k.parent_symbol_id, u.d + 1 FROM u JOIN k ON k.symbol_id = u.at WHERE NOT k.stop AND NOT k.hit AND k.parent_symbol_id IS NOT NULL AND u.d < 4)
      SELECT u.symbol_id, u.at AS test_id FROM u JOIN k ON k.symbol_id = u.at WHERE k.hit AND NOT k.stop""",
    "related_tests": f"""{_REPORT}, kk AS (SELECT symbol_id, parent_symbol_id, {_READS} AS hit, coalesce(test_lifecycle, false) AS stop FROM s WHERE kind IN {_CALL}),
      uu AS (SELECT symbol_id, symbol_id AS at, 0 AS d FROM kk UNION ALL SELECT uu.symbol_id, kk.parent_symbol_id, uu.d + 1 FROM uu JOIN kk ON kk.symbol_id = uu.at WHERE NOT kk.stop AND NOT kk.hit AND kk.parent_symbol_id IS NOT NULL AND uu.d < 4),
      te AS (SELECT uu.symbol_id, uu.at AS test_id FROM uu JOIN kk ON kk.symbol_id = uu.at WHERE kk.hit AND NOT kk.stop),
      j AS (SELECT DISTINCT jc.target AS symbol_id, te.test_id FROM jc JOIN te ON te.symbol_id = jc.from_symbol_id WHERE jc.target IS NOT NULL AND jc.label IN ('proven', 'likely') AND jc.target <> te.test_id),
      o AS (SELECT j.symbol_id, j.test_id, coalesce(s.is_test, false) AS flagged, row_number() OVER (PARTITION BY j.symbol_id ORDER BY coalesce(s.is_test, false) DESC, s.path NULLS LAST, s.start_line NULLS LAST, j.test_id)::INTEGER AS place FROM j JOIN s ON s.symbol_id = j.test_id)
      SELECT * FROM o WHERE place <= 5""",
    "run_commands": f"""WITH {facts.SYMBOLS_SQL}, t AS (SELECT s.*, o.name AS owner, {reports._FOLDER.format("s.path")} AS fo FROM (SELECT * FROM s WHERE {_READS} AND name IS NOT NULL AND path IS NOT NULL) s LEFT JOIN s o ON o.symbol_id = s.parent_symbol_id AND o.kind IN ('class', 'struct', 'interface'))
      SELECT symbol_id, {_RUN} AS command FROM t""",
    "edit_shapes": f"""WITH {snapshots._pair_sql()}, both_ AS (SELECT * FROM pr WHERE base_id IS NOT NULL AND current_id IS NOT NULL), {snapshots._alone('path, owner, kind, body_hash').replace('x1 AS', 'r1 AS').replace('x2 AS', 'r2 AS')}, {snapshots._alone('kind, name, owner, body_hash')},
      mv AS (SELECT x1.id AS base_id, x2.id AS current_id, 'move' AS change, x2.pth AS detail FROM x1 JOIN x2 USING (kind, name, owner, body_hash) WHERE x1.pth <> x2.pth),
      rn AS (SELECT r1.id AS base_id, r2.id AS current_id, 'rename' AS change, c.name AS detail FROM r1 JOIN r2 USING (path, owner, kind, body_hash) JOIN cc c ON c.symbol_id = r2.id),
      sg AS (SELECT base_id, current_id, {_PNAMES.format("b.signature")} AS p1, {_PNAMES.format("c.signature")} AS p2, {_KEYW.format("b.signature")} AS k1, {_KEYW.format("c.signature")} AS k2, {_TAIL.replace("signature", "b.signature")} AS t1, {_TAIL.replace("signature", "c.signature")} AS t2
        FROM both_ JOIN bb b ON b.symbol_id = base_id JOIN cc c ON c.symbol_id = current_id WHERE b.kind IN {_CALL} AND c.kind IN {_CALL}),
      ch AS (SELECT base_id, current_id, CASE WHEN len(p1) <> len(p2) THEN 'parameters' WHEN p1 <> p2 THEN 'renamed' WHEN k1 <> k2 THEN 'keywords' WHEN t1 <> t2 THEN 'signature' END AS change,
        CASE WHEN len(p1) <> len(p2) THEN len(p1) || '>' || len(p2) WHEN p1 <> p2 THEN array_to_string([p1[q] || '>' || p2[q] for q in generate_series(1, len(p1)) if p1[q] <> p2[q]], ',') WHEN k1 <> k2 THEN array_to_string(k1, ' ') || '>' || array_to_string(k2, ' ') ELSE '' END AS detail FROM sg)
      SELECT * FROM mv UNION ALL SELECT * FROM rn UNION ALL SELECT base_id, NULL, 'removed', '' FROM pr WHERE current_id IS NULL AND base_id NOT IN (SELECT base_id FROM mv UNION ALL SELECT base_id FROM rn)
      UNION ALL SELECT base_id, current_id, 'visibility', '' FROM both_ JOIN bb b ON b.symbol_id = base_id JOIN cc c ON c.symbol_id = current_id WHERE {_TAIL.replace("signature", "b.signature")} = {_TAIL.replace("signature", "c.signature")} AND b.visibility IS DISTINCT FROM c.visibility
      UNION ALL SELECT * FROM ch WHERE change IS NOT NULL""",
    "edit_calls": rf"""{_REPORT}, {_CC}, {snapshots._H}, {_ARITY_NOW}, x AS (SELECT jc.*, ar.least, ar.most, {_TOUCH.format("jc")} AS touched, jc.args >= ar.least AND (ar.most IS NULL OR jc.args <= ar.most) AS fits FROM jc JOIN ar ON ar.symbol_id = jc.target WHERE jc.label <> 'excluded'),
      y AS (SELECT target, site, CASE WHEN args IS NOT NULL AND NOT fits THEN label WHEN touched THEN 'in_diff' WHEN args IS NULL THEN 'unresolved' END AS place,
        CASE WHEN args IS NOT NULL AND NOT fits THEN {_NOTE} || 'takes ' || CASE WHEN most IS NULL THEN least || ' or more' WHEN least = most THEN least::VARCHAR ELSE least || ' to ' || most END END AS note FROM x) SELECT * FROM y WHERE place IS NOT NULL""",
    "edit_overloads": rf"""{_REPORT}, {_CC}, {snapshots._H}, {_ARITY_NOW}, x AS (SELECT jc.*, {_TOUCH.format("jc")} AS touched, EXISTS (SELECT 1 FROM ar WHERE ar.name = jc.name AND jc.args >= ar.least AND (ar.most IS NULL OR jc.args <= ar.most)) AS fits FROM jc WHERE label <> 'excluded' AND jc.name IN (SELECT name FROM ar)),
      y AS (SELECT name, site, CASE WHEN args IS NULL AND NOT touched THEN 'unresolved' WHEN args IS NOT NULL AND NOT fits THEN label END AS place, CASE WHEN args IS NOT NULL AND NOT fits THEN {_NOTE} || 'no remaining overload takes it' END AS note FROM x) SELECT * FROM y WHERE place IS NOT NULL""",
    "edit_candidates": rf"""WITH {facts.FILES_SQL}, ch AS (SELECT path FROM f WHERE path IS NOT NULL UNION SELECT path FROM skipped_files WHERE path IS NOT NULL), en AS (SELECT DISTINCT lower(regexp_extract(path, '\.([A-Za-z0-9_]+)$', 1)) AS e FROM f)
      SELECT path FROM ch WHERE NOT (list_has_any(string_split(path, '/'), [{scans._list(scans.scan.EXCLUDED_FOLDERS)}]) OR len(list_filter([{scans._list(scans.scan.EXCLUDED_ENDINGS)}], lambda x: ends_with(path, x))) > 0) AND NOT ends_with(path, '/')
        AND (path IN (SELECT path FROM f) OR (lower(regexp_extract(path, '\.([A-Za-z0-9_]+)$', 1)) <> '' AND lower(regexp_extract(path, '\.([A-Za-z0-9_]+)$', 1)) IN (SELECT e FROM en)))""",
    "edited_lines": f"WITH {facts.LINES_SQL} SELECT path, line, line % 20 = 0 AS edited FROM l WHERE line % 10 = 0",
    "symbol_sections": f"""WITH {facts.SYMBOLS_SQL}, r AS (SELECT kind, symbol_id, row_number() OVER (PARTITION BY kind ORDER BY symbol_id)::INTEGER AS place, count(*) OVER (PARTITION BY kind) AS found FROM s WHERE kind IS NOT NULL)
      SELECT kind, symbol_id, place, found, found > 40 AS more FROM r WHERE place > 20 AND place <= 40""",
    "fitted_outlines": f"""WITH {facts.SYMBOLS_SQL}, r AS (SELECT regexp_extract(path, '^(monorepo/[^/]+|[^/]+)', 1) AS key, path, coalesce(name, '') AS name, row_number() OVER (PARTITION BY path ORDER BY start_line NULLS LAST, symbol_id) AS rn FROM s WHERE path IS NOT NULL),
      ln AS (SELECT key, path, lv.level, coalesce(string_agg(name, ', ' ORDER BY rn) FILTER (rn <= lv.n), '') AS names FROM r, (VALUES (0, 5), (1, 3), (2, 2), (3, 1), (4, 0)) lv(level, n) GROUP BY ALL),
      tx AS (SELECT key, level, string_agg(CASE WHEN names = '' THEN path ELSE path || ': ' || names END, chr(10) ORDER BY path) AS text FROM ln GROUP BY ALL),
      pk AS (SELECT key, coalesce(min(level) FILTER (len(text) <= 2000), max(level)) AS level FROM tx GROUP BY key) SELECT tx.key, tx.level, substr(tx.text, 1, 2000) AS text FROM tx JOIN pk USING (key, level)""",
    "parent_chains": f"""WITH RECURSIVE {facts.SYMBOLS_SQL}, {evidence._UP} SELECT s.symbol_id, coalesce(o.owner, '') AS owner FROM s LEFT JOIN (SELECT up.symbol_id, string_agg(coalesce(a.name, ''), '/' ORDER BY up.depth DESC) AS owner FROM up JOIN s a ON a.symbol_id = up.scope GROUP BY up.symbol_id) o USING (symbol_id)""",
}
