"""Evidence queries over the code facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.paths import folder
from tessera.functions.times import micros
from tessera.operators import report
from tessera.plans import facts


def _sites(spark, f):
    return facts.identifiers(spark, f).join(facts.files(spark, f).select("file_id", "language"), "file_id")


def _judged(spark, f):
    return report.verdicts(_sites(spark, f), facts.symbols(spark, f))


def _rows(spark, f):
    """The judged sites as rows of a report: each a call, claimed where it is tied to a definition; it binds another
    overload where the file has several of its name and none takes so many arguments."""
    s = facts.symbols(spark, f)
    several = s.where("kind IN ('function', 'method', 'constructor')").groupBy("file_id", "name").agg(F.count("*").alias("n")).where("n > 1").select("file_id", "name", F.lit(True).alias("several"))
    bound = overload_bindings(spark, f).select("file_id", "line", "name", F.lit(True).alias("bound")).distinct()
    at = facts.identifiers(spark, f).select("file_id", "line", "name", "column")
    j = _judged(spark, f).join(at, ["file_id", "line", "name"]).join(several, ["file_id", "name"], "left").join(bound, ["file_id", "line", "name"], "left")
    other = F.coalesce(F.col("several") & F.col("bound").isNull(), F.lit(False))
    return j.select("file_id", "path", "line", "name", "fam", "label", "basis", "target", "column", other.alias("other_overload"), F.col("target").isNotNull().alias("claimed"), F.lit(True).alias("call"), F.col("line").alias("end_line"))


def overload_bindings(spark, f):
    s = facts.symbols(spark, f)
    return report.bind_overloads(report.call_arguments(facts.lines(spark, f)), report.arity(s), s)


def site_verdicts(spark, f):
    s = facts.symbols(spark, f)
    return report.exclude_by_arguments(_judged(spark, f), report.call_arguments(facts.lines(spark, f)), report.arity(s))


def site_lines(spark, f):
    return report.merge_sites(_rows(spark, f))


def target_counts(spark, f):
    return report.label_counts(_judged(spark, f), facts.symbols(spark, f))


def target_first_sites(spark, f):
    return report.first_per_label(_judged(spark, f))


def report_places(spark, f):
    """Every site of every report, in report order."""
    return report.report_order(_rows(spark, f).where("target IS NOT NULL")).select("target", "path", "line", "name", "label", "place", "first")


def callable_arity(spark, f):
    return report.arity(facts.symbols(spark, f))


def overload_arity(spark, f):
    s = facts.symbols(spark, f)
    return report.arity_of_groups(report.arity(s), s)


def callee_list(spark, f):
    return report.callees_top(report.callees(facts.edges(spark, f)))


def calling_tests(spark, f):
    return report.calling_tests(facts.edges(spark, f), facts.symbols(spark, f))


def word_accounting(spark, f):
    s = facts.symbols(spark, f)
    names = s.select("name").where("name IS NOT NULL").distinct()
    words = facts.lines(spark, f).select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_$]+)"), 1))).alias("name")).join(names, "name")
    return report.text_accounting(words, facts.identifiers(spark, f), s)


def nearest_owners(spark, f):
    """For each class-like name used as a site's name the nearest definition by folders."""
    s = facts.symbols(spark, f).where("kind IN ('function', 'method', 'constructor') AND name IS NOT NULL AND path IS NOT NULL")
    owners = s.select(F.col("symbol_id").alias("owner_id"), "name", folder(F.col("path")).alias("folder"))
    i = facts.identifiers(spark, f).select(F.concat_ws(":", "path", "line", "name").alias("id"), "name", folder(F.col("path")).alias("folder"))
    return report.nearest_owner(i, owners)


def nearest_declarations(spark, f):
    """For each use in a file the declaration of that name in the same file that stands last before it."""
    i = facts.identifiers(spark, f).select(F.concat_ws(":", "path", "line", "name").alias("site"), F.col("file_id").alias("scope"), "name", "line")
    d = facts.symbols(spark, f).select(F.col("symbol_id").alias("declaration"), F.col("file_id").alias("scope"), "name", F.col("start_line").alias("line")).where("line IS NOT NULL")
    return report.nearest_preceding(i, d)


def unique_starts(spark, f):
    return report.line_unique(facts.symbols(spark, f).where("path IS NOT NULL AND start_line IS NOT NULL"))


def paired_calls(spark, f):
    """Every call with its identifier."""
    ends = facts.symbols(spark, f).select(F.col("symbol_id").alias("caller"), F.col("end_line").alias("caller_end"))
    e = facts.edges(spark, f).select(F.concat_ws(":", "path", "line", "name").alias("edge"), F.col("from_symbol_id").alias("caller"), "name", "line").join(ends, "caller")
    i = facts.identifiers(spark, f).where("containing_symbol_id IS NOT NULL").select(F.concat_ws(":", "path", "line", "name").alias("use"), F.col("containing_symbol_id").alias("caller"), "name", "line")
    return report.pair_greedily(e, i)


def sibling_conventions(spark, f):
    marks = F.regexp_extract_all("signature", F.lit(r"\b(pub|export|static|async|public|private|final|def|func|fn)\b"), 1)
    return report.conventions(facts.symbols(spark, f), marks)


def test_commands(spark, f):
    s = facts.symbols(spark, f).where("is_test AND kind IN ('function', 'method') AND name IS NOT NULL AND path IS NOT NULL")
    return s.select("symbol_id", report.test_command(F.col("language"), F.col("path"), F.col("name")).alias("command"))


def shortened_names(spark, f):
    s = facts.symbols(spark, f).where("path IS NOT NULL AND name IS NOT NULL")
    return report.shorten(s, "path", [F.col("start_line").asc_nulls_last(), F.col("symbol_id")], "name", 60)


def symbols_page(spark, f):
    return report.page(facts.symbols(spark, f).select("symbol_id", "name"), ["symbol_id"], 40, 20)


def turns(spark, f):
    s = facts.symbols(spark, f).where("path IS NOT NULL")
    return report.interleave(s.select("path", "symbol_id"), "path", ["symbol_id"]).where("turn <= 2")


def name_uses(spark, f):
    return facts.identifiers(spark, f).groupBy("name").agg(F.sum("uses").alias("uses"))


def merged_event_order(spark, f):
    from tessera.sources.tables import table

    e = table(spark, f, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), micros(F.col("ts")).alias("time"))
    return report.merge_streams(e)


QUERIES = {f.__name__: f for f in (site_verdicts, site_lines, target_counts, target_first_sites, report_places, callable_arity, overload_arity, overload_bindings, callee_list, calling_tests, word_accounting, nearest_owners,
                                   nearest_declarations, unique_starts, paired_calls, sibling_conventions, test_commands, shortened_names, symbols_page, turns, name_uses, merged_event_order)}

_FAM = facts.family_sql
_FOLDER = "CASE WHEN {0} LIKE '%/%' THEN regexp_replace({0}, '/[^/]*$', '') WHEN {0} IS NOT NULL THEN '' END"
_CALL = "('function', 'method', 'constructor')"
_V = f"""{facts.IDENTIFIERS_SQL}, st AS (SELECT i.*, {_FAM("f.language")} AS fam, {_FOLDER.format("i.path")} AS folder FROM i JOIN f USING (file_id)),
dd AS (SELECT symbol_id, name, file_id, {_FOLDER.format("path")} AS folder, {_FAM("language")} AS fam FROM s WHERE kind IN {_CALL} AND name IS NOT NULL),
d0 AS (SELECT name, count(*) AS n FROM dd GROUP BY ALL), d1 AS (SELECT name, fam, count(*) AS n, min(symbol_id) AS id FROM dd GROUP BY ALL),
d2 AS (SELECT name, fam, folder, count(*) AS n, min(symbol_id) AS id FROM dd GROUP BY ALL), d3 AS (SELECT name, fam, file_id, count(*) AS n, min(symbol_id) AS id FROM dd GROUP BY ALL),
v AS (SELECT st.file_id, st.path, st.line, st.name, st.fam, CASE WHEN d0.n IS NULL THEN 'external' WHEN d1.n IS NULL THEN 'excluded' WHEN d3.n = 1 OR d2.n = 1 THEN 'proven' WHEN d1.n = 1 THEN 'likely' ELSE 'unresolved' END AS label,
  CASE WHEN d0.n IS NULL THEN 'no definition' WHEN d1.n IS NULL THEN 'other language' WHEN d3.n = 1 THEN 'same file' WHEN d2.n = 1 THEN 'same package' WHEN d1.n = 1 THEN 'name only' ELSE d1.n || ' definitions' END AS basis,
  CASE WHEN d3.n = 1 THEN d3.id WHEN d2.n = 1 THEN d2.id WHEN d1.n = 1 THEN d1.id END AS target
  FROM st LEFT JOIN d0 USING (name) LEFT JOIN d1 ON d1.name = st.name AND d1.fam = st.fam LEFT JOIN d2 ON d2.name = st.name AND d2.fam = st.fam AND d2.folder = st.folder LEFT JOIN d3 ON d3.name = st.name AND d3.fam = st.fam AND d3.file_id = st.file_id)"""
_PARAMS = r"""ps AS (SELECT *, list_filter(list_filter(list_transform(string_split(regexp_extract(coalesce(signature, ''), '[A-Za-z0-9_>]\s*\(([^()]*)\)', 1), ','), lambda x: trim(x)), lambda x: x <> ''),
  lambda x: NOT regexp_matches(x, '^(&?(mut )?self|&?''\w+ self|self|cls|this)$')) AS p FROM s WHERE kind IN ('function', 'method', 'constructor') AND contains(signature, '(')),
ar AS (SELECT symbol_id, name, file_id, kind, parent_symbol_id, len(list_filter(p, lambda x: NOT regexp_matches(x, '=|\?:|\?$|^\*|^\.\.\.|\.\.\.')))::INTEGER AS least,
  CASE WHEN len(list_filter(p, lambda x: regexp_matches(x, '^\*|^\.\.\.|\.\.\.'))) = 0 THEN len(p)::INTEGER END AS most FROM ps)"""
_RANK = "CASE label WHEN 'proven' THEN 0 WHEN 'likely' THEN 1 WHEN 'unresolved' THEN 2 WHEN 'excluded' THEN 3 ELSE 4 END"
_ROWS = rf"""{_PARAMS}, ca AS (SELECT DISTINCT file_id, line, name, CASE WHEN trim(inn) = '' THEN 0 ELSE len(string_split(trim(inn), ',')) END::INTEGER AS args FROM (
    SELECT file_id, line, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\(([^()]*)\)', 1)) AS name, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\(([^()]*)\)', 2)) AS inn FROM l)),
sv AS (SELECT file_id, name FROM s WHERE kind IN {_CALL} GROUP BY ALL HAVING count(*) > 1),
fit AS (SELECT c.file_id, c.name, c.args FROM (SELECT DISTINCT file_id, name, args FROM ca JOIN sv USING (file_id, name)) c JOIN ar USING (file_id, name) WHERE c.args >= least AND (most IS NULL OR c.args <= most) GROUP BY ALL HAVING count(*) = 1),
bo AS (SELECT DISTINCT file_id, line, name FROM ca JOIN fit USING (file_id, name, args)),
rw AS (SELECT v.*, i."column", sv.name IS NOT NULL AND bo.name IS NULL AS other_overload, target IS NOT NULL AS claimed FROM v JOIN i USING (file_id, line, name) LEFT JOIN sv USING (file_id, name) LEFT JOIN bo USING (file_id, line, name))"""
_UPS = "unnest(list_distinct([array_to_string(string_split(folder, '/')[1:k], '/') for k in generate_series(0, len(string_split(folder, '/')))])) AS prefix"
SQL = {
    "site_verdicts": rf"""WITH {_V}, {_PARAMS}, ca AS (SELECT file_id, line, name, CASE WHEN trim(inn) = '' THEN 0 ELSE len(string_split(trim(inn), ',')) END AS args FROM (
        SELECT file_id, line, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\(([^()]*)\)', 1)) AS name, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\(([^()]*)\)', 2)) AS inn FROM l)),
      bad AS (SELECT v.file_id, v.line, v.name FROM v JOIN ca USING (file_id, line, name) JOIN ar ON ar.symbol_id = v.target WHERE label = 'likely' GROUP BY ALL HAVING NOT bool_or(args >= least AND (most IS NULL OR args <= most)))
      SELECT v.file_id, v.path, v.line, v.name, CASE WHEN bad.name IS NOT NULL AND label = 'likely' THEN 'excluded' ELSE label END AS label, CASE WHEN bad.name IS NOT NULL AND label = 'likely' THEN 'argument count' ELSE basis END AS basis, target
      FROM v LEFT JOIN bad USING (file_id, line, name)""",
    "site_lines": f"""WITH {_V}, {_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY {_RANK}, NOT other_overload, NOT claimed, "column", name, label, basis) AS rn, count(*) OVER (PARTITION BY path, line) AS names FROM rw)
      SELECT path, line, name, label, basis, "column", names, line AS end_line FROM r WHERE rn = 1""",
    "target_counts": f"""WITH {_V}, ti AS (SELECT target, count(*) FILTER (label = 'proven') AS proven, count(*) FILTER (label = 'likely') AS likely, count(*) FILTER (label = 'excluded') AS excluded FROM v WHERE target IS NOT NULL GROUP BY target),
      un AS (SELECT name, fam, count(*) AS n FROM v WHERE label = 'unresolved' GROUP BY ALL), ud AS (SELECT dd.symbol_id AS target, un.n AS unresolved FROM dd JOIN un USING (name, fam))
      SELECT target, coalesce(proven, 0) AS proven, coalesce(likely, 0) AS likely, coalesce(unresolved, 0) AS unresolved, coalesce(excluded, 0) AS excluded FROM ti FULL JOIN ud USING (target)""",
    "target_first_sites": f"""WITH {_V}, r AS (SELECT target, label, path, line, row_number() OVER (PARTITION BY target, label ORDER BY path, line, name)::INTEGER AS place FROM v WHERE target IS NOT NULL) SELECT * FROM r WHERE place <= 8""",
    "report_places": f"""WITH {_V}, {_ROWS}, o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {_RANK}, path, line, "column", name)::INTEGER AS place FROM rw WHERE target IS NOT NULL)
      SELECT target, path, line, name, label, place, min(place) OVER (PARTITION BY target, path) AS first FROM o""",
    "callable_arity": f"WITH {facts.SYMBOLS_SQL}, {_PARAMS} SELECT symbol_id, least, most FROM ar",
    "overload_arity": f"WITH {facts.SYMBOLS_SQL}, {_PARAMS} SELECT name, file_id, kind, parent_symbol_id, min(least) AS least, CASE WHEN NOT bool_or(most IS NULL) THEN max(most) END AS most, count(*) AS members FROM ar GROUP BY ALL",
    "overload_bindings": rf"""WITH {facts.SYMBOLS_SQL}, {facts.LINES_SQL}, {_PARAMS}, ca AS (SELECT DISTINCT file_id, line, name, CASE WHEN trim(inn) = '' THEN 0 ELSE len(string_split(trim(inn), ',')) END::INTEGER AS args FROM (
        SELECT file_id, line, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\(([^()]*)\)', 1)) AS name, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\(([^()]*)\)', 2)) AS inn FROM l)),
      sv AS (SELECT file_id, name FROM s WHERE kind IN ('function', 'method', 'constructor') GROUP BY ALL HAVING count(*) > 1),
      fit AS (SELECT c.file_id, c.name, c.args, min(ar.symbol_id) AS symbol_id FROM (SELECT DISTINCT file_id, name, args FROM ca JOIN sv USING (file_id, name)) c JOIN ar USING (file_id, name) WHERE c.args >= least AND (most IS NULL OR c.args <= most) GROUP BY ALL HAVING count(*) = 1)
      SELECT file_id, line, name, args, symbol_id FROM ca JOIN fit USING (file_id, name, args)""",
    "callee_list": f"""WITH {facts.EDGES_SQL}, c AS (SELECT from_symbol_id, to_symbol_id, min(line) AS first_line FROM e WHERE to_symbol_id IS NOT NULL GROUP BY ALL),
      o AS (SELECT *, row_number() OVER (PARTITION BY from_symbol_id ORDER BY first_line, to_symbol_id)::INTEGER AS place FROM c) SELECT * FROM o WHERE place <= 10""",
    "calling_tests": f"WITH {facts.EDGES_SQL} SELECT DISTINCT e.to_symbol_id AS symbol_id, e.from_symbol_id AS test_id FROM e JOIN s ON s.symbol_id = e.from_symbol_id AND s.is_test WHERE to_symbol_id <> from_symbol_id",
    "word_accounting": f"""WITH {facts.IDENTIFIERS_SQL}, w AS (SELECT DISTINCT path, line, unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+')) AS name FROM l),
      x AS (SELECT w.name, EXISTS (SELECT 1 FROM i WHERE i.path = w.path AND i.line = w.line AND i.name = w.name) AS st, EXISTS (SELECT 1 FROM s WHERE s.path = w.path AND s.start_line = w.line AND s.name = w.name) AS df FROM w WHERE w.name IN (SELECT name FROM s))
      SELECT name, count(*) FILTER (st) AS site, count(*) FILTER (df AND NOT st) AS definition, count(*) FILTER (NOT st AND NOT df) AS text FROM x GROUP BY name""",
    "nearest_owners": f"""WITH {facts.IDENTIFIERS_SQL}, ow AS (SELECT symbol_id, name, {_FOLDER.format("path")} AS folder FROM s WHERE kind IN {_CALL} AND name IS NOT NULL AND path IS NOT NULL),
      op AS (SELECT name, prefix, count(DISTINCT symbol_id) AS n, min(symbol_id) AS owner_id FROM (SELECT symbol_id, name, {_UPS} FROM ow) GROUP BY ALL),
      w AS (SELECT id, name, {_UPS} FROM (SELECT concat_ws(':', path, line, name) AS id, name, {_FOLDER.format("path")} AS folder FROM i)),
      b AS (SELECT id, arg_max(n, len(prefix)) AS n, arg_max(owner_id, len(prefix)) AS owner_id FROM w JOIN op USING (name, prefix) GROUP BY id) SELECT id, owner_id FROM b WHERE n = 1""",
    "nearest_declarations": f"""WITH {facts.IDENTIFIERS_SQL}, r AS (SELECT concat_ws(':', i.path, i.line, i.name) AS site, s.symbol_id AS declaration, row_number() OVER (PARTITION BY i.path, i.line, i.name ORDER BY s.start_line > i.line, abs(s.start_line - i.line), s.symbol_id) AS rn
      FROM i JOIN s ON s.file_id = i.file_id AND s.name = i.name AND s.start_line IS NOT NULL) SELECT site, declaration FROM r WHERE rn = 1""",
    "unique_starts": f"WITH {facts.SYMBOLS_SQL} SELECT path, start_line AS line, min(symbol_id) AS symbol_id FROM s WHERE path IS NOT NULL AND start_line IS NOT NULL GROUP BY path, start_line HAVING count(*) = 1",
    # each call takes its turn: the first identifier after the one taken last that does not stand before the call
    "paired_calls": f"""WITH RECURSIVE {facts.EDGES_SQL}, a AS (SELECT concat_ws(':', e.path, line, e.name) AS edge, from_symbol_id AS caller, e.name, line, greatest(s.end_line, line) AS upto,
        row_number() OVER (PARTITION BY from_symbol_id, e.name ORDER BY line, concat_ws(':', e.path, line, e.name)) AS k FROM e JOIN s ON s.symbol_id = e.from_symbol_id),
      b AS (SELECT concat_ws(':', path, line, name) AS use, containing_symbol_id AS caller, name, line, row_number() OVER (PARTITION BY containing_symbol_id, name ORDER BY line, concat_ws(':', path, line, name)) AS no FROM i WHERE containing_symbol_id IS NOT NULL),
      t AS (SELECT caller, name, 0::BIGINT AS k, 0::BIGINT AS taken FROM a WHERE k = 1
        UNION ALL SELECT t.caller, t.name, a.k, (SELECT min(no) FROM b WHERE b.caller = t.caller AND b.name = t.name AND b.no > t.taken AND b.line >= a.line) FROM t JOIN a ON a.caller = t.caller AND a.name = t.name AND a.k = t.k + 1 WHERE t.taken IS NOT NULL)
      SELECT a.edge, b.use FROM t JOIN a USING (caller, name, k) JOIN b ON b.caller = t.caller AND b.name = t.name AND b.no = t.taken WHERE a.upto IS NULL OR b.line <= a.upto""",
    "sibling_conventions": rf"""WITH {facts.SYMBOLS_SQL}, m AS (SELECT DISTINCT symbol_id, parent_symbol_id, kind, unnest(regexp_extract_all(signature, '\b(pub|export|static|async|public|private|final|def|func|fn)\b', 1)) AS mark FROM s WHERE parent_symbol_id IS NOT NULL),
      n AS (SELECT parent_symbol_id, kind, count(*) AS siblings FROM s WHERE parent_symbol_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
      SELECT m.parent_symbol_id, m.kind, mark, count(*) AS carriers, max(siblings) AS siblings FROM m JOIN n USING (parent_symbol_id, kind) GROUP BY ALL HAVING 3 * count(*) >= 2 * max(siblings)""",
    "test_commands": f"""WITH {facts.SYMBOLS_SQL} SELECT symbol_id, CASE WHEN language = 'python' THEN 'pytest ' || path || '::' || name WHEN language = 'rust' THEN 'cargo test ' || name WHEN language = 'go' THEN 'go test ./' || {_FOLDER.format("path")} || ' -run ''^' || name || '$'''
      WHEN language IN ('javascript', 'typescript') THEN 'npx jest ' || path || ' -t ''' || name || '''' WHEN language = 'java' THEN 'mvn test -Dtest=' || regexp_extract(path, '([^/]*)\\.[^.]*$', 1) || '#' || name WHEN language = 'csharp' THEN 'dotnet test --filter ' || name END AS command
      FROM s WHERE is_test AND kind IN ('function', 'method') AND name IS NOT NULL AND path IS NOT NULL""",
    "shortened_names": f"""WITH {facts.SYMBOLS_SQL}, r AS (SELECT path, name, sum(len(name)) OVER w AS upto, row_number() OVER w AS rn FROM s WHERE path IS NOT NULL AND name IS NOT NULL WINDOW w AS (PARTITION BY path ORDER BY start_line NULLS LAST, symbol_id ROWS UNBOUNDED PRECEDING))
      SELECT path, coalesce(string_agg(name, ', ' ORDER BY rn) FILTER (upto <= 60), '') AS shown, count(*) FILTER (upto > 60) AS more FROM r GROUP BY path""",
    "symbols_page": f"WITH {facts.SYMBOLS_SQL} SELECT symbol_id, name, (SELECT count(*) FROM s) AS total FROM s ORDER BY symbol_id LIMIT 20 OFFSET 40",
    "turns": f"WITH {facts.SYMBOLS_SQL}, r AS (SELECT path, symbol_id, row_number() OVER (PARTITION BY path ORDER BY symbol_id)::INTEGER AS turn FROM s WHERE path IS NOT NULL) SELECT * FROM r WHERE turn <= 2",
    "name_uses": f"WITH {facts.IDENTIFIERS_SQL} SELECT name, sum(uses)::BIGINT AS uses FROM i GROUP BY name",
    "merged_event_order": "SELECT user_id AS path, event_id AS seq, epoch_us(ts) AS time, max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS place_time FROM events",
}
