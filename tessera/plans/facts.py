"""Fact tables for the code operators, from the driver's tables.

symbols and files are given. What an extractor would add (identifiers, resolved and pending edges) is derived from the
source texts by one rule, here for Spark and below for DuckDB: a name in front of an opening bracket is used in its line by
the innermost callable around it; if exactly one callable of that name is known the edge is resolved, else it is pending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import CALLABLE, family, language
from tessera.operators.intervals import innermost
from tessera.session import once
from tessera.sources.tables import table

#: Words in front of a bracket that are no calls.
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "def", "match", "elif", "and", "or", "not", "in", "Ok", "Err", "Some", "len")


def files(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "files")
    return f.groupBy("file_id").agg(*[F.max(c).alias(c) for c in ("path", "language", "content_hash", "content_bytes", "line_count")])


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Each symbol once, with its file's path and one spelling of its language. Copies of a row differ in nulls alone.
    Written once, as are identifiers and edges: they are the index that all queries share."""
    return once(spark, folder, "symbols", ("symbols", "files"), lambda: _symbols(spark, folder))


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "symbols")
    parent = F.when(F.trim("parent_symbol_id") != "", F.col("parent_symbol_id")).alias("parent_symbol_id")
    doc = F.when(F.trim("doc_comment") != "", F.col("doc_comment")).alias("doc_comment")
    cols = ["file_id", "name", "kind", "signature", "visibility", "start_line", "end_line", "start_byte", "end_byte", "body_start_line", "body_end_line", "body_start_byte", "body_end_byte", "body_hash",
            "is_test", "test_container", "metadata_json", "test_lifecycle"]
    s = s.select("symbol_id", *cols, parent, doc, language(F.col("language")).alias("language"))
    one = s.groupBy("symbol_id").agg(*[F.max(c).alias(c) for c in s.columns if c != "symbol_id"])
    return one.join(files(spark, folder).select("file_id", "path"), "file_id", "left")


def search_fields(spark: SparkSession, folder: str) -> DataFrame:
    """What a search looks at: each symbol once, with its name, kind, signature and documentation as symbols() has them. A
    narrow table of its own, as neither files nor other columns need be shuffled for it."""
    return once(spark, folder, "search_fields", ("symbols",), lambda: _search_fields(spark, folder), spread=False)


def _search_fields(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.when(F.trim("doc_comment") != "", F.col("doc_comment")).alias("doc_comment")
    s = table(spark, folder, "symbols").select("symbol_id", "name", "kind", "signature", doc)
    return s.groupBy("symbol_id").agg(*[F.max(c).alias(c) for c in s.columns if c != "symbol_id"])


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, path, line (from 1), text."""
    t = table(spark, folder, "source_texts").groupBy("file_id").agg(F.max("path").alias("path"), F.max("content").alias("content"))
    return t.select("file_id", "path", F.posexplode(F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n")).alias("pos", "text")).select(
        "file_id", "path", (F.col("pos") + 1).alias("line"), "text")


def identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, path, line, name, uses, column (of its first use, from 0), containing_symbol_id (the innermost callable
    around the line, null outside)."""
    return once(spark, folder, "identifiers", ("symbols", "files", "source_texts"), lambda: _identifiers(spark, folder))


def _identifiers(spark: SparkSession, folder: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), 1)
    used = lines(spark, folder).select("file_id", "path", "line", "text", F.explode(found).alias("name"))
    used = used.where(~F.col("name").isin(*NO_CALLS)).groupBy("file_id", "path", "line", "name").agg(
        F.count("*").alias("uses"), F.min(F.expr("instr(text, concat(name, '('))") - 1).alias("column"))
    defs = symbols(spark, folder).select("file_id", "symbol_id", F.col("name").alias("def_name"), "kind", "start_line", "end_line")
    own = defs.select("file_id", F.col("start_line").alias("line"), F.col("def_name").alias("name"))
    used = used.join(own, ["file_id", "line", "name"], "left_anti")
    inside = defs.where(F.col("kind").isin(*CALLABLE)).select("file_id", F.col("symbol_id").alias("span"), "start_line", "end_line")
    inner = innermost(used, inside, "file_id").withColumnRenamed("span", "containing_symbol_id")
    return used.join(inner, ["file_id", "line"], "left").select("file_id", "path", "line", "name", "uses", "column", "containing_symbol_id")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """from_symbol_id, name, path, file_id, line, to_symbol_id (null: pending), candidates (callables of that name in the
    language family)."""
    return once(spark, folder, "edges", ("symbols", "files", "source_texts"), lambda: _edges(spark, folder))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    s = symbols(spark, folder).where(F.col("kind").isin(*CALLABLE))
    defs = s.select("name", family(F.col("language")).alias("fam"), "symbol_id").groupBy("name", "fam").agg(F.count("*").alias("candidates"), F.min("symbol_id").alias("one"))
    i = identifiers(spark, folder).where("containing_symbol_id IS NOT NULL")
    fam = s.select(F.col("symbol_id").alias("containing_symbol_id"), family(F.col("language")).alias("fam"))
    j = i.join(fam, "containing_symbol_id").join(defs, ["name", "fam"], "left")
    return j.select(F.col("containing_symbol_id").alias("from_symbol_id"), "name", "path", "file_id", "line", F.when(F.col("candidates") == 1, F.col("one")).alias("to_symbol_id"),
                    F.coalesce("candidates", F.lit(0)).alias("candidates"))


def resolved(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst): who calls whom, each pair once."""
    e = lambda: edges(spark, folder).where("to_symbol_id IS NOT NULL").select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst")).distinct()
    return once(spark, folder, "resolved", ("symbols", "files", "source_texts"), e)


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """The calls with what stands in front of their names: site, file_id, path, line, name, receiver (after the last dot),
    namespace (names in front of `::`, and of the receiver), args (commas and one, 0 for empty brackets; null where brackets nest), from_symbol_id, language."""
    return once(spark, folder, "calls", ("symbols", "files", "source_texts"), lambda: _calls(spark, folder))


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    pat = F.lit(r"((?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*)([A-Za-z_][A-Za-z0-9_]*)\(([^()]*\))?")
    group = lambda k, name: F.regexp_extract_all("text", pat, k).alias(name)
    z = lines(spark, folder).select("file_id", "path", "line", F.explode(F.arrays_zip(group(1, "front"), group(2, "name"), group(3, "inner"))).alias("z")).select("file_id", "path", "line", "z.*")
    args = F.when(F.col("inner") == "", None).when(F.trim(F.expr("substring(inner, 1, length(inner) - 1)")) == "", 0).otherwise(F.length("inner") - F.length(F.replace("inner", F.lit(","))) + 1)
    z = z.select("file_id", "path", "line", "front", "name", args.cast("int").alias("args")).groupBy("file_id", "path", "line", "front", "name").agg(F.when(F.count("*") == F.count("args"), F.max("args")).alias("args"))
    i = identifiers(spark, folder).where("containing_symbol_id IS NOT NULL").select("file_id", "line", "name", F.col("containing_symbol_id").alias("from_symbol_id"))
    parts = F.filter(F.split("front", r"\.|::"), lambda x: x != "")
    dotted = F.endswith("front", F.lit("."))
    receiver = F.when(dotted, F.element_at(parts, -1))
    namespace = F.when(dotted, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    lang = files(spark, folder).select("file_id", language(F.col("language")).alias("language"))
    j = z.join(i, ["file_id", "line", "name"]).join(lang, "file_id")
    return j.select(F.concat_ws(":", "path", "line", "front", "name").alias("site"), "file_id", "path", "line", "name", receiver.alias("receiver"), namespace.alias("namespace"), "args", "from_symbol_id", "language")


def variables(spark: SparkSession, folder: str) -> DataFrame:
    """(scope, name, type): parameters of callables with a type of their own, as their signatures declare them: name: Type
    or Type name."""
    s = symbols(spark, folder).where(F.col("kind").isin(*CALLABLE))
    one = lambda pat, a, b: F.arrays_zip(F.regexp_extract_all("signature", F.lit(pat), a).alias("name"), F.regexp_extract_all("signature", F.lit(pat), b).alias("type"))
    both = F.concat(one(r"([a-z_][A-Za-z0-9_]*)\s*:\s*&?([A-Z][A-Za-z0-9_]*)", 1, 2), one(r"[(,]\s*(?:const |final )?([A-Z][A-Za-z0-9_]*)[ *&]+([a-z_][A-Za-z0-9_]*)", 2, 1))
    return s.select(F.col("symbol_id").alias("scope"), F.explode(both).alias("v")).select("scope", "v.name", "v.type").distinct()


_LANG = "CASE lower(trim(language)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (("py", "python"), ("js", "javascript"), ("ts", "typescript"), ("golang", "go"), ("c#", "csharp"))) + " ELSE lower(trim(language)) END"


def family_sql(column: str) -> str:
    return (f"CASE WHEN {column} IN ('javascript', 'typescript', 'tsx', 'jsx', 'vue') THEN 'js' WHEN {column} IN ('java', 'kotlin') THEN 'jvm' "
            f"WHEN {column} IN ('csharp', 'vbnet', 'razor') THEN 'dotnet' WHEN {column} IN ('c', 'cpp') THEN 'c' ELSE {column} END")


_CALL = "('function', 'method', 'constructor')"
FILES_SQL = "f AS (SELECT file_id, max(path) AS path, max(language) AS language, max(content_hash) AS content_hash, max(content_bytes) AS content_bytes, max(line_count) AS line_count FROM files GROUP BY file_id)"
SYMBOLS_SQL = f"""{FILES_SQL},
s0 AS (SELECT symbol_id, max(file_id) AS file_id, max(name) AS name, max(kind) AS kind, max(signature) AS signature, max(visibility) AS visibility, max(start_line) AS start_line, max(end_line) AS end_line,
  max(start_byte) AS start_byte, max(end_byte) AS end_byte, max(body_start_line) AS body_start_line, max(body_end_line) AS body_end_line, max(body_hash) AS body_hash, max(is_test) AS is_test, max(test_container) AS test_container,
  max(body_start_byte) AS body_start_byte, max(body_end_byte) AS body_end_byte, max(metadata_json) AS metadata_json, max(test_lifecycle) AS test_lifecycle,
  max(CASE WHEN trim(parent_symbol_id) <> '' THEN parent_symbol_id END) AS parent_symbol_id, max(CASE WHEN trim(doc_comment) <> '' THEN doc_comment END) AS doc_comment, max({_LANG}) AS language
  FROM symbols GROUP BY symbol_id),
s AS (SELECT s0.*, f.path FROM s0 LEFT JOIN f USING (file_id))"""
LINES_SQL = r"""l AS (SELECT file_id, path, unnest(parts) AS text, generate_subscripts(parts, 1)::INTEGER AS line
  FROM (SELECT file_id, max(path) AS path, string_split(replace(max(content), chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM source_texts GROUP BY file_id))"""
IDENTIFIERS_SQL = rf"""{SYMBOLS_SQL}, {LINES_SQL},
u0 AS (SELECT file_id, path, line, text, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS name FROM l),
u1 AS (SELECT file_id, path, line, name, count(*) AS uses, min(strpos(text, name || '('))::INTEGER - 1 AS "column" FROM u0 WHERE name NOT IN ({", ".join(f"'{x}'" for x in NO_CALLS)}) GROUP BY ALL),
u AS (SELECT * FROM u1 WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.file_id = u1.file_id AND s.start_line = u1.line AND s.name = u1.name)),
i AS (SELECT u.*, c.symbol_id AS containing_symbol_id FROM u LEFT JOIN (
  SELECT u.file_id, u.line, u.name, s.symbol_id, row_number() OVER (PARTITION BY u.file_id, u.line, u.name ORDER BY s.start_line DESC, s.end_line, s.symbol_id) AS rn
  FROM u JOIN s ON s.file_id = u.file_id AND s.kind IN {_CALL} AND u.line BETWEEN s.start_line AND s.end_line) c
  ON c.file_id = u.file_id AND c.line = u.line AND c.name = u.name AND c.rn = 1)"""
EDGES_SQL = f"""{IDENTIFIERS_SQL},
d AS (SELECT name, {family_sql("language")} AS fam, count(*) AS candidates, min(symbol_id) AS one FROM s WHERE kind IN {_CALL} AND name IS NOT NULL GROUP BY ALL),
e AS (SELECT i.containing_symbol_id AS from_symbol_id, i.name, i.path, i.file_id, i.line, CASE WHEN d.candidates = 1 THEN d.one END AS to_symbol_id, coalesce(d.candidates, 0) AS candidates
  FROM i JOIN s ON s.symbol_id = i.containing_symbol_id LEFT JOIN d ON d.name = i.name AND d.fam = {family_sql("s.language")})"""
CALLS_SQL = rf"""{IDENTIFIERS_SQL},
c0 AS (SELECT file_id, path, line, unnest(regexp_extract_all(text, '((?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*)([A-Za-z_][A-Za-z0-9_]*)\(([^()]*\))?', 1)) AS front,
  unnest(regexp_extract_all(text, '((?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*)([A-Za-z_][A-Za-z0-9_]*)\(([^()]*\))?', 2)) AS name,
  unnest(regexp_extract_all(text, '((?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*)([A-Za-z_][A-Za-z0-9_]*)\(([^()]*\))?', 3)) AS inn FROM l),
c1 AS (SELECT file_id, path, line, front, name, CASE WHEN count(*) = count(args) THEN max(args) END AS args FROM (SELECT *, CASE WHEN inn = '' OR inn IS NULL THEN NULL WHEN trim(inn[:-2]) = '' THEN 0 ELSE len(inn) - len(replace(inn, ',', '')) + 1 END::INTEGER AS args FROM c0) GROUP BY ALL),
c AS (SELECT concat_ws(':', c1.path, c1.line, front, c1.name) AS site, c1.file_id, c1.path, c1.line, c1.name, CASE WHEN ends_with(front, '.') THEN pa[-1] END AS receiver, CASE WHEN ends_with(front, '.') THEN pa[:-2] ELSE pa END AS namespace, args,
    i.containing_symbol_id AS from_symbol_id, CASE lower(trim(f.language)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'golang' THEN 'go' WHEN 'c#' THEN 'csharp' ELSE lower(trim(f.language)) END AS language
  FROM (SELECT *, list_filter(regexp_split_to_array(front, '\.|::'), lambda x: x <> '') AS pa FROM c1) c1 JOIN i ON i.file_id = c1.file_id AND i.line = c1.line AND i.name = c1.name AND i.containing_symbol_id IS NOT NULL JOIN f ON f.file_id = c1.file_id),
vr AS (SELECT DISTINCT scope, name, type FROM (
  SELECT symbol_id AS scope, unnest(regexp_extract_all(signature, '([a-z_][A-Za-z0-9_]*)\s*:\s*&?([A-Z][A-Za-z0-9_]*)', 1)) AS name, unnest(regexp_extract_all(signature, '([a-z_][A-Za-z0-9_]*)\s*:\s*&?([A-Z][A-Za-z0-9_]*)', 2)) AS type FROM s WHERE kind IN {_CALL}
  UNION ALL SELECT symbol_id, unnest(regexp_extract_all(signature, '[(,]\s*(?:const |final )?([A-Z][A-Za-z0-9_]*)[ *&]+([a-z_][A-Za-z0-9_]*)', 2)), unnest(regexp_extract_all(signature, '[(,]\s*(?:const |final )?([A-Z][A-Za-z0-9_]*)[ *&]+([a-z_][A-Za-z0-9_]*)', 1)) FROM s WHERE kind IN {_CALL}))"""
