"""Lookup and search queries over symbols, with their SQL. The queries are the names of the symbols whose id, as a number,
is divisible by 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.names import STOP_WORDS, tokens
from tessera.functions.stem import stems
from tessera.operators import lookup
from tessera.plans import facts


def _asked(s):
    return s.where((F.conv(F.substring("symbol_id", 1, 8), 16, 10).cast("bigint") % 20 == 0) & F.col("name").isNotNull())


def lookup_names(spark, folder):
    """Parts of names, without the first two characters, and their first one and two characters as queries."""
    s = facts.symbols(spark, folder)
    q = _asked(s).select(F.explode(F.array(F.substring("name", 3, 12), F.substring("name", 1, 1), F.substring("name", 1, 2))).alias("query")).distinct()
    return lookup.by_name(s, q)


def lookup_qualified(spark, folder):
    s = facts.symbols(spark, folder)
    p = s.select(F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("owner"))
    q = _asked(s).join(p, "parent_symbol_id").select(F.concat_ws("::", "owner", "name").alias("query"))
    return lookup.qualified(s, q)


def lookup_members(spark, folder):
    return lookup.members(facts.symbols(spark, folder))


def overload_groups(spark, folder):
    return lookup.overloads(facts.symbols(spark, folder))


def name_suggestions(spark, folder):
    """Names that lack their second character, short ones included."""
    s = facts.symbols(spark, folder)
    asked = _asked(s).select(F.concat(F.substring("name", 1, 1), F.expr("substring(name, 3)")).alias("asked"))
    return lookup.suggestions(s, asked)


def document_frequencies(spark, folder):
    return lookup.document_frequency(lookup.postings(lookup.searchable(facts.symbols(spark, folder))))


def ranked_search(spark, folder):
    """Over names that carry the two rarest words of a query; ranked_recall looks in all fields."""
    s = facts.symbols(spark, folder)
    return lookup.search(s, _asked(s).select(F.col("name").alias("query")))


def ranked_recall(spark, folder):
    s = facts.search_fields(spark, folder)
    return lookup.search_all_fields(s, _asked(s).select(F.col("name").alias("query")))


def file_suggestions(spark, folder):
    """For paths that exist, files of the same stem alone; misspelt_files has those within two edits."""
    f = facts.files(spark, folder)
    return lookup.similar_files(f, f.select(F.col("path").alias("asked")))


def misspelt_files(spark, folder):
    """Paths whose file name lacks its second character."""
    f = facts.files(spark, folder)
    return lookup.near_files(f, f.select(F.regexp_replace("path", r"([^/\\])[^/\\]([^/\\]*)$", "$1$2").alias("asked")).distinct())


def name_stems(spark, folder):
    return facts.symbols(spark, folder).where("name IS NOT NULL").select("symbol_id", F.array_join(stems(tokens(F.col("name"))), " ").alias("stems"))


QUERIES = {f.__name__: f for f in (lookup_names, lookup_qualified, lookup_members, overload_groups, name_suggestions, document_frequencies, ranked_search, ranked_recall, file_suggestions, misspelt_files, name_stems)}

_S = facts.SYMBOLS_SQL
_ASKED = "a AS (SELECT * FROM s WHERE ('0x' || substr(symbol_id, 1, 8))::BIGINT % 20 = 0 AND name IS NOT NULL)"
_TOKENS = "list_transform(regexp_extract_all(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]+[a-z]*|[a-z]+|[0-9]+|[^\\x00-\\x7F]+'), lambda x: lower(x))"
_INDEX = f"""px AS (SELECT DISTINCT symbol_id, unnest({_TOKENS.format("name")}) AS term, 3.0 AS credit FROM s
  UNION ALL SELECT DISTINCT symbol_id, lower(unnest(regexp_extract_all(concat_ws(' ', signature, substr(doc_comment, 1, 640)), '[A-Za-z]+'))), 1.0 FROM s),
cr AS (SELECT term, symbol_id, max(credit) AS credit FROM px GROUP BY ALL), df AS (SELECT term, least(count(*), 20000) AS df FROM cr GROUP BY term)"""
_STEM = "lower(regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '\\.[^.]*$', ''))"
SQL = {
    "lookup_names": f"""WITH {_S}, {_ASKED}, q AS (SELECT DISTINCT query FROM (SELECT unnest([substr(name, 3, 12), substr(name, 1, 1), substr(name, 1, 2)]) AS query FROM a) WHERE query <> ''),
      m AS (SELECT query, symbol_id, name, CASE WHEN lower(name) = lower(query) THEN 0 WHEN starts_with(lower(name), lower(query)) THEN 1 ELSE 2 END AS r FROM q, s
        WHERE contains(lower(name), lower(query))),
      o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY r, len(name), name, symbol_id)::INTEGER AS place FROM m)
      SELECT query, symbol_id, CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' ELSE 'contains' END AS match, place FROM o WHERE place <= 20""",
    "lookup_qualified": f"""WITH {_S}, {_ASKED}, q AS (SELECT DISTINCT p.name || '::' || a.name AS query, p.name AS owner, a.name AS name FROM a JOIN s p ON a.parent_symbol_id = p.symbol_id)
      SELECT query, s.symbol_id, count(*) OVER (PARTITION BY query) AS candidates FROM q JOIN s ON s.name = q.name JOIN s p ON p.symbol_id = s.parent_symbol_id AND p.name = q.owner""",
    "lookup_members": f"""WITH {_S} SELECT p.symbol_id AS owner_id, c.symbol_id, row_number() OVER (PARTITION BY p.symbol_id ORDER BY c.start_line NULLS LAST, c.start_byte NULLS LAST, c.symbol_id)::INTEGER AS place
      FROM s c JOIN s p ON c.parent_symbol_id = p.symbol_id WHERE p.kind IN ('class', 'struct', 'enum', 'interface', 'trait', 'record', 'union', 'module', 'namespace')""",
    "overload_groups": f"""WITH {_S}, c AS (SELECT symbol_id, count(*) OVER (PARTITION BY name, file_id, kind, parent_symbol_id) AS group_size FROM s WHERE kind IN ('function', 'method', 'constructor'))
      SELECT * FROM c WHERE group_size > 1""",
    "name_suggestions": f"""WITH {_S}, {_ASKED}, q AS (SELECT DISTINCT substr(name, 1, 1) || substr(name, 3) AS asked FROM a), n AS (SELECT name, bool_and(coalesce(kind = 'import', false)) AS imported FROM s WHERE name IS NOT NULL GROUP BY name),
      m AS (SELECT asked, name, imported, levenshtein(lower(asked), lower(name)) AS distance FROM q, n WHERE abs(len(asked) - len(name)) <= 2),
      o AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY distance, imported, name) AS rn FROM m WHERE distance BETWEEN 1 AND 2)
      SELECT asked, name, distance::INTEGER AS distance FROM o WHERE rn <= 3""",
    "document_frequencies": f"""WITH RECURSIVE {_S.replace("s AS (SELECT s0", "s_ AS (SELECT s0")}, lv AS (SELECT symbol_id, parent_symbol_id AS at, 1 AS d FROM s_ WHERE kind = 'variable' AND parent_symbol_id IS NOT NULL
        UNION ALL SELECT lv.symbol_id, p.parent_symbol_id, d + 1 FROM lv JOIN s_ p ON p.symbol_id = lv.at WHERE p.kind = 'variable' AND p.parent_symbol_id IS NOT NULL AND p.parent_symbol_id <> lv.symbol_id AND d < 1000),
      s AS (SELECT * FROM s_ WHERE symbol_id NOT IN (SELECT lv.symbol_id FROM lv JOIN s_ p ON p.symbol_id = lv.at WHERE p.kind IN ('function', 'method', 'constructor'))), {_INDEX} SELECT term, df FROM df""",
    "ranked_search": f"""WITH {_S}, {_ASKED}, {_INDEX}, total AS (SELECT count(*) AS n FROM s),
      q0 AS (SELECT DISTINCT name AS query, list_distinct({_TOKENS.format("name")}) AS t FROM a),
      q AS (SELECT query, CASE WHEN len(list_filter(t, lambda x: NOT list_contains({list(STOP_WORDS)!r}, x))) > 0 THEN list_filter(t, lambda x: NOT list_contains({list(STOP_WORDS)!r}, x)) ELSE t END AS terms FROM q0),
      qt AS (SELECT query, x.term, coalesce(df.df, 0) AS df FROM (SELECT query, unnest(terms) AS term FROM q) x LEFT JOIN df USING (term)),
      rare AS (SELECT query, list(term) AS two FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY df, term) AS rn FROM qt) WHERE rn <= 2 GROUP BY query),
      nm AS (SELECT symbol_id, name, kind, list_distinct({_TOKENS.format("name")}) AS words FROM s),
      h AS (SELECT query, symbol_id FROM rare JOIN nm ON list_has_all(nm.words, rare.two)),
      sc AS (SELECT h.query, h.symbol_id, sum(cr.credit * ln(1 + n::DOUBLE / (qt.df + 1))) AS t FROM h JOIN qt USING (query) JOIN cr ON cr.term = qt.term AND cr.symbol_id = h.symbol_id, total GROUP BY ALL),
      z AS (SELECT sc.query, sc.symbol_id, nm.name, round(t + CASE WHEN list_has_all(words, terms) AND len(words) = len(terms) THEN CASE WHEN kind IN ('function', 'method', 'constructor', 'class', 'struct', 'enum', 'interface', 'trait', 'record', 'union', 'module', 'namespace')
        THEN 100 ELSE 60 END ELSE 0 END + CASE WHEN list_has_all(words, terms) THEN 60 ELSE 0 END, 6) AS score FROM sc JOIN nm USING (symbol_id) JOIN q USING (query)),
      o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name, symbol_id)::INTEGER AS place FROM z)
      SELECT query, symbol_id, score::DOUBLE AS score, place FROM o WHERE place <= 10""",
    "file_suggestions": f"WITH {facts.FILES_SQL} SELECT a.path AS asked, b.path FROM f a JOIN f b ON {_STEM.format('a.path')} = {_STEM.format('b.path')} WHERE a.path <> b.path",
}
