"""Scan queries over files and texts, with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tessera.functions.names import display_kind, in_path, is_test_name, is_test_path, last_segment, plain_identifier, tokens
from tessera.functions.paths import folder, shared_segments
from tessera.operators import scan
from tessera.plans import facts
from tessera.sources.tables import table


def excluded_paths(spark, folder_):
    p = facts.files(spark, folder_).select("path").unionByName(table(spark, folder_, "skipped_files").select("path").distinct())
    return p.where("path IS NOT NULL").select("path", scan.excluded(F.col("path")).alias("excluded"))


WORDS = ("batch", "return", "get_id", "i")


def text_scan(spark, folder_):
    """Several words, among them a common one and one letter."""
    found = [scan.find_word(facts.lines(spark, folder_), w).select(F.lit(w).alias("word"), "path", "line") for w in WORDS]
    return functools.reduce(lambda a, b: a.unionByName(b), found)


def symbol_slices(spark, folder_):
    t = scan.symbol_text(facts.symbols(spark, folder_), table(spark, folder_, "source_texts"))
    return t.select("symbol_id", F.octet_length("text").alias("bytes"), F.md5("text").alias("digest"))


def body_slices(spark, folder_):
    return scan.body_text(facts.symbols(spark, folder_), table(spark, folder_, "source_texts")).select("symbol_id", F.md5("text").alias("digest"))


def file_lookup(spark, folder_):
    """Paths as the symbols table spells them, matched with the files."""
    asked = table(spark, folder_, "symbols").select("path").where("path IS NOT NULL").distinct()
    return scan.match_paths(facts.files(spark, folder_), asked)


def outline_files(spark, folder_):
    return scan.outline(facts.symbols(spark, folder_).where("path IS NOT NULL"))


def unsupported_files(spark, folder_):
    return facts.files(spark, folder_).where("language = 'unsupported'").select("path")


def scope_files(spark, folder_):
    f = facts.files(spark, folder_)
    return f.where(in_path(F.col("path"), "MONOREPO\\")).select("path", F.size(F.split("path", "/")).alias("depth"))


def folder_rollup(spark, folder_):
    return scan.folder_counts(facts.files(spark, folder_), 3)


def content_hashes(spark, folder_):
    """Whether the text of a file still has its recorded length and hash; the recorded hashes are of a kind that is not
    known here, so each is also compared as the SHA-256 of its own text."""
    t = table(spark, folder_, "source_texts").groupBy("file_id").agg(F.max("content").alias("content"))
    j = facts.files(spark, folder_).join(t, "file_id")
    return j.select("file_id", F.sha2("content", 256).alias("sha256"), F.coalesce(F.octet_length("content") == F.col("content_bytes"), F.lit(False)).alias("same_size"),
                    scan.hash_matches(F.col("content"), F.col("content_hash")).alias("same_hash"), scan.hash_matches(F.col("content"), F.concat(F.lit("sha256:"), F.sha2("content", 256))).alias("own_hash"))


def path_facts(spark, folder_):
    f = facts.files(spark, folder_)
    return f.select("path", folder(F.col("path")).alias("folder"), is_test_path(F.col("path")).alias("is_test"), shared_segments(F.col("path"), F.lit("monorepo/exact-frontier-4/src/x.py")).alias("shared"))


def name_facts(spark, folder_):
    s = facts.symbols(spark, folder_)
    return s.select("symbol_id", plain_identifier(F.col("name")).alias("plain"), last_segment(F.col("name")).alias("last"), is_test_name(F.col("name")).alias("test_name"),
                    F.array_join(tokens(F.col("name")), " ").alias("tokens"), display_kind(F.col("kind"), F.col("language"), F.col("name")).alias("shown_kind"))


def reconcile_files(spark, folder_):
    """The texts as a walk sees them against the file table, one folder being unreadable."""
    t = table(spark, folder_, "source_texts").groupBy("file_id").agg(F.max("path").alias("path"), F.max("content").alias("content"))
    sk = table(spark, folder_, "skipped_files")
    f = facts.files(spark, folder_)
    seen = t.join(f.select("file_id", F.col("content_hash").alias("h")), "file_id", "left").select("path", F.octet_length("content").cast("bigint").alias("bytes"), F.col("h").alias("hash"), F.lit(None).cast("bigint").alias("mtime_ns"))
    late = sk.groupBy("path").agg(F.max(F.struct("mtime_ns", "content_bytes")).alias("m")).select("path", F.col("m.content_bytes").alias("bytes"), F.lit("").alias("hash"), F.col("m.mtime_ns").alias("mtime_ns"))
    new = late.select(F.concat("path", F.lit(".new")).alias("path"), "bytes", "hash", "mtime_ns")
    return scan.reconcile(seen.unionByName(late).unionByName(new), f.where("path IS NOT NULL"), sk, ("monorepo",))


def index_facts(spark, folder_):
    return facts.files(spark, folder_).agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))


QUERIES = {f.__name__: f for f in (excluded_paths, text_scan, symbol_slices, body_slices, file_lookup, outline_files, unsupported_files, scope_files, folder_rollup, content_hashes, path_facts, name_facts,
                                   reconcile_files, index_facts)}

_NORM = "translate(replace({0}, '\\', '/'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDER = "CASE WHEN path LIKE '%/%' OR contains(path, '\\') THEN regexp_replace(path, '[/\\\\][^/\\\\]*$', '') WHEN path IS NOT NULL THEN '' END"
_TEXT = "t AS (SELECT file_id, max(path) AS path, max(content) AS content FROM source_texts GROUP BY file_id)"
_LINES_OF = "string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))"


def _list(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


SQL = {
    "excluded_paths": f"""WITH {facts.FILES_SQL}, p AS (SELECT path FROM f WHERE path IS NOT NULL UNION ALL SELECT DISTINCT path FROM skipped_files WHERE path IS NOT NULL)
      SELECT path, list_has_any(string_split(path, '/'), [{_list(scan.EXCLUDED_FOLDERS)}]) OR len(list_filter([{_list(scan.EXCLUDED_ENDINGS)}], lambda x: ends_with(path, x))) > 0 AS excluded FROM p""",
    "text_scan": f"WITH {facts.LINES_SQL} SELECT DISTINCT word, path, line FROM l, (SELECT unnest({list(WORDS)!r}) AS word) WHERE regexp_matches(text, '(^|[^A-Za-z0-9_$])' || word || '($|[^A-Za-z0-9_$])')",
    "symbol_slices": f"""WITH {facts.SYMBOLS_SQL}, {_TEXT}, x AS (SELECT s.symbol_id, CASE WHEN start_byte IS NOT NULL AND end_byte IS NOT NULL THEN
        decode(array_slice(encode(content), start_byte + 1, end_byte)) ELSE array_to_string({_LINES_OF}[start_line:end_line], chr(10)) END AS text FROM s JOIN t USING (file_id))
      SELECT symbol_id, strlen(text)::INTEGER AS bytes, md5(text) AS digest FROM x""",
    "body_slices": f"""WITH {facts.SYMBOLS_SQL}, {_TEXT} SELECT symbol_id, md5(CASE WHEN body_start_byte <= body_end_byte THEN decode(array_slice(encode(content), body_start_byte + 1, body_end_byte)) ELSE array_to_string({_LINES_OF}[body_start_line:body_end_line], chr(10)) END) AS digest
      FROM s JOIN t USING (file_id) WHERE body_start_byte <= body_end_byte OR body_end_line >= body_start_line""",
    "file_lookup": f"""WITH {facts.FILES_SQL}, a AS (SELECT DISTINCT path AS asked FROM symbols WHERE path IS NOT NULL),
      j AS (SELECT asked, file_id, f.path, max((asked = f.path)::INT) OVER (PARTITION BY asked) AS best FROM a JOIN f ON {_NORM.format("asked")} = {_NORM.format("f.path")})
      SELECT asked, file_id, path FROM j WHERE (asked = path)::INT = best""",
    "outline_files": f"""WITH {facts.SYMBOLS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line NULLS LAST, symbol_id) AS rn FROM s WHERE path IS NOT NULL)
      SELECT path, count(*) AS definitions, count(*) FILTER (is_test) AS tests, count(*) FILTER (kind IN ('function', 'method', 'constructor')) AS callables, count(*) FILTER (lower(visibility) = 'private') AS hidden,
        coalesce(string_agg(name, ', ' ORDER BY rn) FILTER (rn <= 5), '') AS names FROM r GROUP BY path""",
    "unsupported_files": f"WITH {facts.FILES_SQL} SELECT path FROM f WHERE language = 'unsupported'",
    "scope_files": f"WITH {facts.FILES_SQL} SELECT path, len(string_split(path, '/'))::INTEGER AS depth FROM f WHERE starts_with({_NORM.format('path')}, 'monorepo/')",
    "folder_rollup": f"""WITH {facts.FILES_SQL}, p AS (SELECT string_split({_FOLDER}, '/') AS parts, content_bytes FROM f),
      x AS (SELECT array_to_string(parts[1:i], '/') AS folder, content_bytes FROM p, generate_series(1, 3) g(i) WHERE i <= len(parts))
      SELECT folder, count(*) AS files, sum(content_bytes)::BIGINT AS bytes FROM x GROUP BY folder""",
    "content_hashes": f"""WITH {facts.FILES_SQL}, {_TEXT} SELECT file_id, sha256(content) AS sha256, coalesce(strlen(content) = content_bytes, false) AS same_size,
      CASE WHEN regexp_matches(content_hash, '^(sha256:)?[0-9a-f]{{64}}$') THEN regexp_replace(content_hash, '^sha256:', '') = sha256(content) END AS same_hash, true AS own_hash FROM f JOIN t USING (file_id)""",
    "path_facts": f"""WITH {facts.FILES_SQL}, p AS (SELECT path, {_FOLDER} AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM f)
      SELECT path, folder, coalesce(regexp_matches(path, '(^|/)(test|tests|__tests__|autotests)/') OR regexp_matches(name, '^test_.*\\.(py|rb)$') OR regexp_matches(name, '_test\\.|\\.test\\.|\\.spec\\.|^tests?\\.rs$|^tst_') OR regexp_matches(name, 'Tests\\.cs$'), false) AS is_test,
        CASE WHEN folder = '' THEN 0 ELSE coalesce(len(list_filter(generate_series(1, 3), lambda i: string_split(folder, '/')[1:i] = ['monorepo', 'exact-frontier-4', 'src'][1:i] AND len(string_split(folder, '/')) >= i)), 0) END::INTEGER AS shared FROM p""",
    "name_facts": f"""WITH {facts.SYMBOLS_SQL} SELECT symbol_id, coalesce(regexp_matches(name, '^[A-Za-z_$][A-Za-z0-9_$]*$'), false) AS plain, regexp_extract(name, '([^.:]*)$', 1) AS last,
      coalesce(regexp_matches(name, '^(test_|Test[A-Z_]|test[A-Z])'), false) AS test_name, array_to_string(list_transform(regexp_extract_all(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]+[a-z]*|[a-z]+|[0-9]+|[^\\x00-\\x7F]+'), lambda x: lower(x)), ' ') AS tokens,
      CASE WHEN kind = 'property' AND regexp_matches(name, '^(self|this|cls)\\.') THEN 'attribute' ELSE kind END AS shown_kind FROM s""",
    "reconcile_files": f"""WITH {facts.FILES_SQL}, {_TEXT}, k AS (SELECT DISTINCT path, content_bytes, mtime_ns FROM skipped_files),
      late AS (SELECT path, arg_max(content_bytes, mtime_ns) AS bytes, '' AS hash, max(mtime_ns) AS mtime_ns FROM skipped_files GROUP BY path),
      d AS (SELECT t.path, strlen(t.content) AS bytes, f.content_hash AS hash, NULL::BIGINT AS mtime_ns FROM t LEFT JOIN f USING (file_id) UNION ALL SELECT * FROM late UNION ALL SELECT path || '.new', bytes, hash, mtime_ns FROM late),
      j AS (SELECT coalesce(d.path, f.path) AS path, d.path IS NOT NULL AS seen, f.path IS NOT NULL AS indexed, k.path IS NOT NULL AS skipped,
        d.bytes IS DISTINCT FROM f.content_bytes OR d.hash IS DISTINCT FROM f.content_hash AS differs
        FROM d LEFT JOIN k ON k.path = d.path AND k.content_bytes = d.bytes AND k.mtime_ns = d.mtime_ns FULL JOIN (SELECT * FROM f WHERE path IS NOT NULL) f ON f.path = d.path),
      c AS (SELECT path, CASE WHEN seen AND NOT indexed AND NOT skipped THEN 'added' WHEN seen AND indexed AND differs THEN 'modified' WHEN NOT seen AND indexed AND NOT starts_with(path, 'monorepo/') THEN 'deleted' END AS change FROM j)
      SELECT path, change FROM c WHERE change IS NOT NULL""",
    "index_facts": f"WITH {facts.FILES_SQL} SELECT count(*) AS files, coalesce(sum(line_count), 0)::BIGINT AS lines FROM f",
}
