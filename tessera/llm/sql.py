"""SQL of the corpus queries, where DuckDB can express them."""

from __future__ import annotations

from tessera.llm import encode, quantiles

# each call once; copies differ in spellings and nulls alone
_CALLS = """calls AS (
  SELECT id, max(epoch_us("timestamp")) AS us, max(lower(trim(replace(tool, '-', '_')))) AS tool, max(workspace_name) AS workspace_name, max(duration_ms) AS duration_ms
  FROM tool_telemetry WHERE id IS NOT NULL GROUP BY id)"""

_G = quantiles.gamma(0.01)
_BUCKETS = f"""WITH {_CALLS},
valid AS (SELECT tool, workspace_name, date_trunc('day', make_timestamp(us)) AS day, duration_ms AS v,
  CASE WHEN duration_ms = 0 THEN 0 ELSE CAST(ceil(ln(CAST(duration_ms AS DOUBLE)) / ln({_G!r})) AS INTEGER) END AS bucket
  FROM calls WHERE duration_ms >= 0 AND duration_ms NOT IN (2147483647, 4294967295, 9223372036854775807))"""


def _percentile_sql() -> str:
    ps = ", ".join(
        f"max(CASE WHEN upto >= k AND upto - n < k THEN est END) FILTER (r = {r}) AS {c}" for c, r in (("p50", 5000), ("p90", 9000), ("p95", 9500), ("p99", 9900)))
    return f"""{_BUCKETS},
levels AS (SELECT 'tool' AS level, tool, NULL AS workspace_name, v, bucket FROM valid
  UNION ALL SELECT 'workspace', NULL, workspace_name, v, bucket FROM valid UNION ALL SELECT 'tool_workspace', tool, workspace_name, v, bucket FROM valid),
b AS (SELECT level, tool, workspace_name, v = 0 AS z, bucket, count(*) AS n FROM levels GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, tool, workspace_name ORDER BY NOT z, bucket) AS upto, sum(n) OVER (PARTITION BY level, tool, workspace_name) AS total,
  CASE WHEN z THEN 0 ELSE 2 * pow({_G!r}, bucket) / ({_G!r} + 1) END AS est FROM b),
k AS (SELECT u.*, r, (total * r + 9999) // 10000 AS k FROM u, (VALUES (5000), (9000), (9500), (9900)) t(r))
SELECT level, tool, workspace_name, CAST(max(total) AS BIGINT) AS n, {ps.replace("max(CASE", "round(max(CASE").replace(") FILTER", ") FILTER").replace(" AS p", ", 6) AS p")}, 0.01::DOUBLE AS max_relative_error
FROM k GROUP BY level, tool, workspace_name"""


# Byte-pair encoding in SQL. What the tokenizer takes for blanks; a mark that parts the last blank of a run from those before
# it, as words take it along (no text holds this character).
_WS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MARK = "\ufdd0"
_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}{_MARK}]+|[{_WS}]+".replace("'", "''")
# words of each document; of each distinct word the pieces, in each round its best pair merged wherever it stands
_TOKENS = rf"""WITH RECURSIVE rk AS MATERIALIZED (SELECT hex(from_base64(b)) AS h, r FROM read_csv('{encode.TOKENIZERS}/byte_bpe_50k.tiktoken', delim = ' ', header = false, quote = '', escape = '', columns = {{'b': 'VARCHAR', 'r': 'INTEGER'}})),
w0 AS (SELECT row_number() OVER () AS rn, doc_id, source, regexp_extract_all(regexp_replace(coalesce(text, ''), '([{_WS}]*)([{_WS}])([^{_WS}])', '\1{_MARK}\2\3', 'g'), '{_WORD}') AS ws FROM documents),
w AS (SELECT rn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w0),
m AS (SELECT word, regexp_extract_all(hex(encode(word)), '..') AS p, 0 AS n FROM (SELECT DISTINCT word FROM w)
  UNION ALL SELECT m.word, list_reduce(list_transform(m.p, lambda x: [x]), lambda a, x: CASE WHEN a[-1] || x[1] = b.h THEN a[:-2] || [b.h] ELSE a || x END), m.n + 1
  FROM m JOIN (SELECT word, arg_min(h, r) AS h FROM (SELECT word, unnest(list_transform(generate_series(1, len(p) - 1), lambda i: p[i] || p[i + 1])) AS h FROM m) JOIN rk USING (h) GROUP BY word) b ON b.word = m.word),
e AS (SELECT word, list(rk.r ORDER BY k) AS ids FROM (SELECT word, unnest(p) AS h, generate_subscripts(p, 1) AS k FROM (SELECT word, arg_max(p, n) AS p FROM m GROUP BY word)) JOIN rk USING (h) GROUP BY word),
d AS (SELECT w0.rn, w0.doc_id, w0.source, coalesce(flatten(list(ids ORDER BY pos) FILTER (ids IS NOT NULL)), []) AS ids FROM w0 LEFT JOIN w USING (rn) LEFT JOIN e USING (word) GROUP BY ALL)"""
_PLAN = f"""{_TOKENS}, wt AS (SELECT source, sum(coalesce(target_share, 0.0)) AS target_share, max(coalesce(max_repeats, 1)) AS max_repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY source),
hv AS (SELECT source, count(*) AS documents, sum(len(ids))::BIGINT AS available_tokens FROM d GROUP BY source), al AS (SELECT coalesce(sum(len(ids)), 0)::BIGINT AS total FROM d),
pl AS (SELECT wt.source, target_share, max_repeats, coalesce(documents, 0) AS documents, coalesce(available_tokens, 0) AS available_tokens, target_share * total AS target_tokens FROM wt LEFT JOIN hv USING (source), al)"""

SQL = {
    "p6_percentiles": _percentile_sql(),
    "p6_daily_sketch": f"""{_BUCKETS} SELECT strftime(day, '%Y-%m-%d') AS day, tool, workspace_name, CASE WHEN v = 0 THEN 0 ELSE 1 END AS sign,
      bucket, count(*) AS n FROM valid GROUP BY ALL""",
    "p8_ids": f"{_TOKENS} SELECT doc_id, ids FROM d",
    "p8_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p9_plan": f"{_PLAN} SELECT source, target_share, max_repeats, documents, available_tokens, target_tokens FROM pl",
    "p9_found": f"{_PLAN} SELECT source FROM pl WHERE available_tokens * max_repeats < target_tokens",
    "p10_hosts": rf"""WITH h AS (SELECT doc_id, rtrim(unnest(regexp_extract_all(lower(text), '(?:https?://|www\.)([^{_WS}/)>\]"''|?#:]+)', 1)), '.') AS host FROM documents), n AS (SELECT doc_id, host, count(*) AS n FROM h GROUP BY ALL)
      SELECT doc_id, arg_min(host, (-n, host)) AS host FROM n GROUP BY doc_id""",
}
