"""Line-table queries: counts, classification, duplicate blocks, token estimates, fallback chunks, snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import lines
from corpusloom.plans import bindings as b
from corpusloom.plans.registry import query

_STRIPPED = b.strip_sql("line")


@query("line_table", "LIN1", f"""
WITH {b.LINES_SQL}
SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, md5(line) AS digest FROM line_table""")
def line_table(spark, sf):
    return lines.explode_lines(b.corpus_lines(spark, sf)).select("repo", "path", "line_no", F.md5("line").alias("digest"))


@query("line_counts", "LIN1 LIN2 AGG6", f"""
WITH {b.LINES_SQL}, c AS (
  SELECT repo, path, count(*) AS total_lines, count(*) FILTER (WHERE {_STRIPPED} <> '') AS code_lines,
         CAST(0 AS BIGINT) AS comment_lines, count(*) FILTER (WHERE {_STRIPPED} = '') AS blank_lines
  FROM line_table GROUP BY repo, path)
SELECT repo, CAST(NULL AS VARCHAR) AS language, path, CAST(sum(total_lines) AS BIGINT) AS total_lines,
       CAST(sum(code_lines) AS BIGINT) AS code_lines, CAST(sum(comment_lines) AS BIGINT) AS comment_lines,
       CAST(sum(blank_lines) AS BIGINT) AS blank_lines, grouping(repo, lang, path) AS level
FROM (SELECT *, CAST(NULL AS VARCHAR) AS lang FROM c) GROUP BY ROLLUP (repo, lang, path)""")
def line_counts(spark, sf):
    return lines.line_count_rollup(lines.line_counts(b.corpus_lines(spark, sf)))


# The frame lines of the derived modules are fixed (see bindings).
@query("code_line_counts", "LIN2", f"""
WITH {b.CODE_SQL}, n AS (
  SELECT *, string_split(text, chr(10)) AS t FROM mods)
SELECT repo, path, CASE WHEN is_py THEN {b.PY_LINES} ELSE {b.TS_LINES} END + len(t) AS total_lines,
  CASE WHEN is_py THEN 49 ELSE 35 END AS code_lines,
  CASE WHEN is_py THEN 4 ELSE 4 END + len(t) AS comment_lines,
  CASE WHEN is_py THEN 13 ELSE 8 END AS blank_lines
FROM n""")
def code_line_counts(spark, sf):
    return lines.line_counts(b.code_lines(spark, sf)).drop("language")


@query("chunked_line_counts", "LIN2 AGG6", f"""
WITH {b.CODE_SQL}, n AS (
  SELECT *, string_split(text, chr(10)) AS t FROM mods)
SELECT repo, path, CASE WHEN is_py THEN {b.PY_LINES} ELSE {b.TS_LINES} END + len(t) AS total_lines,
  CASE WHEN is_py THEN 49 ELSE 35 END AS code_lines,
  CASE WHEN is_py THEN 4 ELSE 4 END + len(t) AS comment_lines,
  CASE WHEN is_py THEN 13 ELSE 8 END AS blank_lines
FROM n""")
def chunked_line_counts(spark, sf):
    """The same counts with every module split into chunks of seven lines."""
    return lines.chunk_line_counts(lines.in_chunks(b.code_lines(spark, sf), 7)).drop("language")



_NORM_SQL = f"""{b.LINES_SQL}, norm AS (
  SELECT repo, path, line_no, t, row_number() OVER (PARTITION BY repo, path ORDER BY line_no) AS n
  FROM (SELECT repo, path, line_no, {_STRIPPED} AS t FROM line_table)
  WHERE t NOT IN ('', '{{', '}}', '(', ')', '[', ']', ';', ':') AND left(t, 1) NOT IN ('#', '*') AND left(t, 2) NOT IN ('//', '/*'))"""


@query("normalized_lines", "LIN3", f"""
WITH {_NORM_SQL}
SELECT repo, path, CAST(n AS INTEGER) AS n, CAST(line_no AS INTEGER) AS line_no, md5(t) AS digest FROM norm""")
def normalized_lines(spark, sf):
    return lines.normalized_line_table(b.corpus_lines(spark, sf)).select(
        "repo", "path", "n", "line_no", F.md5("line").alias("digest")
    )


_BLOCKS_SQL = f"""{_NORM_SQL}, win AS (
  SELECT repo, path, line_no AS start_line, last_value(line_no) OVER w AS end_line, left(t, 60) AS sample,
         count(*) OVER w AS k, string_agg(t, chr(10)) OVER w AS body
  FROM norm WINDOW w AS (PARTITION BY repo, path ORDER BY n ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
hashed AS (SELECT repo, path, start_line, end_line, sample, left(sha256(body), 16) AS block_hash FROM win WHERE k = 6),
folded AS (
  SELECT repo, path, block_hash, list_reduce(list_transform(list(start_line ORDER BY start_line), lambda s: [s]),
         lambda acc, s: CASE WHEN s[1] - acc[-1] >= 6 THEN list_concat(acc, s) ELSE acc END) AS starts
  FROM hashed GROUP BY ALL),
blocks AS (SELECT h.* FROM hashed h JOIN folded f USING (repo, path, block_hash) WHERE list_contains(f.starts, h.start_line))"""


@query("block_hashes", "LIN4 LIN5", f"""
WITH {_BLOCKS_SQL}
SELECT repo, path, block_hash, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, sample FROM blocks""")
def block_hashes(spark, sf):
    return lines.block_occurrences(b.corpus_lines(spark, sf))


@query("duplicate_blocks", "LIN3 LIN4 LIN5 LIN6", f"""
WITH {_BLOCKS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY block_hash ORDER BY repo, path, start_line) AS r FROM blocks)
SELECT d.repo, d.path, CAST(d.start_line AS INTEGER) AS start_line, CAST(d.end_line AS INTEGER) AS end_line,
       o.repo AS original_repo, o.path AS original_path, CAST(o.start_line AS INTEGER) AS original_start,
       CAST(o.end_line AS INTEGER) AS original_end, 6 AS lines_count, d.sample, d.block_hash
FROM ranked d JOIN ranked o USING (block_hash) WHERE d.r > 1 AND o.r = 1""")
def duplicate_blocks(spark, sf):
    return lines.duplicate_blocks(b.corpus_lines(spark, sf))


@query("token_estimate", "STR7", """
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(round_even(length(text) / 3.8, 0) AS INTEGER)) END AS tokens
FROM documents""")
def token_estimate(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("fallback_chunks", "LIN7 STR8 STR9", f"""
WITH {b.LINES_SQL}, c AS (
  SELECT repo, path, CAST(doc_id AS VARCHAR) AS nm, CAST(lo AS INTEGER) AS start_line,
         array_to_string(lines[lo:lo + 39], chr(10)) AS code, CAST(least(len(lines), lo + 39) AS INTEGER) AS end_line
  FROM (SELECT *, unnest(generate_series(1, len(lines), 40)) AS lo FROM split WHERE len(lines) > 0))
SELECT repo, repo || ':' || path || '#' || nm || '#L' || start_line || '-L' || end_line AS chunk_id, nm AS entity_name, start_line, end_line,
  'File: ' || path || ' | File Module: ' || nm || ' | Lines: ' || start_line || '-' || end_line AS context_header, md5(code) AS digest,
  CASE WHEN code = '' THEN 0 ELSE greatest(1, CAST(round_even(length(code) / 3.8, 0) AS INTEGER)) END AS tokens_estimate FROM c""")
def fallback_chunks(spark, sf):
    chunks = lines.fallback_chunks(b.corpus_lines(spark, sf), max_lines=40)
    return chunks.select(
        "repo", "chunk_id", "entity_name", "start_line", "end_line", "context_header",
        F.md5("code_content").alias("digest"), "tokens_estimate",
    )


@query("context_windows", "LIN8 STR11", f"""
WITH {b.LINES_SQL}, t AS (
  SELECT repo, path, lines, len(lines) AS total, doc_id % 40 AS target FROM split WHERE len(lines) > 0),
w AS (SELECT *, CASE WHEN target BETWEEN 1 AND total THEN greatest(1, target - 15) ELSE 1 END AS s,
         CASE WHEN target BETWEEN 1 AND total THEN least(total, target + 15) ELSE least(total, 50) END AS e FROM t)
SELECT repo, path, CAST(target AS INTEGER) AS target_line, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line,
  md5(array_to_string(list_transform(list_zip(lines[s:e], range(s, e + 1)), lambda x: lpad(CAST(x[2] AS VARCHAR), 4, ' ') || ' | ' || x[1]), chr(10))) AS digest
FROM w""")
def context_windows(spark, sf):
    files = b.corpus_lines(spark, sf)
    targets = files.select("repo", "path", (F.col("doc_id") % 40).cast("int").alias("target_line"))
    return lines.context_windows(targets, files).select(
        "repo", "path", "target_line", "start_line", "end_line", F.md5("code_snippet").alias("digest")
    )


@query("truncated_text", "STR12", """
SELECT doc_id, length(left(text, 15000)) AS trace_chars,
  md5(CASE WHEN length(text) > 24000 THEN left(text, 24000) || '...' ELSE text END) AS cut, md5(left(text, 500)) AS message,
  md5(left(text, 4000)) AS manifest FROM documents""")
def truncated_text(spark, sf):
    t = F.col("text")
    return b.table(spark, sf, "documents").select(
        "doc_id", F.char_length(text.truncate(t, text.MAX_TRACE_CHARS)).alias("trace_chars"),
        F.md5(text.truncate(t, text.MAX_REVIEW_CHARS, "...")).alias("cut"), F.md5(text.truncate(t, text.MAX_MESSAGE_CHARS)).alias("message"),
        F.md5(text.truncate(t, text.MAX_MANIFEST_CHARS)).alias("manifest"),
    )


@query("brace_metrics", "ARR1 ARR2", """
WITH br AS (SELECT page_id, html, list_filter(string_split(regexp_replace(html, '[^{}]', '', 'g'), ''), lambda x: x <> '') AS ch FROM pages),
f AS (SELECT page_id, html, list_reduce(list_transform(list_concat(['x'], ch), lambda c: [CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END, 0]),
      lambda a, c: [greatest(0, a[1] + c[1]), greatest(a[2], a[1] + c[1])]) AS st FROM br)
SELECT page_id, CAST(st[2] AS INTEGER) AS depth, CAST(1 + len(regexp_extract_all(html, '\\bif\\b')) + len(regexp_extract_all(html, '\\bfor\\b'))
  + len(regexp_extract_all(html, '\\bwhile\\b')) + len(regexp_extract_all(html, '\\bcase\\b')) + len(regexp_extract_all(html, '\\bcatch\\b'))
  + len(regexp_extract_all(html, '&&')) + len(regexp_extract_all(html, '\\|\\|')) + len(regexp_extract_all(html, '\\?\\?'))
  + len(regexp_extract_all(html, '(?s)\\?[^.]')) AS INTEGER) AS complexity FROM f""")
def brace_metrics(spark, sf):
    html = F.col("html")
    return b.table(spark, sf, "pages").select(
        "page_id", text.brace_depth(html).alias("depth"), text.branch_complexity(html).alias("complexity")
    )
