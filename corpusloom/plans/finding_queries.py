"""Findings over the plain-text corpus and web pages: credentials, redaction, sizes, duplicates, health, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import secrets
from corpusloom.operators import lines, quality as q, security as s
from corpusloom.plans import bindings as b
from corpusloom.plans.line_queries import _BLOCKS_SQL
from corpusloom.plans.registry import query
from corpusloom.session import stored

# File-size limits lowered so that the driver documents reach both levels.
LIMITS = q.Thresholds(file_lines=(20, 40))


@query("redacted_text", "STR4", """
WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'sk-[a-zA-Z0-9_\\-]{20,}', '[REDACTED_API_KEY]', 'g'),
  'ghp_[a-zA-Z0-9_\\-]{20,}', '[REDACTED_GITHUB_TOKEN]', 'g'), 'AKIA[0-9A-Z]{16}', '[REDACTED_AWS_KEY]', 'g') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(t, '(?i)(password|secret|token|api_key|access_token)\\s*=\\s*[''"][^''"]{8,}[''"]', '\\1 = ''[REDACTED_SECRET]''', 'g')) AS review,
  md5(regexp_replace(t, '(?i)(password|secret|token|api_key|access_token)\\s*=\\s*[''"][^''"]{8,}[''"]', '\\1=''[REDACTED_SECRET]''', 'g')) AS debug FROM r""")
def redacted_text(spark, sf):
    t = F.col("text")
    return b.table(spark, sf, "documents").select(
        "doc_id", F.md5(secrets.redact_secrets(t, "review")).alias("review"), F.md5(secrets.redact_secrets(t, "debug")).alias("debug")
    )


# Values with live prefixes, placeholders and short strings, derived from the ids and texts of the documents.
_VALUE_SQL = """vals AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'sk-live' || doc_id || 'abcdef' WHEN 1 THEN 'change_me' WHEN 2 THEN ''
  WHEN 3 THEN 'ab' || (doc_id % 10) WHEN 4 THEN 'ghp_' || doc_id ELSE left(text, 12) END AS v,
  CASE WHEN doc_id % 5 = 0 THEN 'Db_Password' WHEN doc_id % 5 = 1 THEN 'colour' ELSE 'token' END AS name FROM documents)"""


def _values(spark, sf):
    d = F.col("doc_id")
    k = d.cast("string")
    v = (
        F.when(d % 6 == 0, F.concat(F.lit("sk-live"), k, F.lit("abcdef"))).when(d % 6 == 1, F.lit("change_me"))
        .when(d % 6 == 2, F.lit("")).when(d % 6 == 3, F.concat(F.lit("ab"), (d % 10).cast("string")))
        .when(d % 6 == 4, F.concat(F.lit("ghp_"), k)).otherwise(F.left("text", F.lit(12)))
    )
    name = F.when(d % 5 == 0, F.lit("Db_Password")).when(d % 5 == 1, F.lit("colour")).otherwise(F.lit("token"))
    return b.table(spark, sf, "documents").select("doc_id", v.alias("v"), name.alias("name"))


@query("redacted_values", "STR5", f"""
WITH {_VALUE_SQL}
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'sk-***[REDACTED (length ' || length(v) || ')]' WHEN 2 THEN '[EMPTY]' WHEN 3 THEN '[REDACTED]'
  WHEN 4 THEN 'ghp_***[REDACTED (length ' || length(v) || ')]'
  ELSE CASE WHEN length(v) <= 4 THEN '[REDACTED]' ELSE left(v, 2) || '***[REDACTED (length ' || length(v) || ')]' END END AS redacted FROM vals""")
def redacted_values(spark, sf):
    return _values(spark, sf).select("doc_id", secrets.redact_value(F.col("v")).alias("redacted"))


@query("credential_values", "PRJ8", f"""
WITH {_VALUE_SQL}
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN FALSE
  WHEN 4 THEN CASE WHEN length(v) >= 12 THEN TRUE ELSE length(v) >= 8 AND name <> 'colour' END
  ELSE name <> 'colour' AND length({b.strip_sql('v')}) >= 8 END AS credential FROM vals""")
def credential_values(spark, sf):
    return _values(spark, sf).select("doc_id", secrets.is_credential(F.col("name"), F.col("v")).alias("credential"))


_CRED_SQL = f"""{b.LINES_SQL}, assigned AS (
  SELECT repo, path, line_no, unnest(regexp_extract_all(line, '(?:^|[^\\w.])(?:[A-Za-z_]\\w*\\.)*[A-Za-z_]\\w*\\s*=\\s*(?:"(?:[^"\\\\]|\\\\.)*"|''(?:[^''\\\\]|\\\\.)*'')')) AS a FROM line_table),
pairs AS (SELECT repo, path, line_no, regexp_extract(a, '([A-Za-z_]\\w*)\\s*=', 1) AS nm, regexp_extract(a, '=\\s*["''](.*)["'']$', 1) AS v FROM assigned),
creds AS (SELECT *, regexp_matches(v, '^(sk-|ghp_|gho_|ghs_|AKIA|ASIA|xoxb-|xoxp-)') AS live, lower(trim(v)) AS lv FROM pairs),
found AS (SELECT *, 'Variable ''' || nm || ''' assigned a hardcoded literal string (' || length(v) || ' characters).' AS ev FROM creds
  WHERE (length(trim(v)) >= 8 OR live) AND NOT contains(lv, 'your_') AND NOT contains(lv, 'example') AND NOT contains(lv, 'changeme') AND NOT contains(lv, 'dummy')
    AND NOT (lv LIKE '<%>') AND NOT (lv LIKE '{{%}}') AND lv NOT IN ('change_me', 'placeholder', 'replace_me', 'password', 'undefined', 'localhost', 'development', 'your-api-key')
    AND ((live AND length(trim(v)) >= 12) OR (length(trim(v)) >= 8 AND (regexp_matches(lower(nm), '^(pwd|secret|auth_token|client_secret|private_key|jwt_secret|token)$')
      OR regexp_matches(lower(nm), 'password|passwd|api_key|apikey|secret_key|access_token')))))"""


@query("credential_findings", "SR1 PRJ8 SET1 JN15 STR17", f"""
WITH {_CRED_SQL}
SELECT DISTINCT repo, path, CAST(line_no AS INTEGER) AS start_line, CASE WHEN live THEN 'critical' ELSE 'high' END AS severity,
  CASE WHEN live THEN 'high' ELSE 'medium' END AS confidence, ev AS evidence_summary, 'CWE-798' AS cwe_id FROM found
QUALIFY row_number() OVER (PARTITION BY repo, path, line_no ORDER BY left(sha256('PYTHON_HARDCODED_CREDENTIAL|' || repo || '|' || path || '|' || line_no || '|Hardcoded Credential in ''' || nm || ''''), 16)) = 1""")
def credential_findings(spark, sf):
    findings = s.ordered(q.dedupe(s.text_credential_findings(b.corpus_lines(spark, sf))))
    return findings.select("repo", "path", "start_line", "severity", "confidence", "evidence_summary", "cwe_id")


def _labelled_findings(spark, sf):
    """Findings with every severity: credential lines graded by their line number."""
    found = s.text_credential_findings(b.corpus_lines(spark, sf))
    grade = F.element_at(F.array(*[F.lit(x) for x in s.SEVERITIES]), F.col("start_line") % 5 + 1)
    kind = F.element_at(F.array(*[F.lit(x) for x in s.CATEGORIES]), F.col("start_line") % 3 + 1)
    return q.dedupe(found.withColumn("severity", grade).withColumn("category", kind))


_LABELLED_SQL = f"""{_CRED_SQL}, lab AS (
  SELECT DISTINCT repo, path, line_no, ['critical', 'high', 'medium', 'low', 'informational'][line_no % 5 + 1] AS severity,
  ['credentials', 'code_execution', 'command_injection'][line_no % 3 + 1] AS category FROM found)"""


@query("security_severity_summary", "AGG11", f"""
WITH {_LABELLED_SQL}
SELECT repo, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
  count(*) FILTER (WHERE severity = 'informational') AS informational, count(*) AS total FROM lab GROUP BY repo""")
def security_severity_summary(spark, sf):
    return s.severity_summary(_labelled_findings(spark, sf))


@query("security_category_summary", "AGG12", f"""
WITH {_LABELLED_SQL} SELECT repo, category, count(*) AS n FROM lab GROUP BY ALL""")
def security_category_summary(spark, sf):
    return s.category_summary(_labelled_findings(spark, sf))


@query("security_order", "SRT2 PRJ14", f"""
WITH {_LABELLED_SQL}
SELECT repo, path, CAST(line_no AS INTEGER) AS start_line, severity, severity IN ('critical', 'high') AS actionable FROM lab""")
def security_order(spark, sf):
    return s.ordered(_labelled_findings(spark, sf)).select(
        "repo", "path", "start_line", "severity", s.is_actionable(F.col("severity")).alias("actionable")
    )


@query("script_findings", "SR2 SR10", """
WITH w AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'const apiToken = "tok-' || page_id || '-abcdef";' WHEN 1 THEN '// let password = "secretsecret' || page_id || '";'
    WHEN 2 THEN 'var my_api_key = "live-key-' || page_id || '";' ELSE 'let password = "example-value";' END AS line FROM pages)
SELECT 'web' AS repo, 'p' || page_id || '.js' AS path, 'JS_HARDCODED_CREDENTIAL' AS rule_id, 'Hardcoded Credential in ''my_api_key''' AS title,
  1 AS start_line FROM w WHERE page_id % 4 = 2""")
def script_findings(spark, sf):
    from corpusloom.operators import extract
    from corpusloom.sources import corpus as src

    k = F.col("page_id")
    n = k.cast("string")
    first = (
        F.when(k % 4 == 0, F.concat(F.lit('const apiToken = "tok-'), n, F.lit('-abcdef";')))
        .when(k % 4 == 1, F.concat(F.lit('// let password = "secretsecret'), n, F.lit('";')))
        .when(k % 4 == 2, F.concat(F.lit('var my_api_key = "live-key-'), n, F.lit('";')))
        .otherwise(F.lit('let password = "example-value";'))
    )
    files = b.table(spark, sf, "pages").select(
        F.lit("web").alias("repo"), F.concat(F.lit("p"), n, F.lit(".js")).alias("path"),
        F.concat(first, F.lit("\n"), "html").alias("content"),
    )
    found = s.code_findings(extract.with_declarations(src.with_lines(src.code_files(files))))
    return found.select("repo", "path", "rule_id", "title", "start_line")


_COUNTS_SQL = f"""{b.LINES_SQL}, counts AS (SELECT repo, path, count(*) AS total_lines FROM line_table GROUP BY ALL)"""
_SIZE_SQL = f"""{_COUNTS_SQL}, size_f AS (SELECT repo, path, total_lines, CASE WHEN total_lines >= 40 THEN 'error' ELSE 'warning' END AS severity,
  CASE WHEN total_lines >= 40 THEN 40 ELSE 20 END AS lim FROM counts WHERE total_lines >= 20)"""


@query("file_size_findings", "QR1", f"""
WITH {_SIZE_SQL}
SELECT repo, path, severity, CAST(total_lines AS DOUBLE) AS metric_value, CAST(lim AS DOUBLE) AS threshold,
  'File has ' || total_lines || ' lines (exceeds ' || severity || ' threshold of ' || lim || ' lines).' AS message FROM size_f""")
def file_size_findings(spark, sf):
    found = q.file_size_findings(lines.line_counts(b.corpus_lines(spark, sf)), LIMITS)
    return found.select("repo", "path", "severity", "metric_value", "threshold", "message")


def _quality(spark, sf):
    files = b.corpus_lines(spark, sf)
    counts = stored(lines.line_counts(files), "line-counts")  # read by the size rule and by the scores
    return counts, q.file_size_findings(counts, LIMITS).unionByName(q.duplicate_findings(lines.duplicate_blocks(files, within_repo=True)))


_QUALITY_SQL = _BLOCKS_SQL.replace("WITH ", "") + """, counts AS (SELECT repo, path, count(*) AS total_lines FROM line_table GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, block_hash ORDER BY path, start_line) AS r FROM blocks),
dups AS (SELECT d.repo, d.path, d.start_line, d.end_line, o.path AS opath, o.start_line AS ostart FROM ranked d JOIN ranked o USING (repo, block_hash) WHERE d.r > 1 AND o.r = 1),
fnd AS (
  SELECT repo, path, 1 AS start_line, 'FILE_TOO_LARGE' AS rule_id, 'size' AS category, CASE WHEN total_lines >= 40 THEN 'error' ELSE 'warning' END AS severity,
         'File has ' || total_lines || ' lines (exceeds ' || CASE WHEN total_lines >= 40 THEN 'error threshold of 40' ELSE 'warning threshold of 20' END || ' lines).' AS message
  FROM counts WHERE total_lines >= 20
  UNION ALL SELECT repo, path, start_line, 'DUPLICATE_CODE_BLOCK', 'duplication', 'warning',
         'Duplicate code block of 6+ lines matches code in ''' || opath || ''' (lines ' || ostart || '-' || (ostart + 5) || ').' FROM dups)"""


@query("quality_findings", "QR1 QR9 SET3 SRT1", f"""
WITH {_QUALITY_SQL}
SELECT repo, path, CAST(start_line AS INTEGER) AS start_line, rule_id, category, severity, message FROM fnd""")
def quality_findings(spark, sf):
    return q.ordered_findings(_quality(spark, sf)[1]).select("repo", "path", "start_line", "rule_id", "category", "severity", "message")


@query("finding_breakdown", "AGG10", f"""
WITH {_QUALITY_SQL}, keys AS (SELECT * FROM (VALUES {', '.join(f"('category', '{c}')" for c in q.CATEGORIES)}, {', '.join(f"('severity', '{c}')" for c in q.SEVERITIES)}) v(dimension, key)),
n AS (SELECT repo, 'category' AS dimension, category AS key, count(*) AS n FROM fnd GROUP BY ALL UNION ALL SELECT repo, 'severity', severity, count(*) FROM fnd GROUP BY ALL)
SELECT r.repo, k.dimension, k.key, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT repo FROM counts) r CROSS JOIN keys k LEFT JOIN n USING (repo, dimension, key)""")
def finding_breakdown(spark, sf):
    counts, findings = _quality(spark, sf)
    return q.breakdown(findings, counts)


@query("severity_pivot", "AGG10", f"""
WITH {_QUALITY_SQL}
SELECT repo, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'error') AS error,
  count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM fnd GROUP BY repo""")
def severity_pivot(spark, sf):
    return q.severity_pivot(_quality(spark, sf)[1])


_GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"


@query("file_health", "AGG9 MATH4 SRT3", f"""
WITH {_SIZE_SQL}, h AS (SELECT c.repo, c.path, c.total_lines, CASE WHEN s.path IS NULL THEN 0 ELSE 1 END AS findings_count,
  CASE s.severity WHEN 'error' THEN 12.0::DOUBLE WHEN 'warning' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM counts c LEFT JOIN size_f s ON s.repo = c.repo AND s.path = c.path),
sc AS (SELECT *, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - p / greatest(0.5::DOUBLE, least(2.0::DOUBLE, total_lines / 100.0::DOUBLE)))), 1) AS health_score FROM h)
SELECT repo, path, total_lines, CAST(findings_count AS BIGINT) AS findings_count, health_score, {_GRADE.format('health_score')} AS letter_grade FROM sc""")
def file_health(spark, sf):
    counts, findings = _quality(spark, sf)
    return q.worst_first(q.file_health(counts, findings)).select(
        "repo", "path", "total_lines", "findings_count", "health_score", "letter_grade"
    )


@query("repo_health", "AGG8 MATH4", f"""
WITH {_QUALITY_SQL}, l AS (SELECT repo, sum(total_lines) AS n FROM counts GROUP BY repo),
p AS (SELECT repo, sum(CASE WHEN category = 'size' THEN CASE severity WHEN 'error' THEN 8.0::DOUBLE ELSE 3.0::DOUBLE END ELSE 0 END) AS pm,
             sum(CASE WHEN category = 'duplication' THEN 3.0::DOUBLE ELSE 0 END) AS pr FROM fnd GROUP BY repo),
s AS (SELECT l.repo, round_even(greatest(0, least(100, 100 - coalesce(pm, 0) / greatest(1.0::DOUBLE, n / 1000.0::DOUBLE) * 1.5::DOUBLE)), 1) AS m,
             round_even(greatest(0, least(100, 100 - coalesce(pr, 0) / greatest(1.0::DOUBLE, n / 1000.0::DOUBLE) * 1.5::DOUBLE)), 1) AS r FROM l LEFT JOIN p ON p.repo = l.repo),
o AS (SELECT *, round_even(0.35::DOUBLE * m + 0.30::DOUBLE * 100 + 0.15::DOUBLE * 100 + 0.20::DOUBLE * r, 1) AS overall FROM s)
SELECT repo, m AS maintainability_score, 100.0::DOUBLE AS complexity_score, 100.0::DOUBLE AS documentation_score, r AS reliability_score,
  overall AS overall_score, {_GRADE.format('overall')} AS letter_grade FROM o""")
def repo_health(spark, sf):
    return q.repo_health(*_quality(spark, sf))
