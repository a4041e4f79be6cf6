"""Review queries: outside findings derived from the documents, grounding, merging, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import quality as q, review as r, security as s
from corpusloom.plans import bindings as b
from corpusloom.plans.code_queries import LIMITS, declared
from corpusloom.plans.registry import query
from corpusloom.session import stored


def responses(spark, sf):
    """Every document gets one reviewer answer: fenced, bare or wrapped JSON, or no JSON.

    Its findings: one in range, one far outside with the third line of the module as evidence, one outside without.
    """
    d, k = F.col("doc_id"), F.col("doc_id").cast("string")
    third = F.when(d % 2 == 0, F.lit("import json as js")).otherwise(F.lit("import React from 'react';"))
    body = F.concat(
        F.lit('{"executive_summary": "s", "findings": [{"title": "First '), k,
        F.lit('", "problem": "p", "category": "Security", "severity": "HIGH", "confidence": "sure", "start_line": 2, "end_line": 3, "evidence": ""},'),
        F.lit('{"title": "Moved", "problem": "token = \'abcdefgh1234\'", "category": "style", "severity": "odd", "start_line": 9999, "end_line": 10000, "evidence": "'),
        third, F.lit('"}, {"title": "Lost", "problem": "p", "start_line": 9999, "end_line": 9998, "evidence": "no such line here"}, {"title": " ", "problem": "p"}]}'),
    )
    answer = (
        F.when(d % 4 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(d % 4 == 1, body).when(d % 4 == 2, F.concat(F.lit("Result "), body, F.lit(" end"))).otherwise(F.lit("I cannot answer {"))
    )
    files = b.code_corpus(spark, sf).select("repo", "path", "doc_id")
    return files.select(d.alias("review_id"), "repo", "path", answer.alias("text"))


@query("review_json", "STR13", """
SELECT doc_id AS review_id, CAST(i AS INTEGER) AS finding_no, CASE i WHEN 1 THEN 'First ' || doc_id WHEN 2 THEN 'Moved' WHEN 3 THEN 'Lost' ELSE ' ' END AS title
FROM documents, generate_series(1, 4) g(i) WHERE doc_id % 4 < 3""")
def review_json(spark, sf):
    return r.parse_responses(responses(spark, sf)).select("review_id", "finding_no", "title")


_GROUND_SQL = f"""n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {b.PY_LINES} ELSE {b.TS_LINES} END + len(string_split(text, chr(10))) AS total FROM documents WHERE doc_id % 4 < 3),
g AS (SELECT doc_id AS review_id, CAST(i AS INTEGER) AS finding_no, CASE i WHEN 1 THEN 'First ' || doc_id WHEN 2 THEN 'Moved' ELSE 'Lost' END AS title,
  CASE i WHEN 1 THEN 'security' ELSE 'maintainability' END AS category, CASE i WHEN 1 THEN 'high' ELSE 'medium' END AS severity, 'medium' AS confidence,
  CAST(CASE i WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE total END AS INTEGER) AS start_line, CAST(CASE i WHEN 3 THEN total ELSE 3 END AS INTEGER) AS end_line,
  CASE i WHEN 2 THEN 'token = ''[REDACTED_SECRET]''' ELSE 'p' END AS problem,
  CASE i WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'import os' ELSE 'import {{ api' || (doc_id + 10) || ', format }} from ''./c' || (doc_id + 10) || ''';' END
    WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'import json as js' ELSE 'import React from ''react'';' END ELSE 'no such line here' END AS evidence, i < 3 AS is_verified
  FROM n, generate_series(1, 3) s(i))"""


@query("grounded_findings", "RV2 PRJ13 JN12 STR4", f"WITH {_GROUND_SQL} SELECT * FROM g")
def grounded_findings(spark, sf):
    raw = r.parse_responses(responses(spark, sf))
    return r.ground(raw, b.code_lines(spark, sf)).select(
        "review_id", "finding_no", "title", "category", "severity", "confidence", "start_line", "end_line", "problem", "evidence", "is_verified"
    )


@query("focused_findings", "PRJ12", f"WITH {_GROUND_SQL} SELECT review_id, finding_no FROM g WHERE category = 'security'")
def focused_findings(spark, sf):
    found = r.ground(r.parse_responses(responses(spark, sf)), b.code_lines(spark, sf))
    return r.focus(found, "Security").select("review_id", "finding_no")


_STATIC_SQL = f"""{b.CODE_SQL}, st AS (
  SELECT repo, path, 23 AS start_line, 'Dynamic Code Execution (eval)' AS title, 'security' AS category, 'high' AS severity, 'static_analysis' AS source FROM mods WHERE is_py
  UNION ALL SELECT repo, path, 32, 'Overly Broad Exception Handling', 'correctness', 'medium', 'static_analysis' FROM mods WHERE is_py),
ai AS (SELECT repo, path, 23 AS start_line, ' dynamic code execution (EVAL)' AS title, 'correctness' AS category, 'low' AS severity, 'ai_review' AS source FROM mods WHERE is_py AND doc_id % 4 = 0
  UNION ALL SELECT repo, path, 1, 'Other', 'testing', 'info', 'ai_review' FROM mods WHERE doc_id % 3 = 0)"""


def _both(spark, sf):
    files = declared(spark, sf)
    # each file is scanned once; what its findings need is small beside its text
    read = stored(s.with_statements(files).select("repo", "path", "language", "doc_id", "statements", "handlers"), "statements")
    eval_rule = s.code_findings(read).filter(F.col("rule_id") == "PYTHON_DANGEROUS_EVAL")
    broad = q.broad_exception_findings(q.broad_handlers(read))
    static = r.from_security(eval_rule).unionByName(r.from_quality(broad, files))
    none = F.lit(None).cast("string")

    def outside(rows, line, title, category, severity):
        return rows.select(
            F.lit(title).alias("title"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit("low").alias("confidence"),
            "repo", "path", F.lit(line).alias("start_line"), F.lit(line).alias("end_line"), none.alias("entity_name"), F.lit("p").alias("problem"),
            F.lit("e").alias("evidence"), F.lit("r").alias("recommendation"), none.alias("suggested_change"), F.lit("ai_review").alias("source"),
            F.lit(True).alias("is_verified"),
        )

    ai = outside(read.filter(F.col("doc_id") % 4 == 0), 23, " dynamic code execution (EVAL)", "correctness", "low").unionByName(
        outside(read.filter(F.col("doc_id") % 3 == 0), 1, "Other", "testing", "info")
    )
    return files, r.merge(static, ai)


@query("merged_findings", "SET2 RV1", f"""
WITH {_STATIC_SQL}
SELECT * FROM st UNION ALL SELECT * FROM ai WHERE title = 'Other'""")
def merged_findings(spark, sf):
    return _both(spark, sf)[1].select("repo", "path", "start_line", "title", "category", "severity", "source")


@query("review_summary", "AGG16", f"""
WITH {_STATIC_SQL}, m AS (SELECT * FROM st UNION ALL SELECT * FROM ai WHERE title = 'Other'),
l AS (SELECT repo, CAST(sum(CASE WHEN is_py THEN {b.PY_LINES} ELSE {b.TS_LINES} END + len(string_split(text, chr(10)))) AS BIGINT) AS lines_reviewed FROM mods GROUP BY repo)
SELECT repo, lines_reviewed, count(*) AS total_findings, count(*) FILTER (WHERE source = 'static_analysis') AS deterministic_count, count(*) FILTER (WHERE source = 'ai_review') AS ai_count,
  count(*) FILTER (WHERE severity = 'high') AS severity_high, count(*) FILTER (WHERE severity = 'medium') AS severity_medium, count(*) FILTER (WHERE severity = 'info') AS severity_info,
  count(*) FILTER (WHERE category = 'security') AS category_security, count(*) FILTER (WHERE category = 'correctness') AS category_correctness, count(*) FILTER (WHERE category = 'testing') AS category_testing
FROM l JOIN m USING (repo) GROUP BY repo, lines_reviewed""")
def review_summary(spark, sf):
    files, merged = _both(spark, sf)
    return r.summary(merged, files).drop(
        "severity_critical", "severity_low", "category_performance", "category_maintainability", "category_readability"
    )


@query("executive_summaries", "AGG16", f"""
WITH {_STATIC_SQL}, m AS (SELECT * FROM st UNION ALL SELECT * FROM ai WHERE title = 'Other'),
c AS (SELECT repo, count(*) AS n, count(*) FILTER (WHERE category = 'correctness') AS c, count(*) FILTER (WHERE category = 'security') AS s, count(*) FILTER (WHERE category = 'testing') AS t,
  count(*) FILTER (WHERE severity = 'high') AS high FROM m GROUP BY repo)
SELECT repo, 'Review of `' || repo || '` identified ' || n || ' actionable findings across ' || array_to_string(list_filter([CASE WHEN c > 0 THEN 'correctness' END, CASE WHEN s > 0 THEN 'security' END,
  CASE WHEN t > 0 THEN 'testing' END], lambda x: x IS NOT NULL), ', ') || ', 0 critical and ' || high || ' high.' AS executive_summary FROM c""")
def executive_summaries(spark, sf):
    files, merged = _both(spark, sf)
    return r.executive_summary(r.summary(merged, files))


@query("static_review", "RV1 QR2 SR3 STR17", f"""
WITH {b.CODE_SQL}
SELECT repo, count(*) AS n_files, CAST(sum(CASE WHEN is_py THEN 9 ELSE 0 END) AS BIGINT) AS from_quality FROM mods GROUP BY repo""")
def static_review(spark, sf):
    files = declared(spark, sf)
    converted = r.from_quality(q.file_findings(files, LIMITS).filter(F.col("rule_id") != "POTENTIALLY_UNUSED_IMPORT"), files)
    # Per Python module: four long functions, one complex, one nested, one with many parameters, two without docstring,
    # one broad handler; the findings of script functions are counted apart.
    python = converted.filter(F.col("path").endswith(".py")).groupBy("repo").agg(
        F.count_if(F.col("title") != "Overly Broad Exception Handling").alias("from_quality")
    )
    return files.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files")).join(python, "repo", "left").na.fill(0)
