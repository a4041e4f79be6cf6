"""Queries over the derived modules. Their oracles state what each module was built to hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import chunks, docs, extract as x, graph, quality as q, retrieval, security as s
from corpusloom.plans import bindings as b
from corpusloom.plans.registry import query
from corpusloom.sources import corpus as src

LIMITS = q.Thresholds(function_lines=(6, 10), complexity=(4, 6))


def declared(spark, sf):
    return x.with_declarations(b.code_lines(spark, sf))


def _values(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


def _fill(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '{{k10}}', CAST(k10 AS VARCHAR)), '{{k20}}', CAST(k20 AS VARCHAR)), '{{k7}}', CAST(k7 AS VARCHAR)), '{{k}}', k)"


_ENTITIES = [
    (True, "API_KEY", "variable", 8, 8, "API_KEY = ...", None, None, "", None),
    (True, "router", "variable", 9, 9, "router = ...", None, None, "", None),
    (True, "Service{k}", "class", 12, 24, "class Service{k}(Base)", "Service number {k}.", None, "", None),
    (True, "__init__", "method", 15, 16, "def __init__(self, size)", None, "Service{k}", "self,size", None),
    (True, "run", "method", 18, 24, "def run(self, a, b, c, d, e)", None, "Service{k}", "self,a,b,c,d,e", None),
    (True, "login_{k}", "function", 28, 33, "async def login_{k}(name: str, limit) -> dict", "Load items.", None, "name,limit", "dict"),
    (True, "_verify_{k}", "function", 36, 48, "def _verify_{k}(value)", None, None, "value", None),
    (True, "deploy_{k}", "function", 51, 64, "def deploy_{k}(target: str, options: dict) -> dict", "Deploys to a target.", None, "target,options", "dict"),
    (False, "Props{k}", "interface", 5, 7, "interface Props{k}", None, None, "", None),
    (False, "Id{k}", "type_alias", 9, 9, "type Id{k} = ...", None, None, "", None),
    (False, "Widget{k}", "class", 14, 21, "class Widget{k}", None, None, "", None),
    (False, "render", "method", 15, 20, "render(a: string): string", None, "Widget{k}", "", "string"),
    (False, "format{k}", "function", 23, 27, "function format{k}(x)", None, None, "", None),
    (False, "fetch{k}", "function", 29, 31, "const fetch{k} = (url: string) => ...", None, None, "", None),
    (False, "load{k}", "function", 36, 41, "function load{k}(\n  url: string,\n  done: (e: Error, n: number) => void,\n): Promise<{ id: number }>",
     None, None, "", "Promise<{ id: number }>"),
    (False, "save{k}", "function", 43, 47, "const save{k} = (\n  id: number,\n) => ...: Promise<void>", None, None, "", "Promise<void>"),
]
_ENT_SQL = f"""{b.CODE_SQL}, ents AS (
  SELECT repo, path, {_fill('v.name')} AS name, v.type, CAST(v.s AS INTEGER) AS start_line, CAST(v.e AS INTEGER) AS end_line, {_fill('v.sig')} AS signature,
         {_fill('v.doc')} AS docstring, {_fill('v.parent')} AS parent, v.params, v.ret AS return_type, doc_id, k, mods.is_py
  FROM mods JOIN {_values(_ENTITIES)} v(is_py, name, type, s, e, sig, doc, parent, params, ret) ON v.is_py = mods.is_py)"""


@query("entities", "EXT1 EXT2 EXT3 EXT4", f"""
WITH {_ENT_SQL}
SELECT repo, path, name, type, start_line, end_line, signature, docstring, parent, params, return_type FROM ents""")
def entities(spark, sf):
    return x.entities(declared(spark, sf)).select(
        "repo", "path", "name", "type", "start_line", "end_line", "signature", "docstring", "parent",
        F.array_join("parameters", ",").alias("params"), "return_type",
    )


_IMPORTS = [
    (True, 2, "os", "os", None, False), (True, 3, "json", "json", "js", False), (True, 4, "app.m{k10}", "login_{k10}", None, False),
    (True, 5, "m{k20}", "helper_{k20},other_{k20}", None, True), (True, 6, "fastapi", "APIRouter", None, False),
    (False, 2, "./c{k10}", "api{k10},format", None, True), (False, 3, "react", "React", None, False),
]
_IMP_SQL = f"""{b.CODE_SQL}, imps AS (
  SELECT repo, path, CAST(v.n AS INTEGER) AS line_number, {_fill('v.m')} AS module, {_fill('v.names')} AS names, v.alias, v.rel AS is_relative, k10, k20, v.n
  FROM mods JOIN {_values(_IMPORTS)} v(is_py, n, m, names, alias, rel) ON v.is_py = mods.is_py)"""


@query("imports", "EXT5", f"WITH {_IMP_SQL} SELECT repo, path, line_number, module, names, alias, is_relative FROM imps")
def imports(spark, sf):
    return x.imports(declared(spark, sf)).select(
        "repo", "path", "line_number", "module", F.array_join("imported_names", ",").alias("names"), "alias", "is_relative"
    )


@query("page_links", "EXT5 JN3", """
WITH l AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]+)"', 1) AS ls FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, ls[i] AS module, FALSE AS is_internal FROM l, generate_series(1, 1000) g(i) WHERE i <= len(ls)""")
def page_links(spark, sf):
    pages = b.table(spark, sf, "pages").select("page_id", "url", "html")
    links = x.page_links(pages)
    known = pages.select(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("module"), F.lit(True).alias("known")).distinct()
    return graph.salted_join(links, known, ["module"], ["page_id", "pos"]).select(
        "page_id", "pos", "module", F.coalesce("known", F.lit(False)).alias("is_internal")
    )


@query("import_edges", "JN1 JN2 JN3", f"""
WITH {_IMP_SQL}, t AS (SELECT *, CASE WHEN module = 'app.m' || k10 THEN 'app/m' || k10 || '.py' WHEN module = 'm' || k20 THEN 'app/m' || k20 || '.py'
    WHEN module = './c' || k10 THEN 'web/c' || k10 || '.ts' END AS target FROM imps)
SELECT t.repo, t.path AS source_file, t.module AS target_module, t.line_number, m.path AS resolved_target_file, m.path IS NOT NULL AS is_internal
FROM t LEFT JOIN mods m ON m.repo = t.repo AND m.path = t.target""")
def import_edges(spark, sf):
    files = declared(spark, sf)
    return graph.resolve_imports(x.imports(files), files).drop("imported_symbols")


@query("routes", "EXT6", f"""
WITH {b.CODE_SQL}
SELECT repo, 'GET' AS method, CASE WHEN is_py THEN '/items/' || k ELSE '/web/' || k END AS route,
  CASE WHEN is_py THEN 'login_' || k ELSE 'route_handler' END AS handler_name, path AS file_path, CASE WHEN is_py THEN 27 ELSE 33 END AS line_number FROM mods""")
def routes(spark, sf):
    return x.routes(b.code_lines(spark, sf))


_SYM_SQL = f"""{_ENT_SQL}, first_files AS (SELECT repo, path FROM (SELECT DISTINCT repo, path FROM ents WHERE is_py)),
syms AS (SELECT repo, CASE WHEN type = 'method' THEN parent || '.' || name ELSE name END AS name, type AS symbol_type, path AS file_path, start_line, end_line,
  CASE WHEN type = 'class' THEN 'class ' || name ELSE 'def ' || name || '(' || replace(params, ',', ', ') || ')' END AS signature, docstring
  FROM ents JOIN first_files USING (repo, path) WHERE type IN ('class', 'method', 'function'))"""


@query("symbols", "EXT7", f"WITH {_SYM_SQL} SELECT * FROM syms")
def symbols(spark, sf):
    return x.symbols(x.entities(declared(spark, sf)))


_ENV_SQL = f"""{b.CODE_SQL}, ev AS (SELECT DISTINCT repo, CASE WHEN is_py THEN 'SERVICE_KEY_' ELSE 'HOME_' END || k7 AS name FROM mods)"""


@query("env_vars", "EXT8", f"""
WITH {_ENV_SQL} SELECT repo, name, CAST(row_number() OVER (PARTITION BY repo ORDER BY name) AS INTEGER) AS rank FROM ev""")
def env_vars(spark, sf):
    return x.env_vars(b.code_corpus(spark, sf))


_ROOT_FILES = ("package.json", "requirements.txt", "README.md", "docs/architecture.md", "pytest.ini", "src/package.json", "tests/test_a.py", "LICENSE")


def project_files(spark, sf):
    """Eight documents make one project with the usual root files; every third package manifest names jest."""
    d = F.col("doc_id")
    return b.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.floor(d / 8).cast("string")).alias("repo"),
        F.element_at(F.array(*[F.lit(n) for n in _ROOT_FILES]), (d % 8 + 1).cast("int")).alias("path"),
        F.when(F.floor(d / 8) % 3 == 0, F.concat(F.lit("jest "), "text")).otherwise(F.col("text")).alias("content"),
    )


@query("manifests", "EXT9", f"""
WITH p AS (SELECT 'd' || (doc_id // 8) AS repo, {list(_ROOT_FILES)}[doc_id % 8 + 1] AS path, CASE WHEN (doc_id // 8) % 3 = 0 THEN 'jest ' || text ELSE text END AS content, doc_id % 8 AS r FROM documents)
SELECT repo, path, CASE WHEN r < 2 THEN 'manifest' ELSE 'document' END AS kind, md5(content) AS digest FROM p WHERE r IN (0, 1, 2, 3, 7)""")
def manifests(spark, sf):
    return x.manifests(project_files(spark, sf)).select("repo", "path", "kind", F.md5("content").alias("digest"))


@query("test_frameworks", "EXT9", """
SELECT 'd' || (doc_id // 8) AS repo, array_to_string(list_filter([
  CASE WHEN bool_or(doc_id % 8 = 0 AND ((doc_id // 8) % 3 = 0 OR contains(text, 'jest'))) THEN 'jest' END,
  CASE WHEN bool_or(doc_id % 8 IN (4, 6)) THEN 'pytest' END], lambda v: v IS NOT NULL), ',') AS frameworks FROM documents GROUP BY ALL""")
def test_frameworks(spark, sf):
    return x.test_frameworks(project_files(spark, sf)).select("repo", F.array_join("test_frameworks", ",").alias("frameworks"))


@query("entity_chunks", "JN4 JN5 STR7 STR8 STR9", f"""
WITH {_ENT_SQL}
SELECT repo, repo || ':' || path || '#' || CASE WHEN parent IS NULL THEN '' ELSE parent || '.' END || name || '#L' || start_line || '-L' || end_line AS chunk_id,
  'File: ' || path || CASE WHEN parent IS NULL THEN '' ELSE ' | Scope: ' || parent END || ' | ' ||
  CASE type WHEN 'type_alias' THEN 'Type Alias' ELSE upper(left(type, 1)) || substr(type, 2) END || ': ' || name || ' | Lines: ' || start_line || '-' || end_line
  || ' | Signature: ' || signature AS context_header, CAST(end_line - start_line + 1 AS INTEGER) AS n_lines FROM ents""")
def entity_chunks(spark, sf):
    return chunks.chunk_corpus(declared(spark, sf)).select(
        "repo", "chunk_id", "context_header", F.size(text.split_lines(F.col("code_content"))).alias("n_lines")
    )


@query("mixed_chunks", "JN5 LIN7", f"""
WITH {_ENT_SQL}
SELECT repo, entity_type, count(*) AS n FROM (SELECT repo, type AS entity_type FROM ents WHERE doc_id % 3 <> 0
  UNION ALL SELECT repo, 'file_module' FROM mods WHERE doc_id % 3 = 0) GROUP BY ALL""")
def mixed_chunks(spark, sf):
    # Every third module is reduced to its comment lines, so it has no entity and falls back to a module chunk.
    files = b.code_corpus(spark, sf).withColumn(
        "content", F.when(F.col("doc_id") % 3 == 0, F.lit("# notes only\n# nothing else\n")).otherwise(F.col("content"))
    )
    all_chunks = chunks.chunk_corpus(x.with_declarations(src.with_lines(src.code_files(files))))
    return all_chunks.groupBy("repo", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("enclosing_entities", "JN6 SR11", f"""
WITH {b.CODE_SQL}, t AS (SELECT *, CAST(doc_id % 45 + 1 AS INTEGER) AS line FROM mods)
SELECT repo, path, line, CASE WHEN is_py THEN CASE WHEN line BETWEEN 15 AND 16 THEN '__init__' WHEN line BETWEEN 18 AND 24 THEN 'run'
    WHEN line BETWEEN 12 AND 24 THEN 'Service' || k WHEN line BETWEEN 28 AND 33 THEN 'login_' || k WHEN line BETWEEN 36 AND 48 THEN '_verify_' || k END
  ELSE CASE WHEN line BETWEEN 5 AND 7 THEN 'Props' || k WHEN line = 9 THEN 'Id' || k WHEN line BETWEEN 15 AND 20 THEN 'render' WHEN line BETWEEN 14 AND 21 THEN 'Widget' || k
    WHEN line BETWEEN 23 AND 27 THEN 'format' || k WHEN line BETWEEN 29 AND 31 THEN 'fetch' || k
    WHEN line BETWEEN 36 AND 41 THEN 'load' || k WHEN line BETWEEN 43 AND 47 THEN 'save' || k END END AS entity_name FROM t""")
def enclosing_entities(spark, sf):
    line = (F.col("doc_id") % 45 + 1).cast("int")
    return declared(spark, sf).select(
        "repo", "path", line.alias("line"), x.enclosing(F.col("decls"), line)["name"].alias("entity_name")
    )


_METRICS = [
    (True, "Service{k}", "class", 12, 24, None, None, None, True), (True, "__init__", "function", 15, 16, 1, 0, 2, False),
    (True, "run", "function", 18, 24, 6, 4, 6, False), (True, "login_{k}", "function", 28, 33, 2, 1, 2, True),
    (True, "_verify_{k}", "function", 36, 48, 1, 0, 1, False), (False, "Widget{k}", "class", 14, 21, None, None, None, False),
    (False, "render", "method", 15, 20, 4, 2, 0, False), (False, "format{k}", "function", 23, 27, 1, 1, 0, False),
    (False, "fetch{k}", "function", 29, 31, 1, 2, 0, False), (True, "deploy_{k}", "function", 51, 64, 1, 0, 2, True),
    (False, "load{k}", "function", 36, 41, 1, 1, 0, False), (False, "save{k}", "function", 43, 47, 1, 1, 0, False),
]
_MET_SQL = f"""{b.CODE_SQL}, met AS (
  SELECT repo, path, {_fill('v.name')} AS entity_name, v.type AS entity_type, CAST(v.s AS INTEGER) AS start_line, CAST(v.e AS INTEGER) AS end_line,
    CAST(v.e - v.s + 1 AS INTEGER) AS lines_count, CAST(v.cx AS INTEGER) AS cyclomatic_complexity, CAST(v.nest AS INTEGER) AS max_nesting_depth,
    CAST(v.pc AS INTEGER) AS parameter_count, v.doc AS has_docstring, NOT starts_with(v.name, '_') OR v.name = '__init__' AS is_public
  FROM mods JOIN {_values(_METRICS)} v(is_py, name, type, s, e, cx, nest, pc, doc) ON v.is_py = mods.is_py)"""


@query("entity_metrics", "QR3 QR4 QR5 ARR1 ARR2 PRJ7", f"""
WITH {_MET_SQL} SELECT * FROM met""")
def entity_metrics(spark, sf):
    return q.entity_metrics(declared(spark, sf)).drop("language", "first_line")


_WORD = "(^|[^\\p{L}\\p{N}_])WORD([^\\p{L}\\p{N}_]|$)"
_FND_SQL = f"""{_MET_SQL}, fnd AS (
  SELECT repo, path, start_line, 'FUNCTION_TOO_LONG' AS rule_id, CASE WHEN lines_count >= 10 THEN 'error' ELSE 'warning' END AS severity, 'size' AS category, entity_name
  FROM met WHERE entity_type <> 'class' AND lines_count >= 6
  UNION ALL SELECT repo, path, start_line, 'HIGH_CYCLOMATIC_COMPLEXITY', CASE WHEN cyclomatic_complexity >= 6 THEN 'error' ELSE 'warning' END, 'complexity', entity_name FROM met WHERE cyclomatic_complexity >= 4
  UNION ALL SELECT repo, path, start_line, 'EXCESSIVE_NESTING', 'error', 'complexity', entity_name FROM met WHERE max_nesting_depth >= 4
  UNION ALL SELECT repo, path, start_line, 'TOO_MANY_PARAMETERS', 'warning', 'maintainability', entity_name FROM met WHERE parameter_count >= 5
  UNION ALL SELECT repo, path, start_line, 'MISSING_DOCSTRING', 'info', 'documentation', entity_name FROM met WHERE is_public AND NOT has_docstring
  UNION ALL SELECT repo, path, 32, 'BROAD_EXCEPTION', 'error', 'error_handling', NULL FROM mods WHERE is_py
  UNION ALL SELECT repo, path, 4, 'POTENTIALLY_UNUSED_IMPORT', 'info', 'maintainability', 'login_' || k10 FROM mods WHERE is_py
  UNION ALL SELECT repo, path, 5, 'POTENTIALLY_UNUSED_IMPORT', 'info', 'maintainability', 'other_' || k20 FROM mods WHERE is_py
  UNION ALL SELECT repo, path, 2, 'POTENTIALLY_UNUSED_IMPORT', 'info', 'maintainability', 'api' || k10 FROM mods WHERE NOT is_py
  UNION ALL SELECT repo, path, 2, 'POTENTIALLY_UNUSED_IMPORT', 'info', 'maintainability', 'format' FROM mods WHERE NOT is_py AND NOT regexp_matches(text, '{_WORD.replace("WORD", "format")}')
  UNION ALL SELECT repo, path, 3, 'POTENTIALLY_UNUSED_IMPORT', 'info', 'maintainability', 'React' FROM mods WHERE NOT is_py AND NOT regexp_matches(text, '{_WORD.replace("WORD", "React")}')
  UNION ALL SELECT repo, path, 1, 'FILE_TOO_LARGE', CASE WHEN n >= 800 THEN 'error' ELSE 'warning' END, 'size', NULL
    FROM (SELECT repo, path, CASE WHEN is_py THEN {b.PY_LINES} ELSE {b.TS_LINES} END + len(string_split(text, chr(10))) AS n FROM mods) WHERE n >= 400)"""


@query("code_quality_findings", "QR2 QR3 QR4 QR5 QR6 QR7 QR8 JN9", f"""
WITH {_FND_SQL} SELECT repo, path, CAST(start_line AS INTEGER) AS start_line, rule_id, severity, category, entity_name FROM fnd""")
def code_quality_findings(spark, sf):
    found = q.file_findings(declared(spark, sf), LIMITS)
    return found.select("repo", "path", "start_line", "rule_id", "severity", "category", "entity_name")


@query("code_repo_metrics", "AGG7", f"""
WITH {_FND_SQL}, n AS (SELECT repo, path, is_py, len(string_split(text, chr(10))) AS t FROM mods),
l AS (SELECT repo, CAST(sum(CASE WHEN is_py THEN {b.PY_LINES} ELSE {b.TS_LINES} END + t) AS BIGINT) AS total_lines, CAST(sum(CASE WHEN is_py THEN 49 ELSE 35 END) AS BIGINT) AS code_lines,
  CAST(sum(CASE WHEN is_py THEN 4 ELSE 4 END + t) AS BIGINT) AS comment_lines, CAST(sum(CASE WHEN is_py THEN 13 ELSE 8 END) AS BIGINT) AS blank_lines, count(*) AS total_files_analyzed FROM n GROUP BY repo),
e AS (SELECT repo, count(*) FILTER (WHERE entity_type <> 'class') AS total_functions, count(*) FILTER (WHERE entity_type = 'class') AS total_classes,
  round_even(avg(lines_count) FILTER (WHERE entity_type <> 'class'), 1) AS average_function_length, round_even(avg(cyclomatic_complexity), 1) AS average_cyclomatic_complexity,
  max(cyclomatic_complexity) AS max_cyclomatic_complexity, round_even(count(*) FILTER (WHERE is_public AND has_docstring) / count(*) FILTER (WHERE is_public) * 100.0::DOUBLE, 1) AS docstring_coverage_percentage FROM met GROUP BY repo),
i AS (SELECT repo, count(DISTINCT path) AS files_with_issues FROM fnd GROUP BY repo)
SELECT *, CAST(0 AS BIGINT) AS duplicate_blocks_count FROM l JOIN e USING (repo) JOIN i USING (repo)""")
def code_repo_metrics(spark, sf):
    return q.repo_metrics(q.file_items(declared(spark, sf), LIMITS))


_SEC = [
    (True, 23, "PYTHON_DANGEROUS_EVAL", "high", "high", "run", "CWE-95"),
    (True, 32, "PYTHON_BROAD_EXCEPTION_SECURITY", "low", "low", "login_{k}", "CWE-391"),
    (True, 37, "PYTHON_HARDCODED_CREDENTIAL", "high", "medium", "_verify_{k}", "CWE-798"),
    (True, 38, "PYTHON_WEAK_CRYPTO", "medium", "medium", "_verify_{k}", "CWE-328"),
    (True, 39, "PYTHON_SQL_INJECTION", "high", "medium", "_verify_{k}", "CWE-89"),
    (True, 40, "PYTHON_INSECURE_TLS", "high", "high", "_verify_{k}", "CWE-295"),
    (True, 41, "PYTHON_UNSAFE_DESERIALIZATION", "high", "high", "_verify_{k}", "CWE-502"),
    (True, 42, "PYTHON_UNSAFE_DESERIALIZATION", "high", "high", "_verify_{k}", "CWE-502"),
    (True, 44, "PYTHON_INSECURE_SUBPROCESS", "medium", "high", "_verify_{k}", "CWE-78"),
    (True, 45, "PYTHON_DANGEROUS_EXEC", "high", "high", "_verify_{k}", "CWE-95"),
    (True, 46, "PYTHON_INSECURE_TLS", "high", "high", "_verify_{k}", "CWE-295"),
    (True, 48, "PYTHON_INSECURE_SUBPROCESS", "high", "high", "_verify_{k}", "CWE-78"),
    (True, 56, "PYTHON_INSECURE_SUBPROCESS", "high", "high", "deploy_{k}", "CWE-78"),
    (True, 60, "PYTHON_INSECURE_TLS", "high", "high", "deploy_{k}", "CWE-295"),
    (False, 17, "JS_DANGEROUS_EVAL", "high", "high", None, "CWE-95"),
    (False, 25, "JS_HARDCODED_CREDENTIAL", "high", "medium", None, "CWE-798"),
    (False, 26, "JS_WEAK_CRYPTO", "medium", "medium", None, "CWE-328"),
    (False, 30, "JS_INSECURE_TLS", "high", "high", None, "CWE-295"),
]


@query("code_security_findings", "SR1 SR2 SR3 SR4 SR5 SR6 SR7 SR8 SR9 SR10 SR11 JN15 SET1", f"""
WITH {b.CODE_SQL}
SELECT repo, path, CAST(v.n AS INTEGER) AS start_line, v.rule AS rule_id, v.sev AS severity, v.conf AS confidence, {_fill('v.ent')} AS entity_name, v.cwe AS cwe_id
FROM mods JOIN {_values(_SEC)} v(is_py, n, rule, sev, conf, ent, cwe) ON v.is_py = mods.is_py AND (n <> 56 OR doc_id % 3 = 0)""")
def code_security_findings(spark, sf):
    return s.all_findings(declared(spark, sf)).select(
        "repo", "path", "start_line", "rule_id", "severity", "confidence", "entity_name", "cwe_id"
    )


_SUMMARY_SQL = f"""{b.CODE_SQL}, sec AS (
  SELECT repo, v.sev, v.cat FROM mods JOIN (SELECT *, CASE cwe WHEN 'CWE-95' THEN 'code_execution' WHEN 'CWE-391' THEN 'error_handling' WHEN 'CWE-798' THEN 'credentials'
    WHEN 'CWE-328' THEN 'cryptography' WHEN 'CWE-89' THEN 'sql_injection' WHEN 'CWE-295' THEN 'insecure_communication' WHEN 'CWE-502' THEN 'deserialization' ELSE 'command_injection' END AS cat
    FROM {_values(_SEC)} w(is_py, n, rule, sev, conf, ent, cwe)) v ON v.is_py = mods.is_py AND (v.n <> 56 OR doc_id % 3 = 0)),
cats AS (SELECT repo, cat, count(*) AS c FROM sec GROUP BY ALL),
top AS (SELECT repo, array_to_string(list(cat || ' (' || c || ')' ORDER BY c DESC, cat)[1:3], ', ') AS areas FROM cats GROUP BY repo)
SELECT repo, 'Static security scan for ''' || repo || ''' identified ' || count(*) || ' finding(s) (' || count(*) FILTER (sev = 'critical') || ' critical, '
  || count(*) FILTER (sev = 'high') || ' high, ' || count(*) FILTER (sev = 'medium') || ' medium, ' || count(*) FILTER (sev = 'low') || ' low, '
  || count(*) FILTER (sev = 'informational') || ' informational), requiring high attention. Primary areas: ' || any_value(areas) || '.' AS summary
FROM sec JOIN top USING (repo) GROUP BY repo"""


@query("security_summary_text", "AGG11 AGG12 STR17", f"WITH {_SUMMARY_SQL}")
def security_summary_text(spark, sf):
    files = declared(spark, sf)
    return s.summary_text(s.all_findings(files), files)


@query("codebase_summary", "AGG5", f"""
WITH {b.CODE_SQL}
SELECT repo, count(*) AS files_analyzed, count(*) FILTER (WHERE is_py) AS python_files, CAST(0 AS BIGINT) AS javascript_files,
  count(*) FILTER (WHERE NOT is_py) AS typescript_files, count(*) AS classes, CAST(sum(CASE WHEN is_py THEN 3 ELSE 4 END) AS BIGINT) AS functions,
  CAST(sum(CASE WHEN is_py THEN 2 ELSE 1 END) AS BIGINT) AS methods, count(*) FILTER (WHERE NOT is_py) AS interfaces, count(*) FILTER (WHERE NOT is_py) AS types,
  CAST(sum(CASE WHEN is_py THEN 5 ELSE 2 END) AS BIGINT) AS imports, CAST(0 AS BIGINT) AS files_with_errors FROM mods GROUP BY repo""")
def codebase_summary(spark, sf):
    return graph.codebase_summary(src.with_problem(declared(spark, sf)))


def _module_text(first: int, last: int) -> str:
    """SQL for lines of the Python module of a row of ``mods``."""
    lines = b.PY_MODULE.replace("{{", "{").replace("}}", "}").split("\n")[first - 1 : last]
    text = "'" + "\n".join(lines).strip().replace("'", "''") + "'"
    return f"replace({_fill(text)}, '{{kflag}}', CASE WHEN doc_id % 3 = 0 THEN 'True' ELSE 'False' END)"


_HELPERS = [("login_{k}", 28, 33, 1), ("_verify_{k}", 36, 48, 2), ("deploy_{k}", 51, 64, 3)]


@query("target_helpers", "SRCH10", f"""
WITH {b.CODE_SQL}, fn AS (SELECT repo, path, v.no, {_fill('v.name')} AS name, CASE v.no {" ".join(f"WHEN {n} THEN {_module_text(a, z)}" for _, a, z, n in _HELPERS)} END AS code
  FROM mods JOIN (VALUES {", ".join(f"('{name}', {n})" for name, _, _, n in _HELPERS)}) v(name, no) ON is_py),
targets AS (SELECT repo, path, name, NULL AS parent, code FROM fn
  UNION ALL SELECT repo, path, v.name, 'Service' || k, CASE v.name WHEN 'run' THEN {_module_text(18, 24)} ELSE {_module_text(15, 16)} END FROM mods JOIN (VALUES ('__init__'), ('run')) v(name) ON is_py)
SELECT t.repo, t.path, t.name, t.parent, CAST(count(*) AS INTEGER) AS n_helpers, CAST(any_value(length(t.code)) + sum(length(f.code)) AS INTEGER) AS used_chars,
  md5(array_to_string(list(f.code ORDER BY f.no), chr(10))) AS digest
FROM targets t JOIN fn f ON f.repo = t.repo AND f.path = t.path AND f.name <> t.name GROUP BY ALL""")
def target_helpers(spark, sf):
    """The helper functions that go with each function and method of the modules."""
    found = retrieval.target_contexts(declared(spark, sf))
    return found.select(
        "repo", "path", "name", "parent", F.size("helper_snippets").alias("n_helpers"), "used_chars", F.md5(F.array_join("helper_snippets", "\n")).alias("digest"))


@query("rejected_files", "SRC6", f"""
WITH {b.CODE_SQL}
SELECT repo, path, 'Python' AS language, 'SyntaxError' AS error_type,
  'Line ' || ({b.PY_LINES} + len(string_split(text, chr(10))) + 1) || CASE WHEN doc_id % 4 = 0 THEN ': invalid syntax' ELSE ': expected ''(''' END AS message
FROM mods WHERE is_py AND doc_id % 6 = 0""")
def rejected_files(spark, sf):
    broken = F.when(F.col("doc_id") % 4 == 0, F.lit("def broken(:\n    return\n")).otherwise(F.lit("def broken\n    return 1\n"))
    files = b.code_corpus(spark, sf).withColumn(
        "content", F.when(F.col("doc_id") % 6 == 0, F.concat("content", broken)).otherwise(F.col("content"))
    )
    return src.split_rejects(src.code_files(files))[1]


@query("structure_map", "TOP4", f"""
WITH {_ENT_SQL}
SELECT repo, path AS node_path, 'file' AS node_type, 0 AS depth, (CASE WHEN is_py THEN {b.PY_LINES} ELSE {b.TS_LINES} END + len(string_split(text, chr(10)))) || ' lines' AS line_info, NULL AS docstring FROM mods
UNION ALL SELECT repo, path || '::' || CASE WHEN type = 'method' THEN parent || '::' ELSE '' END || name, type, CASE WHEN type = 'method' THEN 2 ELSE 1 END,
  'L' || start_line || '-L' || end_line, docstring FROM ents WHERE type <> 'variable'""")
def structure_map(spark, sf):
    files = declared(spark, sf)
    return graph.structure_map(files, x.entities(files)).select("repo", "node_path", "node_type", "depth", "line_info", "docstring")


def _evidence(spark, sf):
    """With the bounds that the survey words and the statements hold; ``doc_evidence_rows`` is without any."""
    files = declared(spark, sf)
    return docs.evidence(
        files, x.routes(files), x.symbols(x.entities(files)), x.env_vars(files),
        max_routes=docs.MAX_ROUTES, max_symbols=docs.MAX_SYMBOLS, max_env_vars=docs.MAX_ENV_VARS,
    )


@query("doc_evidence", "AGG18", f"""
WITH {_SYM_SQL}, rt AS (SELECT repo, path, CASE WHEN is_py THEN 27 ELSE 33 END AS ln FROM mods),
ev AS (SELECT DISTINCT repo, CASE WHEN is_py THEN 'SERVICE_KEY_' ELSE 'HOME_' END || k7 AS name FROM mods)
SELECT r.repo, least(40, count(*)) AS n_routes, any_value(s.n) AS n_symbols, any_value(e.names) AS env_vars, any_value(f.n) AS source_files
FROM rt r JOIN (SELECT repo, least(50, count(*)) AS n FROM syms GROUP BY repo) s USING (repo)
JOIN (SELECT repo, array_to_string(list(name ORDER BY name)[1:25], ',') AS names FROM ev GROUP BY repo) e USING (repo)
JOIN (SELECT repo, count(DISTINCT path) AS n FROM rt GROUP BY repo) f USING (repo) GROUP BY r.repo""")
def doc_evidence(spark, sf):
    return _evidence(spark, sf).select(
        "repo", F.size("routes").cast("long").alias("n_routes"), F.size("symbols").cast("long").alias("n_symbols"),
        F.array_join("environment_vars", ",").alias("env_vars"), "source_files",
    )


@query("api_reference", "AGG19", f"""
WITH {b.CODE_SQL}, rt AS (SELECT repo, path, CASE WHEN is_py THEN 27 ELSE 33 END AS ln, CASE WHEN is_py THEN '/items/' || k ELSE '/web/' || k END AS route,
  CASE WHEN is_py THEN 'login_' || k ELSE 'route_handler' END AS h FROM mods QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, ln) <= 40)
SELECT repo, md5('# ' || repo || ' — API Reference' || chr(10) || chr(10) || 'Endpoints found in `' || repo || '`.' || chr(10) || chr(10) ||
  array_to_string(list('## `GET ' || route || '`' || chr(10) || chr(10) || '- **Handler**: `' || h || '()`' || chr(10) || '- **Location**: `' || path || ':' || ln || '`' || chr(10) ORDER BY path, ln), chr(10))) AS digest
FROM rt GROUP BY repo""")
def api_reference(spark, sf):
    return docs.api_reference(_evidence(spark, sf), docs.LISTED_SYMBOLS).select("repo", F.md5("document").alias("digest"))


@query("function_reference", "AGG19", f"""
WITH {_SYM_SQL}, svc AS (SELECT * FROM syms WHERE contains(name, 'Service')),
blocks AS (SELECT repo, '## `' || name || '`' || chr(10) || chr(10) || '- **Type**: `' || symbol_type || '`' || chr(10) || '- **Defined in**: `' || file_path || ':' || start_line || '`' || chr(10)
  || '- **Signature**: `' || signature || '`' || chr(10) || chr(10) || '### Description' || chr(10) || chr(10) || coalesce(docstring, 'No docstring provided in source.') || chr(10) AS block, file_path, start_line, name FROM svc)
SELECT repo, md5('# ' || repo || ' — Function Reference' || chr(10) || chr(10) || array_to_string(list(block ORDER BY file_path, start_line, name), chr(10))) AS digest FROM blocks GROUP BY repo""")
def function_reference(spark, sf):
    files = declared(spark, sf)
    symbols = x.symbols(x.entities(files)).filter(F.col("name").contains("Service"))
    whole = docs.evidence(files, x.routes(files), symbols, x.env_vars(files))
    return docs.function_reference(whole, "Service").select("repo", F.md5("document").alias("digest"))


@query("api_reference_whole", "AGG19", f"""
WITH {b.CODE_SQL}, rt AS (SELECT repo, path, CASE WHEN is_py THEN 27 ELSE 33 END AS ln, CASE WHEN is_py THEN '/items/' || k ELSE '/web/' || k END AS route,
  CASE WHEN is_py THEN 'login_' || k ELSE 'route_handler' END AS h FROM mods)
SELECT repo, md5('# ' || repo || ' — API Reference' || chr(10) || chr(10) || 'Endpoints found in `' || repo || '`.' || chr(10) || chr(10) ||
  array_to_string(list('## `GET ' || route || '`' || chr(10) || chr(10) || '- **Handler**: `' || h || '()`' || chr(10) || '- **Location**: `' || path || ':' || ln || '`' || chr(10) ORDER BY path, ln), chr(10))) AS digest
FROM rt GROUP BY repo""")
def api_reference_whole(spark, sf):
    """All routes of every repository, without the survey's bound."""
    files = declared(spark, sf)
    whole = docs.evidence(files, x.routes(files), x.symbols(x.entities(files)), x.env_vars(files))
    return docs.api_reference(whole).select("repo", F.md5("document").alias("digest"))


@query("doc_evidence_rows", "AGG18", f"""
WITH {_SYM_SQL}, ev AS (SELECT DISTINCT repo, CASE WHEN is_py THEN 'SERVICE_KEY_' ELSE 'HOME_' END || k7 AS name FROM mods),
r AS (SELECT repo, 'route' AS kind, path AS place, CASE WHEN is_py THEN 27 ELSE 33 END AS line,
    'GET ' || CASE WHEN is_py THEN '/items/' || k || ' login_' || k ELSE '/web/' || k || ' route_handler' END || ' ' || path || ':' || CASE WHEN is_py THEN 27 ELSE 33 END AS item FROM mods
  UNION ALL SELECT repo, 'symbol', file_path, start_line, symbol_type || ' ' || name || ' ' || file_path || ':' || start_line FROM syms
  UNION ALL SELECT repo, 'variable', name, 0, name FROM ev)
SELECT repo, kind, row_number() OVER (PARTITION BY repo, kind ORDER BY place, line, item) AS rank, item, count(*) OVER (PARTITION BY repo, kind) AS n FROM r""")
def doc_evidence_rows(spark, sf):
    files = declared(spark, sf)
    return docs.evidence_rows(x.routes(files), x.symbols(x.entities(files)), x.env_vars(files))


# Markdown derived from the documents: a title, a summary paragraph, and a section per kind of note.
_MD_SQL = """md AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# Title ' || doc_id || chr(10) || chr(10) || 'Summary of ' || doc_id || chr(10) || chr(10) ELSE '' END ||
  CASE WHEN doc_id % 3 < 2 THEN '## Notes' || chr(10) || chr(10) || replace(text, '#', '') || chr(10) || '## Open points' || chr(10) || 'TODO: check ' || doc_id || chr(10) || 'Run it [Requires Confirmation: site ' || doc_id || ']' ELSE replace(text, '#', '') END AS text, replace(text, '#', '') AS body FROM documents)"""


def markdown(spark, sf):
    d, k = F.col("doc_id"), F.col("doc_id").cast("string")
    body = F.replace("text", F.lit("#"), F.lit(""))
    head = F.when(d % 3 == 0, F.concat(F.lit("# Title "), k, F.lit("\n\nSummary of "), k, F.lit("\n\n"))).otherwise(F.lit(""))
    rest = F.when(
        d % 3 < 2,
        F.concat(F.lit("## Notes\n\n"), body, F.lit("\n## Open points\nTODO: check "), k, F.lit("\nRun it [Requires Confirmation: site "), k, F.lit("]")),
    ).otherwise(body)
    return b.table(spark, sf, "documents").select("doc_id", F.concat(head, rest).alias("text"))


@query("markdown_sections", "STR16", f"""
WITH {_MD_SQL}
SELECT doc_id, CAST(1 AS INTEGER) AS section_no, 'Notes' AS title, md5({b.strip_sql('body')}) AS digest FROM md WHERE doc_id % 3 < 2
UNION ALL SELECT doc_id, CAST(2 AS INTEGER), 'Open points', md5('TODO: check ' || doc_id || chr(10) || 'Run it [Requires Confirmation: site ' || doc_id || ']') FROM md WHERE doc_id % 3 < 2""")
def markdown_sections(spark, sf):
    return docs.markdown_sections(markdown(spark, sf), "doc_id").select("doc_id", "section_no", "title", F.md5("content").alias("digest"))


@query("markdown_titles", "STR16", f"""
WITH {_MD_SQL}
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Title ' || doc_id ELSE 'Technical Documentation' END AS title,
  CASE doc_id % 3 WHEN 0 THEN 'Summary of ' || doc_id WHEN 1 THEN coalesce(nullif({b.strip_sql("replace(left(" + b.strip_sql('body') + ", 250), chr(10), ' ')")}, ''), 'Technical documentation covering Technical Documentation.')
  ELSE 'Technical documentation covering Technical Documentation.' END AS summary FROM md""")
def markdown_titles(spark, sf):
    return docs.markdown_outline(markdown(spark, sf)).select("doc_id", "title", "summary")


@query("unverified_markers", "STR15", f"""
WITH {_MD_SQL}, t AS (SELECT doc_id, text, body FROM md),
n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)\\b(?:TODO|FIXME|TBD|PLACEHOLDER)\\b:?\\s*([^\\n]+)', 1), lambda v: left({b.strip_sql('v')}, 100)) AS notes,
  list_transform(regexp_extract_all(text, '(?i)\\[Requires Confirmation(?::\\s*([^\\]]+))?\\]', 1), lambda v: {b.strip_sql('v')}) AS tags FROM t)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(tags, notes))), '|') AS items FROM n""")
def unverified_markers(spark, sf):
    return markdown(spark, sf).select("doc_id", F.array_join(text.unverified_markers(F.col("text")), "|").alias("items"))
