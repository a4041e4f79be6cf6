"""Traces, test logs and coverage reports derived from events and documents."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import functions as F

from corpusloom.functions import paths, secrets
from corpusloom.operators import retrieval, testruns as tr, traces as t
from corpusloom.plans import bindings as b
from corpusloom.plans.code_queries import declared
from corpusloom.plans.registry import query
from corpusloom.session import shared_folder, stored
from corpusloom.sources import logs, tree

# Every error event is one log text of four kinds; its frames name a derived module of repository r<m % 5>.
_TRACE_SQL = """tr AS (SELECT event_id AS trace_id, CAST(2 * (event_id % 90) AS VARCHAR) AS m, 2 * (event_id % 90) AS mn, event_id % 4 AS kind, CAST(user_id AS VARCHAR) AS u, event_id % 30 + 10 AS ln
  FROM events WHERE event_type = 'error')"""


def traces(spark, sf, events=None):
    e = F.col("event_id")
    m = (2 * (e % 90)).cast("string")
    u, ln = F.col("user_id").cast("string"), (e % 30 + 10).cast("string")
    python = F.concat(
        F.lit('Traceback (most recent call last):\n  File "/srv/app/m'), m, F.lit('.py", line '), ln, F.lit(", in handler_"), u,
        F.lit('\n    value = load(raw)\n  File "/usr/lib/python3/json.py", line 9, in loads\n    raise Broken\nKeyError: \'user_'), u, F.lit("'\n"),
    )
    script = F.concat(
        F.lit("TypeError: None of user "), u, F.lit("\n    at fetch_"), u, F.lit(" (app/m"), m, F.lit(".py:"), ln,
        F.lit(":5)\n    at run (/srv/node_modules/x.js:3:1)\n"),
    )
    plain = F.concat(F.lit("FATAL: timeout for "), u, F.lit(" at db/pool"), m, F.lit(".py:102"))
    note = F.concat(F.lit("\n  service stopped for "), u, F.lit("\nsecond line"))
    body = F.when(e % 4 == 0, python).when(e % 4 == 1, script).when(e % 4 == 2, plain).otherwise(note)
    rows = b.table(spark, sf, "events") if events is None else events
    return rows.filter(F.col("event_type") == "error").select(
        e.alias("trace_id"), F.concat(F.lit("r"), ((2 * (e % 90)) % 5).cast("string")).alias("repo"), body.alias("text"),
        F.lit(None).cast("string").alias("language_hint"),
        F.when(e % 4 == 3, F.concat(F.lit("app/m"), m, F.lit(".py"))).alias("user_file_path"),
    )


@query("trace_errors", "EXT11 EXT12 SET4", f"""
WITH {_TRACE_SQL}
SELECT trace_id, CASE kind WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'python' END AS language,
  CASE kind WHEN 0 THEN 'KeyError' WHEN 1 THEN 'TypeError' END AS error_type,
  CASE kind WHEN 0 THEN '''user_' || u || '''' WHEN 1 THEN 'None of user ' || u WHEN 2 THEN 'FATAL: timeout for ' || u || ' at db/pool' || m || '.py:102' ELSE 'service stopped for ' || u END AS error_message,
  CASE kind WHEN 0 THEN '/srv/app/m' || m || '.py,/usr/lib/python3/json.py' WHEN 1 THEN 'app/m' || m || '.py,/srv/node_modules/x.js' WHEN 2 THEN 'db/pool' || m || '.py' ELSE '' END AS file_paths FROM tr""")
def trace_errors(spark, sf):
    return t.parse_traces(traces(spark, sf)).select(
        "trace_id", "language", "error_type", "error_message", F.array_join("file_paths", ",").alias("file_paths")
    )


@query("trace_frames", "EXT10 PRJ9 PRJ10", f"""
WITH {_TRACE_SQL}
SELECT trace_id, 1 AS frame_no, CASE kind WHEN 0 THEN '/srv/app/m' || m || '.py' WHEN 1 THEN 'app/m' || m || '.py' ELSE 'db/pool' || m || '.py' END AS file_path,
  CAST(CASE kind WHEN 2 THEN 102 ELSE ln END AS INTEGER) AS line_number, CASE kind WHEN 0 THEN 'handler_' || u WHEN 1 THEN 'fetch_' || u END AS function_name,
  CASE kind WHEN 0 THEN 'value = load(raw)' END AS code_context, TRUE AS is_application_code FROM tr WHERE kind < 3
UNION ALL SELECT trace_id, 2, CASE kind WHEN 0 THEN '/usr/lib/python3/json.py' ELSE '/srv/node_modules/x.js' END, CASE kind WHEN 0 THEN 9 ELSE 3 END,
  CASE kind WHEN 0 THEN 'loads' ELSE 'run' END, CASE kind WHEN 0 THEN 'raise Broken' END, FALSE FROM tr WHERE kind < 2""")
def trace_frames(spark, sf):
    return t.frames(t.parse_traces(traces(spark, sf))).drop("repo")


_MODS = "mods AS (SELECT doc_id, 'r' || (doc_id % 5) AS repo, 'app/m' || doc_id || '.py' AS path FROM documents WHERE doc_id % 2 = 0)"


@query("suffix_resolve", "JN7", f"""
WITH {_TRACE_SQL}, {_MODS}
SELECT trace_id, CASE kind WHEN 0 THEN '/srv/app/m' || m || '.py' WHEN 1 THEN 'app/m' || m || '.py' ELSE 'db/pool' || m || '.py' END AS file_path,
  CASE WHEN kind < 2 THEN p.path END AS resolved_path FROM tr LEFT JOIN mods p ON p.doc_id = tr.mn WHERE kind < 3
UNION ALL SELECT trace_id, CASE kind WHEN 0 THEN '/usr/lib/python3/json.py' ELSE '/srv/node_modules/x.js' END, NULL FROM tr WHERE kind < 2""")
def suffix_resolve(spark, sf):
    rows = t.frames(t.parse_traces(traces(spark, sf)))
    return t.resolve_paths(rows, b.code_corpus(spark, sf)).select("trace_id", "file_path", "resolved_path")


@query("missing_files", "JN8", f"""
WITH {_TRACE_SQL}, {_MODS}
SELECT trace_id, CASE kind WHEN 2 THEN 'db/pool' || m || '.py' WHEN 0 THEN '/srv/app/m' || m || '.py' ELSE 'app/m' || m || '.py' END AS file_path
FROM tr LEFT JOIN mods p ON p.doc_id = tr.mn WHERE kind = 2 OR (kind < 2 AND p.path IS NULL)""")
def missing_files(spark, sf):
    rows = t.frames(t.parse_traces(traces(spark, sf)))
    return t.missing_files(t.resolve_paths(rows, b.code_corpus(spark, sf))).select("trace_id", "file_path")


_SPAN = """CASE WHEN ln BETWEEN 12 AND 24 THEN CASE WHEN ln BETWEEN 15 AND 16 THEN [15, 16] WHEN ln BETWEEN 18 AND 24 THEN [18, 24] ELSE [12, 24] END
  WHEN ln BETWEEN 28 AND 33 THEN [28, 33] WHEN ln BETWEEN 36 AND 48 THEN [36, 48] ELSE [greatest(1, ln - 15), ln + 15] END"""


@query("trace_evidence", "SRCH11 JN14 JN6 LIN8 STR11", f"""
WITH {_TRACE_SQL}, {_MODS}, e AS (SELECT trace_id, path, kind, {_SPAN} AS span FROM tr JOIN mods p ON p.doc_id = tr.mn WHERE kind IN (0, 1, 3))
SELECT trace_id, 1 AS evidence_no, path, CAST(CASE kind WHEN 3 THEN 1 ELSE span[1] END AS INTEGER) AS start_line, CAST(CASE kind WHEN 3 THEN 50 ELSE span[2] END AS INTEGER) AS end_line FROM e""")
def trace_evidence(spark, sf):
    packed = t.pack_evidence(t.parse_traces(traces(spark, sf)), declared(spark, sf))
    return t.evidence_rows(packed).select("trace_id", "evidence_no", "path", "start_line", "end_line")


@query("evidence_texts", "SRCH11 STR11", f"""
WITH {_TRACE_SQL}, {_MODS}, e AS (SELECT trace_id, path, kind, ln, u, {_SPAN} AS span FROM tr JOIN mods p ON p.doc_id = tr.mn WHERE kind IN (0, 1, 3)),
n AS (SELECT trace_id, path, CASE kind WHEN 3 THEN 1 ELSE span[1] END AS a, CASE kind WHEN 3 THEN 50 ELSE span[2] END AS z FROM e)
SELECT trace_id, '--- [Evidence E1] File: ' || path || ' (Lines ' || a || '-' || z || ')' AS head, z - a + 1 AS n_lines FROM n""")
def evidence_texts(spark, sf):
    """The evidence of each trace as one text: where it begins, and how many numbered lines it shows."""
    packed = t.pack_evidence(t.parse_traces(traces(spark, sf)), declared(spark, sf))
    text_of = t.evidence_text(packed)
    return text_of.select(
        "trace_id", F.regexp_extract("context_text", r"^(--- \[Evidence E1\] File: [^|\n]*?\)|No matching[^\n]*)", 1).alias("head"),
        F.regexp_count("context_text", F.lit(r"(?m)^\s*\d+ \|")).alias("n_lines"),
    )


@query("trace_diagnosis", "SRCH13 PRJ15", f"""
WITH {_TRACE_SQL}, {_MODS}
SELECT trace_id, CASE kind WHEN 0 THEN 'KeyError' WHEN 1 THEN 'TypeError' ELSE 'RuntimeError' END AS error_type,
  CASE kind WHEN 0 THEN '/srv/app/m' || m || '.py at line ' || ln || ' in function ''handler_' || u || '''' WHEN 1 THEN 'app/m' || m || '.py at line ' || ln || ' in function ''fetch_' || u || ''''
    WHEN 2 THEN 'db/pool' || m || '.py at line 102' ELSE 'unknown' END AS location,
  CASE kind WHEN 0 THEN 'read the key with a default or test for it first' WHEN 1 THEN 'test for None before the operation' END AS suggested_fix,
  CASE WHEN p.path IS NOT NULL AND kind IN (0, 1, 3) THEN 'high' ELSE 'medium' END AS confidence FROM tr LEFT JOIN mods p ON p.doc_id = tr.mn""")
def trace_diagnosis(spark, sf):
    parsed = t.parse_traces(traces(spark, sf))
    found = t.diagnose(parsed, t.pack_evidence(parsed, declared(spark, sf)))
    return found.select(
        "trace_id", "error_type", "location", "suggested_fix",
        t.calibrate_confidence(F.col("confidence"), F.col("confidence") == "high").alias("confidence"),
    )


@query("related_files", "JN13 PRJ15", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a.py' WHEN 1 THEN 'b.py,c.py' ELSE 'x' || user_id || '.py' END AS related,
  CASE event_id % 3 WHEN 2 THEN 'medium' ELSE 'high' END AS confidence FROM events""")
def related_files(spark, sf):
    e = F.col("event_id")
    own = F.concat(F.lit("x"), F.col("user_id").cast("string"), F.lit(".py"))
    suggested = F.when(e % 3 == 0, F.array(F.lit("z.py"), F.lit("a.py"))).when(e % 3 == 1, F.array(F.lit("z.py"))).otherwise(
        F.array(own, F.lit("/etc/passwd"), F.lit("../up.py"))
    )
    located = F.when(e % 3 == 0, F.array(F.lit("a.py"), F.lit("b.py"))).when(e % 3 == 1, F.array(F.lit("c.py"), F.lit("b.py"))).otherwise(
        F.array().cast("array<string>")
    )
    return b.table(spark, sf, "events").select(
        "event_id", F.array_join(t.filter_related(suggested, located), ",").alias("related"),
        t.calibrate_confidence(F.lit("HIGH "), F.size(located) > 0).alias("confidence"),
    )


@query("sanitized_logs", "STR6", """
SELECT event_id, 'app/s.py:10 tests/t.py [REDACTED_API_KEY] [REDACTED_GITHUB_TOKEN]  end ' || user_id || ' ' || coalesce(props, '') AS clean FROM events""")
def sanitized_logs(spark, sf):
    raw = F.concat(
        F.lit("/workspace/app/s.py:10 /tmp/run_a"), F.col("user_id").cast("string"), F.lit("/tests/t.py sk-abcdefghij0123456789"),
        F.col("event_id").cast("string"), F.lit(" ghp_abcdefghij0123456789 /var/folders/x1/y end "), F.col("user_id").cast("string"),
        F.lit(" "), F.coalesce("props", F.lit("")),
    )
    return b.table(spark, sf, "events").select("event_id", secrets.sanitize_log(raw).alias("clean"))


@query("cleaned_paths", "PRJ10 PRJ11", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'app/u' || user_id || '.py' WHEN 1 THEN NULL ELSE 'lib/u' || user_id || '.py' END AS cleaned,
  CASE event_id % 3 WHEN 0 THEN 'app/u' || user_id || '.py' WHEN 1 THEN 'src/../u' || user_id || '.py' ELSE 'lib/u' || user_id || '.py' END AS coverage_path FROM events""")
def cleaned_paths(spark, sf):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    raw = (
        F.when(e % 3 == 0, F.concat(F.lit(" 'app\\u"), u, F.lit(".py' "))).when(e % 3 == 1, F.concat(F.lit("/x/src/../u"), u, F.lit(".py")))
        .otherwise(F.concat(F.lit("lib/u"), u, F.lit(".py")))
    )
    reported = F.when(e % 3 == 0, F.concat(F.lit("/workspace/app/u"), u, F.lit(".py"))).otherwise(raw)
    return b.table(spark, sf, "events").select(
        "event_id", paths.clean_path(raw).alias("cleaned"), paths.coverage_path(reported).alias("coverage_path")
    )


def runs(spark, sf):
    """Every event is a test run of one of five kinds, whose output begins with the event's properties."""
    e, k = F.col("event_id"), F.col("event_id").cast("string")
    stdout = (
        F.when(e % 5 == 0, F.concat(
            F.lit("tests/test_a.py::test_"), k, F.lit(" PASSED [ 50%]\ntests/test_a.py::test_b FAILED [100%]\n==== 1 failed, 1 passed in 0.1s ====")))
        .when(e % 5 == 1, F.concat(
            F.lit("ERROR collecting tests/test_"), k, F.lit(".py\nModuleNotFoundError: No module named 'pkg"), k, F.lit("'\n=== 1 error in 0.05s ===")))
        .when(e % 5 == 2, F.lit("tests/t.py::A::test_x PASSED\ntests/t.py::test_y SKIPPED"))
        .otherwise(F.lit(""))
    )
    code = F.element_at(F.array(*[F.lit(c) for c in (1, 2, 0, 5, 3)]), (e % 5 + 1).cast("int"))
    return b.table(spark, sf, "events").select(
        e.alias("run_id"), F.concat(F.lit("captured "), F.coalesce("props", F.lit("")), F.lit("\n"), stdout).alias("stdout"), F.lit("").alias("stderr"), code.alias("exit_code"),
        (e % 10 == 4).alias("timed_out"), F.when(e % 10 == 3, F.lit("no container")).alias("error"),
    )


@query("test_runs", "EXT14 EXT15 AGG15", """
SELECT event_id AS run_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS passed, CASE event_id % 5 WHEN 0 THEN 1 ELSE 0 END AS failed,
  CASE event_id % 5 WHEN 2 THEN 1 ELSE 0 END AS skipped, CASE event_id % 5 WHEN 1 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS errors,
  CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS total,
  CASE event_id % 5 WHEN 1 THEN 'ERROR collecting tests/test_' || event_id || '.py|ModuleNotFoundError: No module named ''pkg' || event_id || '''|Missing dependency ''pkg' || event_id || ''': packages outside the base runner are not installed.'
    WHEN 3 THEN 'Pytest collected 0 tests in the specified test file.' ELSE '' END AS warnings,
  CASE WHEN event_id % 10 = 4 THEN 'timed_out' WHEN event_id % 10 = 3 THEN 'failed_to_start' WHEN event_id % 5 IN (0, 2) THEN 'completed' ELSE 'failed' END AS status FROM events""")
def test_runs(spark, sf):
    return tr.parse_runs(runs(spark, sf)).select(
        "run_id", "passed", "failed", "skipped", "errors", "total", F.array_join("warnings", "|").alias("warnings"), "status"
    )


@query("test_cases", "EXT13", """
SELECT event_id AS run_id, CASE event_id % 5 WHEN 0 THEN 'test_' || event_id ELSE 'test_x' END AS name, 'passed' AS status FROM events WHERE event_id % 5 IN (0, 2)
UNION ALL SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'test_b' ELSE 'test_y' END, CASE event_id % 5 WHEN 0 THEN 'failed' ELSE 'skipped' END FROM events WHERE event_id % 5 IN (0, 2)""")
def test_cases(spark, sf):
    return tr.cases(tr.parse_runs(runs(spark, sf)))


def _log_folder(spark, sf):
    """All runs' output in one log file, each behind a line with its id and exit code, written once; gives the folder."""
    folder = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    head = F.concat(F.lit("##[run "), F.col("run_id").cast("string"), F.lit(" exit "), F.col("exit_code").cast("string"), F.lit("]"))
    text = F.concat(head, F.lit("\n"), "stdout").alias("value")
    runs(spark, sf).orderBy("run_id").select(text).coalesce(1).write.text(folder)
    return folder


@query("log_runs", "SRC8 EXT13 EXT14 EXT15", """
SELECT event_id AS run_id, CAST(event_id % 5 AS INTEGER) AS kind, CASE event_id % 5 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS passed, CASE event_id % 5 WHEN 0 THEN 1 ELSE 0 END AS failed,
  CASE event_id % 5 WHEN 0 THEN 'test_' || event_id || ',test_b' WHEN 2 THEN 'test_x,test_y' ELSE '' END AS names,
  CASE event_id % 5 WHEN 0 THEN 'completed' WHEN 2 THEN 'completed' ELSE 'failed' END AS status FROM events""")
def log_runs(spark, sf):
    """Every run of one log file, read in byte ranges and put together whole."""
    folder, mark = _log_folder(spark, sf), r"^##\[run (\d+) exit (\d+)\]$"
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    # written while the ranges are small, so that the file comes in many
    records = stored(logs.log_records(logs.read_log_lines(spark, folder), F.col("line").rlike(mark)).filter("record > 0"), "log-records")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    first, rest = F.substring_index("text", "\n", 1), F.regexp_replace("text", r"^[^\n]*\n?", "")
    given = records.select(
        F.regexp_extract(first, mark, 1).cast("long").alias("run_id"), rest.alias("stdout"), F.lit("").alias("stderr"),
        F.regexp_extract(first, mark, 2).cast("int").alias("exit_code"), F.lit(False).alias("timed_out"), F.lit(None).cast("string").alias("error"),
    )
    parsed = tr.parse_runs(given)
    return parsed.select(
        "run_id", (F.col("run_id") % 5).cast("int").alias("kind"), "passed", "failed", F.array_join(F.transform("cases", lambda c: c["name"]), ",").alias("names"), "status")


@query("outcome_totals", "AGG15", """
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS passed, count(*) FILTER (WHERE event_type = 'error') AS failed,
  count(*) FILTER (WHERE event_type = 'view') AS skipped, CAST(0 AS BIGINT) AS errors FROM events GROUP BY user_id""")
def outcome_totals(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "click", F.lit("passed")).when(kind == "error", F.lit("failed")).when(kind == "view", F.lit("skipped"))
    return tr.outcome_totals(b.table(spark, sf, "events").withColumn("status", status), "user_id")


def coverage_reports(spark, sf):
    """Every document is a coverage report: with totals, with files only, empty, malformed, or without statements."""
    d, k = F.col("doc_id"), F.col("doc_id").cast("string")
    n = (F.col("n_chars") + 1).cast("string")
    doc = (
        F.when(d % 5 == 0, F.concat(
            F.lit('{"files": {"/workspace/app/c'), k, F.lit('.py": {"summary": {"num_statements": '), n,
            F.lit(', "covered_lines": 1, "missing_lines": 2, "percent_covered": 33.333333}, "missing_lines": [5, "6", "x"]}, "tests/test_a.py": {"summary": {"num_statements": 4}}}, "totals": {"num_statements": '),
            n, F.lit(', "covered_lines": 1, "missing_lines": 2}}')))
        .when(d % 5 == 1, F.concat(
            F.lit('{"files": {"/home/u/src/b.py": {"summary": {"num_statements": '), n, F.lit(', "covered_lines": 1}}, "a/site-packages/z.py": {"summary": {"num_statements": 9}}}}')))
        .when(d % 5 == 2, F.lit(" "))
        .when(d % 5 == 3, F.lit('{"files": '))
        .otherwise(F.lit('{"totals": {"num_statements": 0}}'))
    )
    return b.table(spark, sf, "documents").select(d.alias("run_id"), doc.alias("json"), F.concat(F.lit("/app/c"), k, F.lit(".py")).alias("target_file"))


@query("coverage_totals", "SRC7 AGG14", """
WITH c AS (SELECT doc_id, doc_id % 5 AS k, n_chars + 1 AS n FROM documents)
SELECT doc_id AS run_id, k IN (0, 1, 4) AS is_available, CASE k WHEN 2 THEN 'Coverage report file was empty.' WHEN 3 THEN 'Failed to parse coverage data' END AS reason,
  CASE WHEN k < 2 THEN n ELSE 0 END AS total_statements, CAST(CASE WHEN k < 2 THEN 1 ELSE 0 END AS BIGINT) AS covered_statements, CAST(CASE k WHEN 0 THEN 2 ELSE 0 END AS BIGINT) AS missing_statements,
  CASE WHEN k < 2 THEN round_even(1 / n * 100.0::DOUBLE, 2) ELSE 0.0::DOUBLE END AS coverage_percent FROM c""")
def coverage_totals(spark, sf):
    return tr.parse_coverage(coverage_reports(spark, sf)).select(
        "run_id", "is_available", "reason", "total_statements", "covered_statements", "missing_statements", "coverage_percent"
    )


@query("coverage_from_files", "SRC7 SRC8 AGG14", """
SELECT doc_id % 5 AS kind, count(*) AS n, CAST(sum(CASE WHEN doc_id % 5 < 2 THEN n_chars + 1 ELSE 0 END) AS BIGINT) AS statements, bool_and(doc_id % 5 IN (0, 1, 4)) AS available FROM documents GROUP BY 1""")
def coverage_from_files(spark, sf):
    """Coverage reports written one to a file, in many folders, and read back as files."""
    folder = f"{shared_folder(spark)}/coverage-{uuid.uuid4().hex}"

    def write(batches):
        store, root = tree.filesystem(folder)
        store.create_dir(root, recursive=True)
        made = set()
        for batch in batches:
            for run_id, doc in zip(batch.column("run_id").to_pylist(), batch.column("json").to_pylist()):
                place = f"{root}/{zlib.crc32(str(run_id).encode()) % 1024:03x}"
                if place not in made:
                    store.create_dir(place, recursive=True)
                    made.add(place)
                with store.open_output_stream(f"{place}/{run_id}.json") as f:
                    f.write(doc.encode())
            yield batch.select(["run_id"])

    coverage_reports(spark, sf).select("run_id", "json").mapInArrow(write, "run_id bigint").write.format("noop").mode("overwrite").save()
    parsed = tr.parse_coverage(logs.read_coverage(spark, folder))
    kind = (F.regexp_extract("run_id", r"(\d+)\.json$", 1).cast("long") % 5).alias("kind")
    return parsed.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_statements").alias("statements"), F.bool_and("is_available").alias("available"))


@query("coverage_files", "JSON1 SET6 SRT4 PRJ11", """
SELECT doc_id AS run_id, CAST(1 AS INTEGER) AS position, CASE doc_id % 5 WHEN 0 THEN 'app/c' || doc_id || '.py' ELSE 'src/b.py' END AS file_path, n_chars + 1 AS total_statements,
  CASE doc_id % 5 WHEN 0 THEN 33.33::DOUBLE ELSE 0.0::DOUBLE END AS coverage_percent, CASE doc_id % 5 WHEN 0 THEN '5,6' ELSE '' END AS missing FROM documents WHERE doc_id % 5 < 2""")
def coverage_files(spark, sf):
    return tr.coverage_files(tr.parse_coverage(coverage_reports(spark, sf))).select(
        "run_id", "position", "file_path", "total_statements", "coverage_percent", F.array_join("missing_lines", ",").alias("missing")
    )


@query("helper_packing", "SRCH10", """
WITH d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents),
f AS (SELECT doc_id, list_reduce(list_transform(list_concat(['#'], ls), lambda x: struct_pack(n := 0, u := 100, l := length(x), h := x = '#')),
  lambda a, x: CASE WHEN x.l < 300 AND a.u + x.l < 900 THEN struct_pack(n := a.n + 1, u := a.u + x.l, l := 0, h := FALSE) ELSE a END) AS s FROM d)
SELECT doc_id, s.n AS n_kept, s.u AS used_chars FROM f""")
def helper_packing(spark, sf):
    snippets = F.filter(F.split("text", "\n"), lambda x: x != "")
    helpers = b.table(spark, sf, "documents").select("doc_id", F.lit(100).alias("base_chars"), snippets.alias("snippets"))
    packed = retrieval.pack_helpers(helpers, 300, 900)
    return packed.select("doc_id", F.size("helper_snippets").alias("n_kept"), "used_chars")
