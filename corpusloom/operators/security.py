"""Security rules on code lines, deduplication, ordering and summaries.

Rules are literal patterns in one expression, evaluated only on lines that hold a rule keyword, each read up to the line that
closes its brackets; each builds the array of rules it breaks and only broken ones become rows. Calls and their keyword
arguments are looked up with strings and comments masked, and arguments of a call within belong to that call.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import scanner, secrets
from corpusloom.functions.rows import explode_rows
from corpusloom.functions.text import strip
from corpusloom.functions.vectors import bind
from corpusloom.operators import extract, quality

# Severity and confidence in display order, categories.
SEVERITIES = ("critical", "high", "medium", "low", "informational")
CONFIDENCES = ("high", "medium", "low")
CATEGORIES = (
    "credentials", "code_execution", "command_injection", "sql_injection", "deserialization", "cryptography",
    "insecure_communication", "error_handling",
)
SENSITIVE_NAME = r"(?i)(auth|login|verify|validate|token|crypto|encrypt|decrypt|permission|credential)"
SQL_TEXT = r"\b(?:SELECT\s.*\sFROM|INSERT\s+INTO\s.+|UPDATE\s.*\sSET|DELETE\s+FROM\s.+|DROP\s+TABLE|ALTER\s+TABLE)"

FINDING = (
    "rule_id", "title", "severity", "confidence", "repo", "path", "start_line", "end_line", "entity_name", "evidence_summary",
    "remediation", "cwe_id", "category",
)

# name = "literal" on its own line (Python), and the same anywhere in a line (plain text).
ASSIGNMENT = (
    r"^\s*(?:[A-Za-z_]\w*\.)*([A-Za-z_]\w*)\s*(?::[^=\"']+)?=\s*[rRuU]?(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)')\s*(?:#.*|;.*)?$"
)
ASSIGNMENT_ANYWHERE = (
    r"(?:^|[^\w.])(?:[A-Za-z_]\w*\.)*([A-Za-z_]\w*)\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)')"
)
JS_ASSIGNMENT = (
    r"(?i)(?:const|let|var|readonly)\s+([a-z0-9_]*password[a-z0-9_]*|[a-z0-9_]*api_?key[a-z0-9_]*|[a-z0-9_]*secret[a-z0-9_]*"
    r"|[a-z0-9_]*token[a-z0-9_]*)\s*[:=]\s*['\"`]([^'\"`]+)['\"`]"
)

_LITERAL_ARG = r"\(\s*(?:[bBrRuU]{0,2}(?:\"[^\"]*\"|'[^']*')|\d[\w.]*|True|False|None)\s*[,)]"
_EVAL, _EXEC = r"\beval\s*\(", r"\bexec\s*\("
_SUBPROCESS = r"(?:\bsubprocess\.|(?<![\w.]))(?:run|Popen|call|check_call|check_output)\s*\("
_SHELL = r"\bshell\s*=\s*(?!False\b|None\b|0\b|\"\"|'')"
_SYSTEM = r"\b(system|popen)\s*\("
_SQL_CALL = r"(?is)\b(?:execute|executemany|raw)\s*\(\s*"
_STRING_WITH_SQL = r"(?:\"[^\"]*" + SQL_TEXT + r"[^\"]*\"|'[^']*" + SQL_TEXT + r"[^']*')"
_SQL_DYNAMIC = (
    _SQL_CALL + r"(?:f[rR]?" + _STRING_WITH_SQL + r"|[rRuU]?" + _STRING_WITH_SQL + r"\s*(?:%|\+|\.format\s*\()|[\w.\[\]]+\s*\+\s*"
    + _STRING_WITH_SQL + r")"
)
_PICKLE = r"\b_?pickle\.(loads?)\s*\("
_YAML, _SAFE_LOADER = r"\byaml\.load\s*\(", r"(?i)\bLoader\s*=\s*[\w.]*SafeLoader"
_HASH, _NOT_SECURITY = r"\bhashlib\.(md5|sha1)\s*\(", r"\busedforsecurity\s*=\s*False\b"
_HTTP = r"\b(?:requests|httpx|aiohttp)\.\w+\s*\(|\b(?:get|post|put|delete|request|Client|AsyncClient)\s*\("
#: A group that captures, to be read as one that does not.
_NO_GROUP = re.compile(r"(?<!\\)\((?!\?)")
_UNVERIFIED, _CONTEXT = r"\b(?:verify|ssl)\s*=\s*False\b", r"\b_create_unverified_context\s*\("

# Parentheses up to four deep; possessive, so a long statement cannot backtrack.
_NESTED = r"\((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+\)"
_ARGUMENTS = r"((?:[^()]++|" + _NESTED + r")*+)"

# Any line that can begin a broken Python or script rule matches one of these.
# Every alternative begins with given characters, so that the search skips to these.
def _words(words: str, then: str) -> str:
    """Whole ``words`` of a pattern, followed by ``then``."""
    return "|".join(rf"{w[0]}(?<=\b{w[0]}){w[1:]}{then}" for w in words.split())


PY_KEYWORDS = "|".join((
    _words("eval exec system popen execute executemany raw pickle _pickle yaml hashlib _create_unverified_context", r"\b"),
    r"=\s*[rRuU]?[\"']",
    _words("run Popen call check_call check_output get post put delete request Client AsyncClient", r"\s*\("),
    _words("requests httpx aiohttp", r"\."),
))
JS_KEYWORDS = (
    r"[eE](?<=\b[eE])(?i:val)\s*\(|[rR](?i:ejectUnauthorized)|[cC](?i:reateHash)|[pP](?i:assword)|[aA](?i:pi_?key)|[sS\u017F](?i:ecret)"
    r"|[tT](?i:oken)"
)


def _finding(rule_id, title, severity, confidence, evidence, remediation, cwe, category) -> Column:
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(rule_id).alias("rule_id") if isinstance(rule_id, str) else rule_id.alias("rule_id"),
        text(title).alias("title"), text(severity).alias("severity"), text(confidence).alias("confidence"),
        text(evidence).alias("evidence_summary"), F.lit(remediation).alias("remediation"), F.lit(cwe).alias("cwe_id"),
        F.lit(category).alias("category"),
    )


def credential_finding(name: Column, value: Column) -> Column:
    """Python credential finding of an assignment, or null. The value itself never enters the finding."""
    return bind(F.struct(name.alias("name"), value.alias("value")), lambda a: _credential_finding(a["name"], a["value"]))


def _credential_finding(name: Column, value: Column) -> Column:
    live = secrets.has_live_prefix(value)
    return F.when(
        secrets.is_credential(name, value),
        _finding(
            "PYTHON_HARDCODED_CREDENTIAL", F.concat(F.lit("Hardcoded Credential in '"), name, F.lit("'")),
            F.when(live, F.lit("critical")).otherwise(F.lit("high")), F.when(live, F.lit("high")).otherwise(F.lit("medium")),
            F.concat(
                F.lit("Variable '"), name, F.lit("' assigned a hardcoded literal string ("), F.char_length(value).cast("string"),
                F.lit(" characters)."),
            ),
            "Read the secret from the environment or a secrets manager.", "CWE-798", "credentials",
        ),
    )


def _assigned(x: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract(x, pattern, 1), F.concat(F.regexp_extract(x, pattern, 2), F.regexp_extract(x, pattern, 3))


def own_arguments(masked: Column, call: str) -> Column:
    """The arguments of the first and of the last ``call`` that begins in the first line of a masked statement.

    ``call`` ends with its opening bracket. Arguments of calls within are left out.
    """
    def of(lead: str) -> Column:
        inner = F.regexp_extract(masked, r"(?s)\A" + lead + "(?:" + call + ")" + _ARGUMENTS, 1)
        return F.regexp_replace(inner, _NESTED, "()")

    return F.concat_ws(", ", of(r"[^\n]*?"), of(r"[^\n]*"))


def python_rules(x: Column, masked: Column) -> Column:
    """Array of the findings of one Python statement, read from a line with a keyword, and its ``masked`` form. A pattern runs only
    where the text holds a word it cannot match without."""
    parts = F.struct(x.alias("x"), masked.alias("masked"), F.substring_index(x, "\n", 1).alias("first"), F.substring_index(masked, "\n", 1).alias("calls"))
    return bind(parts, lambda p: F.array_compact(_python_rules(p["x"], p["masked"], p["first"], p["calls"])))


def _python_rules(x: Column, masked: Column, first: Column, calls: Column) -> Column:
    name, value = _assigned(F.regexp_replace(first, r"\s#[^\"'\n]*$", ""), ASSIGNMENT)

    def dynamic(call: str) -> Column:
        return ~x.rlike(call[:-2] + _LITERAL_ARG)

    def graded(call: str) -> Column:
        return F.when(dynamic(call), F.lit("high")).otherwise(F.lit("medium"))

    def code_run(call: str, word: str, rule: str) -> Column:
        return F.when(masked.contains(word) & calls.rlike(call), _finding(
            rule, f"Dynamic Code Execution ({word})", graded(call), "high", f"Call to {word}() executes dynamic code expressions.",
            "Use literal parsing or an explicit table of allowed operations.", "CWE-95", "code_execution"))

    def given(call: str, argument: str) -> Column:
        return calls.rlike(call) & own_arguments(masked, _NO_GROUP.sub("(?:", call)).rlike(argument)

    system = F.regexp_extract(calls, _SYSTEM, 1)
    algorithm, lowered = F.regexp_extract(calls, _HASH, 1), F.lower(calls)
    return F.array(
        F.when(x.contains("=") & first.rlike(ASSIGNMENT), credential_finding(name, value)),
        code_run(_EVAL, "eval", "PYTHON_DANGEROUS_EVAL"),
        code_run(_EXEC, "exec", "PYTHON_DANGEROUS_EXEC"),
        F.when(masked.contains("shell") & given(_SUBPROCESS, _SHELL), _finding(
            "PYTHON_INSECURE_SUBPROCESS", "Subprocess Shell Execution (shell=True)", graded(_SUBPROCESS), graded(_SUBPROCESS),
            F.concat(F.lit("Subprocess execution configured with shell=True ("),
                     F.when(dynamic(_SUBPROCESS), F.lit("dynamic")).otherwise(F.lit("static")), F.lit(" command).")),
            "Pass the command as a list without a shell.", "CWE-78", "command_injection")),
        F.when((masked.contains("system") | masked.contains("popen")) & calls.rlike(_SYSTEM), _finding(
            "PYTHON_INSECURE_SUBPROCESS", F.concat(F.lit("Insecure Shell Invocation (os."), system, F.lit(")")), graded(_SYSTEM), "high",
            F.concat(F.lit("Call to os."), system, F.lit("() executes commands directly in system shell.")),
            "Run the command from an argument list.", "CWE-78", "command_injection")),
        F.when((lowered.contains("execute") | lowered.contains("raw")) & calls.rlike(_SQL_CALL) & x.rlike(_SQL_DYNAMIC), _finding(
            "PYTHON_SQL_INJECTION", "Potential SQL Injection in Query Execution", "high", "medium",
            "Database execute() called with dynamically formatted SQL query string.", "Bind values as query parameters.",
            "CWE-89", "sql_injection")),
        F.when(masked.contains("pickle.") & calls.rlike(_PICKLE), _finding(
            "PYTHON_UNSAFE_DESERIALIZATION", "Unsafe Deserialization (pickle)", "high", "high",
            F.concat(F.lit("Call to pickle."), F.regexp_extract(calls, _PICKLE, 1), F.lit("() deserializes arbitrary Python objects.")),
            "Exchange data in a format without code, such as JSON.", "CWE-502", "deserialization")),
        F.when(masked.contains("yaml.load") & calls.rlike(_YAML) & ~given(_YAML, _SAFE_LOADER), _finding(
            "PYTHON_UNSAFE_DESERIALIZATION", "Unsafe YAML Deserialization (yaml.load)", "high", "high",
            "Call to yaml.load() without SafeLoader.", "Load YAML with the safe loader.", "CWE-502", "deserialization")),
        F.when(masked.contains("hashlib.") & calls.rlike(_HASH) & ~given(_HASH, _NOT_SECURITY), _finding(
            "PYTHON_WEAK_CRYPTO", F.concat(F.lit("Weak Cryptographic Hash ("), F.upper(algorithm), F.lit(")")), "medium", "medium",
            F.concat(F.lit("Call to hashlib."), algorithm, F.lit("() without usedforsecurity=False.")),
            "Hash with SHA-256 or stronger.", "CWE-328", "cryptography")),
        F.when(masked.contains("False") & given(_HTTP, _UNVERIFIED), _finding(
            "PYTHON_INSECURE_TLS", "Disabled TLS Certificate Verification", "high", "high",
            "HTTP request called with verify=False or ssl=False.", "Leave certificate verification on.", "CWE-295",
            "insecure_communication")),
        F.when(masked.contains("_create_unverified_context") & calls.rlike(_CONTEXT), _finding(
            "PYTHON_INSECURE_TLS", "Unverified SSL Context Created", "high", "high",
            "Call to ssl._create_unverified_context() disables certificate checks.", "Create a default, verifying context.",
            "CWE-295", "insecure_communication")),
    )


def script_rules(x: Column) -> Column:
    """Array of the findings of one JS/TS line; pure comment lines give none."""
    return bind(strip(x), _script_rules)


def _script_rules(t: Column) -> Column:
    comment = t.startswith("//") | t.startswith("/*") | t.startswith("*")
    name, value = F.regexp_extract(t, JS_ASSIGNMENT, 1), strip(F.regexp_extract(t, JS_ASSIGNMENT, 2))
    rules = F.array(
        F.when(t.contains("eval") & t.rlike(_EVAL), _finding(
            "JS_DANGEROUS_EVAL", "Dynamic Code Evaluation (eval)", "high", "high",
            "Call to eval() dynamically evaluates JavaScript code string.", "Parse data instead of evaluating it.", "CWE-95",
            "code_execution")),
        F.when(t.rlike(JS_ASSIGNMENT) & secrets.is_credential(name, value), _finding(
            "JS_HARDCODED_CREDENTIAL", F.concat(F.lit("Hardcoded Credential in '"), name, F.lit("'")), "high", "medium",
            F.concat(F.lit("Variable '"), name, F.lit("' assigned a hardcoded literal string ("),
                     F.char_length(value).cast("string"), F.lit(" chars).")),
            "Read the secret from the environment or a secrets manager.", "CWE-798", "credentials")),
        F.when(t.contains("rejectUnauthorized") & t.rlike(r"rejectUnauthorized\s*:\s*false"), _finding(
            "JS_INSECURE_TLS", "Disabled TLS Certificate Verification", "high", "high",
            "TLS certificate validation disabled with rejectUnauthorized: false.", "Leave certificate verification on.", "CWE-295",
            "insecure_communication")),
        F.when(F.lower(t).contains("createhash") & t.rlike(r"(?i)createHash\s*\(\s*['\"](md5|sha1)['\"]\s*\)"), _finding(
            "JS_WEAK_CRYPTO", "Weak Hash Algorithm (MD5/SHA-1)", "medium", "medium",
            "crypto.createHash() called with weak algorithm (MD5 or SHA-1).", "Hash with SHA-256 or stronger.", "CWE-328",
            "cryptography")),
    )
    return F.when(~comment, F.array_compact(rules))


def _with_id(df: DataFrame) -> DataFrame:
    return df.select(quality.finding_id("title").alias("finding_id"), *FINDING)


def _statement_rules() -> Column:
    """The findings of a row with ``language`` and a statement ``r``."""
    x = F.col("r.x")
    return F.when(F.col("language") == "Python", python_rules(x, F.col("r.masked"))).otherwise(script_rules(F.substring_index(x, "\n", 1)))


def with_statements(files: DataFrame) -> DataFrame:
    """Add the ``statements`` and ``handlers`` arrays (needs ``lines``, ``language``), both from one scan of a file: what
    :func:`code_findings` and ``quality.broad_handlers`` read."""
    read = scanner.statements_with_handlers(F.col("lines"), F.col("language"), PY_KEYWORDS, JS_KEYWORDS)
    found = files.withColumn("_read", read)
    return found.withColumn("statements", F.col("_read.statements")).withColumn("handlers", F.col("_read.handlers")).drop("_read")


def code_findings(files: DataFrame) -> DataFrame:
    """Rule findings of Python and JS/TS files from ``extract.with_declarations``, with their enclosing entity. Files from
    :func:`with_statements` are not scanned again."""
    if "statements" in files.columns:
        read = F.col("statements")
    else:
        read = scanner.statements(F.col("lines"), F.col("language"), PY_KEYWORDS, JS_KEYWORDS)
    rows = explode_rows(files, read, "r", "repo", "path", "language")
    broken = _statement_rules()
    found = explode_rows(rows, broken, "f", "repo", "path", F.col("r.n").alias("start_line"), F.col("r.entity").alias("entity_name"))
    return _with_id(found.select(
        "f.rule_id", "f.title", "f.severity", "f.confidence", "repo", "path", "start_line", F.col("start_line").alias("end_line"),
        "entity_name", "f.evidence_summary", "f.remediation", "f.cwe_id", "f.category",
    ))


def _silenced(has_pass: Column, name: Column) -> Column:
    """The finding of a broad handler with ``pass`` inside a function whose name looks security-sensitive, or null."""
    quoted = F.concat(F.lit("'"), name, F.lit("'"))
    return F.when(has_pass & name.rlike(SENSITIVE_NAME), _finding(
        "PYTHON_BROAD_EXCEPTION_SECURITY", F.concat(F.lit("Broad Exception Silenced in "), quoted), "low", "low",
        F.concat(F.lit("Broad exception handler with pass inside sensitive function "), quoted, F.lit(".")),
        "Handle the expected failures and fail closed.", "CWE-391", "error_handling"))


def silenced_handler_findings(handlers: DataFrame) -> DataFrame:
    """Broad handlers with ``pass`` inside functions whose name looks security-sensitive."""
    found = explode_rows(
        handlers, F.array(_silenced(F.col("has_pass"), F.col("entity_name"))), "f", "repo", "path", "start_line", "end_line", "entity_name")
    return _with_id(found.select("f.*", "repo", "path", "start_line", "end_line", "entity_name"))


def text_credential_findings(files: DataFrame) -> DataFrame:
    """Credential assignments anywhere in the lines of plain text (needs ``lines``); every one of a line is a finding."""
    lines = F.filter(
        F.transform("lines", lambda x, i: F.when(x.contains("=") & x.rlike(ASSIGNMENT_ANYWHERE), F.struct((i + 1).cast("int").alias("n"), x.alias("x")))),
        lambda r: r.isNotNull(),
    )
    whole = "(" + ASSIGNMENT_ANYWHERE + ")"
    rows = explode_rows(
        explode_rows(files, lines, "r", "repo", "path"), F.regexp_extract_all("r.x", F.lit(whole), F.lit(1)), "a",
        "repo", "path", F.col("r.n").alias("start_line"),
    )
    name, value = _assigned(F.col("a"), ASSIGNMENT_ANYWHERE)
    found = explode_rows(rows, F.array(credential_finding(name, value)), "f", "*")
    return _with_id(found.select(
        "f.rule_id", "f.title", "f.severity", "f.confidence", "repo", "path", "start_line", F.col("start_line").alias("end_line"),
        F.lit(None).cast("string").alias("entity_name"), "f.evidence_summary", "f.remediation", "f.cwe_id", "f.category",
    ))


def all_findings(files: DataFrame) -> DataFrame:
    """Every code finding, one per rule, file and line: statements and handlers leave the file's row in one scan."""
    read = scanner.statements_and_handlers(F.col("lines"), F.col("language"), PY_KEYWORDS, JS_KEYWORDS)
    rows = explode_rows(files, read, "item", "repo", "path", "language").select("repo", "path", "language", "item.r", "item.h")
    statement = F.col("r").isNotNull()
    broken = F.when(statement, _statement_rules()).otherwise(F.array(_silenced(F.col("h.has_pass"), F.col("h.entity"))))
    found = explode_rows(
        rows, broken, "f", "repo", "path", F.when(statement, F.col("r.n")).otherwise(F.col("h.n")).alias("start_line"),
        F.when(statement, F.col("r.n")).otherwise(F.col("h.end")).alias("end_line"),
        F.when(statement, F.col("r.entity")).otherwise(F.col("h.entity")).alias("entity_name"),
    )
    return quality.dedupe(_with_id(found.select("f.*", "repo", "path", "start_line", "end_line", "entity_name")))


def ordered(findings: DataFrame) -> DataFrame:
    """Severity, confidence, path, line."""
    return findings.orderBy(
        quality.severity_rank(F.col("severity"), SEVERITIES), quality.severity_rank(F.col("confidence"), CONFIDENCES),
        "repo", "path", "start_line", "rule_id",
    )


def is_actionable(severity: Column) -> Column:
    return severity.isin("critical", "high")


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("total")
    )


def category_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "category").agg(F.count(F.lit(1)).alias("n"))


def summary_text(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """One paragraph per repository: counts by severity and the three largest categories."""
    # one pass over the findings: counts by severity of each category, then their sums
    by_category = findings.groupBy("repo", "category").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("n"))
    summed = by_category.groupBy("repo").agg(
        *[F.sum(s).alias(s) for s in SEVERITIES], F.sum("n").alias("total"),
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "category", "n"))), 1, 3).alias("top"),
    )
    joined = repos.select("repo").distinct().join(summed, "repo", "left")
    counts = F.concat_ws(", ", *[F.concat(F.col(s).cast("string"), F.lit(f" {s}")) for s in SEVERITIES])
    tone = F.when(F.col("critical") + F.col("high") > 0, F.lit("high attention")).otherwise(F.lit("moderate maintainability review"))
    areas = F.array_join(F.transform("top", lambda t: F.concat(t["category"], F.lit(" ("), t["n"].cast("string"), F.lit(")"))), ", ")
    return joined.select(
        "repo",
        F.when(F.coalesce("total", F.lit(0)) == 0, F.concat(F.lit("Static security analysis of '"), "repo", F.lit("' has 0 findings.")))
        .otherwise(F.concat(
            F.lit("Static security scan for '"), "repo", F.lit("' identified "), F.col("total").cast("string"), F.lit(" finding(s) ("),
            counts, F.lit("), requiring "), tone, F.lit(". Primary areas: "), areas, F.lit("."),
        )).alias("summary"),
    )
