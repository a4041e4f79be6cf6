"""Quality metrics, rules, health scores and breakdowns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import paths, scanner, text
from corpusloom.functions.rows import explode_rows
from corpusloom.functions.text import strip
from corpusloom.functions.vectors import bind
from corpusloom.operators import extract, lines as line_ops

# Enumerations in display order.
CATEGORIES = ("complexity", "size", "maintainability", "documentation", "error_handling", "style", "duplication")
SEVERITIES = ("critical", "error", "warning", "info")


@dataclass(frozen=True)
class Thresholds:
    """Rule limits; a value equal to the limit counts."""

    function_lines: tuple[int, int] = (50, 100)
    file_lines: tuple[int, int] = (400, 800)
    nesting: tuple[int, int] = (3, 4)
    complexity: tuple[int, int] = (10, 15)
    parameters: int = 5


DEFAULTS = Thresholds()

FINDING = (
    "rule_id", "category", "severity", "repo", "path", "start_line", "end_line", "entity_name", "entity_type", "message",
    "suggestion", "metric_value", "threshold",
)


def finding_id(*extra: str) -> Column:
    return F.left(F.sha2(F.concat_ws("|", "rule_id", "repo", "path", F.col("start_line").cast("string"), *extra), 256), F.lit(16))


def severity_rank(c: Column, order: tuple[str, ...] = SEVERITIES) -> Column:
    rank = F.when(c == order[0], F.lit(0))
    for i, s in enumerate(order[1:], 1):
        rank = rank.when(c == s, F.lit(i))
    return rank.otherwise(F.lit(99))


def _finish(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(finding_id("entity_name").alias("finding_id"), *FINDING, *keep)


def _found(rule_id, category, severity, start, end, message, suggestion, name=None, kind=None, value=None, limit=None) -> Column:
    """A finding but for its file. Plain strings are literals."""
    text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(
        text(rule_id).alias("rule_id"), text(category).alias("category"), text(severity).alias("severity"), start.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"), text(name).alias("entity_name"), text(kind).alias("entity_type"), text(message).alias("message"),
        text(suggestion).alias("suggestion"), number(value).alias("metric_value"), number(limit).alias("threshold"),
    )


def _exploded(rows: DataFrame, findings: Column, *keep: str) -> DataFrame:
    """The findings table of rows with ``repo`` and ``path`` and an array of :func:`_found`, and the ``keep`` columns."""
    found = explode_rows(rows, findings, "f", "repo", "path", *keep)
    return _finish(found.select("repo", "path", *keep, *[F.col(f"f.{c}").alias(c) for c in FINDING if c not in ("repo", "path")]), *keep)


def _two_level(value: Column, limits: tuple[int, int]) -> tuple[Column, Column]:
    """Severity and the limit reached (both null below the first limit)."""
    warn, error = limits
    severity = F.when(value >= error, F.lit("error")).when(value >= warn, F.lit("warning"))
    return severity, F.when(value >= error, F.lit(float(error))).when(value >= warn, F.lit(float(warn)))


def _size_finding(total: Column, t: Thresholds) -> Column:
    severity, limit = _two_level(total, t.file_lines)
    word = F.when(total >= t.file_lines[1], F.lit("error")).otherwise(F.lit("warning"))
    message = F.concat(
        F.lit("File has "), total.cast("string"), F.lit(" lines (exceeds "), word, F.lit(" threshold of "),
        limit.cast("int").cast("string"), F.lit(" lines)."),
    )
    return F.when(severity.isNotNull(), _found(
        "FILE_TOO_LARGE", "size", severity, F.lit(1), total, message, "Split the file along its responsibilities.", value=total, limit=limit))


def file_size_findings(counts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """FILE_TOO_LARGE from the per-file line counts."""
    return _exploded(counts, F.array(_size_finding(F.col("total_lines"), t)))


def bare_code(code: Column) -> Column:
    """Python text without string contents and comments. A pattern runs only where the text holds its first characters."""
    def without(c: Column, begins: tuple[str, ...], pattern: str, to: str) -> Column:
        held = [F.contains(c, F.lit(x)) for x in begins]
        return F.when(held[0] if len(held) == 1 else held[0] | held[1], F.regexp_replace(c, pattern, to)).otherwise(c)

    triple = lambda c: without(c, ('"""', "'''"), r"(?s)\"\"\".*?\"\"\"|'''.*?'''", "''")
    quoted = lambda c: without(c, ('"', "'"), r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", "''")
    return bind(bind(bind(code, triple), quoted), lambda c: without(c, ("#",), r"#[^\n]*", ""))


def python_complexity(code: Column) -> Column:
    """1 + branches, handlers, context managers, assertions, comprehension filters, boolean operators, case guards."""
    bare = bare_code(code)
    patterns = (
        r"(?m)^\s*(?:if|elif|while|assert)\b|^\s*(?:except|(?:async\s+)?with)\b",
        r"(?m)^\s*(?:async\s+)?for\b[^\n]*:",
        r"\S[ ]for\s[^\n:]*?\sin\s[^\n]*?\sif\s",
        r"\b(?:and|or)\b",
        r"(?m)^\s*case\b[^\n]*\sif\s",
    )
    return bind(
        bare,
        lambda b: F.lit(1) + sum((F.regexp_count(b, F.lit(p)) for p in patterns[1:]), F.regexp_count(b, F.lit(patterns[0]))),
    )


_OPENER = r"^(?:async\s+)?(?:if|elif|for|while|try|with)\b.*:"
_CONTINUES = r"^(?:elif|else|except|finally)\b"


def python_nesting(body: Column) -> Column:
    """Deepest control-block nesting by indentation; an ``elif`` nests below the branch it continues."""
    rows = F.filter(
        F.transform(
            F.split(bare_code(body), "\n"),
            lambda x: F.struct(F.length(F.regexp_extract(x, r"^([ \t]*)", 1)).alias("ind"), strip(x).alias("x")),
        ),
        lambda r: r["x"] != "",
    )
    state = F.aggregate(
        rows,
        F.struct(F.array().cast("array<int>").alias("stack"), F.lit(0).alias("top")),
        lambda s, r: bind(
            F.filter(s["stack"], lambda d: (d < r["ind"]) | ((d == r["ind"]) & r["x"].rlike(_CONTINUES))),
            lambda kept: bind(
                F.when(r["x"].rlike(_OPENER), F.concat(kept, F.array(r["ind"].cast("int")))).otherwise(kept),
                lambda stack: F.struct(stack.alias("stack"), F.greatest(s["top"], F.size(stack)).alias("top")),
            ),
        ),
    )
    return state["top"]


def entity_metrics(files: DataFrame) -> DataFrame:
    """Length, complexity, nesting, parameters and documentation of every function (nested ones too) and class.

    Functions of Python files are all typed ``function``; in JS and TS the entity type is kept, and neither docstring nor
    parameters are known.
    """
    rows = extract.declaration_rows(files).withColumn("entity_type", _entity_type())
    return rows.filter(F.col("entity_type").isNotNull()).select(
        "repo", "path", "language", F.col("name").alias("entity_name"), "entity_type", "start_line", "end_line", *_metrics(),
        F.substring_index("header", "\n", 1).alias("first_line"),
    )


def _entity_type() -> Column:
    python, kind = F.col("language") == "Python", F.col("kind")
    return F.when(kind == "class", F.lit("class")).when(kind.isNotNull() & (python | kind.isin("function", "arrow")), F.lit("function")).when(
        kind == "method", F.lit("method")
    )


def _metrics() -> list[Column]:
    """The measured columns of a row of ``extract.declaration_columns`` with ``language``."""
    python, cls = F.col("language") == "Python", F.col("kind") == "class"
    code = F.concat_ws("\n", "header", "body")
    name = F.col("name")
    public = F.when(cls | ~python, paths.is_public_class(name)).otherwise(paths.is_public_function(name))
    return [
        F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1).alias("lines_count"),
        F.when(~cls & python, python_complexity(code)).when(~cls, text.branch_complexity(code)).alias("cyclomatic_complexity"),
        F.when(~cls & python, python_nesting(F.col("body"))).when(~cls, text.brace_depth(code)).alias("max_nesting_depth"),
        F.when(~cls & python, F.size(extract.python_parameters(F.col("params")))).when(~cls, F.lit(0)).alias("parameter_count"),
        (python & extract.docstring(F.col("body")).isNotNull()).alias("has_docstring"), public.alias("is_public"),
    ]


def _entity_rules(t: Thresholds) -> Column:
    """The findings of a row of :func:`entity_metrics`."""
    function = F.col("entity_type") != "class"
    quoted = F.concat(F.lit("'"), F.col("entity_name"), F.lit("'"))
    title = F.initcap("entity_type")

    def rule(rule_id, category, severity, value, limit, message, suggestion) -> Column:
        return F.when(severity.isNotNull(), _found(
            rule_id, category, severity, F.col("start_line"), F.col("end_line"), message, suggestion, F.col("entity_name"), F.col("entity_type"), value, limit))

    def graded(rule_id, category, column, limits, verb, unit, suggestion) -> Column:
        value = F.col(column)
        severity, limit = _two_level(F.when(function, value), limits)
        message = F.concat(
            title, F.lit(" "), quoted, F.lit(f" {verb} "), value.cast("string"), F.lit(f"{unit} (threshold: "),
            limit.cast("int").cast("string"), F.lit(f"{unit})."),
        )
        return rule(rule_id, category, severity, value, limit, message, suggestion)

    params = F.col("parameter_count")
    # The docstring rule lets dunder names count as public for every function; classes never do.
    rule_public = F.when(function, paths.is_public_function(F.col("entity_name"))).otherwise(paths.is_public_class(F.col("entity_name")))
    too_many = F.when(function & (params >= t.parameters), F.lit("warning"))
    undocumented = F.when(~F.col("has_docstring") & rule_public, F.lit("info"))
    return F.array(
        graded("FUNCTION_TOO_LONG", "size", "lines_count", t.function_lines, "spans", " lines",
               "Extract parts of the function into helpers."),
        graded("HIGH_CYCLOMATIC_COMPLEXITY", "complexity", "cyclomatic_complexity", t.complexity,
               "has cyclomatic complexity of", "", "Reduce the number of branches."),
        graded("EXCESSIVE_NESTING", "complexity", "max_nesting_depth", t.nesting, "has nesting depth of", "",
               "Return early to flatten the nested blocks."),
        rule("TOO_MANY_PARAMETERS", "maintainability", too_many, params, F.lit(t.parameters),
             F.concat(title, F.lit(" "), quoted, F.lit(" accepts "), params.cast("string"),
                      F.lit(f" parameters (threshold: {t.parameters}).")),
             "Pass related parameters as one object."),
        rule("MISSING_DOCSTRING", "documentation", undocumented, None, None,
             F.when(function, F.concat(F.lit("Public "), "entity_type", F.lit(" "), quoted,
                                       F.lit(" has no docstring or documentation.")))
             .otherwise(F.concat(F.lit("Public class "), quoted, F.lit(" has no docstring or documentation."))),
             "Describe purpose, parameters and result."),
    )


def entity_findings(metrics: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """All rules on entity metrics in one pass: each row builds the array of rules it breaks."""
    return _exploded(metrics, _entity_rules(t))


def broad_handlers(files: DataFrame) -> DataFrame:
    """Bare, Exception and BaseException handlers of Python files with their block and enclosing function or class."""
    return explode_rows(files, "handlers", "h", "repo", "path").select(
        "repo", "path", F.col("h.n").alias("start_line"), F.col("h.end").alias("end_line"), F.col("h.caught").alias("caught"),
        "h.only_pass", "h.has_pass", F.col("h.x").alias("source_line"), F.col("h.entity").alias("entity_name"),
    )


def _handler_finding(caught: Column, silent: Column, start: Column, end: Column) -> Column:
    handler = F.when(caught.isNull(), F.lit("bare 'except:'")).otherwise(F.concat(F.lit("'except "), caught, F.lit(":'")))
    message = F.when(silent, F.concat(F.lit("Silent suppression: "), handler, F.lit(" caught with empty/pass body."))).otherwise(
        F.concat(F.lit("Broad exception handling: "), handler, F.lit(" caught.")))
    severity = F.when(silent, F.lit("error")).otherwise(F.lit("warning"))
    return _found("BROAD_EXCEPTION", "error_handling", severity, start, end, message, "Name the exceptions to handle and log the rest.")


def broad_exception_findings(handlers: DataFrame) -> DataFrame:
    """Findings of :func:`broad_handlers`, each with its ``source_line``."""
    finding = _handler_finding(F.col("caught"), F.col("only_pass"), F.col("start_line"), F.col("end_line"))
    return _exploded(handlers, F.array(finding), "source_line")


def unused_names(lines: Column, labels: Column, language: Column) -> Column:
    """``array<struct<n, symbol>>``: imported symbols with no whole-word use outside import lines.

    Each symbol is searched in the text of the other lines up to its first whole-word use; most that have none do not stand in it
    at all, which needs no pattern. Only the first line of an import is left out, so names on its later lines count as used.
    """
    rows = extract.labelled_lines(lines, labels)
    other = F.filter(rows, lambda r: ~((r["label"] == "c") & r["x"].rlike(extract.IMPORT_LINE)))
    rest = F.array_join(F.transform(other, lambda r: r["x"]), "\n")
    symbols = F.flatten(F.transform(extract.import_statements(lines, labels), lambda r: F.flatten(F.transform(
        F.coalesce(extract.imported(r["x"], language), F.array().cast(extract._IMPORT)),
        lambda i: F.transform(i["imported_names"], lambda name: F.struct(r["n"].alias("n"), F.coalesce(i["alias"], name).alias("symbol")))))))

    def unused(found: Column, text: Column) -> Column:
        def used(symbol: Column) -> Column:
            # the symbol itself comes first in the pattern, so the search skips to it
            name = F.concat(F.lit(r"\Q"), symbol, F.lit(r"\E(?<![\p{L}\p{N}_]\Q"), symbol, F.lit(r"\E)(?![\p{L}\p{N}_])"))
            dotted = F.concat(F.lit(r"(?U)\b\Q"), symbol, F.lit(r"\E\b"))
            pattern = F.when(symbol.rlike(r"^[\p{L}\p{N}_]+\z"), name).otherwise(dotted)
            return F.contains(text, symbol) & F.regexp_like(text, pattern)

        return F.filter(found, lambda u: (u["symbol"] != "*") & ~used(u["symbol"]))

    none = F.array().cast("array<struct<n:int,symbol:string>>")
    return bind(symbols, lambda found: F.when(F.size(found) == 0, none).otherwise(bind(rest, lambda text: unused(found, text))))


def unused_imports(files: DataFrame) -> DataFrame:
    """``(repo, path, line_number, symbol)`` of :func:`unused_names`."""
    found = explode_rows(files, unused_names(F.col("lines"), F.col("labels"), F.col("language")), "u", "repo", "path")
    return found.select("repo", "path", F.col("u.n").alias("line_number"), F.col("u.symbol").alias("symbol"))


def _import_finding(symbol: Column, line: Column) -> Column:
    return _found(
        "POTENTIALLY_UNUSED_IMPORT", "maintainability", "info", line, line,
        F.concat(F.lit("Imported symbol '"), symbol, F.lit("' is never referenced in this file.")),
        F.concat(F.lit("Drop the import of '"), symbol, F.lit("' if nothing needs it.")), symbol, "import")


def unused_import_findings(unused: DataFrame) -> DataFrame:
    return _exploded(unused, F.array(_import_finding(F.col("symbol"), F.col("line_number"))))


def duplicate_findings(duplicates: DataFrame) -> DataFrame:
    n = F.col("lines_count")
    none = F.lit(None).cast("string")
    return _finish(duplicates.select(
        F.lit("DUPLICATE_CODE_BLOCK").alias("rule_id"), F.lit("duplication").alias("category"), F.lit("warning").alias("severity"),
        "repo", "path", "start_line", "end_line", none.alias("entity_name"), none.alias("entity_type"),
        F.concat(
            F.lit("Duplicate code block of "), n.cast("string"), F.lit("+ lines matches code in '"), "original_path", F.lit("' (lines "),
            F.col("original_start").cast("string"), F.lit("-"), (F.col("original_start") + n - 1).cast("string"), F.lit(")."),
        ).alias("message"),
        F.lit("Move the shared block into one place.").alias("suggestion"),
        n.cast("double").alias("metric_value"), F.lit(None).cast("double").alias("threshold"),
    ))


_ITEM = (
    f"struct<d:{extract.DECLARATION_ITEM},h:struct<{scanner.HANDLER.replace(' ', ':').replace(',:', ',')}>,"
    "u:struct<n:int,symbol:string>,size:struct<total:bigint,code:bigint,comment:bigint,blank:bigint>>"
)


def file_items(files: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """What one file decides, in one pass over ``extract.with_declarations``: a row per entity, handler, unused import, and one
    per file with its line counts; each with the ``findings`` it gives and, an entity, with its metrics.

    A row holds its own text only, and after that none.
    """
    def item(kind: str, value: Column) -> Column:
        empty = F.lit(None).cast(_ITEM)
        return F.struct(*[(value if k == kind else empty[k]).alias(k) for k in ("d", "h", "u", "size")]).cast(_ITEM)

    count = lambda letter: (F.length("labels") - F.length(F.replace("labels", F.lit(letter), F.lit("")))).cast("bigint")
    size = F.struct(F.length("labels").cast("bigint").alias("total"), count("c").alias("code"), count("m").alias("comment"), count("b").alias("blank"))
    unused = unused_names(F.col("lines"), F.col("labels"), F.col("language"))
    items = F.concat(
        F.transform(extract.declaration_items(F.col("lines"), F.col("decls")), lambda d: item("d", d)),
        F.transform("handlers", lambda h: item("h", h)), F.transform(unused, lambda u: item("u", u)), F.array(item("size", size)),
    )
    rows = explode_rows(files, items, "item", "repo", "path", "language")
    rows = rows.select("repo", "path", "language", "item", *extract.declaration_columns("item.d")).withColumn("entity_type", _entity_type())
    rows = rows.select("repo", "path", "item", "start_line", "end_line", F.col("name").alias("entity_name"), "entity_type", *_metrics())
    h, u, total = "item.h", "item.u", F.col("item.size.total")
    handler = _handler_finding(F.col(f"{h}.caught"), F.col(f"{h}.only_pass"), F.col(f"{h}.n"), F.col(f"{h}.end"))
    found = (
        F.when(F.col("entity_type").isNotNull(), _entity_rules(t)).when(F.col(h).isNotNull(), F.array(handler))
        .when(F.col(u).isNotNull(), F.array(_import_finding(F.col(f"{u}.symbol"), F.col(f"{u}.n"))))
        .when(total.isNotNull(), F.array(_size_finding(total, t)))
    )
    return rows.select("repo", "path", F.col("item.size").alias("size"), *[c for c in rows.columns if c not in ("repo", "path", "item")],
                       F.array_compact(found).alias("findings"))


def file_findings(files: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """All findings that one file decides (everything but duplicates)."""
    return _exploded(file_items(files, t), F.col("findings"))


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Worst first: severity, path, line."""
    return findings.orderBy(severity_rank(F.col("severity")), "repo", "path", "start_line", "rule_id", "entity_name")


def letter_grade(score: Column) -> Column:
    return (
        F.when(score >= 90, F.lit("A")).when(score >= 80, F.lit("B")).when(score >= 70, F.lit("C")).when(score >= 60, F.lit("D"))
        .otherwise(F.lit("F"))
    )


def _weighted(severity: Column, weights: dict[str, float], other: float) -> Column:
    items = list(weights.items())
    column = F.when(severity == items[0][0], F.lit(items[0][1]))
    for name, w in items[1:]:
        column = column.when(severity == name, F.lit(w))
    return column.otherwise(F.lit(other))


FILE_WEIGHTS = {"critical": 20.0, "error": 12.0, "warning": 5.0, "info": 1.5}
REPO_WEIGHTS = {"critical": 15.0, "error": 8.0, "warning": 3.0, "info": 1.0}


def file_health(counts: DataFrame, findings: DataFrame) -> DataFrame:
    """Score and grade per file from its own findings (duplicates never lower a file score)."""
    own = findings.filter(F.col("category") != "duplication").groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("findings_count"), F.sum(_weighted(F.col("severity"), FILE_WEIGHTS, 0.0)).alias("penalty")
    )
    scale = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("total_lines") / F.lit(100.0)))
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - F.coalesce("penalty", F.lit(0.0)) / scale)), 1)
    return (
        counts.join(own, ["repo", "path"], "left")
        .withColumn("health_score", score)
        .withColumn("letter_grade", letter_grade(F.col("health_score")))
        .withColumn("findings_count", F.coalesce("findings_count", F.lit(0)))
        .drop("penalty")
    )


def file_summaries(counts: DataFrame, findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """File health with function, class and complexity figures, worst first."""
    function = F.col("entity_type") != "class"
    per_file = metrics.groupBy("repo", "path").agg(
        F.count_if(function).alias("functions_count"), F.count_if(~function).alias("classes_count"),
        F.bround(F.avg("cyclomatic_complexity"), 1).alias("average_complexity"),
        F.max("cyclomatic_complexity").alias("max_complexity"),
    )
    return worst_first(file_health(counts, findings).join(per_file, ["repo", "path"], "left").na.fill(
        {"functions_count": 0, "classes_count": 0, "average_complexity": 1.0, "max_complexity": 1}
    ))


def worst_first(health: DataFrame) -> DataFrame:
    return health.orderBy("health_score", F.desc("findings_count"), "repo", "path")


def repo_health(counts: DataFrame, findings: DataFrame, metrics: DataFrame | None = None, rejects: DataFrame | None = None) -> DataFrame:
    """Sub-scores, overall score and grade per repository."""
    lines_per_repo = counts.groupBy("repo").agg(F.sum("total_lines").alias("total_lines"))
    weight = _weighted(F.col("severity"), REPO_WEIGHTS, 2.0)

    def penalty(*categories: str) -> Column:
        return F.sum(F.when(F.col("category").isin(*categories), weight).otherwise(F.lit(0.0)))

    penalties = findings.groupBy("repo").agg(
        penalty("size", "maintainability").alias("p_maint"), penalty("complexity").alias("p_complex"),
        penalty("error_handling", "duplication").alias("p_reliab"),
    )
    joined = lines_per_repo.join(penalties, "repo", "left")
    if metrics is not None:
        documented = metrics.filter("is_public").groupBy("repo").agg(
            F.count(F.lit(1)).alias("public_entities"), F.count_if("has_docstring").alias("documented")
        )
        joined = joined.join(documented, "repo", "left")
    else:
        joined = joined.withColumn("public_entities", F.lit(0)).withColumn("documented", F.lit(0))
    if rejects is not None:
        joined = joined.join(rejects.groupBy("repo").agg(F.count(F.lit(1)).alias("n_rejects")), "repo", "left")
    else:
        joined = joined.withColumn("n_rejects", F.lit(0))
    joined = joined.na.fill(0)
    kloc = F.greatest(F.lit(1.0), F.col("total_lines") / F.lit(1000.0))

    def score(p: Column, factor: float) -> Column:
        return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - p / kloc * F.lit(factor))), 1)

    scored = joined.select(
        "repo", score(F.col("p_maint"), 1.5).alias("maintainability_score"), score(F.col("p_complex"), 1.8).alias("complexity_score"),
        F.when(F.col("public_entities") == 0, F.lit(100.0)).otherwise(
            F.bround(F.col("documented") / F.col("public_entities") * 100.0, 1)
        ).alias("documentation_score"),
        score(F.col("p_reliab") + F.col("n_rejects") * 10.0, 1.5).alias("reliability_score"),
    )
    overall = F.bround(
        F.lit(0.35) * F.col("maintainability_score") + F.lit(0.30) * F.col("complexity_score")
        + F.lit(0.15) * F.col("documentation_score") + F.lit(0.20) * F.col("reliability_score"), 1,
    )
    return scored.withColumn("overall_score", overall).withColumn("letter_grade", letter_grade(F.col("overall_score")))


def repo_metrics(items: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """Totals, means and maxima per repository from :func:`file_items`, and ``duplicates`` as of ``lines.duplicate_blocks``.

    One pass: files, entities and findings are rows of the same table, and sums are combined before the shuffle.
    """
    function = F.col("entity_type") != "class"
    public = F.col("entity_type").isNotNull() & F.col("is_public")
    sums = items.groupBy("repo").agg(
        *[F.sum(f"size.{part}").alias(f"{part}_lines") for part in ("total", "code", "comment", "blank")],
        F.count("size").alias("total_files_analyzed"),
        F.count_if(function).alias("total_functions"), F.count_if(~function).alias("total_classes"),
        F.bround(F.avg(F.when(function, F.col("lines_count"))), 1).alias("average_function_length"),
        F.bround(F.avg(F.when(function, F.col("cyclomatic_complexity"))), 1).alias("average_cyclomatic_complexity"),
        F.max(F.when(function, F.col("cyclomatic_complexity"))).alias("max_cyclomatic_complexity"),
        F.bround(F.count_if(public & F.col("has_docstring")) / F.count_if(public) * 100.0, 1).alias("docstring_coverage_percentage"),
        F.count_distinct(F.when(F.size("findings") > 0, F.col("path"))).alias("files_with_issues"),
    )
    if duplicates is None:
        counted = sums.withColumn("duplicate_blocks_count", F.lit(0).cast("bigint"))
    else:
        counted = sums.join(duplicates.groupBy("repo").agg(F.count(F.lit(1)).alias("duplicate_blocks_count")), "repo", "left")
    return counted.na.fill({
        "average_function_length": 0.0, "average_cyclomatic_complexity": 1.0,
        "max_cyclomatic_complexity": 1, "docstring_coverage_percentage": 100.0, "duplicate_blocks_count": 0,
    })


def breakdown(
    findings: DataFrame, repos: DataFrame, categories: tuple[str, ...] = CATEGORIES, severities: tuple[str, ...] = SEVERITIES
) -> DataFrame:
    """``(repo, dimension, key, n)``: findings per category and per severity in one pass, zero where there are none."""
    counted = findings.groupingSets(
        [[F.col("repo"), F.col("category")], [F.col("repo"), F.col("severity")]],
        F.col("repo"), F.col("category"), F.col("severity"),
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping("category").alias("g"))
    long = counted.select(
        "repo", F.when(F.col("g") == 0, F.lit("category")).otherwise(F.lit("severity")).alias("dimension"),
        F.when(F.col("g") == 0, F.col("category")).otherwise(F.col("severity")).alias("key"), "n",
    )
    slots = F.array(
        *[F.struct(F.lit("category").alias("dimension"), F.lit(c).alias("key")) for c in categories],
        *[F.struct(F.lit("severity").alias("dimension"), F.lit(s).alias("key")) for s in severities],
    )
    grid = repos.select("repo").distinct().select("repo", F.inline(slots))
    return grid.join(long, ["repo", "dimension", "key"], "left").select("repo", "dimension", "key", F.coalesce("n", F.lit(0)).alias("n"))


def severity_pivot(findings: DataFrame, severities: tuple[str, ...] = SEVERITIES) -> DataFrame:
    """One row per repository with a column per severity."""
    return findings.groupBy("repo").pivot("severity", list(severities)).count().na.fill(0)


def dedupe(findings: DataFrame, keys: tuple[str, ...] = ("rule_id", "repo", "path", "start_line")) -> DataFrame:
    """First finding per rule, file and line, in a stated order."""
    order = Window.partitionBy(*keys).orderBy("finding_id")
    return findings.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1).drop("_r")
