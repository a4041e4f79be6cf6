"""Stack traces to frames, path resolution against the corpus, evidence packing and diagnosis.

Parsing is column work on one trace row (also usable on a stream). Resolution explodes path suffixes to an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import paths, text
from corpusloom.functions.rows import explode_rows, posexplode_rows
from corpusloom.functions.text import strip
from corpusloom.functions.vectors import bind
from corpusloom.operators import extract, lines as line_ops
from corpusloom.operators.graph import salted_join
from corpusloom.session import stored

MAX_SNIPPETS = 6
MAX_EVIDENCE_LINES = 500
MAX_ENTITY_SPAN = 60

# Headers, frames and errors of traces.
PY_HEADER = r"(?m)^Traceback \(most recent call last\):"
PY_FRAME = r"^\s*File \"([^\"]+)\", line (\d+)(?:, in (.+))?$"
_ERROR_NAME = r"[A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception|Warning|Fault|Interrupt)"
PY_ERROR = r"(?m)^(" + _ERROR_NAME + r")\s*:\s*(.+)$"
PY_ERROR_ONLY = r"(?m)^(" + _ERROR_NAME + r")\s*$"
JS_ERROR = r"(?m)^(?:Uncaught\s+)?([A-Za-z_][A-Za-z0-9_]*(?:Error|Exception))\s*:\s*(.+)$"
JS_FRAME = r"^\s*at\s+(?:(.+?)\s+)?\(?([^:\s()]+):(\d+)(?::(\d+))?\)?$"
FILE_LINE = r"(?m)(?:^|\s)([a-zA-Z0-9_/\\.-]+\.(?:py|js|ts|tsx|jsx|java|go|rs|rb|cpp|c|h)):(\d+)"
NO_MESSAGE = "Unable to extract a clear error message from the input."


def _frame(path: Column, line: Column, function: Column | None = None, context: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    clean = F.replace(F.btrim(strip(path), F.lit("'\"")), F.lit("\\"), F.lit("/"))
    return F.struct(
        clean.alias("file_path"), line.try_cast("int").alias("line_number"),
        (none if function is None else F.nullif(strip(function), F.lit(""))).alias("function_name"),
        (none if context is None else context).alias("code_context"), paths.is_application_path(clean).alias("is_application_code"),
    )


def _python_frames(lines: Column) -> Column:
    def at(x: Column, i: Column) -> Column:
        following = F.get(lines, i + 1)
        context = F.when(~following.rlike(PY_FRAME), F.nullif(strip(following), F.lit("")))
        return F.when(
            x.rlike(PY_FRAME),
            _frame(F.regexp_extract(x, PY_FRAME, 1), F.regexp_extract(x, PY_FRAME, 2), F.regexp_extract(x, PY_FRAME, 3), context),
        )

    return F.filter(F.transform(lines, at), lambda f: f.isNotNull())


def _script_frames(lines: Column) -> Column:
    return F.transform(
        F.filter(lines, lambda x: x.rlike(JS_FRAME)),
        lambda x: _frame(F.regexp_extract(x, JS_FRAME, 2), F.regexp_extract(x, JS_FRAME, 3), F.regexp_extract(x, JS_FRAME, 1)),
    )


def _plain_frames(c: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(c, F.lit(FILE_LINE), F.lit(0)),
        lambda m: _frame(F.regexp_extract(m, FILE_LINE, 1), F.regexp_extract(m, FILE_LINE, 2)),
    )


def parse_traces(traces: DataFrame) -> DataFrame:
    """Add language, error type and message, all frames (outermost first) and the distinct paths in order, from the whole text."""
    t = F.coalesce("text", F.lit(""))
    base = traces.withColumn("raw_trace", t).withColumn("_lines", text.split_lines(F.col("raw_trace")))
    base = (
        base.withColumn("_py", _python_frames(F.col("_lines")))
        .withColumn("_js", _script_frames(F.col("_lines")))
        .withColumn("_any", _plain_frames(F.col("raw_trace")))
    )
    raw = F.col("raw_trace")
    hint = F.lower(strip(F.coalesce("language_hint", F.lit(""))))
    py_type = F.coalesce(
        F.nullif(F.regexp_extract(raw, PY_ERROR, 1), F.lit("")), F.nullif(F.regexp_extract(raw, PY_ERROR_ONLY, 1), F.lit(""))
    )
    blank = strip(raw) == ""
    form = (
        F.when(blank, F.lit("empty"))
        .when(hint.isin("python", "py"), F.lit("python"))
        .when(hint.isin("javascript", "typescript", "js", "ts", "node"), F.lit("javascript"))
        .when(raw.rlike(PY_HEADER), F.lit("python"))
        .when((F.size("_js") > 0) | raw.rlike(JS_ERROR), F.lit("javascript"))
        .when((F.size("_py") > 0) | (F.size("_any") > 0) | py_type.isNotNull(), F.lit("python"))
        .otherwise(F.lit("generic"))
    )
    form_col = F.col("_form")
    js_type = F.nullif(F.regexp_extract(raw, JS_ERROR, 1), F.lit(""))
    own = F.when(form_col == "python", F.col("_py")).when(form_col == "javascript", F.col("_js"))
    frames = F.when(form_col == "empty", F.slice("_any", 1, 0)).otherwise(
        F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(F.col("_any"))
    )
    kind = F.when(form_col == "python", py_type).when(form_col == "javascript", js_type)
    stated = F.when(
        form_col == "python", F.coalesce(F.nullif(strip(F.regexp_extract(raw, PY_ERROR, 2)), F.lit("")), py_type)
    ).when(form_col == "javascript", F.nullif(strip(F.regexp_extract(raw, JS_ERROR, 2)), F.lit("")))
    first_line = F.left(strip(F.get(text.split_lines(strip(raw)), 0)), F.lit(text.MAX_MESSAGE_CHARS))
    message = F.when(form_col == "empty", F.lit("")).otherwise(
        F.coalesce(stated, F.nullif(first_line, F.lit("")), F.lit(NO_MESSAGE))
    )
    language = F.when(form_col.isin("python", "javascript"), form_col).when(
        (form_col == "generic") & (hint != ""), hint
    )
    return (
        base.withColumn("_form", form)
        .withColumn("language", language)
        .withColumn("error_type", kind)
        .withColumn("error_message", message)
        .withColumn("_frames", frames)
        .withColumn(
            "file_paths", F.array_distinct(F.filter(F.transform("_frames", lambda f: f["file_path"]), lambda p: p != ""))
        )
        .withColumnRenamed("_frames", "frames")
        .drop("_lines", "_py", "_js", "_any", "_form")
    )


def frames(parsed: DataFrame) -> DataFrame:
    """``(trace_id, repo, frame_no, …)``."""
    rows = posexplode_rows(parsed, "frames", "_pos", "f", "trace_id", "repo")
    return rows.select("trace_id", "repo", (F.col("_pos") + 1).alias("frame_no"), "f.*")


def resolve_paths(references: DataFrame, files: DataFrame, column: str = "file_path") -> DataFrame:
    """Add ``resolved_path``: the exact corpus path, else the longest suffix that is one; null for escapes and misses.

    Distinct (repository, path) pairs are resolved, so a path named by very many traces is looked up once.
    """
    wanted = references.select("repo", F.col(column).alias("_raw")).distinct()
    clean = paths.clean_path(F.col("_raw"))
    candidates = F.array_distinct(F.concat(F.array(clean), paths.path_suffixes(clean)))
    exploded = posexplode_rows(wanted.filter(clean.isNotNull()), candidates, "priority", "path", "repo", "_raw")
    found = salted_join(exploded, files.select("repo", "path").distinct(), ["repo", "path"], ["_raw"], "inner")
    best = found.groupBy("repo", "_raw").agg(F.min_by("path", "priority").alias("resolved_path"))
    keyed = references.withColumn("_raw", F.col(column))
    return salted_join(keyed, best, ["repo", "_raw"], ["trace_id"]).drop("_raw")


def missing_files(resolved: DataFrame) -> DataFrame:
    """Application paths of a trace that are not in the corpus."""
    return resolved.filter(F.col("is_application_code") & F.col("resolved_path").isNull() & (F.col("file_path") != "")).select(
        "trace_id", "repo", "file_path"
    ).distinct()


def _snippets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Snippet of each distinct ``(repo, path, line)``: the enclosing entity where it is short, else a window.

    ``targets`` are read more than once; ``files`` need ``lines``, ``content`` and ``language``.
    """
    total = F.size("lines")

    def cut(t: Column) -> Column:
        line = t["line"]
        valid = line.isNotNull() & (line >= 1) & (line <= total)
        start, end = text.context_window(line, total)

        def ranged(entity: Column) -> Column:
            short = valid & entity.isNotNull() & (entity["end"] - entity["n"] <= MAX_ENTITY_SPAN)
            return F.struct(
                F.when(valid, entity["name"]).alias("entity"), F.when(short, entity["n"]).otherwise(start).alias("s"),
                F.when(short, F.least(total, entity["end"])).otherwise(end).alias("e"))

        return bind(bind(extract.enclosing(F.col("decls"), line), ranged), lambda r: F.struct(
            line.alias("line"), r["entity"].alias("entity"), r["s"].alias("start_line"), r["e"].alias("end_line"),
            text.numbered_snippet(F.col("lines"), r["s"], r["e"]).alias("code_snippet")))

    # only the files with targets are scanned
    near = files.filter(F.col("content") != "").join(targets.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    return line_ops.at_files(targets, extract.with_declarations(near), ["lines", "decls"], cut)


_EVIDENCE = (
    "array<struct<path:string,line:int,start_line:int,end_line:int,entity_name:string,relevance:string,code_snippet:string>>"
)


_NAMED = "array<struct<phase:int,ord:int,file_path:string,line:int,hint:string>>"


def _named_files(frames: Column, user_file: Column, file_paths: Column) -> Column:
    """The files that one trace names, each with its rank: frames, innermost first, then the user's file, then all paths."""
    none_int, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")

    def named(phase: int, order: Column, path: Column, line: Column = none_int, hint: Column = none_text) -> Column:
        return F.struct(F.lit(phase).alias("phase"), order.alias("ord"), path.alias("file_path"), line.alias("line"), hint.alias("hint"))

    groups = (
        F.transform(frames, lambda f, i: named(1, -(i + 1), f["file_path"], f["line_number"], f["function_name"])),
        F.when(F.coalesce(user_file, F.lit("")) != "", F.array(named(2, F.lit(0), user_file))),
        F.transform(file_paths, lambda p, i: named(3, i, p)),
    )
    return F.concat(*[F.coalesce(g.cast(_NAMED), F.array().cast(_NAMED)) for g in groups])


def pack_evidence(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """``(trace_id, evidence, related_files, total_lines)``: innermost frames first, then the user's file, then others.

    At most six snippets; none is added once 500 lines are used; a frame inside an accepted snippet adds none. The fold
    runs over one trace's candidates, whose number the trace length bounds.
    """
    function, number = F.col("hint"), F.col("line").cast("string")
    frame_note = (
        F.when(
            function.isNotNull() & number.isNotNull(),
            F.concat(F.lit("Stack frame line "), number, F.lit(" in '"), function, F.lit("'")),
        )
        .when(number.isNotNull(), F.concat(F.lit("Stack frame line "), number))
        .otherwise(F.lit("Referenced in stack trace"))
    )
    note = (
        F.when(F.col("phase") == 1, frame_note).when(F.col("phase") == 2, F.lit("User-specified target file for debugging analysis"))
        .otherwise(F.lit("File referenced in error text"))
    )
    # a trace is parsed once: what several steps read is stored
    named = _named_files(F.col("frames"), F.col("user_file_path"), F.col("file_paths"))
    references = stored(
        explode_rows(parsed, named, "_n", "trace_id", "repo").select("trace_id", "repo", "_n.*").withColumn("relevance", note), "references")
    resolved = resolve_paths(references, files).filter(F.col("resolved_path").isNotNull())
    wanted = stored(resolved.withColumnRenamed("resolved_path", "path"), "evidence-references")
    targets = stored(wanted.select("repo", "path", "line").distinct(), "evidence-lines")
    cut = _snippets(targets, files).withColumn("_line", F.coalesce("line", F.lit(-1))).drop("line")
    joined = salted_join(
        wanted.withColumn("_line", F.coalesce("line", F.lit(-1))), cut, ["repo", "path", "_line"], ["trace_id"], "inner"
    )
    candidate = F.struct(
        "phase", "ord", "path", "line", "start_line", "end_line",
        F.when(F.col("entity").isNotNull() | (F.col("phase") == 1), F.coalesce("entity", "hint")).alias("entity_name"), "relevance", "code_snippet",
    )
    ordered = joined.groupBy("trace_id", "repo").agg(F.array_sort(F.collect_list(candidate)).alias("_c"))

    def step(s: Column, c: Column) -> Column:
        open_slot = (F.size(s["kept"]) < MAX_SNIPPETS) & (s["used"] < MAX_EVIDENCE_LINES)
        covered = F.exists(
            s["kept"], lambda k: (k["path"] == c["path"]) & (k["start_line"] <= c["line"]) & (c["line"] <= k["end_line"])
        )
        has_path = F.exists(s["kept"], lambda k: k["path"] == c["path"])
        skip = (
            F.when(c["phase"] == 1, F.coalesce(covered, F.lit(False)))
            .when(c["phase"] == 2, has_path)
            .otherwise(F.array_contains(s["related"], c["path"]))
        )
        related = F.array_union(s["related"], F.array(c["path"]))
        item = F.struct(*[c[f].alias(f) for f in ("path", "line", "start_line", "end_line", "entity_name", "relevance", "code_snippet")])
        taken = F.struct(
            F.concat(s["kept"], F.array(item)).alias("kept"),
            (s["used"] + c["end_line"] - c["start_line"] + 1).alias("used"), related.alias("related"),
        )
        passed = F.struct(
            s["kept"].alias("kept"), s["used"].alias("used"),
            F.when(c["phase"] == 1, related).otherwise(s["related"]).alias("related"),
        )
        return F.when(~open_slot, s).when(skip, passed).otherwise(taken)

    folded = F.aggregate(
        "_c",
        F.struct(
            F.array().cast(_EVIDENCE).alias("kept"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("related")
        ),
        step,
    )
    return ordered.select("trace_id", "repo", folded.alias("s")).select(
        "trace_id", "repo", F.col("s.kept").alias("evidence"), F.array_sort("s.related").alias("related_files"),
        F.col("s.used").alias("total_lines"),
    )


def evidence_rows(packed: DataFrame) -> DataFrame:
    rows = posexplode_rows(packed, "evidence", "_pos", "e", "trace_id", "repo")
    return rows.select("trace_id", "repo", (F.col("_pos") + 1).alias("evidence_no"), "e.*")


def evidence_text(packed: DataFrame) -> DataFrame:
    """Evidence of a trace as one text."""
    blocks = F.transform(
        "evidence",
        lambda e, i: F.concat(
            F.lit("--- [Evidence E"), (i + 1).cast("string"), F.lit("] File: "), e["path"], F.lit(" (Lines "), e["start_line"].cast("string"),
            F.lit("-"), e["end_line"].cast("string"), F.lit(")"),
            F.coalesce(F.concat(F.lit(" | Entity: "), e["entity_name"]), F.lit("")), F.lit(" ---\nRelevance: "), e["relevance"],
            F.lit("\n```\n"), e["code_snippet"], F.lit("\n```"),
        ),
    )
    return packed.select(
        "trace_id", F.when(F.size("evidence") > 0, F.array_join(blocks, "\n\n"))
        .otherwise(F.lit("No matching repository source files found.")).alias("context_text"),
    )


def innermost_frame(parsed: DataFrame) -> DataFrame:
    """The last application frame of a trace, else its last frame."""
    own = F.filter("frames", lambda f: f["is_application_code"] & (f["file_path"] != ""))
    return parsed.withColumn("_f", F.coalesce(F.try_element_at(own, F.lit(-1)), F.try_element_at("frames", F.lit(-1))))


def diagnose(parsed: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """Deterministic cause, first step and fix hint per trace; confidence is high only with located source."""
    rows = innermost_frame(parsed)
    if packed is not None:
        rows = rows.join(packed.select("trace_id", (F.size("evidence") > 0).alias("has_source")), "trace_id", "left")
    else:
        rows = rows.withColumn("has_source", F.lit(False))
    kind = F.coalesce("error_type", F.lit("RuntimeError"))
    message = F.coalesce(F.nullif("error_message", F.lit("")), F.lit("An unhandled exception occurred."))
    path, line = F.coalesce("_f.file_path", F.lit("unknown")), F.col("_f.line_number")
    place = F.concat_ws(
        " ", path, F.concat(F.lit("at line "), line.cast("string")),
        F.concat(F.lit("in function '"), F.col("_f.function_name"), F.lit("'")),
    )
    lowered = F.lower(kind)
    fix = (
        F.when(lowered.contains("zerodivision"), F.lit("check the divisor before dividing"))
        .when(lowered.contains("keyerror"), F.lit("read the key with a default or test for it first"))
        .when(lowered.contains("typeerror") & F.lower(message).contains("none"), F.lit("test for None before the operation"))
    )
    return rows.select(
        "trace_id", kind.alias("error_type"), place.alias("location"),
        F.concat(F.lit("A "), kind, F.lit(" was raised during execution: "), message).alias("error_summary"),
        F.concat(F.lit("Inspect "), path, F.lit(" around line "), F.coalesce(line, F.lit(1)).cast("string")).alias("first_step"),
        fix.alias("suggested_fix"),
        F.when(F.coalesce("has_source", F.lit(False)), F.lit("high")).otherwise(F.lit("medium")).alias("confidence"),
    )


CONFIDENCES = ("high", "medium", "low")


def calibrate_confidence(reported: Column, has_source: Column) -> Column:
    """Unknown levels become medium; ``high`` needs located source."""
    clean = F.lower(strip(F.coalesce(reported, F.lit("medium"))))
    known = F.when(clean.isin(*CONFIDENCES), clean).otherwise(F.lit("medium"))
    return F.when((known == "high") & ~F.coalesce(has_source, F.lit(False)), F.lit("medium")).otherwise(known)


def filter_related(suggested: Column, located: Column) -> Column:
    """Suggested files that were located (sorted); all located where none match; where nothing was located, all
    relative suggestions, redacted."""
    from corpusloom.functions.secrets import redact_secrets

    both = F.array_sort(F.array_distinct(F.array_intersect(suggested, located)))
    fallback = F.transform(
        F.filter(suggested, lambda p: (p != "") & ~p.startswith("/") & ~p.contains("..")), lambda p: redact_secrets(p, "debug")
    )
    return F.when(F.size(located) == 0, fallback).when(F.size(both) > 0, both).otherwise(F.array_sort(located))


