"""Review findings: conversion of rule findings, grounding of outside findings, merging and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import schemas
from corpusloom.functions import text
from corpusloom.functions.rows import posexplode_rows
from corpusloom.functions.secrets import redact_secrets
from corpusloom.functions.text import strip
from corpusloom.functions.vectors import bind
from corpusloom.operators import lines as line_ops, quality

# Enumerations of the review schema.
CATEGORIES = ("correctness", "security", "performance", "maintainability", "readability", "testing")
SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")
DEFAULT_ADVICE = "Review the flagged lines against common practice."
MIN_EVIDENCE_CHARS = 4

REVIEW = (
    "title", "category", "severity", "confidence", "repo", "path", "start_line", "end_line", "entity_name", "problem", "evidence",
    "recommendation", "suggested_change", "source", "is_verified",
)


def coerce(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    clean = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(clean.isin(*allowed), clean).otherwise(F.lit(default))


def rule_title(rule_id: Column) -> Column:
    return F.initcap(F.lower(F.replace(rule_id, F.lit("_"), F.lit(" "))))


def from_quality(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Quality findings on functions and handlers in the review schema, with their first source line as evidence. Findings that
    bring it as ``source_line`` need not look it up in ``files``."""
    broad = F.col("rule_id") == "BROAD_EXCEPTION"
    chosen = findings.filter((F.col("entity_type") == "function") | broad)
    evidence = lambda line: strip(F.coalesce(line, F.lit("")))
    if "source_line" in findings.columns:
        with_line = chosen.filter(F.col("repo").isNotNull() & F.col("path").isNotNull()).withColumn("evidence", evidence(F.col("source_line")))
    else:
        with_line = line_ops.at_files(chosen, files, ["lines"], lambda f: f.withField("evidence", evidence(F.get("lines", f["start_line"] - 1))))
    none = F.lit(None).cast("string")
    return with_line.select(
        F.when(broad, F.lit("Overly Broad Exception Handling")).otherwise(rule_title(F.col("rule_id"))).alias("title"),
        F.when(broad, F.lit("correctness")).otherwise(F.lit("maintainability")).alias("category"),
        F.when(broad, F.lit("medium")).otherwise(F.col("severity")).alias("severity"), F.lit("high").alias("confidence"), "repo", "path",
        "start_line", "end_line", "entity_name", F.col("message").alias("problem"), "evidence",
        F.coalesce("suggestion", F.lit(DEFAULT_ADVICE)).alias("recommendation"), none.alias("suggested_change"),
        F.lit("static_analysis").alias("source"), F.lit(True).alias("is_verified"),
    )


def from_security(findings: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return findings.select(
        "title", F.lit("security").alias("category"), "severity", "confidence", "repo", "path", "start_line", "end_line", "entity_name",
        F.col("evidence_summary").alias("problem"), F.col("evidence_summary").alias("evidence"),
        F.col("remediation").alias("recommendation"), none.alias("suggested_change"), F.lit("static_analysis").alias("source"),
        F.lit(True).alias("is_verified"),
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Raw findings in the free-text answers of a reviewer: ``(review_id, repo, path, finding_no, …)``."""
    parsed = responses.withColumn("_d", text.json_from_free_text(F.col("text"), schemas.REVIEW_JSON))
    rows = posexplode_rows(parsed, "_d.findings", "_pos", "f", "review_id", "repo", "path")
    return rows.select("review_id", "repo", "path", (F.col("_pos") + 1).alias("finding_no"), "f.*")


def ground(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Outside findings checked against the source.

    Findings without title or problem are dropped, enumerations coerced, and all text redacted. A range outside the file
    is moved to the first line that holds the first evidence line; where there is none it is clamped and unverified. Line
    numbers are absolute.
    """
    clean = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    named = raw.filter((clean("title") != "") & (clean("problem") != ""))
    named = (
        named.withColumn("_s", F.coalesce(F.col("start_line").try_cast("int"), F.lit(1)))
        .withColumn("_e", F.coalesce(F.col("end_line").try_cast("int"), F.col("_s")))
        .withColumn("_evidence", clean("evidence"))
        .withColumn("_parts", text.split_lines(F.col("_evidence")))
        .withColumn("_first", strip(F.get("_parts", 0))).withColumn("_n", F.size("_parts")).drop("_parts")
    )

    def look_up(f: Column) -> Column:
        """The file's length, the first line with the evidence where it is needed, and the line the finding names."""
        total = F.size("lines")
        out = (f["_s"] < 1) | (f["_e"] > total) | (f["_s"] > f["_e"])
        at = F.array_position(F.transform("lines", lambda x: x.contains(f["_first"])), True).cast("int")
        usable = F.char_length(f["_evidence"]) >= MIN_EVIDENCE_CHARS
        located = F.when(out & usable, F.nullif(at, F.lit(0)))
        own = lambda a: strip(F.coalesce(F.get("lines", F.when(~out, f["_s"]).otherwise(F.coalesce(a, F.greatest(F.lit(1), F.least(f["_s"], total)))) - 1), F.lit("")))
        return bind(located, lambda a: f.withField("_total", total).withField("_out", out).withField("_at", a).withField("_own", own(a)))

    joined = line_ops.at_files(named, files, ["lines"], look_up)
    s, e, total, out = F.col("_s"), F.col("_e"), F.col("_total"), F.col("_out")
    clamped = F.greatest(F.lit(1), F.least(s, total))
    start = F.when(~out, s).when(F.col("_at").isNotNull(), F.col("_at")).otherwise(clamped)
    end = (
        F.when(~out, e).when(F.col("_at").isNotNull(), F.col("_at") + F.col("_n") - 1)
        .otherwise(F.greatest(clamped, F.least(e, total)))
    )
    joined = joined.withColumn("start", start.cast("int")).withColumn("end", end.cast("int"))
    own_line = F.col("_own")
    change = F.when(F.col("suggested_change").isNotNull(), F.nullif(redact_secrets(clean("suggested_change")), F.lit("")))
    return joined.select(
        "review_id", "finding_no",
        redact_secrets(clean("title")).alias("title"), coerce(F.col("category"), CATEGORIES, "maintainability").alias("category"),
        coerce(F.col("severity"), SEVERITIES, "medium").alias("severity"), coerce(F.col("confidence"), CONFIDENCES, "medium").alias("confidence"),
        "repo", "path", F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.lit(None).cast("string").alias("entity_name"),
        redact_secrets(clean("problem")).alias("problem"),
        redact_secrets(F.when(F.col("_evidence") != "", F.col("_evidence")).otherwise(own_line)).alias("evidence"),
        redact_secrets(F.coalesce(F.nullif(clean("recommendation"), F.lit("")), F.lit(DEFAULT_ADVICE))).alias("recommendation"),
        change.alias("suggested_change"), F.lit("ai_review").alias("source"), (~out | F.col("_at").isNotNull()).alias("is_verified"),
    )


def focus(findings: DataFrame, wanted: str | None) -> DataFrame:
    """Findings of one category; ``bugs`` means correctness, ``all`` or nothing keeps every one."""
    if not wanted or wanted.lower() == "all":
        return findings
    name = "correctness" if wanted.lower() == "bugs" else wanted.lower()
    return findings.filter(F.col("category") == name)


def merge(static: DataFrame, outside: DataFrame) -> DataFrame:
    """Both kinds of findings, one per (file, line, title); static analysis wins. Sorted by severity, then line."""
    both = static.select(*REVIEW, F.lit(0).alias("_p")).unionByName(outside.select(*REVIEW, F.lit(1).alias("_p")))
    title = F.lower(strip(F.col("title")))
    order = Window.partitionBy("repo", "path", "start_line", title).orderBy("_p", "severity", "problem", "end_line")
    kept = both.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1).drop("_r", "_p")
    return kept.orderBy("repo", "path", quality.severity_rank(F.col("severity"), SEVERITIES), "start_line", "title")


def summary(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Per repository: totals by source, severity and category, and the lines reviewed."""
    counted = findings.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_findings"), F.count_if(F.col("source") == "static_analysis").alias("deterministic_count"),
        F.count_if(F.col("source") == "ai_review").alias("ai_count"),
        *[F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in SEVERITIES],
        *[F.count_if(F.col("category") == c).alias(f"category_{c}") for c in CATEGORIES],
    )
    lines = files.groupBy("repo").agg(F.sum(F.greatest(F.lit(1), F.size("lines"))).alias("lines_reviewed"))
    return lines.join(counted, "repo", "left").na.fill(0)


def executive_summary(totals: DataFrame) -> DataFrame:
    """One sentence per repository from :func:`summary`."""
    present = F.array_compact(F.array(*[F.when(F.col(f"category_{c}") > 0, F.lit(c)) for c in CATEGORIES]))
    areas = F.when(F.size(present) > 0, F.array_join(F.slice(present, 1, 3), ", ")).otherwise(F.lit("code quality"))
    return totals.select(
        "repo",
        F.when(F.col("total_findings") == 0, F.concat(F.lit("Review of `"), "repo", F.lit("` found nothing to report.")))
        .otherwise(F.concat(
            F.lit("Review of `"), "repo", F.lit("` identified "), F.col("total_findings").cast("string"),
            F.lit(" actionable findings across "), areas, F.lit(", "), F.col("severity_critical").cast("string"),
            F.lit(" critical and "), F.col("severity_high").cast("string"), F.lit(" high."),
        )).alias("executive_summary"),
    )
