"""Test logs and coverage reports to tables; one row per run in, no shuffle until rows are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import schemas
from corpusloom.functions import paths, text
from corpusloom.functions.rows import explode_rows
from corpusloom.functions.secrets import sanitize_log
from corpusloom.functions.text import strip

# Outcome lines, collection errors and missing modules of a test log.
OUTCOME = r"(?m)^([^\s]+::([^\s]+))\s+(PASSED|FAILED|SKIPPED|ERROR)"
COLLECTION_ERROR = r"(?:ERROR collecting|CollectionError:|ImportError:|ModuleNotFoundError:)\s*[^\n]+"
MISSING_MODULE = r"No module named\s+['\"]([^'\"]+)['\"]"
NO_TESTS = "Pytest collected 0 tests in the specified test file."
COUNTS = ("passed", "failed", "skipped", "errors")


def parse_runs(runs: DataFrame, root: str | None = None) -> DataFrame:
    """Add ``cases`` (array of name and status), the four counts, ``total``, ``warnings`` and ``status`` to each run.

    Counts come from the last summary line, else from the outcomes; a collection error counts once where nothing failed.
    """
    log = sanitize_log(F.concat(F.coalesce("stdout", F.lit("")), F.lit("\n"), F.coalesce("stderr", F.lit(""))), root)
    base = runs.withColumn("_log", log)
    names = F.regexp_extract_all("_log", F.lit(OUTCOME), F.lit(2))
    states = F.regexp_extract_all("_log", F.lit(OUTCOME), F.lit(3))
    cases = F.transform(
        F.arrays_zip(names.alias("name"), states.alias("status")),
        lambda z: F.struct(z["name"].alias("name"), F.lower(z["status"]).alias("status")),
    )
    footer = F.try_element_at(
        F.filter(
            F.transform(text.split_lines(F.col("_log")), strip),
            lambda x: x.startswith("=") & x.rlike("passed|failed|error|skipped"),
        ),
        F.lit(-1),
    )
    words = {"passed": "passed", "failed": "failed", "skipped": "skipped", "errors": "error"}
    collected = F.array_distinct(F.transform(F.regexp_extract_all("_log", F.lit(COLLECTION_ERROR), F.lit(0)), strip))
    module = F.nullif(F.regexp_extract("_log", MISSING_MODULE, 1), F.lit(""))
    base = base.withColumn("cases", cases).withColumn("_footer", footer).withColumn("_collected", collected).withColumn("_module", module)

    def count(word: str) -> Column:
        stated = F.coalesce(F.regexp_extract("_footer", r"(\d+)\s+" + word, 1).try_cast("int"), F.lit(0))
        return F.when(F.col("_footer").isNotNull(), stated).otherwise(F.size(F.filter("cases", lambda c: c["status"] == word)))

    for name, word in words.items():
        base = base.withColumn(name, count(word))
    base = base.withColumn(
        "errors",
        F.when((F.size("_collected") > 0) & (F.col("errors") == 0) & (F.col("failed") == 0), F.lit(1)).otherwise(F.col("errors")),
    )
    total = F.col("passed") + F.col("failed") + F.col("skipped") + F.col("errors")
    total = F.when((total == 0) & (F.size("cases") > 0), F.size("cases")).otherwise(total)
    base = base.withColumn("total", total)
    no_tests = (F.col("exit_code") == 5) & (F.col("total") == 0)
    crashed = (F.col("exit_code") != 0) & (F.col("exit_code") != 5) & (F.col("total") == 0)
    dependency = F.concat(
        F.lit("Missing dependency '"), F.col("_module"), F.lit("': packages outside the base runner are not installed.")
    )
    warnings = F.concat(
        "_collected", F.array_compact(F.array(F.when(F.col("_module").isNotNull(), dependency), F.when(no_tests, F.lit(NO_TESTS))))
    )
    base = (
        base.withColumn("warnings", warnings)
        .withColumn("errors", F.when(crashed, F.lit(1)).otherwise(F.col("errors")))
        .withColumn("total", F.when(crashed, F.col("errors")).otherwise(F.col("total")))
    )
    return base.withColumn("status", run_status()).drop("_log", "_footer", "_collected", "_module")


def run_status() -> Column:
    """Timed out, failed to start, completed (failed tests included), failed."""
    return (
        F.when(F.coalesce("timed_out", F.lit(False)), F.lit("timed_out"))
        .when(F.coalesce("error", F.lit("")) != "", F.lit("failed_to_start"))
        .when((F.col("exit_code") == 0) | (F.col("failed") > 0), F.lit("completed"))
        .otherwise(F.lit("failed"))
    )


def cases(parsed: DataFrame) -> DataFrame:
    return explode_rows(parsed, "cases", "c", "run_id").select("run_id", "c.name", "c.status")


def outcome_totals(rows: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Outcomes per key by status word."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(status) == s).alias(n) for n, s in zip(COUNTS, ("passed", "failed", "skipped", "error"))],
    )


def parse_coverage(reports: DataFrame, root: str | None = None) -> DataFrame:
    """Per report ``is_available``, ``reason``, totals and ``files`` (array) from ``(run_id, json)``.

    Test files and installed packages are left out; totals of the report win over sums.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    schema = schemas.COVERAGE_JSON.simpleString()[len("struct<"):-1] + ",_broken:string"
    doc = strip(F.col("json"))
    base = reports.withColumn("_d", F.from_json(doc, f"struct<{schema}>", options))
    d = F.col("_d")
    empty = (F.coalesce(F.size(d["files"]), F.lit(0)) <= 0) & d["totals"].isNull()
    reason = (
        F.when(F.col("json").isNull(), F.lit("Coverage file was not generated by pytest-cov or was removed."))
        .when(doc == "", F.lit("Coverage report file was empty."))
        .when(d.isNull() | d["_broken"].isNotNull(), F.lit("Failed to parse coverage data"))
        .when(empty, F.lit("Coverage data contained no tracked files or totals."))
    )
    zero = F.lit(0).cast("long")
    files = F.filter(
        F.transform(
            F.map_entries(d["files"]),
            lambda e: F.struct(
                paths.coverage_path(e["key"], root).alias("file_path"),
                F.coalesce(e["value"]["summary"]["num_statements"], zero).alias("total_statements"),
                F.coalesce(e["value"]["summary"]["covered_lines"], zero).alias("covered_statements"),
                F.coalesce(e["value"]["summary"]["missing_lines"], zero).alias("missing_statements"),
                F.bround(F.coalesce(e["value"]["summary"]["percent_covered"], F.lit(0.0)), 2).alias("coverage_percent"),
                F.transform(
                    F.filter(F.coalesce(e["value"]["missing_lines"], F.array().cast("array<string>")), lambda x: x.rlike(r"^\d+$")),
                    lambda x: x.cast("int"),
                ).alias("missing_lines"),
            ),
        ),
        lambda f: ~f["file_path"].startswith("test") & ~f["file_path"].contains("/site-packages/"),
    )
    base = base.withColumn("reason", reason).withColumn("files", F.when(F.col("reason").isNull(), files))

    def total(field: str, column: str) -> Column:
        summed = F.aggregate(F.coalesce("files", F.slice("files", 1, 0)), zero, lambda s, f: s + f[column])
        return F.coalesce(d["totals"][field], summed, zero)

    base = (
        base.withColumn("is_available", F.col("reason").isNull())
        .withColumn("total_statements", F.when(F.col("is_available"), total("num_statements", "total_statements")).otherwise(zero))
        .withColumn("covered_statements", F.when(F.col("is_available"), total("covered_lines", "covered_statements")).otherwise(zero))
        .withColumn("missing_statements", F.when(F.col("is_available"), total("missing_lines", "missing_statements")).otherwise(zero))
    )
    percent = F.when(
        F.col("total_statements") > 0, F.bround(F.col("covered_statements") / F.col("total_statements") * 100.0, 2)
    ).otherwise(F.lit(0.0))
    return base.withColumn("coverage_percent", percent).drop("_d")


def coverage_files(parsed: DataFrame) -> DataFrame:
    """File rows of each report with their ``position`` in it; with a ``target_file`` column its file comes first, then by path.

    The order is made inside a report's row; sort by ``run_id, position`` where rows are shown.
    """
    target = F.ltrim(strip(F.col("target_file")), F.lit("/")) if "target_file" in parsed.columns else F.lit(None).cast("string")
    placed = F.array_sort(F.transform("files", lambda f: F.struct(
        F.when(f["file_path"] == target, 0).otherwise(1).alias("later"), f["file_path"].alias("path"), f.alias("f"))))
    numbered = F.transform(placed, lambda x, i: F.struct((i + 1).cast("int").alias("position"), x["f"].alias("f")))
    return explode_rows(parsed, numbered, "x", "run_id").select("run_id", "x.position", "x.f.*")
