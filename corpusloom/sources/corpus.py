"""Corpus source: files to rows, pruning, size gate, decoding and the reject table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import paths, syntax, text
from corpusloom.sources import tree

MAX_FILE_BYTES = 1024 * 1024


def read_corpus(
    spark: SparkSession, location: str, repo: str | None = None, profile: str = "scan", max_bytes: int | None = MAX_FILE_BYTES,
    extensions: tuple[str, ...] = (), partition_bytes: int = tree.PARTITION_BYTES,
) -> DataFrame:
    """Files below ``location`` as ``(repo, path, size_bytes, raw)``.

    Directories that ``profile`` ignores are not entered; ignored files, other ``extensions`` and files over ``max_bytes``
    (``None``: no bound) are listed but not read, and :func:`oversized` gives the last. ``repo`` names a single repository;
    without it the first path segment below ``location`` is the repository. Filters on ``repo`` and ``size_bytes`` reach the
    listing.
    """
    return _tree(spark, location, repo, profile, extensions, maxBytes=max_bytes, partitionBytes=partition_bytes)


def oversized(
    spark: SparkSession, location: str, repo: str | None = None, max_bytes: int = MAX_FILE_BYTES, extensions: tuple[str, ...] = (),
    profile: str = "scan",
) -> DataFrame:
    """``(repo, path, size_bytes, skip_reason)`` of the files that :func:`read_corpus` leaves out for their size, from a
    listing that opens none."""
    files = _tree(spark, location, repo, profile, extensions, overBytes=max_bytes, content="false")
    return files.drop("raw").withColumn("skip_reason", F.lit("too_large"))


def _tree(spark: SparkSession, location: str, repo: str | None, profile: str, extensions: tuple[str, ...], **options) -> DataFrame:
    spark.dataSource.register(tree.CorpusFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    given = {"path": location, "repo": repo, "profile": profile, "extensions": ",".join(extensions), **options}
    return spark.read.format("corpus_files").options(**{k: str(v) for k, v in given.items() if v not in (None, "")}).load()


def read_corpus_table(spark: SparkSession, location: str) -> DataFrame:
    """A corpus already kept as parquet (``repo, path, size_bytes, content``)."""
    return spark.read.parquet(location)


def prune(files: DataFrame, profile: str = "scan") -> DataFrame:
    """Drop files in ignored directories and files with ignored extensions."""
    return files.filter(~paths.in_ignored_dir(F.col("path"), profile) & ~paths.is_ignored_file(F.col("path")))


def with_skip_reason(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, skip_empty: bool = False) -> DataFrame:
    """Flag, not drop: ``skip_reason`` is null for kept files."""
    reason = F.when(F.col("size_bytes") > max_bytes, F.lit("too_large"))
    if skip_empty:
        reason = reason.when(F.col("size_bytes") == 0, F.lit("empty"))
    return files.withColumn("skip_reason", reason)


def kept(files: DataFrame) -> DataFrame:
    return files.filter(F.col("skip_reason").isNull()).drop("skip_reason")


def decode(raw: Column, fallback: str = "latin1") -> Column:
    """Bytes to text: UTF-8, else Latin-1 (``latin1``) or replacement characters (``replace``)."""
    if fallback == "latin1":
        return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
    if fallback == "replace":
        return F.make_valid_utf8(raw.cast("string"))
    raise ValueError(f"unknown fallback {fallback!r}")


def with_problem(files: DataFrame) -> DataFrame:
    """Flag, not drop: ``_problem`` of a code file that cannot be parsed, null for the others."""
    return files.withColumn("_problem", syntax.parse_problem(F.col("content"), paths.parseable_language(F.col("path"))))


def split_rejects(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejects)`` of code files; rejects are ``repo, path, language, error_type, message`` and processing goes on."""
    language = paths.parseable_language(F.col("path"))
    checked = with_problem(files)
    accepted = checked.filter(F.col("_problem").isNull()).drop("_problem")
    rejects = checked.filter(F.col("_problem").isNotNull()).select(
        "repo", "path", language.alias("language"), "_problem.error_type", "_problem.message")
    return accepted, rejects


def code_files(files: DataFrame) -> DataFrame:
    """Files whose extension is analysed as code, with their language."""
    return files.withColumn("language", paths.parseable_language(F.col("path"))).filter(F.col("language").isNotNull())


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", paths.detect_language(F.col("path")))


def with_lines(files: DataFrame) -> DataFrame:
    """Add the line array; later steps slice it, so a file's lines never leave their row unless they must."""
    return files.withColumn("lines", text.split_lines(F.col("content")))
