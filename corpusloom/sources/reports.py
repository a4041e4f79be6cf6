"""Report sink: one nested record per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import paths
from corpusloom.operators import stats


def repo_reports(files: DataFrame, largest: int = 5) -> DataFrame:
    """``(repo, report)`` where report is JSON with totals, histograms and the largest files.

    Only aggregates are nested: histograms have one entry per extension and the file list is cut to ``largest``.
    """
    totals = stats.corpus_totals(files)
    top = stats.largest_files(files, largest)

    def nested(hist: DataFrame, key: str, name: str) -> DataFrame:
        entry = F.struct((-F.col("n")).alias("o"), F.col(key).alias("key"), F.col("n").alias("count"))
        return hist.groupBy("repo").agg(
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["key"], e["count"])).alias(name)
        )

    extensions = stats.histogram(files, paths.extension_key(F.col("path")), "ext", ("repo",))
    languages = stats.histogram(files, paths.detect_language(F.col("path")), "language", ("repo",))
    files_top = top.groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct("rank", "path", "size_bytes"))).alias("largest_files")
    )
    joined = (
        totals.join(nested(extensions, "ext", "file_extensions"), "repo", "left")
        .join(nested(languages, "language", "languages"), "repo", "left")
        .join(files_top, "repo", "left")
    )
    return joined.select("repo", F.to_json(F.struct(*[c for c in joined.columns if c != "repo"])).alias("report"))


def write_reports(reports: DataFrame, location: str) -> None:
    reports.write.mode("overwrite").parquet(location)
