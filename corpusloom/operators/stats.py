"""Corpus totals, histograms, largest files and tree listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import paths

MAX_TREE_DEPTH = 4
MAX_TREE_CHILDREN = 50
MAX_OUTLINE_LINES = 60


def corpus_totals(files: DataFrame) -> DataFrame:
    """Files, directories and bytes per repository."""
    totals = files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("size_bytes").alias("total_size_bytes")
    )
    folders = (
        files.select("repo", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
        .distinct()
        .groupBy("repo")
        .agg(F.count(F.lit(1)).alias("total_directories"))
    )
    return totals.join(folders, "repo", "left").select(
        "repo", "total_files", F.coalesce("total_directories", F.lit(0)).alias("total_directories"), "total_size_bytes"
    )


def histogram(df: DataFrame, key: Column, name: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Counts of a key, largest first (null keys are left out)."""
    return (
        df.withColumn(name, key)
        .filter(F.col(name).isNotNull())
        .groupBy(*scope, name)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*scope, F.desc("n"), name)
    )


def largest_files(files: DataFrame, n: int = 5) -> DataFrame:
    """The n largest files per repository; the rank limit is applied before the shuffle."""
    order = Window.partitionBy("repo").orderBy(F.desc("size_bytes"), "path")
    return (
        files.select("repo", "path", "size_bytes")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


def directory_rollup(files: DataFrame) -> DataFrame:
    """Files and bytes below every directory, at any depth."""
    exploded = files.select("repo", "size_bytes", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    return (
        exploded.groupBy("repo", "dir")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("bytes"))
        .withColumn("depth", F.size(F.split("dir", "/")))
        .withColumn("parent_dir", paths.parent_dir(F.col("dir")))
    )


def tree_nodes(files: DataFrame) -> DataFrame:
    """Adjacency rows ``(repo, path, parent_path, name, node_type, depth, size_bytes)`` of directories and files."""
    leaves = files.select(
        "repo", "path", paths.parent_dir(F.col("path")).alias("parent_path"), F.lit("file").alias("node_type"), "size_bytes"
    )
    folders = (
        files.select("repo", F.explode(paths.ancestors(F.col("path"))).alias("path"))
        .distinct()
        .select(
            "repo", "path", paths.parent_dir(F.col("path")).alias("parent_path"), F.lit("directory").alias("node_type"),
            F.lit(None).cast("long").alias("size_bytes"),
        )
    )
    return (
        folders.unionByName(leaves)
        .withColumn("name", paths.base_name(F.col("path")))
        .withColumn("depth", F.size(F.split("path", "/")))
    )


def tree_listing(
    files: DataFrame, max_depth: int = MAX_TREE_DEPTH, max_children: int = MAX_TREE_CHILDREN
) -> DataFrame:
    """At most ``max_children`` directories and files per directory, to ``max_depth``; a cut directory hides its subtree."""
    order = Window.partitionBy("repo", "parent_path", "node_type").orderBy(F.lower("name"), "name")
    nodes = tree_nodes(files).filter(F.col("depth") <= max_depth)
    kept = nodes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_children)
    kept_dirs = kept.filter(F.col("node_type") == "directory").select("repo", F.col("path").alias("_dir"))
    # A node is visible when all its ancestors were kept: count those that match and compare with its depth.
    wanted = kept.select("repo", "path", "node_type", F.explode(paths.ancestors(F.col("path"))).alias("_dir"))
    hidden = wanted.join(kept_dirs, ["repo", "_dir"], "left_anti").select("repo", "path", "node_type").distinct()
    return kept.join(hidden, ["repo", "path", "node_type"], "left_anti").select(
        "repo", "path", "parent_path", "name", "node_type", "depth", "rank", "size_bytes"
    )


def _sort_name(node_type: Column, name: Column) -> Column:
    flag = F.when(node_type == "directory", F.lit("0")).otherwise(F.lit("1"))
    return F.concat(flag, F.lower(name), F.lit("\x01"), name)


def tree_outline(
    files: DataFrame, max_depth: int = 3, max_lines: int = MAX_OUTLINE_LINES
) -> DataFrame:
    """Text outline per repository in display order, cut after ``max_lines`` with a marker per unfinished level.

    The cut comes first (a ranked limit per repository); branch glyphs are then worked out for the kept lines only.
    """
    nodes = tree_nodes(prune_docs(files)).filter(F.col("depth") <= max_depth + 1)
    parts = F.split(F.col("path"), "/")
    sort_path = F.array_join(
        F.transform(
            parts,
            lambda p, i: F.concat(
                F.when((i + 1 == F.size(parts)) & (F.col("node_type") == "file"), F.lit("1")).otherwise(F.lit("0")),
                F.lower(p), F.lit("\x01"), p,
            ),
        ),
        "\x02",
    )
    order = Window.partitionBy("repo").orderBy("sort_path")
    top = (
        nodes.select("repo", "path", "name", "node_type", "depth", sort_path.alias("sort_path"))
        .withColumn("line_no", F.row_number().over(order))
        .filter(F.col("line_no") <= max_lines)
    )
    last = nodes.groupBy("repo", "parent_path").agg(
        F.max_by(F.struct("path", "node_type"), _sort_name(F.col("node_type"), F.col("name"))).alias("last")
    ).select("repo", F.col("last.path").alias("_chain"), F.lit(True).alias("_is_last"))
    chain = top.withColumn("_chain", F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))))
    flags = (
        chain.join(last, ["repo", "_chain"], "left")
        .groupBy("repo", "path", "name", "node_type", "depth", "line_no")
        .agg(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct(F.length("_chain").alias("d"), F.coalesce("_is_last", F.lit(False)).alias("last"))
                    )
                ),
                lambda s: s["last"],
            ).alias("last")
        )
    )

    def indent(upto: Column) -> Column:
        return F.array_join(
            F.transform(
                F.slice("last", 1, upto), lambda x: F.when(x, F.lit("    ")).otherwise(F.lit("│   "))
            ),
            "",
        )

    glyph = F.when(F.element_at("last", -1), F.lit("└── ")).otherwise(F.lit("├── "))
    slash = F.when(F.col("node_type") == "directory", F.lit("/")).otherwise(F.lit(""))
    lines = flags.select(
        "repo", "line_no", F.lit(0).alias("sub_no"), F.concat(indent(F.col("depth") - 1), glyph, "name", slash).alias("line")
    )
    markers = (
        flags.filter(F.col("line_no") == max_lines)
        .withColumn("_level", F.explode(F.sequence(F.col("depth"), F.lit(1), F.lit(-1))))
        .filter(~F.element_at("last", F.col("_level")))
        .select(
            "repo", "line_no", (F.col("depth") - F.col("_level") + 1).alias("sub_no"),
            F.concat(indent(F.col("_level") - 1), F.lit("└── ... (truncated)")).alias("line"),
        )
    )
    return lines.unionByName(markers)


def prune_docs(files: DataFrame) -> DataFrame:
    return files.filter(~paths.in_ignored_dir(F.col("path"), "docs"))


def scan_stats(files: DataFrame) -> DataFrame:
    """Discovered, analysed and skipped files per repository (needs ``skip_reason``)."""
    return files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files_discovered"),
        F.count_if(F.col("skip_reason").isNull()).alias("files_analyzed"),
        F.count_if(F.col("skip_reason").isNotNull()).alias("files_skipped"),
    )
