"""Documentation evidence: sectioned Markdown, evidence records and reference texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import text
from corpusloom.functions.rows import explode_rows
from corpusloom.functions.text import strip

MAX_ROUTES, MAX_SYMBOLS, MAX_ENV_VARS = 40, 50, 25
LISTED_SYMBOLS, REFERENCE_SYMBOLS = 20, 25
DEFAULT_TITLE = "Technical Documentation"


def markdown_outline(docs: DataFrame, column: str = "text") -> DataFrame:
    """Add ``title``, ``summary`` and ``sections`` (array of title and content) of a Markdown text, in the row itself."""
    rows = text.split_lines(strip(F.col(column)))
    stripped = F.transform("_rows", strip)
    is_h1 = F.transform(stripped, lambda x: x.startswith("# "))
    h1 = F.array_position(is_h1, True).cast("int")
    after = F.slice(stripped, F.col("_h1") + 1, F.size("_rows"))
    heading = F.array_position(F.transform(after, lambda x: x.startswith("#")), True).cast("int")
    intro = F.filter(F.when(heading > 0, F.slice(after, 1, heading - 1)).otherwise(after), lambda x: x != "")
    marks = F.filter(
        F.transform(stripped, lambda x, i: F.when(x.startswith("## "), (i + 1).cast("int"))), lambda i: i.isNotNull()
    )
    sections = F.transform(
        "_marks",
        lambda m, i: F.struct(
            (i + 1).cast("int").alias("section_no"),
            strip(F.substr(strip(F.get("_rows", m - 1)), F.lit(4))).alias("title"),
            strip(F.array_join(
                F.slice("_rows", m + 1, F.coalesce(F.get("_marks", i + 1), F.size("_rows") + 1) - m - 1), "\n"
            )).alias("content"),
        ),
    )
    summary = F.when(F.col("_h1") > 0, F.left(F.array_join(F.slice(intro, 1, 3), " "), F.lit(350))).otherwise(F.lit(""))
    first = strip(F.replace(F.left(F.get("sections", 0)["content"], F.lit(250)), F.lit("\n"), F.lit(" ")))
    return (
        docs.withColumn("_rows", rows)
        .withColumn("_h1", h1)
        .withColumn("_marks", marks)
        .withColumn(
            "title",
            F.when(F.col("_h1") > 0, strip(F.substr(strip(F.get("_rows", F.col("_h1") - 1)), F.lit(3)))).otherwise(F.lit(DEFAULT_TITLE)),
        )
        .withColumn("sections", sections)
        .withColumn("_s", summary)
        .withColumn(
            "summary",
            F.coalesce(
                F.nullif("_s", F.lit("")), F.nullif(first, F.lit("")),
                F.concat(F.lit("Technical documentation covering "), "title", F.lit(".")),
            ),
        )
        .drop("_rows", "_h1", "_marks", "_s")
    )


def markdown_sections(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``(key, section_no, title, content)``."""
    return explode_rows(markdown_outline(docs, column), "sections", "s", key).select(key, "s.*")


def _ranked(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Rows numbered per repository, all or the first ``limit``; a limit applies before the shuffle, so hot repositories stay small."""
    w = Window.partitionBy("repo").orderBy(*order)
    numbered = df.withColumn("_n", F.row_number().over(w))
    return numbered if limit is None else numbered.filter(F.col("_n") <= limit)


def _first(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


def _listed(df: DataFrame, item: Column, name: str) -> DataFrame:
    return df.groupBy("repo").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", item.alias("item")))), lambda x: x["item"]).alias(name)
    )


def evidence(
    repos: DataFrame, routes: DataFrame, symbols: DataFrame, env_vars: DataFrame, manifests: DataFrame | None = None,
    max_routes: int | None = None, max_symbols: int | None = None, max_env_vars: int | None = None,
) -> DataFrame:
    """One record per repository: lists of routes, symbols and variables, and the number of files they come from.

    Lists are whole unless bounds are given; :func:`evidence_rows` gives the same as rows, for repositories too large for
    one record. Files with a route or a symbol, and the manifests, are counted.
    """
    cut_routes = _ranked(routes, [F.col("file_path"), F.col("line_number")], max_routes)
    cut_symbols = _ranked(symbols, [F.col("file_path"), F.col("start_line"), F.col("name")], max_symbols)
    cut_vars = _ranked(env_vars, [F.col("name")], max_env_vars)
    used = routes.select("repo", "file_path").unionByName(symbols.select("repo", "file_path"))
    if manifests is not None:
        used = used.unionByName(manifests.select("repo", F.col("path").alias("file_path")))
    sources = used.distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("source_files"))
    return (
        repos.select("repo").distinct()
        .join(_listed(cut_routes, F.struct("method", "route", "handler_name", "file_path", "line_number"), "routes"), "repo", "left")
        .join(_listed(cut_symbols, F.struct("name", "symbol_type", "file_path", "start_line", "signature", "docstring"), "symbols"), "repo", "left")
        .join(_listed(cut_vars, F.col("name"), "environment_vars"), "repo", "left")
        .join(sources, "repo", "left")
    )


def evidence_rows(routes: DataFrame, symbols: DataFrame, env_vars: DataFrame) -> DataFrame:
    """All evidence as rows ``(repo, kind, rank, item, n)``: ``n`` is how many of the kind the repository has.

    A rank is a row's number within its file plus those of the files before it, so only counts by file, or variable, of a repository meet in one task.
    """
    place = lambda line: F.concat(F.lit(" "), "file_path", F.lit(":"), F.col(line).cast("string"))
    rows = (
        routes.select("repo", F.lit("route").alias("kind"), F.col("file_path").alias("at"), F.col("line_number").alias("line"),
                      F.concat("method", F.lit(" "), "route", F.lit(" "), "handler_name", place("line_number")).alias("item"))
        .unionByName(symbols.select("repo", F.lit("symbol").alias("kind"), F.col("file_path").alias("at"), F.col("start_line").alias("line"),
                                    F.concat("symbol_type", F.lit(" "), "name", place("start_line")).alias("item")))
        .unionByName(env_vars.select("repo", F.lit("variable").alias("kind"), F.col("name").alias("at"), F.lit(0).alias("line"), F.col("name").alias("item")))
    )
    key = ["repo", "kind"]
    files = rows.groupBy(*key, "at").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*key).orderBy("at")) - F.col("_c")
    files = files.select(*key, "at", before.alias("_before"), F.sum("_c").over(Window.partitionBy(*key)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*key, "at").orderBy("line", "item"))
    return rows.withColumn("_i", inside).join(files, [*key, "at"]).select(*key, (F.col("_before") + F.col("_i")).alias("rank"), "item", "n")


def source_files_used(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """The files behind the evidence as rows (``repo, file_path``), since their number has no bound."""
    return routes.select("repo", "file_path").unionByName(symbols.select("repo", "file_path")).distinct()


def api_reference(record: DataFrame, max_symbols: int | None = None) -> DataFrame:
    """Reference text of the routes of an evidence record; a symbol list, whole or of ``max_symbols``, where it has none."""
    repo = F.col("repo")
    head = F.concat(F.lit("# "), repo, F.lit(" — API Reference\n\n"))
    blocks = F.transform(
        F.coalesce("routes", F.array()),
        lambda r: F.concat(
            F.lit("## `"), r["method"], F.lit(" "), r["route"], F.lit("`\n\n- **Handler**: `"), r["handler_name"],
            F.lit("()`\n- **Location**: `"), r["file_path"], F.lit(":"), r["line_number"].cast("string"), F.lit("`\n"),
        ),
    )
    listed = F.transform(
        _first(F.coalesce("symbols", F.array()), max_symbols),
        lambda x: F.concat(F.lit("- `"), x["symbol_type"], F.lit("` `"), x["name"], F.lit("` in `"), x["file_path"], F.lit("`")),
    )
    return record.select(
        "repo",
        F.when(
            F.size(F.coalesce("routes", F.array())) > 0,
            F.concat(head, F.lit("Endpoints found in `"), repo, F.lit("`.\n\n"), F.array_join(blocks, "\n")),
        ).otherwise(
            F.concat(head, F.lit("No routes were found in `"), repo, F.lit("`.\n\n## Discovered Code Symbols\n\n"), F.array_join(listed, "\n"))
        ).alias("document"),
    )


def function_reference(record: DataFrame, target: str | None = None, max_symbols: int | None = None) -> DataFrame:
    """Reference text of the symbols of an evidence record, or of those whose name holds ``target``; at most ``max_symbols`` of these."""
    repo, symbols = F.col("repo"), F.coalesce("symbols", F.array())
    chosen = F.filter(symbols, lambda x: x["name"].contains(target)) if target else symbols
    blocks = F.transform(
        _first(chosen, max_symbols),
        lambda x: F.concat(
            F.lit("## `"), x["name"], F.lit("`\n\n- **Type**: `"), x["symbol_type"], F.lit("`\n- **Defined in**: `"), x["file_path"],
            F.lit(":"), x["start_line"].cast("string"), F.lit("`\n- **Signature**: `"), F.coalesce(x["signature"], x["name"]),
            F.lit("`\n\n### Description\n\n"), F.coalesce(x["docstring"], F.lit("No docstring provided in source.")), F.lit("\n"),
        ),
    )
    head = F.concat(F.lit("# "), repo, F.lit(" — Function Reference\n\n"))
    return record.select(
        "repo",
        F.when(F.size(chosen) > 0, F.concat(head, F.array_join(blocks, "\n")))
        .otherwise(F.concat(head, F.lit(f"No symbol matches '{target or 'all'}'.\n"))).alias("document"),
    )
