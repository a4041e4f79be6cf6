"""Import resolution to dependency edges, the structure map and the code-base summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import paths
from corpusloom.operators import extract

SALTS = 8


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], salt_by: list[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join to a table that is unique per key, with hot left keys spread over ``salts`` copies of the right side."""
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*keys, "_salt"], how).drop("_salt")


def module_index(files: DataFrame) -> DataFrame:
    """``(repo, key, target)``: dotted Python names, paths, and extension-less paths; the first path wins a clash."""
    path = F.col("path")
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    dotted = F.translate(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    python = F.col("language") == "Python"
    keys = F.array_compact(
        F.array(
            F.concat(F.lit("path:"), path),
            F.concat(F.lit("bare:"), bare),
            F.when(python, F.concat(F.lit("py:"), dotted)),
            F.when(python & dotted.endswith(".__init__"), F.concat(F.lit("py:"), F.regexp_replace(dotted, r"\.__init__$", ""))),
        )
    )
    return files.select("repo", "path", F.explode(keys).alias("key")).groupBy("repo", "key").agg(F.min("path").alias("target"))


def normalize_relative(directory: Column, target: Column) -> Column:
    """``directory/target`` with ``.`` and ``..`` segments resolved."""
    joined = F.filter(F.split(F.concat_ws("/", F.nullif(directory, F.lit("")), target), "/"), lambda p: ~p.isin("", "."))
    stack = F.aggregate(
        joined,
        F.array().cast("array<string>"),
        lambda s, p: F.when(
            (p == "..") & (F.size(s) > 0) & (F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("")) != ".."),
            F.slice(s, 1, F.size(s) - 1),
        ).otherwise(F.concat(s, F.array(p))),
    )
    return F.array_join(stack, "/")


def import_candidates(imports: DataFrame) -> DataFrame:
    """Add ``candidates``: the index keys an import may resolve to, best first."""
    module, directory = F.col("module"), paths.parent_dir(F.col("path"))
    parts = F.split(module, r"\.")
    prefixes = F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
        lambda i: F.concat(F.lit("py:"), F.array_join(F.slice(parts, 1, i), ".")),
    )
    relative = F.concat_ws(
        "/", F.nullif(directory, F.lit("")), F.nullif(F.translate(module, ".", "/"), F.lit(""))
    )
    python_relative = F.array(
        F.concat(F.lit("path:"), relative, F.lit(".py")), F.concat(F.lit("path:"), relative, F.lit("/__init__.py"))
    )
    clean = normalize_relative(directory, module)
    script = F.array(F.concat(F.lit("bare:"), clean), F.concat(F.lit("bare:"), clean, F.lit("/index")))
    none = F.array().cast("array<string>")
    return imports.withColumn(
        "candidates",
        F.when((F.col("language") == "Python") & F.col("is_relative"), python_relative)
        .when(F.col("language") == "Python", prefixes)
        .when(F.col("is_relative"), script)
        .otherwise(none),
    )


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Dependency edges: the first candidate that exists in the repository is the target; the rest is external.

    Longest prefix and ordered fallback are one equi-join on exploded candidates, never a ``LIKE`` join.
    """
    key = ["repo", "path", "module", "imported_names", "line_number"]
    exploded = import_candidates(imports).select(*key, F.posexplode_outer("candidates").alias("priority", "key"))
    joined = salted_join(exploded, module_index(files), ["repo", "key"], ["path", "line_number"])
    return (
        joined.groupBy(*key)
        .agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("priority"))).alias("resolved_target_file"))
        .select(
            "repo", F.col("path").alias("source_file"), F.col("module").alias("target_module"),
            F.col("imported_names").alias("imported_symbols"), "line_number", "resolved_target_file",
            F.col("resolved_target_file").isNotNull().alias("is_internal"),
        )
    )


def codebase_summary(files: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Files by language, entities by kind, imports and rejects per repository.

    Entities and imports are counted inside the row of their file, from ``extract.with_declarations``, so the files are read
    once and only counts leave a row. ``rejects`` may be left out where ``files`` holds them, too, flagged by
    ``sources.corpus.with_problem``: then they are read, scanned and parsed once for both.
    """
    python = F.col("language") == "Python"

    def count(kept) -> Column:
        return F.size(F.filter("decls", kept)).cast("bigint")

    top = lambda d: ~python | (d["ind"] == 0)
    function = lambda d: F.when(python, (d["kind"] != "class") & (d["ind"] == 0)).otherwise(d["kind"].isin("function", "arrow"))
    method = lambda d: F.when(python, (d["kind"] != "class") & (d["outer_kind"] == "class") & (d["outer_ind"] == 0)).otherwise(d["kind"] == "method")
    found = F.transform(extract.import_statements(F.col("lines"), F.col("labels")), lambda r: F.greatest(F.size(extract.imported(r["x"], F.col("language"))), F.lit(0)))
    kinds = {
        "classes": count(lambda d: (d["kind"] == "class") & top(d)), "functions": count(function), "methods": count(method),
        "interfaces": count(lambda d: d["kind"] == "interface"), "types": count(lambda d: d["kind"] == "type_alias"),
        "imports": F.aggregate(found, F.lit(0), lambda s, n: s + n).cast("bigint"),
    }
    accepted = F.lit(True) if rejects is not None else F.col("_problem").isNull()
    counted = files.select("repo", "language", accepted.alias("_accepted"), *[c.alias(name) for name, c in kinds.items()])
    by_file = counted.groupBy("repo").agg(
        F.count_if("_accepted").alias("files_analyzed"),
        *[F.count_if((F.col("language") == n) & F.col("_accepted")).alias(n.lower() + "_files") for n in ("Python", "JavaScript", "TypeScript")],
        *[F.sum(F.when(F.col("_accepted"), F.col(name))).alias(name) for name in kinds],
        F.count_if(~F.col("_accepted")).alias("files_with_errors"),
    )
    if rejects is None:
        return by_file.filter("files_analyzed > 0").na.fill(0)
    by_reject = rejects.groupBy("repo").agg(F.count(F.lit(1)).alias("files_with_errors"))
    return by_file.drop("files_with_errors").join(by_reject, "repo", "left").na.fill(0)


def structure_map(files: DataFrame, entities: DataFrame, docstring_chars: int = 100) -> DataFrame:
    """Adjacency rows file, class, method, interface, type and function of each file in display order."""
    doc = F.col("docstring")
    short = F.when(F.char_length(doc) > docstring_chars, F.concat(F.left(doc, F.lit(docstring_chars)), F.lit("..."))).otherwise(doc)
    span = F.concat(F.lit("L"), F.col("start_line").cast("string"), F.lit("-L"), F.col("end_line").cast("string"))
    none = F.lit(None).cast("string")
    file_nodes = files.select(
        "repo", F.col("path").alias("file_path"), F.col("path").alias("node_path"), paths.base_name(F.col("path")).alias("name"),
        F.lit("file").alias("node_type"), F.lit(0).alias("depth"), F.lit(0).alias("kind_rank"), F.lit("").alias("sort_name"),
        F.lit(0).alias("sort_line"), F.concat(F.size("lines").cast("string"), F.lit(" lines")).alias("line_info"), none.alias("docstring"),
    )
    kind = F.col("type")
    rank = F.when(kind.isin("class", "method"), 1).when(kind == "interface", 2).when(kind == "type_alias", 3).otherwise(4)
    member = kind == "method"
    nodes = entities.filter(kind != "variable").select(
        "repo", F.col("path").alias("file_path"),
        F.concat_ws("::", "path", F.when(member, F.col("parent")), "name").alias("node_path"), "name", kind.alias("node_type"),
        F.when(member, 2).otherwise(1).alias("depth"), rank.alias("kind_rank"),
        F.when(member, F.lower("parent")).when(kind == "class", F.lower("name")).otherwise(F.lit("")).alias("sort_name"),
        F.when(kind == "class", 0).otherwise(F.col("start_line")).alias("sort_line"), span.alias("line_info"),
        F.when(kind.isin("class", "method", "function"), short).alias("docstring"),
    )
    return file_nodes.unionByName(nodes)


def display_order() -> list[Column]:
    """Sort columns of :func:`structure_map`: file, kind, class name, then line."""
    return [F.col(c) for c in ("repo", "file_path", "kind_rank", "sort_name", "sort_line", "node_path")]
