"""Line tables, line classification and duplicated blocks.

A file is one row holding its line array. Classification, normalising and block hashing work inside the row, so
they need no shuffle; only block hashes travel, and only to find equal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import text
from corpusloom.functions.rows import explode_rows, posexplode_rows
from corpusloom.functions.text import strip
from corpusloom.functions.vectors import bind
from corpusloom.session import stored

BRACE_LANGUAGES = ("javascript", "typescript", "c", "cpp", "csharp", "java", "go")
BLOCK_LINES = 6
SAMPLE_CHARS = 60
FALLBACK_CHUNK_LINES = 300


def explode_lines(files: DataFrame) -> DataFrame:
    """``(repo, path, line_no, line)`` with Python ``splitlines`` semantics; needs the ``lines`` array."""
    return posexplode_rows(files, "lines", "_pos", "line", "repo", "path").select(
        "repo", "path", (F.col("_pos") + 1).alias("line_no"), "line"
    )


def _count(line: Column, needle: str) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit(needle), F.lit("")))) / F.lit(len(needle))


def _fold(stripped: Column, step, is_open: bool = False) -> Column:
    """``struct<labels, open>``: one label letter per line, and whether a block comment is open behind the last."""
    return F.aggregate(
        stripped,
        F.struct(F.lit("").alias("labels"), F.lit(is_open).alias("open")),
        lambda s, line: F.when(
            line == "", F.struct(F.concat(s["labels"], F.lit("b")).alias("labels"), s["open"].alias("open"))
        ).otherwise(step(s, line)),
    )


def _fold_labels(stripped: Column, step) -> Column:
    return _fold(stripped, step)["labels"]


def _emit(s: Column, label: Column, is_open: Column) -> Column:
    return F.struct(F.concat(s["labels"], label).alias("labels"), is_open.alias("open"))


def _brace_step(s: Column, line: Column) -> Column:
    starts, closes = line.startswith("/*"), line.contains("*/")
    label = F.when(s["open"] | starts | line.startswith("//"), F.lit("m")).otherwise(F.lit("c"))
    return _emit(s, label, F.when(s["open"] | starts, ~closes).otherwise(F.lit(False)))


def _python_step(s: Column, line: Column) -> Column:
    triple, single = '"""', "'''"
    opens = line.startswith(triple) | line.startswith(single)
    toggles = (_count(line, triple) == 1) | (_count(line, single) == 1)
    closes = line.contains(triple) | line.contains(single)
    hash_line = line.startswith("#")
    label = F.when(hash_line | opens | s["open"], F.lit("m")).otherwise(F.lit("c"))
    is_open = (
        F.when(hash_line, s["open"])
        .when(opens, F.when(toggles, ~s["open"]).otherwise(s["open"]))
        .when(s["open"], ~closes)
        .otherwise(F.lit(False))
    )
    return _emit(s, label, is_open)


def line_labels(lines: Column, content: Column, language: Column) -> Column:
    """One letter per line: ``b`` blank, ``m`` comment, ``c`` code.

    The stateful fold runs only for files that hold a block-comment opener; all others are labelled line by line.
    """
    language = F.lower(F.coalesce(language, F.lit("")))
    stripped = F.transform(lines, strip)

    def plain(comment_prefixes: tuple[str, ...]) -> Column:
        def label(line: Column) -> Column:
            comment = F.lit(False)
            for prefix in comment_prefixes:
                comment = comment | line.startswith(prefix)
            return F.when(line == "", F.lit("b")).when(comment, F.lit("m")).otherwise(F.lit("c"))

        return F.array_join(F.transform(stripped, label), "")

    brace, python = language.isin(*BRACE_LANGUAGES), language == "python"
    return (
        F.when(brace & content.contains("/*"), _fold_labels(stripped, _brace_step))
        .when(brace, plain(("//",)))
        .when(python & (content.contains('"""') | content.contains("'''")), _fold_labels(stripped, _python_step))
        .when(python, plain(("#",)))
        .otherwise(plain(()))
    )


def classify_lines(files: DataFrame) -> DataFrame:
    """Add the ``labels`` string (needs ``lines``, ``content``, ``language``)."""
    return files.withColumn("labels", line_labels(F.col("lines"), F.col("content"), F.col("language")))


def chunk_labels(chunks: DataFrame) -> DataFrame:
    """``labels`` of the chunks ``(repo, path, language, chunk_no, lines)`` of files too large for one row.

    What a chunk does to the state of block comments is a function of two values: each is folded for a comment that is open
    before it and for none, both in the chunk's row. Only these functions, two flags a chunk, meet per file, where they are
    applied one after the other; each chunk then takes the labels of the state it begins with.
    """
    language = F.lower(F.coalesce("language", F.lit("")))
    stripped = F.transform("lines", strip)
    none = F.struct(F.array_join(F.transform(stripped, lambda x: F.when(x == "", F.lit("b")).otherwise(F.lit("c"))), "").alias("labels"), F.lit(False).alias("open"))

    def folded(is_open: bool) -> Column:
        return F.when(language.isin(*BRACE_LANGUAGES), _fold(stripped, _brace_step, is_open)).when(
            language == "python", _fold(stripped, _python_step, is_open)).otherwise(none)

    key = ["repo", "path", "chunk_no"]
    both = stored(chunks.select(*key, "language", folded(False).alias("shut"), folded(True).alias("open")), "chunk-labels")
    steps = both.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("chunk_no", F.col("shut.open").alias("shut"), F.col("open.open").alias("open")))).alias("steps"))
    begins = F.aggregate("steps", F.array(F.lit(False)), lambda s, f: F.concat(s, F.array(F.when(F.element_at(s, -1), f["open"]).otherwise(f["shut"]))))
    starts = steps.select("repo", "path", F.explode(F.arrays_zip(F.transform("steps", lambda f: f["chunk_no"]).alias("chunk_no"), F.slice(begins, F.lit(1), F.size("steps")).alias("open"))).alias("s"))
    starts = starts.select("repo", "path", "s.chunk_no", F.col("s.open").alias("_open"))
    return both.join(starts, key).select(*key, "language", F.when(F.col("_open"), F.col("open.labels")).otherwise(F.col("shut.labels")).alias("labels"))


def line_classes(files: DataFrame) -> DataFrame:
    """``(repo, path, line_no, line, kind)`` with kind blank, comment or code."""
    labelled = classify_lines(files)
    kinds = F.transform(
        F.filter(F.split(F.col("labels"), ""), lambda x: x != ""),
        lambda x: F.when(x == "b", F.lit("blank")).when(x == "m", F.lit("comment")).otherwise(F.lit("code")),
    )
    zipped = posexplode_rows(labelled, F.arrays_zip("lines", kinds.alias("kinds")), "_pos", "_l", "repo", "path")
    return zipped.select(
        "repo", "path", (F.col("_pos") + 1).alias("line_no"), F.col("_l")["lines"].alias("line"),
        F.col("_l")["kinds"].alias("kind"),
    )


def _counts() -> list[Column]:
    labels = F.col("labels")

    def count(letter: str) -> Column:
        return (F.length(labels) - F.length(F.replace(labels, F.lit(letter), F.lit("")))).cast("long")

    return [
        F.length(labels).cast("long").alias("total_lines"),
        count("c").alias("code_lines"),
        count("m").alias("comment_lines"),
        count("b").alias("blank_lines"),
    ]


def line_counts(files: DataFrame) -> DataFrame:
    """Per file total, code, comment and blank lines (one row in, one row out)."""
    return classify_lines(files).select("repo", "path", "language", *_counts())


def chunk_line_counts(chunks: DataFrame) -> DataFrame:
    """:func:`line_counts` of files that come in chunks."""
    counted = chunk_labels(chunks).select("repo", "path", "language", *_counts())
    return counted.groupBy("repo", "path", "language").agg(*[F.sum(c).alias(c) for c in ("total_lines", "code_lines", "comment_lines", "blank_lines")])


def in_chunks(files: DataFrame, size: int) -> DataFrame:
    """Files with ``lines`` as chunks of ``size`` lines."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / size).cast("int")), lambda i: F.struct(i.alias("no"), F.slice("lines", i * size + 1, F.lit(size)).alias("lines")))
    return explode_rows(files.filter(F.size("lines") > 0), parts, "c", "repo", "path", "language").select(
        "repo", "path", "language", F.col("c.no").alias("chunk_no"), F.col("c.lines").alias("lines"))


def line_count_rollup(counts: DataFrame) -> DataFrame:
    """Corpus, repository, language and file totals in one pass (null marks a rolled-up level)."""
    return counts.rollup("repo", "language", "path").agg(
        *[F.sum(c).alias(c) for c in ("total_lines", "code_lines", "comment_lines", "blank_lines")],
        F.grouping_id().cast("int").alias("level"),
    )


def normalized_lines(lines: Column) -> Column:
    """``array<struct<n, t>>``: stripped lines with their numbers, without blanks, lone brackets and comment lines."""
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), strip(x).alias("t")))
    return F.filter(
        numbered,
        lambda s: ~(
            s["t"].isin("", "{", "}", "(", ")", "[", "]", ";", ":")
            | s["t"].startswith("#") | s["t"].startswith("//") | s["t"].startswith("/*") | s["t"].startswith("*")
        ),
    )


def normalized_line_table(files: DataFrame) -> DataFrame:
    """``(repo, path, n, line_no, line)`` of the lines that count for duplicate detection."""
    exploded = posexplode_rows(files, normalized_lines(F.col("lines")), "_pos", "_s", "repo", "path")
    return exploded.select(
        "repo", "path", (F.col("_pos") + 1).alias("n"), F.col("_s")["n"].alias("line_no"), F.col("_s")["t"].alias("line")
    )


def _suppress_overlaps(windows: Column, block: int) -> Column:
    """Within a file keep a window only if every kept one with its hash starts at least ``block`` lines away.

    Kept windows older than ``block`` lines can no longer clash, so the fold carries at most ``block`` of them. It runs
    in slices of 256 windows, which keeps the cost of appending low for very long files, and only for files in which
    some hash repeats.
    """
    kind = "array<struct<h:string,s:int,e:int,sample:string>>"
    empty = F.array().cast(kind)

    def step(state: Column, w: Column) -> Column:
        recent = F.filter(state["recent"], lambda k: k["s"] > w["s"] - block)
        clash = F.exists(recent, lambda k: k["h"] == w["h"])
        return F.struct(
            F.when(clash, recent).otherwise(F.concat(recent, F.array(w))).alias("recent"),
            F.when(clash, state["out"]).otherwise(F.concat(state["out"], F.array(w))).alias("out"),
        )

    def slice_step(state: Column, first: Column) -> Column:
        part = F.aggregate(
            F.slice(windows, first, 256), F.struct(state["recent"].alias("recent"), empty.alias("out")), step
        )
        return F.struct(part["recent"].alias("recent"), F.concat(state["out"], part["out"]).alias("out"))

    folded = F.aggregate(
        F.sequence(F.lit(1), F.size(windows), F.lit(256)),
        F.struct(empty.alias("recent"), empty.alias("out")),
        slice_step,
    )["out"]
    repeats = F.size(F.array_distinct(F.transform(windows, lambda w: w["h"]))) < F.size(windows)
    return F.when(repeats, folded).otherwise(windows)


def block_occurrences(files: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """``(repo, path, block_hash, start_line, end_line, sample)`` of every ``block``-line window that is kept."""
    norm = F.col("_norm")
    windows = F.transform(
        F.sequence(F.lit(1), F.size(norm) - (block - 1)),
        lambda i: F.struct(
            F.substring(
                F.sha2(F.encode(F.array_join(F.transform(F.slice(norm, i, block), lambda s: s["t"]), "\n"), "UTF-8"), 256),
                1, 16,
            ).alias("h"),
            F.get(norm, i - 1)["n"].alias("s"),
            F.get(norm, i + (block - 2))["n"].alias("e"),
            F.substring(F.get(norm, i - 1)["t"], 1, SAMPLE_CHARS).alias("sample"),
        ),
    )
    hashed = files.select("repo", "path", normalized_lines(F.col("lines")).alias("_norm")).select(
        "repo", "path", F.when(F.size(norm) >= block, windows).alias("_w")
    )
    return explode_rows(hashed, _suppress_overlaps(F.col("_w"), block), "_b", "repo", "path").select(
        "repo", "path", F.col("_b")["h"].alias("block_hash"), F.col("_b")["s"].alias("start_line"),
        F.col("_b")["e"].alias("end_line"), F.col("_b")["sample"].alias("sample"),
    )


def duplicate_blocks(
    files: DataFrame, block: int = BLOCK_LINES, within_repo: bool = False, salts: int = 64
) -> DataFrame:
    """Every later occurrence of a block with the first one (by repo, path, line) as its original.

    Rank 1 is found by a two-level minimum and joined to the rest, never pair against pair. A hash as common as a
    licence header is spread over ``salts`` sub-keys on both sides, and the original is copied only to sub-keys in use.
    """
    key = ["repo", "block_hash"] if within_repo else ["block_hash"]
    # written once: the minima and the join below read hashes, not texts
    occurrences = stored(block_occurrences(files, block), "blocks").withColumn(
        "_salt", F.pmod(F.xxhash64("repo", "path", "start_line"), F.lit(salts)).cast("int")
    )
    place = F.struct("repo", "path", "start_line", "end_line")
    partial = occurrences.groupBy(*key, "_salt").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = (
        partial.groupBy(*key)
        .agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("_salt").alias("_salts"))
        .filter(F.col("n") >= 2)
        .select(*key, "first", F.explode("_salts").alias("_salt"))
    )
    joined = occurrences.join(first, [*key, "_salt"])
    return joined.filter(
        F.struct("repo", "path", "start_line") != F.struct("first.repo", "first.path", "first.start_line")
    ).select(
        "repo", "path", "start_line", "end_line",
        F.col("first.repo").alias("original_repo"),
        F.col("first.path").alias("original_path"),
        F.col("first.start_line").alias("original_start"),
        F.col("first.end_line").alias("original_end"),
        F.lit(block).alias("lines_count"),
        "sample", "block_hash",
    )


def fallback_chunks(files: DataFrame, max_lines: int = FALLBACK_CHUNK_LINES) -> DataFrame:
    """Module chunks of every non-empty file: all its lines, at most ``max_lines`` in each chunk."""
    from corpusloom.functions import paths

    name, start, end = paths.stem(F.col("path")), F.col("part.start"), F.col("part.end")
    kind = F.lit("file_module")
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    # only the chunk's own lines are carried by its row
    parts = bind(F.col("lines"), lambda rows: F.transform(
        F.sequence(F.lit(1), F.size(rows), F.lit(max_lines)),
        lambda at: F.struct(
            at.alias("start"), F.least(at + max_lines - 1, F.size(rows)).alias("end"),
            F.array_join(F.slice(rows, at, F.lit(max_lines)), "\n").alias("code"),
        ),
    ))
    filled = files.filter((F.col("content") != "") & (F.size("lines") > 0))
    code = F.col("part.code")
    return explode_rows(filled, parts, "part", "repo", "path", "language").select(
        "repo",
        text.chunk_id(F.col("repo"), F.col("path"), name, start, end).alias("chunk_id"),
        F.col("path").alias("file_path"),
        name.alias("entity_name"),
        kind.alias("entity_type"),
        F.col("language"),
        start.alias("start_line"),
        end.alias("end_line"),
        none.alias("signature"), none.alias("docstring"), none.alias("parent"),
        empty.alias("parameters"), none.alias("return_type"), empty.alias("decorators"), none.alias("visibility"),
        code.alias("code_content"),
        text.context_header(F.col("path"), name, kind, start, end).alias("context_header"),
        text.estimate_tokens(code).alias("tokens_estimate"),
    )


def at_files(targets: DataFrame, files: DataFrame, columns: list[str], look_up, most: int = 1000) -> DataFrame:
    """``look_up(target)`` for every row of ``targets`` (``repo, path, …``), inside the row of its file.

    The targets go to the files, not the files to the targets: those of a file become arrays, and each of its rows is read
    with ``columns`` of ``files`` at hand. So a file's lines are moved once, and not at all where the targets are few enough
    for Spark to broadcast them. A file with more than ``most`` targets comes in several rows, each with a part of them, and
    those go to several tasks. ``look_up`` gives a struct, whose fields are the result's columns beside ``repo`` and ``path``.
    """
    key = ["repo", "path"]
    fields = [c for c in targets.columns if c not in key]
    targets = stored(targets, "targets")
    rows = files.select(*key, *columns)
    hot = targets.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")).filter("_parts > 1")
    if hot.isEmpty():
        arrays = targets.groupBy(*key).agg(F.collect_list(F.struct(*fields)).alias("_targets"))
        joined = rows.join(arrays, key)
    else:
        hot = stored(hot, "hot-files")
        part = F.pmod(F.xxhash64(F.to_json(F.struct(*fields))), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part")
        spread = targets.join(hot, key, "left").select(*key, part, F.struct(*fields).alias("_t"))
        arrays = spread.groupBy(*key, "_part").agg(F.collect_list("_t").alias("_targets"))
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part")
        joined = rows.join(hot, key, "left").select(*rows.columns, copies).join(arrays, [*key, "_part"])
    return explode_rows(joined, F.transform("_targets", look_up), "_o", *key).select(*key, "_o.*")


def context_windows(targets: DataFrame, files: DataFrame, pad: int = 15, head: int = 50) -> DataFrame:
    """The numbered lines around each target ``(repo, path, target_line, …)``, cut in the row of its file."""
    def window(t: Column) -> Column:
        start, end = text.context_window(t["target_line"], F.size("lines"), pad, head)
        return bind(F.struct(start.alias("s"), end.alias("e")), lambda w: t.withField("start_line", w["s"]).withField("end_line", w["e"]).withField(
            "code_snippet", text.numbered_snippet(F.col("lines"), w["s"], w["e"])))

    return at_files(targets, files.filter(F.col("content") != ""), ["lines"], window)
