"""Semantic and hybrid search over the unified hit schema, source selection, context packing and citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import vectors as vf
from corpusloom.functions.rows import explode_rows, posexplode_rows
from corpusloom.functions.text import citation_tags, strip as trimmed, title_case
from corpusloom.functions.vectors import bind
from corpusloom.operators import extract, lexical, vectors as vector_ops
from corpusloom.session import durable

RRF_K = 60
RRF_WEIGHT = 0.5
MIN_POOL = 20
CONTEXT_CHARS = 12_000
HELPER_SNIPPET_CHARS = 600
HELPER_BUDGET_CHARS = 8_000


def _fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def semantic_search(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Unified hits by cosine similarity; ``queries`` carry ``embedding`` and ``collection``.

    Only the k hits per query are joined back to the chunks for their metadata.
    """
    hits = vector_ops.cosine_top_k(queries, vectors, k).withColumn("score", vf.similarity_score(F.col("cosine")))
    distance = vf.cosine_distance(F.col("cosine"))
    meta = chunks.select("chunk_id", F.struct(*lexical._META).alias("meta"))
    m = F.col("meta")
    return hits.join(meta, "chunk_id").select(
        "query_id", "rank", "chunk_id", "score", F.lit("semantic").alias("search_mode"),
        F.array(
            F.concat(F.lit("Semantic similarity: "), _fixed(F.col("score"), 2)),
            F.concat(F.lit("Embedding cosine distance: "), _fixed(distance, 3)),
        ).alias("reasons"),
        F.concat(
            F.initcap(m["entity_type"]), F.lit(" '"), m["entity_name"], F.lit("' in "), m["file_path"],
            F.lit(" semantically aligns with query (similarity "), _fixed(F.col("score"), 2), F.lit(")."),
        ).alias("explanation"),
        "meta",
    )


def pool_size(limit: int) -> int:
    return max(MIN_POOL, 2 * limit)


def fuse(lexical_hits: DataFrame, semantic_hits: DataFrame, limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of two cut pools, decided per query.

    A query with hits on one side only keeps that side's order and scores. Ties of the fused score keep lexical order,
    then semantic order. Every group here is at most two pools of one query.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(
            "query_id", "chunk_id", *[F.col(c).alias(f"{p}_{c}") for c in ("rank", "score", "reasons", "explanation", "meta")]
        )

    both = side(lexical_hits, "l").join(side(semantic_hits, "s"), ["query_id", "chunk_id"], "full")
    per_query = Window.partitionBy("query_id")
    counted = both.withColumn("n_l", F.count("l_rank").over(per_query)).withColumn("n_s", F.count("s_rank").over(per_query))
    part = lambda c: F.coalesce(F.lit(RRF_WEIGHT) / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    mixed = (F.col("n_l") > 0) & (F.col("n_s") > 0)
    mode = (
        F.when(mixed, F.lit("hybrid")).when(F.col("n_l") > 0, F.lit("hybrid (lexical-only)"))
        .otherwise(F.lit("hybrid (semantic-only)"))
    )
    place = F.coalesce(F.col("l_rank"), F.lit(1_000_000) + F.col("s_rank"))
    empty = F.array().cast("array<string>")
    scored = counted.select(
        "query_id", "chunk_id", place.alias("place"), mode.alias("search_mode"),
        F.when(mixed, part("l_rank") + part("s_rank")).otherwise(F.lit(0.0)).alias("rrf"),
        F.when(mixed, F.bround(part("l_rank") + part("s_rank"), 5)).otherwise(F.coalesce("l_score", "s_score")).alias("score"),
        F.concat(F.coalesce("l_reasons", empty), F.coalesce("s_reasons", empty)).alias("reasons"),
        F.when(
            F.col("l_rank").isNotNull() & F.col("s_rank").isNotNull(),
            F.concat(
                "l_explanation", F.lit(" Also matches semantically (similarity "), _fixed(F.col("s_score"), 2), F.lit(").")
            ),
        ).otherwise(F.coalesce("l_explanation", "s_explanation")).alias("explanation"),
        F.coalesce("l_meta", "s_meta").alias("meta"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "place")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(
        "query_id", "rank", "chunk_id", "score", "search_mode", "reasons", "explanation", "meta"
    )


def search(
    mode: str, queries: DataFrame, chunks: DataFrame | lexical.Index, vectors: DataFrame | None = None, k: int = 10
) -> DataFrame:
    """Lexical, semantic or hybrid search with one output schema. ``chunks``: a chunk table, or its lexical index."""
    mode, table = (mode or "hybrid").lower().strip(), chunks.chunks if isinstance(chunks, lexical.Index) else chunks
    if mode == "lexical":
        return lexical.lexical_search(queries, chunks, k)
    if mode == "semantic":
        return semantic_search(queries, vectors, table, k)
    pool = pool_size(k)
    return fuse(lexical.lexical_search(queries, chunks, pool), semantic_search(queries, vectors, table, pool), k)


def select_sources(hits: DataFrame, k: int = 5) -> DataFrame:
    """First hit per (query, repository, file, lines), the k best of them, labelled S1..Sk; ``hits`` were cut to 2k."""
    place = Window.partitionBy("query_id", "meta.repo", "meta.file_path", "meta.start_line", "meta.end_line").orderBy("rank")
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        hits.withColumn("_r", F.row_number().over(place))
        .filter(F.col("_r") == 1)
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= k)
        .select(
            "query_id", F.concat(F.lit("S"), F.col("_n").cast("string")).alias("source_id"), F.col("_n").alias("source_no"),
            "chunk_id", "meta.repo", "meta.file_path", "meta.start_line", "meta.end_line", "meta.entity_name", "meta.entity_type",
            "meta.language", "meta.signature", F.bround("score", 4).alias("score"),
        )
    )


def source_block(code: Column) -> Column:
    """One source as a delimited text block."""
    language = F.coalesce("language", F.lit("text"))
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("SOURCE ["), F.col("source_id"), F.lit("]")),
        F.concat(
            F.lit("File: "), "file_path", F.lit(" (Lines "), F.col("start_line").cast("string"), F.lit("-"),
            F.col("end_line").cast("string"), F.lit(")"),
        ),
        F.concat(F.lit("Entity: "), "entity_type", F.lit(" "), "entity_name"),
        F.concat(F.lit("Language: "), language),
        F.concat(F.lit("Signature: "), F.nullif("signature", F.lit(""))),
    )
    return F.concat(
        F.lit("--- BEGIN "), "source_id", F.lit(" ---\n"), header, F.lit("\n\n```"), F.lower(language), F.lit("\n"), code,
        F.lit("\n```\n--- END "), "source_id", F.lit(" ---"),
    )


def pack_context(sources: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Blocks in source order until the budget is passed; the first block always fits, the first overflow ends it.

    ``sources`` carry ``block``. Lengths are never negative, so a running sum stops at the first overflow. The groups
    are one query's few labelled sources.
    """
    running = Window.partitionBy("query_id").orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    kept = sources.withColumn("_sum", F.sum(F.char_length("block")).over(running)).filter(
        (F.col("source_no") == 1) | (F.col("_sum") <= budget)
    )
    entry = F.struct("source_no", "source_id", "block")
    packed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_b"), F.max("_sum").alias("chars"))
    return packed.select(
        "query_id",
        F.transform("_b", lambda x: x["source_id"]).alias("source_ids"),
        F.array_join(F.transform("_b", lambda x: x["block"]), "\n\n").alias("context"),
        "chars",
    )


def target_contexts(files: DataFrame, max_snippet: int = HELPER_SNIPPET_CHARS, budget: int = HELPER_BUDGET_CHARS) -> DataFrame:
    """``(repo, path, name, parent, start_line, helper_snippets, used_chars)`` of every function and method of the Python files.

    The helpers of a target are the other functions at the top of its file, in order, packed as by :func:`pack_helpers`;
    all within the file's row of ``extract.with_declarations``.
    """
    items = extract.declaration_items(F.col("lines"), F.col("decls"))
    code = lambda d: trimmed(F.concat_ws("\n", d["header"], F.nullif(d["body"], F.lit(""))))
    function = lambda d: d["kind"] != "class"

    def context(d: Column, functions: Column) -> Column:
        start = F.struct(F.length(code(d)).alias("used"), F.array().cast("array<string>").alias("kept"))
        others = F.filter(functions, lambda f: f["name"] != d["name"])
        packed = F.aggregate(others, start, lambda s, f: F.when(
            (F.length(f["code"]) < max_snippet) & (s["used"] + F.length(f["code"]) < budget),
            F.struct((s["used"] + F.length(f["code"])).alias("used"), F.concat(s["kept"], F.array(f["code"])).alias("kept"))).otherwise(s))
        return bind(packed, lambda p: F.struct(
            d["name"].alias("name"), F.when(d["outer_kind"] == "class", d["outer_name"]).alias("parent"), d["n"].alias("start_line"),
            p["kept"].alias("helper_snippets"), p["used"].alias("used_chars")))

    def of_file(ds: Column) -> Column:
        top = F.transform(F.filter(ds, lambda d: function(d) & (d["ind"] == 0)), lambda d: F.struct(d["name"].alias("name"), code(d).alias("code")))
        targets = F.filter(ds, lambda d: function(d) & ((d["ind"] == 0) | (d["outer_kind"] == "class")))
        return bind(top, lambda functions: F.transform(targets, lambda d: context(d, functions)))

    python = files.filter(F.col("language") == "Python")
    return explode_rows(python, bind(items, of_file), "t", "repo", "path").select("repo", "path", "t.*")


def pack_helpers(helpers: DataFrame, max_snippet: int = HELPER_SNIPPET_CHARS, budget: int = HELPER_BUDGET_CHARS) -> DataFrame:
    """Greedy packing that skips a snippet that does not fit and goes on with the next.

    ``helpers`` is one row per target: ``base_chars`` and ``snippets``, the ordered snippets of its file.
    """
    folded = F.aggregate(
        "snippets",
        F.struct(F.col("base_chars").cast("int").alias("used"), F.array().cast("array<string>").alias("kept")),
        lambda s, x: F.when(
            (F.char_length(x) < max_snippet) & (s["used"] + F.char_length(x) < budget),
            F.struct((s["used"] + F.char_length(x)).alias("used"), F.concat(s["kept"], F.array(x)).alias("kept")),
        ).otherwise(s),
    )
    return helpers.withColumn("_f", folded).withColumn("helper_snippets", F.col("_f.kept")).withColumn(
        "used_chars", F.col("_f.used")
    ).drop("_f", "snippets")


def validate_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``(answer_id, citation_no, source_id, …)``: known tags in order of first mention, else all sources.

    ``sources`` carry ``answer_id, source_id, source_no``; unknown tags drop out in the join.
    """
    tags = (
        posexplode_rows(answers, citation_tags(F.col("text")), "pos", "source_id", "answer_id")
        .groupBy("answer_id", "source_id")
        .agg(F.min("pos").alias("pos"))
    )
    matched = sources.join(tags, ["answer_id", "source_id"], "left")
    # One row per source: whether the answer cited any of its own sources decides the fallback.
    cited = Window.partitionBy("answer_id")
    chosen = matched.withColumn("_any", F.count("pos").over(cited)).filter(F.col("pos").isNotNull() | (F.col("_any") == 0))
    order = Window.partitionBy("answer_id").orderBy(F.coalesce("pos", "source_no"), "source_no")
    return chosen.join(answers.select("answer_id"), "answer_id", "left_semi").withColumn(
        "citation_no", F.row_number().over(order)
    ).drop("pos", "_any")


def answer_questions(
    questions: DataFrame, chunks: lexical.Index, vectors: DataFrame, generate: Callable[[DataFrame], DataFrame],
    k: int = 5, budget: int = CONTEXT_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """Retrieve, pack, generate and check citations for a table of questions: ``(answers, citations)``.

    ``chunks``: the lexical index of the chunk table. ``generate`` maps ``(query_id, prompt)`` to ``(query_id, answer, warning)``.
    The sources are written once, for the prompts and for the citations.
    """
    hits = search("hybrid", questions, chunks, vectors, 2 * k)
    sources = durable(select_sources(hits, k))
    code = lexical.rows_of_hits(chunks.chunks.select("chunk_id", "code_content"), sources, "chunk_id")
    blocks = sources.join(code, "chunk_id").withColumn("block", source_block(F.col("code_content"))).drop("code_content")
    context = pack_context(blocks, budget)
    prompts = questions.select("query_id", "text").join(context, "query_id", "left").select(
        "query_id",
        F.concat(
            F.lit("Question: "), "text", F.lit("\n\nSources:\n\n"), F.coalesce("context", F.lit("None found."))
        ).alias("prompt"),
    )
    answers = generate(prompts)
    cited = validate_citations(
        answers.select(F.col("query_id").alias("answer_id"), F.col("answer").alias("text")),
        sources.withColumnRenamed("query_id", "answer_id"),
    )
    return answers, cited
