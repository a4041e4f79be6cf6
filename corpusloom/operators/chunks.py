"""Search chunks: one per entity, and one module chunk for files without entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import text
from corpusloom.functions.rows import where_computed
from corpusloom.operators import extract, lines


def entity_chunks(entities: DataFrame) -> DataFrame:
    c = F.col
    return entities.select(
        "repo",
        text.chunk_id(c("repo"), c("path"), c("name"), c("start_line"), c("end_line"), c("parent")).alias("chunk_id"),
        c("path").alias("file_path"), c("name").alias("entity_name"), c("type").alias("entity_type"), "language", "start_line",
        "end_line", "signature", "docstring", "parent", "parameters", "return_type", "decorators", "visibility",
        c("code").alias("code_content"),
        text.context_header(
            c("path"), c("name"), c("type"), c("start_line"), c("end_line"), c("parent"), c("signature")
        ).alias("context_header"),
        text.estimate_tokens(c("code")).alias("tokens_estimate"),
    )


def chunk_corpus(files: DataFrame) -> DataFrame:
    """Chunks of files from ``extract.with_declarations``."""
    bare = where_computed(files, ~extract.has_entities(files))
    return entity_chunks(extract.entities(files)).unionByName(lines.fallback_chunks(bare))
