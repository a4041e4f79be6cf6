"""Seams for user models: an embedder and a text generator, run in Arrow batches on the executors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

UNAVAILABLE = "text generation was unavailable; a template answer is shown"


class Embedder(Protocol):
    """A model: its name, its dimension and texts to vectors. One instance is unpickled per Python worker."""

    name: str
    dimension: int

    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """The repeatable hash embedding as a pluggable model (the Column form is ``functions.vectors.hash_embedding``)."""

    def __init__(self, dimension: int = 384, name: str = "hash"):
        self.dimension, self.name = dimension, name

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        blocks = -(-self.dimension // 32)
        rows = []
        for text in texts:
            raw = text.encode("utf-8")
            digest = b"".join(hashlib.sha256(raw + n.to_bytes(4, "big")).digest() for n in range(blocks))
            vector = np.frombuffer(digest, dtype=np.uint8)[: self.dimension] / 127.5 - 1.0
            length = np.linalg.norm(vector)
            rows.append((vector / length if length > 0 else vector).tolist())
        return rows


def embed_column(df: DataFrame, column: str, model: Embedder) -> DataFrame:
    """Add ``embedding``, ``model`` and ``dimension``. The batch size is the session's Arrow batch size.

    A batch whose vectors do not match the batch or the dimension fails the task, which Spark retries.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = model.embed_texts(texts.fillna("").tolist())
            if len(vectors) != len(texts) or any(len(v) != model.dimension for v in vectors):
                raise ValueError(f"model {model.name} returned vectors of another count or dimension")
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vectors], dtype="object")

    return (
        df.withColumn("embedding", embed(F.col(column)))
        .withColumn("model", F.lit(model.name))
        .withColumn("dimension", F.lit(model.dimension))
    )


def generate_column(df: DataFrame, key: str, column: str, generate: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """``(key, answer, warning)`` from a batch generator; a failed or empty answer becomes a template and a warning."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                texts = generate(batch[column].tolist())
            except Exception:
                texts = [None] * len(batch)
            yield pd.DataFrame({key: batch[key], "raw": texts})

    raw = df.select(key, column).mapInPandas(run, f"{key} {kind}, raw string")
    missing = F.coalesce(F.col("raw"), F.lit("")) == ""
    return raw.select(
        key,
        F.when(missing, F.lit("No generated answer is available; see the cited sources.")).otherwise(F.col("raw")).alias("answer"),
        F.when(missing, F.lit(UNAVAILABLE)).alias("warning"),
    )


def template_generator(prompts: DataFrame) -> DataFrame:
    """Generator without a model: a fixed sentence citing the first packed source, on JVM columns only."""
    cited = F.regexp_extract("prompt", r"--- BEGIN (S\d+) ---", 1)
    return prompts.select(
        "query_id",
        F.when(cited == "", F.lit("No matching source was found."))
        .otherwise(F.concat(F.lit("The most relevant source is ["), cited, F.lit("].")))
        .alias("answer"),
        F.when(cited == "", F.lit(UNAVAILABLE)).alias("warning"),
    )
