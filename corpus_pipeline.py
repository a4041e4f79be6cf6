"""Training-data pipeline over ``documents``: quality rules, quality classifier, near-duplicates, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the last return the columns
of ``docs`` as they came, further ones included, and only drop rows. Empty tables give empty tables; rows with null ids or
texts are judged like others (a null text counts as empty, so the quality rules drop it).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions.rows import where_computed
from corpusloom.llm import lsh_forest, packing, quality_net, quality_rules
from corpusloom.llm.common import id_remainder, stored, table

#: No oracle: SQL can express neither the classifier nor the packing. tests/llm checks the stages against brute force.
ORACLE_SQL = None
#: Keys of rejected rows up to this size are broadcast.
MAX_KEY_BYTES = 64 << 20


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near a language reference of these documents."""
    # a verdict depends on text and language; between counting and judging only this key of a row is kept, not its text
    said = [F.col("doc_id"), F.col("text"), F.col("lang")]
    keyed = docs.select(F.struct("*").alias("row_"), "text", "lang", F.xxhash64(*said).alias("key_"), F.xxhash64(F.lit(1), *said).alias("more_"))
    judged = quality_rules.judge(keyed, "key_", "more_")
    rejected = stored(where_computed(judged, ~F.col("kept")).select("key_", "more_").distinct(), "quality-rejected")
    # two longs a row: small keys go to the tasks, so that no text is moved; many are joined by a shuffle
    small = rejected.count() * 16 <= MAX_KEY_BYTES
    return keyed.join(F.broadcast(rejected) if small else rejected, ["key_", "more_"], "left_anti").select("row_.*")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least 0.7; the model learns from those of them whose id's crc32 mod 4 is not 2.

    Where these have labels of one class only, all documents get its value: all stay, or, without a good one, none.
    """
    model = quality_net.fitted(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 4) != 2)
    whole = docs.select(F.struct("*").alias("row_"), "text")
    return quality_net.score(whole, model, "row_").filter(F.col("score") >= quality_net.THRESHOLD).select("row_.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group whose five-word shingle sets are similar to 0.8 or more."""
    judged = lsh_forest.near_duplicates(docs)
    return docs.join(judged.filter(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; what passes between stages is written to the shared folder as Parquet."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
