"""Thin queries over the driver tables: one per operator, with the contract's columns, and DuckDB oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import bpe, collocations, language_cnn, licenses, lsh_forest, media, oracles, packing, quality_net, quality_rules, secret_ledger, toxicity, url_reputation, variants
from corpusloom.llm.common import id_remainder, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


@query(oracles.url_filters())
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = url_reputation.document_outcomes(pages, table(spark, sf_dir, "labels"))
    return url_reputation.judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


@query(oracles.quality_rules())
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), "doc_id")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query(oracles.license_scans())
def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id").drop("places")


@query()
def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.stored_media(table(spark, sf_dir, "documents")))


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 4) == 2
    model = language_cnn.train(language_cnn.training_sample(docs, ~held_out))
    return language_cnn.predict(docs, model, "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model, "doc_id")
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "offending"
    )


@query()
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 4) == 2
    model = quality_net.fitted(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality_net.score(docs, model, "doc_id")
    predicted = F.when(F.col("score") >= quality_net.THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = bpe.encode(table(spark, sf_dir, "documents"), path, "doc_id")
    ids_sha256 = F.sha2("ids", 256).alias("ids_sha256")
    decoded = bpe.decode(tokens.select("doc_id", "n_tokens", ids_sha256, "ids"), path, "doc_id", "n_tokens", "ids_sha256")
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query(oracles.collocations_of(collocations.ORDER, collocations.MIN_COUNT, collocations.TOP))
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query(oracles.secret_scans())
def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"
    scanned = secret_ledger.scan(table(spark, sf_dir, "documents"), ledger, "doc_id")
    base = F.filter("findings", lambda x: x["kind"].isin(*secret_ledger.BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return scanned.select(
        "doc_id", *map(count, secret_ledger.BASE_KINDS), F.sha2(secret_ledger.digest(base), 256).alias("base_sha256"),
        secret_ledger.digest(F.col("findings")).alias("spans"),
    )


@query(oracles.spelling_variants())
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))
