"""Incremental vector index: micro-batches of vectors upserted by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.sources.vectors import upsert_vectors


def upsert_batch(location: str):
    """``foreachBatch`` function. The batch id is the version, so a batch replayed after a failure changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        upsert_vectors(batch.withColumn("version", F.lit(batch_id + 1).cast("long")), location)

    return write


def start_index(vectors: DataFrame, location: str, checkpoint: str) -> StreamingQuery:
    """Upsert a stream of vectors (``collection, chunk_id, embedding, model, dimension, entity_type``) into a table."""
    return (
        vectors.writeStream.foreachBatch(upsert_batch(location))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
