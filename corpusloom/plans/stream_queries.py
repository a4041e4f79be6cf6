"""Streaming queries over the driver tables, run to the end of their input, and the batch history."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.plans import bindings as b
from corpusloom.plans.log_queries import traces
from corpusloom.plans.registry import query
from corpusloom.session import shared_folder
from corpusloom.sources import vectors as sink
from corpusloom.streaming import history, index, logs


def _work_dir(spark) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _in_parts(df, folder, parts):
    """Write ``df`` as one file per part, in order, and stream it a file per micro-batch."""
    for part in parts:
        df.filter(part).coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _stream(spark, sf, name):
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("latest_n_history", "STM2", """
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events QUALIFY rank <= 5""")
def latest_n_history(spark, sf):
    events = b.table(spark, sf, "events").select("user_id", "event_id", "ts")
    return history.latest_per_key(events, "user_id", "ts", "event_id", 5).select("user_id", "event_id", "rank")


@query("latest_n_overall", "STM2", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def latest_n_overall(spark, sf):
    return history.latest(b.table(spark, sf, "events"), "ts", "event_id").select("event_id", "event_type")


_VECTOR_SCHEMA = "collection string, chunk_id string, embedding array<float>, model string, dimension int, entity_type string, version bigint"


@query("stream_index", "STM1 SNK1 SNK3", f"""
WITH {b.VECTORS_SQL}, w AS (
  SELECT collection, chunk_id, CASE WHEN vec_id % 5 = 0 THEN -embedding[1] ELSE embedding[1] END AS first, CASE WHEN vec_id % 5 = 0 THEN 4 ELSE vec_id % 3 + 1 END AS version FROM vectors)
SELECT collection, chunk_id, round(CAST(first AS DOUBLE), 5) AS first, CAST(version AS BIGINT) AS version FROM w""")
def stream_index(spark, sf):
    """Four micro-batches, the last of which writes every fifth vector again with flipped sign, and that one replayed."""
    folder, v = _work_dir(spark), b.vectors(spark, sf)
    flipped = v.filter("vec_id % 5 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn("part", F.lit(3))
    sent = v.withColumn("part", (F.col("vec_id") % 3).cast("int")).unionByName(flipped).drop("version", "vec_id")
    vectors = _in_parts(sent, f"{folder}/in", [f"part = {k}" for k in range(4)]).drop("part")
    index.start_index(vectors, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    index.upsert_batch(f"{folder}/table")(sent.filter("part = 3").drop("part"), 3)
    table = sink.read_vectors(spark, f"{folder}/table", _VECTOR_SCHEMA)
    return table.select("collection", "chunk_id", F.round(F.get("embedding", 0).cast("double"), 5).alias("first"), "version")


@query("stream_traces", "STM3 STR4 STR6 EXT10", """
SELECT event_id AS trace_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n_frames,
  CASE event_id % 4 WHEN 0 THEN 'KeyError' WHEN 1 THEN 'TypeError' END AS error_type FROM events WHERE event_type = 'error'""")
def stream_traces(spark, sf):
    folder = _work_dir(spark)
    events = _stream(spark, sf, "events")
    logs.start_traces(traces(spark, sf, events), f"{folder}/traces", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/traces").select("trace_id", F.size("frames").alias("n_frames"), "error_type")


# Half of all events belong to one key.
_EVENTS_SQL = """ev AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'hot' ELSE CAST(user_id AS VARCHAR) END AS key, event_id, ts, event_id // 2 % 3 AS part FROM events)"""


def _history(spark, sf):
    """Updates of three micro-batches of events, as ``(key, record_id, position, evicted, batch)``."""
    folder, e = _work_dir(spark), F.col("event_id")
    events = b.table(spark, sf, "events").select(
        F.when(e % 2 == 0, F.lit("hot")).otherwise(F.col("user_id").cast("string")).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        e.alias("record_id"), (F.floor(e / 2) % 3).cast("int").alias("part"),
    )
    spark.conf.set(*history.STATE_STORE)

    def write(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    # a part is written by all tasks and read by all; the stream goes on from its checkpoint, so a part is one micro-batch
    for k in range(3):
        events.filter(F.col("part") == k).write.mode("append").parquet(f"{folder}/in")
        updates = history.stream_latest(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), 5)
        updates.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(
            availableNow=True
        ).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("key", "record_id", "position", "evicted", "batch")


@query("stream_history", "STM2", f"""
WITH {_EVENTS_SQL}
SELECT key, event_id AS record_id, CAST(row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS INTEGER) AS position
FROM ev QUALIFY position <= 5""")
def stream_history(spark, sf):
    # Each batch restates the keys it changed; the newest statement of a key counts.
    rows = _history(spark, sf).filter("NOT evicted")
    newest = rows.groupBy("key").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["key", "batch"], "left_semi").select("key", "record_id", "position")


@query("stream_evictions", "STM2", f"""
WITH {_EVENTS_SQL}, held AS (
  SELECT b, key, event_id FROM ev, (VALUES (0), (1), (2)) t(b) WHERE part <= b
  QUALIFY row_number() OVER (PARTITION BY b, key ORDER BY ts DESC, event_id DESC) <= 5)
SELECT h.key, h.event_id AS record_id, CAST(h.b + 1 AS INTEGER) AS batch
FROM held h LEFT JOIN held n ON n.b = h.b + 1 AND n.key = h.key AND n.event_id = h.event_id WHERE h.b < 2 AND n.key IS NULL""")
def stream_evictions(spark, sf):
    """Which records of earlier micro-batches a key lets go, and when."""
    return _history(spark, sf).filter("evicted").select("key", "record_id", F.col("batch").cast("int").alias("batch"))
