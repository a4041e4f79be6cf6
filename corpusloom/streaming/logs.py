"""Sanitising and trace extraction over a log stream: the batch column functions, appended per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.secrets import redact_secrets, sanitize_log
from corpusloom.operators.traces import parse_traces


def extract_traces(logs: DataFrame) -> DataFrame:
    """``logs`` carry the trace columns; text is sanitised and redacted before it is parsed. Stateless."""
    clean = logs.withColumn("text", redact_secrets(sanitize_log(F.col("text")), "debug"))
    return parse_traces(clean).select(
        "trace_id", "repo", "language", "error_type", "error_message", "frames", "file_paths", F.col("text").alias("log")
    )


def start_traces(logs: DataFrame, location: str, checkpoint: str) -> StreamingQuery:
    return (
        extract_traces(logs).writeStream.format("parquet").option("path", location).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
