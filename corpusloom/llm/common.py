"""Shared helpers of the training-data operators: tables, byte-wise lower case, folds, lineage cuts, bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: A word between white space characters.
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets a folder of its own, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new Parquet folder under the shared one and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Texts longer than this stay out of training samples, which bounds a sample's bytes; they are scored whole like all others.
MAX_SAMPLE_CHARS = 100_000


def class_sample(docs: DataFrame, labels: DataFrame, target: str, learn: Column, max_rows: int) -> list[tuple[str, int]]:
    """``(text, label)`` of at most ``max_rows`` labelled rows of ``docs``, by hash of the id, the same at every run.

    Only ids that ``docs`` holds with a text to learn from count towards the bound; their ids are joined before the cut. Half
    of the bound is reserved for either class, and what one class leaves free the other fills, so a rare class is taken
    whole up to ``max_rows / 2``. Rows that repeat an id with the same text count once.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(F.length("text") <= MAX_SAMPLE_CHARS)
    labelled = (
        labels.select(F.col("doc_id"), F.col(target).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .filter(learn)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .join(texts.select("doc_id"), "doc_id", "left_semi")
    )
    labelled = stored(labelled, "labelled")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # of each class its first rows at most leave the tasks
    classes = [labelled.filter(F.col("label") == k).orderBy(*order).limit(max_rows).collect() for k in (0, 1)]
    n = [len(c) for c in classes]
    take = [min(n[k], max(max_rows // 2, max_rows - n[1 - k])) for k in (0, 1)]
    wanted = [(r.doc_id, r.label) for c, k in zip(classes, take) for r in c[:k]]
    if not wanted:
        return []
    chosen = docs.sparkSession.createDataFrame(wanted, labelled.schema)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").distinct().toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return list(zip(rows["text"].to_pylist(), rows["label"].to_pylist()))


def score_texts(docs: DataFrame, keep: list[str], scorer, schema: str) -> DataFrame:
    """``keep`` columns and, per row, what ``scorer()`` gives for its text (null: empty).

    ``scorer()`` is called once per task and returns a function from a list of texts to a list of Arrow arrays, one per
    column of ``schema``. Texts are handed over in slices of bounded size, so a task holds one Arrow batch and its scores.
    """
    import pyarrow as pa

    kept = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    added = T.StructType.fromDDL(schema).fields
    names, n = [*keep, *(f.name for f in added)], len(keep)

    def run(batches):
        score = scorer()
        for batch in batches:
            texts, start = batch.column(n), 0
            while start < batch.num_rows:
                stop = slice_end(texts, start)
                columns = [batch.column(i).slice(start, stop - start) for i in range(n)]
                yield pa.RecordBatch.from_arrays(columns + score(texts.slice(start, stop - start).to_pylist()), names=names)
                start = stop

    return kept.mapInArrow(run, T.StructType(kept.schema.fields[:-1] + added))


def slice_end(texts, start: int, max_rows: int = 512, max_chars: int = 1 << 20) -> int:
    """End of the slice from ``start`` with at most ``max_rows`` texts, and one text or at most ``max_chars`` bytes."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(texts.slice(start, max_rows)).to_pylist()
    total = 0
    for i, size in enumerate(sizes):
        total += size or 0
        if i and total > max_chars:
            return start + i
    return start + len(sizes)
