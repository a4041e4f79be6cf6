"""Vector-table sink: upsert, replace, model guard and delete on a table partitioned by collection and bucket of the id.

The merge itself is a pure function of two DataFrames. The stored table is plain Parquet to which versions are appended: a
write moves and rewrites no earlier row, and a large collection is written by as many tasks as it has touched buckets. A
reader takes the newest version of each key, an ordered maximum that combines before the shuffle. What a collection held
before it was replaced or deleted is hidden by a mark, a row without an id. ``compact_vectors`` rewrites the buckets of which
many versions have gathered.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = ("collection", "chunk_id")
#: Buckets of a collection; the same for all writes to a table.
BUCKETS = 16


def latest(vectors: DataFrame) -> DataFrame:
    """Last write per key. An ordered maximum, not a window: it combines before the shuffle, however often a key repeats."""
    rest = [c for c in vectors.columns if c not in KEY and c != "version"]
    return vectors.groupBy(*KEY).agg(F.max(F.struct("version", *rest)).alias("_row")).select(
        *[c if c in KEY else F.col(f"_row.{c}").alias(c) for c in vectors.columns]
    )


def guard_actions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per incoming collection ``append``, ``create`` or (model or dimension changed) ``rebuild``."""
    stored = existing.groupBy("collection").agg(F.min("model").alias("m"), F.min("dimension").alias("d"))
    new = incoming.groupBy("collection").agg(F.min("model").alias("model"), F.min("dimension").alias("dimension"))
    changed = (F.col("m") != F.col("model")) | (F.col("d") != F.col("dimension"))
    action = F.when(F.col("m").isNull(), F.lit("create")).when(changed, F.lit("rebuild")).otherwise(F.lit("append"))
    return new.join(stored, "collection", "left").select("collection", "model", "dimension", action.alias("action"))


def merge_vectors(existing: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """Touched collections after an upsert; collections to rebuild (or all touched, with ``force``) lose old rows."""
    actions = guard_actions(existing, incoming)
    replaced = actions if force else actions.filter(F.col("action") == "rebuild")
    touched = incoming.select("collection").distinct()
    old = existing.join(touched, "collection", "left_semi").join(replaced.select("collection"), "collection", "left_anti")
    return latest(old.unionByName(incoming))


def pair_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with their vectors; a chunk without a vector, or the reverse, is an error when the rows are read."""
    joined = chunks.withColumn("_c", F.lit(True)).join(embeddings.withColumn("_e", F.lit(True)), "chunk_id", "full")
    broken = F.col("_c").isNull() | F.col("_e").isNull()
    note = F.concat(F.lit("chunk and embedding counts differ at "), F.col("chunk_id"))
    return joined.withColumn("chunk_id", F.when(broken, F.raise_error(note).cast("string")).otherwise(F.col("chunk_id"))).drop(
        "_c", "_e"
    )


def delete_collections(vectors: DataFrame, collections: DataFrame) -> DataFrame:
    return vectors.join(collections.select("collection").distinct(), "collection", "left_anti")


def _stored(spark: SparkSession, location: str, schema: str) -> DataFrame:
    """All rows of the table, marks and old versions included; an absent table has none."""
    try:
        return spark.read.schema(f"{schema}, bucket int").parquet(location)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], f"{schema}, bucket int")
        raise


def _visible(rows: DataFrame) -> DataFrame:
    """Rows that no later mark of their collection hides; there is at most one mark per write and collection."""
    marks = rows.filter("chunk_id IS NULL").groupBy("collection").agg(F.max("version").alias("_from"))
    kept = rows.filter("chunk_id IS NOT NULL").join(marks, "collection", "left")
    return kept.filter(F.col("version") >= F.coalesce("_from", F.col("version"))).drop("_from")


def read_vectors(spark: SparkSession, location: str, schema: str) -> DataFrame:
    """The newest version of every vector of the table; an absent table reads as empty."""
    return latest(_visible(_stored(spark, location, schema)).drop("bucket"))


def _schema(vectors: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)


def _append(rows: DataFrame, location: str, buckets: int) -> None:
    bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")
    spread = rows.withColumn("bucket", bucket).repartition("collection", "bucket")
    spread.write.mode("append").partitionBy("collection", "bucket").parquet(location)


def _marks(collections: DataFrame, like: DataFrame, version) -> DataFrame:
    """Rows without an id from which on a collection's rows count."""
    fields = [c for c in like.columns if c not in ("collection", "version")]
    return collections.select("collection", version.alias("version"), *[F.lit(None).cast(like.schema[c].dataType).alias(c) for c in fields]).select(like.columns)


def upsert_vectors(incoming: DataFrame, location: str, force: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Append ``incoming`` to the table at ``location`` and return the counts per touched collection.

    Its ``version`` decides between writes to a key. A collection whose model or dimension changes, or with ``force`` every
    touched one, loses its earlier rows. A write that is repeated, whole or in part, changes nothing.
    """
    spark, schema = incoming.sparkSession, _schema(incoming)
    touched = incoming.groupBy("collection").agg(F.count_distinct("chunk_id").alias("chunks_indexed"))

    def visible() -> DataFrame:
        # of the touched collections' partitions, and no embedding
        return _visible(_stored(spark, location, schema).join(touched.select("collection"), "collection", "left_semi"))

    actions = guard_actions(visible(), incoming)
    first = incoming.groupBy("collection").agg(F.min("version").alias("_first"))
    replaced = first if force else first.join(actions.filter(F.col("action") == "rebuild").select("collection"), "collection", "left_semi")
    _append(latest(incoming).unionByName(_marks(replaced, incoming, F.col("_first"))), location, buckets)
    return touched.join(visible().groupBy("collection").agg(F.count_distinct("chunk_id").alias("total_chunks")), "collection", "left")


def drop_collections(collections: DataFrame, location: str, schema: str, version: int, buckets: int = BUCKETS) -> None:
    """Hide all rows of ``collections`` that are older than ``version``."""
    like = collections.sparkSession.createDataFrame([], schema)
    _append(_marks(collections.select("collection").distinct(), like, F.lit(version).cast("long")), location, buckets)


def compact_vectors(spark: SparkSession, location: str, schema: str, versions: float = 2.0) -> DataFrame:
    """Rewrite the buckets that hold at least ``versions`` rows per visible key to one row per key; returns them.

    Buckets are replaced one by one by partition overwrite; all others, and the marks, stay as they are.
    """
    rows = _stored(spark, location, schema)
    newest = latest_in_buckets(_visible(rows))
    held = rows.filter("chunk_id IS NOT NULL").groupBy("collection", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    kept = newest.groupBy("collection", "bucket").agg(F.count(F.lit(1)).alias("keys"))
    full = held.join(kept, ["collection", "bucket"]).filter(F.col("rows") >= versions * F.col("keys")).select("collection", "bucket", "rows", "keys")
    chosen = full.collect()  # a row per bucket
    if chosen:
        listed = spark.createDataFrame(chosen, full.schema).select("collection", "bucket")
        (
            newest.join(F.broadcast(listed), ["collection", "bucket"], "left_semi").repartition("collection", "bucket")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "bucket").parquet(location)
        )
    return spark.createDataFrame(chosen, full.schema)


def latest_in_buckets(rows: DataFrame) -> DataFrame:
    """As :func:`latest`, with the bucket of each key."""
    rest = [c for c in rows.columns if c not in (*KEY, "version", "bucket")]
    newest = rows.groupBy(*KEY, "bucket").agg(F.max(F.struct("version", *rest)).alias("_row"))
    return newest.select(*[F.col(f"_row.{c}").alias(c) if c in ("version", *rest) else c for c in rows.columns])
