"""Vector queries: hash embedding, similarity, top-k, upsert, guards and index statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import vectors as vf
from corpusloom.operators import vectors as ops
from corpusloom.plans import bindings as b
from corpusloom.plans.registry import query
from corpusloom.sources import vectors as sink

_DIM = 32


def hash_embedding_sql(text: str, dim: int) -> str:
    """SQL twin of the hash embedding for dimensions up to 32 (one digest)."""
    digest = f"sha256(encode({text}) || '\\x00\\x00\\x00\\x00'::BLOB)"
    return (
        f"list_transform(range(0, {dim}), lambda i: CAST(('0x' || substr({digest}, CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) / 127.5 - 1.0)"
    )


@query("hash_embedding", "MATH1 MATH2 ARR3", f"""
WITH e AS (SELECT item_id, {hash_embedding_sql('text', _DIM)} AS v FROM benchmark),
n AS (SELECT item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM e)
SELECT item_id, round(v[1] / l, 6) AS first, round(v[{_DIM}] / l, 6) AS last,
       round(sqrt(list_sum(list_transform(v, lambda x: (x / l) * (x / l)))), 6) AS length, TRUE AS valid FROM n""")
def hash_embedding(spark, sf):
    v = F.col("v")
    return b.table(spark, sf, "benchmark").select("item_id", vf.hash_embedding(F.col("text"), _DIM).alias("v")).select(
        "item_id", F.round(F.get(v, 0), 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"),
        F.round(vf.norm(v), 6).alias("length"), vf.is_valid_vector(v, _DIM).alias("valid"),
    )


@query("normalized_vectors", "MATH2", f"""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 3)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM s)
SELECT vec_id, round(CASE WHEN l > 0 THEN v[1] / l ELSE v[1] END, 6) AS first,
       round(CASE WHEN l > 0 THEN sqrt(list_sum(list_transform(v, lambda x: (x / l) * (x / l)))) ELSE 0 END, 6) AS length FROM n""")
def normalized_vectors(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3))
    return b.table(spark, sf, "embeddings").select("vec_id", vf.l2_normalize(scaled).alias("v")).select(
        "vec_id", F.round(F.get("v", 0), 6).alias("first"), F.round(vf.norm(F.col("v")), 6).alias("length")
    )


_COS_SQL = """list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))
  / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
   * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"""


@query("neighbour_similarity", "MATH3", f"""
SELECT a.vec_id, round(greatest(0, least(1, {_COS_SQL})), 4) AS similarity, round(1 - {_COS_SQL}, 4) AS distance
FROM embeddings a JOIN embeddings q ON q.vec_id = a.vec_id + 1""")
def neighbour_similarity(spark, sf):
    v = b.table(spark, sf, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    cosine = vf.cosine_similarity(F.col("embedding"), F.col("other"))
    return v.join(nxt, "vec_id").select(
        "vec_id", vf.similarity_score(cosine).alias("similarity"), vf.cosine_distance(cosine).alias("distance")
    )


def _query_vectors(spark, sf):
    """Every tenth vector as a query in its own collection; every other query asks for its own type only."""
    return b.vectors(spark, sf).filter(F.col("vec_id") % 10 == 0).select(
        F.col("vec_id").alias("query_id"), "collection", "embedding",
        F.when(F.col("vec_id") % 20 == 0, F.array("entity_type")).alias("entity_types"),
    )


@query("cosine_topk_batch", "JN16 SRCH3 PRJ12", f"""
WITH {b.VECTORS_SQL}, s AS (
  SELECT q.vec_id AS query_id, a.chunk_id, round({_COS_SQL}, 9) AS cosine
  FROM vectors q JOIN vectors a ON a.collection = q.collection
  WHERE q.vec_id % 10 = 0 AND (q.vec_id % 20 <> 0 OR a.entity_type = q.entity_type)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(greatest(0, least(1, cosine)), 4) AS similarity FROM r WHERE rank <= 10""")
def cosine_topk_batch(spark, sf):
    hits = ops.cosine_top_k(_query_vectors(spark, sf), b.vectors(spark, sf), 10)
    return hits.select("query_id", "rank", "chunk_id", vf.similarity_score(F.col("cosine")).alias("similarity"))


@query("cosine_topk_fragments", "SRCH3", f"""
WITH {b.VECTORS_SQL}, s AS (
  SELECT q.vec_id AS query_id, a.chunk_id, round({_COS_SQL}, 9) AS cosine
  FROM vectors q JOIN vectors a ON a.collection = q.collection
  WHERE q.vec_id % 10 = 0 AND (q.vec_id % 20 <> 0 OR a.entity_type = q.entity_type)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM r WHERE rank <= 10""")
def cosine_topk_fragments(spark, sf):
    """The shuffled form that large query sets take, forced by a zero broadcast budget."""
    hits = ops.cosine_top_k(_query_vectors(spark, sf), b.vectors(spark, sf), 10, max_query_bytes=0)
    return hits.select("query_id", "rank", "chunk_id")


@query("cosine_topk_approx", "SRCH4", "SELECT vec_id AS query_id, CAST(10 AS BIGINT) AS n_hits, TRUE AS recalled FROM embeddings WHERE vec_id % 10 = 0")
def cosine_topk_approx(spark, sf):
    """Whether each query's approximate hits hold at least nine of its ten exact ones, a twelfth of the vectors being read."""
    q, v = _query_vectors(spark, sf).drop("entity_types"), b.vectors(spark, sf)
    exact = ops.cosine_top_k(q, v, 10).select("query_id", "chunk_id")
    near = ops.approx_top_k(q, v, 10).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    both = exact.join(near, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("hit") >= 9).alias("recalled"))
    return near.groupBy("query_id").agg(F.count("hit").alias("n_hits")).join(both, "query_id")


@query("type_filter", "PRJ12", """
SELECT vec_id, label FROM embeddings WHERE lower('Type' || label) IN ('type1', 'type3')""")
def type_filter(spark, sf):
    v = b.table(spark, sf, "embeddings").select("vec_id", "label")
    return v.filter(F.lower(F.concat(F.lit("Type"), F.col("label").cast("string"))).isin("type1", "type3"))


def _incoming(spark, sf):
    """Second batch: every third vector again with flipped sign and version 2, each of them sent twice."""
    v = b.vectors(spark, sf).filter(F.col("vec_id") % 3 == 0)
    flipped = v.withColumn("embedding", F.transform("embedding", lambda x: -x))
    moved = flipped.withColumn("chunk_id", F.when(F.col("vec_id") % 2 == 0, F.col("chunk_id")).otherwise(
        F.concat("chunk_id", F.lit("n"))))
    return moved.withColumn("version", F.lit(2).cast("long")).unionByName(moved.withColumn("version", F.lit(3).cast("long")))


_INCOMING_SQL = b.VECTORS_SQL + """, incoming AS (
  SELECT collection, CASE WHEN vec_id % 2 = 0 THEN chunk_id ELSE chunk_id || 'n' END AS chunk_id,
         list_transform(embedding, lambda x: -x) AS embedding, model, dimension, entity_type, CAST(ver AS BIGINT) AS version
  FROM vectors, (VALUES (2), (3)) t(ver) WHERE vec_id % 3 = 0)"""


@query("vector_upsert", "SNK1", f"""
WITH {_INCOMING_SQL}, u AS (
  SELECT collection, chunk_id, embedding, version FROM vectors UNION ALL SELECT collection, chunk_id, embedding, version FROM incoming)
SELECT collection, chunk_id, version, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM u
QUALIFY row_number() OVER (PARTITION BY collection, chunk_id ORDER BY version DESC) = 1""")
def vector_upsert(spark, sf):
    merged = sink.merge_vectors(b.vectors(spark, sf).drop("vec_id"), _incoming(spark, sf).drop("vec_id"))
    return merged.select("collection", "chunk_id", "version", F.round(F.get("embedding", 0).cast("double"), 5).alias("first"))


@query("vector_replace", "SNK2", f"""
WITH {_INCOMING_SQL}
SELECT collection, chunk_id, max(version) AS version FROM incoming GROUP BY ALL""")
def vector_replace(spark, sf):
    merged = sink.merge_vectors(b.vectors(spark, sf).drop("vec_id"), _incoming(spark, sf).drop("vec_id"), force=True)
    return merged.select("collection", "chunk_id", "version")


@query("vector_guard", "SNK3", f"""
WITH {b.VECTORS_SQL}
SELECT collection, CASE collection WHEN 'c0' THEN 'other-64' ELSE 'table-64' END AS model, 64 AS dimension,
       CASE WHEN collection = 'c0' THEN 'rebuild' WHEN collection = 'c1' THEN 'create' ELSE 'append' END AS action
FROM (SELECT DISTINCT collection FROM vectors)""")
def vector_guard(spark, sf):
    v = b.vectors(spark, sf)
    incoming = v.withColumn("model", F.when(F.col("collection") == "c0", F.lit("other-64")).otherwise(F.col("model")))
    return sink.guard_actions(v.filter(F.col("collection") != "c1"), incoming)


@query("vector_delete", "SNK4", f"""
WITH {b.VECTORS_SQL} SELECT collection, count(*) AS n FROM vectors WHERE collection NOT IN
  (SELECT collection FROM vectors GROUP BY collection HAVING count(*) % 2 = 0) GROUP BY 1""")
def vector_delete(spark, sf):
    v = b.vectors(spark, sf)
    even = v.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") % 2 == 0)
    return sink.delete_collections(v, even).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query("index_stats", "SNK5", f"""
WITH {b.VECTORS_SQL}
SELECT collection, count(*) AS total_chunks, min(model) AS model, CAST(min(dimension) AS INTEGER) AS dimension, TRUE AS index_exists
FROM vectors GROUP BY 1""")
def index_stats(spark, sf):
    return ops.index_stats(b.vectors(spark, sf))


@query("index_metrics", "AGG17", f"""
WITH {b.VECTORS_SQL}
SELECT collection, count(DISTINCT vec_id // 10) AS files_processed, count(*) AS chunks_indexed, count(*) AS total_vectors
FROM vectors GROUP BY 1""")
def index_metrics(spark, sf):
    v = b.vectors(spark, sf)
    chunks = v.withColumn("file_path", F.concat(F.lit("f"), F.floor(F.col("vec_id") / 10).cast("string")))
    return ops.index_metrics(chunks, v)


@query("vector_rejects", "ARR3", """
SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST(vec_id % 64 AS INTEGER) AS length FROM embeddings WHERE vec_id % 5 = 0""")
def vector_rejects(spark, sf):
    v = b.vectors(spark, sf)
    cut = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, (F.col("vec_id") % 64).cast("int"))).otherwise(F.col("embedding"))
    return ops.validate_vectors(v.withColumn("embedding", cut), 64)[1].select("chunk_id", "length")
