"""Vector search: exact batch top-k in blocks, approximate top-k over an inverted file of codes, and index statistics.

Exact search never forms query-vector pairs as rows. Vectors stay where they are stored; each task multiplies its Arrow
batches with the query matrix and hands on only its best k per query, so the shuffle carries at most
``tasks * queries * k`` rows. The query matrix is sent to the tasks only below a checked size; a larger query set is
joined to the vectors fragment by fragment through a shuffle.

Approximate search reads codes instead of vectors: a vector's list is its nearest of a few trained centroids, its code one
byte a dimension for what lies between the two. A query looks into the lists nearest to it, as many as the training sample
says it needs, ranks their codes, and only the best few vectors themselves are read and ranked exactly.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.vectors import is_valid_vector
from corpusloom.session import durable, shared_folder, stored

MAX_QUERY_BYTES = 64 * 1024 * 1024
VECTORS_PER_FRAGMENT = 20_000
QUERIES_PER_FRAGMENT = 5_000
#: Collections that each fit one cell share cells, about so many in one.
COLLECTIONS_PER_FRAGMENT = 8
#: Lists of an inverted file, and the vectors that train it.
MAX_LISTS, SAMPLE_VECTORS = 256, 20_000
# One score matrix: at most so many queries times vectors, however large the batch or the query set. A search begins with few vectors.
QUERY_ROWS, VECTOR_ROWS, FIRST_ROWS = 512, 4_096, 64
# Scores are ranked at nine decimals, so equal vectors tie (and fall to the id) however the sums were grouped.
RANK_DECIMALS = 9
#: Queries whose hits a task hands on at once, and numbers that are gathered at once for exact scores.
ROWS_OUT, GATHERED = 10_000, 1 << 22

_HITS = "query_id bigint, chunk_id string, cosine double"
_HITS_ARROW = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.string()), ("cosine", pa.float64())])


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _rows_of(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; a null in a list is not a number."""
    sizes = pc.list_value_length(column)
    if sizes.null_count or len(pc.unique(sizes)) > 1:
        raise ValueError("all vectors must have the same length")
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), sizes[0].as_py() if len(sizes) else 0)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


class _Side(NamedTuple):
    """The queries of one collection: their rows, unit vectors, as single precision too, and which rows ask for the same types."""

    rows: np.ndarray
    unit: np.ndarray
    single: np.ndarray
    types: list[tuple[list | None, np.ndarray]]
    probed: np.ndarray | None


class _Asked:
    """Queries as arrays with the k best vectors of each so far."""

    def __init__(self, table: pa.Table, k: int, probe: Callable[[np.ndarray], np.ndarray] | None = None):
        table, n = table.combine_chunks(), table.num_rows
        self.ids, self.sides, self.seen = table["query_id"].combine_chunks(), {}, Counter()
        self.score, self.name = np.full((n, k), -np.inf), np.full((n, k), None, object)
        self.scores, self.reach = (np.empty(min(n, QUERY_ROWS) * VECTOR_ROWS, t) for t in (np.float32, bool))  # of one cell, kept for the next
        wanted, embeddings = table["entity_types"].to_pylist(), table["embedding"].combine_chunks()
        for collection, rows in _places(table["collection"].combine_chunks()):
            unit = _unit(_rows_of(embeddings.take(pa.array(rows))))
            types: dict[tuple, list[int]] = {}
            for i, row in enumerate(rows.tolist()):
                types.setdefault(tuple(wanted[row] or ()), []).append(i)
            self.sides[collection] = _Side(
                rows, unit, unit.astype(np.float32), [(list(t) or None, np.array(at)) for t, at in types.items()], probe(unit) if probe else None)

    def add(self, batch: pa.RecordBatch, matrix: Callable[[pa.RecordBatch], np.ndarray]) -> None:
        """Score the vectors of ``batch`` for the queries of their collections, in blocks that grow: the first ones tell what later ones have to reach."""
        for collection, rows in _places(batch["collection"]):
            side = self.sides.get(collection)
            if side is None:
                continue
            some = batch.take(pa.array(rows))
            some = some.take(pc.sort_indices(some["chunk_id"], null_placement="at_start"))  # places have the order of the ids, as Spark sorts them
            unit, kinds, names = _unit(matrix(some)), np.array([*some["entity_type"].to_pylist(), None], object)[:-1], np.array([*some["chunk_id"].to_pylist(), None], object)[:-1]
            lists = [(None, np.arange(len(names)))] if side.probed is None else _places(some["list"])
            for number, at in lists:
                for wanted, asks in side.types:
                    asks = asks if number is None else asks[side.probed[asks, number]]
                    of_kind = at if wanted is None else at[np.isin(kinds[at], wanted)]
                    self._add_blocks((collection, number, tuple(wanted or ())), side, asks, unit[of_kind], names[of_kind])

    def _add_blocks(self, group: tuple, side: _Side, asks: np.ndarray, unit: np.ndarray, names: np.ndarray) -> None:
        single, start = unit.astype(np.float32).T, 0
        while start < len(names) and len(asks):
            stop = start + min(max(FIRST_ROWS, self.seen[group]), VECTOR_ROWS)
            for i in range(0, len(asks), QUERY_ROWS):
                self._add_cell(side, asks[i : i + QUERY_ROWS], unit[start:stop], np.ascontiguousarray(single[:, start:stop]), names[start:stop])
            self.seen[group] += min(stop, len(names)) - start
            start = stop

    def _add_cell(self, side: _Side, asks: np.ndarray, unit: np.ndarray, single: np.ndarray, names: np.ndarray) -> None:
        """Single precision tells, with a margin for its errors, which scores can be among the best; these are taken exactly."""
        rows, k, n = side.rows[asks], self.score.shape[1], len(names)
        least, margin = self.score[rows, -1], (unit.shape[1] + 16) * 2.0**-23
        scores, reach = (buffer[: len(asks) * n].reshape(len(asks), n) for buffer in (self.scores, self.reach))
        np.greater_equal(np.matmul(side.single[asks], single, out=scores), (least - margin).astype(np.float32)[:, None], out=reach)
        near = np.flatnonzero(reach)
        query, vector = np.divmod(near, n)
        if len(near) * 8 > len(asks) * n:
            score = (side.unit[asks] @ unit.T)[query, vector]
        else:
            step = max(1, GATHERED // max(1, unit.shape[1]))
            parts = [np.einsum("ij,ij->i", side.unit[asks[query[i : i + step]]], unit[vector[i : i + step]]) for i in range(0, len(near), step)]
            score = np.concatenate([np.zeros(0), *parts])
        level = np.rint(score * 10**RANK_DECIMALS)
        best = level >= np.rint(least * 10**RANK_DECIMALS)[query]
        # one number that sorts by query, falling score and place; a place fits 16 bits and a score, from -2 to 2, 32
        key = np.sort(query[best] << 48 | (2 * 10**RANK_DECIMALS - level[best].astype(np.int64)) << 16 | vector[best])
        sizes = np.minimum(np.diff(np.searchsorted(key, np.arange(len(asks) + 1) << 48)), k)
        key = key[_ranges(np.searchsorted(key, np.arange(len(asks)) << 48), sizes)]
        if not len(key):
            return
        vector, score = key & 0xFFFF, (2 * 10**RANK_DECIMALS - (key >> 16 & 0xFFFFFFFF)) / 10**RANK_DECIMALS
        changed = np.flatnonzero(sizes)
        line, place = np.repeat(np.arange(len(changed)), sizes[changed]), _ranges(np.zeros(len(changed), np.int64), sizes[changed])
        new, named = np.full((len(changed), place.max() + 1), -np.inf), np.full((len(changed), place.max() + 1), None, object)
        new[line, place], named[line, place] = score, names[vector]
        new, named = np.concatenate([self.score[rows[changed]], new], axis=1), np.concatenate([self.name[rows[changed]], named], axis=1)
        order = np.argsort(-new, axis=1, kind="stable")
        new, named = np.take_along_axis(new, order, axis=1), np.take_along_axis(named, order, axis=1)
        for i in np.flatnonzero(((new[:, 1:] == new[:, :-1]) & (new[:, 1:] > -np.inf)).any(axis=1)).tolist():
            named[i] = [x for _, _, x in sorted(zip((-new[i]).tolist(), [x is not None for x in named[i]], named[i]), key=lambda x: (x[0], x[1], x[2] or ""))]
        self.score[rows[changed]], self.name[rows[changed]] = new[:, :k], named[:, :k]

    def hits(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.ids), ROWS_OUT):
            query, at = np.nonzero(self.score[i : i + ROWS_OUT] > -np.inf)
            query = query + i
            yield pa.RecordBatch.from_arrays(
                [self.ids.take(pa.array(query)), pa.array(self.name[query, at], pa.string()), pa.array(self.score[query, at])], schema=_HITS_ARROW)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, in a row."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _places(column: pa.Array) -> list[tuple[str | int, np.ndarray]]:
    """Each value of a column and its rows; rows without a value are left out."""
    codes = column.dictionary_encode()
    known = np.flatnonzero(codes.indices.is_valid().to_numpy(zero_copy_only=False))
    of = codes.indices.take(pa.array(known)).to_numpy(zero_copy_only=False)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(codes.dictionary) + 1))
    return [(value, known[order[a:b]]) for value, a, b in zip(codes.dictionary.to_pylist(), cuts.tolist(), cuts[1:].tolist())]


def _stored(batch: pa.RecordBatch) -> np.ndarray:
    return _rows_of(batch["embedding"])


def _prepare_queries(queries: DataFrame) -> DataFrame:
    if "entity_types" not in queries.columns:
        queries = queries.withColumn("entity_types", F.lit(None).cast("array<string>"))
    return queries.select(
        F.col("query_id").cast("long"), "collection", "embedding",
        F.transform("entity_types", F.lower).alias("entity_types"),
    )


def cosine_top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 10, max_query_bytes: int = MAX_QUERY_BYTES
) -> DataFrame:
    """Exact ``(query_id, rank, chunk_id, cosine)`` of the k nearest vectors in each query's collection.

    ``queries`` holds ``query_id, collection, embedding`` and optionally ``entity_types``.
    """
    q = _prepare_queries(queries)
    v = vectors.select("collection", "chunk_id", F.lower("entity_type").alias("entity_type"), "embedding")
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if size["n"] * (size["d"] or 0) * 8 <= max_query_bytes:
        return _ranked(_top_k_by_broadcast(q, v, k), k)
    return _ranked(_top_k_by_fragments(q, v, k), k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "chunk_id", "cosine"
    )


def _top_k_by_broadcast(q: DataFrame, v: DataFrame, k: int) -> DataFrame:
    """One pass over the stored vectors; the query matrix was checked to be small."""
    sent = q.sparkSession.sparkContext.broadcast(q.toArrow())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked(sent.value, k)
        for batch in batches:
            asked.add(batch, _stored)
        yield from asked.hits()

    return v.mapInArrow(search, _HITS)


def _top_k_by_fragments(
    q: DataFrame, v: DataFrame, k: int, matrix: Callable[[pa.RecordBatch], np.ndarray] = _stored,
    probe: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Fragment-and-replicate within each collection: each (query part, vector part) cell is one bounded task.

    A row goes to as many cells as the other side has parts in its own collection. Collections of one cell share cells by hash.
    """
    count = F.count(F.lit(1))
    asks = q.groupBy("collection").agg(F.ceil(count / QUERIES_PER_FRAGMENT).cast("int").alias("qs"))
    holds = v.groupBy("collection").agg(F.ceil(count / VECTORS_PER_FRAGMENT).cast("int").alias("vs"))
    parts = stored(asks.join(holds, "collection"), "fragments")
    n_small = max(1, parts.filter("qs = 1 and vs = 1").count() // COLLECTIONS_PER_FRAGMENT)
    name = F.xxhash64("collection")
    cell = F.when((F.col("qs") == 1) & (F.col("vs") == 1), F.pmod(name, F.lit(n_small))).otherwise(name).alias("cell")
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(parts, "collection").select(*q.columns, cell, part("query_id", "qs").alias("qp"), numbers("vs").alias("vp"))
    # columns of their own, should the queries come from the same table
    right = v.join(parts, "collection").select(*[F.col(c).alias(c) for c in v.columns], cell, part("chunk_id", "vs").alias("vp"), numbers("qs").alias("qp"))

    def search(qs: pa.Table, vs: pa.Table) -> pa.Table:
        if not (qs.num_rows and vs.num_rows):
            return _HITS_ARROW.empty_table()
        asked = _Asked(qs, k, probe)
        for batch in vs.combine_chunks().to_batches():
            asked.add(batch, matrix)
        return pa.Table.from_batches(list(asked.hits()), _HITS_ARROW)

    return left.groupBy("cell", "qp", "vp").cogroup(right.groupBy("cell", "qp", "vp")).applyInArrow(search, _HITS)


def nearest(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """Top-k for a single query vector, planned as ``TakeOrderedAndProject`` on JVM columns."""
    from corpusloom.functions.vectors import cosine_similarity

    q = F.array(*[F.lit(float(x)) for x in query])
    return (
        vectors.select("chunk_id", cosine_similarity(F.col("embedding"), q).alias("cosine"))
        .orderBy(F.desc(F.bround("cosine", RANK_DECIMALS)), "chunk_id")
        .limit(k)
    )


class Centroids(NamedTuple):
    """``centres`` of the lists, the ``step`` of a code in each dimension, and how many lists a query has to ``probe``."""

    centres: np.ndarray
    step: np.ndarray
    probe: int


class CodeIndex(NamedTuple):
    """``codes``: ``collection, list, chunk_id, entity_type, code``, in folders by collection and list."""

    centroids: Centroids
    codes: DataFrame


def train_centroids(sample: np.ndarray, k: int = 10, recall: float = 0.9, sure: float = 0.995, rounds: int = 10, seed: int = 42) -> Centroids:
    """k-means of unit vectors; ``probe`` is the least number of lists that hold ``recall`` of the neighbours of ``sure`` of the
    sample's own vectors."""
    x, rng = _unit(sample.astype(np.float64)), np.random.default_rng(seed)
    n = max(1, min(MAX_LISTS, int(len(x) ** 0.5 / 2)))
    centres = x[rng.choice(len(x), n, replace=False)] if len(x) else np.zeros((1, sample.shape[1] if sample.ndim > 1 else 0))
    for _ in range(rounds if len(x) else 0):
        at = (x @ centres.T).argmax(axis=1)
        for c in range(n):
            if (at == c).any():
                centres[c] = x[at == c].mean(axis=0)
        centres = _unit(centres)
    if not len(x):
        return Centroids(centres, np.ones(centres.shape[1]), 1)
    at = (x @ centres.T).argmax(axis=1)
    step = np.maximum(np.abs(x - centres[at]).max(axis=0), 1e-6) / 127
    asked = x[:200]
    near = np.argsort(-(asked @ x.T), axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each list, by nearness to the query
    if not near.size:
        return Centroids(centres, step, 1)
    far = np.sort(np.take_along_axis(place, at[near], axis=1), axis=1)[:, int(np.ceil(recall * near.shape[1])) - 1]
    return Centroids(centres, step, int(np.quantile(far, sure, method="higher")) + 1)


def index_vectors(vectors: DataFrame, sample: int = SAMPLE_VECTORS) -> CodeIndex:
    """Train on ``sample`` vectors, chosen by hash of the id, and write the codes of all of them under the shared folder."""
    rows = vectors.select("collection", "chunk_id", "embedding").orderBy(F.xxhash64("collection", "chunk_id")).limit(sample).toPandas()
    centroids = train_centroids(_matrix(rows["embedding"]))

    @F.arrow_udf("struct<list:int,code:binary>")
    def coded(embeddings: pa.Array) -> pa.Array:
        x = _unit(_matrix(embeddings.to_numpy(zero_copy_only=False)))
        at = (x @ centroids.centres.T).argmax(axis=1) if len(x) else np.zeros(0, int)
        codes = np.clip(np.round((x - centroids.centres[at]) / centroids.step), -127, 127).astype(np.int8) if len(x) else []
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "code"])

    path = f"{shared_folder(vectors.sparkSession)}/vector-codes-{uuid.uuid4().hex}"
    table = vectors.select("collection", "chunk_id", "entity_type", coded("embedding").alias("c")).select("collection", "chunk_id", "entity_type", "c.list", "c.code")
    table.write.partitionBy("collection", "list").parquet(path)
    schema = "chunk_id string, entity_type string, code binary, collection string, list int"
    return CodeIndex(centroids, vectors.sparkSession.read.schema(schema).parquet(path))


def approx_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, index: CodeIndex | None = None, read_share: float = 0.08) -> DataFrame:
    """Approximate ``(query_id, rank, chunk_id, cosine)``: codes of the nearest lists, then an exact rank of the best of them.

    Of each query's collection at most ``read_share`` of the vectors, ``k + 2`` at least and ``4 k`` at most, are read. Queries that
    find fewer than k hits are answered exactly.
    """
    index = index or index_vectors(vectors)
    centres, step, probe = index.centroids
    prepared = _prepare_queries(queries)

    def probed(unit: np.ndarray) -> np.ndarray:
        nearest, marks = np.argsort(-(unit @ centres.T), axis=1)[:, :probe], np.zeros((len(unit), len(centres)), bool)
        np.put_along_axis(marks, nearest, True, axis=1)
        return marks

    def decoded(batch: pa.RecordBatch) -> np.ndarray:
        codes = batch["code"].to_pylist()
        rows = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1) if codes else np.zeros((0, centres.shape[1]))
        return (rows * step + centres[batch["list"].to_numpy()]).astype(np.float32).astype(np.float64)

    largest = vectors.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    pool = max(k + 2, min(4 * k, int(read_share * largest)))
    # a query meets the codes of its collection once, not once per list: the lists it looks into are told apart in the cell
    codes = index.codes.select("collection", "chunk_id", F.lower("entity_type").alias("entity_type"), "list", "code")
    near = _ranked(_top_k_by_fragments(prepared, codes, pool, decoded, probed), pool).select("query_id", "chunk_id")
    own = prepared.select("query_id", "collection", F.col("embedding").alias("q"))
    candidates = near.join(own.select("query_id", "collection"), "query_id")
    read = vectors.select("collection", "chunk_id", F.col("embedding").alias("v")).join(candidates, ["collection", "chunk_id"])

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.round((_unit(_matrix(a)) * _unit(_matrix(b))).sum(axis=1), RANK_DECIMALS))

    scored = read.join(own.select("query_id", "q"), "query_id").select("query_id", "chunk_id", cosine("q", "v").alias("cosine"))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = durable(ranked.select("query_id", "rank", "chunk_id", "cosine"))
    full = found.filter(F.col("rank") == k).select("query_id")
    rest = queries.join(full, "query_id", "left_anti")
    return found.join(full, "query_id", "left_semi").unionByName(cosine_top_k(rest, vectors, k))


def validate_vectors(vectors: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)``: vectors of another length are quarantined with the reason."""
    ok = is_valid_vector(F.col("embedding"), dimension)
    rejects = vectors.filter(~ok).select(
        "collection", "chunk_id", F.coalesce(F.size("embedding"), F.lit(0)).alias("length"),
        F.lit(f"length differs from dimension {dimension}").alias("reason"),
    )
    return vectors.filter(ok), rejects


def index_stats(vectors: DataFrame) -> DataFrame:
    """Chunks, model and dimension per collection."""
    return vectors.groupBy("collection").agg(
        F.count(F.lit(1)).alias("total_chunks"), F.min("model").alias("model"), F.min("dimension").alias("dimension")
    ).withColumn("index_exists", F.col("total_chunks") > 0)


def index_metrics(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Files processed, chunks indexed and vectors held per collection."""
    processed = chunks.groupBy("collection").agg(
        F.count_distinct("file_path").alias("files_processed"), F.count(F.lit(1)).alias("chunks_indexed")
    )
    return processed.join(vectors.groupBy("collection").agg(F.count(F.lit(1)).alias("total_vectors")), "collection", "left")
