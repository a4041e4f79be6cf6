"""Lexical search for whole batches of queries over an inverted index.

The index is written once and read by every search. It holds, for each chunk, the distinct words of its text with the fields
they stand in, and the words of its name, class and path with what they are. A query term occurs in a text where some word
contains it, so a task looks each distinct word of a block of chunks up once in the tree of the queries' terms. The chunks come
in the order in which they win ties; what a block holds bounds the scores it can give, and only queries whose k best a block can
still change are scored, as a product of matrices. No pair of query and chunk becomes a row, and each task hands on its best k
chunks per query only. Reasons are built for the ranked hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from corpusloom.functions.identifiers import core_tokens, expand_terms, split_identifier
from corpusloom.functions.rows import explode_rows
from corpusloom.functions.text import title_case
from corpusloom.functions.vectors import bind
from corpusloom.session import shared_folder, stored

TYPE_HINTS = ("function", "class", "method", "interface")
TYPE_PRIORITY = {"function": 3, "method": 3, "class": 2, "interface": 2, "type_alias": 1, "file_module": 0}

#: Where a word stands: in text fields, as parts of words too, or, whole, as what the chunk is called.
SIGNATURE, DOCSTRING, BODY, DECORATOR, EXACT, NAME, PARENT, PATH, HINT = (1 << i for i in range(9))
WORD = r"[\p{L}\p{N}_]+"
#: Queries are sent to the tasks up to this size; more in a few parts, each with a pass over the chunks; still more meet them fragment by fragment.
MAX_QUERY_BYTES, MAX_BATCH_BYTES, MAX_PASSES = 64 << 20, 32 << 20, 8
QUERIES_PER_FRAGMENT, CHUNKS_PER_FRAGMENT = 20_000, 20_000
#: Queries whose best chunks a task hands on at once.
ROWS_OUT = 10_000
_META = (
    "repo", "file_path", "entity_name", "entity_type", "language", "start_line", "end_line", "signature", "docstring",
    "parent", "tokens_estimate",
)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, is_core)`` (and ``repo`` or ``entity_types`` where the queries carry them)."""
    extra = [c for c in ("repo", "entity_types") if c in queries.columns]
    core = queries.select("query_id", *extra, core_tokens(F.col("text")).alias("core"))
    return explode_rows(core, expand_terms(F.col("core")), "term", "query_id", *extra, "core").select("query_id", *extra, "term", F.array_contains("core", F.col("term")).alias("is_core"))


class Index(NamedTuple):
    """``chunks``: the chunk table with ``chunk_no``, which has the order of the ids; ``postings``: each chunk's words with their places."""

    chunks: DataFrame
    postings: DataFrame


def _priority(kind: Column) -> Column:
    kinds = F.create_map(*[x for n, p in TYPE_PRIORITY.items() for x in (F.lit(n), F.lit(p))])
    return F.coalesce(F.try_element_at(kinds, kind), F.lit(1))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def _path_tokens() -> Column:
    return F.split(F.lower("file_path"), r"[/\\_\-.]+")


def _entries() -> Column:
    """``array<struct<word, bits>>`` of a chunk: one entry per word and place."""

    def marked(words: Column, bit: int) -> Column:
        return F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(bit).alias("bits")))

    decorators = marked(F.array_distinct(F.flatten(F.transform(F.coalesce("decorators", F.array().cast("array<string>")), _words))), DECORATOR)
    kind = F.lower("entity_type")
    return F.concat(
        marked(_words(F.col("signature")), SIGNATURE), marked(_words(F.col("docstring")), DOCSTRING), marked(_words(F.col("code_content")), BODY),
        decorators, marked(F.array(F.lower("entity_name")), EXACT), marked(F.array_distinct(split_identifier(F.col("entity_name"))), NAME),
        marked(F.array_distinct(split_identifier(F.coalesce("parent", F.lit("")))), PARENT), marked(F.array_distinct(_path_tokens()), PATH),
        marked(F.filter(F.array(kind), lambda k: k.isin(*TYPE_HINTS)), HINT),
    )


def write_index(chunks: DataFrame, path: str) -> None:
    """Write the index of ``chunks`` to a folder that driver and executors share."""
    spark = chunks.sparkSession
    chunks.select("chunk_id", *_META, "decorators", "code_content").write.parquet(f"{path}/rows")
    # the sort samples ids of written rows; its ranges come in a row, so the numbers have the order of the ids
    numbered = spark.read.parquet(f"{path}/rows").orderBy("chunk_id").withColumn("chunk_no", F.monotonically_increasing_id())
    numbered.write.parquet(f"{path}/chunks")
    # within a task the chunks that win ties come first: most queries then have soon what later chunks cannot pass
    numbered = spark.read.parquet(f"{path}/chunks").withColumn("_priority", _priority(F.col("entity_type"))).sortWithinPartitions(F.desc("_priority"), "tokens_estimate", "chunk_no")
    numbered.select(
        "chunk_no", F.col("_priority").cast("int").alias("priority"), F.col("tokens_estimate").cast("long").alias("tokens"), "repo",
        F.lower("entity_type").alias("kind"), _entries().alias("entries"),
    ).write.parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/postings"))


def indexed(chunks: DataFrame) -> Index:
    """An index of ``chunks`` under the shared folder."""
    path = f"{shared_folder(chunks.sparkSession)}/lexical-{uuid.uuid4().hex}"
    write_index(chunks, path)
    return read_index(chunks.sparkSession, path)


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``starts[i]:stops[i]`` in a row."""
    sizes = stops - starts
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _runs(cuts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs ``a:b`` of the ranges between ``cuts`` that hold about ``most`` numbers each."""
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + most, side="right")) - 1)
        yield a, b
        a = b


class _Asked:
    """Queries as arrays. A row of ``table`` is what one query asks under one filter; a query's rows stay together."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        codes = pc.dictionary_encode(table["query_id"].combine_chunks(), null_encoding="encode")
        order = np.argsort(codes.indices.to_numpy(), kind="stable")
        rows = table.take(pa.array(order))
        self.ids = codes.dictionary
        self.rows = np.searchsorted(codes.indices.to_numpy()[order], np.arange(len(self.ids) + 1))
        self.repo = rows["repo"].to_numpy() if "repo" in rows.column_names else None
        self.kinds = np.array([*rows["kinds"].to_pylist(), None], object)[:-1] if "kinds" in rows.column_names else None
        terms = rows["terms"].combine_chunks()
        self.ends = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64))])
        asked, self.core, self.n = (terms.flatten().field(i) for i in range(3))
        self.core, self.n = self.core.to_numpy(zero_copy_only=False), self.n.to_numpy(zero_copy_only=False)
        asked = pc.dictionary_encode(asked)  # terms are never null
        self.term, self.dictionary = asked.indices.to_numpy(zero_copy_only=False), asked.dictionary
        # the terms' bytes as a tree: per level the edges out of it, sorted, and the number of its first node
        text, letters = asked.dictionary.cast(pa.large_binary()), np.zeros(0, np.uint8)
        starts = np.zeros(len(text) + 1, np.int64)
        if len(text):
            starts, letters = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1], np.frombuffer(text.buffers()[2] or b"", np.uint8)
        sizes, nodes, node = np.diff(starts), 1, np.zeros(len(text), np.int64)
        self.levels: list[tuple[np.ndarray, int]] = []
        live = np.flatnonzero(sizes > 0)
        while len(live):
            edges, child = np.unique(node[live] * 256 + letters[starts[live] + len(self.levels)], return_inverse=True)
            node[live] = nodes + child
            self.levels.append((edges, nodes))
            nodes += len(edges)
            live = live[sizes[live] > len(self.levels)]
        self.ending = np.full(nodes, -1)
        self.ending[node[sizes > 0]] = np.flatnonzero(sizes > 0)

    def terms_in(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Terms that stand anywhere in each of the words, once per place, in a row, and where each word's begin. UTF-8 meets whole letters only."""
        words = words.cast(pa.large_binary())
        pairs = []
        if len(words):
            starts, letters = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1], np.frombuffer(words.buffers()[2] or b"", np.uint8)
            word = np.repeat(np.arange(len(words)), np.diff(starts))
            at, node = np.arange(starts[0], starts[-1]), np.zeros(starts[-1] - starts[0], np.int64)
            for depth, (edges, nodes) in enumerate(self.levels):
                inside = at + depth < starts[word + 1]
                word, at, node = word[inside], at[inside], node[inside]
                if not len(at):
                    break
                edge = node * 256 + letters[at + depth]
                child = np.minimum(np.searchsorted(edges, edge), len(edges) - 1)
                known = edges[child] == edge
                word, at, node = word[known], at[known], nodes + child[known]
                ends = self.ending[node] >= 0
                pairs.append(word[ends] * len(self.dictionary) + self.ending[node[ends]])
        word, term = np.divmod(np.sort(np.concatenate([np.zeros(0, np.int64), *pairs])), max(1, len(self.dictionary)))
        return term, np.searchsorted(word, np.arange(len(words) + 1))

    def sums(self, queries: np.ndarray, there: np.ndarray, core: bool) -> np.ndarray:
        """How many of each query's terms are marked in ``there``."""
        starts, stops = self.ends[self.rows[queries]], self.ends[self.rows[queries + 1]]
        at, cuts = _ranges(starts, stops), np.concatenate([[0], np.cumsum(stops - starts)])
        totals = np.concatenate([[0], np.cumsum((self.core if core else self.n)[at] * there[self.term[at]])])
        return totals[cuts[1:]] - totals[cuts[:-1]]


#: One block of scores: at most so many chunks times queries, and terms multiplied at once. A task begins with a small block.
CHUNK_ROWS, QUERY_ROWS, TERM_COLUMNS, FIRST_ROWS = 4_096, 256, 2_048, 128
#: A block ends, too, with the chunk that brings its words to this number.
BLOCK_WORDS = 1_000_000
#: What a matched term counts for: the place, whether a word of the name is left out, whether core terms only.
_COUNTS = {
    "exact": (EXACT, False, True), "concept": (EXACT, False, False), "name": (NAME, False, False), "parent": (PARENT, False, False),
    "path": (PATH, False, False), "sig": (SIGNATURE, True, False), "doc": (DOCSTRING, False, False), "dec": (DECORATOR, False, False),
    "body": (BODY, True, False), "hint": (HINT, False, True),
}
#: Places in texts, whose part of a score has a limit.
_TEXTS = ("sig", "doc", "dec", "body")


#: A product of matrices does so many products in the time of counting one place, and so many places are counted at once.
PRODUCTS_PER_PLACE, PLACES = 256, 1 << 21


class _Chunks:
    """A block of chunk rows as arrays, the better of two that score the same first; per term its chunks and places."""

    def __init__(self, rows: pa.RecordBatch, asked: _Asked):
        number, priority = rows["chunk_no"].to_numpy(), rows["priority"].to_numpy()
        tokens = pc.fill_null(rows["tokens"], np.iinfo(np.int64).min).to_numpy()
        order = np.lexsort((number, tokens, -priority))
        self.number, self.priority, self.tokens = number[order], priority[order], tokens[order]
        self.repo = rows["repo"].to_numpy(zero_copy_only=False)[order] if "repo" in rows.schema.names else None
        self.kind = rows["kind"].to_numpy(zero_copy_only=False)[order] if "kind" in rows.schema.names else None
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        chunk = np.repeat(at, pc.fill_null(pc.list_value_length(rows["entries"]), 0).to_numpy())
        words, bits = rows["entries"].flatten().flatten()
        known = words.is_valid().to_numpy(zero_copy_only=False)  # a chunk without a name has a null for it
        words, bits, chunk = words.drop_null().dictionary_encode(), bits.to_numpy(zero_copy_only=False)[known], chunk[known]
        code, whole = words.indices.to_numpy(), bits >= EXACT
        equal = pc.fill_null(pc.index_in(words.dictionary, asked.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        # what stands in a text: each word's terms in a row, taken by the words in their places
        flat, starts = asked.terms_in(words.dictionary)
        text, named = np.flatnonzero(~whole), np.flatnonzero(whole & (equal >= 0))
        begins, stops = starts[code[text]], starts[code[text] + 1]
        terms, entry = np.concatenate([flat[_ranges(begins, stops)], equal[named]]), np.concatenate([np.repeat(text, stops - begins), named])
        n, n_terms = len(order), len(asked.dictionary)
        key = np.sort((terms * n + chunk[entry]) * (2 * HINT) + bits[entry])  # a word's places are below twice the last one
        key, bits = np.divmod(key, 2 * HINT)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        term, chunk = np.divmod(key[first], max(n, 1))
        bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        #: Of each kind of count: the chunks of every term in a row, and where each term's begin.
        self.found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for name, (place, unnamed, _) in _COUNTS.items():
            where = (bits & place) > 0
            where = where & ((bits & NAME) == 0) if unnamed else where
            if where.any():
                self.found[name] = chunk[where], np.concatenate([[0], np.cumsum(np.bincount(term[where], minlength=n_terms))])
        # chunks called alike, by the terms in their names, paths and kinds, are one group
        called = np.flatnonzero(bits >= EXACT)
        called = called[np.argsort(chunk[called], kind="stable")]
        cuts = np.searchsorted(chunk[called], np.arange(n + 1))
        marks = np.stack([term[called], bits[called] & -EXACT], axis=1).astype(np.int64)
        groups: dict[bytes, int] = {}
        self.group = np.array([groups.setdefault(marks[i:j].tobytes(), len(groups)) for i, j in zip(cuts.tolist(), cuts[1:].tolist())], np.int64)
        self.sample = np.unique(self.group, return_index=True)[1]


def _counts(chunks: _Chunks, rows: np.ndarray, asked: _Asked, queries: np.ndarray, kinds: Iterable[str], filtered: bool = True) -> dict[str, np.ndarray | float]:
    """How many terms of each of ``queries`` stand at the places of each kind in each of the chunks ``rows``."""
    asks = _ranges(asked.rows[queries], asked.rows[queries + 1])
    at, n_rows = _ranges(asked.ends[asks], asked.ends[asks + 1]), len(asks)
    line = np.repeat(np.arange(n_rows), asked.ends[asks + 1] - asked.ends[asks])
    first = np.cumsum(np.diff(asked.rows)[queries]) - np.diff(asked.rows)[queries]
    allowed = None
    if filtered and asked.repo is not None:
        allowed = chunks.repo[rows, None] == asked.repo[None, asks]
        allowed &= np.array([r is not None for r in asked.repo[asks]], bool)
    if filtered and asked.kinds is not None:
        free = np.ones(len(rows), bool)
        of_kind = np.stack([np.isin(chunks.kind[rows], [k for k in ks if k is not None]) if ks else free for ks in asked.kinds[asks]], axis=1)
        allowed = of_kind if allowed is None else allowed & of_kind
    place_of = np.full(len(chunks.number), -1)
    place_of[rows] = np.arange(len(rows))
    n: dict[str, np.ndarray | float] = dict.fromkeys(_COUNTS, 0.0)
    for name in kinds:
        if name not in chunks.found:
            continue
        chunk, starts = chunks.found[name]
        weight = (asked.core if _COUNTS[name][2] else asked.n)[at]
        there = (starts[asked.term[at] + 1] > starts[asked.term[at]]) & (weight > 0)
        terms, column = np.unique(asked.term[at[there]], return_inverse=True)
        weight, asker = weight[there], line[there]
        stood = place_of[chunk[_ranges(starts[terms], starts[terms + 1])]]
        known, of = stood >= 0, np.repeat(np.arange(len(terms)), starts[terms + 1] - starts[terms])
        stood, of = stood[known], of[known]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(terms)))])
        places = np.concatenate([[0], np.cumsum(cuts[column + 1] - cuts[column])])
        if places[-1] * PRODUCTS_PER_PLACE <= len(rows) * len(terms) * n_rows:
            # few of the terms' places are asked for: these are counted one by one
            n[name] = np.zeros(len(rows) * n_rows, np.float32)
            for a, b in _runs(places, PLACES):
                sizes = np.diff(places[a : b + 1])
                cell = stood[_ranges(cuts[column[a:b]], cuts[column[a:b] + 1])] * n_rows + np.repeat(asker[a:b], sizes)
                n[name] += np.bincount(cell, None if (weight[a:b] == 1).all() else np.repeat(weight[a:b], sizes), len(n[name])).astype(np.float32)
            n[name] = n[name].reshape(len(rows), n_rows)
        for i in range(0, len(terms) if isinstance(n[name], float) else 0, TERM_COLUMNS):
            some, part = slice(cuts[i], cuts[min(i + TERM_COLUMNS, len(terms))]), (column >= i) & (column < i + TERM_COLUMNS)
            width = min(TERM_COLUMNS, len(terms) - i)
            stands, wanted = np.zeros((len(rows), width), np.float32), np.zeros((n_rows, width), np.float32)
            stands[stood[some], of[some] - i] = 1
            wanted[asker[part], column[part] - i] = weight[part]
            n[name] = n[name] + stands @ wanted.T
        if isinstance(n[name], np.ndarray):
            n[name] = n[name] if allowed is None else n[name] * allowed
            n[name] = n[name] if len(queries) == n_rows else np.add.reduceat(n[name], first, axis=1)
    return n


def _doubled(n: dict[str, np.ndarray | float]) -> np.ndarray:
    """Doubled scores, whole numbers: in a sum each match counts, where the weights say so up to two or three."""
    return (
        np.where(np.greater(n["exact"], 0), 20.0, np.where(np.greater(n["concept"], 0), 16.0, 0.0) + 10.0 * n["name"]) + 8.0 * n["parent"] + 7.0 * np.minimum(2, n["path"])
        + 6.0 * np.greater(n["sig"], 0) + 5.0 * np.minimum(2, n["doc"]) + 4.0 * np.greater(n["dec"], 0) + 2.0 * np.minimum(3, n["body"]) + 4.0 * n["hint"]
    )


class _Best:
    """The k best chunks of every query so far; no score is zero."""

    def __init__(self, n: int, k: int):
        self.score, self.priority, self.tokens, self.number = (np.zeros((n, k), np.int64) for _ in range(4))

    def add(self, queries: np.ndarray, score: np.ndarray, chunks: _Chunks, at: np.ndarray) -> None:
        k = self.score.shape[1]
        new = score, chunks.priority[at], chunks.tokens[at], chunks.number[at]
        held = [np.concatenate([h[queries], x], axis=1) for h, x in zip((self.score, self.priority, self.tokens, self.number), new)]
        order = np.lexsort((held[3], held[2], -held[1], -held[0]), axis=1)[:, :k]
        for h, x in zip((self.score, self.priority, self.tokens, self.number), held):
            h[queries] = np.take_along_axis(x, order, axis=1)

    def least(self, queries: np.ndarray, chunks: _Chunks) -> np.ndarray:
        """The score that a chunk of the block needs to be among the best: more than the last one's if it loses ties."""
        score, priority, tokens, number = (h[queries, -1] for h in (self.score, self.priority, self.tokens, self.number))
        first = -int(chunks.priority[0]), int(chunks.tokens[0]), int(chunks.number[0])
        loses = (-priority < first[0]) | ((-priority == first[0]) & ((tokens < first[1]) | ((tokens == first[1]) & (number < first[2]))))
        return np.maximum(1, score + loses)


def _add_block(chunks: _Chunks, asked: _Asked, best: _Best) -> None:
    """Score the chunks that can still be among the best of a query; a text's part of a score is bounded by the terms the block holds."""
    queries = np.arange(len(asked.ids))
    there = {name: starts[1:] > starts[:-1] for name, (_, starts) in chunks.found.items()}
    most = {name: asked.sums(queries, there[name], core) if name in there else np.zeros(len(queries)) for name, (_, _, core) in _COUNTS.items()}
    text = _doubled({name: most[name] if name in _TEXTS else 0.0 for name in _COUNTS})
    queries = queries[np.maximum(_doubled(most), _doubled(most | {"exact": np.zeros(len(queries))})) >= best.least(queries, chunks)]
    for i in range(0, len(queries), QUERY_ROWS):
        some = queries[i : i + QUERY_ROWS]
        named = _counts(chunks, chunks.sample, asked, some, [name for name in _COUNTS if name not in _TEXTS], filtered=False)
        bound = np.broadcast_to(_doubled(named), (len(chunks.sample), len(some))) + text[some]
        bound = np.maximum(bound, _doubled(named | {"exact": 0.0}) + text[some])  # a filter may leave out what is exact
        able = bound >= best.least(some, chunks)
        some, able = some[able.any(axis=0)], able.any(axis=1)
        rows = np.flatnonzero(able[chunks.group])
        if not len(some):
            continue
        scores = np.broadcast_to(_doubled(_counts(chunks, rows, asked, some, _COUNTS)), (len(rows), len(some))).astype(np.int64)
        n, k = len(rows), best.score.shape[1]
        place = scores * n + np.arange(n - 1, -1, -1)[:, None]  # chunks come in the order of the ties
        top = np.argpartition(place, n - k, axis=0)[n - k :] if n > k else np.broadcast_to(np.arange(n)[:, None], scores.shape)
        best.add(some, np.take_along_axis(scores, top, axis=0).T, chunks, rows[top].T)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks grow from ``FIRST_ROWS`` to ``CHUNK_ROWS``: a small one tells for most queries what the others have to reach."""
    size = min(FIRST_ROWS, CHUNK_ROWS)
    for batch in batches:
        words = np.cumsum(pc.fill_null(pc.list_value_length(batch["entries"]), 0).to_numpy())
        start = 0
        while start < batch.num_rows:
            enough = np.searchsorted(words, (words[start - 1] if start else 0) + BLOCK_WORDS) + 1
            stop = int(min(start + size, enough, batch.num_rows))
            yield batch.slice(start, stop - start)
            start, size = stop, min(2 * size, CHUNK_ROWS)


def _best_rows(asked: _Asked, batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of all rows of ``batches`` for each query; held are one block of scores and the k best of each query."""
    best = _Best(len(asked.ids), k)
    for block in _blocks(batches):
        _add_block(_Chunks(block, asked), asked, best)
    for i in range(0, len(asked.ids), ROWS_OUT):
        query, at = np.nonzero(best.score[i : i + ROWS_OUT])
        query = query + i
        score, priority, tokens, number = (h[query, at] for h in (best.score, best.priority, best.tokens, best.number))
        yield pa.RecordBatch.from_arrays(
            [asked.ids.take(pa.array(query)), pa.array(number), pa.array(score / 2.0), pa.array(priority.astype(np.int32)), pa.array(tokens)],
            names=["query_id", "chunk_no", "score", "priority", "tokens"])


def best_chunks(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """``(query_id, chunk_no, score, rank)`` of the k best chunks of every query that score above zero."""
    return _best_of_terms(queries, stored(query_terms(queries), "query-terms"), index, k)


def _best_of_terms(queries: DataFrame, terms: DataFrame, index: Index, k: int, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """Scores are formed in blocks of chunks and queries within the tasks and never are rows; a task hands on its k best per query."""
    by = [c for c in ("repo", "entity_types") if c in queries.columns]
    hits = index.postings.select("chunk_no", "priority", "tokens", *[{"repo": "repo", "entity_types": "kind"}[c] for c in by], "entries")
    core, times = F.count_if("is_core").cast("int").alias("core"), F.count(F.lit(1)).cast("int").alias("n")
    counted = terms.filter("term is not null").groupBy("query_id", *by, "term").agg(core, times)
    asked = counted.groupBy("query_id", *by).agg(F.collect_list(F.struct("term", "core", "n")).alias("terms"))
    if "entity_types" in by:
        asked = asked.withColumn("kinds", F.transform("entity_types", F.lower)).drop("entity_types")
    asked = stored(asked, "asked")
    schema = T.StructType([asked.schema["query_id"], *T.StructType.fromDDL("chunk_no bigint, score double, priority int, tokens bigint").fields])
    size = F.aggregate("terms", F.lit(64).cast("long"), lambda n, t: n + 16 + F.octet_length(t["term"]))
    n, n_bytes = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if n_bytes <= MAX_PASSES * max_query_bytes:
        passes = max(1, -(-n_bytes // max(1, max_query_bytes)))
        of = F.pmod(F.xxhash64("query_id"), F.lit(passes))
        ranked = _ranked_by_sent(asked.filter(of == 0), hits, k, schema)
        for i in range(1, passes):
            ranked = ranked.unionByName(_ranked_by_sent(asked.filter(of == i), hits, k, schema))
    else:
        # every fragment of the queries meets every fragment of the chunks
        n_queries, n_chunks = -(-n // QUERIES_PER_FRAGMENT), max(1, -(-index.postings.count() // CHUNKS_PER_FRAGMENT))
        numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = asked.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).cast("int")).withColumn("_c", numbers(n_chunks))
        right = hits.withColumn("_c", F.pmod(F.xxhash64("chunk_no"), F.lit(n_chunks)).cast("int")).withColumn("_q", numbers(n_queries))
        kinds, names = [asked.limit(0).toArrow().schema.field("query_id").type, pa.int64(), pa.float64(), pa.int32(), pa.int64()], schema.names

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            found = list(_best_rows(_Asked(a), b.to_batches(), k)) if a.num_rows and b.num_rows else []
            return pa.Table.from_batches(found) if found else pa.table([pa.array([], t) for t in kinds], names=names)

        ranked = left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("priority"), "tokens", "chunk_no")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("priority", "tokens")


def _ranked_by_sent(asked: DataFrame, hits: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """One pass over the chunks; the queries' size was checked."""
    sent = asked.sparkSession.sparkContext.broadcast(asked.toArrow())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.value.num_rows:
            yield from _best_rows(_Asked(sent.value), batches, k)

    return hits.mapInArrow(best, schema)


def _matches() -> Column:
    """``matches`` of a hit row: the query's ``terms`` looked up in the chunk's own columns."""
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))

    def match(t: Column, seen: Column) -> Column:
        term, core = t["term"], t["is_core"]
        name = F.array_contains(seen["name_tokens"], term)
        decorated = F.filter(F.transform(seen["decorators"], lambda d, i: F.when(F.contains(F.lower(d), term), i.cast("int"))), lambda i: i.isNotNull())
        exact = seen["name"] == term
        return F.struct(
            term.alias("term"), exact.alias("exact"), (exact & core).alias("core_exact"), name.alias("in_name"),
            F.array_contains(seen["parent_tokens"], term).alias("in_parent"), F.array_contains(seen["path_tokens"], term).alias("in_path"),
            (F.contains(seen["signature"], term) & ~name).alias("in_sig"), F.contains(seen["docstring"], term).alias("in_doc"),
            (F.contains(seen["code"], term) & ~name).alias("in_body"), (term.isin(*TYPE_HINTS) & (seen["kind"] == term) & core).alias("hint"),
            F.get(decorated, 0).alias("dec_no"),
        )

    seen = F.struct(
        F.lower("entity_name").alias("name"), split_identifier(F.col("entity_name")).alias("name_tokens"),
        split_identifier(F.coalesce("parent", F.lit(""))).alias("parent_tokens"), _path_tokens().alias("path_tokens"), text(F.col("signature")).alias("signature"),
        text(F.col("docstring")).alias("docstring"), text(F.col("code_content")).alias("code"), F.lower("entity_type").alias("kind"),
        F.coalesce("decorators", F.array().cast("array<string>")).alias("decorators"),
    )
    return bind(seen, lambda s: F.transform("terms", lambda t: match(t, s)))


def _reasons() -> Column:
    """Why a hit was found, from its ``matches``."""
    meta = F.col("meta")

    def n(flag: str) -> Column:
        return F.size(F.filter("matches", lambda m: m[flag]))

    def named(flag: str, top: int | None = None) -> Column:
        terms = F.array_sort(F.transform(F.filter("matches", lambda m: m[flag]), lambda m: m["term"]))
        return F.array_join(terms if top is None else F.slice(terms, 1, top), ", ")

    def quoted(c: Column) -> Column:
        return F.concat(F.lit("'"), c, F.lit("'"))

    exact = n("core_exact") > 0
    dec_no = F.array_min(F.transform("matches", lambda m: m["dec_no"]))
    listed = F.array_compact(
        F.array(
            F.when(exact, F.concat(F.lit("Exact match on "), meta["entity_type"], F.lit(" name "), quoted(meta["entity_name"])))
            .when(
                n("exact") > 0,
                F.concat(F.lit("Entity name "), quoted(meta["entity_name"]), F.lit(" matches concept "), quoted(named("exact", 1))),
            ),
            F.when(~exact & (n("in_name") > 0), F.concat(F.lit("Identifier parts matched: "), named("in_name"))),
            F.when(
                n("in_parent") > 0,
                F.concat(F.lit("Enclosing class "), quoted(meta["parent"]), F.lit(" matches: "), named("in_parent")),
            ),
            F.when(
                n("in_path") > 0,
                F.concat(F.lit("File path "), quoted(meta["file_path"]), F.lit(" matches keywords: "), named("in_path")),
            ),
            F.when(n("in_sig") > 0, F.concat(F.lit("Signature matches terms: "), named("in_sig", 3))),
            F.when(n("in_doc") > 0, F.concat(F.lit("Docstring mentions: "), named("in_doc", 3))),
            F.when(
                dec_no.isNotNull(),
                F.concat(F.lit("Decorator "), quoted(F.get("decorators", dec_no)), F.lit(" matches query terms")),
            ),
        )
    )
    body = F.when(
        (F.size(listed) == 0) & (n("in_body") > 0), F.array(F.concat(F.lit("Code body contains: "), named("in_body", 3)))
    ).otherwise(F.array().cast("array<string>"))
    hints = F.transform(
        F.filter("matches", lambda m: m["hint"]),
        lambda m: F.concat(F.lit("Matches requested entity type '"), m["term"], F.lit("'")),
    )
    return F.concat(listed, body, hints)


def explanation(meta: Column, reasons: Column) -> Column:
    """One sentence on why a chunk was returned."""
    kind = title_case(meta["entity_type"])
    place = F.concat(
        meta["file_path"], F.lit(":"), meta["start_line"].cast("string"), F.lit("-"), meta["end_line"].cast("string")
    )
    scope = F.coalesce(F.concat(F.lit(" in '"), F.nullif(meta["parent"], F.lit("")), F.lit("'")), F.lit(""))
    more = F.when(F.size(reasons) > 1, F.concat(F.lit(" ("), F.get(reasons, 1), F.lit(")"))).otherwise(F.lit(""))
    head = F.concat(kind, F.lit(" '"), meta["entity_name"], F.lit("'"))
    return F.when(
        F.size(reasons) == 0, F.concat(head, F.lit(" at "), place, F.lit(" contains relevant code keywords."))
    ).otherwise(
        F.concat(head, scope, F.lit(" ["), place, F.lit("] matches query: "), F.get(reasons, 0), more, F.lit("."))
    )


def rows_of_hits(chunks: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """The rows of ``chunks`` that were hit, written. Only the hits' keys go to the chunks: the texts of all others stay where they are."""
    keys = stored(hits.select(key).distinct(), "hit-keys")
    return stored(chunks.join(keys, key, "left_semi"), "hit-chunks")


def lexical_search(queries: DataFrame, chunks: DataFrame | Index, k: int = 10) -> DataFrame:
    """Unified hits: the k best chunks per query with reasons and an explanation. ``chunks``: a chunk table, or its index.

    Ranked by score, then entity type, then fewer tokens, then chunk id. Reasons are built for the ranked hits only, from
    their chunks' rows.
    """
    index = chunks if isinstance(chunks, Index) else indexed(chunks)
    terms = stored(query_terms(queries), "query-terms")
    asked = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "is_core"))).alias("terms"))
    # k rows a query, written
    hits = stored(_best_of_terms(queries, terms, index, k).join(asked, "query_id"), "lexical-hits")
    rows = rows_of_hits(index.chunks, hits, "chunk_no").join(hits, "chunk_no").select(
        "query_id", "rank", "chunk_id", "score", F.struct(*_META).alias("meta"), F.coalesce("decorators", F.array().cast("array<string>")).alias("decorators"),
        _matches().alias("matches"),
    )
    reasoned = rows.withColumn("reasons", _reasons())
    return reasoned.select(
        "query_id", "rank", "chunk_id", "score", F.lit("lexical").alias("search_mode"), "reasons",
        explanation(F.col("meta"), F.col("reasons")).alias("explanation"), "meta",
    )
