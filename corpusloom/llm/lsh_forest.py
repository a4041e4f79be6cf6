"""Near-duplicates by an LSH forest of MinHash signatures, with links confirmed on the full shingle sets.

1. Every text is read once: distinct shingles as 64-bit hashes, their number, a fingerprint of the set, and a signature of
   ``HASHES`` one-byte minima. Documents with the same set fall together at once; the smallest id stands for them.
2. The forest: in each of ``TREES`` orders the signatures, rotated to begin at another hash, are sorted over the whole
   table. Neighbours have the longest common prefix with each other, as deep as their region is dense, so no prefix length
   is fixed and no bucket can overflow. Neighbours whose whole signatures agree well enough to be possible links are
   candidates; a document has at most ``2 * REACH`` of them per tree.
3. Every document's best two candidates are confirmed on the full sets, which gives components.
4. The rest is exact: candidates, confirmed or not, tie documents into clusters. Where a cluster has several components,
   each document outside the largest one is compared on full sets with every other document of the cluster. This is done
   in blocks of bounded size; in a block the postings of the shingles count the intersections of one set with all others.
   What is emitted is one link per pair of components.

Nothing is collected to the driver, and no step emits the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.common import slice_end, stored
from corpusloom.operators.graph import salted_join

SHINGLE, PERCENT = 5, 80
HASHES, TREES, REACH = 64, 16, 2
#: A pair stays a candidate if its estimated similarity is within so many standard deviations of the threshold.
DEVIATIONS = 4.5
BEST = 2
#: Shingles per side of a block.
BLOCK_SHINGLES = 100_000
#: Bits of the map of ids whose sets are needed (16 MB).
MAX_FILTER_BITS = 1 << 27

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---- sets and signatures --------------------------------------------------------------------------------------------


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word windows; of the whole word sequence where it is shorter; none without words.

    Words stand between the blanks 0x20 and 0x09-0x0D, after A-Z are lower-cased: what bytes' own split and lower do.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * _STEP + w[j : len(w) - k + 1 + j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(hashes: np.ndarray) -> bytes:
    """One byte of the minimum under each of ``HASHES`` orders of the hashes."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[a : a + 2048, None] ^ _MASKS) * _FACTORS).min(axis=0))
    return (least >> np.uint64(20)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, fingerprint, signature`` per row; the last two are null for an empty set."""
    names = ["doc_id", "n_shingles", "fingerprint", "signature"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, start = batch.column(0).to_pylist(), batch.column(1), 0
            while start < batch.num_rows:
                stop, rows = slice_end(texts, start), []
                for doc_id, text in zip(ids[start:stop], texts.slice(start, stop - start).to_pylist()):
                    h = shingle_set(text, size)
                    rows.append((doc_id, len(h), xxhash.xxh3_128_digest(h.tobytes()), signature(h)) if len(h) else (doc_id, 0, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                start = stop

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, fingerprint binary, signature binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shingle_sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """``node, set``: the full shingle set, sorted, of every row whose id is in ``wanted(node)``.

    The wanted ids become a bit map of bounded size, with which the tasks leave out most other rows where they stand, so
    that only few sets are moved for the join with ``wanted`` that decides. With more ids than the map can tell apart it
    only leaves out less.
    """
    count = wanted.count()
    bits = min(MAX_FILTER_BITS, max(1 << 10, 1 << (16 * count).bit_length()))
    slots = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(bits)).alias(f"slot{k}") for k in range(2)]
    marks = wanted.select(F.explode(F.array(*slots)).alias("slot"))
    words = marks.groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()  # at most MAX_FILTER_BITS / 64 numbers

    def marked(slot: np.ndarray) -> np.ndarray:
        return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = marked(batch.column(2).to_numpy()) & marked(batch.column(3).to_numpy())
            batch = batch.filter(pa.array(keep))
            ids, texts, start = batch.column(0), batch.column(1), 0
            while start < batch.num_rows:
                stop = slice_end(texts, start)
                sets = [shingle_set(t, size).view(np.int64) for t in texts.slice(start, stop - start).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), arrays], names=["node", "set"])
                start = stop

    texts = _texts(docs).filter("doc_id is not null").withColumnRenamed("doc_id", "node").select("node", "text", *slots)
    return texts.mapInArrow(run, "node bigint, set array<bigint>").join(wanted, "node", "left_semi")


# ---- the forest -----------------------------------------------------------------------------------------------------


def least_agreement(percent: int) -> int:
    """Equal bytes from which on a pair of signatures may belong to sets of the threshold's similarity."""
    s = percent / 100
    return max(1, int(np.floor(HASHES * (s - DEVIATIONS * (s * (1 - s) / HASHES) ** 0.5))))


def forest_candidates(signed: DataFrame, percent: int) -> DataFrame:
    """``a, b, agreement`` with ``a < b``: pairs of ``signed(node, signature)`` that are near in some order."""
    width, least = HASHES // TREES, least_agreement(percent)
    rotated = F.array(*[
        F.struct(F.lit(t).alias("tree"), F.concat(F.substring("signature", t * width + 1, HASHES), F.substring("signature", 1, t * width)).alias("key"))
        for t in range(TREES)
    ])
    rows = signed.select("node", F.explode(rotated).alias("r")).select("r.tree", "r.key", "node")
    ordered = rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_tree, tail_key, tail_node = np.empty(0, np.int32), np.empty((0, HASHES), np.uint8), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = np.concatenate([tail_tree, batch.column(0).to_numpy()])
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, HASHES)
            keys, node = np.concatenate([tail_key, keys]), np.concatenate([tail_node, batch.column(2).to_numpy()])
            found, new = [], len(tail_node)
            for d in range(1, REACH + 1):
                later = np.arange(max(d, new), len(node))  # pairs within the tail were seen before
                agree = (keys[later] == keys[later - d]).sum(axis=1)
                good = (agree >= least) & (tree[later] == tree[later - d]) & (node[later] != node[later - d])
                x, y = node[later][good], node[later - d][good]
                found.append((np.minimum(x, y), np.maximum(x, y), agree[good].astype(np.int32)))
            tail_tree, tail_key, tail_node = tree[-REACH:], keys[-REACH:], node[-REACH:]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b", "agreement"])

    return ordered.mapInArrow(run, "a bigint, b bigint, agreement int").groupBy("a", "b").agg(F.max("agreement").alias("agreement"))


# ---- components -----------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)``; the component is its smallest node.

    Each round lowers a node's parent to the least grandparent among its neighbours, lets a root follow its members, and
    shortcuts to the grandparent; rounds grow with the logarithm of the longest path. Every round is written to the shared
    folder. Joins on a parent, which many nodes may share, are salted.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    state = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("parent"))
    state = stored(_with_grandparents(state), "components")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near"))
        seen = state.withColumnRenamed("grand", "was").join(near, "node")
        roots = seen.groupBy(F.col("parent").alias("node")).agg(F.min("near").alias("pull"))
        lowered = seen.join(roots, "node", "left").select("node", F.least("parent", "was", "near", F.coalesce("pull", "near")).alias("parent"), "was")
        state = stored(_with_grandparents(lowered), "components")
        if not state.filter("grand <> was").limit(1).count():
            return state.select("node", F.col("grand").alias("component"))
        state = state.drop("was")


def _with_grandparents(state: DataFrame) -> DataFrame:
    up = state.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return salted_join(state, up, ["parent"], ["node"], "inner")


# ---- links ----------------------------------------------------------------------------------------------------------


def confirmed_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are as similar as ``percent`` asks."""
    x, y = F.col("set_a"), F.col("set_b")
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    common = F.size(F.array_intersect(x, y))
    both = both.select("a", "b", common.alias("common"), (F.size(x) + F.size(y)).alias("total"))
    return both.filter(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b").distinct()


def remaining_links(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """One link ``(a, b)`` per pair of linked components within a cluster, found in bounded blocks.

    ``nodes``: ``node, cluster, component``. Clusters of one component, and those of two nodes, which were confirmed, are
    done. Of the others, all nodes are members of blocks; those outside the largest component are also probes.
    """
    sizes = sets.select("node", F.size("set").cast("bigint").alias("n"))
    sized = nodes.join(sizes, "node")
    parts = sized.groupBy("cluster", "component").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    open_ = (
        parts.groupBy("cluster")
        .agg(F.max(F.struct("docs", "component"))["component"].alias("main"), F.count("*").alias("parts"), F.sum("docs").alias("docs"),
             F.sum("n").alias("n"), F.max(F.struct("docs", "n"))["n"].alias("main_n"))
        .filter((F.col("parts") > 1) & (F.col("docs") > 2))
        .select("cluster", "main", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int").alias("blocks"),
                F.ceil((F.col("n") - F.col("main_n")) / BLOCK_SHINGLES).cast("int").alias("chunks"))
    )
    todo = salted_join(nodes, open_, ["cluster"], ["node"], "inner").join(sets, "node")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    columns = ["cluster", "node", "component", "set"]
    members = todo.select(*columns, F.lit(False).alias("probe"), mine(F.col("blocks")).alias("block"), spread(F.col("chunks")).alias("chunk"))
    probes = todo.filter("component <> main").select(*columns, F.lit(True).alias("probe"), mine(F.col("chunks")).alias("chunk"), spread(F.col("blocks")).alias("block"))

    def run(block: pa.Table) -> pa.Table:
        found = block_links(*(block.column(c).combine_chunks() for c in ("node", "component", "probe", "set")), percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return members.unionByName(probes).groupBy("cluster", "block", "chunk").applyInArrow(run, "a bigint, b bigint").distinct()


def block_links(node: pa.Array, component: pa.Array, probe: pa.Array, sets: pa.Array, percent: int) -> list[tuple[int, int]]:
    """Links between a block's probes and its members of other components, one per pair of components."""
    node, component, probe = node.to_numpy(), component.to_numpy(), probe.to_numpy(zero_copy_only=False)
    bounds, values = sets.offsets.to_numpy(), sets.values.to_numpy()
    sizes = np.diff(bounds)
    members, out, done = np.flatnonzero(~probe), [], set()
    if not len(members):
        return out
    shingles = np.concatenate([values[bounds[m] : bounds[m + 1]] for m in members])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], np.repeat(np.arange(len(members)), sizes[members])[order]
    for p in np.flatnonzero(probe):
        mine = values[bounds[p] : bounds[p + 1]]
        first, last = np.searchsorted(shingles, mine, "left"), np.searchsorted(shingles, mine, "right")
        count, starts = last - first, np.concatenate([[0], np.cumsum(last - first)[:-1]])
        at = np.repeat(first - starts, count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=len(members))
        linked = (100 * common >= percent * (sizes[members] + sizes[p] - common)) & (component[members] != component[p])
        for m in members[linked]:
            pair = (min(component[p], component[m]), max(component[p], component[m]))
            if pair not in done:
                done.add(pair)
                out.append((int(min(node[p], node[m])), int(max(node[p], node[m]))))
    return out


# ---- the operator ---------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs(doc_id, text)``.

    Two documents are linked if ``100 * |intersection| >= percent * |union|`` of their shingle sets. ``component_id`` is the
    smallest id that links lead to; ``kept`` marks it. A null text, or one without words, has an empty set, is linked with
    nothing and kept. A row with a null id takes no part: its component is null and it is kept. Rows that repeat an id are
    the same document: what links one links all, and they are kept or not together. An empty table gives no rows.
    """
    signed = stored(signatures(docs, size), "signatures")
    usable = signed.filter("doc_id is not null and fingerprint is not null")
    groups = usable.groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("signature").alias("signature"))
    groups = stored(groups, "sets")
    candidates = stored(forest_candidates(groups.select("node", "signature"), percent), "candidates")
    # only documents with a candidate need their sets
    wanted = stored(candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets = stored(shingle_sets(docs, size, wanted), "shingles")
    # copies have the same set, whichever of them the forest has met; an id that has two sets is linked by either
    directed = candidates.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "agreement", "a", "b")
    rank = Window.partitionBy("p.x").orderBy(F.desc("agreement"), "p.y")
    best = directed.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= BEST).select("a", "b").distinct()
    links = stored(confirmed_links(best, sets, percent), "links")
    linked = components(links)
    nodes = stored(wanted.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")

    def contracted(edges: DataFrame) -> DataFrame:
        """Edges between the components that the nodes of ``edges`` are in."""
        label = lambda side: nodes.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component"))
        joined = edges.select("a", "b").join(label("a"), "a").join(label("b"), "b")
        return joined.select(F.col("a_component").alias("a"), F.col("b_component").alias("b")).filter("a <> b").distinct()

    # components that candidates tie together, and what the exact comparison joins of them: both graphs are small
    clusters = components(contracted(candidates)).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    rest = stored(remaining_links(salted_join(nodes, clusters, ["component"], ["node"], "inner"), sets, percent), "links")
    merged = components(contracted(rest)).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    ends = salted_join(nodes, merged, ["component"], ["node"], "left")
    final = ends.select("node", F.coalesce("merged", "component").alias("component")).filter("node <> component")

    copies = groups.filter("n > 1").select("fingerprint", "node")
    placed = salted_join(signed, copies, ["fingerprint"], ["doc_id"], "left").select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node"))
    placed = salted_join(placed, final, ["node"], ["doc_id"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
