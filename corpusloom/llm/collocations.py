"""Phrase collocations: counts of phrases up to five words from padded longest windows, marginalised with ROLLUP.

At every word a window holds the word and those after it in its piece (the lead columns ``w2`` to ``w5``), padded with
nulls at the piece's end. Only such longest windows are counted. A phrase's occurrences are the windows that begin with it,
so ``ROLLUP (lang, w1, …, w5)`` sums them to the counts of all shorter prefixes, and no n-grams are exploded length by
length. A phrase cannot be frequent if a pair or triple in it is rare; so passes before it add up hashes of these, and windows
are padded from the first rare part on, too. The frequent parts travel as a bitmap of fixed size: equal hashes and
shared bits only leave a window longer than needed and never lose a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import stored

ORDER, MIN_COUNT, TOP = 5, 100, 2000
NO_LANGUAGE = "und"
#: Longest parts whose frequency bounds the windows.
PART = 3
#: Bits of the map of frequent parts (8 MB, whatever the corpus), and bytes of text counted at once.
PART_BITS, BLOCK_BYTES = 1 << 26, 4 << 20

# What parts pieces, what parts words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2

_ODD_1, _ODD_2, _ODD_3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Words:
    """The words of a block: ``ids`` into ``known``, ``piece`` numbers and ``lang`` numbers, in order."""

    def __init__(self, data: np.ndarray, kind: np.ndarray, starts: np.ndarray, doc_langs: np.ndarray):
        """``starts``: where documents begin in ``data``, the first at or before 0; ``doc_langs``: their languages' numbers."""
        word = kind == 0
        before, after = np.empty_like(word), np.empty_like(word)
        before[0], before[1:], after[-1], after[:-1] = False, word[:-1], False, word[1:]
        inner = starts[(starts > 0) & (starts < len(data))]
        before[inner] = False
        after[inner - 1] = False
        first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
        doc = np.searchsorted(starts, first, "right") - 1
        self.piece = np.cumsum(kind == 2)[first] + doc
        self.lang = doc_langs[doc]
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum(last - first + 1, out=offsets[1:])
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]
        coded = pa.LargeStringArray.from_buffers(len(first), buffers[1], buffers[2]).dictionary_encode()
        self.ids, self.known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        self.joined = self.piece[1:] == self.piece[:-1]

    def parts(self, lang_hash: np.ndarray, longest: int) -> list[np.ndarray]:
        """Hashes of language and words of the parts of 1, 2, … ``longest`` words that begin at each word."""
        word = _hashes(self.known.to_pylist())[self.ids]
        mixed = [_mix(word * _ODD_1 ^ lang_hash[self.lang])]
        for k in range(1, longest):
            mixed.append(_mix(mixed[-1][:-1] * _ODD_2 + word[k:]) if len(mixed[-1]) else mixed[-1])
        return mixed

    def whole(self, k: int) -> np.ndarray:
        """Whether the part of ``k`` words at each word lies in one piece."""
        n = max(0, len(self.ids) - k + 1)
        inside = np.ones(n, bool)
        for j in range(k - 1):
            inside &= self.joined[j : j + n]
        return inside


def _mix(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(31))) * _ODD_3


def _marked(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    at = hashed & np.uint64(PART_BITS - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _hashes(values: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(values, object), categorize=False) if values else np.zeros(0, np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, list[str], np.ndarray]]:
    """Words of the batches' texts with the names and hashes of their languages.

    Blocks end at the end of a piece, so a long document's memory is that of its text; only a piece is never cut.
    """
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        names = langs.dictionary.to_pylist()
        numbers, hashed = langs.indices.to_numpy(zero_copy_only=False), _hashes(names)
        texts = batch.column("text").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[-1] == offsets[0]:
            continue
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts, at = offsets[:-1] - offsets[0], 0
        while at < len(data):
            end = _block_end(data, starts, at)
            part = _LOWER[data[at:end]]
            # documents without text share a place with the next one; the last of them holds the text
            first = np.searchsorted(starts, at, "right") - 1
            final = np.searchsorted(starts, end, "left")
            words = _Words(part, _KIND[part], starts[first:final] - at, numbers[first:final])
            if len(words.ids):
                yield words, names, hashed
            at = end


def _block_end(data: np.ndarray, starts: np.ndarray, at: int) -> int:
    wanted = at + BLOCK_BYTES
    if wanted >= len(data):
        return len(data)
    ends = np.flatnonzero(_KIND[data[at:wanted]] == 2)
    inner = starts[(starts > at) & (starts <= wanted)]
    end = max(at + int(ends[-1]) + 1 if len(ends) else 0, int(inner[-1]) if len(inner) else 0)
    while not end:  # a piece longer than a block: up to its end
        stop = min(wanted + BLOCK_BYTES, len(data))
        ends = np.flatnonzero(_KIND[data[wanted:stop]] == 2)
        inner = starts[(starts > wanted) & (starts <= stop)]
        found = [wanted + int(e[0]) + k for e, k in ((ends, 1), (inner - wanted, 0)) if len(e)]
        end = min(found) if found else len(data) if stop == len(data) else 0
        wanted = stop
    return end


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    return docs.select(lang, F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)


def _counted(docs: DataFrame, size: int, min_count: int, shared) -> np.ndarray:
    """Bits of the parts of ``size`` words that occur ``min_count`` times; ``shared``: bits of those one word shorter, if known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if shared else None
        for words, _, hashed in _blocks(batches):
            parts, wanted = words.parts(hashed, size), words.whole(size)
            if shared:
                shorter = _marked(bits, parts[-2])
                wanted &= shorter[:-1] & shorter[1:]
            part, n = np.unique(parts[-1][wanted], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(n.astype(np.int64))], names=["part", "n"])

    counts = _texts(docs).mapInArrow(run, "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n"))
    bit = F.col("part").bitwiseAND(PART_BITS - 1)
    # at most PART_BITS / 64 rows reach the driver, whatever the corpus
    cells = (
        counts.filter(F.col("n") >= min_count).select(F.shiftright(bit, 6).alias("cell"), F.expr("shiftleft(1L, cast(part & 63 AS int))").alias("mask"))
        .groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    )
    found = np.zeros(PART_BITS // 64, np.uint64)
    found[cells["cell"].to_numpy()] = cells["mask"].to_numpy().view(np.uint64)
    return found


def frequent_parts(docs: DataFrame, min_count: int, longest: int = PART) -> np.ndarray:
    """Bits, at hashes modulo ``PART_BITS``, of pairs, triples, … of ``longest`` words that stand ``min_count`` times in a language.

    Each size is added up in a pass of its own, the longer ones only where both their shorter parts are frequent.
    """
    context = docs.sparkSession.sparkContext
    bits = _counted(docs, 2, min_count, None)
    for k in range(3, longest + 1):
        bits = bits | _counted(docs, k, min_count, context.broadcast(bits))
    return bits


def longest_windows(docs: DataFrame, order: int, frequent: np.ndarray, longest: int = PART) -> DataFrame:
    """``(lang, w1, …, wN, n)``: windows with their counts, padded after a piece's end and from the first rare part on."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    columns = [f"w{k + 1}" for k in range(order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for words, names, hashed in _blocks(batches):
            n = len(words.ids)
            usual = []  # per size from 2, whether the part at a word is whole and frequent
            for k, part in enumerate(words.parts(hashed, longest)[1:], 2):
                usual.append(np.concatenate([words.whole(k) & _marked(bits, part), np.zeros(n - len(part), bool)]))
            open_, leads = np.ones(n, bool), []
            for j in range(order):
                for k in range(2, min(longest, j + 1) + 1):  # the parts that end with the window's word j
                    open_ = open_ & np.concatenate([usual[k - 2][j - k + 1 :], np.zeros(min(n, j - k + 1), bool)])
                leads.append(np.where(open_, np.concatenate([words.ids[j:], np.zeros(min(n, j), words.ids.dtype)]), -1))
            table = pa.table([pa.array(words.lang), *map(pa.array, leads)], names=["lang", *columns])
            counted = table.group_by(["lang", *columns], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            known = words.known.cast(pa.string())
            out = [pa.array(names, pa.string()).take(counted["lang"].combine_chunks())]
            for c in columns:
                ids = counted[c].combine_chunks().to_numpy()
                out.append(known.take(pa.array(ids, mask=ids < 0)))
            out.append(counted["count_all"].combine_chunks().cast(pa.int64()))
            yield pa.RecordBatch.from_arrays(out, names=["lang", *columns, "n"])

    windows = _texts(docs).mapInArrow(run, "lang string, " + ", ".join(f"{c} string" for c in columns) + ", n bigint")
    return windows.groupBy("lang", *columns).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """``(lang, words, phrase, f)``: every phrase of 1 to ``order`` words that occurs ``min_count`` times in its language.

    ``words`` = 0 is a language's row with all its word occurrences and an empty phrase. ``docs``: ``text``, ``lang`` (null:
    ``und``); null and empty texts have no words; repeated rows count each; an empty table gives no rows.
    """
    columns = [f"w{k + 1}" for k in range(order)]
    windows = longest_windows(docs, order, frequent_parts(docs, min_count))
    sums = windows.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # a prefix of k words has the low order - k bits set; one that ends in padding is a shorter phrase, counted as such
    level = F.lit(None).cast("int")
    for k in range(order + 1):
        here = F.col("level") == (1 << (order - k)) - 1
        level = F.when(here & (F.col(columns[k - 1]).isNotNull() & (F.col("f") >= min_count) if k else here), k).otherwise(level)
    phrase = F.concat_ws(" ", *columns)
    return sums.withColumn("words", level).filter("words is not null").select("lang", "words", phrase.alias("phrase"), "f")


def cut_score() -> Column:
    """``floor(1000 a n / (l r))`` of the columns of these names, exact while the products have 38 digits at most."""
    wide = {c: f"cast({c} AS decimal(19, 0))" for c in "alrn"}
    return F.expr(f"(cast(1000 AS decimal(4, 0)) * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})")


def collocations(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``order`` words: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` occurrences of the phrase, ``l`` and ``r`` of the two parts of its weakest cut, ``n`` words of the language; the score
    is that of :func:`cut_score`. A phrase that a longer one contains as often as it occurs is left
    out. Ties go by ``a``, then by the phrase's bytes. Rows without words, and tables without rows, give nothing.
    """
    counts = stored(phrase_counts(docs, order, min_count), "phrase-counts")
    known = counts.filter("words > 0").select("lang", "phrase", "f")
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    found = counts.filter("words > 1").select("lang", "words", "phrase", F.split("phrase", " ", -1).alias("parts"), F.col("f").alias("a"))
    cut = found.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select(
        "lang", "words", "phrase", "a", "k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    )
    cut = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cut = cut.join(totals, "lang")
    cut = stored(cut.withColumn("score", cut_score()), "phrase-cuts")

    # one word less at either end suffices: what lies between a phrase and a longer one of its count has that count, too
    begun = cut.filter("words > 2 AND k = words - 1 AND a >= l").select("lang", F.col("first").alias("phrase"))
    ended = cut.filter("words > 2 AND k = 1 AND a >= r").select("lang", F.col("rest").alias("phrase"))
    weakest = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    kept = weakest.join(begun.unionByName(ended).distinct(), ["lang", "phrase"], "left_anti")
    order_by = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order_by).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")
