"""Best-fit packing of tokenized documents with exact-complement look-up.

Packing depends on lengths only, and there are no more lengths than ``capacity``: Spark counts the pieces of each length,
the driver plans on these at most ``capacity`` numbers, and Spark gives every piece its place by its rank among the pieces
of its length. The plan is a list of patterns with repeats. A bin begins with the longest length left; its gap is closed
exactly by one, two or three available lengths where their sums allow, as often as the counts allow; else the longest
length that fits goes in, and the rest of the gap is tried again. The ranking is salted, so a length that a third of all
pieces share is spread over many groups, and no document's tokens are shuffled.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from corpusloom.llm.common import slice_end, stored

CAPACITY = 4096
END_ID = 1
SALTS, ROWS_PER_SALT = 32, 100_000

# ---- tokens ---------------------------------------------------------------------------------------------------------

# Fixed value: the piece pattern in the vocabulary's file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts with characters that the library's normalizer may treat otherwise than Arrow's lower case and split, or with marks
#: of special tokens, go to the library whole.
UNUSUAL = "[\x1c-\x1f\u0130\u0180-\U0010ffff]|<\\|"
POINTS = frozenset(".,;:!?")
#: Words a task remembers, and bytes of text it encodes at once: two tasks share an executor with the pipeline's other stages.
CACHED_WORDS, MAX_SLICE = 200_000, 2 << 20


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class WordTokens:
    """Ids of texts, by a bounded cache of the ids of their blank-separated words and of the pieces of these.

    Blanks never lie within a token and every piece's last token carries the word-end mark, so the ids of many new pieces
    encoded as one text fall apart at those marks. Pieces are normalized and split already, so they are encoded by a copy
    of the tokenizer that does neither again.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Per text its ids as packed little-endian unsigned 32-bit numbers."""
        odd = pc.match_substring_regex(texts, UNUSUAL)
        words = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts)))
        coded = words.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        packed = list(map(self.known.get, distinct))
        missing = {w for w, p in zip(distinct, packed) if p is None}
        if missing:
            if len(self.known) + len(missing) > CACHED_WORDS:
                self.known = {"": b""} | {w: p for w, p in zip(distinct, packed) if p is not None}
            self._learn(missing)
            packed = [self.known[w] if p is None else p for w, p in zip(distinct, packed)]
        # the tokens of all words in a row, taken from those of the distinct words
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        tokens, starts = np.frombuffer(b"".join(packed), np.uint32), np.concatenate([[0], np.cumsum(sizes)])[:-1]
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = tokens[np.repeat(starts[which] - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        out = [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = array("I", self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids).tobytes()
        return out

    def _learn(self, missing: set[str]) -> None:
        new = set(filter(str.isalpha, missing))  # a word of letters is one piece
        split = {w: (w[:-1], w[-1]) if w[-1] in POINTS and w[:-1].isalpha() else PIECES.findall(w) for w in missing - new}
        new = list(new.union(*split.values()).difference(self.known))
        if new:
            ids = np.array(self.model.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
            stops, packed = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), ids.tobytes()
            self.known.update(zip(new, map(packed.__getitem__, map(slice, [0, *stops], stops))))
        look_up = self.known.__getitem__
        self.known.update([(w, b"".join(map(look_up, parts))) for w, parts in split.items()])


PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row's ids, which end with ``end_id``: cut at ``capacity`` only where the document is longer.

    A null or empty text is the end id alone. ``path``: a tokenizer file, present on every executor.
    """
    end, limit = array("I", [end_id]).tobytes(), 4 * capacity
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        for batch in batches:
            ids, texts, start = batch.column(0).to_pylist(), batch.column(1), 0
            while start < batch.num_rows:
                stop = slice_end(texts, start, 2048, MAX_SLICE)
                rows = []
                for doc_id, packed in zip(ids[start:stop], tokens.encode(texts.slice(start, stop - start))):
                    packed += end
                    for k, at in enumerate(range(0, len(packed), limit)):
                        part = packed[at : at + limit]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                start = stop

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, PIECE_SCHEMA)


# ---- the plan -------------------------------------------------------------------------------------------------------


class LengthIndex:
    """Available lengths with their counts, and which sums of one or two of them there are, as bits of a number."""

    def __init__(self, counts: dict[int, int]):
        self.counts = Counter({length: n for length, n in counts.items() if n > 0})
        self.lengths = sorted(self.counts, reverse=True)
        self.singles = self.pairs = 0
        self._index()

    def _index(self) -> None:
        self.singles = sum(1 << x for x in self.lengths)
        self.pairs = 0
        for x in self.lengths:
            self.pairs |= self.singles << x

    def longest(self, gap: int, taken: Counter) -> int | None:
        return next((x for x in self.lengths if x <= gap and self.counts[x] > taken[x]), None)

    def complement(self, gap: int, taken: Counter) -> tuple[int, ...] | None:
        """One, two or three lengths that add up to ``gap`` and are available beside ``taken``; the longest first."""

        def free(*combination: int) -> bool:
            return all(self.counts[x] - taken[x] >= n for x, n in Counter(combination).items())

        if self.singles >> gap & 1 and free(gap):
            return (gap,)
        if self.pairs >> gap & 1:
            for x in self.lengths:
                if 2 * x < gap:
                    break
                if x < gap and self.singles >> (gap - x) & 1 and free(x, gap - x):
                    return (x, gap - x)
        for x in self.lengths:
            if 3 * x < gap:
                break
            if x < gap and self.pairs >> (gap - x) & 1:
                for y in self.lengths:
                    z = gap - x - y
                    if y > x or z > y or z <= 0:
                        if z > y:
                            break
                        continue
                    if self.singles >> z & 1 and free(x, y, z):
                        return (x, y, z)
        return None

    def consume(self, pattern: tuple[int, ...]) -> int:
        """Take the pattern as often as the counts allow."""
        uses = Counter(pattern)
        repeats = min(self.counts[x] // n for x, n in uses.items())
        for x, n in uses.items():
            self.counts[x] -= repeats * n
            if not self.counts[x]:
                del self.counts[x]
        if any(x not in self.counts for x in uses):
            self.lengths = [x for x in self.lengths if x in self.counts]
            self._index()
        return repeats


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths of a bin, how many such bins)``; every counted piece is in one. Each step uses up a length's count."""
    index, out = LengthIndex(counts), []
    while index.lengths:
        pattern, taken = [index.lengths[0]], Counter([index.lengths[0]])
        gap = capacity - pattern[0]
        while gap > 0:
            fit = index.complement(gap, taken)
            if fit is None:
                one = index.longest(gap, taken)
                if one is None:
                    break
                fit = (one,)
            pattern += fit
            taken.update(fit)
            gap -= sum(fit)
        out.append((tuple(pattern), index.consume(tuple(pattern))))
    return out


def slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows ``(length, first rank, first sequence, offset)``, sorted: ranks of a length from ``first rank`` on stand in
    successive sequences from ``first sequence`` on, at ``offset``."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, repeats in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += repeats
            offset += length
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# ---- the operator ---------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null texts count as empty and take one token; rows that repeat an id are documents of their own; other columns are not
    returned; an empty table gives no rows. The pieces, without their tokens, are written to the shared folder once.
    """
    pieces = stored(token_pieces(docs, path, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = slots(plan_bins(counts, capacity))
    salts = max(SALTS, -(-max(counts.values(), default=0) // ROWS_PER_SALT))

    group = ["length", "_salt"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*group).orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(firsts, group)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_first")).alias("_rank"))
    keys, names = (places[:, 0] << 44) | places[:, 1], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            slot = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            sequence, offset = places[slot, 2] + rank - places[slot, 1], places[slot, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(place, f"{PIECE_SCHEMA}, sequence_id bigint, offset bigint")
