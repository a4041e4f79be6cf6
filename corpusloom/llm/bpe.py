"""Byte-level BPE as a streaming transducer, and its inverse.

Encoding walks through a text in blocks that end where a piece surely ends, and through a long piece in windows. How far
ahead a merge can depend on what follows is a property of the merge list: ``sufficient_lookahead`` computes a bound once.
Tokens of a window that end at least that far before its end are stable; they are emitted, and the next window begins
after them. So what a merge looks at does not grow with the text; pieces of up to 256 characters are merged whole, and a
row's ids are joined at its end. Decoding maps ids to bytes and turns bytes into text with a machine
whose state is the unfinished character. Both are per-row work without a shuffle.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from corpusloom.llm.common import score_texts, slice_end

# The piece pattern of this vocabulary's family and the printable stand-ins of bytes in its file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BLANKS = r"\t-\r \x85\xa0  -     　"
#: Coarser than pieces: a run of non-blanks with at most one blank before it holds whole pieces.
RUNS = re.compile(rf" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
RUN_END = re.compile(rf"(?<=[^{BLANKS}])(?=[{BLANKS}])")

SHIFT, MASK, NEVER = 20, (1 << 20) - 1, 1 << 62
BLOCK_CHARS = 1 << 16
#: Entries of the two caches of a task.
CACHED_RUNS, CACHED_PIECES = 600_000, 300_000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary and merge list of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_characters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.byte_id[b[0]] = i
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        #: a pair of ids, packed, and its rank with the id it becomes, packed so that the lower rank is the lower number
        self.table: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            self.table.setdefault(vocab[a] << SHIFT | vocab[b], rank << SHIFT | vocab[a + b])
        self.lookahead = sufficient_lookahead(self)
        self.window = max(256, 4 * self.lookahead)

    def merge(self, data: bytes) -> list[int]:
        """Tokens of the whole of ``data``: the pair of lowest rank is merged, from the left, until none is left."""
        ids = [self.byte_id[b] for b in data]
        get = self.table.get
        ranks = [get(a << SHIFT | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i, new = ranks.index(best), best & MASK
            ids[i] = new
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << SHIFT | ids[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(ids[i - 1] << SHIFT | new, NEVER)
        return ids

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Tokens of ``data`` in lists, each from a window; only stable tokens leave a window that is not the last."""
        at = 0
        while len(data) - at > self.window:
            stable, end = [], 0
            for token in self.merge(data[at : at + self.window]):
                end += len(self.bytes_of[token])
                if end > self.window - self.lookahead:
                    break
                stable.append(token)
                at += len(self.bytes_of[token])
            yield stable
        yield self.merge(data[at:])


def sufficient_lookahead(merges: Merges) -> int:
    """Bytes after a token's end beyond which nothing can change it.

    Whether ``(u, v)`` merges at a place depends on ``v`` standing there: on its own bytes, and on no earlier merge having
    taken ``v``, or the token with which ``v`` begins, away to the right. Such a merge ``(s, w)`` has a lower rank, ``s``
    begins where ``v`` begins, and depends in turn on what follows ``s``. Going through the list by rank, the reach of a
    merge is the largest of the length of ``v`` and of ``len(s)`` plus the reach of each such earlier merge.
    """
    begins: dict[int, set[int]] = {}  # token: the tokens it can begin with when it is put together
    reach: dict[int, int] = {}  # left token: largest reach of the merges so far
    for pair, made in sorted(merges.table.items(), key=lambda x: x[1]):
        u, v = pair >> SHIFT, pair & MASK
        far, seen, todo = len(merges.bytes_of[v]), {v}, [v]
        while todo:
            s = todo.pop()
            if s in reach:
                far = max(far, len(merges.bytes_of[s]) + reach[s])
            for t in begins.get(s, ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach[u] = max(reach.get(u, 0), far)
        begins.setdefault(made & MASK, set()).add(u)
    return max(reach.values(), default=0)


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    return Merges(path)


class _Bounded(dict):
    """A cache of two generations: when the young one is full it becomes the old one, so entries in use stay."""

    def __init__(self, limit: int, make):
        self.limit, self.make, self.old = limit // 2, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids as packed little-endian unsigned 32-bit numbers, block by block."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pieces = _Bounded(CACHED_PIECES, self._piece)
        self.runs = _Bounded(CACHED_RUNS, self._run)
        self.special = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def _piece(self, piece: str) -> bytes:
        return array("I", self.merges.merge(piece.encode("utf-8", "replace"))).tobytes()

    def _run(self, run: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(run)))

    def blocks(self, text: str) -> Iterator[bytes]:
        """Special tokens of the vocabulary are themselves wherever their text stands, as the library has it."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._plain(text, at, m.start())
            yield array("I", [self.merges.special[m.group()]]).tobytes()
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        while at < end:
            stop = min(at + BLOCK_CHARS, end)
            if stop < end:
                # a run of non-blanks ends a piece for certain: cut at the last one in the block, or at the next
                inside = None
                for inside in RUN_END.finditer(text, at + 1, stop):
                    pass
                found = inside or RUN_END.search(text, stop, end)
                stop = found.start() if found else end
            if stop - at <= 2 * BLOCK_CHARS:
                runs = RUNS.findall(text, at, stop)
                if len(max(runs, key=len)) <= 256:
                    yield b"".join(map(self.runs.__getitem__, runs))
                    at = stop
                    continue
            for m in PIECES.finditer(text, at, stop):
                piece = m.group()
                if len(piece) <= 256:
                    yield self.pieces[piece]
                else:
                    for tokens in self.merges.stream(piece.encode("utf-8", "replace")):
                        yield array("I", tokens).tobytes()
            at = stop


class Decoder:
    """Bytes of ids to text; the state is the beginning of a character whose other bytes have not come yet."""

    def __init__(self, merges: Merges):
        self.bytes_of, self.open = merges.bytes_of, b""

    def feed(self, ids) -> str:
        data = self.open + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:  # begins a character of two to four bytes
                if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    cut -= back
                break
            if lead < 0x80:
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open.decode("utf-8", "replace"), b""
        return rest


def encode(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """``keep``, ``n_tokens`` and ``ids`` of every row; ``ids`` is binary, little-endian unsigned 32-bit numbers.

    A null or empty text has no tokens. Repeated rows are encoded alike. ``path``: a tokenizer file, present on every
    executor.
    """

    def scorer():
        encoder = Encoder(load(path))

        def run(texts: list[str]) -> list[pa.Array]:
            ids = [b"".join(encoder.blocks(t)) for t in texts]
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

        return run

    return score_texts(docs, list(keep), scorer, "n_tokens bigint, ids binary")


def decode(tokens: DataFrame, path: str, *keep: str) -> DataFrame:
    """``keep`` and ``text``, the decoded ``ids`` of every row; special tokens are kept. Null ids give empty text."""
    kept = tokens.select(*keep, F.coalesce(F.col("ids"), F.lit(b"")).alias("_ids"))
    n, step = len(keep), 1 << 15

    def text_of(decoder: Decoder, packed: bytes) -> str:
        ids = array("I", packed)
        return "".join([*(decoder.feed(ids[a : a + step]) for a in range(0, len(ids), step)), decoder.close()])

    def run(batches):
        decoder = Decoder(load(path))
        for batch in batches:
            ids, start = batch.column(n), 0
            while start < batch.num_rows:
                stop = slice_end(ids, start)
                texts = pa.array([text_of(decoder, x) for x in ids.slice(start, stop - start).to_pylist()], pa.string())
                columns = [batch.column(i).slice(start, stop - start) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*columns, texts], names=[*keep, "text"])
                start = stop

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("text", T.StringType())]))
