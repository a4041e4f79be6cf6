import random
import zlib
from array import array
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_cache_equals_the_library():
    library, words, rng = Tokenizer.from_file(PATH), packing.WordTokens(PATH), random.Random(3)
    parts = ["a", "B", " ", "\n", "Don't", "'s", "'", "1", "23", "é", "É", "ß", "İ", "漢", "🙂", " ", "\x1c", "\x85", "<|endoftext|>",
             "!!", "The", " in", "ing", "\t", "Σ", "\xa0", "...", "x-y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    assert [list(array("I", b)) for b in words.encode(pa.array(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("draw", [
    lambda r: r.randint(1, 4096), lambda r: r.randint(50, 600), lambda r: r.choice([100, 3000, 1096, 2048, 700]), lambda r: 4096, lambda r: 2049, lambda r: 1,
])
def test_plan_holds_every_piece_once_and_is_tight(draw):
    rng = random.Random(8)
    counts = Counter(draw(rng) for _ in range(5000))
    plan = packing.plan_bins(counts)
    held = Counter()
    for pattern, repeats in plan:
        assert sum(pattern) <= 4096 and repeats > 0
        for x in pattern:
            held[x] += repeats
    assert held == counts
    large = sum(n for x, n in counts.items() if 2 * x > 4096)
    bound = max(large, -(-sum(x * n for x, n in counts.items()) // 4096))
    assert sum(r for _, r in plan) <= bound * 1.02 + 1


def test_exact_complements_are_used():
    assert packing.plan_bins({3000: 2, 1096: 2}) == [((3000, 1096), 2)]
    assert packing.plan_bins({2000: 1, 1500: 1, 596: 1, 600: 1}) [0] == ((2000, 1500, 596), 1)
    assert packing.plan_bins({2500: 1, 800: 1, 500: 1, 296: 1, 400: 1})[0] == ((2500, 800, 500, 296), 1)
    assert packing.plan_bins({}) == []


def test_pieces_are_placed_without_gaps(odd_docs, no_docs):
    rows = packing.pack(odd_docs, PATH, capacity=64).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        want += [(r.doc_id, k, a, len(ids[a : a + 64]), zlib.crc32(array("I", ids[a : a + 64]).tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == order(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(no_docs, PATH).count() == 0


def test_words_remembered_are_bounded():
    """Two tasks of the pipeline share an executor: what a task remembers of distinct words stays small, and ids stay right."""
    tokens = packing.WordTokens(PATH)
    for part in range(6):
        tokens.encode(pa.array([" ".join(f"w{i}" for i in range(a, a + 500)) for a in range(part * 50_000, (part + 1) * 50_000, 500)]))
        assert len(tokens.known) <= 200_010
    text = "w7 of w299999, and w123456."
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert tokens.encode(pa.array([text]))[0] == array("I", want).tobytes()
