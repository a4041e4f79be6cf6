import hashlib
import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "e", "t", "'s", "'", "1", "é", "ß", "漢", "字", "🙂", " ", "\x1c", "\x85", "<|endoftext|>", "!!",
         "the", " in", "ing", "\t", "K", "İ", "́", "\xa0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(PATH))


def ids_of(encoder, text):
    return list(array("I", b"".join(encoder.blocks(text))))


def test_equals_the_library_on_random_texts(encoder, library):
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text", [
    "a" * 3000, "ab" * 4000, "-" * 2000 + "=" * 2000, "漢字かな交じり文" * 2000, " " * 5000 + "x", "\n" * 70_000 + "a b" + " " * 70_000,
    "word " * 40_000, ("x" * 70_000 + " ") * 2, "".join(random.Random(5).choice("etaoin") for _ in range(9000)),
])
def test_long_pieces_and_blocks(encoder, library, text):
    assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_windows_give_the_tokens_of_the_whole(encoder):
    merges, rng = encoder.merges, random.Random(6)
    window = merges.window
    try:
        for extra in (130, 200):
            merges.window = merges.lookahead + extra
            for _ in range(40):
                data = "".join(rng.choice(["a", "in", "ing", "th", "the", "er", "on", "-", "aa", "0"]) for _ in range(500)).encode()
                assert [t for part in merges.stream(data) for t in part] == merges.merge(data)
    finally:
        merges.window = window


def test_decoder_keeps_unfinished_characters():
    merges = bpe.load(PATH)
    decoder, text = bpe.Decoder(merges), "é漢🙂a"
    parts = [decoder.feed([merges.byte_id[b]]) for b in text.encode()]
    assert "".join(parts) + decoder.close() == text and "" in parts
    broken = b"\xe6\xbc"
    assert decoder.feed([merges.byte_id[b] for b in broken]) == "" and decoder.close() == broken.decode("utf-8", "replace")


def test_query_columns_on_odd_rows(odd_docs, no_docs, library, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda spark, sf, name: odd_docs)
    rows = queries.op1_bpe(odd_docs.sparkSession, "").collect()
    texts = sorted((r.text or "") for r in odd_docs.collect())
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    want = sorted((len(i), hashlib.sha256(array("I", i).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t, i in zip(texts, ids))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert bpe.decode(bpe.encode(no_docs, PATH, "a b"), PATH, "a b").count() == 0
