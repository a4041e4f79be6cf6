"""Spelling variants: words one edit apart by asymmetric q-chunks, each led to the frequent form it is a variant of.

Of two words one edit apart the shorter one (of equal length, the smaller one) contributes two disjoint chunks, its halves; the
other one contributes positional grams. An edit touches one half at most, so the other half is a gram of the other word, at
its own place or one beside it. The same holds again for the two halves of what the chunk leaves over, of which one is whole,
too: chunk and sub-chunk together are the join key, so that a frequent beginning does not bring all its words together. Of
the positional grams only those within one shift of a chunk's place can meet it, and only they are made. The join verifies
the distance itself, so no candidate leaves it that is not a link.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import ascii_lower, stored

LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 7, 2, 10
#: One run in so many loses a code point.
DROP_ONE_IN = 31
LETTERS = r"A-Za-zÀ-ÿ"


def variant_runs(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``word`` of every run of letters with ``least_length`` code points, after the loss of one where ``DROP_ONE_IN`` says so."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(rf"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % DROP_ONE_IN == 0, shorter).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words that occur ``least_count`` times; counts are combined before the shuffle."""
    return variant_runs(docs, least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _parts(word: Column, length: Column, shift: int) -> list[tuple[Column, Column]]:
    """Chunk with sub-chunk, as a beginning and an end of ``word``, for a chunk word of ``length`` that is ``shift`` shorter.

    The chunks are ``[0, half)`` and ``[half, length)``. With the first go the two halves of the rest behind it, with the
    second those of the rest before it.
    """
    half = F.floor(length / 2).cast("int")
    first, last = F.floor(half / 2).cast("int"), half + F.floor((length - half) / 2).cast("int")
    begin = lambda n: F.substring(word, F.lit(1), n)
    end = lambda n: F.substring(word, n + (shift + 1), length)
    nothing = F.lit("")
    return [(begin(last), nothing), (begin(half), end(last)), (begin(first), end(half)), (nothing, end(first))]


def _keyed(words: DataFrame, shifts: tuple[int, ...], side: str) -> DataFrame:
    """One row per key: ``side`` word, its count and length, the chunk word's length ``of``, and the number ``k`` of the key."""
    keys = []
    for shift in shifts:
        of = F.length("word") - shift
        for k, (begin, end) in enumerate(_parts(F.col("word"), of, shift)):
            keys.append(F.struct(F.xxhash64(F.lit(k), of, begin, end).alias("key"), of.alias("of"), F.lit(k).alias("k")))
    rows = words.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"), F.explode(F.array(*keys)).alias("x"))
    return rows.select(side, f"n_{side}", "x.key", "x.of", "x.k")


def near_words(words: DataFrame) -> DataFrame:
    """``(a, n_a, b, n_b)``: each pair of ``words`` (``word, n``) one inserted, deleted or replaced code point apart, once."""
    chunks = _keyed(words, (0,), "a")
    grams = _keyed(words, (0, 1), "b")
    a, b, of = F.col("a"), F.col("b"), chunks["of"]
    shift = F.length(b) - of
    same = F.lit(3)
    for k in (2, 1, 0):  # the first key that brings the two together gives the link
        meet = [F.when(shift == s, (x[0] == y[0]) & (x[1] == y[1])) for s in (0, 1) for x, y in [(_parts(a, of, 0)[k], _parts(b, of, s)[k])]]
        same = F.when(F.coalesce(*meet), k).otherwise(same)
    ordered = (F.length(a) < F.length(b)) | (a < b)
    match = (chunks["key"] == grams["key"]) & (chunks["k"] == grams["k"]) & (of == grams["of"])
    return chunks.join(grams, match & ordered & (F.levenshtein(a, b, 1) == 1) & (same == chunks["k"])).select("a", "n_a", "b", "n_b")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``.

    A word's form is the most frequent of its near words (the smallest of equally frequent ones) if that one is at least
    ``factor`` times as frequent; ``root`` is where the forms lead. Null and empty texts have no words; a null id counts as
    empty text; repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    words = stored(word_counts(docs, least_length, least_count), "variant-words")
    links = near_words(words)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")),
                    F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))
    near = links.select(F.explode(sides).alias("x")).groupBy("x.word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("x.n")).alias("less"), F.col("x.near").alias("near"))).alias("best"))
    led = words.join(near, "word", "left")
    has = -F.col("best.less") >= factor * F.col("n")
    led = led.select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has, -F.col("best.less")).alias("form_n"),
    )
    led = stored(led, "variant-forms")
    return led.join(_roots(led, factor, least_count), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(led: DataFrame, factor: int, least_count: int) -> DataFrame:
    """``(word, root)`` of the words with a form. Counts grow by ``factor`` at each step, which bounds the steps; each round doubles them."""
    most = led.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(most / least_count, 1), factor)) + 1)
    roots = led.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
    return roots
