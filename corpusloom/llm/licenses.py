"""Licence scan with a positional index of rare template words.

Every text is read once. Of its words only those that occur in some template are kept, with their positions, and written
to the shared folder: the licence postings of the corpus. Document frequencies of these few words give their weights.
A file's postings of the templates' heaviest words (anchors) are looked up in the template index, which gives a template
and where it would start; the other words of the template are then matched by relative position in the neighbouring
postings. A place counts by the share of the template's weight that matches; a label also needs the template's mandatory
key phrase, word for word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.vectors import bind
from corpusloom.llm.common import ascii_lower, stored

#: Words are runs of 0-9, a-z and characters beyond ASCII, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Looked-up words per template, the heaviest first; an exact template needs one, which each of its places holds.
ANCHORS = 3
#: Share of a template's weight that must match for its label.
MIN_SCORE = 0.8
#: Weights are whole numbers of thousandths, so that sums do not depend on their order.
SCALE = 1000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Mandatory key phrase; it must stand in the template.
    key: str
    #: Only exact places count, and they are the base places.
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_range(self) -> range:
        words, key = self.words, self.key.split()
        start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return range(start, start + len(key))


BASE = tuple(Template(label, phrase, phrase, True) for phrase, label in (
    ("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"),
))
TEMPLATES = BASE + (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person"),
    Template("mit", "released under the terms of the mit license", "mit license"),
    Template("apache-2", "licensed under the apache license version 2 0 the license", "apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by", "gnu lesser general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
)


def vocabulary(templates) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def licence_postings(docs: DataFrame, *keep: str, templates=TEMPLATES) -> DataFrame:
    """``keep`` columns, ``n_words`` and ``hits``, an array of ``(pos, word)`` of the template words, by position.

    A null or empty text has no words. The case is folded for A-Z only: the plain ``lower`` finds candidates cheaply,
    the exact fold decides.
    """
    vocab = vocabulary(templates)

    def hits(words: Column) -> Column:
        near = F.filter(F.transform(words, lambda w, i: F.when(F.lower(w).isin(*vocab), i)), lambda i: i.isNotNull())
        found = F.transform(near, lambda i: F.struct(i.alias("pos"), ascii_lower(F.get(words, i)).alias("word")))
        return F.filter(found, lambda h: h["word"].isin(*vocab))

    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_ANY_CASE), F.lit(0))
    split = docs.select(*keep, words.alias("_words"))
    return split.select(*keep, F.size("_words").cast("bigint").alias("n_words"), bind(F.col("_words"), hits).alias("hits"))


def word_weights(postings: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Inverse document frequencies of the template words over all rows, in thousandths, at least 1."""
    vocab = vocabulary(templates)
    n = postings.count()
    rows = (
        postings.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("df")).collect()  # at most one row per template word
    )
    df = {r.word: r.df for r in rows}
    return {w: max(1, round(SCALE * math.log((n + 1) / (df.get(w, 0) + 1)))) for w in vocab}


def _literal(values, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def find_places(postings: DataFrame, weights: dict[str, int], *keep: str, templates=TEMPLATES) -> DataFrame:
    """``keep``, ``n_words`` and ``places``, the distinct ``(template, start, score, key)`` a file's anchors lead to.

    ``template``: its number; ``start``: word position, which for a damaged copy may lie before the text; ``score``:
    matched weight / whole weight; ``key``: whether the key phrase stands there word for word. An exact template gives
    only its whole places.
    """
    index: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(templates):
        anchors = sorted(set(t.words), key=lambda w: (-weights[w], w))[: 1 if t.exact else ANCHORS]
        for offset, word in enumerate(t.words):
            if word in anchors:
                index.setdefault(word, []).append((number, offset))
    posting = "array<struct<template:int,offset:int>>"
    lookup = F.create_map(*[
        x for word, found in sorted(index.items())
        for x in (F.lit(word), F.array(*[F.struct(F.lit(a).alias("template"), F.lit(b).alias("offset")) for a, b in found]).cast(posting))
    ])
    words = F.array(*[_literal(t.words, "string") for t in templates])
    parts = F.array(*[_literal([weights[w] for w in t.words], "bigint") for t in templates])
    sizes = _literal([len(t.words) for t in templates], "int")
    totals = _literal([sum(weights[w] for w in t.words) for t in templates], "bigint")
    key_from = _literal([t.key_range.start for t in templates], "int")
    key_to = _literal([t.key_range.stop for t in templates], "int")
    exact = _literal([t.exact for t in templates], "boolean")

    def candidates(hits: Column) -> Column:
        anchored = F.filter(F.transform(hits, lambda h, k: F.when(h["word"].isin(*index), k)), lambda k: k.isNotNull())
        return F.flatten(F.transform(anchored, lambda k: F.transform(
            F.try_element_at(lookup, F.get(hits, k)["word"]),
            lambda p: F.struct(
                p["template"].alias("template"), (F.get(hits, k)["pos"] - p["offset"]).alias("start"),
                # the template's other words are among as many postings before and after as it has words there
                F.slice(hits, F.greatest(k - p["offset"], F.lit(0)) + 1, F.get(sizes, p["template"])).alias("near"),
            ),
        )))

    def scored(c: Column) -> Column:
        size = F.get(sizes, c["template"])
        offsets = F.filter(
            F.transform(c["near"], lambda h: F.when(F.get(F.get(words, c["template"]), F.when((h["pos"] >= c["start"]) & (h["pos"] < c["start"] + size), h["pos"] - c["start"]).otherwise(-1)) == h["word"], h["pos"] - c["start"])),
            lambda o: o.isNotNull(),
        )

        def place(found: Column) -> Column:
            first, last = F.get(key_from, c["template"]), F.get(key_to, c["template"])
            weight = F.aggregate(found, F.lit(0).cast("bigint"), lambda s, o: s + F.get(F.get(parts, c["template"]), o))
            return F.struct(
                c["template"].alias("template"), c["start"].alias("start"), (weight / F.get(totals, c["template"])).alias("score"),
                (F.size(F.filter(found, lambda o: (o >= first) & (o < last))) == last - first).alias("key"),
                (F.size(found) == size).alias("whole"),
            )

        return bind(offsets, place)

    places = F.filter(F.array_distinct(F.transform(candidates(F.col("hits")), scored)), lambda p: p["whole"] | ~F.get(exact, p["template"]))
    return postings.select(*keep, "n_words", places.alias("places"))


def scan(docs: DataFrame, *keep: str, templates=TEMPLATES) -> DataFrame:
    """Per row of ``docs``: ``keep``, ``n_words``, base places, labels, best score and all ``places``.

    Null and empty texts have no words, no labels and score 0. Repeated rows are scanned alike; other columns are not
    returned. ``labels`` holds the base labels and those of templates matched to ``MIN_SCORE`` with their key phrase.
    """
    postings = stored(licence_postings(docs, *keep, templates=templates), "licence-postings")
    found = find_places(postings, word_weights(postings, templates), *keep, templates=templates)
    names = _literal([t.label for t in templates], "string")
    exact = _literal([t.exact for t in templates], "boolean")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: F.get(names, p["template"])))), ",")
    found = found.select(
        *keep, "n_words", "places", F.filter("places", lambda p: F.get(exact, p["template"])).alias("base"),
        F.filter("places", lambda p: p["key"] & (p["score"] >= MIN_SCORE)).alias("sure"),
    )
    return found.select(
        *keep, "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["start"])).cast("bigint").alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.col("sure")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"), "places",
    )
