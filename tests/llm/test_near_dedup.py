import random

import numpy as np
import pytest

from corpusloom.llm import lsh_forest as forest


def brute(rows, size, percent):
    """Components over all pairs of ids; rows that share an id are one document."""
    sets = [(i, {tuple(w[k : k + min(size, len(w))]) for k in range(max(1, len(w) - size + 1))} if (w := (t or "").encode().lower().split()) else set())
            for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if i is not None and j is not None and s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}, sorted(((i, len(s)) for i, s in sets), key=str)


def corpus(seed):
    """Unrelated texts, copies, near copies of several strengths, chains, and a large family about the threshold."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 60))
    texts = [[word() for _ in range(rng.randint(1, 90))] for _ in range(60)]

    def edited(words, share):
        return [word() if rng.random() < share else w for w in words]

    for base in list(texts[:25]):
        texts += [base, edited(base, 0.01), edited(base, 0.03), edited(base, 0.06)]
    chain = [word() for _ in range(120)]
    for _ in range(30):
        chain = edited(chain, 0.015)
        texts.append(chain)
    family = [word() for _ in range(150)]
    texts += [edited(family, 0.025) for _ in range(120)]
    rng.shuffle(texts)
    return [(1000 + 3 * k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, size, percent):
    rows = corpus(size)
    want, counts = brute(rows, size, percent)
    got = forest.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), size, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=str) == counts
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_find_what_candidates_miss(spark, monkeypatch):
    """With one tree and blocks of a few shingles the exact rest has to do most of the work."""
    monkeypatch.setattr(forest, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(forest, "BEST", 1)
    rows = corpus(9)
    got = forest.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 3, 85)[0]


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want, counts = brute(rows, 5, 80)
    got = forest.near_duplicates(odd_docs).collect()
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=str) == counts
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert forest.near_duplicates(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 999), (999, 1000)]
    got = {r.node: r.component for r in forest.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(201)} | {999: 999, 1000: 999}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[200:2200])
    agree = np.mean(np.frombuffer(forest.signature(a), np.uint8) == np.frombuffer(forest.signature(b), np.uint8))
    assert abs(agree - 1800 / 2200) < 0.2
