"""Trained operators: accuracy on held-out rows of planted data, and defined results on odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import common, language_cnn, quality_net, queries, toxicity

FORMS = {"en": ["the", "ing", "and", "th", "er"], "de": ["sch", "ung", "ein", "ich", "ä"], "fr": ["eau", "qu", "é", "les", "ou"]}


def planted(seed, n=500):
    """``(doc_id, text, lang, quality, toxic)``: toxic texts hold a few bad words in one sentence, poor ones shout or repeat."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        lang = rng.choice(list(FORMS))
        word = lambda: "".join(rng.choice(FORMS[lang]) for _ in range(rng.randint(1, 3)))  # noqa: B023,E731
        sentences = [[word() for _ in range(rng.randint(4, 9))] for _ in range(rng.randint(4, 12))]
        toxic, quality = int(rng.random() < 0.2), int(rng.random() > 0.2)
        if toxic:
            for _ in range(2):
                rng.choice(sentences).insert(1, rng.choice(["grumbolt", "snarkle", "vexfool" + rng.choice("abc")]))
        text = ". ".join(" ".join(s) for s in sentences) + "."
        if not quality:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(f"{w} {w} {w}" for w in t.split()), lambda t: t.replace(" ", "*** ")])(text)
        rows.append((k, text, lang, quality, toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = planted(3)
    docs = spark.createDataFrame([(i, t, g, "s") for i, t, g, _, _ in rows], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, q, x) for i, _, _, q, x in rows], "doc_id bigint, quality int, toxic int")
    return {"documents": docs, "labels": labels}, {r[0]: r for r in rows}


def results(monkeypatch, tables, query, spark):
    monkeypatch.setattr(queries, "table", lambda spark, sf, name: tables[name])
    return query(spark, "").collect()


def test_toxicity(spark, monkeypatch, tables):
    rows = results(monkeypatch, tables[0], queries.op3_toxicity, spark)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in tables[1] if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == tables[1][r.doc_id][4] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_offending_sentences():
    rows = planted(4)
    model = toxicity.train([(t, x) for _, t, _, _, x in rows])
    assert model.words and any(t.startswith("vexf") for t in model.words)
    weights = toxicity.WordWeights({w: float(model.weights[i]) for w, i in model.words.items()})
    assert weights["grumbolt"] + model.bias > 0 > weights["the"] + model.bias


def test_spans_of_sentences(spark):
    model = toxicity.SentenceModel(["bad"])
    model.weights[0] = 12.0
    df = spark.createDataFrame([(1, "All fine. A bad one! Ok"), (2, None), (3, "..")], "doc_id int, text string")
    got = {r.doc_id: r for r in toxicity.score(df, model, "doc_id").collect()}
    assert [(s.start, s.end) for s in got[1].offending] == [(9, 19)] and got[1].score > 0.9
    assert got[2].score == got[3].score == 0.0 and got[2].offending == []


def test_quality(spark, monkeypatch, tables):
    rows = results(monkeypatch, tables[0], queries.op8_quality_classifier, spark)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in tables[1] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == tables[1][r.doc_id][3] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_language(spark, monkeypatch, tables):
    rows = results(monkeypatch, tables[0], queries.op9_language_id, spark)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == tables[1][r.doc_id][2] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_tabulated_network_equals_the_plain_one():
    model = language_cnn.ByteCNN(["a", "b", "c"], seed=2)
    for k in language_cnn.WIDTHS:
        model.parts[f"b{k}"] += np.float32(0.1)
    x = np.random.default_rng(3).integers(0, 256, (5, language_cnn.WINDOW)).astype(np.uint8)
    vectors, hidden = model.parts["embed"][x], []
    for k in language_cnn.WIDTHS:
        columns = np.concatenate([vectors[:, j : language_cnn.WINDOW - k + 1 + j] for j in range(k)], axis=2)
        hidden.append(np.maximum((columns @ model.parts[f"w{k}"] + model.parts[f"b{k}"]).max(axis=1), 0))
    want = np.concatenate(hidden, axis=1) @ model.parts["dense"] + model.parts["out"]
    assert np.allclose(model.scorer()(x), want, atol=1e-4)


def test_gradients_of_the_network():
    model = language_cnn.ByteCNN(["a", "b"], seed=4)
    rng = np.random.default_rng(5)
    x, y = rng.integers(97, 105, (6, language_cnn.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        z = model.scorer()(x).astype(np.float64)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(6), y]).mean())

    for name in ("embed", "w3", "dense", "b2"):
        grads = model.step(x, y)[name]
        at = np.unravel_index(np.abs(grads).argmax(), grads.shape)
        kept = model.parts[name][at]
        model.parts[name][at] = kept + 1e-2
        up = loss()
        model.parts[name][at] = kept - 1e-2
        down = loss()
        model.parts[name][at] = kept
        assert abs((up - down) / 2e-2 - grads[at]) < 0.15 * abs(grads[at]) + 1e-3, name


@pytest.mark.parametrize("name", ["op3_toxicity", "op8_quality_classifier", "op9_language_id"])
def test_odd_rows(spark, monkeypatch, odd_docs, no_docs, no_labels, name):
    rows = results(monkeypatch, {"documents": odd_docs, "labels": no_labels}, queries.QUERIES[name], spark)
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert results(monkeypatch, {"documents": no_docs, "labels": no_labels}, queries.QUERIES[name], spark) == []
    if name == "op9_language_id":
        texts = {r.doc_id: r.text for r in odd_docs.collect()}
        assert all((r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or ""))) for r in rows if r.doc_id is not None)
    odd_labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 1, 0), (12, 7, -1)], "doc_id bigint, quality int, toxic int")
    assert len(results(monkeypatch, {"documents": odd_docs, "labels": odd_labels}, queries.QUERIES[name], spark)) == odd_docs.count()


def test_contexts_shape_the_word_vectors():
    texts = ["red apple pie " * 20, "green apple pie " * 20, "fast car road " * 20]
    known, vectors = quality_net.context_vectors(texts)
    near = vectors[known["red"]] @ vectors[known["green"]]
    assert near > vectors[known["red"]] @ vectors[known["fast"]]


def test_poor_survivors_reach_the_sample(spark, monkeypatch):
    """Labels of rows that are not in the stage's documents take no place, and a rare class is taken whole."""
    rows = planted(6, 900)
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _, _ in rows], "doc_id bigint, text string, lang string")
    poor = [i for i, _, _, q, _ in rows if not q][:40]
    stage = docs.join(spark.createDataFrame([(i,) for i, _, _, q, _ in rows if q or i in poor], "doc_id bigint"), "doc_id", "left_semi")
    labels = [(i, q) for i, _, _, q, _ in rows] + [(10_000 + k, 0) for k in range(4000)]
    sampled = common.class_sample(stage, spark.createDataFrame(labels, "doc_id bigint, quality int"), "quality", F.lit(True), 200)
    assert len(sampled) == 200 and sum(not label for _, label in sampled) == 40
    assert {t for t, label in sampled if not label} == {rows[i][1] for i in poor}

    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf, name: spark.createDataFrame(labels, "doc_id bigint, quality int"))
    monkeypatch.setattr(quality_net.fitted, "__defaults__", (200,))
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier_stage(spark, stage, "").collect()}
    good = {i for i, _, _, q, _ in rows if q}
    assert len(kept & set(poor)) <= 4 and len(kept & good) > 0.9 * len(good)


def test_toxicity_scores_equal_plain_loops(odd_docs):
    """Each row's score and spans by a loop over its sentences and words."""
    model = toxicity.SentenceModel(sorted({"the", "th-", "and-", "wor-", "word", "漢字"}))
    model.weights = np.linspace(-1.0, 4.0, len(model.words))
    rows = {(r.doc_id, r.text): r for r in toxicity.score(odd_docs, model, "doc_id", "text").collect()}
    assert len(rows) == odd_docs.select("doc_id", "text").distinct().count()
    for (_, text), r in rows.items():
        miss, spans, at = 1.0, [], 0
        for end in [i for i, c in enumerate(text or "") if c in ".!?\n"] + [len(text or "")]:
            if end > at:
                words = {w.lower() for w in "".join(c if c.isalpha() else " " for c in text[at:end]).split()}
                z = model.bias
                for w in words:
                    for trait in [w] + [w[:n] + "-" for n in (3, 4, 5) if len(w) >= n]:
                        z += model.weights[model.words[trait]] if trait in model.words else 0.0
                p = 1 / (1 + np.exp(-z))
                miss *= 1 - p
                if p >= 0.5:
                    spans.append((at, end))
            at = end + 1
        assert abs(r.score - (1 - miss)) < 1e-6 and [(s.start, s.end) for s in r.offending] == spans


def test_quality_scores_equal_plain_loops(odd_docs):
    rows = planted(9, 200)
    model = quality_net.train([(t, q) for _, t, _, q, _ in rows])
    got = {(r.doc_id, r.text): r.score for r in quality_net.score(odd_docs, model, "doc_id", "text").collect()}
    p = model.layers
    for (_, text), score in got.items():
        tokens = (text or "").split()
        total, known, forms = np.zeros(quality_net.DIMENSION), 0, [0] * len(quality_net.FORMS)
        for token, before in zip(tokens, ["", *tokens]):
            forms[quality_net.form(token, before)] += 1
            if token.lower() in model.known:
                total += model.vectors[model.known[token.lower()]]
                known += 1
        n = max(len(tokens), 1)
        x = [*(total / max(known, 1)), known / n, *(k / n for k in forms), np.log1p(len(tokens))]
        z = [(v - c) / s for v, c, s in zip(x, model.centre, model.scale)]
        out = p["b2"][0]
        for h in range(quality_net.HIDDEN):
            out += max(0.0, p["b1"][h] + sum(v * w for v, w in zip(z, p["w1"][:, h]))) * p["w2"][h]
        assert abs(score - 1 / (1 + np.exp(-out / model.temperature))) < 1e-4


def test_many_languages(spark):
    """A language of few rows among very many is learnt, too."""
    rows = [(k, "qx zv " * 30, f"l{k:03d}") for k in range(250)] + [(1000 + k, "der ung sch " * 20, "rare") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = language_cnn.training_sample(docs, F.lit(True))
    assert {lang for lang, _ in sample} == {r[2] for r in rows}
    monkey = language_cnn.SAMPLE_DOCS
    language_cnn.SAMPLE_DOCS = 300
    try:
        assert {lang for lang, _ in language_cnn.training_sample(docs, F.lit(True))} == {r[2] for r in rows}
    finally:
        language_cnn.SAMPLE_DOCS = monkey
