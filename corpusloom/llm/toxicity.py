"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

A sentence's probability is logistic in its words and their beginnings; a document's is the noisy-or of its sentences,
``1 - product(1 - p)``. Only documents carry labels: the gradient of the document's log-likelihood divides the blame among
the sentences. The model is fitted in numpy on a bounded sample of labelled documents; applying it is one pass over whole
texts without a shuffle, which also gives the offending sentences.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from corpusloom.llm.common import class_sample, score_texts

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")

#: Bounds of the training sample and of the traits; rarer ones say nothing.
MAX_SAMPLE, MAX_TRAITS, MIN_DOCUMENTS, MIN_DEVIATIONS = 6000, 20_000, 3, 4.0
BEGINNINGS = (3, 4, 5)
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 64, 0.05, 3e-5, 11
START_BIAS = -6.0
#: Sentences from this probability on are reported.
OFFENDING = 0.5


def traits(word: str) -> tuple[str, ...]:
    """What a word is known by: itself, and its first three, four and five letters, which inflected forms share."""
    return (word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n))


class WordWeights(dict):
    """Weight of a word as the sum over its traits, kept for ``limit`` words at a time."""

    def __init__(self, weights: dict[str, float], limit: int = 100_000):
        self.weights, self.limit = weights, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        self[word] = total = sum(self.weights.get(t, 0.0) for t in traits(word))
        return total


class SentenceModel:
    """``bias`` and a weight per trait; an unknown trait has none."""

    def __init__(self, words: list[str]):
        self.words = {w: i for i, w in enumerate(words)}
        self.weights = np.zeros(len(words))
        self.bias = START_BIAS

    def fit(self, documents: list[list[list[int]]], labels: np.ndarray, seed: int = SEED) -> SentenceModel:
        """``documents``: per document its sentences as lists of trait numbers. Adam on small batches."""
        rng = np.random.default_rng(seed)
        n, k = len(documents), len(self.weights)
        flat = [np.array([w for s in d for w in s], np.int64) for d in documents]
        sizes = [np.array([len(s) for s in d], np.int64) for d in documents]
        parameters, first, second = np.append(self.weights, self.bias), np.zeros(k + 1), np.zeros(k + 1)
        t, steps = 0, EPOCHS * -(-n // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for a in range(0, n, BATCH):
                at = order[a : a + BATCH]
                words, lengths = np.concatenate([flat[i] for i in at]), np.concatenate([sizes[i] for i in at])
                counts = np.array([len(sizes[i]) for i in at])
                sentence = np.repeat(np.arange(len(lengths)), lengths)
                document = np.repeat(np.arange(len(at)), counts)
                z = np.bincount(sentence, parameters[words], len(lengths)) + parameters[k]
                miss = np.exp(-np.bincount(document, np.logaddexp(0, z), len(at)))  # probability that no sentence is toxic
                y = labels[at]
                # d loss / d z of a sentence: p if the label is 0, else -p * (1 - P) / P
                blame = np.where(y == 1, -miss / np.maximum(1 - miss, 1e-9), 1.0)[document] / (1 + np.exp(-z)) / len(at)
                g = np.append(np.bincount(words, blame[sentence], k), blame.sum())
                g[:k] += DECAY * parameters[:k]
                t += 1
                first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
                rate = RATE * (1 - t / (steps + 1))
                parameters -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.weights, self.bias = parameters[:k], float(parameters[k])
        return self


def train(sample: list[tuple[str, int]]) -> SentenceModel:
    """From ``(text, label)``. With no document of one of the classes every sentence keeps the starting probability.

    Traits enter the model if they stand in more toxic documents than chance explains: so many that their share exceeds
    that of all documents by ``MIN_DEVIATIONS`` standard deviations.
    """
    labels = np.array([label for _, label in sample])
    if len(set(labels.tolist())) < 2:
        return SentenceModel([])

    def found(text: str) -> set[str]:
        return {t for w in set(WORD.findall(text.lower())) for t in traits(w)}

    # texts are gone through three times so that only traits that may enter the model are ever held
    toxic = Counter(t for text, label in sample if label for t in found(text))
    toxic = {t: k for t, k in toxic.items() if k >= MIN_DOCUMENTS}
    seen = Counter(t for text, _ in sample for t in found(text) if t in toxic)
    rate = labels.mean()
    sure = {t: (k - seen[t] * rate) / (seen[t] * rate * (1 - rate)) ** 0.5 for t, k in toxic.items()}
    chosen = sorted((t for t in sure if sure[t] >= MIN_DEVIATIONS), key=lambda t: (-sure[t], t))[:MAX_TRAITS]
    model = SentenceModel(sorted(chosen))
    number = model.words
    documents = [
        [[number[t] for w in sorted(set(WORD.findall(s.lower()))) for t in traits(w) if t in number] for s in SENTENCE.findall(text)]
        for text, _ in sample
    ]
    return model.fit(documents, labels)


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_SAMPLE) -> SentenceModel:
    return train(class_sample(docs, labels, "toxic", learn, max_rows))


def score(docs: DataFrame, model: SentenceModel, *keep: str) -> DataFrame:
    """``keep``, ``score`` and ``offending``, the sentences from probability ``OFFENDING`` on, of every row.

    ``offending``: ``(start, end, score)`` in characters of the text. A null or empty text, or one of full stops only,
    has no sentence and score 0. Repeated rows are scored alike.
    """
    table, bias = {w: float(model.weights[i]) for w, i in model.words.items() if abs(model.weights[i]) > 1e-3}, model.bias
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scorer():
        weight = WordWeights(table).__getitem__

        def run(texts: list[str]) -> list[pa.Array]:
            scores, found = [], []
            for text in texts:
                matches = list(SENTENCE.finditer(text))
                z = np.fromiter(
                    (sum(map(weight, set(WORD.findall(m.group().lower())))) for m in matches), np.float64, len(matches)
                ) + bias
                scores.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                found.append([
                    {"start": matches[i].start(), "end": matches[i].end(), "score": float(1 / (1 + np.exp(-z[i])))}
                    for i in np.flatnonzero(z >= np.log(OFFENDING / (1 - OFFENDING)))
                ])
            return [pa.array(scores, pa.float64()), pa.array(found, spans)]

        return run

    return score_texts(docs, list(keep), scorer, "score double, offending array<struct<start:bigint,end:bigint,score:double>>")
