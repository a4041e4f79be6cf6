"""Quality classifier: random-indexing word vectors, pooled per document, in a two-layer network.

Every token has a fixed sparse vector of signs drawn by its hash. A token's meaning is the sum of its neighbours' sparse
vectors over the training sample (random indexing), scaled to unit length. A document is pooled into the mean vector of
its known tokens and the shares of its tokens' forms. A hidden layer and a logistic output are fitted in numpy; a temperature fitted on rows kept aside calibrates the
probability for classes of equal weight, whatever their shares in the sample.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from corpusloom.llm.common import class_sample, score_texts

TOKEN = re.compile(r"\S+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")

#: Bounds of the training sample and of the vocabulary of context vectors.
MAX_SAMPLE, MAX_WORDS, MIN_COUNT = 2500, 20_000, 5
DIMENSION, SIGNS, REACH = 64, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 40, 64, 0.01, 1e-4, 5
#: Share of the sample kept aside for the temperature.
ASIDE = 0.2
FORMS = ("again", "upper", "mixed", "marks", "digits", "symbols", "plain")
THRESHOLD = 0.7


def form(token: str, before: str) -> int:
    """Number of a token's form: a repeat of the one before, capitals, marks only, with digits, with symbols, or plain."""
    if token == before:
        return 0
    if token.isalpha():
        return 1 if len(token) > 1 and token.isupper() else 6
    bare = EDGES.sub("", token)
    if not bare:
        return 3
    if len(bare) > 1 and bare.isupper():
        return 1
    if any(c.isdigit() for c in bare):
        return 4
    if len(token) - len(bare) > 1:
        return 5
    return 6 if bare.isalpha() else 2


def sign_vector(word: str) -> np.ndarray:
    """``SIGNS`` places of plus one or minus one, by hash."""
    seed = zlib.crc32(word.encode("utf-8", "replace"))
    v = np.zeros(DIMENSION, np.float32)
    for k in range(SIGNS):
        seed = (seed * 1103515245 + 12345 + k) & 0x7FFFFFFF
        v[(seed >> 8) % DIMENSION] += 1.0 if seed >> 30 & 1 else -1.0
    return v


def bare_words(text: str) -> list[str]:
    return [t.lower() for t in TOKEN.findall(text)]


def context_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Random indexing over the sample: per frequent word the unit sum of the sign vectors within ``REACH`` words."""
    counts: Counter[str] = Counter()
    for text in texts:  # one text's words at a time, here and below
        counts.update(bare_words(text))
    known = {w: i for i, w in enumerate(sorted(w for w, n in counts.most_common(MAX_WORDS) if n >= MIN_COUNT))}
    del counts
    signs = np.array([sign_vector(w) for w in known], np.float32).reshape(-1, DIMENSION)
    vectors = np.zeros((len(known), DIMENSION), np.float32)
    for text in texts:
        at = np.array([known.get(w, -1) for w in bare_words(text)], np.int64)
        for d in range(1, REACH + 1):
            a, b = at[:-d], at[d:]
            both = (a >= 0) & (b >= 0)
            np.add.at(vectors, a[both], signs[b[both]])
            np.add.at(vectors, b[both], signs[a[both]])
    return known, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)


class QualityModel:
    def __init__(self, known: dict[str, int], vectors: np.ndarray):
        self.known, self.vectors = known, vectors
        self.layers: dict[str, np.ndarray] | None = None
        self.centre = self.scale = None
        self.temperature, self.base = 1.0, 1.0

    def pool(self, text: str) -> np.ndarray:
        """Mean context vector of the known words, share of known words, shares of the forms, log of the word count."""
        tokens = TOKEN.findall(text)
        n = len(tokens)
        at = [i for i in map(self.known.get, map(str.lower, tokens)) if i is not None]
        forms = np.bincount(np.fromiter(map(form, tokens, [""] + tokens[:-1]), np.int64, n), minlength=len(FORMS))
        mean = self.vectors[at].mean(axis=0) if at else np.zeros(DIMENSION, np.float32)
        return np.concatenate([mean, [len(at) / max(n, 1)], forms / max(n, 1), [np.log1p(n)]])

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> QualityModel:
        """Adam on the cross entropy, both classes with equal weight on small batches; then the temperature on rows aside."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        aside, learn = order[: int(len(x) * ASIDE)], order[int(len(x) * ASIDE) :]
        if len(set(y[learn].tolist())) < 2:
            return self
        self.centre, self.scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-3
        p = {
            "w1": rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
            "w2": rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), "b2": np.zeros(1),
        }
        first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        z, steps, t = (x - self.centre) / self.scale, EPOCHS * -(-len(learn) // BATCH), 0
        weight = (0.5 / np.bincount(y[learn], minlength=2))[y[learn]]
        while t < steps:
            t += 1
            at = rng.choice(learn, min(BATCH, len(learn)), p=weight / weight.sum())
            hidden = np.maximum(z[at] @ p["w1"] + p["b1"], 0)
            d = (1 / (1 + np.exp(-(hidden @ p["w2"] + p["b2"]))) - y[at]) / len(at)
            back = np.outer(d, p["w2"]) * (hidden > 0)
            grads = {"w1": z[at].T @ back + DECAY * p["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ d + DECAY * p["w2"], "b2": np.array([d.sum()])}
            for k, g in grads.items():
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g * g
                p[k] -= RATE * (1 - t / (steps + 1)) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
        self.layers = p
        if len(aside):
            logits, target = self.logits(x[aside]), y[aside]
            share = (0.5 / np.maximum(np.bincount(target, minlength=2), 1))[target]
            loss = lambda t: float((share * (np.logaddexp(0, logits / t) - target * logits / t)).sum())
            self.temperature = min((t for t in np.geomspace(0.5, 8, 41)), key=loss)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.layers
        return np.maximum((x - self.centre) / self.scale @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def train(sample: list[tuple[str, int]]) -> QualityModel:
    """From ``(text, label)``. Without rows of both classes every text scores the one class there is, and 1 without any."""
    texts, y = [t for t, _ in sample], np.array([label for _, label in sample], np.int64)
    model = QualityModel(*context_vectors(texts))
    if len(set(y.tolist())) < 2:
        model.base = float(y[0]) if len(y) else 1.0
        return model
    model.base = float(y.mean())
    return model.fit(np.array([model.pool(t) for t in texts]), y)


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_SAMPLE) -> QualityModel:
    return train(class_sample(docs, labels, "quality", learn, max_rows))


def score(docs: DataFrame, model: QualityModel, *keep: str) -> DataFrame:
    """``keep`` and ``score``, the probability of label 1 among classes of equal weight, of every row.

    Null and empty texts are pooled as no words and scored like any other. Repeated rows are scored alike.
    """

    def scorer():
        def run(texts: list[str]) -> list[pa.Array]:
            pooled = np.array([model.pool(t) for t in texts])
            return [pa.array(model.probability(pooled).astype(np.float64), pa.float64())]

        return run

    return score_texts(docs, list(keep), scorer, "score double")
