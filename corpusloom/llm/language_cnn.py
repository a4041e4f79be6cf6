"""Language identification by a small convolutional network over bytes, trained and applied in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, all of them, the last filled with zeros. In a window,
filters of several widths slide over the byte vectors; each filter's largest rectified response goes into a softmax layer.
A text's language has the largest mean of the windows' logits. The network is fitted on a bounded sample of labelled rows
on the driver; applying it needs no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import score_texts, stored

UNKNOWN = "und"
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS, DIMENSION = 8, 8
#: Bounds of the training sample: documents of a language, of all languages (one of each at least), windows of a document.
DOCS_PER_LANGUAGE, SAMPLE_DOCS, WINDOWS_PER_DOC = 400, 40_000, 4
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.004, 7


def training_sample(docs: DataFrame, learn: Column) -> list[tuple[str, bytes]]:
    """``(lang, window bytes)`` of some documents of every language, chosen by hash of the id.

    A language gives at most ``DOCS_PER_LANGUAGE`` of them, or its part of ``SAMPLE_DOCS`` where there are many languages, and
    at least one.

    From each document come at most ``WINDOWS_PER_DOC`` windows, evenly spaced over the whole text and cut on the
    executors.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(learn).select("doc_id", F.col("lang").alias("lang_"))
    counts = stored(known.groupBy("lang_").count(), "languages")
    languages = counts.count()
    if not languages:
        return []
    each = min(DOCS_PER_LANGUAGE, max(1, SAMPLE_DOCS // languages))
    # a cut on the hash leaves about twice the wanted rows of a language, however many it has, before any row is moved
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    cut = counts.select("lang_", F.least(F.lit(1.0), F.lit(2.0 * each + 20) / F.col("count")).alias("_cut"))
    order = Window.partitionBy("lang_").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        known.join(cut, "lang_").filter(part < F.col("_cut")).withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= each).select("doc_id", "lang_").distinct()
    )
    raw = F.encode(F.col("text"), "UTF-8")
    step = F.greatest(F.lit(WINDOW), F.floor(F.octet_length(raw) / WINDOWS_PER_DOC)).cast("int")
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1)), step)
    windows = F.slice(F.transform(starts, lambda at: F.substring(raw, at, F.lit(WINDOW))), 1, WINDOWS_PER_DOC)
    rows = (
        docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "lang_", windows.alias("windows")).toArrow().sort_by([("doc_id", "ascending"), ("lang_", "ascending")])
    )
    return [(lang, w) for lang, ws in zip(rows["lang_"].to_pylist(), rows["windows"].to_pylist()) for w in ws if w]


def as_windows(pieces: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(WINDOW, b"\0") for p in pieces), np.uint8).reshape(-1, WINDOW)


class ByteCNN:
    """``embed`` 256 x d; per width k ``filters[k]`` (k*d) x f with ``bias[k]``; ``dense`` (widths*f) x languages."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.parts = {"embed": rng.normal(0, 0.3, (256, DIMENSION)).astype(np.float32)}
        for k in WIDTHS:
            self.parts[f"w{k}"] = rng.normal(0, (2 / (k * DIMENSION)) ** 0.5, (k * DIMENSION, FILTERS)).astype(np.float32)
            self.parts[f"b{k}"] = np.zeros(FILTERS, np.float32)
        self.parts["dense"] = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.parts["out"] = np.zeros(len(languages), np.float32)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy on windows ``x`` with language numbers ``y``."""
        p, n = self.parts, len(x)
        vectors = p["embed"][x]
        pooled, kept = [], []
        for k in WIDTHS:
            columns = np.concatenate([vectors[:, j : WINDOW - k + 1 + j] for j in range(k)], axis=2)
            response = columns @ p[f"w{k}"] + p[f"b{k}"]
            best = response.argmax(axis=1)
            top = np.take_along_axis(response, best[:, None, :], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            kept.append((columns, best, top > 0))
        hidden = np.concatenate(pooled, axis=1)
        logits = hidden @ p["dense"] + p["out"]
        share = np.exp(logits - logits.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        share[np.arange(n), y] -= 1
        d = share / n
        grads = {"dense": hidden.T @ d, "out": d.sum(axis=0)}
        back = d @ p["dense"].T
        d_vectors = np.zeros_like(vectors)
        rows = np.arange(n)
        for i, k in enumerate(WIDTHS):
            columns, best, on = kept[i]
            g = back[:, i * FILTERS : (i + 1) * FILTERS] * on
            grads[f"b{k}"] = g.sum(axis=0)
            w = np.zeros_like(p[f"w{k}"])
            for f in range(FILTERS):
                w[:, f] = columns[rows, best[:, f]].T @ g[:, f]
                spread = (g[:, f, None] * p[f"w{k}"][None, :, f]).reshape(n, k, DIMENSION)
                for j in range(k):
                    d_vectors[rows, best[:, f] + j] += spread[:, j]
            grads[f"w{k}"] = w
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, x.ravel(), d_vectors.reshape(-1, DIMENSION))
        grads["embed"] = embed
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteCNN:
        """Adam; windows are drawn with equal weight per language, so that a frequent language does not crowd out others."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.parts.items()}
        second = {k: np.zeros_like(v) for k, v in self.parts.items()}
        weight = 1.0 / np.bincount(y, minlength=len(self.languages))[y]
        steps = max(100, epochs * len(x) // BATCH)
        for t in range(1, steps + 1):
            at = rng.choice(len(x), size=min(BATCH, len(x)), p=weight / weight.sum())
            rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, g in self.step(x[at], y[at]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.parts[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)
        return self

    def scorer(self):
        """A function from windows to logits. Responses to pairs of bytes are tabulated, so that a width of two or three
        takes one or two look-ups per byte and a width of four two."""
        p, f = self.parts, FILTERS

        def at(k, j):
            return p["embed"] @ p[f"w{k}"][j * DIMENSION : (j + 1) * DIMENSION]

        def pair(a, b):
            return (a[:, None, :] + b[None, :, :]).reshape(65536, f)

        first = np.concatenate([pair(at(2, 0), at(2, 1)), pair(at(3, 0), at(3, 1)), pair(at(4, 0), at(4, 1))], axis=1)
        third, last = at(3, 2), pair(at(4, 2), at(4, 3))
        bias = np.concatenate([p[f"b{k}"] for k in WIDTHS])

        def logits(x: np.ndarray) -> np.ndarray:
            pairs = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
            response = first[pairs]
            response[:, :-1, f : 2 * f] += third[x[:, 2:]]
            response[:, -1, f : 2 * f] = -np.inf
            response[:, :-2, 2 * f :] += last[pairs[:, 2:]]
            response[:, -2:, 2 * f :] = -np.inf
            hidden = np.maximum(response.max(axis=1) + bias, 0)
            return hidden @ p["dense"] + p["out"]

        return logits


def train(sample: list[tuple[str, bytes]]) -> ByteCNN | None:
    """None without any labelled window."""
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    return ByteCNN(languages).fit(as_windows([w for _, w in sample]), np.array([number[lang] for lang, _ in sample]))


def predict(docs: DataFrame, model: ByteCNN | None, *keep: str) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` (the softmax share of the mean logits) of every row.

    A null, empty or letterless text is ``und`` with score 0, as is every text without a model. Repeated rows are
    predicted alike.
    """
    block = 64  # windows looked up at once, which keeps the responses in the processor's cache

    def scorer():
        logits = model.scorer() if model else None

        def score(texts: list[str]) -> list[pa.Array]:
            found = [None] * len(texts)
            if model:
                lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
                pieces = [texts[i].encode("utf-8", "replace") for i in lettered]
                counts = np.array([-(-len(b) // WINDOW) for b in pieces], np.int64)
                if lettered:
                    x = np.frombuffer(b"".join(b.ljust(int(n) * WINDOW, b"\0") for b, n in zip(pieces, counts)), np.uint8).reshape(-1, WINDOW)
                    all_logits = np.concatenate([logits(x[a : a + block]) for a in range(0, len(x), block)])
                    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
                    mean = np.add.reduceat(all_logits.astype(np.float64), starts, axis=0) / counts[:, None]
                    share = np.exp(mean - mean.max(axis=1, keepdims=True))
                    share /= share.sum(axis=1, keepdims=True)
                    for i, row in zip(lettered, share):
                        best = int(row.argmax())
                        found[i] = (model.languages[best], float(row[best]))
            return [pa.array([f[0] if f else UNKNOWN for f in found], pa.string()), pa.array([f[1] if f else 0.0 for f in found], pa.float64())]

        return score

    return score_texts(docs, list(keep), scorer, "lang_pred string, score double")
