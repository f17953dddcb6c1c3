"""Quality classifier: logistic regression on hashed word n-grams.

Trained with follow-the-regularised-leader updates (per-coordinate rates, L1 and L2) on a
bounded sample of labelled texts; scored as sparse dot products in one pass, no shuffle.
Word tokens are the lower-cased bare words, their shapes (case, affixed punctuation) and
whether they stand in a repeated five-word window, as one-, two- and three-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._linear import SLOTS, bare, gram_hash, held_out_column, labelled, lowered, score_with, sigmoid, within
from ._text import Words, as_words, mix, slice_hash, word_hash
from .repetition import repeated_items

#: Most labelled texts to learn from.
MAX_LABELLED = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
#: Each kind of n-gram enters as its frequency in the text times this.
SCALE = 10.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


def shapes(w: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A code of each word's case and of the punctuation around it."""
    upper = np.concatenate([[0], np.cumsum((w.buf >= 65) & (w.buf <= 90))])
    lower = np.concatenate([[0], np.cumsum((w.buf >= 97) & (w.buf <= 122))])
    ups, lows = upper[w.end] - upper[w.start], lower[w.end] - lower[w.start]
    case = (ups > 0) * 1 + (lows > 0) * 2 + (ups > 1) * 4
    return mix(slice_hash(w, end, w.end, 3) + slice_hash(w, w.start, start, 5) * np.uint64(3) + case.astype(np.uint64))


def slots(column: pa.Array) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """For each kind of n-gram, (slot, text) of every occurrence."""
    w = as_words(column)
    low = lowered(column)
    start, end = bare(w)
    word = slice_hash(low, start, end, 1)
    shape = shapes(w, start, end)
    again = mix(repeated_items(word_hash(w), w.doc, 5).astype(np.uint64) + np.uint64(77))
    kinds = []
    for h, n in ((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3), (again, 1)):
        p = np.flatnonzero(within(w.doc, n))
        kinds.append(((gram_hash(h, n, len(kinds) + 1)[p] & np.uint64(SLOTS - 1)).astype(np.int64), w.doc[p]))
    return w, kinds


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: distinct slots and their values."""
    w, kinds = slots(column)
    slot = np.concatenate([s for s, _ in kinds])
    doc = np.concatenate([d for _, d in kinds])
    value = np.concatenate([SCALE / np.bincount(d, minlength=w.n)[d] if d.size else np.zeros(0) for _, d in kinds])
    key, at = np.unique(doc * SLOTS + slot, return_inverse=True)
    total = np.bincount(at, weights=value, minlength=key.size)
    cut = np.searchsorted(key, np.arange(w.n + 1) * SLOTS)
    return [(key[i:j] % SLOTS, total[i:j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate learning rates; the last coordinate is the bias."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        bias = -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)
        g = sigmoid(w @ x + bias) - y
        self.update(at, g * x, w)
        self.update(np.array([SLOTS]), np.array([g]), np.array([bias]))

    def update(self, at: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more

    def final(self) -> np.ndarray:
        w = self.weights(slice(None))
        w[-1] = -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)
        return w


def train(texts: pa.Array, y: np.ndarray, epochs: int = EPOCHS, **options) -> np.ndarray:
    """Weights, the bias last."""
    rows = [x for i in range(0, len(texts), 256) for x in matrix(texts.slice(i, 256))]
    model, order = Ftrl(**options), np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i], float(y[i]))
    return model.final()


def score(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    w, kinds = slots(column)
    total = np.full(w.n, weights[-1])
    for slot, doc in kinds:
        total += SCALE * np.bincount(doc, weights=weights[slot], minlength=w.n) / np.maximum(np.bincount(doc, minlength=w.n), 1)
    return sigmoid(total)


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> np.ndarray:
    got = labelled(docs, labels, "quality", 6, FOLDS, HELD_OUT, bound).toPandas()
    if not len(got):
        return np.zeros(SLOTS + 1)
    return train(pa.array(got["text"], pa.string()), got["label"].to_numpy())


def quality_scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score for every row of ``docs``; a null text is scored as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32).astype(np.float64))
    return score_with(docs, lambda column: {"score": pa.array(score(shared.value, column))}, "score double")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality_scores(docs, fit(docs, labels))
    return found.select("doc_id", held_out_column(FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
