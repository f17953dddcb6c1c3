"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score on hashed words and stems;
the document's is their noisy-or, 1 - prod(1 - p). Only documents have labels: the gradient
of the bag's log loss reaches each sentence through the noisy-or, so training finds the
sentences that explain the label, and scoring locates them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._linear import SLOTS, bare, held_out_column, labelled, lowered, score_with, sigmoid
from ._text import Words, slice_hash, text_pieces

#: Most labelled texts to learn from.
MAX_LABELLED = 6000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.2
#: Words longer than these numbers of bytes count by their first bytes, too.
STEMS = (4, 5, 6, 7)
#: Sentences start out as this unlikely to be toxic.
PRIOR = -8.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


def sentences(w: Words) -> np.ndarray:
    """The number of each word's sentence; sentences end at ``.``, ``!``, ``?``, a line break or the text's end."""
    stops = np.concatenate([[0], np.cumsum(_ENDS[w.buf[: w.off[-1]]])])
    new = np.zeros(w.start.size, bool)
    if new.size:
        new[0] = True
        new[1:] = (w.doc[1:] != w.doc[:-1]) | (stops[w.start[1:]] > stops[w.end[:-1] - 1])
    return np.cumsum(new) - 1


def slots(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, each word's sentence, and (slot, sentence) of all features: bare words and the first bytes of longer ones."""
    w = lowered(column)
    sentence = sentences(w)
    start, end = bare(w)
    slot, own = [slice_hash(w, start, end, 1)], [sentence]
    for n in STEMS:
        stem = np.flatnonzero(end - start > n)
        slot.append(slice_hash(w, start[stem], start[stem] + n, 2))
        own.append(sentence[stem])
    return w, sentence, (np.concatenate(slot) & np.uint64(SLOTS - 1)).astype(np.int64), np.concatenate(own)


def bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Per text: slots, the sentence of each within the text, number of sentences; each slot once a sentence."""
    w, sentence, slot, own = slots(column)
    key = np.unique(own * SLOTS + slot)
    slot, own = key % SLOTS, key // SLOTS
    first = np.searchsorted(sentence, np.arange(sentence[-1] + 2 if sentence.size else 1))
    doc = w.doc[first[:-1]] if sentence.size else np.zeros(0, int)
    lo, hi = np.searchsorted(doc, np.arange(w.n)), np.searchsorted(doc, np.arange(w.n), "right")
    a, b = np.searchsorted(own, lo), np.searchsorted(own, hi)
    return [(slot[a[i] : b[i]].astype(np.int32), (own[a[i] : b[i]] - lo[i]).astype(np.int32), int(hi[i] - lo[i])) for i in range(w.n)]


def weights_of(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Proximal weights, none below zero: a word may speak for toxicity, but none excuses another."""
    return np.maximum(0.0, -z - l1) / ((beta + np.sqrt(n)) / alpha + l2)


def train(texts: pa.Array, y: np.ndarray, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Sentence weights, the bias last, by per-coordinate proximal updates on the bags' log loss."""
    rows = [x for i in range(0, len(texts), 256) for x in bags(texts.slice(i, 256))]
    z, n, order = np.zeros(SLOTS), np.zeros(SLOTS), np.random.default_rng(9)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slot, own, size = rows[i]
            if not size:
                continue
            at, back = np.unique(slot, return_inverse=True)
            w = weights_of(z[at], n[at], alpha, beta, l1, l2)
            p = sigmoid(np.bincount(own, weights=w[back], minlength=size) + PRIOR)
            clean = np.exp(np.log1p(-p).sum())
            pull = -p * clean / max(1 - clean, 1e-9) if y[i] else p
            g = np.bincount(back, weights=pull[own], minlength=at.size)
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return np.append(weights_of(z, n, alpha, beta, l1, l2), PRIOR)


def score(weights: np.ndarray, column: pa.Array, threshold: float = THRESHOLD) -> dict[str, pa.Array]:
    """The document's noisy-or score, and the byte spans of sentences at or over the threshold."""
    w, sentence, slot, own = slots(column)
    number = int(sentence[-1]) + 1 if sentence.size else 0
    live = np.flatnonzero(weights[slot])
    key = np.unique(own[live] * SLOTS + slot[live])
    # Above what a sentence without evidence has: any number of such sentences leaves a text clean.
    p = np.maximum(sigmoid(np.bincount(key // SLOTS, weights=weights[:-1][key % SLOTS], minlength=number) + weights[-1]) - sigmoid(weights[-1]), 0)
    first = np.searchsorted(sentence, np.arange(number))
    last = np.searchsorted(sentence, np.arange(number), "right") - 1
    doc = w.doc[first]
    total = 1 - np.exp(np.bincount(doc, weights=np.log1p(-p), minlength=w.n)) if number else np.zeros(w.n)
    bad = np.flatnonzero(p >= threshold)
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    spans = pa.StructArray.from_arrays([pa.array(w.start[first[bad]] - w.off[doc[bad]]), pa.array(w.end[last[bad]] - w.off[doc[bad]]), pa.array(p[bad])], fields=list(kind))
    off = np.searchsorted(doc[bad], np.arange(w.n + 1)).astype(np.int32)
    return {"score": pa.array(np.clip(total, 0, 1)), "sentences": pa.ListArray.from_arrays(pa.array(off), spans)}


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> np.ndarray:
    """Weights learned in one task, so that the driver holds neither the texts nor their features."""

    def run(batches):
        rows = pa.Table.from_batches(batches, schema)
        if rows.num_rows:
            rows = rows.sort_by("doc_id").combine_chunks()
            weights = train(rows["text"].combine_chunks().cast(pa.string()), rows["label"].to_numpy())
            yield pa.record_batch([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    rows = labelled(docs, labels, "toxic", 10, FOLDS, HELD_OUT, bound).selectExpr("doc_id", "text", "cast(label AS double) AS label")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("label", pa.float64())])
    got = rows.coalesce(1).mapInArrow(run, "weights binary").collect()
    return np.frombuffer(bytes(got[0][0])) if got else np.append(np.zeros(SLOTS), PRIOR)


def toxicity_scores(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and the offending sentences (byte spans) of every row of ``docs``.

    A null or empty text has no sentence and scores 0. Reads ``doc_id`` and ``text`` only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return score_with(docs, lambda column: score(shared.value, column, threshold), "score double, sentences array<struct<start:long,end:long,score:double>>")


def drop_toxic(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, all columns as they are, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns
    text = names.index("text")

    def run(batches):
        for batch in batches:
            renamed = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(batch.num_columns)])
            for piece in text_pieces(renamed, f"c{text}"):
                low = pc.less(score(shared.value, piece.column(text), threshold)["score"], threshold)
                yield pa.RecordBatch.from_arrays(piece.filter(low).columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity_scores(docs, fit(docs, labels))
    return found.select("doc_id", held_out_column(FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("sentences").cast("long").alias("n_toxic_sentences"))
