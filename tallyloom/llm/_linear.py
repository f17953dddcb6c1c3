"""Hashed word n-gram features for the linear models of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Words, as_bytes, gram_hash, ids, text_pieces, within, word_hash, words_of

#: Weights of a model: a power of two; the model's size does not depend on the data.
SLOTS = 1 << 18


def lowered(column: pa.Array) -> Words:
    """Words of the texts with A-Z lower-cased."""
    b = as_bytes(column)
    b.buf[(b.buf >= 65) & (b.buf <= 90)] += 32
    return words_of(b)


def bare(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and ends without ASCII punctuation around the word (kept where nothing else is left)."""
    punct = np.zeros(256, bool)
    punct[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        cut = (end - start > 1) & punct[w.buf[end - 1]]
        end -= cut
        cut = (end - start > 1) & punct[w.buf[start]]
        start += cut
    return start, end


def labelled(docs: DataFrame, labels: DataFrame, label: str, part: int, of: int, held_out: int, bound: int) -> list:
    """At most ``bound`` labelled texts to learn from, those with the least hash of their doc_id.

    Rows whose crc32(doc_id as text) mod ``of`` is in the held-out part are never read as labels.
    """
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) != held_out
    chosen = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(part)), "doc_id").limit(bound)
    own = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))
    return rows.orderBy("doc_id")


def held_out_column(of: int, part: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(of)) == part


def score_with(docs: DataFrame, score, schema: str) -> DataFrame:
    """doc_id and whatever ``score(texts)`` returns (a dict of columns) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch):
                made = score(piece.column("text"))
                yield pa.record_batch([piece.column("doc_id"), *made.values()], names=["doc_id", *made])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(run, f"doc_id long, {schema}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


__all__ = ["SLOTS", "bare", "gram_hash", "held_out_column", "ids", "labelled", "lowered", "score_with", "sigmoid", "within", "word_hash"]
