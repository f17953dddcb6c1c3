"""Exact dedup with two-pass Bloom filtering.

Pass one sets each text's bit and learns which bits were set more than once. Only rows whose
bit was ("possibly repeated") take part in the shuffle of pass two; all others pass straight
through. The filter has some 16 bits a row, ``FILTER_BYTES`` at most. More rows than that serves
are kept by range of their hash, without a shuffle, and every range has a filter of its own,
which goes to the tasks that read the range. A filter is built in segments that are merged apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import settle_state, settle_table
from ._repeats import dump, id_column, load, split
from ._skew import look_up
from ._text import WHITESPACE, as_bytes, ids, text_pieces

BITS_A_ROW = 16
SEGMENT_BITS = 1 << 20
#: Most bytes of one range's filter.
FILTER_BYTES = 64 << 20


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_pieces(batch):
            b = as_bytes(piece.column("text"))
            opens = np.concatenate([[0], np.cumsum((b.buf & 0xC0) != 0x80)])
            sha = [hashlib.sha256(b.text(i).translate(None, WHITESPACE)).digest() for i in range(b.n)]
            word = np.frombuffer(b"".join(sha), "<i8")[::4] if sha else np.zeros(0, np.int64)
            yield pa.record_batch([id_column(ids(piece.column("doc_id"))), pa.array(opens[b.off[1:]] - opens[b.off[:-1]]), pa.array(word), pa.array(sha, pa.binary())], names=["doc_id", "points", "h", "sha"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points, and the SHA-256 of the text without whitespace (null: empty)."""
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(_digest, "doc_id long, points long, h long, sha binary")


def repeated_bits(hashes: DataFrame, segments: int) -> DataFrame:
    """(key, bits): for each segment of the filter, the positions that were set twice or more."""

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)]).view(np.uint64)
        bit, n = np.unique(h % np.uint64(segments * SEGMENT_BITS), return_counts=True)
        key = (bit // np.uint64(SEGMENT_BITS)).astype(np.int64)
        at = (bit % np.uint64(SEGMENT_BITS)).astype(np.uint32)
        made = [(k, dump(at[s], np.packbits(n[s] > 1))) for k, s in split(key)]
        yield pa.record_batch([pa.array([k for k, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], names=["key", "bits"])

    def merge(key, table):
        once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
        for blob in table.column("bits"):
            at, many = load(blob.as_py())
            twice[at] |= once[at] | np.unpackbits(many, count=at.size).astype(bool)
            once[at] = True
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    return hashes.select("h").mapInArrow(sort_out, "key long, bits binary").groupBy("key").applyInArrow(merge, "key long, bits binary")


def possibly_repeated(rows: DataFrame, n_rows: int, filter_bytes: int) -> DataFrame:
    """``rows`` (with a hash ``h``) and the column ``maybe``, false only where no other row has the same hash. No row is shuffled."""
    ranges = max(1, -(-n_rows * BITS_A_ROW // (8 * filter_bytes)))
    segments = max(1, -(-n_rows * BITS_A_ROW // (ranges * SEGMENT_BITS)))
    if ranges == 1:
        # One filter serves every task, so the rows need not be kept by range.
        return rows.withColumn("maybe", _tester(settle_table(rows.select("h")), segments)("h"))
    stored = settle_state(rows.withColumn("range", F.pmod(F.shiftright("h", 40), F.lit(ranges)).cast("int")), "range")
    out = None
    for k in range(ranges):
        own = stored.where(F.col("range") == k).drop("range")
        part = own.withColumn("maybe", _tester(own, segments)("h"))
        out = part if out is None else out.unionByName(part)
    return out


def _tester(rows: DataFrame, segments: int):
    """A UDF that looks hashes up in the filter of ``rows``."""
    bits = np.zeros(segments * SEGMENT_BITS // 8, np.uint8)
    # The filter's own bytes, ``FILTER_BYTES`` at most, in one job: an iterator would run one for each partition.
    for key, part in repeated_bits(rows, segments).collect():
        bits[key * SEGMENT_BITS // 8 : (key + 1) * SEGMENT_BITS // 8] = np.frombuffer(part, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        at = h.to_numpy().view(np.uint64) % np.uint64(segments * SEGMENT_BITS)
        return pd.Series(shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1 == 1)

    return test


def exact_groups(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without ``[\\x20\\x09-\\x0D]``; null counts as empty.
    Of equal texts the one with most code points stays, then the smallest doc_id, null after
    all others; of rows that tie in both, one. Exactly one row of a group is kept. Reads
    ``doc_id`` and ``text`` only. An empty table gives an empty result.
    """
    total = docs.count()
    numbered = settle_table(digests(docs).withColumn("n", F.monotonically_increasing_id()))
    rows = settle_table(possibly_repeated(numbered, total, filter_bytes))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = rows.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    maybe = rows.where("maybe").select("doc_id", "points", "sha", "n")
    best = F.max_by(F.struct("doc_id", "n"), F.struct("points", F.col("doc_id").isNotNull(), -F.col("doc_id"), -F.col("n"))).alias("keep")
    groups = settle_table(maybe.groupBy("sha").agg(best, F.count(F.lit(1)).alias("group_size")))
    found = look_up(maybe, groups, "sha", "group_size", total)
    return alone.unionByName(found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("n") == F.col("keep.n")).alias("kept"), sha))


def drop_copies(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; exactly one of each group.

    Rows whose hash the filter has only once are never shuffled. Of the others, whole rows meet
    by a hash of their text, one row of each group and task at most (the aggregation starts
    before the shuffle). Of rows that tie in code points and doc_id, any one stays. Column
    names may be anything: the row travels as one struct.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    bare = F.regexp_replace(F.coalesce(F.col("row.text"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")
    rows = whole.withColumn("sha", F.unhex(F.sha2(bare, 256))).withColumn("h", F.xxhash64("sha"))
    rows = possibly_repeated(rows, docs.count(), filter_bytes)
    points, doc = F.coalesce(F.char_length(F.col("row.text")), F.lit(0)), F.col("row.doc_id")
    best = rows.where("maybe").groupBy("sha").agg(F.max_by("row", F.struct(points, doc.isNotNull(), -doc)).alias("row"))
    return rows.where("NOT maybe").select("row").unionByName(best.select("row")).select("row.*")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), r AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
