"""Quality rules on repetition: how much of a text stands inside duplicated n-grams and lines.

Rolling hashes of several n-gram lengths are computed with numpy over a whole piece of the
table at once; per length, the characters of words inside an n-gram that occurs twice or more
in its text are measured. One pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._repeats import id_column
from ._text import Words, as_words, covered, gram_hash, ids, long_hash, mix, per_text, text_pieces, texts, within, word_hash

#: Largest share of word characters inside duplicated n-grams, by n.
NGRAM_LIMITS = {3: 0.60, 5: 0.30, 7: 0.28, 10: 0.26}
#: Largest share of characters on lines that are equal to an earlier line.
LINE_LIMIT = 0.30
#: Most symbols a word.
SYMBOL_LIMIT = 0.3
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_OUT = [("doc_id", "long"), ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("dup_line_share", "double")]


def repeated_items(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which items stand in an n-gram that occurs twice or more in their text."""
    p = np.flatnonzero(within(doc, n))
    if not p.size:
        return np.zeros(doc.size, bool)
    key = mix(gram_hash(h, n)[p] + doc[p].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(p.size, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return covered(p[twice], n, doc.size)


def _lines(w: Words, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that are equal to an earlier line of their text: their number and characters; ``points`` counts characters before each byte."""
    breaks = np.flatnonzero(w.buf[: w.off[-1]] == 10)
    first = np.searchsorted(breaks, w.off) + np.arange(w.n + 1)
    end = np.sort(np.concatenate([breaks, w.off[1:]]), kind="stable")
    start = np.empty_like(end)
    start[1:] = end[:-1] + 1
    start[first[:-1]] = w.off[:-1]
    doc = np.repeat(np.arange(w.n), np.diff(first))
    live = np.flatnonzero((np.diff(first) > 1)[doc] & (np.searchsorted(w.start, start) < np.searchsorted(w.start, end)))
    start, end, doc = start[live], end[live], doc[live]
    h, h2 = long_hash(w, start, end), long_hash(w, start, end, seed=1)
    order = np.lexsort((np.arange(doc.size), h2, h, doc))
    same = np.zeros(doc.size, bool)
    same[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    size = points[end] - points[start]
    return np.bincount(doc[same], minlength=w.n), np.bincount(doc[same], weights=size[same], minlength=w.n).astype(np.int64)


def measure(batch: pa.RecordBatch, lengths: tuple[int, ...]) -> pa.RecordBatch:
    w = as_words(texts(batch.column("text")))
    h, total = word_hash(w), np.diff(w.first)
    opens = ((w.buf & 0xC0) != 0x80) & (w.buf > 32) | (w.buf < 32) & ~np.isin(w.buf, [9, 10, 11, 12, 13])
    opens[w.off[-1] :] = False
    count = np.concatenate([[0], np.cumsum(opens)])
    chars = count[w.end] - count[w.start]
    word_chars = per_text(chars, w.first)
    symbols = per_text(_SYMBOL[w.buf[: w.off[-1]]].astype(np.int64), w.off)
    points = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
    dup_lines, dup_chars = _lines(w, points)
    dup_share = dup_chars / np.maximum(points[w.off[1:]] - points[w.off[:-1]], 1)
    repeat = repeated_items(h, w.doc, 5)
    n_repeat = per_text(repeat.astype(np.int64), w.first)
    failed = (total < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * total)
    bad, shares = dup_share > LINE_LIMIT, []
    for n in lengths:
        share = per_text(np.where(repeat if n == 5 else repeated_items(h, w.doc, n), chars, 0), w.first) / np.maximum(word_chars, 1)
        bad |= share > NGRAM_LIMITS[n]
        shares.append(pa.array(share))
    bad |= symbols > SYMBOL_LIMIT * total
    cols = [id_column(ids(batch.column("doc_id"))), *map(pa.array, (total.astype(np.int64), word_chars, symbols, dup_lines, n_repeat, failed, ~failed & ~bad, dup_share)), *shares]
    return pa.record_batch(cols, names=[x for x, _ in _OUT] + [f"dup_{n}gram_share" for n in lengths])


def repetition_rules(docs: DataFrame, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> DataFrame:
    """One row per row of ``docs`` with its measures, ``base_failed`` and the verdict ``kept``.

    A text is kept if it passes the base rules, no more than the limits' shares of its word
    characters stand inside duplicated n-grams, repeated lines make up at most LINE_LIMIT of
    its characters, and it has at most SYMBOL_LIMIT symbols a word. Reads ``doc_id`` and ``text``
    only; a null text has no words (and fails the base rules); a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch):
                yield measure(piece, lengths)

    schema = ", ".join(f"{x} {t}" for x, t in [*_OUT, *((f"dup_{n}gram_share", "double") for n in lengths)])
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(run, schema)


def op1_repetition_rules(spark, sf_dir: str) -> DataFrame:
    return repetition_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (
  SELECT n, doc_id, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (VALUES (3), (5), (7), (10)) v(n) WHERE len(ws) >= n)
),
twice AS (SELECT n, doc_id, i FROM (SELECT n, doc_id, i, count(*) OVER (PARTITION BY n, doc_id, win) AS c FROM g) WHERE c > 1),
pos AS (SELECT DISTINCT n, doc_id, unnest(range(i, i + n)) AS p FROM twice),
cov AS (SELECT n, doc_id, count(*) AS words, sum(length(ws[p])) AS chars FROM pos JOIN w USING (doc_id) GROUP BY n, doc_id),
shares AS (
  SELECT doc_id, max(words) FILTER (n = 5) AS w5, max(chars) FILTER (n = 3) AS c3, max(chars) FILTER (n = 5) AS c5, max(chars) FILTER (n = 7) AS c7, max(chars) FILTER (n = 10) AS c10 FROM cov GROUP BY doc_id
),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
dup AS (SELECT doc_id, count(*) AS n_dup, sum(length(line)) AS size FROM l WHERE nth > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(w5, 0)::BIGINT AS n_repeat_words, coalesce(size, 0)::DOUBLE / greatest(length(t), 1) AS dup_line_share, c3, c5, c7, c10
  FROM w LEFT JOIN shares USING (doc_id) LEFT JOIN dup USING (doc_id)
),
s AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, dup_line_share,
    coalesce(c3, 0)::DOUBLE / greatest(word_chars, 1) AS dup_3gram_share, coalesce(c5, 0)::DOUBLE / greatest(word_chars, 1) AS dup_5gram_share, coalesce(c7, 0)::DOUBLE / greatest(word_chars, 1) AS dup_7gram_share, coalesce(c10, 0)::DOUBLE / greatest(word_chars, 1) AS dup_10gram_share
  FROM m
)
SELECT *, NOT base_failed AND dup_line_share <= 0.3 AND n_symbols <= 0.3::DOUBLE * n_words AND dup_3gram_share <= 0.6 AND dup_5gram_share <= 0.3 AND dup_7gram_share <= 0.28 AND dup_10gram_share <= 0.26 AS kept FROM s
"""
