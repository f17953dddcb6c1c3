"""Suffix-array dedup by a depth-limited radix sort.

Suffixes are ordered only through ``n`` bytes. The first digit is the suffix's anchor, by which
the sort is dealt out over the cluster; suffixes whose anchor stands in no other document are
alone and leave there. In a bucket, suffixes that lie side by side in equal texts are sorted
once, as one of them. All others are sorted by most-significant-digit passes over eight bytes
each; a group of equals after the last pass is exactly one repeated window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import Chunk, Found, anchor_size, columns, family_slices, id_column, merged, mixed, outside, runs, search, spread
from ._text import _LANE_MASK, mix

BYTES = 50
ANCHOR = 20

_SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary"
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.binary())])


def maybe_repeated(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of codes that occur more than once (and rare others), equal ones together, and where new ones begin: one sort of integers."""
    bits = max(8, int(code.size).bit_length())
    packed = mix(code) >> np.uint64(bits) << np.uint64(bits) | np.arange(code.size, dtype=np.uint64)
    packed.sort()
    new = np.ones(code.size + 1, bool)
    new[1:-1] = (packed[1:] ^ packed[:-1]) >> np.uint64(bits) != 0
    many = ~(new[:-1] & new[1:])
    return (packed[many] & np.uint64((1 << bits) - 1)).astype(np.int64), new[:-1][many]


def radix_groups(lanes: np.ndarray, pos: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes through ``n`` bytes within their groups; returns members of groups of two or more, and their groups."""
    live = np.arange(pos.size)
    for at in range(0, n, 8):
        digit = lanes[pos[live] + at] & _LANE_MASK[min(8, n - at)]
        some, begins = maybe_repeated(mix(group.astype(np.uint64)) ^ digit)
        live, group, digit = live[some], group[some], digit[some]
        new = runs(group, digit)
        if (new & ~begins).any():  # unequal digits met under one hash
            order = np.lexsort((digit, group))
            live, group, digit = live[order], group[order], digit[order]
            new = runs(group, digit)
        many = ~(new & np.append(new[1:], True)) if new.size else new
        live, group = live[many], (np.cumsum(new) - 1)[many]
    return live, group


def _settle(n: int):
    def settle(found: Found, group: np.ndarray, doc: np.ndarray, pos: np.ndarray):
        """First and last window of each occurrence that also start in a smaller doc; they overlap, so all between are covered."""
        windows = found.end - found.start - n + 1
        lo, hi = windows.copy(), np.full(windows.size, -1)
        some = mixed(found)
        for own in family_slices(found, some, windows[some]):
            g, step = np.repeat(own, windows[own]), spread(windows[own])
            live, same = radix_groups(found.b.lanes(), found.start[g] + step, found.family[g], n)
            if not live.size:
                continue
            head = np.flatnonzero(runs(same))
            least = np.repeat(np.minimum.reduceat(found.least[g[live]], head), np.diff(np.append(head, live.size)))
            hit = live[least < found.least[g[live]]]
            np.minimum.at(lo, g[hit], step[hit])
            np.maximum.at(hi, g[hit], step[hit])
        later = found.least[group] < doc
        first, last = np.where(later, 0, lo[group]), np.where(later, windows[group] - 1, hi[group])
        own = np.flatnonzero(first <= last)
        return own, [first[own].astype(np.uint8), last[own].astype(np.uint8)]

    return settle


def _builder(n: int):
    def build(c: Chunk, answers: list[list[np.ndarray]]) -> pa.Table:
        place, first, last = columns(answers) if answers else (np.zeros(0, np.int64),) * 3
        place = place.astype(np.int64)
        doc, start, end = merged(c.doc(place), place + first, place + last + n)
        spans = pa.StructArray.from_arrays([pa.array(start - c.b.off[doc]), pa.array(end - start)], fields=list(_SPAN))
        per = np.searchsorted(doc, np.arange(c.who.size + 1)).astype(np.int32)
        size, removed = np.diff(c.b.off), np.bincount(doc, weights=end - start, minlength=c.who.size).astype(np.int64)
        kept = kept_bytes(c, start, end, size - removed, pa.binary())
        return pa.table([id_column(c.who), pa.array(size), pa.array(removed), pa.ListArray.from_arrays(pa.array(per), spans), kept], schema=_ARROW)

    return build


def kept_bytes(c: Chunk, start: np.ndarray, end: np.ndarray, left: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The chunk's texts without disjoint byte ranges; ``left`` bytes of each are left."""
    off = np.concatenate([[0], np.cumsum(left)]).astype(np.int32)
    size = int(c.b.off[-1])
    return pa.Array.from_buffers(kind, c.who.size, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(c.b.buf[:size][outside(size, start, end)].tobytes())])


def suffix_dedup(docs: DataFrame, n: int = BYTES, **options) -> DataFrame:
    """One row per row of ``docs``: the bytes that are left and the maximal removed spans.

    Reads ``doc_id`` and ``text`` only. A null text is empty; a null doc_id counts as larger
    than any other; rows that share a doc_id never remove each other's bytes; a text of fewer
    than ``n`` bytes stays as it is. Spans may cut a character in two, hence ``kept`` is binary.
    A worker needs some eight times its longest text.
    """
    return search(docs, False, n, anchor_size(n, ANCHOR), _settle(n), _builder(n), _SCHEMA, _ARROW, **options)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substring(h, 2 * i - 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT win, min(doc_id) AS first_doc FROM g GROUP BY win),
hit AS (SELECT doc_id, i FROM g JOIN f USING (win) WHERE first_doc < doc_id),
run AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM hit),
span AS (SELECT doc_id, min(i) AS lo, max(i) + 49 AS hi FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM run) GROUP BY doc_id, k),
keep AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM span),
left_over AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed, max(hi) AS last, string_agg(substring(h, 2 * before + 1, 2 * (lo - before - 1)), '' ORDER BY lo) AS kept FROM keep JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN kept IS NULL AND last IS NULL THEN h ELSE coalesce(kept, '') || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""
