"""Substring dedup by relative Lempel-Ziv parsing.

All documents are the reference. It is cut into blocks by the anchors of their word windows;
a block indexes the reference texts around its anchors. Every document's text around an anchor
is parsed against the block that holds the anchor: from each word on, the longest match with a
document of smaller doc_id is found by growing matches word by word, and matches are taken
greedily. The document's parse joins what its blocks answer: a factor runs on over anchors while
source and offset stay the same, and the next factor begins where it ends. At a factor's end
the windows that lie across the boundary are checked; those the index knows become short
factors of their own. Factors of ``n`` words or more are the duplicate spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import Bytes, Chunk, Found, anchor_size, columns, family_slices, gather, hashed, id_column, merged, mixed, runs, search, spread, words_in
from ._text import mix
from .suffix_dedup import kept_bytes, maybe_repeated

WORDS = 13
ANCHOR = 7

_SCHEMA = "doc_id long, n_words long, n_removed long, factors array<struct<start:long,length:long,source:long,boundary:boolean>>, kept_text string"
_FACTOR = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64()), ("boundary", pa.bool_())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("factors", pa.list_(_FACTOR)), ("kept_text", pa.string())])


def longest(found: Found, own: np.ndarray, n: int) -> list[np.ndarray]:
    """Matches of ``n`` words or more with a smaller doc, for each word of the groups ``own``: group, word, length, source, word in the source."""
    size = found.end[own] - found.start[own]
    b = Bytes(gather(found.b, found.start[own], found.end[own]), np.concatenate([[0], np.cumsum(size)]))
    b.buf = np.concatenate([b.buf, np.zeros(32, np.uint8)])
    start, end, first = words_in(b)
    count = np.maximum(np.diff(first) - n + 1, 0)
    at, step = np.repeat(np.arange(own.size), count), spread(count)
    p = first[at] + step
    out = []
    for length in range(n, int(np.diff(first).max(initial=0)) + 1):
        fits = p + length <= first[at + 1]
        at, step, p = at[fits], step[fits], p[fits]
        lo, hi = start[p], end[p + length - 1]
        family = found.family[own[at]]
        h = hashed(b, lo, hi, 12) ^ mix(family.astype(np.uint64))
        some, _ = maybe_repeated(h)
        at, step, p, h, family = at[some], step[some], p[some], h[some], family[some]
        h2 = hashed(b, lo[some], hi[some], 13)
        least, pos = found.least[own[at]], found.pos[own[at]] + step
        order = np.lexsort((pos, least, h2, h, family))
        new = runs(family[order], h[order], h2[order])
        head = order[new][np.cumsum(new) - 1]
        alone = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] < 2 if new.size else new
        known = least[head] < least[order]
        hit = order[known]
        out.append((own[at[hit]], step[hit], np.full(hit.size, length), least[head[known]], pos[head[known]]))
        go = np.sort(order[~alone])
        at, step, p = at[go], step[go], p[go]
        if not at.size:
            break
    return columns(out) if out else [np.zeros(0, np.int64)] * 5


def greedy(group: np.ndarray, word: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Matches taken in order of words: of those from one word the longest, then on from the first word whose window it does not hold."""
    order = np.lexsort((-length, word, group))
    order = order[runs(group[order], word[order])]
    taken, done = [], {}
    group, word, length = group[order], word[order], length[order]
    number = np.cumsum(runs(group)) - 1 if group.size else group
    reach = np.full(number[-1] + 1 if number.size else 0, -1)
    for at in np.unique(word):
        here = np.flatnonzero(word == at)
        here = here[reach[number[here]] < at]
        reach[number[here]] = at + length[here] - n
        taken.append(order[here])
    return np.sort(np.concatenate(taken)) if taken else order


def _settle(n: int):
    def settle(found: Found, group: np.ndarray, doc: np.ndarray, pos: np.ndarray):
        """The greedy parse of each occurrence against the documents with a smaller doc_id."""
        some, out = mixed(found), []
        for own in family_slices(found, some, np.maximum(1, (found.end - found.start)[some] // 4)):
            got = longest(found, own, n)
            take = greedy(*got[:3], n)
            out.append([x[take] for x in got])
        g, word, length, source, at = columns(out) if out else [np.zeros(0, np.int64)] * 5
        order = np.lexsort((word, g))
        g, word, length, source, at = (x[order] for x in (g, word, length, source, at))
        later = found.least[group] < doc
        # The group's first document takes the parse; a later one has all the text in the first.
        lo, hi = np.searchsorted(g, group), np.searchsorted(g, group, "right")
        count = np.where(later, 0, hi - lo)
        own, nth = np.repeat(np.arange(group.size), count), np.repeat(lo, count) + spread(count)
        whole = np.flatnonzero(later)
        # Words of a group's text: its single spaces and one.
        gaps = np.concatenate([[0], np.cumsum(found.b.buf == 32, dtype=np.int32)])
        words = gaps[found.end] - gaps[found.start] + 1
        return np.concatenate([whole, own]), [
            np.concatenate([np.zeros(whole.size, np.uint8), word[nth].astype(np.uint8)]),
            np.concatenate([words[group[whole]], length[nth]]).astype(np.uint16),
            np.concatenate([found.least[group[whole]], source[nth]]),
            np.concatenate([found.pos[group[whole]], at[nth]]).astype(np.uint32),
        ]

    return settle


def factors(c: Chunk, answers: list[list[np.ndarray]], n: int) -> list[np.ndarray]:
    """The parse of the chunk's documents: doc, start, end, source and whether the factor was found at a boundary."""
    if not answers:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
    place, word, length, source, at = (x.astype(np.int64) for x in columns(answers))
    start = place + word
    order = np.argsort(start, kind="stable")
    start, length, source, at = start[order], length[order], source[order], at[order]
    doc = c.doc(start)
    last = start + length - n
    shift = at - (start - c.first[doc])
    new = runs(doc, source, shift)
    new[1:] |= start[1:] != last[:-1] + 1
    head = np.flatnonzero(new)
    tail = np.append(head[1:], new.size) - 1
    out, reach, before = [], -1, -1
    for d, s, t, who in zip(doc[head].tolist(), start[head].tolist(), last[tail].tolist(), source[head].tolist()):
        if d != before:
            before, reach = d, -1
        if s < reach:
            # Windows across the end of the factor before.
            out.append((d, s, min(t, reach - 1) + n, who, True))
        if t >= reach:
            out.append((d, max(s, reach), t + n, who, False))
            reach = t + n
    d, s, e, who, boundary = zip(*out)
    return [*(np.array(x, np.int64) for x in (d, s, e, who)), np.array(boundary, bool)]


def _builder(n: int):
    def build(c: Chunk, answers: list[list[np.ndarray]]) -> pa.Table:
        doc, s, e, source, boundary = factors(c, answers, n)
        order = np.lexsort((s, doc))
        found = pa.StructArray.from_arrays([pa.array((s - c.first[doc])[order]), pa.array((e - s)[order]), pa.array(source[order]), pa.array(boundary[order])], fields=list(_FACTOR))
        per = np.searchsorted(doc[order], np.arange(c.who.size + 1)).astype(np.int32)
        doc, s, e = merged(doc, s, e)
        removed = np.bincount(doc, weights=e - s, minlength=c.who.size).astype(np.int64)
        # A word goes with the space after it; the last ones with the space before them.
        bottom = e == c.first[doc + 1]
        start = c.start[s] - (bottom & (s > c.first[doc]))
        end = np.where(bottom, c.b.off[doc + 1], c.start[np.minimum(e, max(c.size - 1, 0))] if c.size else s)
        left = np.diff(c.b.off) - np.bincount(doc, weights=end - start, minlength=c.who.size).astype(np.int64)
        return pa.table(
            [id_column(c.who), pa.array(np.diff(c.first).astype(np.int64)), pa.array(removed), pa.ListArray.from_arrays(pa.array(per), found), kept_bytes(c, start, end, left, pa.string())], schema=_ARROW
        )

    return build


def substring_dedup(docs: DataFrame, n: int = WORDS, **options) -> DataFrame:
    """One row per row of ``docs``: the words that are left, joined by single spaces, and the factors that went.

    Reads ``doc_id`` and ``text`` only, so other columns may have any names. A null text has
    no words; a null doc_id counts as larger than any other; rows that share a doc_id never
    remove each other's words; a text of fewer than ``n`` words loses none. ``source`` is the
    document that has the factor's words. Words are matched by 128 bits of hashes.
    A worker needs some twenty times its longest text.
    """
    return search(docs, True, n, anchor_size(n, ANCHOR), _settle(n), _builder(n), _SCHEMA, _ARROW, **options)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), f AS (SELECT win, min(doc_id) AS first_doc FROM g GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM g JOIN f USING (win) WHERE first_doc < doc_id
), r AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ats), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ats IS NULL THEN ws ELSE list_filter(ws, lambda x, pos: NOT list_contains(ats, pos)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
