"""Windows of n items (words, bytes, lines) that also start in a document with a smaller doc_id.

A window's *anchor* is its least k-gram, so equal windows pick equal anchors. The consecutive
windows that share one anchor occurrence form a *context*. Documents are shuffled once into
chunks, packed and compressed; the same exchange feeds the three passes of ``search``:

1. every chunk sends its distinct anchors (six bytes each) to the anchors' buckets, which
   answer with one bit per anchor: does it stand in another document, and a second one: is it hot;
2. the contexts of repeated anchors go, as text, to the anchors' buckets, once for each distinct
   context of a chunk; a ``settle`` function compares the contexts of an anchor and answers for
   each occurrence what it found in documents with a smaller doc_id;
3. every chunk builds its rows from the answers.

A hot anchor's contexts are cut in two, each part under a longer anchor, so that common phrases
spread over many buckets. A passage that stands in every document costs one entry per chunk;
chunks grow with the square root of the text. No list of partners is ever built.

Memory: a task holds a chunk (``MOST_CHUNK_BYTES`` or its longest text) and some four times that
in masks and copies; anchors are searched in segments, so nothing of eight bytes per byte of text is built.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import _LANE_MASK, LAST_ID, WHITESPACE, Bytes, as_bytes, gram_hash, ids, long_hash, mix, slice_hash, sliding_argmin, texts, within

#: Text behind a chunk: some 32 times the square root of all text, within these bounds.
LEAST_CHUNK_BYTES, MOST_CHUNK_BYTES = 1 << 20, 16 << 20
#: Text behind a bucket.
LEAST_BUCKET_BYTES, MOST_BUCKET_BYTES = 2 << 20, 8 << 20
PACK_BYTES = 16 << 20
#: Windows looked at in one go.
SEGMENT = 1 << 17
#: Anchors that stand in about this many places, or more, have their contexts cut in two.
HOT = 2048
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Anchors are told apart by the bits above these.
_PLACE = np.uint64((1 << 20) - 1)
_ROW = "key long, chunk long, payload binary"
_SCHEMA = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary())])
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WHITESPACE)] = True


# -- packing ---------------------------------------------------------------


def sizing(docs: DataFrame) -> tuple[int, int]:
    """Numbers of chunks and buckets. They follow the text, so that a chunk sends each bucket many entries in one row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = min(MOST_CHUNK_BYTES, max(LEAST_CHUNK_BYTES, 32 * math.isqrt(size)))
    return max(1, math.ceil(size / chunk)), max(1, min(2 * parts, math.ceil(size / LEAST_BUCKET_BYTES)), math.ceil(size / MOST_BUCKET_BYTES))


def joined_words(b: Bytes) -> Bytes:
    """The texts' words joined by single spaces."""
    size = int(b.off[-1])
    solid = ~_IS_SPACE[b.buf[:size]]
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first whitespace after a word stands for all of it
    some = b.off[:-1] < b.off[1:]
    opens = b.off[:-1][some]
    keep[opens] = solid[opens]
    # No space after a text's last word.
    counts = np.add.reduceat(keep.view(np.uint8), opens, dtype=np.int64) if opens.size else np.zeros(0, np.int64)
    flat, last = np.where(solid, b.buf[:size], np.uint8(32))[keep], np.cumsum(counts) - 1
    spare = np.flatnonzero(counts > 0)
    spare = spare[flat[last[spare]] == 32]
    flat = np.delete(flat, last[spare])
    counts[spare] -= 1
    per = np.zeros(b.n, np.int64)
    per[some] = counts
    off = np.concatenate([[0], np.cumsum(per)])
    return Bytes(np.concatenate([flat, np.zeros(32, np.uint8)]), off)


def pack(docs: DataFrame, chunks: int, words: bool) -> DataFrame:
    """Documents as compressed blobs (chunk, raw, rows, blob); a document's chunk follows from its doc_id (from its text where that is null)."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        who, column = ids(table.column("doc_id")), texts(table.column("text"))
        code = who.view(np.uint64).copy()
        if (lost := np.flatnonzero(who == LAST_ID)).size:
            b = as_bytes(column.take(pa.array(lost)))
            code[lost] = long_hash(b, b.off[:-1], b.off[1:])
        chunk = (mix(code) % np.uint64(chunks)).astype(np.int64)
        order = np.argsort(chunk, kind="stable")
        b, who, chunk = as_bytes(column.take(pa.array(order))), who[order], chunk[order]
        if words:
            b = joined_words(b)
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1))
        blobs, sizes = [], []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            raw = who[i:j].tobytes() + np.diff(b.off[i : j + 1]).tobytes() + b.buf[b.off[i] : b.off[j]].tobytes()
            blobs.append(pa.compress(raw, codec="zstd", asbytes=True))
            sizes.append((len(raw), j - i))
        raw, rows = np.array(sizes, np.int64).reshape(-1, 2).T
        yield pa.record_batch([pa.array(chunk[cuts[:-1]]), pa.array(raw), pa.array(rows), pa.array(blobs, pa.binary())], names=["chunk", "raw", "rows", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > PACK_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "chunk long, raw long, rows long, blob binary")


@dataclass
class Chunk:
    """Texts in order of doc_id. ``first`` has each text's first item and their number; ``start``/``end`` are the items' bytes (None: items are bytes)."""

    who: np.ndarray
    b: Bytes
    first: np.ndarray
    start: np.ndarray | None = None
    end: np.ndarray | None = None
    h: np.ndarray = field(default=None)

    @property
    def size(self) -> int:
        return int(self.first[-1])

    def slices(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of items i..j-1."""
        return (i, j) if self.start is None else (self.start[i], self.end[j - 1])

    def grams(self, at: int, to: int, k: int) -> np.ndarray:
        """Hashes of the k-grams from items at..to-1 on."""
        if self.h is not None:
            return gram_hash(self.h[at : to + k - 1], k)
        lanes, m = self.b.lanes(), to - at
        out = lanes[at : at + m] * _A
        for i, by in zip([*range(8, k - 7, 8), *([k - 8] if k % 8 and k > 8 else [])], (_B, _C, _A ^ _B, _A ^ _C, _B ^ _C, _A, _B, _C)):
            out += (lanes[at + i : at + i + m] ^ out >> np.uint64(32)) * by
        return out

    def doc(self, item: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, item, "right") - 1

    def doc_of_sorted(self, item: np.ndarray) -> np.ndarray:
        """The same for items in order."""
        if not item.size:
            return item
        lo, hi = self.doc(item[[0, -1]]).tolist()
        return np.repeat(np.arange(lo, hi + 1), np.diff(np.searchsorted(item, self.first[lo + 1 : hi + 1]), prepend=0, append=item.size))


def unpacked(table: pa.Table, items: Callable[[np.ndarray, Bytes], Chunk]) -> Chunk:
    """A chunk, its texts in order of doc_id (equal ones by their hash), whatever order its rows came in."""
    who, lens, data = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for raw, n, blob in zip(table.column("raw").to_pylist(), table.column("rows").to_pylist(), table.column("blob")):
        flat = np.frombuffer(pa.decompress(blob.as_buffer(), decompressed_size=raw, codec="zstd"), np.uint8)
        who.append(flat[: 8 * n].view(np.int64))
        lens.append(flat[8 * n : 16 * n].view(np.int64))
        data.append(flat[16 * n :])
    who, lens = np.concatenate(who), np.concatenate(lens)
    off = np.concatenate([[0], np.cumsum(lens)])
    flat = np.concatenate([*data, np.zeros(32, np.uint8)])
    del data
    order = np.argsort(who, kind="stable")
    tied = np.zeros(who.size, bool)
    tied[1:] = who[order][1:] == who[order][:-1]
    tied[:-1] |= tied[1:]
    if tied.any():
        some = order[tied]
        tie = np.zeros(who.size, np.uint64)
        tie[some] = long_hash(Bytes(flat, off), off[some], off[some + 1])
        order = np.lexsort((tie, who))
    buf = np.concatenate([*(flat[off[i] : off[i + 1]] for i in order.tolist()), np.zeros(32, np.uint8)])
    return items(who[order], Bytes(buf, np.concatenate([[0], np.cumsum(lens[order])])))


def bytes_of(who: np.ndarray, b: Bytes) -> Chunk:
    return Chunk(who, b, b.off)


def words_in(b: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of joined texts, and the first word of each text."""
    gaps, some = np.flatnonzero(b.buf[: b.off[-1]] == 32), b.off[:-1] < b.off[1:]
    start, end = np.sort(np.concatenate([gaps + 1, b.off[:-1][some]])), np.sort(np.concatenate([gaps, b.off[1:][some]]))
    return start, end, np.searchsorted(start, b.off)


def words_of_chunk(who: np.ndarray, b: Bytes) -> Chunk:
    start, end, first = words_in(b)
    return Chunk(who, b, first, start, end, hashed(b, start, end, 0))


def lines_of(who: np.ndarray, b: Bytes) -> Chunk:
    """Lines between newlines; the last line of a text may be empty."""
    breaks = np.flatnonzero(b.buf[: b.off[-1]] == 10)
    first = np.searchsorted(breaks, b.off) + np.arange(b.n + 1)
    end = np.sort(np.concatenate([breaks, b.off[1:]]), kind="stable")
    start = np.empty_like(end)
    start[1:] = end[:-1] + 1
    start[first[:-1]] = b.off[:-1]
    return Chunk(who, b, first, start, end)


def hashed(b: Bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of byte slices, some at a time."""
    step = 1 << 16
    return np.concatenate([np.zeros(0, np.uint64), *(slice_hash(b, start[i : i + step], end[i : i + step], seed) for i in range(0, start.size, step))])


# -- payloads --------------------------------------------------------------


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays, each with its type and length in front."""
    return b"".join(np.array([ord(a.dtype.kind) << 8 | a.dtype.itemsize, a.size], np.int64).tobytes() + a.tobytes() for a in arrays)


def load(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n = np.frombuffer(blob, np.int64, 2, at)
        kind = np.dtype(f"{chr(kind >> 8)}{kind & 255}")
        out.append(np.frombuffer(blob, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


def short(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids as a base and offsets, four bytes each where they fit."""
    base = who.min(initial=LAST_ID)
    gap = (who.astype(np.int64) - base).view(np.uint64)
    return np.array([base], np.int64), gap.astype(np.uint32) if gap.max(initial=0) < 1 << 32 else gap


def long(base: np.ndarray, gap: np.ndarray) -> np.ndarray:
    return base[0] + gap.astype(np.int64)


def rows(found: list[tuple[int, int, bytes]]) -> pa.Table:
    key, chunk, payload = zip(*found) if found else ((), (), ())
    return pa.table([pa.array(key, pa.int64()), pa.array(chunk, pa.int64()), pa.array(payload, pa.binary())], schema=_SCHEMA)


def columns(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)]


def split(by: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values."""
    cuts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1], [True]])) if by.size else np.zeros(1, int)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(by[i]), slice(i, j)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.ones(keys[0].size, bool)
    if new.size:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def spread(size: np.ndarray) -> np.ndarray:
    """0..size-1 for each size, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def gather(b: Bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of the slices, joined."""
    size = end - start
    return b.buf[np.repeat(start, size) + spread(size)]


def same_bytes(b: Bytes, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from x and from y on are the same."""
    lanes, same = b.lanes(), np.ones(x.size, bool)
    live, at = np.arange(x.size), 0
    while live.size:
        left = size[live] - at
        same[live] &= (lanes[x[live] + at] ^ lanes[y[live] + at]) & _LANE_MASK[np.minimum(left, 8)] == 0
        live, at = live[same[live] & (left > 8)], at + 8
    return same


def equal_slices(b: Bytes, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by 44 bits of ``key`` that brings equal slices of a key together, and where each new one begins in it."""
    size = end - start
    code = key & ~_PLACE | hashed(b, start, end, 11) >> np.uint64(44)
    order = np.argsort(code)
    new = runs(code[order])
    rest = np.flatnonzero(~new)
    if rest.size:
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        own, to = order[rest], order[head[rest]]
        other = np.zeros(order.size, bool)
        other[rest] = (size[own] != size[to]) | ~same_bytes(b, start[own], start[to], size[own])
        if other.any():
            # Unequal bytes under one hash: from the first such slice on, each makes a group of its own, which only costs work.
            count = np.cumsum(other)
            new |= count > count[head]
    return order, new


# -- the search ------------------------------------------------------------


def anchor_size(n: int, least: int) -> int:
    """Items of an anchor: ``least`` or more, so that a context's n - k + 1 windows fit a mask of 64 bits."""
    return max(min(least, n), n - 63)


def contexts(c: Chunk, n: int, k: int, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, anchor item, anchor hash and text of every context of the chunk, in order."""
    found, last = [], c.size - n + 1
    for s in range(0, max(last, 0), segment):
        e = min(s + segment, last)
        grams = c.grams(s, e + n - k, k)
        at = sliding_argmin(grams, n - k + 1)
        lo, hi = np.searchsorted(c.first, (s - n, e + n))
        seams = c.first[lo:hi]
        seams = np.sort(np.concatenate([seams, seams - n + 1]))
        seams = np.concatenate([[s], seams[(seams > s) & (seams < e)]])
        p0 = s + 1 + np.flatnonzero(at[1:] != at[:-1])
        p0 = np.insert(p0, np.searchsorted(p0, seams), seams)
        p0 = p0[runs(p0)]
        p1 = np.append(p0[1:], e) - 1
        doc = c.doc_of_sorted(p0)
        inside = np.flatnonzero(p0 + n <= c.first[doc + 1])
        p0, p1 = p0[inside], p1[inside]
        a = at[p0 - s]
        found.append((p0, p1, a + s, mix(grams[a]), doc[inside]))
    return tuple(columns(found)) if found else (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64), np.zeros(0, np.int64))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def ask(c: Chunk, n: int, k: int, buckets: int, chunk: int, segment: int) -> pa.Table:
    """The chunk's distinct anchors: 44 bits, whether in several documents, and the logarithm of the number of places."""
    *_, h, doc = contexts(c, n, k, segment)
    order, h, head, count = by_anchor(h)
    several = c.who[doc[order[head]]] != c.who[doc[order[head + count - 1]]]
    note = (np.log2(np.maximum(count, 1)).astype(np.uint8) << 1 | several).astype(np.uint8)
    h = h[head]
    return rows([(key, chunk, dump((h[s] >> np.uint64(32)).astype(np.uint32), (h[s] >> np.uint64(16)).astype(np.uint16), note[s])) for key, s in split(bucket_of(h, buckets))])


def by_anchor(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts in order of 44 bits of their anchor hash: the order, the hashes, and the first and number of each anchor's."""
    if h.size <= 1 << 20:
        # One sort of integers, the place in the bits below.
        h = h & ~_PLACE | np.arange(h.size, dtype=np.uint64)
        h.sort()
        order, h = (h & _PLACE).astype(np.int64), h & ~_PLACE
    else:
        h = h & ~_PLACE
        order = np.argsort(h, kind="stable")
        h = h[order]
    head = np.flatnonzero(runs(h))
    return order, h, head, np.diff(np.append(head, h.size))


def answer(key: int, table: pa.Table, many: int) -> pa.Table:
    """Two bits for each anchor that a chunk sent: it stands in several documents; it is hot."""
    parts = [load(x.as_py()) for x in table.column("payload")]
    size = np.array([p[0].size for p in parts])
    high, low, note = columns(parts)
    bits = max(20, int(size.sum()).bit_length())
    # One sort of integers: a hash of the anchor above, the place below. Anchors that share the hash by chance only cost work.
    code = mix(high.astype(np.uint64) << np.uint64(16) | low) >> np.uint64(bits) << np.uint64(bits) | np.arange(high.size, dtype=np.uint64)
    code.sort()
    place = (code & np.uint64((1 << bits) - 1)).astype(np.int64)
    head = np.flatnonzero(runs(code >> np.uint64(bits)))
    count = np.diff(np.append(head, code.size))
    note = note[place]
    repeated = (count > 1) | np.logical_or.reduceat(note & 1 > 0, head)
    hot = np.add.reduceat(np.int64(1) << (note >> 1).astype(np.int64), head) >= many
    flags = np.zeros((2, place.size), bool)
    flags[0, place], flags[1, place] = np.repeat(repeated, count), np.repeat(hot & repeated, count)
    off = np.concatenate([[0], np.cumsum(size)])
    return rows([(key, c, dump(np.packbits(flags[:, i:j], axis=1).ravel())) for c, i, j in zip(table.column("chunk").to_pylist(), off[:-1].tolist(), off[1:].tolist()) if flags[0, i:j].any()])


def detail(c: Chunk, replies: pa.Table, n: int, k: int, buckets: int, chunk: int, segment: int) -> pa.Table:
    """The contexts of repeated anchors, as text, each distinct one once, with the places where they stand."""
    p0, p1, a, h, _ = contexts(c, n, k, segment)
    order, h, head, count = by_anchor(h)
    flags = np.zeros((2, head.size), bool)
    begin = {key: s for key, s in split(bucket_of(h[head], buckets))}
    for key, blob in zip(replies.column("key").to_pylist(), replies.column("payload")):
        s = begin[key]
        flags[:, s] = np.unpackbits(load(blob.as_py())[0].reshape(2, -1), axis=1, count=s.stop - s.start)
    pick = np.repeat(flags[0], count)
    own, h, hot = order[pick], h[pick], np.repeat(flags[1], count)[pick]
    p0, p1, a = p0[own], p1[own], a[own]
    if hot.any() and n > k:
        # Windows that reach far to the left of the anchor go under a longer anchor there, the others to the right.
        cut = a[hot] - (n - k + 1) // 2
        x0, x1, at = p0[hot], p1[hot], a[hot]
        left, right = x0 <= cut, x1 > cut
        cool = ~hot
        longer = hashed(c.b, *c.slices(np.concatenate([cut[left], at[right]]), np.concatenate([at[left] + k, cut[right] + n + 1])), 13)
        p0, p1 = np.concatenate([p0[cool], x0[left], np.maximum(x0, cut + 1)[right]]), np.concatenate([p1[cool], np.minimum(x1, cut)[left], x1[right]])
        h = np.concatenate([h[cool], longer & ~_PLACE])
    start, end = c.slices(p0, p1 + n)
    order, new = equal_slices(c.b, start, end, h)
    p0, h, start, end = p0[order], h[order], start[order], end[order]
    head, doc = np.flatnonzero(new), c.doc(p0)
    to = bucket_of(h[head], buckets)
    ends, found = np.append(head[1:], new.size), []
    for key, s in split(to):
        own = slice(int(head[s.start]), int(ends[s.stop - 1]))
        at = head[s]
        found.append((key, chunk, dump(h[at], (end[at] - start[at]).astype(np.uint32), (ends[s] - at).astype(np.uint32), gather(c.b, start[at], end[at]), *short(c.who[doc[own]]), p0[own].astype(np.uint32), (p0[own] - c.first[doc[own]]).astype(np.uint32))))
    return rows(found)


@dataclass
class Found:
    """Contexts in a bucket. Group g has the text ``start[g]:end[g]`` and stands first at ``pos`` of document ``least``; ``family`` is its anchor."""

    b: Bytes
    start: np.ndarray
    end: np.ndarray
    family: np.ndarray
    least: np.ndarray
    pos: np.ndarray


def settled(key: int, table: pa.Table, settle: Callable) -> pa.Table:
    """``settle(found, group, doc, place)`` says for each occurrence what to answer: (occurrence, arrays)."""
    parts = [load(x.as_py()) for x in table.column("payload")]
    h, size, count, text, doc, place, pos = columns([(p[0], p[1], p[2], p[3], long(p[4], p[5]), p[6], p[7]) for p in parts])
    chunk = np.repeat(table.column("chunk").to_numpy(), [p[6].size for p in parts])
    end = np.cumsum(size, dtype=np.int64)
    start, b = end - size, Bytes(np.concatenate([text, np.zeros(32, np.uint8)]), np.zeros(1, np.int64))
    order, new = equal_slices(b, start, end, h)
    group = np.empty(h.size, np.int64)
    group[order] = np.cumsum(new) - 1
    rep = order[new]
    group = np.repeat(group, count)
    least, first = np.full(rep.size, LAST_ID), np.full(rep.size, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc)
    own = np.flatnonzero(doc == least[group])
    np.minimum.at(first, group[own], pos[own].astype(np.int64))
    found = Found(b, start[rep], end[rep], np.cumsum(runs(h[rep])) - 1 if rep.size else rep, least, first)
    own, arrays = settle(found, group, doc, pos)
    order = np.argsort(chunk[own], kind="stable")
    own, arrays = own[order], [x[order] for x in arrays]
    return rows([(key, c, dump(place[own[s]], *(x[s] for x in arrays))) for c, s in split(chunk[own])])


def mixed(found: Found) -> np.ndarray:
    """Groups whose anchor has other contexts, too."""
    return np.flatnonzero(np.bincount(found.family)[found.family] > 1) if found.family.size else found.family


def family_slices(found: Found, some: np.ndarray, size: np.ndarray, limit: int = 1 << 17) -> Iterator[np.ndarray]:
    """``some`` groups, cut between families into parts of about ``limit`` windows."""
    total, at = np.cumsum(size), 0
    heads = np.append(np.flatnonzero(runs(found.family[some])), some.size) if some.size else np.zeros(1, int)
    while at < some.size:
        done = total[at - 1] if at else 0
        to = heads[np.searchsorted(heads, np.searchsorted(total, done + limit), "right") - 1]
        to = int(to if to > at else heads[np.searchsorted(heads, at, "right")])
        yield some[at:to]
        at = to


def search(docs: DataFrame, words: bool, n: int, k: int, settle: Callable, build: Callable, schema: str, out_schema: pa.Schema, hot: int = HOT, segment: int = SEGMENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), as ``build(chunk, answers)`` makes it from what ``settle`` answers."""
    chunks, buckets = sizing(docs)
    packed, items = pack(docs, chunks, words), words_of_chunk if words else bytes_of

    def first(key, table):
        return ask(unpacked(table, items), n, k, buckets, key[0].as_py(), segment)

    def second(key, table):
        return answer(key[0].as_py(), table, hot)

    def third(key, table, replies):
        return detail(unpacked(table, items), replies, n, k, buckets, key[0].as_py(), segment) if replies.num_rows else _SCHEMA.empty_table()

    def fourth(key, table):
        return settled(key[0].as_py(), table, settle)

    def last(key, table, replies):
        if not table.num_rows:
            return out_schema.empty_table()
        return build(unpacked(table, items), [load(x.as_py()) for x in replies.column("payload")])

    anchors = packed.groupBy("chunk").applyInArrow(first, _ROW).groupBy("key").applyInArrow(second, _ROW)
    found = packed.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(third, _ROW).groupBy("key").applyInArrow(fourth, _ROW)
    return packed.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(last, schema)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of equal doc that overlap or touch, as one: doc, start, end in order."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not doc.size:
        return doc, start, end
    # Items are numbered through the chunk, so the largest end so far never reaches into the next text.
    reach = np.maximum.accumulate(end)
    new = np.ones(doc.size, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    head = np.flatnonzero(new)
    return doc[head], start[head], reach[np.append(head[1:], doc.size) - 1]


def outside(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the items outside disjoint ranges."""
    step = np.zeros(size + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    return np.cumsum(step[:-1], dtype=np.int8) == 0


# -- windows that are their own anchors --------------------------------------


def whole_windows(docs: DataFrame, n: int, build: Callable, schema: str, out_schema: pa.Schema) -> DataFrame:
    """Windows of ``n`` lines, sent as two independent hashes; ``build(chunk, h, starts, marks)`` makes the rows."""
    chunks, buckets = sizing(docs)
    packed = pack(docs, chunks, False)

    def windows(c: Chunk):
        """Every window's start, hash and number in order of the chunk's distinct hashes; those hashes, their least texts and buckets."""
        doc = np.repeat(np.arange(c.who.size), np.diff(c.first))
        p = np.flatnonzero(within(doc, n))
        h, h2 = (gram_hash(long_hash(c.b, c.start, c.end, seed=s), n)[p] if p.size else np.zeros(0, np.uint64) for s in (0, 1))
        order = np.lexsort((h2, h))
        new = runs(h[order], h2[order])
        head = np.flatnonzero(new)
        number = np.empty(p.size, np.int64)
        number[order] = np.cumsum(new) - 1
        return p, number, h[order[head]], h2[order[head]], doc[p[order[head]]], doc[p[order[np.append(head[1:], p.size) - 1]]] if p.size else head

    def ask(key, table):
        c = unpacked(table, lines_of)
        _, _, h, h2, low, high = windows(c)
        several = c.who[low] != c.who[high]
        return rows([(to, key[0].as_py(), dump(h[s], h2[s], *short(c.who[low[s]]), np.packbits(several[s]))) for to, s in split(bucket_of(h, buckets))])

    def answer(key, table):
        parts = [load(x.as_py()) for x in table.column("payload")]
        size = [p[0].size for p in parts]
        h, h2, doc, several = columns([(p[0], p[1], long(p[2], p[3]), np.unpackbits(p[4], count=p[0].size).astype(bool)) for p in parts])
        chunk, place = np.repeat(table.column("chunk").to_numpy(), size), np.concatenate([np.arange(x, dtype=np.uint32) for x in size])
        order = np.lexsort((doc, h2, h))
        head = np.flatnonzero(runs(h[order], h2[order]))
        least = np.empty(doc.size, np.int64)
        least[order] = np.repeat(doc[order[head]], np.diff(np.append(head, doc.size)))
        own = np.flatnonzero((least < doc) | several)
        own = own[np.lexsort((place[own], chunk[own]))]
        return rows([(key[0].as_py(), c, dump(place[own[s]], *short(least[own[s]]))) for c, s in split(chunk[own])])

    def final(key, table, replies):
        if not table.num_rows:
            return out_schema.empty_table()
        c = unpacked(table, lines_of)
        p, number, h, _, _, _ = windows(c)
        least, begin = np.full(h.size, LAST_ID, np.int64), {to: s.start for to, s in split(bucket_of(h, buckets))}
        for to, blob in zip(replies.column("key").to_pylist(), replies.column("payload")):
            place, base, gap = load(blob.as_py())
            least[begin[to] + place.astype(np.int64)] = long(base, gap)
        return build(c, number, p, least[number] < c.who[c.doc(p)])

    replies = packed.groupBy("chunk").applyInArrow(ask, _ROW).groupBy("key").applyInArrow(answer, _ROW)
    return packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(final, schema)


def id_column(who: np.ndarray) -> pa.Array:
    return pa.array(who, mask=who == LAST_ID)
