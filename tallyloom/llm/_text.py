"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on one Arrow string array at a time and returns flat numpy arrays
over the concatenated UTF-8 bytes, so the per-word cost is a handful of array passes
instead of Python objects. Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITESPACE = b" \t\n\x0b\x0c\r"
#: Texts are worked on in pieces of about this many bytes, which bounds a worker's arrays.
PIECE_BYTES = 1 << 19
#: Stands for a null doc_id where ids are compared: after every other document.
LAST_ID = np.int64(2**63 - 1)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITESPACE)] = True
_LANE_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S29 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(29)


def keep_heap(map_from: int = 8 << 20, trim_from: int = 32 << 20) -> None:
    """Let the C library reuse the memory of arrays under ``map_from`` bytes.

    By default every array of some hundred kilobytes is mapped and unmapped, and touching its
    fresh pages takes longer than the work on them. Up to ``trim_from`` freed bytes are kept.
    """
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-3, map_from)  # M_MMAP_THRESHOLD
        mallopt(-1, trim_from)  # M_TRIM_THRESHOLD


keep_heap()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (multiply and xor-shift rounds)."""
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


@dataclass
class Bytes:
    """Concatenated texts: ``buf`` has 32 zero bytes after the last text; text i is ``buf[off[i]:off[i+1]]``."""

    buf: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return self.off.size - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def lanes(self) -> np.ndarray:
        """The eight bytes from each position on, as little-endian integers."""
        return np.ndarray((self.buf.size - 7,), dtype="<u8", buffer=self.buf.data, strides=(1,))


@dataclass
class Words(Bytes):
    """Word i is ``buf[start[i]:end[i]]`` in text ``doc[i]``; text j has words ``first[j]:first[j+1]``."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array of texts, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def as_bytes(column: pa.Array) -> Bytes:
    column = texts(column)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return Bytes(np.zeros(32, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.zeros(off[-1] - off[0] + 32, np.uint8)
    if data is not None:
        buf[:-32] = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return Bytes(buf, off - off[0])


def as_words(column: pa.Array) -> Words:
    return words_of(as_bytes(column))


def words_of(b: Bytes) -> Words:
    solid = ~_IS_SPACE[b.buf[: b.off[-1]]]
    opens, closes = solid.copy(), np.empty(solid.size + 1, bool)
    cuts = b.off[(b.off > 0) & (b.off < solid.size)]
    opens[1:] &= ~solid[:-1]
    opens[cuts] = solid[cuts]
    closes[0] = False
    closes[1:] = solid
    closes[1:-1] &= ~solid[1:]
    closes[cuts] = solid[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    first = np.searchsorted(start, b.off)
    doc = np.repeat(np.arange(b.n), np.diff(first))
    return Words(b.buf, b.off, start, end, doc, first)


def slice_hash(b: Bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]``, eight bytes a round; only slices that are long enough take part in later rounds."""
    lanes, size = b.lanes(), end - start
    h = mix(size.astype(np.uint64) * _A + np.uint64(seed))
    left, at, live = size, start, None
    while True:
        lane = lanes[at] & _LANE_MASK[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ lane)
        else:
            h[live] = mix(h[live] ^ lane)
        more = left > 8
        if not more.any():
            return h
        live = np.flatnonzero(more) if live is None else live[more]
        left, at = left[more] - 8, at[more] + 8


def long_hash(b: Bytes, start: np.ndarray, end: np.ndarray, block: int = 256, seed: int = 0) -> np.ndarray:
    """As ``slice_hash`` for slices of any length: blocks are hashed side by side and summed under their number."""
    size = end - start
    count = np.maximum(1, -(-size // block))
    head = np.cumsum(count) - count
    nth = np.arange(count.sum()) - np.repeat(head, count)
    lo = np.repeat(start, count) + block * nth
    parts = mix(slice_hash(b, lo, np.minimum(lo + block, np.repeat(end, count)), seed) + nth.astype(np.uint64) * _A)
    return mix(np.add.reduceat(parts, head) ^ size.astype(np.uint64)) if size.size else parts


def word_hash(w: Words, seed: int = 0) -> np.ndarray:
    return slice_hash(w, w.start, w.end, seed)


def gram_hash(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Rolling hashes of n consecutive items; the first ``len(h) - n + 1`` positions."""
    if h.size < n:
        return np.zeros(0, np.uint64)
    m = h.size - n + 1
    by = np.uint64((seed * int(_C) + int(_A)) & (1 << 64) - 1 | 1)
    out = h[:m].copy()
    for j in range(1, n):
        out *= by
        out += h[j : j + m]
    return mix(out ^ (out >> _S29))


def within(doc: np.ndarray, n: int) -> np.ndarray:
    """Whether the n items from each position on belong to one text."""
    return doc[: doc.size - n + 1] == doc[n - 1 :] if doc.size >= n else np.zeros(0, bool)


def covered(marks: np.ndarray, n: int, size: int) -> np.ndarray:
    """Items covered by a marked window; ``marks`` are window starts."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, marks, 1) if marks.size < 64 else step.__iadd__(np.bincount(marks, minlength=size + 1).astype(np.int32))
    step -= np.bincount(np.minimum(marks + n, size), minlength=size + 1).astype(np.int32)
    return np.cumsum(step[:-1]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's items ``first[i]:first[i+1]``."""
    total = np.zeros(values.size + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of each w consecutive values by their upper 32 bits, leftmost of equals."""
    if h.size < w:
        return np.zeros(0, np.int64)
    low, span = np.uint64(0xFFFFFFFF), 1
    val = h & ~low | np.arange(h.size, dtype=np.uint64)
    while span * 2 <= w:
        val = np.minimum(val[span:], val[:-span])
        span *= 2
    if span < w:
        val = np.minimum(val[w - span :], val[: span - w])
    return (val & low).astype(np.int64)


def pieces(n: int, size_of: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts n rows into ranges of about ``limit`` bytes each, of one row at least."""
    total, at = np.concatenate([[0], np.cumsum(size_of)]), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def text_pieces(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of a batch or table with about ``limit`` bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    for at, to in pieces(batch.num_rows, size, limit):
        yield batch.slice(at, to - at)


def ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """doc_id as int64, null as LAST_ID."""
    out = pc.fill_null(column, int(LAST_ID))
    return (out.to_numpy() if isinstance(out, pa.ChunkedArray) else out.to_numpy(zero_copy_only=False)).astype(np.int64)
