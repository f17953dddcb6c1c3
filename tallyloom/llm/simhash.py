"""SimHash near-dedup through a segment-popcount embedding.

A fingerprint becomes a point: the popcounts of its 32 two-bit segments. Manhattan distance
between points is never above the Hamming distance between fingerprints, so fingerprints
within ``bits`` of each other lie within ``bits`` in the grid. The segments are cut into
``groups`` coordinate groups; if the distance is at most 4, all but four groups agree
exactly, so the pair meets in a grid cell made of ``groups - 4`` groups. Inside a cell, pairs
are ranged by total popcount (a Manhattan bound, too) and verified exactly on the fingerprints.
Cells give spanning links only, never all pairs; components then join the links.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, settle_table
from ._repeats import dump, id_column, load, split
from ._skew import look_up
from ._text import as_bytes, ids, text_pieces, within, words_of

SHINGLE = 4
BITS = 4
#: Coordinate groups by number of distinct fingerprints: more groups, more selective cells.
GROUPS = ((1 << 26, 6), (1 << 34, 8), (1 << 63, 10))
#: Members of a cell that one task compares; larger cells are compared in pairs of tiles.
TILE = 32768
_PAIRWISE = 256
_FIVES = np.uint64(0x5555555555555555)


# -- fingerprints ------------------------------------------------------------


def fingerprint(column: pa.Array, n: int = SHINGLE) -> np.ndarray:
    import xxhash

    b = as_bytes(column)
    upper = (b.buf >= 65) & (b.buf <= 90)
    b.buf[upper] += 32
    w = words_of(b)
    size = w.end - w.start
    to = np.cumsum(size + 1) - size - 1  # words joined by one space
    flat = np.full(int((size + 1).sum()), 32, np.uint8)
    flat[np.repeat(to - (np.cumsum(size) - size), size) + np.arange(size.sum())] = b.buf[np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    p = np.flatnonzero(within(w.doc, n))
    count = np.diff(w.first)
    few = np.flatnonzero((count > 0) & (count < n))
    own = np.concatenate([w.doc[p], few])
    start, end = np.concatenate([to[p], to[w.first[few]]]), np.concatenate([to[p + n - 1] + size[p + n - 1], to[w.first[few + 1] - 1] + size[w.first[few + 1] - 1]])
    order = np.argsort(own, kind="stable")
    own, raw, digest = own[order], flat.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[s:e], 42) for s, e in zip(start[order].tolist(), end[order].tolist())), np.uint64, own.size)
    out = np.zeros(b.n, np.uint64)
    if own.size:
        head = np.flatnonzero(np.diff(own, prepend=-1))
        votes = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), head, axis=0, dtype=np.int32)
        many = np.diff(np.append(head, own.size))
        out[own[head]] = np.packbits(2 * votes > many[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, n: int = SHINGLE, named: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; if ``named``, also h1 and h2, two hashes of the text."""
    names = ["h1", "h2"] if named else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch):
                fp = pa.array(fingerprint(piece.column("text"), n).view(np.int64))
                yield pa.record_batch([id_column(ids(piece.column("doc_id"))), fp, *[piece.column(h) for h in names]], names=["doc_id", "fp", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if named:
        rows = rows.select("*", *[h.alias(name) for h, name in zip(text_hashes(F.col("text")), names)])
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *names]))


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes under different seeds."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


# -- links -------------------------------------------------------------------


def embed(fp: np.ndarray) -> np.ndarray:
    """Popcounts of the 32 two-bit segments, packed in two bits each."""
    return fp - (fp >> np.uint64(1) & _FIVES)


def cell_masks(groups: int, bits: int = BITS) -> list[np.uint64]:
    """For each choice of groups that must agree, the mask of their segments."""
    part = [sum(3 << 2 * s for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    return [np.uint64(sum(part[g] for g in pick)) for pick in itertools.combinations(range(groups), groups - bits)]


def spanning(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Least label of each of ``size`` nodes under links x-y."""
    label = np.arange(size)
    while x.size:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def near(fp: np.ndarray, others: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(fp ^ others) <= bits


def link_cells(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a spanning set) among fingerprints of equal key; sorts by key and total popcount."""
    order = np.lexsort((np.bitwise_count(fp), key))
    key, fp = key[order], fp[order]
    cell = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if key.size else np.zeros(0, int)
    size = np.bincount(cell)[cell] if key.size else cell
    xs, ys, weight = [np.zeros(0, int)], [np.zeros(0, int)], np.bitwise_count(fp).astype(int)
    i, d = np.flatnonzero((size > 1) & (size <= _PAIRWISE)), 1
    while i.size:
        i = i[i + d < key.size]
        i = i[(key[i] == key[i + d]) & (weight[i + d] - weight[i] <= bits)]
        hit = i[near(fp[i], fp[i + d], bits)]
        xs.append(hit)
        ys.append(hit + d)
        d += 1
    label = spanning(np.concatenate(xs), np.concatenate(ys), key.size)
    for c in np.unique(cell[size > _PAIRWISE]):
        lo, hi = np.searchsorted(cell, [c, c + 1])
        label[lo:hi] = lo + dense(fp[lo:hi], weight[lo:hi], bits)
    own = np.flatnonzero(label != np.arange(key.size))
    return fp[own], fp[label[own]]


def dense(fp: np.ndarray, weight: np.ndarray, bits: int) -> np.ndarray:
    """Component labels among many fingerprints, ordered by popcount; row by row, without listing pairs."""
    label = np.arange(fp.size)
    to = np.searchsorted(weight, weight + bits, "right")
    for i in range(fp.size):
        got = label[i : to[i]][near(fp[i], fp[i : to[i]], bits)]
        low = got.min()
        if (other := got[got != low]).size:
            label[np.isin(label, np.unique(other))] = low
    return label


def across(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links between two tiles of one cell."""
    both = np.concatenate([left, right])
    order = np.argsort(np.bitwise_count(both), kind="stable")
    label = dense(both[order], np.bitwise_count(both[order]).astype(int), bits)
    own = np.flatnonzero(label != np.arange(both.size))
    return both[order][own], both[order][label[own]]


def links(prints: DataFrame, count: int, bits: int = BITS) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``bits`` of each other. ``prints`` has distinct ``fp``."""
    groups = next(g for most, g in GROUPS if count <= most)
    masks = cell_masks(groups, bits)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * parts, -(-count * len(masks) // (1 << 20)))
    pair = "a long, b long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)]).view(np.uint64)
        for at in range(0, fp.size, 1 << 18):
            own = fp[at : at + (1 << 18)]
            point = embed(own)
            key = np.concatenate([(point & m) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i) for i, m in enumerate(masks)])
            key = (key ^ key >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
            to = (key >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(to, kind="stable")
            key, to, all_ = key[order], to[order], np.tile(own, len(masks))[order]
            made = [(k, dump(key[s], all_[s])) for k, s in split(to)]
            yield pa.record_batch([pa.array([k for k, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], names=["bucket", "payload"])

    def gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = [load(x.as_py()) for x in table.column("payload")]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def made(a: np.ndarray, b: np.ndarray, tiles: list) -> pa.Table:
        x, y = pa.array(a.view(np.int64)), pa.array(b.view(np.int64))
        none = pa.nulls(len(tiles), pa.int64())
        return pa.table({
            "a": pa.concat_arrays([x, none]), "b": pa.concat_arrays([y, none]),
            "tile": pa.array([None] * len(x) + [t for t, _ in tiles], pa.int64()), "payload": pa.array([None] * len(x) + [p for _, p in tiles], pa.binary()),
        })

    def inside(table):
        key, fp = gather(table)
        kinds, at, size = np.unique(key, return_inverse=True, return_counts=True)
        large, tiles = size[at] > TILE, []
        for k in np.flatnonzero(size > TILE):
            own = np.sort(fp[at == k])
            cuts = np.array_split(own, -(-own.size // TILE))
            for i, j in itertools.combinations_with_replacement(range(len(cuts)), 2):
                tiles.append((int((kinds[k] + np.uint64(1000003 * i + j)).astype(np.int64)), dump(cuts[i], cuts[j] if i != j else cuts[i][:0])))
        return made(*link_cells(key[~large], fp[~large], bits), tiles)

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                a, b = across(*load(blob.as_py()), bits)
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    found = settle_table(prints.select("fp").mapInArrow(deal, "bucket long, payload binary").groupBy("bucket").applyInArrow(inside, f"{pair}, tile long, payload binary"))
    tiles = found.where("tile IS NOT NULL").repartition("tile").select("payload").mapInArrow(tiled, pair)
    return found.where("tile IS NULL").select("a", "b").unionByName(tiles)


def _grouped(docs: DataFrame, bits: int, n: int, named: bool = False) -> DataFrame:
    """One row per row of ``docs``: the columns of ``fingerprints``, component_id and root, the component's least fingerprint."""
    if bits != BITS:
        raise ValueError("the grid is laid out for 4 bits")
    rows = settle_table(fingerprints(docs, n, named))
    prints = settle_table(rows.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("size")))
    roots = settle_table(components(links(prints, prints.count(), bits)))
    own = settle_table(prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "doc", "size", F.coalesce("root", "fp").alias("root")))
    tops = own.groupBy("root").agg(F.min("doc").alias("component_id"))
    known = settle_table(own.join(settle_table(tops), "root").select("fp", "size", "component_id", "root"))
    return look_up(rows, known, "fp", "size", rows.count()).select(*rows.columns, "component_id", "root")


def near_groups(docs: DataFrame, bits: int = BITS, n: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id.

    component_id is the smallest doc_id reachable over links of at most ``bits`` differing
    bits, the row's own included (null if all are null). Texts are lower-cased (A-Z); a null or
    blank text has fingerprint zero and is linked like any other; fewer than ``n`` words
    make one shingle. Reads ``doc_id`` and ``text`` only.
    """
    return _grouped(docs, bits, n).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bits: int = BITS, n: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, all columns as they are.

    Rows without a doc_id stay only where their whole component has none, and then one of
    them. Rows that repeat their component's smallest doc_id stay, too. A row goes by its doc_id
    and two hashes of its text, so rows of other components that share its doc_id, or have none,
    are left, and fingerprints are computed once.
    """
    grouped = settle_table(_grouped(docs, bits, n, named=True))
    tag = f"_{uuid.uuid4().hex[:8]}"
    keys = {c: f"{c}{tag}" for c in ("h1", "h2")}
    gone = grouped.where("doc_id <> component_id").select(F.col("doc_id").alias(f"id{tag}"), *[F.col(c).alias(f"gone_{k}") for c, k in keys.items()]).distinct()
    # Of a component without any id, the text with the least hashes.
    nameless = grouped.where("component_id IS NULL").groupBy("root").agg(F.min(F.struct("h1", "h2")).alias("h"))
    nameless = nameless.select(*[F.col(f"h.{c}").alias(f"one_{k}") for c, k in keys.items()])
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(f"row{tag}"))
    row, doc = F.col(f"row{tag}"), F.col(f"row{tag}.doc_id").cast("long")
    whole = whole.select(row, *[h.alias(k) for h, k in zip(text_hashes(F.col(f"row{tag}.text").cast("string")), keys.values())])
    same = lambda kind: [F.col(k) == F.col(f"{kind}_{k}") for k in keys.values()]
    named = whole.where(doc.isNotNull()).join(gone, [doc == F.col(f"id{tag}"), *same("gone")], "left_anti")
    others = whole.where(doc.isNull()).join(nameless, same("one"), "left_semi")
    one = others.groupBy(*keys.values()).agg(F.first(row).alias(f"row{tag}"))
    return named.select(row).unionByName(one.select(row)).select(f"row{tag}.*")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
