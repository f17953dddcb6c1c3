"""Rank metrics. Scores are first grouped: everything after works on one row per distinct score.

``scored`` has (y: 0/1, score: double). Running totals over distinct scores use range
partitions and their sums, so no window runs over all scores in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_groups(scored: DataFrame) -> DataFrame:
    """(score, pos, n): one row per distinct score."""
    return scored.groupBy("score").agg(F.sum("y").cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))


def cumulated(groups: DataFrame) -> DataFrame:
    """``groups`` with tp and fp: positives and negatives at or above the score."""
    from pyspark.sql import Window

    from ..operators.components import settle_table

    parts = settle_table(groups.repartitionByRange(F.desc("score")).sortWithinPartitions(F.desc("score")).withColumn("__p", F.spark_partition_id()))
    sums = sorted((r[0], r[1], r[2]) for r in parts.groupBy("__p").agg(F.sum("pos"), F.sum("n")).toLocalIterator())
    before, pairs = (0, 0), []
    for p, pos, n in sums:
        pairs += [F.lit(p), F.struct(F.lit(before[0]).cast("long").alias("pos"), F.lit(before[1]).cast("long").alias("n"))]
        before = (before[0] + pos, before[1] + n)
    if not pairs:
        return groups.select("*", F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    base = F.create_map(*pairs)[F.col("__p")]
    w = Window.partitionBy("__p").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    tp, all_ = base["pos"] + F.sum("pos").over(w), base["n"] + F.sum("n").over(w)
    return parts.select("score", "pos", "n", tp.alias("tp"), (all_ - tp).alias("fp"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: ap, with tied scores as one step."""
    total = scored.agg(F.sum("y").alias("total"))
    steps = cumulated(score_groups(scored)).agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("sum"))
    return steps.crossJoin(total).select(F.round(F.col("sum") / F.col("total"), 6).alias("average_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row: the chance that a positive outranks a negative, ties half."""
    steps = cumulated(score_groups(scored))
    neg = F.col("n") - F.col("pos")
    out = steps.agg(F.sum(neg * (F.col("tp") - F.col("pos")) + neg * F.col("pos") / 2).alias("wins"), F.sum("pos").alias("p"), F.sum(neg).alias("q"))
    return out.select(F.round(F.col("wins") / (F.col("p") * F.col("q")), 6).alias("roc_auc"))


def best_f1(scored: DataFrame) -> DataFrame:
    """One row: threshold, precision, recall, f1 of the best F1 (ties: the higher threshold)."""
    total = scored.agg(F.sum("y").alias("total"))
    rows = cumulated(score_groups(scored)).crossJoin(total)
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("total"))
    best = rows.select(F.max(F.struct(f1.alias("f1"), F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("total")).alias("recall"))).alias("b"))
    return best.select(F.round("b.threshold", 6).alias("threshold"), F.round("b.precision", 6).alias("precision"), F.round("b.recall", 6).alias("recall"), F.round("b.f1", 6).alias("f1"))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 at score >= threshold."""
    hit, pos = F.col("score") >= threshold, F.col("y") == 1
    c = scored.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


#: Rows whose weights are drawn at once: a few arrays of them fit a core's cache.
DRAW_ROWS = 16_384
#: Rows whose weights are summed by score before they leave a task.
SUM_ROWS = 400_000


def _mixed(h: np.ndarray, number: int) -> np.ndarray:
    """Spark's xxhash64 of an int, seeded by the hashes ``h`` of the columns before it."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = h + (p5 + np.uint64(4))
    h ^= np.uint64((number & 0xFFFFFFFF) * int(p1) & 0xFFFFFFFFFFFFFFFF)
    high = h >> np.uint64(41)
    h <<= np.uint64(23)
    h |= high
    h *= p2
    h += p3
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    h ^= h >> np.uint64(32)
    return h


def _poisson_steps() -> list[int]:
    """Cumulative probabilities of 0, 1, 2, ... under Poisson(1), times 2^31."""
    steps, p, total = [], float(np.exp(-1)), 0.0
    for i in range(1, 10):
        total += p
        steps.append(int(total * 2**31))
        p /= i
    return steps


def _weights(hashes: np.ndarray, number: int, seed: int) -> np.ndarray:
    """Poisson(1) weights of one bootstrap round from hashes of the rows' keys: reruns and both arms agree."""
    out = np.zeros(hashes.size, np.uint8)
    for at in range(0, hashes.size, DRAW_ROWS):
        u = (_mixed(_mixed(hashes[at : at + DRAW_ROWS], number), seed) & np.uint64(2**31 - 1)).astype(np.uint32)
        w = out[at : at + DRAW_ROWS]
        for step in _poisson_steps():
            w += u >= np.uint32(step)
    return out


def _sums(rounds: int, seed: int):
    import pyarrow as pa

    def of(columns):
        hashes, y = columns[0].to_numpy().view(np.uint64), columns[1].fill_null(0).to_numpy().astype(np.float64)
        groups = []
        for column in columns[2:]:
            codes = column.dictionary_encode(null_encoding="encode").combine_chunks()
            codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
            groups.append((codes.dictionary, codes.indices.to_numpy()))
        for number in range(rounds):
            w = _weights(hashes, number, seed).astype(np.float64)
            for arm, (values, at) in enumerate(groups):
                n, pos = (np.bincount(at, x, len(values)).astype(np.int64) for x in (w, w * y))
                kept = np.flatnonzero(n)
                yield pa.record_batch([pa.array(np.full(kept.size, arm, np.int32)), pa.array(np.full(kept.size, number, np.int32)), values.take(pa.array(kept)), pa.array(pos[kept]), pa.array(n[kept])], names=["arm", "round", "score", "pos", "n"])

    def sums(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= SUM_ROWS:
                yield from of(pa.Table.from_batches(held).combine_chunks().columns)
                held, size = [], 0
        if size:
            yield from of(pa.Table.from_batches(held).combine_chunks().columns)

    return sums


def bootstrap_groups(scored: DataFrame, key: str, scores: list[str], rounds: int, seed: int) -> DataFrame:
    """(arm, round, score, pos, n) under Poisson weights, arms by position in ``scores``; resampling never needs the rows in one place.

    A row's weights are drawn once for all arms, and summed by score inside the task before they are shuffled.
    """
    rows = scored.select(F.xxhash64(key).alias("h"), F.col("y").cast("int").alias("y"), *[F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(scores)])
    sums = rows.mapInArrow(_sums(rounds, seed), "arm int, round int, score double, pos long, n long")
    return sums.groupBy("arm", "round", "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def _ap(groups: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("arm", "round").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = groups.select("arm", "round", "pos", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("all"))
    return steps.groupBy("arm", "round").agg((F.sum(F.col("pos") * F.col("tp") / F.col("all")) / F.sum("pos")).alias("ap"))


def bootstrap_interval(scored: DataFrame, key: str, rounds: int = 100, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row: percentile interval of the average precision."""
    ap, a = _ap(bootstrap_groups(scored, key, ["score"], rounds, seed)), (1 - level) / 2
    return ap.agg(F.round(F.percentile("ap", F.lit(a)), 6).alias("low"), F.round(F.percentile("ap", F.lit(1 - a)), 6).alias("high"))


def paired_bootstrap(scored: DataFrame, key: str, left: str, right: str, rounds: int = 100, seed: int = 7) -> DataFrame:
    """One row: mean and interval of ap(right) - ap(left) under the same weights, and the share of rounds where right wins."""
    ap = _ap(bootstrap_groups(scored, key, [left, right], rounds, seed))
    of = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("ap")))
    d = ap.groupBy("round").agg((of(1) - of(0)).alias("d"))
    return d.agg(F.round(F.avg("d"), 6).alias("difference"), F.round(F.percentile("d", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("d", F.lit(0.975)), 6).alias("high"), F.round(F.avg((F.col("d") > 0).cast("int")), 6).alias("p_better"))


def compare_arms(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row about a one-to-one join of two prediction tables (key, y, score): what is missing on a side or has other labels."""
    l, r = left.select(key, F.col("y").alias("yl"), F.col("score").alias("sl")), right.select(key, F.col("y").alias("yr"), F.col("score").alias("sr"))
    j = l.join(r, key, "full")
    return j.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("yl").isNull()).alias("left_missing_MUST_BE_ZERO"), F.count_if(F.col("yr").isNull()).alias("right_missing_MUST_BE_ZERO"),
        F.count_if(F.col("yl") != F.col("yr")).alias("labels_differ_MUST_BE_ZERO"), F.round(F.avg(F.abs(F.col("sl") - F.col("sr"))), 6).alias("mean_abs_difference"),
    )
