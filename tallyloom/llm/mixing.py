"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of about equal word counts along a hashed order of its documents,
and its blocks are put in a random order by another hash. A source's target becomes a quota of
blocks: whole passes over all its blocks, then the blocks that the rest of the target reaches
into; of the last one only the documents that fit. A binary tree over the output shards splits the
vector of quotas at every node by a multivariate-hypergeometric draw, so every shard gets an
exact random share of every source. Draw number j of a source, its place in pass and random order,
goes to the shard whose range holds j: shards hold disjoint draws. Rows are shuffled inside
the shard by a hash. All draws follow from ``seed`` and the documents: reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import settle_state, settle_table
from ._skew import running_total

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (3.0, 1.0, 2.0)
#: All targets together, and the most of one source, as shares of the sizes.
SHARE, MOST = 1.5, 2.0
#: Words of a block, unless a source has fewer than ``LEAST_BLOCKS`` blocks then.
BLOCK_WORDS = 1 << 16
LEAST_BLOCKS = 64
SHARD_WORDS = 1 << 22
#: Subtrees that the driver deals out; tasks split them further.
SUBTREES = 64


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets of sources in the order given: shares by weight, none above ``most`` times its size, the excess reshared."""
    want = share * sum(n for _, n in sizes)
    out, weight = [0.0] * len(sizes), [weights[i % len(weights)] for i in range(len(sizes))]
    free = set(range(len(sizes)))
    while free:
        unit = want / sum(weight[i] for i in free)
        over = {i for i in free if unit * weight[i] > most * sizes[i][1]}
        if not over:
            for i in free:
                out[i] = unit * weight[i]
            break
        for i in over:
            out[i] = most * sizes[i][1]
            want -= out[i]
        free -= over
    return out


def halves(have: np.ndarray, lo: int, hi: int, shards: int, total: int, seed: int) -> tuple[int, np.ndarray]:
    """The middle of shards lo..hi-1 and a random exact draw of what goes to its left; all shards have room for equal shares of ``total``."""
    mid = (lo + hi) // 2
    room = total * mid // shards - total * lo // shards
    return mid, np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, room, method="marginals")


def split_down(nodes: list[tuple[int, int, np.ndarray, np.ndarray]], until: int, shards: int, total: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Nodes (lo, hi, quotas, first draw of each source) split until they have ``until`` shards or fewer."""
    while nodes:
        lo, hi, have, first = nodes.pop()
        if hi - lo <= until:
            yield lo, hi, have, first
            continue
        mid, left = halves(have, lo, hi, shards, total, seed)
        nodes += [(mid, hi, have - left, first + left), (lo, mid, left, first)]


def tree(spark, quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(nth, shard, first, last): the draws of the nth source that a shard gets, where it gets any."""
    total = int(quotas.sum())
    schema = "nth long, shard long, first long, last long"
    if not total:
        return spark.createDataFrame([], schema)
    tops = split_down([(0, shards, quotas.astype(np.int64), np.zeros(quotas.size, np.int64))], -(-shards // SUBTREES), shards, total, seed)
    nodes = spark.createDataFrame([(lo, hi, have.tolist(), first.tolist()) for lo, hi, have, first in tops], "lo long, hi long, have array<long>, first array<long>")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for shard, _, have, first in split_down([(r["lo"], r["hi"], np.array(r["have"], np.int64), np.array(r["first"], np.int64))], 1, shards, total, seed):
                    nth = np.flatnonzero(have)
                    yield pa.record_batch([pa.array(nth), pa.array(np.full(nth.size, shard)), pa.array(first[nth]), pa.array((first + have)[nth] - 1)], names=["nth", "shard", "first", "last"])

    return nodes.repartition(min(SUBTREES, shards), "lo").mapInArrow(grow, schema)


def sized(rows: DataFrame) -> list[tuple[str | None, int]]:
    """Sources in code point order, null last, with their words. One row a source comes to the driver."""
    sizes = [(r[0], int(r[1])) for r in rows.groupBy("source").agg(F.sum("size")).collect()]
    return sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))


def draws(rows: DataFrame, seed: int, weights=WEIGHTS, share=SHARE, most=MOST, block_words=BLOCK_WORDS, shard_words=SHARD_WORDS) -> DataFrame:
    """``rows`` (n, source, size, k, twin) with source_size, target and ``shards``, the shard of each copy taken."""
    spark, sizes = rows.sparkSession, sized(rows)
    goal = targets(sizes, weights, share, most)
    block_words = max(block_words, sum(n for _, n in sizes) >> 28)
    table = spark.createDataFrame(
        [(i, s, n, want, int(want // n) if n else 0, want - want // n * n if n else 0.0, max(1, min(block_words, n // LEAST_BLOCKS))) for i, ((s, n), want) in enumerate(zip(sizes, goal))],
        "nth long, its string, source_size long, target double, passes long, rest double, block_words long",
    )
    # One row a source.
    known = rows.join(table, F.col("source").eqNullSafe(F.col("its"))).drop("its", "source")
    placed = running_total(known, "nth", ["k", "twin"], {"start": "size"}, rows.count())
    placed = settle_table(placed.withColumn("block", F.floor(F.col("start") / F.col("block_words"))))
    blocks = placed.groupBy("nth", "block").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max("passes").alias("passes"), F.lit(1).cast("long").alias("one"))
    blocks = settle_table(blocks.withColumn("draw", F.xxhash64("nth", "block", F.lit(seed))))
    # The random order of a source's blocks: their number and words before each.
    ordered = settle_table(running_total(blocks, "nth", ["draw", "block"], {"rank": "one", "before": "words"}, blocks.count()))
    counts = ordered.groupBy("nth").agg(F.count(F.lit(1)).alias("blocks"), F.sum((F.col("before") < F.col("rest")).cast("long")).alias("reached"), F.max("passes").alias("passes"))
    quota = np.zeros(len(sizes), np.int64)
    number = {}
    for r in counts.collect():
        quota[r["nth"]], number[r["nth"]] = r["passes"] * r["blocks"] + r["reached"], r["blocks"]
    shards = max(1, math.ceil(sum(goal) / shard_words))
    dealt = tree(spark, quota, shards, seed).select("nth", "shard", F.explode(F.sequence("first", "last")).alias("j"))
    per = spark.createDataFrame([(int(i), int(b), int(quota[i])) for i, b in number.items()], "nth long, blocks long, quota long")
    # Draws of a block: one in every pass, and one more if its place in the order is under the quota's rest.
    drawn = ordered.join(per, "nth").withColumn("copies", F.floor((F.col("quota") - F.col("rank") + F.col("blocks") - 1) / F.col("blocks")))
    drawn = drawn.where("copies > 0").select("nth", "block", "blocks", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("pass"))
    drawn = drawn.select("nth", "block", "pass", (F.col("pass") * F.col("blocks") + F.col("rank")).alias("j")).join(dealt, ["nth", "j"])
    shards_of = drawn.groupBy("nth", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"))
    plan = settle_table(ordered.select("nth", "block", "before").join(shards_of, ["nth", "block"], "left"))
    found = running_total_in_block(placed).join(plan, ["nth", "block"])
    # In the last pass a document is taken if the rest of the target reaches its middle.
    fits = F.col("before") + F.col("inside") + F.col("size") / 2 <= F.col("rest")
    copies = F.col("passes") + F.when(fits, 1).otherwise(0)
    return found.select("n", "size", "source_size", "target", F.slice(F.coalesce("shards", F.array().cast("array<long>")), F.lit(1), copies.cast("int")).alias("shards"), *[c for c in rows.columns if c not in ("n", "size", "source")])


def running_total_in_block(placed: DataFrame) -> DataFrame:
    """``placed`` with ``inside``, the words before a document in its block: blocks are cut from the running total ``start``."""
    first = placed.groupBy("nth", "block").agg(F.min("start").alias("opens"))
    return placed.join(first, ["nth", "block"]).withColumn("inside", F.col("start") - F.col("opens")).drop("opens", "start", "block_words")


def measured(whole: DataFrame) -> DataFrame:
    """n, doc_id, source, size (words; null text: 0), a hash k of the row and the row's number among its twins, from rows (row, n).

    k and twin put a source in an order that does not depend on how the table is cut into files.
    """
    size = F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = settle_table(whole.select("n", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), size.alias("size"), F.xxhash64("row.doc_id", "row.text", "row.source", F.lit(3)).alias("k"), F.lit(1).cast("long").alias("one")))
    return settle_table(running_total(rows, "k", ["n"], {"twin": "one"}, rows.count()).drop("one"))


def taken(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken and the shard of each copy.

    A row is taken at most ``most`` times, rounded up (2 by default). Repeated rows are taken one
    by one. A null source is a source of its own; documents without words take up no room and
    go with their block. Only doc_id, text and source are read; an empty table gives no rows.
    """
    rows = measured(docs.select(F.struct("doc_id", "text", "source").alias("row"), F.monotonically_increasing_id().alias("n")))
    return draws(rows, seed, **options).select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"), "shards")


def mix(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns as they are, as often as taken, partitioned by shard and shuffled inside it.

    Rows travel as one struct under a number of their own, so columns may have any names and rows may repeat.
    """
    whole = settle_state(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("n")))
    drawn = settle_table(draws(measured(whole), seed, **options).where(F.size("shards") > 0).select("n", "k", "twin", "shards"))
    rows = whole.join(drawn, "n").select("row", "k", "twin", F.posexplode("shards").alias("copy", "shard"))
    return rows.repartition("shard").sortWithinPartitions("shard", F.xxhash64("k", "twin", "copy", F.lit(seed))).select("row.*")


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
