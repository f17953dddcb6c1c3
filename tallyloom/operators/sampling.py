"""Point-in-time neighbour sampling and negative sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import settle_table

#: Relations of the sampled graph: source type, name, target type, most neighbours per hop.
RELATIONS = (("card", "card_merchant", "merchant", 10), ("merchant", "merchant_card", "card", 10), ("party", "party_device", "party", 5), ("party", "party_ip", "party", 5), ("card", "card_party", "party", 3), ("party", "party_card", "card", 3))


def dense_ids(keys: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """(key, out): contiguous ids from 0 in key order, numbered partition by partition."""
    from ..sources.domain import dense_sequence

    return dense_sequence(keys.select(key).distinct(), [key], out).withColumn(out, F.col(out) - 1)


def map_ids(rows: DataFrame, column: str, ids: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` with the dense id of ``column``; null where the map lacks the key (count them with ``unmapped``)."""
    return rows.join(ids.select(F.col(key).alias(column), F.col("idx").alias(out)), column, "left")


def unmapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_unmapped") for c in columns])


def neighbours_before(seeds: DataFrame, edges: DataFrame, cap: int, strategy: str = "recent", seed: int = 0) -> DataFrame:
    """For each seed (seed_id, node, time) up to ``cap`` edges (src, dst, time) of its node strictly earlier than its time.

    ``recent`` takes the last ones (ties: larger dst); ``uniform`` draws min(available, cap)
    with replacement from a hash of the draw. Returned edges point to the seed's node and carry
    ``seed_time``, the time found neighbours inherit. Edges are numbered per node by time; one sort
    of edges and seeds together counts the earlier ones, and neighbours are looked up by number, so
    no seed meets all edges of its node.
    """
    if strategy not in ("recent", "uniform"):
        raise ValueError(f"unknown strategy {strategy}")
    order = Window.partitionBy("node").orderBy("edge_time", "dst")
    numbered = settle_table(edges.where("src IS NOT NULL AND time IS NOT NULL").select(F.col("src").alias("node"), "dst", F.col("time").alias("edge_time")).withColumn("at", F.row_number().over(order).cast("long")))
    both = seeds.where("node IS NOT NULL AND time IS NOT NULL").select("node", "seed_id", F.col("time").alias("seed_time"), F.lit(0).alias("edge")).unionByName(
        numbered.select("node", F.col("edge_time").alias("seed_time"), F.lit(1).alias("edge")), allowMissingColumns=True
    )
    # At equal times seeds come first: an edge counts only for later seeds.
    before = Window.partitionBy("node").orderBy("seed_time", "edge").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = both.withColumn("n", F.sum("edge").over(before)).where("edge = 0 AND n > 0")
    asked = asked.select("seed_id", "node", "seed_time", "n", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(cap)).cast("int"))).alias("nth"))
    back = F.col("nth") if strategy == "recent" else F.pmod(F.xxhash64("seed_id", "node", "nth", F.lit(seed)), F.col("n")) + 1
    return asked.withColumn("at", F.col("n") - back + 1).join(numbered, ["node", "at"]).select("seed_id", "node", "seed_time", "dst", "edge_time", "nth")


def sample_hops(seeds: DataFrame, edges: DataFrame, caps: tuple[int, ...] = (10, 5), strategy: str = "recent", seed: int = 0) -> DataFrame:
    """Edges found over several hops: (hop, seed_id, node, seed_time, dst, edge_time, nth). Found nodes inherit the seed's time."""
    frontier, out = seeds.select("seed_id", "node", "time"), None
    for hop, cap in enumerate(caps, 1):
        got = settle_table(neighbours_before(frontier, edges, cap, strategy, seed + hop).withColumn("hop", F.lit(hop)))
        out = got if out is None else out.unionByName(got)
        frontier = got.select("seed_id", F.col("dst").alias("node"), F.col("seed_time").alias("time")).distinct()
    return out


def leaks(sampled: DataFrame) -> DataFrame:
    return sampled.agg(F.count_if(F.col("edge_time") >= F.col("seed_time")).alias("future_edges_MUST_BE_ZERO"))


def fanout_bound(caps: tuple[int, ...]) -> int:
    """Most nodes a seed can bring in."""
    total, layer = 1, 1
    for cap in caps:
        layer *= cap
        total += layer
    return total


def random_negatives(positives: DataFrame, merchants: int, rounds: int = 12, seed: int = 0) -> DataFrame:
    """For each positive (card, merchant: dense ids) its card with a merchant it never met: (row, card, merchant, negative).

    A hash of (row, round) draws; a row whose draw meets one of the card's merchants draws again.
    After ``rounds`` rounds the remaining rows draw from their cards' free merchants; only a card
    that met every merchant has no negative (null), which callers count.
    """
    pairs = positives.select("card", F.col("merchant").alias("negative")).distinct()
    left, out = positives.select("row", "card", "merchant"), None
    for i in range(rounds):
        drawn = left.withColumn("negative", F.pmod(F.xxhash64("row", F.lit(i), F.lit(seed)), F.lit(merchants)).cast("long"))
        good = settle_table(drawn.join(pairs, ["card", "negative"], "left_anti"))
        out = good if out is None else out.unionByName(good, allowMissingColumns=True)
        left = settle_table(left.join(good.select("row"), "row", "left_anti"))
        if not left.limit(1).count():
            break
    every = left.select("card").distinct().select("card", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(merchants - 1).cast("long"))).alias("negative"))
    free = every.join(pairs, ["card", "negative"], "left_anti").withColumn("at", F.row_number().over(Window.partitionBy("card").orderBy("negative")) - 1)
    free = settle_table(free.select("card", "negative", F.col("at").cast("long").alias("at")))
    asked = left.join(free.groupBy("card").agg(F.count(F.lit(1)).alias("n")), "card", "left").withColumn("at", F.pmod(F.xxhash64("row", F.lit(rounds), F.lit(seed)), F.col("n")))
    return out.unionByName(asked.join(free, ["card", "at"], "left").select("row", "card", "merchant", "negative")).select("row", "card", "merchant", "negative")


def historical_negatives(positives: DataFrame, pool: DataFrame, seed: int = 0) -> DataFrame:
    """For each positive a pair of the pool that is no current pair: (row, card, negative). Needs a pool; draws with replacement."""
    free = settle_table(dense_pairs(pool.join(positives.select("card", "merchant").distinct(), ["card", "merchant"], "left_anti")))
    n = free.count()
    if not n:
        raise ValueError("the pool holds no pair outside the current ones")
    at = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("long").alias("at")
    return positives.select("row", at).join(free, "at").select("row", "card", F.col("merchant").alias("negative"))


def dense_pairs(pairs: DataFrame) -> DataFrame:
    from ..sources.domain import dense_sequence

    return dense_sequence(pairs.select("card", "merchant").distinct(), ["card", "merchant"], "at").withColumn("at", F.col("at") - 1)


def collisions(negatives: DataFrame, positives: DataFrame) -> DataFrame:
    """One row: negatives that are pairs after all, and rows left without one."""
    bad = negatives.where("negative IS NOT NULL").join(positives.select("card", F.col("merchant").alias("negative")).distinct(), ["card", "negative"], "left_semi").agg(F.count(F.lit(1)).alias("collisions_MUST_BE_ZERO"))
    return bad.crossJoin(negatives.agg(F.count_if(F.col("negative").isNull()).alias("without_negative")))
