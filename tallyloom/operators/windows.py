"""Backward-looking per-row features and other ordered operators, all as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.builds import Build
from .aggregates import MONEY, _interval, _over_builds, known_before

HOUR, DAY = 3600, 86400


def rounded(value: Column, places: int = 6) -> Column:
    """Halves up, by plain arithmetic, so that any engine with the same doubles agrees."""
    return F.floor(value * 10**places + 0.5) / float(10**places)


def velocity(fact: DataFrame, parity: bool = True) -> DataFrame:
    """Nine features per row from strictly earlier rows of its card, time ties in order of event_seq.

    Gaps, ratio and z are -1 where there is nothing to compare with; counts, amount and tenure
    are true zeros. ``parity`` keeps the published quirk of row_amount_z: n is the number of
    prior positive gaps plus one, and two such gaps are needed; without it, n is the number
    of prior rows (two needed) and the missing value is null.
    """
    order = Window.partitionBy("card").orderBy("unix_time", "event_seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pair = Window.partitionBy("card", "merchant").orderBy("unix_time", "event_seq")
    tie = Window.partitionBy("card", "unix_time").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, -1)
    by_time = Window.partitionBy("card").orderBy("unix_time")
    ut, money = F.col("unix_time"), F.col("amount").cast(MONEY)

    def prior(f, value: Column, seconds: int) -> Column:
        # Strictly earlier times within the range, plus earlier rows at the same time.
        none = F.lit(0).cast(MONEY) if f is F.sum else F.lit(0)
        return F.coalesce(f(value).over(by_time.rangeBetween(-seconds, -1)), none) + F.coalesce(f(value).over(tie), none)

    rows = fact.select(
        "event_seq", "card", "merchant", "unix_time", "amount",
        (ut - F.lag("unix_time").over(order)).alias("gap"), (ut - F.lag("unix_time").over(pair)).alias("pair_gap"),
        prior(F.count, F.lit(1), HOUR).alias("n1"), prior(F.count, F.lit(1), DAY).alias("n24"), prior(F.sum, money, DAY).cast("double").alias("a24"),
        (ut - F.first("unix_time").over(order)).alias("tenure"), (F.row_number().over(pair) - 1).alias("pairs"), (F.row_number().over(order) - 1).alias("priors"),
        F.sum(money).over(before).cast("double").alias("s"), F.sum(money * money).over(before).cast("double").alias("ss"),
    )
    positive = F.when(F.col("gap") > 0, F.col("gap"))
    rows = rows.withColumn("gaps", F.count(positive).over(before)).withColumn("gap_sum", F.sum(positive).over(before))
    n = (F.col("gaps") + 1 if parity else F.col("priors")).cast("double")
    var = F.col("ss") / n - (F.col("s") / n) * (F.col("s") / n)
    enough = (F.col("gaps") > 1 if parity else F.col("priors") > 1) & (var > 0)
    z = F.when(enough, rounded((F.col("amount") - F.col("s") / n) / F.sqrt(var)))
    ratio = F.when((F.col("gaps") > 0) & (F.col("gap") > 0), rounded(F.col("gap") / (F.col("gap_sum") / F.col("gaps")))).otherwise(-1.0)
    return rows.select(
        "event_seq", F.coalesce("gap", F.lit(-1)).cast("long").alias("row_card_gap_seconds"), F.coalesce("pair_gap", F.lit(-1)).cast("long").alias("row_pair_gap_seconds"), F.col("n1").cast("long").alias("row_card_txn_count_1h"), F.col("n24").cast("long").alias("row_card_txn_count_24h"),
        F.col("a24").alias("row_card_amount_24h"), F.col("tenure").cast("long").alias("row_card_tenure_seconds"), ratio.alias("row_card_gap_ratio"), (F.coalesce(z, F.lit(-1.0)) if parity else z).alias("row_amount_z"), F.col("pairs").cast("long").alias("row_pair_txn_count"),
    )


def interval_max(fact: DataFrame, builds: list[Build], minutes: int = 5) -> DataFrame:
    """Per card and build: the largest amount and count inside any trailing window at one merchant, the row included.

    A row's window holds strictly earlier times within range and earlier rows of its own
    second, so it does not depend on the build: windows are computed once.
    """
    keys = ["card", "merchant"]
    past = Window.partitionBy(*keys).orderBy("unix_time").rangeBetween(-60 * minutes, -1)
    tie = Window.partitionBy(*keys, "unix_time").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, 0)
    money = F.col("amount").cast(MONEY)
    total = F.coalesce(F.sum(money).over(past), F.lit(0).cast(MONEY)) + F.sum(money).over(tie)
    rows = fact.where(known_before("event_seq", max(b.cutoff for b in builds))).select("card", "event_seq", total.cast("double").alias("total"), (F.count(F.lit(1)).over(past) + F.count(F.lit(1)).over(tie)).alias("n"))
    partial = rows.groupBy("card", _interval(builds).alias("__interval")).agg(F.max("total").alias("total"), F.max("n").alias("n"))
    return _over_builds(partial, builds).groupBy("card", "build_id").agg(F.max("total").alias("max_amount_in_interval"), F.max("n").alias("max_txn_count_in_interval"))


def forward_target_encoding(fact: DataFrame, key: str, folds: int = 10, smoothing: float = 20.0, prior_rows: str = "split_id = 0") -> DataFrame:
    """Target encoding of training rows by forward chaining: fold k is encoded from folds before it; fold 0 is null.

    Folds are equal slices of event_seq (earlier slices take the remainder). Row numbers follow
    from event_seq, which is dense, so no global sort is needed.
    """
    train = fact.where(prior_rows)
    size = train.agg(F.count(F.lit(1)).alias("n"), F.min("event_seq").alias("lo"))
    at = F.col("event_seq") - F.col("lo")
    short, extra = F.floor(F.col("n") / folds), F.col("n") % folds
    fold = F.when(at < extra * (short + 1), F.floor(at / (short + 1))).otherwise(extra + F.floor((at - extra * (short + 1)) / F.greatest(short, F.lit(1))))
    rows = train.crossJoin(F.broadcast(size)).select("event_seq", key, "is_fraud", fold.cast("int").alias("fold"))
    per = rows.groupBy(key, "fold").agg(F.sum("is_fraud").alias("pos"), F.count(F.lit(1)).alias("cnt"))
    past = Window.partitionBy(key).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    known = per.select(key, "fold", F.coalesce(F.sum("pos").over(past), F.lit(0)).alias("pos"), F.coalesce(F.sum("cnt").over(past), F.lit(0)).alias("cnt"))
    total = rows.groupBy("fold").agg(F.sum("is_fraud").alias("p"), F.count(F.lit(1)).alias("c"))
    prior = total.alias("a").join(F.broadcast(total).alias("b"), F.col("b.fold") < F.col("a.fold")).groupBy(F.col("a.fold").alias("fold")).agg((F.sum("b.p") / F.sum("b.c")).alias("prior"))
    made = rows.join(known, [key, "fold"]).join(F.broadcast(prior), "fold", "left")
    return made.select("event_seq", "fold", F.round((F.col("pos") + smoothing * F.col("prior")) / (F.col("cnt") + smoothing), 6).alias("encoded"))


def target_encoding(fact: DataFrame, key: str, smoothing: float = 20.0) -> DataFrame:
    """Target encoding of later splits from all training rows; unseen keys get the prior."""
    train = fact.where("split_id = 0")
    prior = train.agg(F.avg("is_fraud").alias("prior"))
    known = train.groupBy(key).agg(F.sum("is_fraud").alias("pos"), F.count(F.lit(1)).alias("cnt"))
    rows = fact.where("split_id > 0").select("event_seq", key).join(known, key, "left").crossJoin(F.broadcast(prior))
    return rows.select("event_seq", F.round((F.coalesce("pos", F.lit(0)) + smoothing * F.col("prior")) / (F.coalesce("cnt", F.lit(0)) + smoothing), 6).alias("encoded"))


def rank_share(value: str, keys: list[str]) -> Column:
    """Average rank over the number of non-null values, as a share; null stays null.

    Meant for rows of entities (bounded per build); values tie on equality.
    """
    w, same = Window.partitionBy(*keys, F.col(value).isNull()), Window.partitionBy(*keys, value)
    return F.when(F.col(value).isNotNull(), (F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(same) - 1) / 2) / F.count(F.lit(1)).over(w))


def rank_bins(rows: DataFrame, columns: list[str], bins: int = 32, keys: tuple[str, ...] = ("build_id",)) -> DataFrame:
    """Each column replaced by floor(rank share * bins), the top share in the last bin; within build."""
    shares = rows.select("*", *[rank_share(c, list(keys)).alias(f"__{c}") for c in columns])
    return shares.select(*[c for c in rows.columns if c not in columns], *[F.least(F.floor(F.col(f"__{c}") * bins), F.lit(bins - 1)).cast("int").alias(c) for c in columns])


def rank_embedding(rows: DataFrame, vector: str = "embedding", keys: tuple[str, ...] = ("build_id",)) -> DataFrame:
    """(key, build_id, vector): every dimension replaced by its rank share within the build."""
    long = rows.select("key", *keys, F.posexplode(vector).alias("dim", "x"))
    ranked = long.select("key", *keys, "dim", F.round(rank_share("x", [*keys, "dim"]), 6).alias("x"))
    return ranked.groupBy("key", *keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias(vector))


def last_neighbours(fact: DataFrame, bound: int, n: int = 10) -> DataFrame:
    """The last n transactions before ``bound`` of every card and of every merchant: (side, seed, neighbour, event_seq, nth)."""
    past = fact.where(known_before("event_seq", bound))
    sides = past.select(F.explode(F.array(F.struct(F.lit("card").alias("side"), F.col("card").alias("seed"), F.col("merchant").alias("neighbour")), F.struct(F.lit("merchant").alias("side"), F.col("merchant").alias("seed"), F.col("card").alias("neighbour")))).alias("e"), "event_seq").select("e.*", "event_seq")
    w = Window.partitionBy("side", "seed").orderBy(F.desc("event_seq"))
    return sides.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def latest_before(seeds: DataFrame, states: DataFrame, key: str, seed_time: str, state_time: str, value: str) -> DataFrame:
    """As-of join: for each seed the value of its key's latest state strictly before it (null: none).

    Seeds and states are merged and sorted once per key; no pair is formed.
    """
    merged = seeds.select("*", F.lit(None).cast(dict(states.dtypes)[value]).alias("__v"), F.col(seed_time).alias("__t"), F.lit(0).alias("__kind")).unionByName(
        states.select(key, F.col(value).alias("__v"), F.col(state_time).alias("__t"), F.lit(1).alias("__kind")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__kind = 0").drop("__v", "__t", "__kind")


def assert_ordered(stream: DataFrame) -> DataFrame:
    """One row: how many rows have an event_seq not above their predecessor's in time order (per card)."""
    w = Window.partitionBy("card").orderBy("unix_time", "event_seq")
    return stream.select((F.lag("event_seq").over(w) >= F.col("event_seq")).alias("bad")).agg(F.count_if("bad").alias("out_of_order_MUST_BE_ZERO"))
