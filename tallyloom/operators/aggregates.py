"""Point-in-time aggregates, for all builds in one pass.

Rows are first aggregated per key and *interval* between consecutive cutoffs (one shuffle of
the fact table, with partial aggregation); a build then merges the intervals before its
cutoff. The fact table is never multiplied by the number of builds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.builds import Build

MONEY = "decimal(18,2)"
WIDE = "decimal(38,2)"


def known_before(seq: str, cutoff: int | Column) -> Column:
    """The cutoff is exclusive, and 0 means that the time is unknown."""
    return (F.col(seq) > 0) & (F.col(seq) < cutoff)


def _interval(builds: list[Build]) -> Column:
    """The number of cutoffs at or before the row: builds past it see the row."""
    cutoffs = sorted({b.cutoff for b in builds})
    return sum((F.when(F.col("event_seq") >= c, 1).otherwise(0) for c in cutoffs), F.lit(0))


def _over_builds(partial: DataFrame, builds: list[Build]) -> DataFrame:
    """Each partial row for every build that sees its interval (partials are small: keys times builds)."""
    cutoffs = sorted({b.cutoff for b in builds})
    seen = F.array(*[F.struct(F.lit(b.build_id).alias("build_id"), F.lit(cutoffs.index(b.cutoff)).alias("rank")) for b in {b.build_id: b for b in builds}.values()])
    return partial.withColumn("__build", F.explode(F.filter(seen, lambda b: b["rank"] >= F.col("__interval")))).withColumn("build_id", F.col("__build.build_id")).drop("__build", "__interval")


def transaction_stats(fact: DataFrame, key: str, builds: list[Build]) -> DataFrame:
    """Per key and build: txn_count, total, max, min and avg amount of the rows before the cutoff."""
    money = F.col("amount").cast(MONEY)
    last = max(b.cutoff for b in builds)
    partial = fact.where(known_before("event_seq", last)).groupBy(key, _interval(builds).alias("__interval")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(money).alias("total"), F.max("amount").alias("hi"), F.min("amount").alias("lo")
    )
    merged = _over_builds(partial, builds).groupBy(key, "build_id").agg(F.sum("n").alias("txn_count"), F.sum(F.col("total").cast(WIDE)).cast("double").alias("total_txn_amount"), F.max("hi").alias("max_txn_amount"), F.min("lo").alias("min_txn_amount"))
    return merged.withColumn("avg_txn_amount", F.round(F.col("total_txn_amount") / F.col("txn_count"), 6))


def category_stats(merchant_stats: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per category and build, composed from merchant aggregates; ``assigned`` has (merchant, category).

    distinct_merchant_count counts every assigned merchant, those without history included.
    """
    total = assigned.groupBy("category").agg(F.countDistinct("merchant").alias("distinct_merchant_count"))
    per = merchant_stats.join(assigned, "merchant").groupBy("category", "build_id").agg(
        F.sum("txn_count").alias("txn_count"), F.sum(F.col("total_txn_amount").cast(WIDE)).cast("double").alias("total_txn_amount"), F.max("max_txn_amount").alias("max_txn_amount"), F.min("min_txn_amount").alias("min_txn_amount")
    )
    builds = merchant_stats.select("build_id").distinct()
    return total.crossJoin(F.broadcast(builds)).join(per, ["category", "build_id"], "left").withColumn("avg_txn_amount", F.round(F.col("total_txn_amount") / F.col("txn_count"), 6))


def interaction_edges(fact: DataFrame, builds: list[Build]) -> DataFrame:
    """Per (card, merchant) and build: txn_count, total_amount, first and last time and event_seq."""
    last = max(b.cutoff for b in builds)
    partial = fact.where(known_before("event_seq", last)).groupBy("card", "merchant", _interval(builds).alias("__interval")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast(MONEY)).alias("total"), F.min("unix_time").alias("t0"), F.max("unix_time").alias("t1"), F.min("event_seq").alias("s0"), F.max("event_seq").alias("s1")
    )
    return _over_builds(partial, builds).groupBy("card", "merchant", "build_id").agg(
        F.sum("n").alias("txn_count"), F.sum(F.col("total").cast(WIDE)).cast("double").alias("total_amount"), F.min("t0").alias("first_unix_time"), F.max("t1").alias("last_unix_time"), F.min("s0").alias("first_event_seq"), F.max("s1").alias("last_event_seq")
    )


def verify_interactions(edges: DataFrame, fact: DataFrame, builds: list[Build]) -> DataFrame:
    """Independent recount per build: transactions on edges against transactions under the cutoff, and all."""
    have = edges.groupBy("build_id").agg(F.sum("txn_count").alias("on_edges_MUST_EQUAL_under_cutoff"))
    counts = fact.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(known_before("event_seq", b.cutoff)).alias(b.build_id) for b in builds])
    ids = ", ".join(f"'{b.build_id}', `{b.build_id}`" for b in builds)
    return counts.selectExpr("total", f"stack({len(builds)}, {ids}) AS (build_id, under_cutoff)").join(have, "build_id", "left")


def degree_stats(edges: DataFrame, key: str) -> DataFrame:
    """Per key and build: distinct and repeated (two transactions or more) counterparts. A row means the key is seen."""
    other = "merchant" if key == "card" else "card"
    return edges.groupBy(key, "build_id").agg(F.count(F.lit(1)).alias(f"distinct_{other}_count"), F.count_if(F.col("txn_count") >= 2).alias(f"repeated_{other}_count"))


def band(weight: str) -> Column:
    """Bands 1 to 9 of a strength: 1, 2, 3, 4-5, 6-9, 10-19, 20-49, 50-99, 100 and more."""
    w = F.col(weight)
    ladder = F.lit(9)
    for number, top in reversed(list(enumerate((1, 2, 3, 5, 9, 19, 49, 99), 1))):
        ladder = F.when(w <= top, number).otherwise(ladder)
    return ladder


def strength_histogram(edges: DataFrame, weight: str) -> DataFrame:
    """Edges per band of ``weight``, with min, max and mean."""
    return edges.groupBy(band(weight).alias("band")).agg(F.count(F.lit(1)).alias("edges"), F.min(weight).alias("min_weight"), F.max(weight).alias("max_weight"), F.round(F.avg(weight), 6).alias("avg_weight"))


def surviving(edges: DataFrame, weight: str, probes: list[int], left: str, right: str) -> DataFrame:
    """For each distinct probe: edges with at least that weight, and the vertices they attach on either side.

    A vertex is attached at a probe if its heaviest edge is; so each side needs one row per vertex.
    """
    probe = sorted(set(probes))

    def at_least(df: DataFrame, what: str, name: str) -> DataFrame:
        one = df.agg(*[F.count_if(F.col(what) >= p).alias(f"p{p}") for p in probe])
        return one.selectExpr(f"stack({len(probe)}, {', '.join(f'{p}, p{p}' for p in probe)}) AS (probe, {name})")

    out = at_least(edges, weight, "surviving_edges")
    for side, name in ((left, "attached_left"), (right, "attached_right")):
        out = out.join(at_least(edges.groupBy(side).agg(F.max(weight).alias("__w")), "__w", name), "probe")
    return out


def density_check(edges: DataFrame, group: str, member: str, cap: int, pair_budget: int) -> DataFrame:
    """Cost of the co-occurrence projection over ``group``: one row of metrics.

    Candidate pairs sum d(d-1)/2 with and without the cap; hub concentration is the sum of
    squared degrees over the square of members; ABORT if the capped pairs exceed the budget.
    """
    d = edges.groupBy(group).agg(F.count(F.lit(1)).alias("d"))
    members = edges.agg(F.countDistinct(member).alias("members"))
    pairs = F.col("d") * (F.col("d") - 1) / 2
    out = d.agg(
        F.count(F.lit(1)).alias("groups"), F.max("d").alias("max_degree"), F.sum(pairs).cast("long").alias("candidate_pairs"), F.sum(F.when(F.col("d") <= cap, pairs).otherwise(0)).cast("long").alias("capped_pairs"),
        F.count_if(F.col("d") > cap).alias("groups_over_cap"), F.sum(F.col("d") * F.col("d")).alias("squares"),
    ).crossJoin(members)
    n = F.col("members")
    return out.select(
        "groups", "members", "max_degree", "candidate_pairs", "capped_pairs", "groups_over_cap", F.round(F.col("squares") / (n * n), 6).alias("hub_concentration"), F.round(F.col("max_degree") / n, 6).alias("max_reach_share"),
        F.round(F.col("candidate_pairs") / (n * (n - 1) / 2), 6).alias("saturation"), (F.col("capped_pairs") > pair_budget).alias("ABORT_pair_budget"),
    )


def top_degrees(edges: DataFrame, group: str, k: int) -> DataFrame:
    """The k keys of the largest degree (ties: smaller key first)."""
    return edges.groupBy(group).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), group).limit(k)


def community_stats(members: DataFrame, card_stats: DataFrame, merchant_stats: DataFrame) -> DataFrame:
    """Per community: family, members and transaction aggregates. ``members`` has (entity_type, key, cid).

    Aggregates come from the cards; from merchants only where a community has no card.
    """
    stats = ["txn_count", "total_txn_amount", "max_txn_amount", "min_txn_amount"]
    cards = members.where("entity_type = 'card'").join(card_stats.select(F.col("card").alias("key"), *stats), "key", "left")
    shops = members.where("entity_type = 'merchant'").join(merchant_stats.select(F.col("merchant").alias("key"), *stats), "key", "left")
    rows = cards.unionByName(shops)
    is_card = F.col("entity_type") == "card"
    has_card = F.max(is_card)

    def pick(f, col: str) -> Column:
        return F.when(has_card, f(F.when(is_card, F.col(col)))).otherwise(f(F.col(col)))

    money = lambda c: F.sum(c.cast(WIDE)).cast("double")
    out = rows.groupBy("cid").agg(
        F.when(F.min(is_card), "card").when(~has_card, "merchant").otherwise("bipartite").alias("entity_family"), F.count(F.lit(1)).alias("member_count"),
        pick(F.sum, "txn_count").alias("txn_count"), pick(money, "total_txn_amount").alias("total_amount"), pick(F.max, "max_txn_amount").alias("max_amount"), pick(F.min, "min_txn_amount").alias("min_amount"),
        F.count_if(is_card & (F.col("txn_count") > 0)).alias("distinct_active_cards"), F.count_if(~is_card & (F.col("txn_count") > 0)).alias("distinct_active_merchants"),
    )
    return out.withColumn("avg_amount", F.round(F.col("total_amount") / F.col("txn_count"), 6))


def neighborhood(edges: DataFrame, features: DataFrame, columns: list[str], min_weight: int = 0) -> DataFrame:
    """Per key a: unweighted mean and max of its neighbours' features; -1 counts as missing. ``edges`` is (a, b, weight) with a < b."""
    kept = edges.where(F.col("weight") >= min_weight)
    both = kept.select("a", "b").unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = features.select(F.col("key").alias("b"), *[F.when(F.col(c) != -1, F.col(c)).alias(c) for c in columns])
    return both.join(known, "b").groupBy(F.col("a").alias("key")).agg(*[x for c in columns for x in (F.round(F.avg(c), 6).alias(f"nbr_mean_{c}"), F.max(c).alias(f"nbr_max_{c}"))])


def inductive_reach(fact: DataFrame) -> DataFrame:
    """Per split: rows, and the shares of rows whose card, merchant or either was never seen in training."""
    def seen(key: str) -> DataFrame:
        return fact.where("split_id = 0").select(key).distinct().withColumn(f"{key}_seen", F.lit(1))

    rows = fact.where("split_id > 0").select("split_id", "card", "merchant").join(seen("card"), "card", "left").join(seen("merchant"), "merchant", "left")
    new_card, new_shop = F.col("card_seen").isNull(), F.col("merchant_seen").isNull()
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return rows.groupBy("split_id").agg(
        F.count(F.lit(1)).alias("n_rows"), share(new_card).alias("unseen_card"), share(new_shop).alias("unseen_merchant"), share(new_card | new_shop).alias("unseen_either"),
        F.countDistinct("card").alias("cards"), F.countDistinct(F.when(new_card, F.col("card"))).alias("cards_unseen"), F.countDistinct("merchant").alias("merchants"), F.countDistinct(F.when(new_shop, F.col("merchant"))).alias("merchants_unseen"),
    )


def column_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_fraction, distinct_up_to_two, constant): one pass over ``rows``."""
    parts = [x for c in columns for x in (F.avg(F.col(c).isNull().cast("int")).alias(f"n_{c}"), F.min(F.col(c).cast("double")).alias(f"lo_{c}"), F.max(F.col(c).cast("double")).alias(f"hi_{c}"))]
    lines = ", ".join(f"'{c}', n_{c}, coalesce(lo_{c} = hi_{c}, true)" for c in columns)
    return rows.agg(*parts).selectExpr(f"stack({len(columns)}, {lines}) AS (column, null_fraction, constant)").withColumn("null_fraction", F.round("null_fraction", 6))
