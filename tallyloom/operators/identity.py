"""Entity resolution over shared personal data, as of an exclusive cutoff.

``pii`` is one table (party, rel, value, seq). Degrees used for blocking and for hub caps are
full degrees by default (``degree_scope="full"``), which lets later edges decide whether a
value is a hub; ``degree_scope="cutoff"`` counts what is known at the cutoff only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import known_before
from .components import components, meet

VALUE = ["rel", "value"]


def degrees(pii: DataFrame, cutoff: int) -> DataFrame:
    """Per (rel, value): full degree and degree at the cutoff."""
    return pii.groupBy(*VALUE).agg(F.count(F.lit(1)).alias("full_degree"), F.count_if(known_before("seq", cutoff)).alias("cutoff_degree"))


def measure_degrees(pii: DataFrame, cutoff: int, low: int = 100, high: int = 25000) -> DataFrame:
    """Per relation: values, values of degree one, largest degrees, pairs kept and dropped by the cap, disagreements of the two degrees about it."""
    d, pairs = degrees(pii, cutoff), F.col("full_degree") * (F.col("full_degree") - 1) / 2
    inside = lambda c: (F.col(c) > 1) & (F.col(c) < low)
    return d.groupBy("rel").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("full_degree") == 1).alias("degree_one"), F.max("full_degree").alias("max_full_degree"), F.max("cutoff_degree").alias("max_cutoff_degree"),
        F.sum(F.when(F.col("full_degree") < high, pairs).otherwise(0)).cast("long").alias("pairs_retained"), F.sum(F.when(F.col("full_degree") >= high, pairs).otherwise(0)).cast("long").alias("pairs_dropped"),
        F.count_if(inside("full_degree") != inside("cutoff_degree")).alias("disagreements"),
    )


def shared_pairs(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Unordered pairs a < b of parties on one value, formed inside each value's list: (rel, value, a, b) and both sides' ``extra``.

    Lists are as long as the degree cap of the caller allows.
    """
    lists = rows.groupBy(*VALUE).agg(F.array_sort(F.collect_list(F.struct("party", *extra))).alias("ps"))
    left = lists.select(*VALUE, "ps", F.posexplode("ps").alias("i", "x"))
    return left.select(*VALUE, "x", F.explode(F.slice("ps", F.col("i") + 2, F.size("ps"))).alias("y"))


def scoped(pii: DataFrame, cutoff: int, low: int, high: int, degree_scope: str) -> DataFrame:
    """PII edges known at the cutoff whose value is shared and no hub, with the degree that says so."""
    name = {"full": "full_degree", "cutoff": "cutoff_degree"}[degree_scope]
    d = degrees(pii, cutoff).select(*VALUE, F.col(name).alias("degree")).where((F.col("degree") > 1) & (F.col("degree") < high))
    return meet(pii.where(known_before("seq", cutoff)), d, VALUE)


def shared_values(pii: DataFrame, cutoff: int, weights: dict[str, float], low: int, high: int, degree_scope: str, stamps: bool) -> DataFrame:
    """(a, b, p) for each value below ``high`` that a pair shares, of pairs that share one below ``low``; with ``stamps`` also ``at``, the later of its two stamps.

    Blocking comes first: pairs are formed on selective values only. Values between the caps
    then count for these pairs through two joins, so no hub's list is ever paired.
    """
    known = scoped(pii, cutoff, low, high, degree_scope)
    points = F.lit(None).cast("double")
    for rel, w in weights.items():
        points = F.when(F.col("rel") == rel, F.lit(float(w))).otherwise(points)
    seq = ["seq"] * stamps
    later = lambda one, other: [F.greatest(one, other).alias("at")] * stamps
    small = shared_pairs(known.where(F.col("degree") < low), seq).select(*VALUE, F.col("x.party").alias("a"), F.col("y.party").alias("b"), *later("x.seq", "y.seq")).where("a < b")
    own = small.select("a", "b", points.alias("p"), *["at"] * stamps)
    large = known.where(F.col("degree") >= low).select("party", *VALUE, *seq)
    candidates = small.select("a", "b").distinct()
    left = meet(candidates, large.withColumnsRenamed({"party": "a", "seq": "sa"}), "a")
    more = meet(left, large.withColumnsRenamed({"party": "b", "seq": "sb"}), ["b", *VALUE]).select("a", "b", points.alias("p"), *later("sa", "sb"))
    return own.unionByName(more)


def match_parties(pii: DataFrame, cutoff: int, weights: dict[str, float], threshold: float = 1.0, low: int = 100, high: int = 25000, degree_scope: str = "full") -> DataFrame:
    """(a, b, score): pairs that share a value below ``low``, scored over all their shared values below ``high``.

    The score adds the relation's weight for each shared value; pairs over threshold - 1e-6 stay.
    """
    shared = shared_values(pii, cutoff, weights, low, high, degree_scope, False)
    return shared.groupBy("a", "b").agg(F.round(F.sum("p"), 6).alias("score")).where(F.col("score") > threshold - 1e-6)


def match_stamped(pii: DataFrame, cutoff: int, weights: dict[str, float], threshold: float = 1.0, low: int = 100, high: int = 25000) -> DataFrame:
    """The matches of ``match_parties`` by full degrees with the columns of ``stamp_provenance``: each shared value is met once, and both are sums over the same values."""
    shared = shared_values(pii, cutoff, weights, low, high, "full", True)
    found = shared.groupBy("a", "b").agg(F.round(F.sum("p"), 6).alias("score"), *provenance())
    return found.where(F.col("score") > threshold - 1e-6)


def score_histogram(matches: DataFrame) -> DataFrame:
    """Matches per tenth of the score."""
    return matches.groupBy(F.floor(F.round(F.col("score") * 10, 4)).cast("int").alias("tenth")).agg(F.count(F.lit(1)).alias("pairs"))


def provenance() -> list[Column]:
    """Of a match, from ``at`` of its shared values: when the last of them came, how long after the first, how many there are."""
    return [F.max("at").alias("resolved_at"), (F.max("at") - F.min("at")).alias("evidence_span"), F.count(F.lit(1)).alias("n_shared")]


def stamp_provenance(matches: DataFrame, pii: DataFrame, cutoff: int, high: int = 25000) -> DataFrame:
    """(a, b, score, resolved_at, evidence_span, n_shared): a value counts from the later of its two stamps; a match from its last value."""
    known = scoped(pii, cutoff, 0, high, "full").select("party", *VALUE, "seq")
    left = meet(matches, known.select(F.col("party").alias("a"), *VALUE, F.col("seq").alias("sa")), "a")
    both = meet(left, known.select(F.col("party").alias("b"), *VALUE, F.col("seq").alias("sb")), ["b", *VALUE]).withColumn("at", F.greatest("sa", "sb"))
    found = both.groupBy("a", "b").agg(*provenance())
    return meet(matches, found, ["a", "b"], "left")


def unify(parties: DataFrame, stamped: DataFrame, cutoff: int) -> DataFrame:
    """(party, re_id): components over matches resolved before the cutoff; a party without a match is its own entity."""
    roots = components(stamped.where(known_before("resolved_at", cutoff)).select("a", "b")).toDF("party", "root")
    return meet(parties.select("party").distinct(), roots, "party", "left").select("party", F.coalesce("root", "party").alias("re_id"))


def scoped_parties(pii: DataFrame, cutoff: int) -> DataFrame:
    """Parties first seen before the cutoff."""
    return pii.where("seq > 0").groupBy("party").agg(F.min("seq").alias("first_seen")).where(known_before("first_seen", cutoff)).select("party")


def assert_entities(entities: DataFrame, max_members: int = 50, max_fraction: float = 0.05) -> DataFrame:
    """One row of metrics: entities, parties, the largest, and ABORT flags when one grows implausibly."""
    sizes = entities.groupBy("re_id").agg(F.count(F.lit(1)).alias("n"))
    out = sizes.agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("parties"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))
    return out.select("*", (F.col("largest") > max_members).alias("ABORT_largest_entity"), (F.col("largest") / F.col("parties") > max_fraction).alias("ABORT_component_fraction"))


def worst_values(entities: DataFrame, pii: DataFrame, k: int = 20) -> DataFrame:
    """What holds the largest entity together: per relation its k values with most members (ties: smaller value)."""
    largest = entities.groupBy("re_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "re_id").limit(1)
    counts = meet(entities.join(F.broadcast(largest), "re_id"), pii, "party").groupBy(*VALUE).agg(F.countDistinct("party").alias("members"))
    w = Window.partitionBy("rel").orderBy(F.desc("members"), "value")
    return counts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def entity_stats(entities: DataFrame, pii: DataFrame, party_card: DataFrame, interactions: DataFrame, matches: DataFrame, cutoff: int) -> DataFrame:
    """Per entity: members, distinct PII values, connected cards and merchants, largest score among its own pairs."""
    members = entities.groupBy("re_id").agg(F.count(F.lit(1)).alias("member_count"))
    values = meet(entities, pii.where(known_before("seq", cutoff)), "party").groupBy("re_id").agg(F.countDistinct(*VALUE).alias("distinct_pii_count"))
    cards = meet(entities, party_card, "party").select("re_id", "card").distinct()
    n_cards = cards.groupBy("re_id").agg(F.count(F.lit(1)).alias("connected_card_count"))
    shops = meet(cards, interactions.select("card", "merchant").distinct(), "card").groupBy("re_id").agg(F.countDistinct("merchant").alias("connected_merchant_count"))
    ea, eb = entities.toDF("a", "ra"), entities.toDF("b", "rb")
    scores = meet(meet(matches, ea, "a"), eb, "b").where("ra = rb").groupBy(F.col("ra").alias("re_id")).agg(F.max("score").alias("max_pair_score"))
    out = members
    for part in (values, n_cards, shops, scores):
        out = meet(out, part, "re_id", "left")
    return out.fillna(0, ["distinct_pii_count", "connected_card_count", "connected_merchant_count"])


def stamp_keys(entities: DataFrame, owned: DataFrame, key: str, drop_conflicts: bool = False) -> DataFrame:
    """(key, re_id, conflict): the least entity of the owning parties; owners of different entities are a conflict."""
    out = meet(owned, entities, "party").groupBy(key).agg(F.min("re_id").alias("re_id"), (F.min("re_id") != F.max("re_id")).alias("conflict"))
    return out.withColumn("re_id", F.when(~F.col("conflict"), F.col("re_id"))) if drop_conflicts else out


def home_distance(interactions: DataFrame, party_card: DataFrame, homes: DataFrame, sites: DataFrame, cutoff: int) -> DataFrame:
    """(card, merchant, home_distance_km): haversine from the card's home to the merchant's site, -1 where either is unknown.

    Home: the latest geocoded tenure before the cutoff among the owning parties (ties: larger
    zip); tenures of unknown time count. Site: the geocoded location of the largest id, whatever its time.
    """
    from ..functions.scalars import haversine_km

    tenures = homes.where((F.col("seq") < cutoff) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).join(party_card, "party")
    home = tenures.groupBy("card").agg(F.max(F.struct("seq", "zip", "lat", "lon")).alias("h")).select("card", F.col("h.lat").alias("hlat"), F.col("h.lon").alias("hlon"))
    site = sites.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("merchant").agg(F.max(F.struct("location_id", "lat", "lon")).alias("s")).select("merchant", F.col("s.lat").alias("slat"), F.col("s.lon").alias("slon"))
    km = F.round(haversine_km(F.col("hlat"), F.col("hlon"), F.col("slat"), F.col("slon")), 6)
    return interactions.select("card", "merchant").join(home, "card", "left").join(site, "merchant", "left").select("card", "merchant", F.coalesce(km, F.lit(-1.0)).alias("home_distance_km"))
