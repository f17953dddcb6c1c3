"""Joins whose sizes cannot be guessed before they run: none may broadcast a table that grows with the input."""

import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tallyloom import queries
from tallyloom.functions import metrics
from tallyloom.operators import components, graph, identity
from tallyloom.operators.components import settle_state, settle_table
from tallyloom.sources import domain

CUTOFF = queries.CLOCK_CUTOFF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pii(spark):
    return settle_table(domain.party_pii(spark, SMALL))


def test_match_parties_broadcasts_nothing(pii):
    assert "Broadcast" not in plan(identity.match_parties(pii, CUTOFF, domain.RELATIONS))


@pytest.fixture(scope="module")
def matches(pii):
    return settle_table(identity.match_parties(pii, CUTOFF, domain.RELATIONS))


def test_stamp_provenance_broadcasts_nothing(pii, matches):
    assert "Broadcast" not in plan(identity.stamp_provenance(matches, pii, CUTOFF))


def test_unify_broadcasts_nothing(pii, matches):
    stamped = identity.stamp_provenance(matches, pii, CUTOFF)
    assert "Broadcast" not in plan(identity.unify(identity.scoped_parties(pii, CUTOFF), stamped, CUTOFF))


@pytest.fixture(scope="module")
def entities(pii, matches):
    return settle_table(identity.unify(identity.scoped_parties(pii, CUTOFF), identity.stamp_provenance(matches, pii, CUTOFF), CUTOFF))


def test_stamp_keys_broadcasts_nothing(spark, entities):
    assert "Broadcast" not in plan(identity.stamp_keys(entities, domain.party_card(spark, SMALL), "card"))


def test_worst_values_broadcasts_the_largest_entity_only(pii, entities):
    assert plan(identity.worst_values(entities, pii)).count("BroadcastExchange") == 1


def test_entity_stats_broadcasts_nothing(spark, pii, matches, entities):
    stats = identity.entity_stats(entities, pii, domain.party_card(spark, SMALL), queries.interactions(spark, SMALL), matches, CUTOFF)
    assert "Broadcast" not in plan(stats)


def plans_of(spark, monkeypatch, name):
    """The plans of every table that a query settles, and of its result."""
    seen = []
    monkeypatch.setattr(queries, "settle_table", lambda df: seen.append(plan(df)) or settle_table(df))
    last = plan(queries.QUERIES[name](spark, SMALL))
    return [*seen, last]


@pytest.mark.parametrize("name", ["i6_assert_entities", "i1_reset_dry_run", "s8_entity_features"])
def test_queries_broadcast_nothing(spark, monkeypatch, name):
    assert not [p for p in plans_of(spark, monkeypatch, name) if "Broadcast" in p]


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    """Nodes of contracted graphs grow with the input, too; small tables never come to such a round by themselves."""
    seen = []
    monkeypatch.setattr(components, "settle_state", lambda df: seen.append(plan(df)) or settle_state(df))
    edges = spark.range(40).selectExpr("id AS a", "id + 1 AS b").where("a % 20 <> 19")
    roots = components.components(edges, 0)
    assert {r["root"] for r in roots.collect()} == {0, 20}
    assert sum("Join" in p for p in seen) > 2
    assert not [p for p in [*seen, plan(roots)] if "Broadcast" in p]


@pytest.mark.parametrize("name", ["i1_reset_dry_run", "i6_assert_entities", "s8_entity_features"])
def test_queries_broadcast_nothing_in_rounds_of_components(spark, monkeypatch, name):
    """Over sf0.01, the least tables in which parties match."""
    seen = []
    monkeypatch.setattr(components.components, "__defaults__", (0,))
    monkeypatch.setattr(components, "settle_state", lambda df: seen.append(plan(df)) or settle_state(df))
    queries.QUERIES[name](spark, SMALL.replace("sf0.001", "sf0.01"))
    assert sum("Join" in p for p in seen) > 2
    assert not [p for p in seen if "Broadcast" in p]


@pytest.mark.parametrize("name", ["i6_assert_entities", "s8_entity_features"])
def test_queries_meet_shared_values_once(spark, monkeypatch, name):
    """Matches are stamped as they are found; they once met all their values again, in plans as large as those that found them."""
    seen = []
    monkeypatch.setattr(components, "settle_state", lambda df: seen.append(plan(df)) or settle_state(df))
    queries.QUERIES[name](spark, SMALL)
    assert seen
    assert "Join" not in seen[0]


def test_entity_features_number_no_events(spark, monkeypatch):
    """The merchants of a card need no order; numbering stores all events and asks the driver for counts."""
    monkeypatch.setattr(domain, "dense_sequence", lambda *_: pytest.fail("numbered"))
    assert queries.QUERIES["s8_entity_features"](spark, SMALL).count()


def test_event_pairs_are_those_of_the_fact(spark):
    want = domain.events_fact(spark, SMALL).select("card", "merchant")
    got = domain.event_pairs(spark, SMALL)
    assert got.schema == want.schema
    assert sorted(got.collect()) == sorted(want.collect())


def test_matches_are_stamped_as_they_are_found(spark):
    pii = settle_table(domain.party_pii(spark, SMALL.replace("sf0.001", "sf0.01")))
    # Values that a party has twice, at two times, count twice.
    pii = settle_table(pii.unionByName(pii.where("party % 3 = 0").withColumn("seq", F.col("seq") + 5)))
    for low in (100, 12):
        matches = identity.match_parties(pii, CUTOFF, domain.RELATIONS, low=low)
        want = sorted(identity.stamp_provenance(matches, pii, CUTOFF).collect())
        assert len(want) > 20
        assert sorted(identity.match_stamped(pii, CUTOFF, domain.RELATIONS, low=low).collect()) == want


def test_rounds_of_components_write_few_tables(spark, monkeypatch):
    """Stars: the links, each node's least neighbour, one jump, no links left, the roots; nothing that marks the end of a write."""
    seen = []
    monkeypatch.setattr(components, "settle_state", lambda df: seen.append(settle_state(df)) or seen[-1])
    roots = components.components(spark.range(40).selectExpr("id % 8 AS a", "id + 8 AS b"), 0)
    assert {(r["node"], r["root"]) for r in roots.collect()} == {(i, i % 8) for i in range(48)}
    assert len(seen) == 5
    folders = {f.removeprefix("file://").rpartition("/")[0] for df in seen for f in df.inputFiles()}
    assert folders
    assert not [f for folder in folders for f in os.listdir(folder) if "_SUCCESS" in f]


def test_projected_links_are_not_broadcast(spark, monkeypatch):
    edges = settle_table(graph.project(queries.interactions(spark, SMALL), "merchant"))
    seen = []
    monkeypatch.setattr(graph, "settle_state", lambda df: seen.append(plan(df)) or settle_state(df))
    graph.pagerank(edges, max_iteration=1)
    assert "Broadcast" not in seen[0]


def test_pairs_are_formed_in_more_than_one_task(spark):
    assert "REPARTITION_BY_NUM" in plan(graph.project(queries.interactions(spark, SMALL), "merchant"))


def test_both_arms_share_one_draw(spark):
    rows = spark.range(50).selectExpr("id", "cast(id % 2 AS int) AS y", "cast(id AS double) AS good", "cast(-id AS double) AS bad")
    assert plan(metrics.paired_bootstrap(rows, "id", "bad", "good", 10)).count("Range (") == 1


def test_weights_are_those_of_spark_hashes(spark):
    """Sums by score, null scores and labels too, against hashes and thresholds computed row by row."""
    rows = spark.range(300).selectExpr("id", "IF(id % 7 = 0, NULL, cast(id % 2 AS int)) AS y", "IF(id % 5 = 0, NULL, cast(id % 11 AS double)) AS s")
    want = {}
    for r in rows.select("y", "s", *[F.xxhash64("id", F.lit(i), F.lit(7)).alias(f"h{i}") for i in range(4)]).collect():
        for i in range(4):
            w = sum(r[f"h{i}"] % 2**31 >= step for step in metrics._poisson_steps())
            if w:
                pos, n = want.get((i, r.s), (0, 0))
                want[i, r.s] = pos + w * (r.y or 0), n + w
    got = metrics.bootstrap_groups(rows, "id", ["s", "s"], 4, 7).collect()
    for arm in (0, 1):
        assert {(r["round"], r.score): (r.pos, r.n) for r in got if r.arm == arm} == want
