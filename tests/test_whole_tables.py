"""Queries without SQL over tables with more rows than any fixed number in the code."""

import datetime

import pytest

from tallyloom import queries
from tallyloom.operators import graph, sampling

EARLY, LATE = set(range(60)), set(range(500, 520))
EARLY_SHOPS, LATE_SHOPS = set(range(10, 60)), set(range(5))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """6,400 events: 60 cards meet 50 merchants twice each, then 20 other cards meet 5 others four times each."""
    pairs = [(i % 60, 10 + i // 60 % 50) for i in range(6000)] + [(500 + i % 20, i // 20 % 5) for i in range(400)]
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=i), card, "view", 1.0, f'{{"k": {shop}}}') for i, (card, shop) in enumerate(pairs)]
    home = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{home}/events.parquet")
    return str(home)


def vertices(spark, folder, name):
    return {r["v"] for r in queries.QUERIES[name](spark, folder).select("v").collect()}


@pytest.mark.parametrize("name", ["ga3_wcc_card_hierarchical", "ga7_louvain_card", "ga8_kcore_card"])
def test_cards_of_all_events(spark, folder, name):
    assert vertices(spark, folder, name) == EARLY | LATE


@pytest.mark.parametrize("name", ["ga7_louvain_merchant", "ga8_kcore_merchant"])
def test_merchants_of_all_events(spark, folder, name):
    assert vertices(spark, folder, name) == EARLY_SHOPS | LATE_SHOPS


def test_bipartite_of_all_events(spark, folder):
    assert vertices(spark, folder, "ga6_louvain_bipartite") == EARLY | LATE | {graph.MERCHANT_BASE + m for m in EARLY_SHOPS | LATE_SHOPS}


def test_every_event_is_a_seed(spark, folder, monkeypatch):
    first = {}
    for r in queries.domain.events_fact(spark, folder).select("card", "event_seq").collect():
        first[r["card"]] = min(first.get(r["card"], r["event_seq"]), r["event_seq"])
    got = queries.QUERIES["n3_two_hop_sample"](spark, folder).where("hop = 1").select("seed_id").distinct().collect()
    assert {r["seed_id"] for r in got} == set(range(1, 6401)) - set(first.values())
    seeds, sample = [], sampling.sample_hops
    monkeypatch.setattr(sampling, "sample_hops", lambda s, *a: seeds.append(s.count()) or sample(s, *a))
    assert queries.QUERIES["n3_uniform_sample_leaks"](spark, folder).first()[0] == 0
    assert seeds == [6400]


def test_neighbours_before_against_brute_force(spark):
    edges = [(i % 3, i * 7 % 5, i // 4) for i in range(60)]
    seeds = [(s, s % 4, s) for s in range(20)]
    frames = spark.createDataFrame(seeds, "seed_id long, node long, time long"), spark.createDataFrame(edges, "src long, dst long, time long")
    past = {s: sorted(((t, d) for n, d, t in edges if n == node and t < time), reverse=True) for s, node, time in seeds}
    got = sampling.neighbours_before(*frames, 4).collect()
    assert sorted((r["seed_id"], r["nth"], r["edge_time"], r["dst"]) for r in got) == sorted((s, i, *e) for s, p in past.items() for i, e in enumerate(p[:4], 1))
    drawn = sampling.neighbours_before(*frames, 4, "uniform").collect()
    assert sorted((r["seed_id"], r["nth"]) for r in drawn) == sorted((s, i) for s, p in past.items() for i in range(1, min(4, len(p)) + 1))
    assert all((r["edge_time"], r["dst"]) in past[r["seed_id"]] for r in drawn)


def test_core_numbers_have_no_bound(spark, folder):
    got = dict(queries.QUERIES["ga8_kcore_card"](spark, folder).collect())
    assert got == {**dict.fromkeys(EARLY, 59), **dict.fromkeys(LATE, 19)}
    got = dict(queries.QUERIES["ga8_kcore_merchant"](spark, folder).collect())
    assert got == {**dict.fromkeys(EARLY_SHOPS, 49), **dict.fromkeys(LATE_SHOPS, 4)}


@pytest.mark.parametrize("name", ["ga6_louvain_bipartite", "ga7_louvain_card", "ga7_louvain_merchant"])
def test_louvain_has_its_default_rounds(spark, folder, monkeypatch, name):
    asked, louvain = [], graph.louvain
    monkeypatch.setattr(graph, "louvain", lambda edges, max_iteration=20, **k: asked.append(max_iteration) or louvain(edges, max_iteration, **k))
    assert queries.QUERIES[name](spark, folder).count() > 0
    assert asked == [20]


@pytest.mark.parametrize("name", ["bootstrap_interval", "paired_bootstrap"])
def test_bootstraps_have_their_default_rounds(monkeypatch, name):
    asked = []
    monkeypatch.setattr(queries, "scored", lambda spark, d: None)
    monkeypatch.setattr(queries.metrics, name, lambda *a, **k: asked.append(k))
    queries.QUERIES["m8_bootstrap_interval" if name == "bootstrap_interval" else "m9_paired_bootstrap"](None, "")
    assert asked == [{}]


def test_negatives_are_real_merchants(spark, folder, monkeypatch):
    drawn, draw = [], sampling.random_negatives
    monkeypatch.setattr(sampling, "random_negatives", lambda *a: drawn.append(draw(*a)) or drawn[-1])
    assert tuple(queries.QUERIES["n5_random_negatives_check"](spark, folder).first()) == (0, 0)
    assert {r["negative"] for r in drawn[0].select("negative").distinct().collect()} <= set(range(len(EARLY_SHOPS | LATE_SHOPS)))


def test_only_a_card_that_met_all_has_no_negative(spark):
    pairs = [(0, m) for m in range(200) if m != 77] + [(1, m) for m in range(200)] + [(2, 5)]
    positives = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "row long, card long, merchant long")
    got = [(r["card"], r["negative"]) for r in sampling.random_negatives(positives, 200).collect()]
    assert len(got) == len(pairs)
    assert {n for c, n in got if c == 0} == {77} and {n for c, n in got if c == 1} == {None}
    assert all(0 <= n < 200 and n != 5 for c, n in got if c == 2)
