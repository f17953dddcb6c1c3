"""Results over projected graphs without their pairs, against the pairs."""

import datetime
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from tallyloom import queries
from tallyloom.operators import graph, projection
from tallyloom.operators.components import settle_table


def events(spark, home, pairs):
    start = datetime.datetime(2024, 1, 1)
    table = [(i, start + datetime.timedelta(seconds=i), card, "view", 1.0, f'{{"k": {shop}}}') for i, (card, shop) in enumerate(pairs)]
    spark.createDataFrame(table, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{home}/events.parquet")
    return str(home)


def against_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
    return len(got)


@pytest.fixture(scope="module")
def hub(spark, tmp_path_factory):
    """5,003 cards at one merchant, of which six come twice, and two other merchants of three cards."""
    pairs = [(card, 0) for card in range(5003)] + [(card, 0) for card in range(0, 5003, 1000)] + [(card, shop) for shop, cards in ((1, (0, 7, 8)), (2, (20, 21, 22))) for card in cards * 3]
    return events(spark, tmp_path_factory.mktemp("hub") / "x", pairs)


@pytest.mark.parametrize("name, count", [("s15_embedding_features", 11), ("ga10_card_card_weights", 21)])
def test_merchants_of_many_cards_are_not_left_out(spark, hub, name, count):
    assert against_sql(spark, hub, name) == count


def test_all_cards_of_a_large_merchant_are_neighbours(spark, tmp_path):
    folder = events(spark, tmp_path / "x", [(card, 0) for card in range(5003)] * 2)
    got = queries.QUERIES["s15_embedding_features"](spark, folder).drop("v")
    assert [tuple(r) for r in got.groupBy(*got.columns).count().collect()] == [("whole", 1.0, 1.0, 5003.0, 5003.0, 2.0, 2.0, 32, 5003)]


def test_cards_that_share_nothing(spark, tmp_path):
    folder = events(spark, tmp_path / "x", [(card, card % 3) for card in range(9)])
    assert against_sql(spark, folder, "s15_embedding_features") == 0


@pytest.fixture(scope="module")
def interactions(spark):
    """Groups of 2 to 30 members of 60, a lone pair, a group of one, weak links, and a null on either side."""
    r = random.Random(4)
    links = [(v, g, 2) for g in range(14) for v in r.sample(range(60), 2 if g % 3 else 2 + 2 * g)] + [(70, 90, 2), (71, 90, 3), (72, 91, 5), (73, 90, 1), (None, 0, 2), (0, None, 2), (1, None, 2)]
    return settle_table(spark.createDataFrame(links, "card long, merchant long, txn_count long"))


@pytest.fixture(scope="module")
def pairs(interactions):
    return settle_table(graph.project(interactions, "merchant", min_txn_count=2))


@pytest.fixture(scope="module")
def groups(interactions):
    return projection.shared_groups(interactions, "merchant", 2)


def close(got, want):
    got, want = dict(got.collect()), dict(want.collect())
    assert got.keys() == want.keys() and len(want) > 30
    for v in want:
        assert got[v] == pytest.approx(want[v], abs=2e-6)


def test_pagerank(groups, pairs):
    close(projection.pagerank(groups), graph.pagerank(pairs, max_change=0.0, max_iteration=5))


def test_component_sizes(groups, pairs):
    vertices = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    close(projection.component_sizes(groups), graph.wcc(vertices, pairs).select("v", "c_size"))


#: Squares alone, squares and pairs, pairs alone.
LEAST = [2, 8, None]


@pytest.fixture(params=LEAST)
def neighbours(request, monkeypatch, groups):
    monkeypatch.setattr(projection, "_large_from", lambda *_: request.param)
    monkeypatch.setattr(projection, "SIDE", 25)
    made = projection.Neighbours(groups)
    assert (made.members is None, made.pairs is None) == (request.param is None, request.param == 2)
    assert made.members is None or made.side > 1
    return made


def test_sums_and_tops_over_neighbours(neighbours, pairs):
    values = graph.both_ways(pairs).select("v").distinct().selectExpr("v", "cast(v * 37 % 101 AS double) AS x", "cast(-v AS double) AS y")
    near = graph.both_ways(pairs).select("v", "u").join(values.withColumnRenamed("v", "u"), "u").groupBy("v")
    want = near.agg(F.count(F.lit(1)).cast("double"), F.sum("x"), F.sum("y"), F.max("y"), F.max("x"))
    assert sorted(map(tuple, neighbours.gather(values, ["x", "y"], ["y", "x"]).collect())) == sorted(map(tuple, want.collect()))


def test_fastrp(neighbours, pairs):
    degree = graph.both_ways(pairs).groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("degree"))
    close(projection.fastrp(neighbours, degree, dim=8), graph.fastrp(pairs, degree.count(), dim=8))


def test_the_cheaper_way_is_chosen(spark):
    hub = spark.range(3000).selectExpr("0L AS g", "id AS v", "3000L AS n")
    lone = spark.range(20_000).selectExpr("id div 2 + 1 AS g", "id AS v", "2L AS n")
    assert projection._large_from(hub, 3000) == 2048
    assert projection._large_from(lone, 20_000) is None
    assert projection._large_from(hub.unionByName(lone), 20_000) == 2048


def test_squares_in_parts(monkeypatch):
    """Columns, rows, groups and links of a square in many parts."""
    for name, size in (("COLUMNS", 64), ("ROWS", 7), ("GROUPS", 3), ("LINKS", 5)):
        monkeypatch.setattr(projection, name, size)
    r = np.random.default_rng(1)
    row_v, col_v = r.permutation(300)[:40], r.permutation(300)[:150]
    lists = {int(v): r.permutation(30)[: r.integers(1, 4)].tolist() for v in range(300)}
    x = {int(v): float(r.integers(-9, 9)) for v in range(300)}
    sides = pa.table({"v": row_v, "gs": [lists[v] for v in row_v]}), pa.table({"u": col_v, "us": [lists[v] for v in col_v], "x": [x[v] for v in col_v]})
    want = {}
    for v in row_v:
        near = [x[u] for u in col_v if u != v and set(lists[u]) & set(lists[v])]
        if near:
            want[int(v)] = (len(near), sum(near), max(near))
    got = projection._compare(["x"], ["x"])(*sides).to_pydict()
    assert dict(zip(got["v"], zip(got["degree"], got["sum_x"], got["top_x"]))) == want
