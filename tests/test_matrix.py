"""Selection, checks and models around the matrix."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tallyloom.functions import metrics, ml, scalars
from tallyloom.operators import aggregates, identity, matrix
from tallyloom.plans import builds
from tallyloom.sources import domain


def test_preflight(spark):
    tables = {"fact": spark.createDataFrame([(1, "a")], "event_seq long, card string")}
    assert matrix.preflight(tables, {"fact": {"event_seq": "bigint", "card": "string"}}) == []
    assert len(matrix.preflight(tables, {"fact": {"event_seq": "int", "x": "string"}, "gone": {}})) == 3


def test_fingerprint_follows_what_matters():
    b = builds.Build("b", 5, 5, 9, 0)
    assert builds.fingerprint(b, {"x": 1}) == builds.fingerprint(b, {"x": 1})
    assert builds.fingerprint(b, {"x": 1}) != builds.fingerprint(b, {"x": 2}) != builds.fingerprint(builds.Build("b", 6, 6, 9, 0), {"x": 2})


def test_one_hot_merges_names_and_ignores_unknown(spark):
    rows = spark.createDataFrame([("A b",), ("a-b",), ("new",), (None,)], "c string")
    got = scalars.one_hot(rows, "c", ["A b", "a-b"])
    assert got.columns == ["c", "c_a_b"] and [r["c_a_b"] for r in got.collect()] == [1, 1, 0, 0]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "x array<double>, y array<double>")
    got = rows.select(scalars.dot(F.col("x"), F.col("y")), scalars.cosine(F.col("x"), F.col("y")), scalars.euclidean(F.col("x"), F.col("y"))).collect()
    assert tuple(got[0]) == pytest.approx((11, 11 / (5**0.5 * 5), 8**0.5)) and got[1][1] is None and tuple(got[2]) == (None, None, None)


def test_pair_keys(spark):
    rows = spark.range(60).select((F.col("id") / 7).cast("long").alias("c"), (F.col("id") % 7).alias("m"))
    c, m = scalars.unpair(scalars.pair_key(F.col("c"), F.col("m"), 7), 7)
    assert rows.where((c != F.col("c")) | (m != F.col("m"))).count() == 0


def test_strays_and_routing(spark):
    fact = spark.createDataFrame([(i, 0 if i < 7 else 1) for i in range(1, 11)], "event_seq long, split_id int")
    routed = builds.route(fact, [builds.Build("a", 4, 4, 7, 0), builds.Build("v", 7, 7, 9, 1)])
    assert tuple(matrix.strays(routed, 4).first()) == (10, 3, 2)
    with pytest.raises(builds.GateError):
        builds.enforce_gates(matrix.strays(routed, 4))


def test_validator(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 2, float("inf")), (None, 1, None)], "k long, y int, x double")
    assert matrix.validate_matrix(rows, "k", "y", ["x"]).first().asDict() == {"total": 3, "null_key_MUST_BE_ZERO": 1, "bad_label_MUST_BE_ZERO": 1, "wild_values_MUST_BE_ZERO": 1, "repeated_key_MUST_BE_ZERO": 1}


def test_bootstrap_prefers_the_better_arm(spark):
    rows = spark.range(600).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 3).cast("double").alias("bad"), (-(F.col("id") % 3)).cast("double").alias("good"))
    r = metrics.paired_bootstrap(rows, "id", "bad", "good", 10).first()
    assert r["p_better"] == 1.0 and r["low"] > 0
    assert tuple(r) == tuple(metrics.paired_bootstrap(rows, "id", "bad", "good", 10).first())


def test_matching_blocks_first(spark):
    rows = [(1, "name", "n", 1), (2, "name", "n", 2), (1, "phone", "p", 1), (2, "phone", "p", 2), (3, "name", "n", 3), (4, "name", "n", 9), (4, "phone", "p", 9)]
    pii = spark.createDataFrame(rows, "party long, rel string, value string, seq long")
    weights = {"name": 0.5, "phone": 0.6}
    got = lambda **k: {tuple(r) for r in identity.match_parties(pii, 5, weights, **k).collect()}
    assert got(low=4) == {(1, 2, 1.1)}
    assert got(low=3) == set()
    assert got(low=3, degree_scope="cutoff") == {(1, 2, 1.1)}


def test_trees_survive_saving(spark, tmp_path):
    from pyspark.ml.classification import GBTClassificationModel

    rows = ml.features(domain.events_fact(spark, SMALL), ["view"])
    columns = ["amount", "hour"]
    model = ml.train_trees(rows, columns, 2, 2)
    model.save(str(tmp_path / "m"))
    a, b = (ml.score_trees(m, rows, columns).orderBy("event_seq").limit(50).collect() for m in (model, GBTClassificationModel.load(str(tmp_path / "m"))))
    assert all(abs(x["score"] - y["score"]) < 1e-12 for x, y in zip(a, b))


def test_hub_caps(spark):
    from tallyloom.operators import graph

    e = spark.createDataFrame([(c, m, 1) for c in range(4) for m in (0,)] + [(0, 1, 1), (1, 1, 1)], "card long, merchant long, txn_count long")
    assert {tuple(r) for r in graph.project(e, "merchant", max_degree=3).collect()} == {(0, 1, 1)}
    assert graph.project(e, "merchant").count() == 6
    assert aggregates.density_check(e, "merchant", "card", 3, 0).first()["ABORT_pair_budget"]
