"""Exports, their gates over rows that break them, and settings."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import exports
from tallyloom.plans import config
from tallyloom.plans.builds import Build, PlanError


def test_only_the_build_and_its_columns(spark):
    rows = spark.createDataFrame([(1, 2, "a", 3.0, "x"), (1, 2, "b", 4.0, "y")], "card long, merchant long, build_id string, home_distance_km double, more string")
    got = exports.pair_features(rows, "b")
    assert got.columns == list(exports.COLUMNS["pair"]) and [tuple(r) for r in got.collect()] == [(1, 2, "b", 4.0)]
    with pytest.raises(PlanError):
        exports.pair_features(rows.drop("home_distance_km"), "b")


def test_counts_show_lost_and_repeated_rows(spark, tmp_path):
    rows = spark.range(1, 8).toDF("event_seq")
    assert tuple(exports.write_counted(rows, str(tmp_path / "a"), 7).first()) == (7, 7, 0, 0)
    assert tuple(exports.write_counted(rows.unionAll(rows.limit(1)), str(tmp_path / "b"), 9).first()) == (9, 8, 1, 1)


def test_graph_export_is_reused_only_for_its_build(spark, tmp_path):
    edges, path = spark.createDataFrame([(1, 2)], "src long, dst long"), str(tmp_path / "g")
    one, other = Build("b", 5, 5, 9, 0), Build("b", 6, 6, 9, 0)
    assert [exports.write_graph(edges, path, b, {"k": 1}) for b in (one, one, other, other)] == [False, True, False, True]
    assert not exports.write_graph(edges, path, other, {"k": 2})


def test_target_edges_are_written_when_the_count_differs(spark, tmp_path):
    path = str(tmp_path / "t")
    assert exports.ensure_target_edges(spark.range(5), path).count() == 5
    assert exports.ensure_target_edges(spark.range(100, 105), path).agg(F.max("id")).first()[0] == 4
    assert exports.ensure_target_edges(spark.range(6), path).count() == 6


def test_csr_gates_see_broken_rows(spark):
    edges = spark.createDataFrame([(2, 9, 5), (1, 8, 3), (1, 7, 3), (2, 9, 1)], "src long, dst long, time long")
    slots, pointers = exports.timed_csr(edges)
    assert [tuple(r) for r in slots.orderBy("slot").select("src", "time", "dst").collect()] == [(1, 3, 7), (1, 3, 8), (2, 1, 9), (2, 5, 9)]
    assert tuple(exports.check_csr(slots, pointers).first()) == (0, 4, 0)
    assert exports.check_csr(slots.withColumn("time", -F.col("time")), pointers).first()["time_goes_back_MUST_BE_ZERO"] == 1
    assert exports.check_csr(slots, pointers.withColumn("end", F.col("end") + 1)).first()["broken_ranges_MUST_BE_ZERO"] == 2


def test_settings(tmp_path):
    file = tmp_path / "s.toml"
    file.write_text('source = "a"\ntarget = "b"\nfolds = 3\narms = ["raw"]\n')
    assert config.load_settings(file) == config.Settings("a", "b", folds=3, arms=("raw",))
    for bad in ({}, {"source": "a", "target": 1}, {"source": "a", "target": "b", "more": 1}, {"source": "a", "target": "b", "folds": True}, {"source": "a", "target": "b", "train_share": 0.9, "validation_share": 0.2}, []):
        with pytest.raises(ValueError):
            config.checked(bad)
