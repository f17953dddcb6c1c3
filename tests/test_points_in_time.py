"""Nothing after a cutoff may change a feature; samplers, joins and the stream see the past only."""

import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tallyloom.functions import scalars
from tallyloom.operators import aggregates, matrix, sampling, windows
from tallyloom.plans import builds
from tallyloom.sources import domain
from tallyloom.streaming.velocity import _empty, step


def test_features_ignore_the_future(spark):
    fact = domain.events_fact(spark, SMALL)
    n = fact.count()
    build = [builds.Build("b", n // 2, n // 2, n, 0)]
    later = F.col("event_seq") >= n // 2
    changed = fact.withColumn("amount", F.when(later, F.col("amount") * 7 + 1).otherwise(F.col("amount"))).withColumn("merchant", F.when(later, F.col("merchant") + 1).otherwise(F.col("merchant")))
    for f in (lambda x: aggregates.transaction_stats(x, "card", build), lambda x: aggregates.interaction_edges(x, build), lambda x: windows.interval_max(x, build), lambda x: windows.last_neighbours(x, n // 2), lambda x: windows.velocity(x).where(F.col("event_seq") < n // 2)):
        a, b = f(fact), f(changed)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_unknown_times_are_never_seen(spark):
    rows = spark.createDataFrame([(0, 1), (1, 1), (5, 1), (9, 1)], "event_seq long, x long")
    assert [r[0] for r in rows.where(aggregates.known_before("event_seq", 9)).select("event_seq").collect()] == [1, 5]


def test_inductive_reach(spark):
    rows = [(0, "c0", "m0"), (0, "c1", "m0"), (1, "c0", "m0"), (2, "c0", "m1"), (2, "c2", "m0"), (2, "c2", "m0")]
    got = {r["split_id"]: r.asDict() for r in aggregates.inductive_reach(spark.createDataFrame(rows, "split_id int, card string, merchant string")).collect()}
    assert (got[1]["unseen_card"], got[1]["unseen_merchant"], got[1]["unseen_either"]) == (0, 0, 0)
    assert (got[2]["n_rows"], got[2]["cards"], got[2]["cards_unseen"], got[2]["merchants"], got[2]["merchants_unseen"], got[2]["unseen_either"]) == (3, 2, 1, 2, 1, 1.0)
    assert got[2]["unseen_card"] == pytest.approx(2 / 3, abs=1e-6) and got[2]["unseen_merchant"] == pytest.approx(1 / 3, abs=1e-6)


@pytest.mark.parametrize("time,found", [(5, {0}), (15, set())])
def test_sampler_looks_back_only(spark, time, found):
    edges = spark.createDataFrame([(0, 1, time)], "src long, dst long, time long")
    seeds = spark.createDataFrame([(7, 0, 10)], "seed_id long, node long, time long")
    got = sampling.sample_hops(seeds, edges, (3, 3)).collect()
    assert {r["node"] for r in got} == found


def test_uniform_sampling_repeats(spark):
    edges = spark.createDataFrame([(0, d, d) for d in range(1, 5)], "src long, dst long, time long")
    seeds = spark.createDataFrame([(s, 0, 100) for s in range(40)], "seed_id long, node long, time long")
    got = sampling.neighbours_before(seeds, edges, 3, "uniform").groupBy("seed_id").count().collect()
    assert {r["count"] for r in got} == {3}


def test_stream_step_agrees_with_windows(spark):
    rows = [(i, 1 + i % 2, i % 3, 1000 + 1800 * (i // 2), float(i)) for i in range(1, 60)]
    fact = spark.createDataFrame(rows, "event_seq long, card long, merchant long, unix_time long, amount double")
    want = {r["event_seq"]: r for r in windows.velocity(fact).collect()}
    frame = pd.DataFrame(rows, columns=["event_seq", "card", "merchant", "unix_time", "amount"])
    for card, own in frame.groupby("card"):
        state, cut = _empty(), len(own) // 2
        for _, seq, late, gap, pair, n1, n24, a24, tenure, pairs in step(card, own[:cut], state) + step(card, own[cut:], state):
            w = want[seq]
            assert not late and (gap, pair, n1, n24, a24, tenure, pairs) == (w["row_card_gap_seconds"], w["row_pair_gap_seconds"], w["row_card_txn_count_1h"], w["row_card_txn_count_24h"], w["row_card_amount_24h"], w["row_card_tenure_seconds"], w["row_pair_txn_count"])
        assert step(card, own[:1], state)[0][2]


def test_stream_runs(spark, tmp_path):
    from tallyloom.streaming.velocity import stream_velocity

    schema = "event_seq long, card long, merchant long, unix_time long, amount double"
    fact = spark.createDataFrame([(i, i % 3, i % 5, 1000 + 60 * i, 1.0) for i in range(1, 31)], schema)
    fact.write.parquet(str(tmp_path / "in"))
    q = stream_velocity(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = windows.velocity(fact)
    assert got.join(want, ["event_seq", "row_card_gap_seconds", "row_pair_gap_seconds", "row_card_txn_count_24h", "row_pair_txn_count"]).count() == 30


def test_sentinels(spark):
    rows = spark.createDataFrame([(1, -1, -1.0), (2, 3, -1.0)], "k long, n long, amount double")
    assert [tuple(r) for r in scalars.sentinel_to_null(rows, ["n"], {"n": ["amount"]}).collect()] == [(1, None, None), (2, 3, -1.0)]


def test_sinks(spark, tmp_path):
    fact = domain.events_fact(spark, SMALL)
    assert matrix.write_fact(fact, str(tmp_path / "fact"), fact.count()) == fact.count()
    with pytest.raises(builds.PlanError):
        matrix.write_fact(fact, str(tmp_path / "fact"), 3)
    b = builds.Build("b", 500, 500, 600, 0)
    dim = aggregates.category_stats(aggregates.transaction_stats(fact, "merchant", [b]), fact.select("merchant", "category").distinct())
    matrix.write_dimension(dim, str(tmp_path / "dims"), "category", ["category"], b, {"v": 1})
    found = matrix.discover(spark, str(tmp_path / "dims"), "category")
    assert [m["build_id"] for m in found] == ["b"] and matrix.stale(found, [b], {"v": 1}) == [] and matrix.stale(found, [b], {"v": 2}) == ["b"]


def test_arms_never_hold_keys():
    columns = ["amount", "card_txn_count", "card_pagerank", "row_amount_z", "cemb_0", "event_seq", "is_fraud", "cat_txn_count", "pair_dot"]
    assert matrix.arm_columns(columns, "raw") == ["amount"]
    assert matrix.arm_columns(columns, "raw_plus_temporal") == ["amount", "card_txn_count", "card_pagerank", "row_amount_z", "cat_txn_count"]
    for arm in matrix.ARMS:
        assert not set(matrix.arm_columns(columns, arm)) & set(matrix.FORBIDDEN)
