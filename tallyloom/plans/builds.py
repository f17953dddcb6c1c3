"""Build plans: which cutoff serves which rows, and the gates every build has to pass."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Build:
    """A snapshot: everything before ``cutoff`` (exclusive), serving event_seq in [serves_from, serves_until)."""

    build_id: str
    cutoff: int
    serves_from: int
    serves_until: int
    split_id: int


@dataclass(frozen=True)
class Facts:
    """Per split and fold: first and last event_seq, rows, positives. ``splits`` and ``folds`` map a number to them."""

    splits: dict[int, tuple[int, int, int, int]]
    folds: dict[int, tuple[int, int, int, int]]


class PlanError(ValueError):
    pass


def build_facts(fact: DataFrame) -> DataFrame:
    """One row per split and per training fold: min, max, rows, positives; ``scope`` tells them apart."""
    row = [F.min("event_seq").alias("first_seq"), F.max("event_seq").alias("last_seq"), F.count(F.lit(1)).alias("n_rows"), F.sum("is_fraud").cast("long").alias("n_frauds")]
    splits = fact.groupBy(F.lit("split").alias("scope"), F.col("split_id").alias("number")).agg(*row)
    folds = fact.where("split_id = 0 AND causal_fold >= 0").groupBy(F.lit("fold").alias("scope"), F.col("causal_fold").alias("number")).agg(*row)
    return splits.unionByName(folds)


def collect_facts(facts: DataFrame) -> Facts:
    """The facts on the driver: a row per split and fold."""
    rows = facts.toLocalIterator()
    out: dict[str, dict] = {"split": {}, "fold": {}}
    for r in rows:
        out[r["scope"]][int(r["number"])] = (int(r["first_seq"]), int(r["last_seq"]), int(r["n_rows"]), int(r["n_frauds"]))
    return Facts(out["split"], out["fold"])


def equal_edges(first: int, last: int, folds: int) -> list[int]:
    """Edges of ``folds`` folds of equal rows over first..last; halves round to even."""
    rows = last - first + 1
    return [first + round(i * rows / folds) for i in range(folds + 1)]


def fold_edges(facts: Facts, folds: int, source: str = "auto") -> tuple[str, list[int]]:
    """Training fold edges: from the loader's causal_fold where it has that many folds, else of equal rows."""
    if source not in ("auto", "causal_fold", "event_seq"):
        raise PlanError(f"unknown fold source {source}")
    first, last, _, _ = facts.splits[0]
    has = len(facts.folds) > 1
    if source == "causal_fold" and not has:
        raise PlanError("causal_fold is asked for, but the table has no folds")
    if source == "event_seq" or not has:
        return "event_seq", equal_edges(first, last, folds)
    if len(facts.folds) != folds:
        raise PlanError(f"the table has {len(facts.folds)} folds, not {folds}")
    numbers = sorted(facts.folds)
    edges = [facts.folds[k][0] for k in numbers] + [last + 1]
    for k, nxt in zip(numbers, numbers[1:]):
        if facts.folds[nxt][0] <= facts.folds[k][0]:
            raise PlanError("folds do not follow each other")
        if facts.folds[k][1] + 1 != facts.folds[nxt][0]:
            raise PlanError("folds leave a gap or overlap")
    if edges[0] < first or facts.folds[numbers[-1]][1] > last:
        raise PlanError("folds reach outside the training split")
    if edges[0] != first or facts.folds[numbers[-1]][1] != last:
        raise PlanError("folds do not cover the training split")
    return "causal_fold", edges


def resolve_cutoff(spec: int | str, facts: Facts, folds: int = 5, source: str = "auto") -> int:
    """A cutoff: an event_seq, or val_boundary, test_boundary, end_of_data, fold:k."""
    if isinstance(spec, int):
        return spec
    if spec in ("val_boundary", "test_boundary"):
        return facts.splits[1 if spec == "val_boundary" else 2][0]
    if spec == "end_of_data":
        return max(x[1] for x in facts.splits.values()) + 1
    if spec.startswith("fold:"):
        return fold_edges(facts, folds, source)[1][int(spec[5:])]
    raise PlanError(f"unknown cutoff {spec}")


def plan_builds(facts: Facts, folds: int = 5, source: str = "auto") -> list[Build]:
    """Forward chaining: n folds make n - 1 windowed builds (the first fold only warms up), then val and test."""
    _, edges = fold_edges(facts, folds, source)
    builds = [Build(f"fold_{k}", edges[k], edges[k], edges[k + 1], 0) for k in range(1, folds)]
    for number, name in ((1, "val"), (2, "test")):
        first, last, _, _ = facts.splits[number]
        builds.append(Build(name, first, first, last + 1, number))
    check_plan(builds)
    return merge_equal(builds)


def check_plan(builds: list[Build]) -> None:
    """Every row is served by at most one build, and no build has seen the rows it serves."""
    for b in builds:
        if b.cutoff > b.serves_from:
            raise PlanError(f"{b.build_id} is fitted on rows it serves")
    order = sorted(builds, key=lambda b: b.serves_from)
    for a, b in zip(order, order[1:]):
        if a.serves_until > b.serves_from:
            raise PlanError(f"{a.build_id} and {b.build_id} serve the same rows")


def merge_equal(builds: list[Build]) -> list[Build]:
    """Builds with the same cutoff are computed once: later ones keep their window under the first's id."""
    first: dict[int, str] = {}
    return [Build(first.setdefault(b.cutoff, b.build_id), b.cutoff, b.serves_from, b.serves_until, b.split_id) for b in builds]


def builds_table(spark: SparkSession, builds: list[Build]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(b).values()) for b in builds], "build_id string, cutoff long, serves_from long, serves_until long, split_id int")


def fingerprint(build: Build, config: dict) -> str:
    """What a build's results depend on; equal fingerprints may share results."""
    return hashlib.sha256(json.dumps([asdict(build), config], sort_keys=True).encode()).hexdigest()


def route(fact: DataFrame, builds: list[Build]) -> DataFrame:
    """``fact`` with the build_id that serves each row (null: warm-up rows); a CASE ladder, no join."""
    out = F.lit(None).cast("string")
    for b in builds:
        out = F.when((F.col("split_id") == b.split_id) & (F.col("event_seq") >= b.serves_from) & (F.col("event_seq") < b.serves_until), b.build_id).otherwise(out)
    return fact.withColumn("build_id", out)


# -- gates ---------------------------------------------------------------------


class GateError(AssertionError):
    pass


def evaluate_gates(metrics: dict, expect: tuple[str, ...] = ()) -> list[str]:
    """Names say what must hold: ..._MUST_BE_ZERO, ..._MUST_BE_1, ..._MUST_EQUAL_x, ..._MUST_BE_BELOW_TOTAL, ..._MUST_HAVE_NO_KEY_1, ABORT_...

    Returns what fails. Expected names, and names a gate refers to, must be there: a missing one fails.
    """
    failed = [f"{name} is missing" for name in expect if name not in metrics]
    for name, value in metrics.items():
        if name.endswith("_MUST_BE_ZERO"):
            bad = value is None or value != 0
        elif name.endswith("_MUST_BE_1"):
            bad = value is None or value != 1
        elif name.endswith("_MUST_BE_BELOW_TOTAL"):
            bad = "total" not in metrics or value is None or not value < metrics["total"]
        elif name.endswith("_MUST_HAVE_NO_KEY_1"):
            bad = not isinstance(value, dict) or 1 in value or "1" in value
        elif "_MUST_EQUAL_" in name:
            other = name.split("_MUST_EQUAL_")[1]
            bad = other not in metrics or value is None or value != metrics[other]
        elif name.startswith("ABORT_"):
            bad = value is None or bool(value)
        else:
            continue
        if bad:
            failed.append(f"{name} = {value}")
    return failed


def enforce_gates(metrics: DataFrame | dict, expect: tuple[str, ...] = ()) -> None:
    """Raises unless every gate of a one-row metrics table holds."""
    values = metrics.first().asDict(recursive=True) if isinstance(metrics, DataFrame) else metrics
    if failed := evaluate_gates(values, expect):
        raise GateError("; ".join(failed))


def default_builds(fact: DataFrame, folds: int = 5) -> list[Build]:
    return plan_builds(collect_facts(build_facts(fact)), folds)
