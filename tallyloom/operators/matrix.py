"""The training matrix: contract columns, the star join, sinks with manifests, and feature selection."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.builds import Build, PlanError, fingerprint

#: Contract columns by table, without keys and build_id. Fixed values.
CONTRACT = {
    "card": ("pagerank", "c_size", "cc_degree", "louvain_size", "core_number", "distinct_merchant_count", "repeated_merchant_count", "txn_count", "total_txn_amount", "max_txn_amount", "min_txn_amount", "avg_txn_amount"),
    "merchant": ("pagerank", "c_size", "cc_degree", "louvain_size", "core_number", "distinct_card_count", "repeated_card_count", "txn_count", "total_txn_amount", "max_txn_amount", "min_txn_amount", "avg_txn_amount"),
    "category": ("distinct_merchant_count", "txn_count", "total_txn_amount", "max_txn_amount", "min_txn_amount", "avg_txn_amount"),
    "community": ("member_count", "txn_count", "total_amount", "max_amount", "min_amount", "avg_amount"),
    "entity": ("member_count", "distinct_pii_count", "connected_card_count", "connected_merchant_count", "max_pair_score"),
}
PREFIX = {"card": "card_", "merchant": "mer_", "category": "cat_", "card_community": "ccom_", "merchant_community": "mcom_", "card_entity": "cre_", "merchant_entity": "mre_"}
FACT = ("amount", "use_chip", "error", "is_online")
TEMPORAL = ("row_card_gap_seconds", "row_pair_gap_seconds", "row_card_txn_count_1h", "row_card_txn_count_24h", "row_card_amount_24h", "row_card_tenure_seconds", "row_card_gap_ratio", "row_amount_z", "row_pair_txn_count")
#: Never features: keys, routing, and the label.
FORBIDDEN = ("event_seq", "unix_time", "transaction_id", "card", "merchant", "build_id", "split_id", "causal_fold", "is_fraud", "c_id", "louvain_id", "re_id")
ARMS = {
    "raw": ("fact",), "raw_plus_aggregates": ("fact", "aggregate"), "raw_plus_graph": ("fact", "aggregate", "graph"), "raw_plus_temporal": ("fact", "aggregate", "graph", "temporal"),
    "raw_plus_embeddings": ("fact", "aggregate", "graph", "embedding"), "raw_plus_temporal_embeddings": ("fact", "aggregate", "graph", "temporal", "embedding"), "raw_plus_aggregates_embeddings": ("fact", "aggregate", "embedding"),
    "raw_plus_pair_scores": ("fact", "aggregate", "graph", "pair"), "raw_plus_temporal_pair_scores": ("fact", "aggregate", "graph", "temporal", "pair"),
}
AGGREGATES = ("txn_count", "total_txn_amount", "max_txn_amount", "min_txn_amount", "avg_txn_amount", "distinct_merchant_count", "max_amount_in_interval", "max_txn_count_in_interval")


def family(column: str) -> str:
    """The feature family of a matrix column."""
    if column in TEMPORAL:
        return "temporal"
    if column.startswith(("cemb_", "memb_")):
        return "embedding"
    if column.startswith("pair_"):
        return "pair"
    if column.startswith(("card_", "mer_")) and column.split("_", 1)[1] in AGGREGATES or column.startswith("cat_"):
        return "aggregate"
    if column.startswith(tuple(PREFIX.values())) or column == "home_distance_km":
        return "graph"
    return "fact" if column in FACT else "other"


def arm_columns(columns: Iterable[str], arm: str) -> list[str]:
    """The features of an arm; raises if a forbidden column would be among them."""
    chosen = [c for c in columns if family(c) in ARMS[arm]]
    if bad := [c for c in chosen if c in FORBIDDEN]:
        raise PlanError(f"forbidden features: {bad}")
    return chosen


def prefixed(dim: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return dim.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in dim.columns if c not in keys])


def star_join(routed: DataFrame, dims: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``routed`` (with build_id) left-joined to every dimension on its keys and build_id.

    ``dims`` maps a prefix to (dimension, keys). Rows never multiply: a dimension must be
    unique on (keys, build_id), which ``duplicate_keys`` checks. Joins are left to the optimizer,
    which broadcasts by size.
    """
    for prefix, (dim, keys) in dims.items():
        routed = routed.join(prefixed(dim, [*keys, "build_id"], prefix), [*keys, "build_id"], "left")
    return routed


def duplicate_keys(dim: DataFrame, keys: list[str]) -> DataFrame:
    return dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_keys_MUST_BE_ZERO"), F.count_if(F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()).alias("null_keys_MUST_BE_ZERO"))


def strays(routed: DataFrame, warm_up_until: int) -> DataFrame:
    """One row: rows no build serves, apart from the warm-up before the first window."""
    lost = F.col("build_id").isNull()
    return routed.agg(F.count(F.lit(1)).alias("total"), F.count_if(lost & (F.col("event_seq") < warm_up_until)).alias("warm_up_rows"), F.count_if(lost & (F.col("event_seq") >= warm_up_until)).alias("stray_rows_MUST_BE_ZERO"))


def droppable(train: DataFrame, columns: list[str]) -> list[str]:
    """Columns that are all null or constant in the training rows: one pass, one row to the driver."""
    stats = train.agg(*[x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    return [c for c in columns if stats[f"n_{c}"] == 0 or stats[f"lo_{c}"] == stats[f"hi_{c}"]]


def validate_matrix(rows: DataFrame, key: str, label: str, features: list[str]) -> DataFrame:
    """One row of gates: unique keys, binary labels, no infinite or absurd numbers."""
    wild = sum((F.coalesce(F.abs(F.col(c).cast("double")) > 1e30, F.lit(False)).cast("int") for c in features), F.lit(0))
    one = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(key).isNull()).alias("null_key_MUST_BE_ZERO"), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("bad_label_MUST_BE_ZERO"), F.coalesce(F.sum(wild), F.lit(0)).alias("wild_values_MUST_BE_ZERO"))
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_key_MUST_BE_ZERO"))
    return one.crossJoin(twice)


def narrow_floats(rows: DataFrame, keep: Iterable[str] = FORBIDDEN) -> DataFrame:
    """Features as 32-bit floats; keys, times and labels keep their types."""
    kept = set(keep)
    return rows.select(*[F.col(c).cast("float").alias(c) if t == "double" and c not in kept else F.col(c) for c, t in rows.dtypes])


# -- sinks and sources ---------------------------------------------------------


def write_partitioned(rows: DataFrame, path: str, by: str = "build_id") -> None:
    rows.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_fact(fact: DataFrame, path: str, expected: int) -> int:
    """The fact table in ranges of event_seq, reconciled by count after the write."""
    fact.repartitionByRange("event_seq").sortWithinPartitions("event_seq").write.mode("overwrite").parquet(path)
    got = fact.sparkSession.read.parquet(path).count()
    if got != expected:
        raise PlanError(f"wrote {got} rows of {expected}")
    return got


def fact_page(fact: DataFrame, first: int, until: int) -> DataFrame:
    """Rows of a half-open range of event_seq; the range reaches the parquet scan."""
    return fact.where((F.col("event_seq") >= first) & (F.col("event_seq") < until))


def write_dimension(dim: DataFrame, path: str, table: str, keys: list[str], build: Build, config: dict) -> dict:
    """One build's dimension and a JSON manifest with its fingerprint and columns, written through Spark."""
    missing = [c for c in CONTRACT.get(table, ()) if c not in dim.columns]
    if missing:
        raise PlanError(f"{table} lacks {missing}")
    gate = duplicate_keys(dim, keys).first()
    if gate[0] or gate[1]:
        raise PlanError(f"{table} has repeated or null keys")
    target = f"{path}/{table}/build_id={build.build_id}"
    dim.drop("build_id").write.mode("overwrite").parquet(target)
    manifest = {"table": table, "build_id": build.build_id, "cutoff": build.cutoff, "serves_from": build.serves_from, "serves_until": build.serves_until, "split_id": build.split_id, "columns": dim.columns, "rows": dim.sparkSession.read.parquet(target).count(), "fingerprint": fingerprint(build, config)}
    dim.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifests/{table}/{build.build_id}")
    return manifest


def discover(spark: SparkSession, path: str, table: str) -> list[dict]:
    """Manifests of a table's builds."""
    return [json.loads(r[0]) for r in spark.read.text(f"{path}/manifests/{table}/*").toLocalIterator()]


def stale(manifests: list[dict], builds: list[Build], config: dict) -> list[str]:
    """Builds on disk whose fingerprint the plan no longer has; callers move them aside."""
    wanted = {fingerprint(b, config) for b in builds}
    return sorted(m["build_id"] for m in manifests if m["fingerprint"] not in wanted)


def embedding_join(rows: DataFrame, embeddings: DataFrame, key: str, prefix: str, dim: int) -> DataFrame:
    """Vectors joined on (key, build_id), never on the key alone, spread over columns."""
    wide = embeddings.select(F.col("key").alias(key), "build_id", *[F.col("embedding")[i].alias(f"{prefix}{i}") for i in range(dim)])
    return rows.join(wide, [key, "build_id"], "left")


def preflight(tables: dict[str, DataFrame], wanted: dict[str, dict[str, str]]) -> list[str]:
    """What the tables lack of the columns and types wanted of them."""
    out = []
    for name, columns in wanted.items():
        if name not in tables:
            out.append(f"{name} is missing")
            continue
        have = dict(tables[name].dtypes)
        out += [f"{name}.{c} is {have.get(c, 'missing')}, not {t}" for c, t in columns.items() if have.get(c) != t]
    return out
