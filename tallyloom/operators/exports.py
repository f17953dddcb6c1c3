"""Exports of single builds: what each table hands on, and gates that a written table passes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.builds import Build, PlanError, fingerprint
from ..sources.domain import dense_sequence

#: Columns of the exported tables, in order; fixed by what readers of the exports expect.
COLUMNS = {
    "category": ("category", "build_id", "distinct_merchant_count", "txn_count", "total_amount", "max_txn_amount", "min_txn_amount", "avg_txn_amount"),
    "community": ("cid", "build_id", "entity_family", "member_count", "txn_count", "total_amount", "max_amount", "min_amount", "avg_amount"),
    "entity": ("re_id", "build_id", "member_count", "distinct_pii_count", "connected_card_count", "connected_merchant_count", "max_pair_score"),
    "pair": ("card", "merchant", "build_id", "home_distance_km"),
}
NEIGHBOUR = ("pagerank", "c_size", "txn_count")


def of_build(rows: DataFrame, table: str, build_id: str) -> DataFrame:
    """The columns of ``table`` for one build; a table without builds is taken to be that build's."""
    if "build_id" not in rows.columns:
        rows = rows.withColumn("build_id", F.lit(build_id))
    missing = [c for c in COLUMNS[table] if c not in rows.columns]
    if missing:
        raise PlanError(f"{table} lacks {missing}")
    return rows.where(F.col("build_id") == build_id).select(*COLUMNS[table])


def category_features(stats: DataFrame, build_id: str) -> DataFrame:
    return of_build(stats.withColumnRenamed("total_txn_amount", "total_amount"), "category", build_id)


def community_features(stats: DataFrame, build_id: str) -> DataFrame:
    return of_build(stats, "community", build_id)


def entity_features(stats: DataFrame, build_id: str) -> DataFrame:
    """Entities with members only."""
    return of_build(stats.where("member_count > 0"), "entity", build_id)


def pair_features(distances: DataFrame, build_id: str) -> DataFrame:
    return of_build(distances, "pair", build_id)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """One row: pairs exported, and those without a known distance (negative)."""
    return pairs.agg(F.count(F.lit(1)).alias("rows_returned"), F.count_if(F.col("home_distance_km") < 0).alias("pairs_missing_geography"))


def embedding_features(vectors: DataFrame, near: DataFrame, build_id: str) -> DataFrame:
    """(v, build_id, fastrp, nbr_*): each vertex's embedding, and mean and max over its neighbours of ``NEIGHBOUR``.

    ``near`` is (v, degree, sum_*, top_*) of the neighbours. Vertices without one have nulls.
    """
    means = {c: (F.round(F.col(f"sum_{c}") / F.col("degree"), 6).alias(f"nbr_{c}_mean"), F.round(f"top_{c}", 6).alias(f"nbr_{c}_max")) for c in NEIGHBOUR}
    near = near.select("v", *[x for c in NEIGHBOUR for x in means[c]])
    return vectors.select("v", F.lit(build_id).alias("build_id"), F.col("embedding").alias("fastrp")).join(near.hint("merge"), "v", "left")


def write_counted(rows: DataFrame, path: str, expected: int) -> DataFrame:
    """Rows written by range of event_seq; one row of counts, whose gate enforces that none is missing or cut off."""
    rows.repartitionByRange("event_seq").write.mode("overwrite").parquet(path)
    got = rows.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_written"), F.countDistinct("event_seq").alias("rows_distinct"))
    return got.select(F.lit(expected).cast("long").alias("rows_expected"), "rows_written", (F.lit(expected) - F.col("rows_written")).alias("truncated_MUST_BE_ZERO"), (F.col("rows_written") - F.col("rows_distinct")).alias("repeated_MUST_BE_ZERO"))


def write_graph(edges: DataFrame, path: str, build: Build, config: dict) -> bool:
    """Edges in a folder with a manifest that names the build, its cutoff and the settings; True if an equal export was there already."""
    spark, identity = edges.sparkSession, {"fingerprint": fingerprint(build, config), "cutoff": build.cutoff, "columns": edges.columns}
    if _manifest(spark, path) == identity:
        return True
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    # The manifest comes last: an export that was cut off has none, or one of another identity.
    spark.createDataFrame([(json.dumps(identity, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return False


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Hadoop's file systems know a finished write at ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0]) if _exists(spark, f"{path}/manifest") else None


def ensure_target_edges(edges: DataFrame, path: str) -> DataFrame:
    """Target edges written once: a table with as many rows is left as it is, another one is written anew and counted.

    Returns the table as read; raises PlanError if the count differs after the write.
    """
    spark, expected = edges.sparkSession, edges.count()
    if not (_exists(spark, path) and spark.read.parquet(path).count() == expected):
        edges.write.mode("overwrite").parquet(path)
        got = spark.read.parquet(path).count()
        if got != expected:
            raise PlanError(f"wrote {got} target edges of {expected}")
    return spark.read.parquet(path)


def reset_dry_run(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) that a reset would remove. Builds are immutable, so nothing is."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def timed_csr(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots, pointers) of edges (src, dst, time) sorted by src, then time (ties: dst).

    Slots are numbered 0.. over all sources without a global window; pointers give each source its
    half-open range of slots and its first and last time, so "edges before t" is a prefix.
    """
    slots = dense_sequence(edges.select("src", "time", "dst"), ["src", "time", "dst"], "slot").withColumn("slot", F.col("slot") - 1)
    pointers = slots.groupBy("src").agg(F.min("slot").alias("begin"), (F.max("slot") + 1).alias("end"), F.count(F.lit(1)).alias("edges"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    return slots, pointers


def check_csr(slots: DataFrame, pointers: DataFrame) -> DataFrame:
    """One row of gates: sources whose range is not theirs alone, and slots whose time is under the one before in their source."""
    ranges = pointers.agg(F.count_if(F.col("end") - F.col("begin") != F.col("edges")).alias("broken_ranges_MUST_BE_ZERO"), F.sum("edges").alias("edges"))
    before = slots.select((F.col("slot") + 1).alias("slot"), F.col("src").alias("__src"), F.col("time").alias("__time"))
    steps = slots.join(before, "slot").where("src = __src AND time < __time")
    return ranges.crossJoin(steps.agg(F.count(F.lit(1)).alias("time_goes_back_MUST_BE_ZERO")))
