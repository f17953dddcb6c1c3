"""Feature matrices and gradient-boosted trees with the engine's own ML library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scalars import time_parts


def check_splits(fact: DataFrame) -> DataFrame:
    """One row of gates: splits follow each other in time, all exist, each has positives and negatives."""
    per = fact.groupBy("split_id").agg(F.min("event_seq").alias("lo"), F.max("event_seq").alias("hi"), F.sum("is_fraud").alias("pos"), F.count(F.lit(1)).alias("n"))
    at = lambda c, k: F.max(F.when(F.col("split_id") == k, F.col(c)))
    return per.agg(
        (F.lit(3) - F.count_if(F.col("split_id").isin(0, 1, 2))).alias("missing_splits_MUST_BE_ZERO"), F.count_if((F.col("pos") == 0) | (F.col("pos") == F.col("n"))).alias("one_class_splits_MUST_BE_ZERO"),
        ((at("hi", 0) >= at("lo", 1)).cast("int") + (at("hi", 1) >= at("lo", 2)).cast("int")).alias("overlapping_splits_MUST_BE_ZERO"),
    )


def features(fact: DataFrame, chips: list[str]) -> DataFrame:
    """Amount, time parts and one-hot chip columns of every row."""
    parts = [c.cast("double").alias(name) for name, c in time_parts("unix_time").items()]
    hot = [(F.coalesce(F.col("use_chip"), F.lit("")) == chip).cast("double").alias(f"use_chip_{i}") for i, chip in enumerate(chips)]
    return fact.select("event_seq", "split_id", F.col("is_fraud").cast("double").alias("y"), F.coalesce("amount", F.lit(0.0)).alias("amount"), *parts, *hot)


def train_trees(rows: DataFrame, columns: list[str], max_iter: int = 20, depth: int = 5, seed: int = 42):
    """A boosted-tree model on split 0, positives weighted by the ratio of classes, stopped early on split 1."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = rows.where("split_id = 0").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).first()
    ratio = (counts["n"] - counts["p"]) / max(counts["p"], 1)
    ready = VectorAssembler(inputCols=columns, outputCol="x").transform(rows.where("split_id < 2")).select("x", "y", F.when(F.col("y") == 1, ratio).otherwise(1.0).alias("w"), (F.col("split_id") == 1).alias("validate"))
    return GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", validationIndicatorCol="validate", maxIter=max_iter, maxDepth=depth, seed=seed).fit(ready)


def score_trees(model, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(event_seq, y, score) of every row."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=columns, outputCol="x").transform(rows)
    return model.transform(ready).select("event_seq", F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("score"))


def round_trip(model, rows: DataFrame, columns: list[str], path: str, tolerance: float = 1e-12) -> DataFrame:
    """One row: rows scored, the largest difference between ``model`` and itself saved and loaded again, and how many differ by more than ``tolerance``."""
    from pyspark.ml.classification import GBTClassificationModel

    model.write().overwrite().save(path)
    again = score_trees(GBTClassificationModel.load(path), rows, columns).select("event_seq", F.col("score").alias("again"))
    gap = F.abs(F.col("score") - F.col("again"))
    return score_trees(model, rows, columns).join(again, "event_seq").agg(F.count(F.lit(1)).alias("rows"), F.max(gap).alias("max_difference"), F.count_if(gap > tolerance).alias("differing_MUST_BE_ZERO"))
