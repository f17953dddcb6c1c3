"""Joins and running totals that hold up under hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups with more than 1 / HOT_SHARE of the rows (so fewer than HOT_SHARE groups) are looked up by broadcast.
HOT_SHARE = 1024


def look_up(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` inner-joined to one row per group, however large a group is.

    ``count`` is the group's number of rows. Groups with over 1 / HOT_SHARE of all rows are
    fewer than HOT_SHARE, so they fit a broadcast; the others are too small to unbalance a shuffle.
    """
    large = max(total // HOT_SHARE, 64)
    hot = groups.where(F.col(count) > large)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"))), key, "left")
    few = marked.where("__hot").drop("__hot").join(F.broadcast(hot), key)
    return few.unionByName(marked.where("__hot IS NULL").drop("__hot").join(groups.where(F.col(count) <= large), key))


def running_total(rows: DataFrame, key: str, order: list[str], values: dict[str, str], total: int, block: int = 256) -> DataFrame:
    """``rows`` with sums over the rows of the same key that come before; ``values`` maps new columns to the summed ones.

    Rows are dealt into blocks of about ``block`` rows of one key by a hash of ``order``, blocks into
    runs of ``block`` blocks. Windows go over the rows of a block, the blocks of a run and the
    runs of a key, so a key with all of ``total`` rows has total / block^2 rows in its last window. The
    order is that of the blocks' numbers, then ``order``.
    """
    blocks = max(1, -(-total // block))
    earlier = lambda by, within: Window.partitionBy(key, *within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda column, by, *within: F.coalesce(F.sum(column).over(earlier(by, within)), F.lit(0))
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(blocks)))
    sums = dealt.groupBy(key, "__block").agg(*[F.sum(v).alias(f"__{out}") for out, v in values.items()]).withColumn("__run", F.floor(F.col("__block") / block))
    runs = sums.groupBy(key, "__run").agg(*[F.sum(f"__{out}").alias(f"__all_{out}") for out in values])
    runs = runs.select(F.col(key).alias("__rk"), F.col("__run").alias("__rr"), *[before(f"__all_{out}", ["__run"]).alias(f"__all_{out}") for out in values])
    same_run = F.col(key).eqNullSafe(F.col("__rk")) & (F.col("__run") == F.col("__rr"))
    sums = sums.select(key, "__block", "__run", *[before(f"__{out}", ["__block"], "__run").alias(f"__{out}") for out in values]).join(runs, same_run)
    sums = sums.select(F.col(key).alias("__bk"), F.col("__block").alias("__bb"), *[(F.col(f"__{out}") + F.col(f"__all_{out}")).alias(f"__{out}") for out in values])
    inside = dealt.select("*", *[before(v, order, "__block").alias(f"__in_{out}") for out, v in values.items()])
    joined = inside.join(sums, F.col(key).eqNullSafe(F.col("__bk")) & (F.col("__block") == F.col("__bb")))
    return joined.select(*rows.columns, *[(F.col(f"__in_{out}") + F.col(f"__{out}")).alias(out) for out in values])
