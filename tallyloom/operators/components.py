"""Connected components by repeated contraction, and lineage cuts for iterative jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Once a contracted graph has no more edges than this, one task finishes it.
LAST_EDGES = 50_000


def shared_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; make one only where none is named and all work is on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tallyloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    shared_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def settle_table(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_state(df: DataFrame, *parts: str) -> DataFrame:
    """``df`` as a written table in the shared checkpoint folder, for state that is joined round after round.

    A checkpoint keeps the size estimate of its plan, and estimates of joins multiply: in a
    loop they soon have millions of digits. A written table has its true size. ``parts`` are
    columns whose values get folders of their own, without a shuffle. No file marks the end of the
    write: nothing looks for it, and on a local disk Hadoop starts two processes of the driver to make it.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "state")
    write = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    (write.partitionBy(*parts) if parts else write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def meet(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join by a shuffle. Guessed sizes do not see the rows that an explode or a list of pairs makes, and a table broadcast by such a guess is held by the driver."""
    return left.join(right.hint("merge"), on, how)


def _finish(batches):
    import numpy as np
    import pyarrow as pa

    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not pairs:
        return
    a, b = (np.concatenate(x) for x in zip(*pairs))
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    label = np.arange(node.size)
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    yield pa.record_batch([pa.array(node), pa.array(node[label])], names=["node", "root"])


def components(edges: DataFrame, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's least node.

    Each round every node joins its least neighbour, the trees so formed are flattened by
    pointer jumping, and edges between the same pair of trees merge into one; the number of
    nodes halves at least. Only key-value tables are shuffled, aggregated before the shuffle;
    joins stand directly on exchanges, so skewed partitions can be split. No table of nodes is
    broadcast: its compressed files are far smaller than the hash table the driver would hold.
    """
    live = settle_state(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    total = None
    while live.count() > last_edges:
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = settle_state(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        near = flatten(near)
        x, y = near.toDF("a", "ra"), near.toDF("b", "rb")
        merged = meet(meet(live, x, "a"), y, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        live = settle_state(merged.distinct())
        total = near if total is None else follow(total, near)
    last = live.coalesce(1).mapInArrow(_finish, "node long, root long")
    return last if total is None else follow(total, last)


def follow(first: DataFrame, then: DataFrame) -> DataFrame:
    """Roots of ``first`` replaced by their roots in ``then``."""
    then = then.toDF("root", "top")
    return settle_state(meet(first, then, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def flatten(near: DataFrame) -> DataFrame:
    """Point every node to the top of its tree; doubles the reach of each pointer per round."""
    while True:
        top = near.toDF("root", "top")
        jumped = settle_state(meet(near, top, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.coalesce(F.col("top") != F.col("root"), F.lit(False)).alias("moved")))
        near = jumped.select("node", "root")
        if not jumped.where("moved").limit(1).count():
            return near
