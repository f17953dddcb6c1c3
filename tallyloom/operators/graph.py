"""Graph operators over edge tables (a, b, weight), one row per undirected edge.

Vertices are longs; where two kinds of vertex meet, ``bipartite`` moves merchants out of the
cards' range. Iterations keep one settled table of vertex states; edges are doubled once.
Every state table is key-value, so a shuffle carries a few bytes a vertex or edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, meet, settle_state

#: Merchants' vertex ids start here.
MERCHANT_BASE = 1_000_000_000


def bipartite(interactions: DataFrame, min_txn_count: int = 1) -> DataFrame:
    """Card-merchant edges of at least that many transactions as (a, b, weight)."""
    return interactions.where(F.col("txn_count") >= min_txn_count).select(F.col("card").alias("a"), (F.col("merchant") + MERCHANT_BASE).alias("b"), F.col("txn_count").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(v, u, weight) for both directions of every edge."""
    return edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "weight").unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"), "weight"))


def project(interactions: DataFrame, over: str, min_edge_weight: int = 1, max_degree: int | None = None, min_txn_count: int = 1) -> DataFrame:
    """Co-occurrence: pairs a < b that share at least ``min_edge_weight`` of ``over`` (weight: how many).

    All pairs are formed unless ``max_degree`` is given: then hubs with a degree over it are left
    out. Pairs grow with the square of the degree; ``density_check`` gives the cost beforehand.
    The degree counts all interactions of the build, weak ones too.
    """
    one = "card" if over == "merchant" else "merchant"
    kept = interactions.where((F.col("txn_count") >= min_txn_count) & F.col(over).isNotNull())
    if max_degree is not None:
        degree = interactions.groupBy(over).agg(F.count(F.lit(1)).alias("__d"))
        kept = kept.join(degree.where(F.col("__d") <= max_degree), over)
    kept = kept.select(over, F.col(one).alias("v"))
    # Pairs are formed inside the sorted list of each group, so the group is shuffled once, not twice. The partitions
    # have a fixed number: joined by the few bytes they hold, one task would form all pairs.
    groups = kept.repartition(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), over).groupBy(over).agg(F.array_sort(F.collect_set("v")).alias("vs")).where(F.size("vs") > 1)
    left = groups.select("vs", F.posexplode("vs").alias("i", "a"))
    pairs = left.select("a", F.explode(F.slice("vs", F.col("i") + 2, F.size("vs"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_edge_weight)


def wcc(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, c_id, c_size, cc_degree) for every row of ``vertices`` (v).

    c_id is the least vertex of the component. A seen vertex without an edge has degree 0 and
    -1 for component and size.
    """
    degree = both_ways(edges).groupBy("v").agg(F.count(F.lit(1)).alias("cc_degree"))
    roots = components(edges.select("a", "b")).toDF("v", "c_id")
    sizes = roots.groupBy("c_id").agg(F.count(F.lit(1)).alias("c_size"))
    found = roots.join(sizes, "c_id").join(degree, "v")
    return vertices.join(found, "v", "left").select("v", F.coalesce("c_id", F.lit(-1)).alias("c_id"), F.coalesce("c_size", F.lit(-1)).alias("c_size"), F.coalesce("cc_degree", F.lit(0)).alias("cc_degree"))


def wcc_hierarchical(vertices: DataFrame, edges: DataFrame, high: float = 10, low: float = 1, levels: int = 10) -> DataFrame:
    """(v, c_id, c_size, level): components settled from strong edges to weak; what a level connects is frozen before the next.

    Vertices that never settle are components of their own (level null).
    """
    playing, found = settle_state(vertices.select("v").distinct()), None
    for i in range(1, levels + 1):
        level = high - (i - 1) * (high - low) / levels
        strong = edges.where(F.col("weight") >= level)
        live = settle_state(strong.join(playing.toDF("a"), "a", "left_semi").join(playing.toDF("b"), "b", "left_semi").select("a", "b"))
        if not live.limit(1).count():
            continue
        settled = settle_state(components(live).toDF("v", "c_id").withColumn("level", F.lit(i)))
        found = settled if found is None else found.unionByName(settled)
        playing = settle_state(playing.join(settled, "v", "left_anti"))
    alone = playing.select("v", F.col("v").alias("c_id"), F.lit(None).cast("int").alias("level"))
    found = alone if found is None else found.unionByName(alone)
    return found.join(found.groupBy("c_id").agg(F.count(F.lit(1)).alias("c_size")), "c_id").select("v", "c_id", "c_size", "level")


def pagerank(edges: DataFrame, damping: float = 0.85, max_change: float = 0.001, max_iteration: int = 25) -> DataFrame:
    """(v, pagerank): weighted, not normalised: starts at 1, s = (1-d) + d * sum of neighbours' s * w / W.

    Stops when no vertex changes by more than ``max_change`` relative to 1 + its old value, or
    at the iteration cap. Vertices without an edge are not in the result.
    """
    links = both_ways(edges)
    out = links.groupBy("v").agg(F.sum("weight").alias("total"))
    pull = settle_state(meet(links, out.withColumnRenamed("v", "u"), "u").select("v", "u", (F.col("weight") / F.col("total")).alias("share")))
    score = settle_state(out.select("v", F.lit(1.0).alias("s")))
    for _ in range(max_iteration):
        got = pull.join(score.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.sum(F.col("share") * F.col("s")).alias("sum"))
        score = settle_state(score.withColumnRenamed("s", "old").join(got, "v").select("v", (F.lit(1 - damping) + damping * F.col("sum")).alias("s"), "old"))
        change = score.agg(F.max(F.abs(F.col("s") - F.col("old")) / (1 + F.abs(F.col("old"))))).first()[0]
        score = score.select("v", "s")
        if change is None or change <= max_change:
            break
    return score.toDF("v", "pagerank")


def louvain(edges: DataFrame, max_iteration: int = 20, alternate: bool = False) -> tuple[DataFrame, dict]:
    """((v, louvain_id, louvain_size), metrics): one level of local moving.

    Every vertex moves to the neighbouring community of the largest gain (ties: the smaller
    id), all at once; with ``alternate``, cards move first, then merchants, on fresh totals.
    The synchronous form may oscillate and then ends at the iteration cap.
    """
    links = settle_state(both_ways(edges))
    degree = settle_state(links.groupBy("v").agg(F.sum("weight").cast("double").alias("k")))
    two_m = degree.agg(F.sum("k")).first()[0] or 0.0
    state = settle_state(degree.select("v", "k", F.col("v").alias("c")))
    sides = [F.col("v") < MERCHANT_BASE, F.col("v") >= MERCHANT_BASE] if alternate else [F.lit(True)]
    rounds = 0
    while two_m and rounds < max_iteration:
        rounds, moved = rounds + 1, 0
        for side in sides:
            total = state.groupBy("c").agg(F.sum("k").alias("sigma"))
            seen = links.where(side).join(state.select(F.col("v").alias("u"), "c"), "u").groupBy("v", "c").agg(F.sum("weight").alias("kic"))
            own = state.select("v", "k", F.col("c").alias("now"))
            gain = F.col("kic") - (F.col("sigma") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)) * F.col("k") / two_m
            best = seen.join(total, "c").join(own, "v").groupBy("v").agg(F.max_by("c", F.struct(gain.alias("g"), (-F.col("c")).alias("n"))).alias("to"))
            state = settle_state(state.join(best, "v", "left").select("v", "k", F.coalesce("to", "c").alias("c"), (F.coalesce("to", "c") != F.col("c")).alias("moved")))
            moved += state.where("moved").count()
            state = state.drop("moved")
        if not moved:
            break
    inside = links.join(state.select("v", F.col("c").alias("cv")), "v").join(state.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").where("cv = cu").agg(F.sum("weight")).first()[0] or 0.0
    squares = state.groupBy("c").agg(F.sum("k").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0
    sizes = state.groupBy("c").agg(F.count(F.lit(1)).alias("louvain_size"))
    quality = float(inside) / two_m - squares / (two_m * two_m) if two_m else 0.0
    return state.join(sizes, "c").select("v", F.col("c").alias("louvain_id"), "louvain_size"), {"iterations": rounds, "modularity": quality}


def kcore(edges: DataFrame, max_core: int | None = 50) -> DataFrame:
    """(v, core_number), at most ``max_core`` (None: no bound). Vertices without an edge are not in the result.

    Instead of peeling shell by shell, every vertex starts from its degree and takes the largest
    k such that k of its neighbours hold k or more, until nothing changes: the fixed point is the
    core number, in few rounds. Neighbours are counted per level that they hold, never listed.
    """
    links = settle_state(both_ways(edges).select("v", "u"))
    degree = F.count(F.lit(1))
    state = settle_state(links.groupBy("v").agg((degree if max_core is None else F.least(degree, F.lit(max_core))).alias("c")))
    down = Window.partitionBy("v").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        held = links.join(state.withColumnRenamed("v", "u"), "u").groupBy("v", "c").agg(F.count(F.lit(1)).alias("n"))
        best = held.select("v", F.least("c", F.sum("n").over(down)).alias("to")).groupBy("v").agg(F.max("to").cast("long").alias("to"))
        both = settle_state(best.join(state, "v").select("v", F.least("to", "c").alias("c"), (F.col("to") < F.col("c")).alias("moved")))
        state = both.select("v", "c")
        if not both.where("moved").limit(1).count():
            return state.select("v", F.col("c").cast("int").alias("core_number"))


#: Fixed values of the integer generator that draws the projection's signs.
LCG = {"multiplier": 2654435761, "dim_step": 40503, "factor": 1103515245, "increment": 12345, "modulus": 2147483647}


def drawn_bucket(v: str, d: str, seed: int, s: int):
    """Bucket 0..2s-1 of vertex ``v`` in dimension ``d`` (SQL columns of longs)."""
    m = LCG["modulus"]
    start = f"(({v} + 1) * {LCG['multiplier']} % {m} + ({d} + 1) * {LCG['dim_step']} + {seed}) % {m}"
    return F.expr(f"(({start}) * {LCG['factor']} + {LCG['increment']}) % {m} % {2 * s}")


def fastrp(edges: DataFrame, seen: int, dim: int = 32, beta: float = -0.1, weights: tuple[float, ...] = (1.0, 1.0, 0.0), s: int = 3, seed: int = 42) -> DataFrame:
    """(v, embedding): sparse random signs, spread along edges scaled by degree, weighted over iterations, L2-normalised.

    An iteration of weight 0 is skipped. Vertices without an edge are not in the result.
    """
    links = both_ways(edges).select("v", "u")
    degree = settle_state(links.groupBy("v").agg(F.count(F.lit(1)).alias("deg")))
    scale = F.pow(F.col("deg") / F.lit(float(seen)), F.lit(beta))
    spread = settle_state(links.join(degree.select(F.col("v").alias("u"), scale.alias("l")), "u").join(degree, "v").select("v", "u", (F.col("l") / F.col("deg")).alias("f")))
    sign = F.when(F.col("bucket") == 0, F.sqrt(F.lit(float(s)))).otherwise(-F.sqrt(F.lit(float(s))))
    prev = degree.select("v", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d")).withColumn("bucket", drawn_bucket("v", "cast(d AS long)", seed, s)).where("bucket < 2").select("v", "d", sign.alias("x"))
    total = None
    for w in weights:
        if w == 0:
            continue
        prev = settle_state(spread.join(prev.withColumnRenamed("v", "u"), "u").groupBy("v", "d").agg(F.sum(F.col("x") * F.col("f")).alias("x")))
        part = prev.select("v", "d", (F.col("x") * w).alias("x"))
        total = part if total is None else total.unionByName(part)
    final = total.groupBy("v", "d").agg(F.sum("x").alias("x"))
    vectors = degree.select("v").join(final.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")), "v", "left")
    norm = F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    entry = lambda i: F.round(F.coalesce(F.element_at("m", i), F.lit(0.0)) / norm, 6)
    return vectors.select("v", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), entry).alias("embedding"))


def degree_stratum(column: str):
    """Strata 0 to 7 of a degree: up to 1, 2, 4, 8, 16, 64, 256, and more."""
    out = F.lit(7)
    for number, top in reversed(list(enumerate((1, 2, 4, 8, 16, 64, 256)))):
        out = F.when(F.col(column) <= top, number).otherwise(out)
    return out


def permutation_control(features: DataFrame, degree: str, columns: list[str], seed: int = 42, min_stratum: int = 10) -> DataFrame:
    """``features`` (v, degree, columns) with each vertex's columns taken from a hashed donor of its degree stratum.

    Donors are ordered by vertex and may serve several vertices; small strata stay as they are.
    """
    m = LCG["modulus"]
    rows = features.withColumn("b", degree_stratum(degree))
    size = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    donors = rows.select("b", *[F.col(c).alias(f"donor_{c}") for c in columns], (F.row_number().over(Window.partitionBy("b").orderBy("v")) - 1).cast("long").alias("at"))
    draw = F.expr(f"(((v + 1) * {LCG['multiplier']} % {m} + {seed} * {LCG['dim_step']}) % {m} * {LCG['factor']} + {LCG['increment']}) % {m}")
    asked = rows.join(F.broadcast(size), "b").withColumn("at", draw % F.col("n"))
    took = asked.join(donors, ["b", "at"], "left")
    return took.select("v", F.col(degree), *[F.when(F.col("n") < min_stratum, F.col(c)).otherwise(F.col(f"donor_{c}")).alias(c) for c in columns])


def co_use(uses: DataFrame, max_degree: int = 1000) -> DataFrame:
    """Parties sharing an endpoint, both directions: (src, dst, seq), seq the earliest time at which both had used one.

    Endpoints with ``max_degree`` users or more are left out; unknown times (0) do not count.
    """
    degree = uses.groupBy("kind", "endpoint").agg(F.countDistinct("party").alias("__d"))
    kept = uses.where("seq > 0").join(degree.where(F.col("__d") < max_degree), ["kind", "endpoint"])
    groups = kept.groupBy("kind", "endpoint", "party").agg(F.min("seq").alias("seq")).groupBy("kind", "endpoint").agg(F.array_sort(F.collect_list(F.struct("party", "seq"))).alias("us"))
    left = groups.select("kind", "us", F.posexplode("us").alias("i", "a"))
    pairs = left.select("kind", "a", F.explode(F.slice("us", F.col("i") + 2, F.size("us"))).alias("b"))
    one = pairs.groupBy("kind", F.col("a.party").alias("src"), F.col("b.party").alias("dst")).agg(F.min(F.greatest("a.seq", "b.seq")).alias("seq"))
    return one.unionByName(one.select("kind", F.col("dst").alias("src"), F.col("src").alias("dst"), "seq"))
