"""Results over a projected graph without its pairs.

``graph.project`` lists every pair of vertices that share a group; pairs grow with the square of
a group. What follows takes the groups themselves: weighted sums go through each group once,
components through a star in each group, and sums and maxima over distinct neighbours compare
vertices in squares of bits. No group is left out, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, meet, settle_state
from .graph import drawn_bucket

#: Vertices on a side of the square that one task compares and their links to groups, at most about; columns held at a time, rows of these spread out at a time.
SIDE, BLOCK_LINKS, COLUMNS, ROWS = 8192, 1 << 21, 4096, 1024
#: Groups, and links to them, whose bits are looked at together.
GROUPS, LINKS = 2048, 1 << 17
#: A pair formed as a row costs about as much as so many cells of a square.
CELLS = 1000


def shared_groups(interactions: DataFrame, over: str, min_txn_count: int = 1) -> DataFrame:
    """(g, v, n): the members of each group of ``over`` that has two at least; n is their number."""
    one = "card" if over == "merchant" else "merchant"
    kept = interactions.where(F.col("txn_count") >= min_txn_count).select(F.col(over).alias("g"), F.col(one).alias("v")).dropna().distinct()
    sizes = kept.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return settle_state(meet(kept, sizes, "g").select("g", "v", "n"))


def pagerank(groups: DataFrame, damping: float = 0.85, rounds: int = 5) -> DataFrame:
    """(v, pagerank) as ``graph.pagerank`` over the projected edges after that many rounds: a vertex gets each of its groups' sums less its own part."""
    score = settle_state(groups.groupBy("v").agg(F.sum(F.col("n") - 1).alias("total"), F.count(F.lit(1)).alias("k")).withColumn("s", F.lit(1.0)))
    own = F.col("s") / F.col("total")
    for _ in range(rounds):
        sums = meet(groups, score, "v").groupBy("g").agg(F.sum(own).alias("sum"))
        got = meet(groups, sums, "g").groupBy("v").agg(F.sum("sum").alias("sum"))
        score = settle_state(meet(score, got, "v").select("v", "total", "k", (F.lit(1 - damping) + damping * (F.col("sum") - F.col("k") * own)).alias("s")))
    return score.select("v", F.col("s").alias("pagerank"))


def component_sizes(groups: DataFrame) -> DataFrame:
    """(v, c_size) of the projected graph's components: each member is linked to the least of its group."""
    least = groups.groupBy("g").agg(F.min("v").alias("a"))
    roots = components(meet(groups, least, "g").select("a", F.col("v").alias("b"))).toDF("v", "c_id")
    return meet(roots, roots.groupBy("c_id").agg(F.count(F.lit(1)).alias("c_size")), "c_id").select("v", "c_size")


def _large_from(groups: DataFrame, vertices: int) -> int | None:
    """The size from which comparing all members of groups costs less than forming their pairs (None: never); both are exact."""
    bins = groups.groupBy(F.floor(F.log2("n")).alias("bin")).agg(F.sum((F.col("n") - 1) / 2).alias("pairs"), F.count(F.lit(1)).alias("members"))
    bins = sorted(tuple(r) for r in bins.collect())
    cost = {None: CELLS * sum(pairs for _, pairs, _ in bins)}
    for least, _, _ in bins:
        cost[2**least] = CELLS * sum(p for b, p, _ in bins if b < least) + min(vertices, sum(m for b, _, m in bins if b >= least)) ** 2
    return min(cost, key=cost.get)


class Neighbours:
    """The distinct neighbours of every vertex of ``groups`` (g, v, n), the vertex itself left out."""

    def __init__(self, groups: DataFrame):
        vertices = groups.select("v").distinct().count()
        least = _large_from(groups, vertices)
        self.members = self.pairs = None
        if least is not None:
            self.members = settle_state(groups.where(F.col("n") >= least).groupBy("v").agg(F.collect_list("g").alias("gs")))
            number, links = self.members.agg(F.count(F.lit(1)), F.sum(F.size("gs"))).first()
            self.side = max(-(-number // SIDE), -(-links // BLOCK_LINKS))
        small = groups.where(F.lit(True) if least is None else F.col("n") < least)
        if least is None or small.limit(1).count():
            found = small.withColumnRenamed("v", "a").join(small.select("g", F.col("v").alias("b")).hint("merge"), "g").where("a < b").select("a", "b").distinct()
            if least is not None:
                found = meet(meet(found, self.members.toDF("a", "as"), "a", "left"), self.members.toDF("b", "bs"), "b", "left").where(~F.coalesce(F.arrays_overlap("as", "bs"), F.lit(False))).select("a", "b")
            self.pairs = settle_state(found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("v", "u"))

    def gather(self, values: DataFrame, sums: list[str], tops: list[str] = ()) -> DataFrame:
        """(v, degree, sum_* and top_*): sums and maxima of columns of ``values`` (v, ...: doubles) over each vertex's neighbours.

        ``values`` has a row for every vertex.
        """
        parts, columns = [], [*dict.fromkeys([*sums, *tops])]
        out = ["degree", *[f"sum_{c}" for c in sums], *[f"top_{c}" for c in tops]]
        if self.members is not None:
            block, others = F.pmod(F.xxhash64("v"), F.lit(self.side)), F.sequence(F.lit(0), F.lit(self.side - 1))
            rows = self.members.withColumn("other", F.explode(others)).select((block * self.side + F.col("other")).alias("cell"), "v", "gs")
            met = meet(self.members, values, "v").withColumn("other", F.explode(others))
            cols = met.select((F.col("other") * self.side + block).alias("cell"), F.col("v").alias("u"), F.col("gs").alias("us"), *columns)
            # A fixed number of partitions: by the bytes that they hold, few tasks would compare all vertices.
            number = min(self.side**2, 10_000)
            found = rows.repartition(number, "cell").groupBy("cell").cogroup(cols.repartition(number, "cell").groupBy("cell"))
            parts.append(found.applyInArrow(_compare(list(sums), list(tops)), ", ".join(["v long", *[f"{c} double" for c in out]])))
        if self.pairs is not None:
            near = meet(self.pairs, values.withColumnRenamed("v", "u"), "u").groupBy("v")
            parts.append(near.agg(F.count(F.lit(1)).cast("double").alias("degree"), *[F.sum(c).alias(f"sum_{c}") for c in sums], *[F.max(c).alias(f"top_{c}") for c in tops]))
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return both.groupBy("v").agg(*[(F.max if c.startswith("top_") else F.sum)(c).alias(c) for c in out])


def _compare(sums: list[str], tops: list[str]):
    """The function of one square: its rows' sums and maxima over those of its columns that share a group with them."""

    def square(rows, cols):
        import numpy as np
        import pyarrow as pa

        def links(table, name):
            lists = table[name].combine_chunks()
            return np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()

        row_v, (row, row_g) = rows["v"].to_numpy(), links(rows, "gs")
        cols = cols.sort_by("u")
        col_v, (col, col_g) = cols["u"].to_numpy(), links(cols, "us")
        value = {c: cols[c].to_numpy() for c in {*sums, *tops}}
        x = np.column_stack([np.ones(col_v.size), *[value[c] for c in sums]])
        total, top = np.zeros((row_v.size, x.shape[1])), np.full((row_v.size, len(tops)), -np.inf)
        for start in range(0, col_v.size, COLUMNS):
            end = min(start + COLUMNS, col_v.size)
            bits = _shared(np, row, row_g, row_v.size, col[(at := (col >= start) & (col < end))] - start, col_g[at])
            own = np.searchsorted(col_v[start:end], row_v)
            own_row = np.flatnonzero((own < end - start) & (col_v[start:end][np.minimum(own, end - start - 1)] == row_v))
            bits[own_row, own[own_row] // 8] &= ~(128 >> own[own_row] % 8).astype(np.uint8)
            order = [np.argsort(-value[c][start:end], kind="stable") for c in tops]
            for low in range(0, row_v.size, ROWS):
                near = np.unpackbits(bits[low : low + ROWS], axis=1, count=end - start)
                total[low : low + ROWS] += near.astype(np.float64) @ x[start:end]
                for k, c in enumerate(tops):
                    ranked = near[:, order[k]].view(bool)
                    first = ranked.argmax(axis=1)
                    found = np.where(ranked[np.arange(first.size), first], value[c][start:end][order[k]][first], -np.inf)
                    top[low : low + ROWS, k] = np.maximum(top[low : low + ROWS, k], found)
        seen = total[:, 0] > 0
        out = ["degree", *[f"sum_{c}" for c in sums], *[f"top_{c}" for c in tops]]
        return pa.table([pa.array(row_v[seen]), *[pa.array(np.ascontiguousarray(y)) for y in (*total[seen].T, *top[seen].T)]], names=["v", *out])

    return square


def _shared(np, row, row_g, rows: int, col, col_g):
    """Bits of rows by columns (at most COLUMNS): set where both have a group in common. Rows' links come sorted by row."""
    bits = np.zeros((rows, COLUMNS // 64), np.uint64)
    names = np.intersect1d(row_g, col_g)
    for start in range(0, names.size, GROUPS):
        part = names[start : start + GROUPS]

        def held(link, g):
            at = np.minimum(np.searchsorted(part, g), part.size - 1)
            keep = part[at] == g
            return link[keep], at[keep]

        (r, rg), (c, cg) = held(row, row_g), held(col, col_g)
        of_group = np.zeros((part.size, COLUMNS), bool)
        of_group[cg, c] = True
        of_group = np.packbits(of_group, axis=1).view(np.uint64)
        for low in range(0, r.size, LINKS):
            one, of = r[low : low + LINKS], rg[low : low + LINKS]
            first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
            bits[one[first]] |= np.bitwise_or.reduceat(of_group[of], first, axis=0)
    return bits.view(np.uint8)


def fastrp(near: Neighbours, degree: DataFrame, dim: int = 32, beta: float = -0.1, weights: tuple[float, ...] = (1.0, 1.0, 0.0), s: int = 3, seed: int = 42) -> DataFrame:
    """(v, embedding) as ``graph.fastrp`` over the projected edges; ``degree`` is (v, degree: neighbours)."""
    names = [f"x{i}" for i in range(dim)]
    scale = F.pow(F.col("degree") / F.lit(float(degree.count())), F.lit(beta))
    root = F.sqrt(F.lit(float(s)))
    drawn = [F.when((b := drawn_bucket("v", f"{i}L", seed, s)) == 0, root).when(b == 1, -root).otherwise(0.0).alias(n) for i, n in enumerate(names)]
    prev, total = degree.select("v", *drawn), None
    for w in weights:
        if w == 0:
            continue
        scaled = meet(degree, prev, "v").select("v", *[(scale * F.col(n)).alias(n) for n in names])
        got = meet(degree.toDF("v", "d"), near.gather(scaled, names), "v")
        prev = settle_state(got.select("v", *[(F.col(f"sum_{n}") / F.col("d")).alias(n) for n in names]))
        part = prev.select("v", *[(F.col(n) * w).alias(n) for n in names])
        total = part if total is None else total.unionByName(part)
    final = total.groupBy("v").agg(*[F.sum(n).alias(n) for n in names])
    norm = F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0)))
    final = final.withColumn("norm", F.when(norm > 0, norm).otherwise(1.0))
    return final.select("v", F.array(*[F.round(F.col(n) / F.col("norm"), 6) for n in names]).alias("embedding"))
