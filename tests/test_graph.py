"""Iterative graph operators against direct computations on small random graphs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import graph
from tallyloom.operators.components import components


def random_edges(seed, n=40, m=60):
    r = random.Random(seed)
    return sorted({(min(a, b), max(a, b), r.randint(1, 5)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b})


def table(spark, edges):
    seen = {}
    for a, b, w in edges:
        seen[a, b] = w
    return spark.createDataFrame([(a, b, w) for (a, b), w in seen.items()], "a long, b long, weight long"), seen


def roots(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {x: find(x) for x in top}


@pytest.mark.parametrize("last", [0, 50_000])
def test_components(spark, last):
    edges, seen = table(spark, random_edges(3, 60, 45))
    assert dict(components(edges, last).collect()) == roots(seen)


def test_components_of_a_path_and_of_nothing(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(path, 0).collect()} == {0}
    assert components(path.where("a < 0")).count() == 0


def test_kcore(spark):
    edges, seen = table(spark, random_edges(5, 25, 90))
    near = defaultdict(set)
    for a, b in seen:
        near[a].add(b)
        near[b].add(a)
    want, alive, k = {}, set(near), 1
    while alive:
        while low := {v for v in alive if len(near[v] & alive) < k}:
            want.update(dict.fromkeys(low, k - 1))
            alive -= low
        k += 1
    assert dict(graph.kcore(edges).collect()) == want
    capped = dict(graph.kcore(edges, 2).collect())
    assert capped == {v: min(c, 2) for v, c in want.items()}


def test_louvain_round(spark):
    edges, seen = table(spark, [(0, 1, 3), (1, 2, 3), (0, 2, 3), (3, 4, 3), (4, 5, 3), (3, 5, 3), (2, 3, 1)])
    k = defaultdict(float)
    near = defaultdict(dict)
    for (a, b), w in seen.items():
        k[a] += w
        k[b] += w
        near[a][b] = near[b][a] = w
    comm, two_m = {v: v for v in k}, sum(k.values())
    for _ in range(4):
        sigma = defaultdict(float)
        for v, c in comm.items():
            sigma[c] += k[v]
        new = {}
        for v in k:
            to = defaultdict(float)
            for u, w in near[v].items():
                to[comm[u]] += w
            new[v] = min(to, key=lambda c: (-(to[c] - (sigma[c] - (k[v] if c == comm[v] else 0)) * k[v] / two_m), c))
        if new == comm:
            break
        comm = new
    got, metrics = graph.louvain(edges, max_iteration=4)
    assert {r["v"]: r["louvain_id"] for r in got.collect()} == comm
    assert -1 <= metrics["modularity"] <= 1


def test_hierarchical_levels(spark):
    edges, _ = table(spark, [(1, 2, 9), (2, 3, 4), (4, 5, 4), (3, 4, 1), (6, 7, 1)])
    v = spark.createDataFrame([(i,) for i in range(1, 9)], "v long")
    got = {r["v"]: (r["c_id"], r["c_size"], r["level"]) for r in graph.wcc_hierarchical(v, edges, high=7, low=1, levels=2).collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, None), 4: (4, 2, 2), 5: (4, 2, 2), 6: (6, 1, None), 7: (7, 1, None), 8: (8, 1, None)}


def test_wcc_marks_isolated_vertices(spark):
    edges, _ = table(spark, [(1, 2, 1)])
    got = {r["v"]: tuple(r)[1:] for r in graph.wcc(spark.createDataFrame([(1,), (2,), (3,)], "v long"), edges).collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (-1, -1, 0)}
