"""The ten operators against brute force, on odd inputs: nulls, blanks, long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, line_dedup, mixing, packing, quality, registry, repetition, simhash, substring_dedup, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, `row` string, maybe string, __k string, fp string, c0 string, shards string"
SPACE = "[\\x20\\x09-\\x0D]"


def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["ünï", "日本", "é", " x"]
    passage = " ".join(r.choice(words) for _ in range(60))
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three"), (5, passage), (6, passage), (7, f"x {passage} y"), (7, passage), (8, passage.replace(" ", "\n")), (None, passage), (None, None), (9, "a " * 3000), (10, passage * 40), (11, passage[20:200]), (12, "é" * 80), (13, "x" + "é" * 79)]
    for i in range(14, 60):
        text = " ".join(r.choice(words) for _ in range(r.choice([3, 12, 13, 14, 50, 200])))
        if i % 3 == 0:
            text += "\nshared line one\nshared line two\nshared line three\n" + passage[: r.randint(20, 300)]
        out.append((i, text))
    return out + out[20:23]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "abc"[k % 3] if k % 7 else None, 1, *["z"] * 7) for k, (i, t) in enumerate(corpus())], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ranked(i):
    return float("inf") if i is None else i


def words_of(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


def as_bag(rows):
    return Counter(tuple(r) for r in rows)


def removed(items_of, n, join):
    """Brute force: (doc_id, items, removed, sha) where an n-window also starts in a smaller doc_id."""
    first, out = {}, []
    for i, t in corpus():
        items = items_of(t)
        for k in range(len(items) - n + 1):
            w = tuple(items[k : k + n])
            first[w] = min(first.get(w, float("inf")), ranked(i))
    for i, t in corpus():
        items, gone = items_of(t), set()
        for k in range(len(items) - n + 1):
            if first[tuple(items[k : k + n])] < ranked(i):
                gone.update(range(k, k + n))
        out.append((i, len(items), len(gone), join([x for k, x in enumerate(items) if k not in gone])))
    return Counter(out)


@pytest.mark.parametrize("hot,segment", [(0, 100), (4, 1000), (2048, 1 << 18)])
def test_substring_dedup(docs, hot, segment):
    got = substring_dedup.substring_dedup(docs, hot=hot, segment=segment)
    want = removed(words_of, 13, " ".join)
    assert as_bag(got.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == want
    texts = defaultdict(list)
    for i, t in corpus():
        texts[ranked(i)].append(" ".join(words_of(t)))
    for r in got.where("n_removed > 0").collect():
        spans, before = r["factors"], 0
        assert r["n_removed"] == len({w for f in spans for w in range(f["start"], f["start"] + f["length"])})
        for f in spans:
            # Every factor is text of its source; only windows across a boundary may begin inside the factor before.
            assert f["length"] >= 13 and f["source"] < ranked(r["doc_id"])
            assert f["boundary"] or f["start"] >= before
            before = before if f["boundary"] else f["start"] + f["length"]
            own = {" ".join(words_of(t)[f["start"] : f["start"] + f["length"]]) for t in [x for i, x in corpus() if i == r["doc_id"]]}
            assert any(x in t for x in own for t in texts[f["source"]])


def test_windows_across_factors_are_checked(spark):
    """A document made of two overlapping sources: the second is known by boundary windows first."""
    w = [f"u{i}" for i in range(60)]
    rows = [(1, " ".join(w[:30])), (2, " ".join(w[20:60])), (3, " ".join(w))]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 0, 60]
    assert [tuple(f) for f in got[3]["factors"]] == [(0, 30, 1, False), (20, 22, 2, True), (30, 30, 2, False)]


@pytest.mark.parametrize("hot,segment", [(0, 100), (4, 1000), (2048, 1 << 18)])
def test_suffix_dedup(docs, hot, segment):
    got = suffix_dedup.suffix_dedup(docs, hot=hot, segment=segment)
    want = removed(lambda t: list((t or "").encode()), 50, bytes)
    rows = got.collect()
    assert as_bag((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in rows) == want
    for r in rows:
        assert sum(s["length"] for s in r["spans"]) == r["n_removed"]


def test_line_dedup(docs):
    out = []
    order = sorted(enumerate(corpus()), key=lambda x: ranked(x[1][0]))
    first = defaultdict(lambda: float("inf"))
    for _, (i, t) in order:
        lines = (t or "").split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            first[w] = min(first[w], ranked(i))
    for i, t in corpus():
        lines, gone, own = (t or "").split("\n"), set(), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if first[w] < ranked(i) or w in own:
                gone.update(range(k, k + 3))
            own.add(w)
        out.append((i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    assert as_bag(line_dedup.line_dedup(docs).collect()) == Counter(out)


def groups_by_text():
    out = defaultdict(list)
    for i, t in corpus():
        out[re.sub(SPACE, "", t or "")].append((i, t))
    return out


@pytest.mark.parametrize("limit", [8, 40, 64 << 20])
def test_exact_dedup(docs, limit):
    want = []
    for text, rows in groups_by_text().items():
        best = min(range(len(rows)), key=lambda k: (-len(rows[k][1] or ""), ranked(rows[k][0])))
        want += [(i, rows[best][0], len(rows), k == best, hashlib.sha256(text.encode()).hexdigest()) for k, (i, _) in enumerate(rows)]
    assert as_bag(exact_dedup.exact_groups(docs, limit).collect()) == Counter(want)
    kept = exact_dedup.drop_copies(docs, limit)
    assert kept.columns == docs.columns
    assert Counter(re.sub(SPACE, "", r["text"] or "") for r in kept.collect()) == Counter(list(groups_by_text()))


def fingerprint(text):
    low = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    grams = [b" ".join(low[i : i + 4]) for i in range(len(low) - 3)] if len(low) >= 4 else [b" ".join(low)] if low else []
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def test_fingerprints(docs):
    got = Counter((r[0], r[1] & (1 << 64) - 1) for r in simhash.fingerprints(docs).collect())
    assert got == Counter((i, fingerprint(t)) for i, t in corpus())


def near_prints(seed, n=400):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(40)] + [0]
    out = [0]
    for _ in range(n):
        x = r.choice(centres)
        for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4, 5, 9])):
            x ^= 1 << b
        out.append(x)
    return sorted(set(out))


def linked(prints, bits=4):
    top = {x: x for x in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, x in enumerate(prints):
        for y in prints[:i]:
            if (x ^ y).bit_count() <= bits:
                a, b = find(x), find(y)
                top[max(a, b)] = min(a, b)
    return {x: find(x) for x in prints}


@pytest.mark.parametrize("tile,pairwise,groups", [(32768, 256, 6), (8, 4, 6), (32768, 2, 8)])
def test_links(spark, monkeypatch, tile, pairwise, groups):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "_PAIRWISE", pairwise)
    monkeypatch.setattr(simhash, "GROUPS", ((1 << 63, groups),))
    prints = near_prints(4)
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    from tallyloom.operators.components import components

    got = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in components(simhash.links(rows, len(prints))).collect()}
    want = linked(prints)
    same = lambda m: {frozenset(x for x in m if m[x] == r) for r in set(m.values())}
    assert same(got) == {g for g in same(want) if len(g) > 1}


def test_manhattan_bounds_hamming():
    r = np.random.default_rng(1)
    x, y = r.integers(0, 2**63, 500).astype(np.uint64), r.integers(0, 2**63, 500).astype(np.uint64)
    a, b = simhash.embed(x), simhash.embed(y)
    field = lambda v, s: (v >> np.uint64(2 * s) & np.uint64(3)).astype(int)
    assert (sum(np.abs(field(a, s) - field(b, s)) for s in range(32)) <= np.bitwise_count(x ^ y)).all()


def test_near_groups(docs):
    prints = {fingerprint(t) for _, t in corpus()}
    root = linked(sorted(prints))
    least = {}
    for i, t in corpus():
        if i is not None:
            k = root[fingerprint(t)]
            least[k] = min(least.get(k, i), i)
    want = Counter((i, least.get(root[fingerprint(t)])) for i, t in corpus())
    assert as_bag(simhash.near_groups(docs).select("doc_id", "component_id").collect()) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(least.values())


def test_keep_one_by_whole_rows(spark):
    a, b, u, v = "one two three four five six", "some other words stand here now", "a text with no number at all", "alone among many rows it stays"
    rows = [(5, a, 1), (7, a, 2), (7, b, 3), (None, a, 4), (None, u, 5), (None, u, 6), (9, None, 7), (None, "", 8), (5, a, 9), (3, v, 10)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, h1 long")).collect()
    assert sorted(r["h1"] for r in kept if r["h1"] not in (5, 6)) == [1, 3, 7, 9, 10]
    assert sum(r["h1"] in (5, 6) for r in kept) == 1


def test_repetition(docs):
    want = []
    for i, t in corpus():
        w = words_of(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        seen, twice = set(), 0
        for line in (t or "").split("\n"):
            twice += line in seen and bool(words_of(line))
            seen.add(line)
        want.append((i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), twice, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    got = repetition.repetition_rules(docs)
    assert as_bag(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == Counter(want)
    assert got.where("kept AND base_failed").count() == 0


def test_repetition_shares(spark):
    w = [f"v{i}" for i in range(40)]
    rows = [(1, " ".join(w)), (2, " ".join(w + w[:12])), (3, "\n".join([" ".join(w[:8])] * 6))]
    got = {r["doc_id"]: r for r in repetition.repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    chars = sum(map(len, w[:12]))
    assert got[2]["dup_5gram_share"] == pytest.approx(2 * chars / (sum(map(len, w)) + chars)) and got[2]["dup_10gram_share"] == got[2]["dup_5gram_share"]
    assert got[1]["kept"] and not got[3]["kept"] and got[3]["n_dup_lines"] == 5


def test_packing(docs):
    rows = packing.pack(docs, buckets=4, budget=500).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((i, len(words_of(t))) for i, t in corpus())
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows)
    size = Counter((r["bucket"], r["batch"]) for r in rows)
    for r in rows:
        assert r["n_tokens"] <= r["bucket_len"] and r["padding"] == r["bucket_len"] - r["n_tokens"]
        assert size[r["bucket"], r["batch"]] * r["bucket_len"] <= 500 or size[r["bucket"], r["batch"]] == 1
    for b in {r["bucket"] for r in rows}:
        full = sorted(n for (k, _), n in size.items() if k == b)[1:]
        assert len(set(full)) <= 1  # only one batch of a bucket is not full


def test_boundaries_are_optimal():
    import itertools

    r = random.Random(2)
    top = np.array(sorted(r.sample(range(1, 60), 9)))
    count = np.array([r.randint(1, 9) for _ in top])
    best = min(
        sum(int(count[k]) * (min(e for e in ends if e >= top[k]) - int(top[k])) for k in range(9))
        for ends in (tuple(int(x) for x in c) + (int(top[-1]),) for c in itertools.combinations(top[:-1], 2))
    )
    ends = packing.boundaries(top.tolist(), count.tolist(), (top * count).tolist(), 3)
    assert sum(int(count[k]) * (min(e for e in ends if e >= top[k]) - int(top[k])) for k in range(9)) == best and ends[-1] == top[-1]


def test_boundaries_of_long_texts_are_optimal():
    """Against the plain quadratic programme, up to 20,000 tokens."""
    r = np.random.default_rng(4)
    top = np.unique(np.minimum(20000, (r.pareto(1.1, 4000) * 300 + 1).astype(int)))
    count = r.integers(1, 50, top.size)
    rows, words = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * top)])
    best = np.concatenate([[0], np.full(top.size, 1 << 60)])
    for _ in range(8):
        best = np.array([0] + [min(best[i] + top[j - 1] * (rows[j] - rows[i]) - (words[j] - words[i]) for i in range(max(0, j - 900), j)) for j in range(1, top.size + 1)])
    ends = np.array(packing.boundaries(top.tolist(), count.tolist(), (count * top).tolist(), 8))
    assert int((count * (ends[np.searchsorted(ends, top)] - top)).sum()) == best[-1]


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([("a", 10), ("b", 1000)]) == [20.0, 1495.0]
    assert mixing.targets([("a", 0), (None, 0)]) == [0.0, 0.0] and mixing.targets([]) == []


def test_tree_is_exact_and_spread(spark):
    q = np.array([1000, 30, 0, 400])
    for shards in (1, 7, 200):
        got = mixing.tree(spark, q, shards, 5).collect()
        for nth, size in enumerate(q):
            ranges = sorted((r["first"], r["last"]) for r in got if r["nth"] == nth)
            assert [x for a, b in ranges for x in range(a, b + 1)] == list(range(size))
        per = Counter()
        for r in got:
            per[r["shard"]] += r["last"] - r["first"] + 1
        assert len(per) == shards and max(per.values()) - min(per.values()) <= 1
        assert as_bag(got) == as_bag(mixing.tree(spark, q, shards, 5).collect())
        assert shards == 1 or as_bag(got) != as_bag(mixing.tree(spark, q, shards, 6).collect())


def test_mix_keeps_whole_rows(spark, docs):
    """Clashing names, null and repeated ids, repeated rows: what comes out are rows of the table, each at most twice."""
    names = ["doc_id", "text", "source", "__k", "__shard", "__copy", "__shards", "n", "k", "row", "shards", "nth"]
    own = docs.select("doc_id", "text", "source", *[F.lit(f"its {c}").alias(c) for c in names[3:]])
    have, got = as_bag(own.collect()), as_bag(mixing.mix(own, 3).collect())
    assert got and all(got[r] <= 2 * have[r] for r in got)
    verdicts = Counter()
    for r in mixing.taken(own, 3).collect():
        verdicts[r["doc_id"]] += len(r["shards"])
    ids = Counter()
    for r, c in got.items():
        ids[r[0]] += c
    assert ids == +verdicts
    # The same rows in other partitions are taken alike.
    other = own.repartition(7)
    flat = [F.concat_ws(",", "shards").alias("shards"), "doc_id", "size", "taken"]
    assert as_bag(mixing.taken(other, 3).select(*flat).collect()) == as_bag(mixing.taken(own, 3).select(*flat).collect())


def test_a_source_of_one_text_is_split(spark):
    rows = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 400, "x").otherwise(F.lit("y")).alias("source"))
    for r in mixing.taken(rows).groupBy("source_size").agg(F.sum("taken").alias("t"), F.max("target").alias("goal")).collect():
        assert abs(r["t"] - r["goal"]) <= 3


def test_mixing(spark, docs):
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 50 as int))").alias("text"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 > 0, "b").alias("source"))
    options = {"block_words": 500, "shard_words": 5000}
    got = mixing.taken(big, 1, **options).collect()
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == len(r["shards"]) * r["size"]
        per[r["source_size"]][0] += r["taken"]
        per[r["source_size"]][2] = r["target"]
    for size, (total, _, goal) in per.items():
        assert abs(total - goal) <= 0.02 * size
    assert as_bag((r["doc_id"], r["taken"], tuple(r["shards"])) for r in got) == as_bag((r["doc_id"], r["taken"], tuple(r["shards"])) for r in mixing.taken(big, 1, **options).collect())
    assert len({s for r in got for s in r["shards"]}) > 5
    assert mixing.mix(big, 1, **options).count() == sum(len(r["shards"]) for r in got)
    odd = mixing.taken(docs).collect()
    assert len(odd) == len(corpus()) and all(r["taken"] <= 2 * r["size"] for r in odd)
    assert mixing.mix(docs).columns == docs.columns


def labelled(n=400):
    r = random.Random(3)
    words = [f"word{i}" for i in range(200)]
    out = []
    for i in range(n):
        toxic, poor = i % 7 == 0, i % 5 == 0
        sentences = [" ".join(r.choice(words) for _ in range(8)) for _ in range(6)]
        if toxic:
            sentences[r.randrange(6)] += " " + r.choice(["vileword", "badword"])
        text = ". ".join(sentences) + "."
        out.append((i, text.upper().replace(" ", " !! ") if poor else text, 0 if poor else 1, int(toxic)))
    return out


def test_quality_model(spark):
    rows = labelled()
    w = quality.train(pa.array([r[1] for r in rows[:300]]), np.array([r[2] for r in rows[:300]]))
    s = quality.score(w, pa.array([r[1] for r in rows[300:]] + ["", None]))
    assert ((s[:100] >= 0.3) == np.array([r[2] == 1 for r in rows[300:]])).mean() > 0.97 and ((0 <= s) & (s <= 1)).all()


def test_toxicity_model_locates_sentences(spark):
    rows = labelled()
    w = toxicity.train(pa.array([r[1] for r in rows[:300]]), np.array([r[3] for r in rows[:300]]))
    out = toxicity.score(w, pa.array([r[1] for r in rows[300:]] + ["", None]))
    s = out["score"].to_numpy()
    assert ((s[:100] >= 0.3) == np.array([r[3] == 1 for r in rows[300:]])).mean() > 0.95 and s[100] == s[101] == 0
    for r, spans in zip(rows[300:], out["sentences"].to_pylist()):
        for x in spans:
            if r[3]:
                assert re.search("vileword|badword", r[1].encode()[x["start"] : x["end"]].decode(), re.I)


def test_models_learn_from_their_part_only(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(docs, labels) == quality.fit(docs, flipped)).all()
    assert quality.fit(docs, labels.where("doc_id < 0")).sum() == 0
    w = toxicity.fit(docs, labels)
    kept = toxicity.drop_toxic(docs, w)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_scores_of_odd_rows(docs):
    n = len(corpus())
    assert quality.quality_scores(docs, np.zeros(quality.SLOTS + 1)).count() == n
    assert toxicity.toxicity_scores(docs, np.append(np.zeros(toxicity.SLOTS), -6.0)).count() == n
    assert toxicity.drop_toxic(docs, np.append(np.zeros(toxicity.SLOTS), -60.0)).count() == n


def test_empty_tables(empty):
    assert substring_dedup.substring_dedup(empty).count() == suffix_dedup.suffix_dedup(empty).count() == line_dedup.line_dedup(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == exact_dedup.drop_copies(empty).count() == 0
    assert simhash.near_groups(empty).count() == simhash.keep_one(empty).count() == 0
    assert repetition.repetition_rules(empty).count() == packing.pack(empty).count() == mixing.taken(empty).count() == mixing.mix(empty).count() == 0
    assert toxicity.drop_toxic(empty, np.append(np.zeros(toxicity.SLOTS), -6.0)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), duck.execute(registry.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert Counter(map(tuple, got[columns].astype(str).values)) == Counter(map(tuple, want[columns].astype(str).values))
