"""Text operators on shared and missing ids, and on window lengths far from the registered ones."""

import random

import pytest

from tallyloom.llm import simhash, substring_dedup, suffix_dedup


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choice([f"w{i}" for i in range(500)]) for _ in range(80)) for _ in range(n)]


def kept(spark, rows):
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, note string"))
    assert got.columns == ["doc_id", "text", "note"]
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["note"]) for r in got.collect())


def test_null_ids_go_with_their_own_component_only(spark):
    a, b, c = texts(1, 3)
    rows = [(1, a, "a"), (None, a.upper(), "near a"), (None, b, "b"), (2, c, "c")]
    assert kept(spark, rows) == [(False, 1, "a"), (False, 2, "c"), (True, 0, "b")]


def test_a_shared_id_goes_with_its_own_component_only(spark):
    a, b = texts(2, 2)
    assert kept(spark, [(1, a, "a"), (5, a.upper(), "near a"), (5, b, "b")]) == [(False, 1, "a"), (False, 5, "b")]
    assert kept(spark, [(1, a, "a"), (1, a, "a"), (5, a, "copy")]) == [(False, 1, "a")] * 2


def test_a_component_without_ids_keeps_one_row(spark):
    a, b = texts(3, 2)
    assert kept(spark, [(None, a, "a"), (None, a.upper(), "a"), (None, a + " ", "a"), (None, b, "b")]) == [(True, 0, "a"), (True, 0, "b")]


@pytest.mark.parametrize("n", [70, 71, 84, 100, 150])
def test_long_windows(spark, n):
    """Repeats of n + 3 items amid fresh ones go whole, whatever n."""
    r = random.Random(n)
    fresh = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    words, letters = [], []
    for i in range(8):
        same, text = [fresh(6) for _ in range(n + 3)], fresh(n + 3)
        for k, mark in ((2 * i, "A"), (2 * i + 1, "B")):
            words.append((k, " ".join([*(fresh(7) for _ in range(2 * n)), *same, *(fresh(7) for _ in range(2 * n))])))
            letters.append((k, fresh(2 * n) + mark + text + mark + fresh(2 * n)))
    want = {k: n + 3 if k % 2 else 0 for k in range(16)}
    for dedup, rows in ((substring_dedup.substring_dedup, words), (suffix_dedup.suffix_dedup, letters)):
        assert dict(dedup(spark.createDataFrame(rows, "doc_id long, text string"), n).select("doc_id", "n_removed").collect()) == want


def test_slices_of_one_hash_stay_apart(monkeypatch):
    """Equal slices that lie beyond an unequal one of the same hash are never taken for it."""
    import numpy as np

    from tallyloom.llm import _repeats

    monkeypatch.setattr(_repeats, "hashed", lambda b, start, end, seed: np.zeros(start.size, np.uint64))
    data = [b"aaaa", b"aaaa", b"bbbb", b"aaaa", b"bbbb", b"ccc"]
    flat, end = np.frombuffer(b"".join(data) + bytes(32), np.uint8), np.cumsum([len(x) for x in data])
    start = end - [len(x) for x in data]
    order, new = _repeats.equal_slices(_repeats.Bytes(flat, np.zeros(1, np.int64)), start, end, np.zeros(6, np.uint64))
    group = np.cumsum(new) - 1
    for g in range(group.max() + 1):
        assert len({data[i] for i in order[group == g]}) == 1
