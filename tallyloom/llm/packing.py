"""Packing into optimal length buckets.

A global histogram of token counts goes to the driver, one entry per length. Different lengths
add up to no more than all tokens T, so there are at most sqrt(2 T) entries (six million for
100 TB of text). Dynamic programming over it chooses the bucket boundaries with the least padding. Inside each bucket, rows are numbered along a
hashed order and cut into batches of at most ``budget`` tokens, padding included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import settle_table
from ._skew import running_total

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 8
BUDGET = 1 << 16


def boundaries(top: list[int], count: list[int], tokens: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding; lengths ``top`` rise.

    Padding of lengths i..j-1 in one bucket is top[j-1] * (rows[j] - rows[i]) - (words[j] - words[i]), so for
    each j the best i is the least of lines with falling slopes at a rising place: a lower hull
    with a pointer finds all of them in one go. Whole numbers throughout.
    """
    n, rows, words = len(top), [0], [0]
    for c, t in zip(count, tokens):
        rows.append(rows[-1] + c)
        words.append(words[-1] + t)
    best: list[int | None] = [0] + [None] * n
    back = []
    for _ in range(min(buckets, n)):
        new, choice, hull, at = [0] + [None] * n, [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                slope, base = -rows[j - 1], best[j - 1] + words[j - 1]
                while len(hull) >= 2:
                    (s1, b1, _), (s2, b2, _) = hull[-2], hull[-1]
                    if (base - b1) * (s1 - s2) > (b2 - b1) * (s1 - slope):
                        break
                    hull.pop()
                hull.append((slope, base, j - 1))
                at = min(at, len(hull) - 1)
            x = top[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            slope, base, choice[j] = hull[at]
            new[j] = slope * x + base + x * rows[j] - words[j]
        best = new
        back.append(choice)
    ends, j = [], n
    for choice in reversed(back):
        if j == 0:
            break
        ends.append(top[j - 1])
        j = choice[j]
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket, bucket_len, batch, slot, padding.

    Tokens are words (a null text has none; a row without words takes up one token of room).
    ``batch`` numbers batches inside a bucket; a batch holds ``budget // bucket_len`` rows, one
    at least, so a text longer than the budget is a batch of its own. Repeated rows are
    packed one by one. Reads ``doc_id`` and ``text`` only; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("doc_id", "text").alias("k"))
    rows = settle_table(rows.withColumn("room", F.greatest("n_tokens", F.lit(1))))
    hist = rows.groupBy("room").agg(F.count(F.lit(1)).alias("n"))
    cells = sorted((r["room"], r["n"], r["n"] * r["room"]) for r in hist.collect())
    if not cells:
        return rows.select("doc_id", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("bucket", "bucket_len", "batch", "slot", "padding")])
    ends = boundaries(*(list(x) for x in zip(*cells)), buckets)
    number, length = F.lit(len(ends) - 1), F.lit(ends[-1])
    for i in range(len(ends) - 2, -1, -1):
        inside = F.col("room") <= ends[i]
        number, length = F.when(inside, i).otherwise(number), F.when(inside, ends[i]).otherwise(length)
    rows = rows.withColumn("bucket", number.cast("long")).withColumn("bucket_len", length.cast("long")).withColumn("one", F.lit(1).cast("long"))
    ranked = running_total(rows, "bucket", ["k", "doc_id", "n_tokens"], {"rank": "one"}, sum(c[1] for c in cells))
    each = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1))
    return ranked.select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("rank") / each).cast("long").alias("batch"), (F.col("rank") % each).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )


def op2_length_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
