"""Line dedup over overlapping three-line windows.

Consecutive lines are hashed; windows that repeat anywhere are found globally (``_repeats``), and
every occurrence but the first, in order of doc_id and position, goes. Covered positions of
overlapping windows are merged before lines are cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import Chunk, id_column, merged, runs, whole_windows
from .suffix_dedup import kept_bytes

LINES = 3
_SCHEMA = "doc_id long, n_lines long, n_removed long, kept_text string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _builder(n: int):
    def build(c: Chunk, number: np.ndarray, p: np.ndarray, marked: np.ndarray) -> pa.Table:
        # Within one document the first occurrence stays, later ones go.
        own = c.doc(p)
        order = np.lexsort((p, number, own))
        later = np.zeros(p.size, bool)
        later[order] = ~runs(own[order], number[order])
        gone = np.flatnonzero(marked | later)
        doc, s, e = merged(own[gone], p[gone], p[gone] + n)
        removed = np.bincount(doc, weights=e - s, minlength=c.who.size).astype(np.int64)
        # A line goes with the newline before it; at the top of a text, with the one after it.
        top, bottom = s == c.first[doc], e == c.first[doc + 1]
        start = c.start[s] - ~top
        end = np.where(top & ~bottom, c.start[np.minimum(e, c.size - 1)], c.end[e - 1])
        left = np.diff(c.b.off) - np.bincount(doc, weights=end - start, minlength=c.who.size).astype(np.int64)
        return pa.table([id_column(c.who), pa.array(np.diff(c.first).astype(np.int64)), pa.array(removed), kept_bytes(c, start, end, left, pa.string())], schema=_ARROW)

    return build


def line_dedup(docs: DataFrame, n: int = LINES) -> DataFrame:
    """One row per row of ``docs``: its text without later occurrences of n-line windows.

    Lines are split at ``\\n`` and compared whole, blank lines included, by 128 bits of hashes. Reads
    ``doc_id`` and ``text`` only. A null text is one empty line; a null doc_id counts as larger than
    any other; rows that share a doc_id are not held against each other; a text of fewer than ``n``
    lines stays as it is. Windows are judged on the input, not on what is left.
    """
    return whole_windows(docs, n, _builder(n), _SCHEMA, _ARROW)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (
  SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)
), o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS pos FROM o WHERE nth > 1),
r AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id)
SELECT l.doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(ats), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ats IS NULL THEN ls ELSE list_filter(ls, lambda x, pos: NOT list_contains(ats, pos)) END, chr(10))) AS kept_sha256
FROM l LEFT JOIN r USING (doc_id)
"""
