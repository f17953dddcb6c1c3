"""The velocity features online: keyed state per card over a Structured Streaming source.

Each micro-batch hands a card's new rows to ``step`` in order of (unix_time, event_seq). State
holds what the batch windows would look back on: rows of the last 24 hours, last time and
count per merchant, and running moments. Rows older than the card's last row are late: they
get no features and are marked, for a side table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY, HOUR = 86400, 3600
OUT = "card long, event_seq long, late boolean, row_card_gap_seconds long, row_pair_gap_seconds long, row_card_txn_count_1h long, row_card_txn_count_24h long, row_card_amount_24h double, row_card_tenure_seconds long, row_pair_txn_count long"


def _empty() -> dict:
    return {"recent": [], "pairs": {}, "first": None, "last": None}


def step(card: int, rows: pd.DataFrame, state: dict) -> list[tuple]:
    """Features of one card's rows in time order; changes ``state``."""
    out = []
    for seq, ut, merchant, amount in rows.sort_values(["unix_time", "event_seq"])[["event_seq", "unix_time", "merchant", "amount"]].itertuples(index=False):
        if state["last"] is not None and (ut, seq) <= state["last"]:
            out.append((card, seq, True, None, None, None, None, None, None, None))
            continue
        state["recent"] = [(t, a) for t, a in state["recent"] if ut - t <= DAY]
        gap = ut - state["last"][0] if state["last"] else -1
        seen, count = state["pairs"].get(merchant, (None, 0))
        state["first"] = ut if state["first"] is None else state["first"]
        out.append((card, seq, False, gap, -1 if seen is None else ut - seen, sum(ut - t <= HOUR for t, _ in state["recent"]), len(state["recent"]), round(sum(a for _, a in state["recent"]), 2), ut - state["first"], count))
        state["recent"].append((ut, amount))
        state["pairs"][merchant] = (ut, count + 1)
        state["last"] = (ut, seq)
    return out


def stream_velocity(rows: DataFrame) -> DataFrame:
    """``rows`` is a stream of (event_seq, card, merchant, unix_time, amount)."""
    names = [x.split()[0] for x in OUT.split(", ")]

    def update(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = pickle.loads(held.get[0]) if held.exists else _empty()
        got = pd.concat(list(batches))
        made = step(int(key[0]), got, state)
        held.update((pickle.dumps(state),))
        yield pd.DataFrame(made, columns=names).astype({"late": bool})

    return rows.groupBy("card").applyInPandasWithState(update, OUT, "state binary", "append", GroupStateTimeout.NoTimeout)
