"""Latest prices in flight: a timer for each token's first call, every few minutes while it is young and whole, else once a day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Age up to which a call is young, and the two cadences, in milliseconds.
YOUNG, OFTEN, SELDOM = 30 * 86_400_000, 15 * 60_000, 86_400_000
OUT = "call_id long, token string, checked_ms long, trade_ms long, latest_price double, return_pct double, rugged boolean, changed boolean"
STATE = "call_id long, entry_ms long, entry_price double, trade_ms long, price double, rugged boolean, told double, due_ms long"


def cadence(now_ms: int, entry_ms: int, rugged: bool, young: int = YOUNG, often: int = OFTEN, seldom: int = SELDOM) -> int:
    """Milliseconds to the next check of a call."""
    return often if now_ms - entry_ms < young and not rugged else seldom


def take_in(known: tuple | None, rows: pd.DataFrame) -> tuple:
    """State after a token's new rows: its first call, and its last price and whether it is rugged, by event time.

    A rug is final: prices behind it don't count. Of rows of one moment the last in order of `seq` counts.
    """
    call_id, entry_ms, entry_price, trade_ms, price, rugged, told, due_ms = known or (None, None, None, None, None, False, None, None)
    for r in rows.sort_values(["ms", "seq"]).itertuples():
        if r.kind == "call" and (entry_ms is None or (r.ms, r.call_id) < (entry_ms, call_id)):
            call_id, entry_ms, entry_price = int(r.call_id), int(r.ms), None if pd.isna(r.price) else float(r.price)
        elif r.kind == "rug":
            rugged = True
        elif r.kind == "price" and not rugged and not pd.isna(r.price) and (trade_ms is None or r.ms >= trade_ms):
            trade_ms, price = int(r.ms), float(r.price)
    return call_id, entry_ms, entry_price, trade_ms, price, rugged, told, due_ms


def told_of(token: str, state: tuple, now_ms: int) -> tuple[pd.DataFrame, tuple]:
    """The row of a check, and the state that remembers what it told: -100 % once rugged, null without a usable entry or price."""
    call_id, entry_ms, entry_price, trade_ms, price, rugged, told, _ = state
    shown = 0.0 if rugged else price
    change = -100.0 if rugged else (price / entry_price - 1) * 100 if price is not None and entry_price else None
    row = pd.DataFrame({"call_id": [call_id], "token": [token], "checked_ms": [now_ms], "trade_ms": pd.array([trade_ms], "Int64"), "latest_price": [shown], "return_pct": [change], "rugged": [rugged], "changed": [shown is not None and shown != told]})
    return row, (call_id, entry_ms, entry_price, trade_ms, price, rugged, shown if shown is not None else told, now_ms)


def latest_prices(rows: DataFrame, young: int = YOUNG, often: int = OFTEN, seldom: int = SELDOM) -> DataFrame:
    """A row of each token's first call whenever its check is due, with the last price seen by then.

    rows: token, kind (call, price, rug), call_id, ms (event time), seq, price. Checks go by processing time: a call is
    checked when it arrives and after each cadence. New rows don't put a check off, since its moment is kept in the
    state. Tokens without a call keep their last price and have no timer.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        known = tuple(state.get) if state.exists else None
        if not state.hasTimedOut:
            known = take_in(known, pd.concat(frames))
        if known[0] is not None:
            if known[-1] is None or now >= known[-1]:
                row, known = told_of(key[0], known, now)
                known = (*known[:-1], now + cadence(now, known[1], known[5], young, often, seldom))
                yield row
            state.update(known)
            state.setTimeoutDuration(max(1, known[-1] - now))
        else:
            state.update(known)

    named = rows.where("token is not null").select(F.lower("token").alias("token"), "kind", F.col("call_id").cast("long").alias("call_id"), F.col("ms").cast("long").alias("ms"), F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price"))
    return named.groupBy("token").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
