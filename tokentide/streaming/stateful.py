"""Streaming operators with state of their own: first-seen tokens, and the running state of each pool."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokentide.plans.domain import HORIZONS

RUNNING = "token string, n long, last_price double, high double, low double, rug_block long"


def _first_seen(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first = state.get[0] if state.exists else None
    rows = pd.concat(frames).sort_values(["message_date", "post_id"])
    if first is None:
        first = int(rows["post_id"].iloc[0])
        state.update((first,))
    yield pd.DataFrame({"post_id": rows["post_id"], "token": key[0], "first_post_id": first, "status": ["first" if p == first else "duplicate" for p in rows["post_id"]]})


def first_seen(posts: DataFrame) -> DataFrame:
    """post_id, token (lower case), first_post_id and status of each post: only a token's first one is `first`.

    posts: post_id, token, message_date. The first is the earliest of the micro-batch in which the token is first seen,
    ties by post_id; later batches are duplicates whatever their dates. Posts without a token are left out.
    """
    keyed = posts.where("token is not null").select("post_id", F.lower("token").alias("token"), "message_date")
    return keyed.groupBy("token").applyInPandasWithState(
        _first_seen, "post_id long, token string, first_post_id long, status string", "first_post_id long", "append", GroupStateTimeout.NoTimeout
    )


def _running(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, last, high, low, rug = state.get if state.exists else (0, None, None, None, None)
    if rug is None:
        rows = pd.concat(frames).sort_values(["block", "log_index"])
        gone = rows["rug"].fillna(False).to_numpy(bool)
        if gone.any():
            at = int(gone.argmax())
            rug = int(rows["block"].iloc[at])
            rows = rows.iloc[:at]
        prices = rows["price"].dropna()
        if len(prices):
            n, last = n + len(prices), float(prices.iloc[-1])
            high = max(prices.max(), prices.max() if high is None else high)
            low = min(prices.min(), prices.min() if low is None else low)
            high, low = float(high), float(low)
        state.update((n, last, high, low, rug))
    yield pd.DataFrame({"token": [key[0]], "n": [n], "last_price": [last], "high": [high], "low": [low], "rug_block": pd.array([rug], "Int64")})


def running_state(events: DataFrame) -> DataFrame:
    """After each micro-batch, the state of the tokens it names: prices so far, the last, the extremes, and the rug block.

    events: token, block, log_index, price, rug. Neither the first rug nor anything behind it counts. A token's events
    come in the order of micro-batches; within one they are sorted, so memory holds one token's events of one batch.
    """
    return events.where("token is not null").select("token", "block", "log_index", "price", "rug").groupBy("token").applyInPandasWithState(
        _running, RUNNING, "n long, last_price double, high double, low double, rug_block long", "update", GroupStateTimeout.NoTimeout
    )


def _due(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    call_id = key[0]
    if state.hasTimedOut:
        entry_ms, done = state.get
        names = list(HORIZONS)
        yield pd.DataFrame({"call_id": [call_id], "horizon": [names[done]], "due_ms": [entry_ms + HORIZONS[names[done]] * 1000]})
        done += 1
    else:
        known = state.get if state.exists else None
        first = int(pd.concat(frames)["entry_ms"].min())
        entry_ms, done = known if known is not None else (first, 0)
    if done < len(HORIZONS):
        state.update((entry_ms, done))
        due = entry_ms + list(HORIZONS.values())[done] * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    else:
        state.remove()


def due_horizons(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """call_id, horizon and its moment, as each horizon of a call comes due: a timer of event time for each call.

    calls: call_id, entry_at. A call that is posted again keeps its first entry. After its last horizon its state goes.
    """
    timed = calls.withWatermark("entry_at", late).select("call_id", "entry_at", F.unix_millis("entry_at").alias("entry_ms"))
    return timed.groupBy("call_id").applyInPandasWithState(_due, "call_id long, horizon string, due_ms long", "entry_ms long, done int", "append", GroupStateTimeout.EventTimeTimeout)
