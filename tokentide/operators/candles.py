"""Candles, returns at fixed horizons, time to peak, pre-call activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.operators.asof import as_of
from tokentide.plans.domain import HORIZONS

S = 1_000_000  # microseconds in a second
DAY = 86400
#: Seconds that a call is followed.
LONGEST = max(HORIZONS.values())


def within(calls: DataFrame, rows: DataFrame, back: int, ahead: int, span: int = DAY) -> DataFrame:
    """calls joined to rows of their token from `back` to `ahead` seconds around the entry, by token and span (a day).

    rows has token and t; the caller cuts to the exact moments. A call is sent once to each span that it meets, so spans
    should be as long as a key's rows in one allow. By merge at every size: nothing is broadcast.
    """
    day = lambda c: F.floor(c / (span * S))
    near = calls.withColumn("_day", F.explode(F.sequence(day(F.col("entry_t") - back * S), day(F.col("entry_t") + ahead * S))))
    return near.join(rows.withColumn("_day", day(F.col("t"))).hint("merge"), ["token", "_day"]).drop("_day")


def token_candles(trades: DataFrame, interval: int, keys: list[str] | None = None) -> DataFrame:
    """OHLC candles of each token, aligned to UTC; open, close and their moments by event order."""
    at = F.struct("t", "seq")
    return trades.groupBy(*(keys or ["token"]), (F.floor(F.col("t") / (S * interval)) * interval).cast("long").alias("bucket_s")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.max(at).alias("last"), F.count(F.lit(1)).alias("events")
    )


def candles(trades: DataFrame, calls: DataFrame, ahead: int = LONGEST) -> DataFrame:
    """OHLC candles of each call: 5 minutes for its first day, hours up to `ahead` seconds; open and close by event order.

    Buckets that lie whole within a call's time are the token's candles, made once. Only those it cuts (at its entry and
    ends) are made from trades, for each call.
    """
    trades, calls = trades.select("token", "t", "seq", "price"), calls.select("call_id", "token", "entry_t")
    out = None
    for interval, length in ((300, DAY), (3600, ahead)):
        whole = within(calls, token_candles(trades, interval).withColumn("t", F.col("bucket_s") * S), 0, length, span=max(length, DAY))
        whole = whole.where((F.col("bucket_s") * S >= F.col("entry_t")) & ((F.col("bucket_s") + interval) * S <= F.col("entry_t") + length * S))
        cut = F.array_distinct(F.transform(F.array("entry_t", F.col("entry_t") + length * S), lambda t: (F.floor(t / (S * interval)) * interval).cast("long")))
        edges = calls.withColumn("bucket_s", F.explode(cut)).where(~((F.col("bucket_s") * S >= F.col("entry_t")) & ((F.col("bucket_s") + interval) * S <= F.col("entry_t") + length * S)))
        part = edges.join(trades.withColumn("bucket_s", (F.floor(F.col("t") / (S * interval)) * interval).cast("long")).hint("merge"), ["token", "bucket_s"])
        part = part.where((F.col("t") >= F.col("entry_t")) & (F.col("t") < F.col("entry_t") + length * S))
        made = token_candles(part, interval, ["call_id"])
        columns = ["call_id", F.lit(interval).alias("interval_s"), "bucket_s", "open", "high", "low", "close", "events"]
        both = whole.select(*columns).unionByName(made.select(*columns))
        out = both if out is None else out.unionByName(both)
    return out


def merge_candles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts add up, high and low widen, the first open and the last close win."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return both.groupBy("call_id", "interval_s", "bucket_s").agg(
        F.min_by("open", "_n").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "_n").alias("close"), F.sum("events").alias("events")
    )


def entry_price(trades: DataFrame, calls: DataFrame) -> DataFrame:
    """Last price at or before the call, else the first after it, and where it is from."""
    calls = calls.select("call_id", "token", "entry_t")
    prices = trades.select("token", "t", "seq", F.col("price").alias("_before"), F.col("price").alias("_after"))
    found = as_of(calls, prices, "token", "entry_t", "t", ["_before"], "seq")
    found = as_of(found, prices, "token", "entry_t", "t", ["_after"], "seq", forward=True)
    source = F.when(F.col("_before").isNotNull(), "before").when(F.col("_after").isNotNull(), "after").otherwise("none")
    return found.select("call_id", "token", "entry_t", F.coalesce("_before", "_after").alias("entry_price"), source.alias("entry_source"))


def pieces(trades: DataFrame, entries: DataFrame, start: str = "entry_t", ends: tuple[str, ...] = ()) -> DataFrame:
    """call_id, entry_t, `ends`, from_t, to_t, high, low, last (t, seq) and close of a call's time after its entry, or after `start`.

    Whole hours are the token's hourly candles; the hours in which that time begins or a horizon ends (or a moment of the
    columns `ends`) come trade by trade, so that every horizon is cut exactly. A call goes to two spans of thirty days, where
    a token has 720 hours; which hours are cut is worked out there, from the moments.
    """
    trades = trades.select("token", "t", "seq", "price")
    hour = lambda t: F.floor(t / (3600 * S)).cast("long")
    calls = entries.select("call_id", "token", "entry_t", F.col(start).alias("start_t"), *ends)
    moments = [F.col("start_t"), *[F.col("entry_t") + s * S for s in HORIZONS.values()], *map(F.col, ends)]
    is_cut = F.lit(False)
    for m in moments:
        is_cut = is_cut | F.coalesce(hour(F.col("t")) == hour(m), F.lit(False))
    hours = token_candles(trades, 3600).withColumn("t", F.col("bucket_s") * S).select("token", "t", "high", "low", "close", "last")
    inside = (F.col("t") > F.col("start_t")) & (F.col("t") <= F.col("entry_t") + LONGEST * S)
    whole = within(calls, hours, 0, LONGEST, span=LONGEST).where(inside & ~is_cut)
    cut = F.array_compact(F.array_distinct(F.array(*map(hour, moments))))
    part = calls.withColumn("hour", F.explode(cut)).join(trades.withColumn("hour", hour(F.col("t"))).hint("merge"), ["token", "hour"]).where(inside)
    piece = lambda df, end, last, high, low, close: df.select("call_id", "entry_t", *ends, F.col("t").alias("from_t"), end.alias("to_t"), last.alias("last"), F.col(high).alias("high"), F.col(low).alias("low"), F.col(close).alias("close"))
    return piece(whole, F.col("last.t"), F.col("last"), "high", "low", "close").unionByName(piece(part, F.col("t"), F.struct("t", "seq"), "price", "price", "price"))


def horizon_returns(trades: DataFrame, entries: DataFrame, now_t: int) -> DataFrame:
    """Return, peak and drawdown of each call and horizon against its entry price; pending until due, no_data without trades."""
    # one pass over a call's pieces; the horizons are conditions, not copies
    aggs = []
    for h, s in HORIZONS.items():
        inside = F.col("to_t") <= F.col("entry_t") + s * S
        aggs += [F.max_by(F.when(inside, F.col("close")), F.when(inside, F.col("last"))).alias(f"last_{h}"), F.max(F.when(inside, F.col("high"))).alias(f"high_{h}"), F.min(F.when(inside, F.col("low"))).alias(f"low_{h}")]
    seen = pieces(trades, entries).groupBy("call_id").agg(*aggs)
    # a call meets its figures in one row; its horizons are rows only behind that
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (F.col("entry_t") + F.lit(s * S).cast("long")).alias("due_t"), F.col(f"last_{h}").alias("last"), F.col(f"high_{h}").alias("high"), F.col(f"low_{h}").alias("low")) for h, s in HORIZONS.items()])).alias("x")
    rows = entries.select("call_id", "entry_t", "entry_price").join(seen.hint("merge"), "call_id", "left").select("call_id", "entry_price", each).select("call_id", "entry_price", "x.*")
    pct = lambda c: F.round((F.col(c) / F.col("entry_price") - 1) * 100, 6)
    ready = F.col("due_t") <= now_t
    status = F.when(~ready, "pending").when(F.col("last").isNull() | F.col("entry_price").isNull(), "no_data").otherwise("done")
    done = status == "done"
    return rows.select(
        "call_id", "horizon", status.alias("status"), F.when(done, pct("last")).alias("return_pct"), F.when(done, pct("high")).alias("max_gain_pct"), F.when(done, pct("low")).alias("max_drawdown_pct")
    )


def full_results(trades: DataFrame, entries: DataFrame, now_t: int) -> DataFrame:
    """Return, peak and drawdown of each call and horizon against its entry and against its late entry, with rugs.

    entries: call_id, token, entry_t, entry_price, late_t, late_price, rug_t (null: none). A rug at or before a horizon's
    end makes its price zero: returns and drawdowns of -100 %, and peaks from before the rug; trades from the rug on don't
    count. Late figures are of trades behind the late entry, and null without a late price.
    """
    c = F.col
    found = pieces(trades, entries, "entry_t", ("late_t", "rug_t"))
    aggs = []
    for h, s in HORIZONS.items():
        inside = (c("to_t") <= c("entry_t") + s * S) & (c("rug_t").isNull() | (c("to_t") < c("rug_t")))
        late = inside & (c("from_t") > c("late_t"))
        parts = {"last": F.max_by(F.when(inside, c("close")), F.when(inside, c("last"))), "high": F.max(F.when(inside, c("high"))), "low": F.min(F.when(inside, c("low"))), "late_high": F.max(F.when(late, c("high"))), "late_low": F.min(F.when(late, c("low")))}
        aggs.append(F.struct(*[v.alias(k) for k, v in parts.items()]).alias(f"h_{h}"))
    seen = found.groupBy("call_id").agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (c("entry_t") + F.lit(s * S).cast("long")).alias("due_t"), c(f"h_{h}").alias("seen")) for h, s in HORIZONS.items()])).alias("x")
    joined = entries.select("call_id", "entry_t", "entry_price", "late_price", "rug_t").join(seen.hint("merge"), "call_id", "left")
    rows = joined.select("call_id", "entry_price", "late_price", "rug_t", each).select("*", "x.horizon", "x.due_t", "x.seen.*").drop("x")
    rugged = F.coalesce(c("rug_t") <= c("due_t"), F.lit(False))
    status = F.when(c("due_t") > now_t, "pending").when(~F.coalesce(c("entry_price") > 0, F.lit(False)) | (c("last").isNull() & ~rugged), "no_data").otherwise("done")
    done = status == "done"
    pct = lambda v, of: F.when(done & (of > 0), F.round((v / of - 1) * 100, 6))
    end = F.when(rugged, 0.0).otherwise(c("last"))
    low = lambda v: F.when(rugged, 0.0).otherwise(v)
    return rows.select(
        "call_id", "horizon", status.alias("status"), F.when(done, rugged).alias("rugged"), pct(end, c("entry_price")).alias("return_pct"), pct(c("high"), c("entry_price")).alias("max_gain_pct"), pct(low(c("low")), c("entry_price")).alias("max_drawdown_pct"),
        pct(end, c("late_price")).alias("return_late_pct"), pct(c("late_high"), c("late_price")).alias("max_gain_late_pct"), pct(low(c("late_low")), c("late_price")).alias("max_drawdown_late_pct"),
    )


def horizon_timing(trades: DataFrame, entries: DataFrame, horizon: str = "7d") -> DataFrame:
    """Seconds to the peak, to the first price of twice the entry, and how long it was held; censored if still above."""
    end = HORIZONS[horizon] * S
    joined = within(entries.where("entry_price > 0"), trades.select("token", "t", "seq", "price"), 0, HORIZONS[horizon]).where(f"t > entry_t and t <= entry_t + {end}")
    w = Window.partitionBy("call_id").orderBy("t", "seq")
    steps = joined.withColumn("until", F.coalesce(F.lead("t").over(w), F.col("entry_t") + end)).withColumn("above", F.col("price") >= 2 * F.col("entry_price"))
    every = Window.partitionBy("call_id")
    first = F.min(F.when(F.col("above"), F.col("t"))).over(every)
    steps = steps.withColumn("first_t", first).withColumn("peak", F.max("price").over(every))
    after = (F.col("t") >= F.col("first_t")) & ~F.col("above")
    return steps.groupBy("call_id").agg(
        F.min(F.when(F.col("price") == F.col("peak"), (F.col("t") - F.col("entry_t")) / S)).alias("peak_after_s"),
        F.min((F.col("first_t") - F.col("entry_t")) / S).alias("first_2x_after_s"),
        F.coalesce(F.sum(F.when(F.col("above"), (F.col("until") - F.col("t")) / S)), F.lit(0.0)).alias("above_2x_s"),
        F.min(F.when(after, (F.col("t") - F.col("entry_t")) / S)).alias("fall_below_2x_after_s"),
        F.max_by("above", F.struct("t", "seq")).alias("censored"),
    )


def precall(events: DataFrame, calls: DataFrame, minutes: tuple[int, ...] = (5, 15, 60)) -> DataFrame:
    """Swaps, buys, sells, volumes and price change in the minutes before a call, (entry - m, entry], from the last hour.

    The price change is against the last price at or before the window's start, or, where the hour has none, the first
    price in it. first_trade_age_s is the age of the first price in the hour. events: token, t, seq, price and side (buy,
    sell, or null for what isn't a trade), amount.
    """
    longest = max(minutes) * 60
    rows = events.where("price > 0").select("token", "t", "seq", "price", "side", "amount")
    joined = within(calls.select("call_id", "token", "entry_t"), rows, longest, 0, span=longest).withColumn("ago", F.col("entry_t") - F.col("t")).where(f"ago >= 0 and ago <= {longest * S}")
    at = F.struct("t", "seq")
    aggs = [(F.max("ago") / S).alias("first_trade_age_s"), F.max_by("price", at).alias("_last")]
    for m in minutes:
        inside = F.col("ago") < m * 60 * S
        side = lambda x: inside & (F.col("side") == x)  # noqa: B023, E731
        volume = lambda x: F.round(F.coalesce(F.sum(F.when(side(x), F.col("amount"))), F.lit(0.0)), 4)  # noqa: B023, E731
        aggs += [F.count_if(inside).alias(f"swaps_{m}m"), F.count_if(side("buy")).alias(f"buys_{m}m"), F.count_if(side("sell")).alias(f"sells_{m}m"), volume("buy").alias(f"buy_vol_{m}m"), volume("sell").alias(f"sell_vol_{m}m")]
        aggs += [F.coalesce(F.max_by(F.when(~inside, F.col("price")), F.when(~inside, at)), F.min_by("price", at)).alias(f"_ref{m}")]
    found = joined.groupBy("call_id").agg(*aggs)
    found = found.withColumns({f"price_chg_{m}m": F.round((F.col("_last") / F.col(f"_ref{m}") - 1) * 100, 6) for m in minutes})
    counts = [f"{c}_{m}m" for m in minutes for c in ("swaps", "buys", "sells", "buy_vol", "sell_vol")]
    shown = [F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    return calls.select("call_id").join(found, "call_id", "left").select("call_id", "first_trade_age_s", *shown, *[f"price_chg_{m}m" for m in minutes])


def trades_24h(five_minutes: DataFrame, calls: DataFrame, now_t: int) -> DataFrame:
    """Trades of a call's first day from its 5-minute candles; null until the day is over, 0 for none."""
    n = five_minutes.where("interval_s = 300").groupBy("call_id").agg(F.sum("events").alias("n"))
    return calls.join(n, "call_id", "left").select("call_id", F.when(F.col("entry_t") + DAY * S <= now_t, F.coalesce("n", F.lit(0))).alias("trades_24h"))


def from_arrays(rows: DataFrame, candles: str) -> DataFrame:
    """Candles of arrays [start, open, high, low, close, ...]: entries of fewer than five numbers go, the rest in order of start."""
    whole = F.array_sort(F.filter(candles, lambda c: F.size(c) >= 5))
    exploded = rows.select(*[c for c in rows.columns if c != candles], F.posexplode(whole).alias("pos", "c"))
    return exploded.select(*[c for c in rows.columns if c != candles], "pos", F.col("c")[0].cast("long").alias("bucket_s"), *[F.col("c")[i + 1].alias(n) for i, n in enumerate(("open", "high", "low", "close"))])


def scaled(hourly: DataFrame, rates: DataFrame, quote: str) -> DataFrame:
    """Prices of candles in USD, by the rate of the candle's hour; a candle without a rate goes."""
    hour = lambda c: (F.floor(F.col(c) / 3600) * 3600).cast("long")
    joined = hourly.withColumn("_hour", hour("bucket_s")).join(rates.select(F.col(quote), F.col("hour_s").alias("_hour"), "usd"), [quote, "_hour"])
    return joined.select(*[c for c in hourly.columns if c not in ("open", "high", "low", "close")], *[(F.col(c) * F.col("usd")).alias(c) for c in ("open", "high", "low", "close")])


def scaled_precall(pre: DataFrame, usd: Column) -> DataFrame:
    """Volumes in USD with their unit; where the rate is missing they stay in the quote's unit."""
    volumes = [c for c in pre.columns if "_vol_" in c]
    return pre.withColumns({**{c: F.round(F.col(c) * F.coalesce(usd, F.lit(1.0)), 4) for c in volumes}, "vol_unit": F.when(usd.isNotNull(), "usd").otherwise("quote")})


def entry_from_candles(candles: DataFrame, calls: DataFrame, period: int, stale: int) -> DataFrame:
    """Close of the candle a call falls in or the last before it, if fresh enough, else the open of the first after it, if near."""
    limit = (period + stale) * S
    rows = candles.select("token", (F.col("bucket_s") * S).alias("_bt"), F.col("bucket_s"), F.col("close").alias("_close"))
    after = candles.select("token", (F.col("bucket_s") * S).alias("_at"), F.col("bucket_s"), F.col("open").alias("_open"))
    found = as_of(calls.select("call_id", "token", "entry_t"), rows, "token", "entry_t", "_bt", ["_bt", "_close"], "bucket_s")
    found = as_of(found, after, "token", "entry_t", "_at", ["_at", "_open"], "bucket_s", strict=True, forward=True)
    whole = lambda t: F.floor(t / S) * S
    fresh = F.when((whole(F.col("entry_t")) - F.col("_bt") <= limit) & (F.col("_close") > 0), F.col("_close"))
    near = F.when((F.col("_at") - whole(F.col("entry_t")) <= limit) & (F.col("_open") > 0), F.col("_open"))
    return found.select("call_id", "token", "entry_t", F.coalesce(fresh, near).alias("entry_price"))


def horizons_from_candles(hourly: DataFrame, entries: DataFrame, now_t: int) -> DataFrame:
    """Results from a token's hourly candles: the last close before due, the highest and lowest price from the entry's hour on.

    Without a trade in the window the price is flat at the last one; no_data without any candle before due.
    """
    entry_h = F.floor(F.col("entry_t") / (3600 * S)) * 3600
    last = hourly.select("token", (F.col("bucket_s") * S).alias("_ct"), "bucket_s", F.col("close").alias("_last"))
    due = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(s).alias("s")) for h, s in HORIZONS.items()])).alias("x")
    asked = entries.select("call_id", "token", "entry_t", "entry_price", due).select("call_id", "token", "entry_t", "entry_price", "x.horizon", (F.floor(F.col("entry_t") / S) * S + F.col("x.s") * F.lit(S).cast("long")).alias("due_t"))
    ended = as_of(asked, last, "token", "due_t", "_ct", ["_last"], "bucket_s", strict=True)
    near = within(entries.select("call_id", "token", "entry_t"), hourly.select("token", "bucket_s", "high", "low").withColumn("t", F.col("bucket_s") * S), 3600, LONGEST, span=LONGEST).where(F.col("bucket_s") >= entry_h)
    aggs = []
    for h, s in HORIZONS.items():
        inside = F.col("t") < F.floor(F.col("entry_t") / S) * S + F.lit(s * S).cast("long")
        aggs += [F.max(F.when(inside, F.col("high"))).alias(f"high_{h}"), F.min(F.when(inside & (F.col("low") > 0), F.col("low"))).alias(f"low_{h}")]
    seen = near.groupBy("call_id").agg(*aggs)
    rows = seen.select("call_id", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"high_{h}").alias("high"), F.col(f"low_{h}").alias("low")) for h in HORIZONS])).alias("x")).select("call_id", "x.*")
    status = F.when(F.col("due_t") > now_t, "pending").when(F.col("_last").isNull() | ~F.coalesce(F.col("entry_price") > 0, F.lit(False)), "no_data").otherwise("done")
    pct = lambda c: F.when(status == "done", F.round((c / F.col("entry_price") - 1) * 100, 6))
    return ended.join(rows, ["call_id", "horizon"], "left").select("call_id", "horizon", status.alias("status"), pct(F.col("_last")).alias("return_pct"), pct(F.coalesce("high", "_last")).alias("max_gain_pct"), pct(F.coalesce("low", "_last")).alias("max_drawdown_pct"))


def timing_todo(results: DataFrame, timed: DataFrame) -> DataFrame:
    """Done horizons that have no timing yet."""
    return results.where("status = 'done'").select("call_id", "horizon").join(timed.select("call_id", "horizon"), ["call_id", "horizon"], "left_anti")
