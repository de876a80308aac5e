"""Prices and extremes around a call's entry, pools by activity, launches, transfer logs, deliveries and display rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.operators.asof import as_of
from tokentide.operators.candles import S
from tokentide.plans.domain import HORIZONS


def late_entry(trades: DataFrame, calls: DataFrame, delay_s: int = 60) -> DataFrame:
    """calls with late_t, `delay_s` after entry, and late_price: the last price at or before it (null: none)."""
    late = calls.withColumn("late_t", F.col("entry_t") + F.lit(delay_s * S).cast("long"))
    return as_of(late, trades, "token", "late_t", "t", ["price"], "seq").withColumnRenamed("price", "late_price")


def extremes(trades: DataFrame, calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Highest and lowest USD price of each call and horizon since entry and since late entry.

    Each price counts at the rate of its own hour (rates: hour, rate); zero and hours without a rate count as none. Rates
    meet trades before calls do, so that a trade is priced once.
    """
    usd = trades.withColumn("hour", F.floor(F.col("t") / (3600 * S))).join(rates, "hour").withColumn("usd", F.nullif(F.col("price") * F.col("rate"), F.lit(0.0)))
    joined = calls.join(usd.select("token", "t", "usd"), "token").where(f"usd is not null and t > entry_t and t <= entry_t + {max(HORIZONS.values()) * S}")
    rows = []
    aggs = []
    for h, s in HORIZONS.items():
        inside = F.col("t") <= F.col("entry_t") + s * S
        late = inside & (F.col("t") > F.col("late_t"))
        names = {f"high_{h}": F.max(F.when(inside, F.col("usd"))), f"low_{h}": F.min(F.when(inside, F.col("usd"))), f"late_high_{h}": F.max(F.when(late, F.col("usd"))), f"late_low_{h}": F.min(F.when(late, F.col("usd")))}
        aggs += [a.alias(n) for n, a in names.items()]
        rows.append(F.struct(F.lit(h).alias("horizon"), *[F.col(n).alias(n.removesuffix(f"_{h}")) for n in names]))
    found = joined.groupBy("call_id").agg(*aggs)
    return found.select("call_id", F.explode(F.array(*rows)).alias("x")).select("call_id", "x.*").where("high is not null")


def price_via_pools(requests: DataFrame, trades: DataFrame, time: str) -> DataFrame:
    """requests with pool and price_usd of the pool traded last at or before their time; of pools traded at the same
    time the one quoted in the chain's own coin wins. trades: token, t, seq, pool, price, native, quote_usd."""
    ordered = trades.withColumn("_order", F.struct("native", "seq")).withColumn("price_usd", F.col("price") * F.col("quote_usd"))
    return as_of(requests, ordered, "token", time, "t", ["pool", "price_usd"], "_order")


def rank_pools(pool_txs: DataFrame, token_txs: DataFrame) -> DataFrame:
    """token, pool, n_txs and rank: pools by the number of the token's transactions that they take part in; ties by pool."""
    met = token_txs.select("token", "tx").distinct().join(pool_txs.select("pool", "tx").distinct(), "tx")
    counted = met.groupBy("token", "pool").agg(F.count(F.lit(1)).alias("n_txs"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("n_txs"), "pool")))


def launch(mints: DataFrame, txs: DataFrame, first_block: int) -> DataFrame:
    """token, launch_block and deployer: the first mint and the sender of its transaction; capped marks launches that the
    look-back from `first_block` may have cut off."""
    first = mints.where(F.col("block") >= first_block).groupBy("token").agg(F.min(F.struct("block", "log_index", "tx")).alias("m"))
    named = first.select("token", F.col("m.block").alias("launch_block"), F.col("m.tx").alias("tx"))
    return named.join(txs.select("tx", F.col("sender").alias("deployer")), "tx", "left").select("token", "launch_block", "deployer", (F.col("launch_block") == first_block).alias("capped"))


def decode_transfers(logs: DataFrame) -> DataFrame:
    """logs(topics, data) with valid, sender, receiver and amount (a 32-byte word in hex).

    Valid: three topics, both addresses padded with zeros to 32 bytes, one word of data; else the rest is null.
    """
    padded = r"^0x0{24}[0-9a-fA-F]{40}$"
    topic = lambda n: F.try_element_at("topics", F.lit(n))
    valid = F.coalesce((F.size("topics") == 3) & topic(2).rlike(padded) & topic(3).rlike(padded) & F.col("data").rlike(r"^0x[0-9a-fA-F]{64}$"), F.lit(False))
    party = lambda n: F.when(F.col("valid"), F.concat(F.lit("0x"), F.lower(F.substring(topic(n), 27, 40))))
    rows = logs.withColumn("valid", valid)
    return rows.select("*", party(2).alias("sender"), party(3).alias("receiver"), F.when(F.col("valid"), F.lower(F.substring("data", 3, 64))).alias("amount"))


def first_delivery(deliveries: DataFrame, key: str, at: list[str]) -> DataFrame:
    """First sent delivery of each key, in the order of `at`."""
    return deliveries.where("sent").groupBy(key).agg(F.min(F.struct(*at)).alias("_d")).select(key, "_d.*")


def kind_stats(requests: DataFrame, kind: str, time: str, since: Column) -> DataFrame:
    """Requests since a moment, and the newest request, of each kind."""
    return requests.groupBy(kind).agg(F.count_if(F.col(time) >= since).alias("n_since"), F.max(time).alias("newest"))


def next_check(calls: DataFrame, done: DataFrame) -> DataFrame:
    """call_id and next_s: the second at which the first horizon that is not done falls due (null: all are done)."""
    seen = done.groupBy("call_id").agg(F.collect_set("horizon").alias("_done"))
    due = [F.when(~F.coalesce(F.array_contains("_done", h), F.lit(False)), F.col("entry_s") + s) for h, s in HORIZONS.items()]
    return calls.join(seen, "call_id", "left").select("call_id", F.least(*due).alias("next_s"))


def display_rules(rows: DataFrame) -> DataFrame:
    """What a list may show: numbers only in USD and finite, no peak of a drained pool (unless the rug is a fall in price),
    and a latest price only with its time. Columns: currency, peak, latest, latest_at, rug_kind."""
    shown = lambda c, ok: F.when((F.col("currency") == "USD") & ok & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    ok_peak = F.col("rug_kind").isNull() | (F.col("rug_kind") == "price")
    return rows.withColumns({"peak": shown("peak", ok_peak), "latest": shown("latest", F.col("latest_at").isNotNull())})
