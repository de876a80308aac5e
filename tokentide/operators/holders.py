"""Trades read off a transfer ledger: who bought and sold at venues, apart from liquidity; deployers, held shares, row states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the addresses that burn.
BURN = ("0x0000000000000000000000000000000000000000", "0x000000000000000000000000000000000000dead")


def _marked(transfers: DataFrame, side: str, known: DataFrame, name: str) -> DataFrame:
    mine = known.select(F.lower("address").alias(f"_{name}")).distinct()
    return transfers.join(mine, F.lower(F.col(side)) == F.col(f"_{name}"), "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")


def classify_trades(transfers: DataFrame, venues: DataFrame, excluded: DataFrame, liquidity: DataFrame) -> DataFrame:
    """transfers with kind (buy, sell, liquidity, none) and wallet.

    A buy goes from a venue to a wallet, a sell the other way; a wallet is neither a venue, excluded nor a burn address.
    In a transaction that takes liquidity out of (or puts it into) the venue, such a transfer is liquidity. liquidity:
    venue, tx, takes, puts.
    """
    rows = transfers
    for side, known, name in (("sender", venues, "_from_venue"), ("receiver", venues, "_to_venue"), ("sender", excluded, "_from_ex"), ("receiver", excluded, "_to_ex")):
        rows = _marked(rows, side, known, name)
    lp = liquidity.select(F.lower("venue").alias("_v"), F.lower(F.col("tx").cast("string")).alias("_tx"), "takes", "puts")
    c = F.col
    burn = lambda side: F.lower(c(side)).isin(*BURN)
    buys = c("_from_venue") & ~c("_to_venue") & ~c("_to_ex") & ~burn("receiver")
    sells = c("_to_venue") & ~c("_from_venue") & ~c("_from_ex") & ~burn("sender")
    rows = rows.withColumns({"_buy": F.coalesce((c("value") > 0) & buys, F.lit(False)), "_sell": F.coalesce((c("value") > 0) & sells, F.lit(False))})
    at = F.when(c("_buy"), F.lower(c("sender"))).when(c("_sell"), F.lower(c("receiver")))
    rows = rows.withColumn("_at", at).join(lp, (c("_at") == c("_v")) & (F.lower(c("tx").cast("string")) == c("_tx")), "left")
    lost, put = F.coalesce("takes", F.lit(False)), F.coalesce("puts", F.lit(False))
    kind = F.when(c("_buy"), F.when(lost, "liquidity").otherwise("buy")).when(c("_sell"), F.when(put, "liquidity").otherwise("sell")).otherwise("none")
    wallet = F.when(c("_buy"), F.lower(c("receiver"))).when(c("_sell"), F.lower(c("sender")))
    return rows.select(*transfers.columns, kind.alias("kind"), wallet.alias("wallet"))


def most_buyers_in_one(trades: DataFrame, token: str) -> DataFrame:
    """The most distinct buyers of a token in one transaction; without a transaction a buy doesn't count."""
    buys = trades.where("kind = 'buy' and tx is not null")
    return buys.groupBy(token, "tx").agg(F.count_distinct("wallet").alias("n")).groupBy(token).agg(F.max("n").alias("max_tx_buyers"))


def deployer_sold(trades: DataFrame, deployers: DataFrame, token: str) -> DataFrame:
    """Whether a token's deployer sent tokens to someone else that were neither burnt nor liquidity."""
    sent = trades.join(deployers.select(F.col(token).alias("_t"), F.lower("deployer").alias("deployer")), F.col(token) == F.col("_t")).where((F.lower("sender") == F.col("deployer")) & (F.col("value") > 0))
    sold = sent.where((F.lower("receiver") != F.col("deployer")) & ~F.lower("receiver").isin(*BURN) & (F.col("kind") != "liquidity")).select(token).distinct().withColumn("_sold", F.lit(True))
    return deployers.join(sold, token, "left").select(token, F.coalesce("_sold", F.lit(False)).alias("deployer_sold"))


def held_share(balances: DataFrame, wallets: DataFrame, token: str) -> DataFrame:
    """Share of a token's circulating amount (positive balances) that a set of wallets holds; null where nothing circulates."""
    mine = wallets.select(F.col(token).alias("_t"), F.col("wallet").alias("_w")).distinct()
    rows = balances.where("balance > 0").join(mine, (F.col(token) == F.col("_t")) & (F.col("address") == F.col("_w")), "left")
    return rows.groupBy(token).agg(F.round(F.try_divide(F.sum(F.when(F.col("_w").isNotNull(), F.col("balance")).otherwise(0)), F.nullif(F.sum("balance"), F.lit(0))), 6).alias("held_share"))


def token_balances(transfers: DataFrame, token: str) -> DataFrame:
    """Balance of each address of each token; burn addresses never hold."""
    moves = transfers.select(token, F.explode(F.array(F.struct(F.lower("sender").alias("address"), (-F.col("value")).alias("v")), F.struct(F.lower("receiver").alias("address"), F.col("value").alias("v")))).alias("x")).select(token, "x.*")
    return moves.where(F.col("address").isNotNull() & ~F.col("address").isin(*BURN)).groupBy(token, "address").agg(F.sum("v").alias("balance"))


def liquidity_for(events: DataFrame, venues: DataFrame, pool_ids: DataFrame) -> DataFrame:
    """Liquidity events at a token's venues; those of a shared venue (kind v4) only with one of the token's pool ids."""
    at = events.join(venues.select(F.lower("address").alias("_a")).distinct(), F.lower(F.col("venue")) == F.col("_a"), "left_semi")
    shared = at.where("kind = 'v4'").join(pool_ids.select("pool_id").distinct(), "pool_id", "left_semi")
    return at.where("kind <> 'v4' or kind is null").unionByName(shared.select(*at.columns))


def phases(rows: DataFrame, block: str, entry: Column, end: Column) -> DataFrame:
    """rows with phase: pre up to the entry block, post behind it up to the end, null later."""
    b = F.col(block)
    return rows.withColumn("phase", F.when(b <= entry, "pre").when(b <= end, "post"))


def row_status(found: Column, entry_block: Column, incomplete: Column, error: Column) -> Column:
    """State of an exported row, and why it was skipped, as `status` or `skipped:reason`."""
    return F.when(~found, "skipped:not in the list").when(entry_block.isNull(), "skipped:no entry block").when(error.isNotNull(), F.concat(F.lit("failed:"), error)).when(incomplete, "incomplete").otherwise("done")


def plan(ids: DataFrame, known: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Ids of a list that are known and not yet done, in order; at most so many where a run is limited."""
    rows = ids.join(known.select("call_id").distinct(), "call_id", "left_semi").join(done.select("call_id").distinct(), "call_id", "left_anti").select("call_id").distinct().orderBy("call_id")
    return rows.limit(most) if most is not None else rows


def features(trades: DataFrame, balances: DataFrame, token: str) -> DataFrame:
    """One row per token: flow, distinct traders, buyers of the first block, most buyers in one transaction, holders and the largest share."""
    side = lambda k: F.col("kind") == k
    first = trades.where(side("buy")).groupBy(F.col(token).alias("_f")).agg(F.min("block").alias("first_block"))
    flow = trades.join(first, F.col(token) == F.col("_f"), "left").groupBy(token).agg(
        F.count_if(side("buy")).alias("buys"), F.count_if(side("sell")).alias("sells"), F.count_if(side("liquidity")).alias("liquidity"), F.count_distinct(F.when(side("buy"), F.col("wallet"))).alias("buyers"), F.count_distinct(F.when(side("sell"), F.col("wallet"))).alias("sellers"),
        F.round(F.try_divide(F.sum(F.when(side("sell"), F.col("value"))), F.sum(F.when(side("buy"), F.col("value")))), 6).alias("sell_buy_ratio"), F.count_distinct(F.when(side("buy") & (F.col("block") == F.col("first_block")), F.col("wallet"))).alias("first_block_buyers"),
    )
    held = balances.where("balance > 0").groupBy(token).agg(F.count(F.lit(1)).alias("holders"), F.round(F.max("balance") / F.sum("balance"), 6).alias("top1_share"))
    return flow.join(most_buyers_in_one(trades, token), token, "left").join(held, token, "left")
