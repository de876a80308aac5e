"""Balances, holders and trades from transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def movements(transfers: DataFrame) -> DataFrame:
    """Debit and credit of each transfer; within one transfer the debit comes first."""
    side = F.explode(F.array(F.struct(F.col("sender").alias("address"), (-F.col("value")).alias("delta"), F.lit(0).alias("side")), F.struct(F.col("receiver").alias("address"), F.col("value").alias("delta"), F.lit(1).alias("side")))).alias("m")
    return transfers.select("block", "idx", side).select("block", "idx", "m.*").where("address is not null")


def balances(transfers: DataFrame) -> DataFrame:
    """Balance of each address, and whether it ever went below zero in the order of blocks and log places."""
    w = Window.partitionBy("address").orderBy("block", "idx", "side")
    running = movements(transfers).withColumn("after", F.sum("delta").over(w))
    return running.groupBy("address").agg(F.sum("delta").alias("balance"), F.coalesce(F.bool_or((F.col("after") < 0) & (F.col("side") == 0)), F.lit(False)).alias("negative"))


def holder_stats(balances: DataFrame) -> DataFrame:
    """Holders, circulating amount and the shares of the largest 1, 5 and 10."""
    held = balances.where("balance > 0")
    top = held.orderBy(F.desc("balance"), "address").limit(10)
    places = top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("balance"), "address")))
    sums = places.agg(*[F.sum(F.when(F.col("place") <= n, F.col("balance"))).alias(f"t{n}") for n in (1, 5, 10)])
    total = held.agg(F.count(F.lit(1)).alias("holders"), F.sum("balance").alias("circulating"))
    return total.crossJoin(sums).select("holders", "circulating", *[F.round(F.try_divide(f"t{n}", "circulating"), 6).alias(f"top{n}_share") for n in (1, 5, 10)])  # one row each


def trade_flow(trades: DataFrame, token: str) -> DataFrame:
    """Buys, sells, distinct traders and amounts of each token from (token, trader, side, amount)."""
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    return trades.groupBy(token).agg(
        F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"),
        F.countDistinct(F.when(buy, F.col("trader"))).alias("buyers"), F.countDistinct(F.when(sell, F.col("trader"))).alias("sellers"),
        F.sum(F.when(buy, F.col("amount")).otherwise(0)).alias("bought"), F.sum(F.when(sell, F.col("amount")).otherwise(0)).alias("sold"),
    )


def snipers(buys: DataFrame, token: str, blocks: int) -> DataFrame:
    """Distinct buyers within some blocks of the first buy."""
    first = buys.groupBy(token).agg(F.min("block").alias("first_block"))
    return buys.join(first, token).where(F.col("block") <= F.col("first_block") + blocks).groupBy(token, "first_block").agg(F.countDistinct("trader").alias("snipers"))


def first_buyers(buys: DataFrame, token: str, n: int) -> DataFrame:
    """The first n distinct buyers in the order of their first buy."""
    firsts = buys.groupBy(token, "trader").agg(F.min(F.struct("block", "idx")).alias("at"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy(token).orderBy("at", "trader"))).where(F.col("place") <= n).select(token, "trader", "place")
