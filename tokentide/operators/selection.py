"""Which rows are due, excluded or next, and reports on the state of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def due(rows: DataFrame, next_check: str, now: Column, order: list, limit: int) -> DataFrame:
    """The first rows that are due, in order of priority: a top-k, never a sort of all rows."""
    return rows.where(F.col(next_check) <= now).orderBy(*order).limit(limit)


def lag_percentile(rows: DataFrame, next_check: str, now_t: int, share: float = 0.95) -> DataFrame:
    """Nearest-rank percentile of overdue seconds, floored at zero."""
    late = F.greatest(F.lit(0.0), (F.lit(now_t) - F.col(next_check)) / 1e6)
    return rows.select(late.alias("late")).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY late)").alias("lag_s"), F.count(F.lit(1)).alias("n"))


def without(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def age_bucket(hours: Column) -> Column:
    return F.when(hours < 24, "under a day").when(hours < 24 * 7, "under a week").otherwise("older")


def status_rollup(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts and sums per group with subtotals; TOTAL stands for all."""
    named = [F.when(F.grouping(k) == 1, "TOTAL").otherwise(F.col(k)).alias(f"{k}_") for k in keys]
    sums = rows.rollup(*keys).agg(*named, F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total"))
    return sums.select(*[F.col(f"{k}_").alias(k) for k in keys], "n", "total")


def candle_gaps(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """Hours of a call with a trade but no hourly candle."""
    hours = trades.select("call_id", F.col("hour_s").alias("bucket_s")).distinct()
    return hours.join(candles.where("interval_s = 3600").select("call_id", "bucket_s"), ["call_id", "bucket_s"], "left_anti")


def ranked(rows: DataFrame, value: str, key: str, k: int, offset: int = 0) -> DataFrame:
    """A slice of the list by value descending, nulls last, ties by key descending."""
    return rows.orderBy(F.col(value).desc_nulls_last(), F.desc(key)).offset(offset).limit(k)
