"""When and how a token's pool was found empty, and model scores attached to calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of the entry price under which a price counts as a rug; places of the kinds, the lowest stays.
RUG_SHARE = 0.05
KINDS = ("at_call", "event", "detected", "price")


def rug_kind(rug: Column, entry: Column, scanned: Column, latest: Column) -> Column:
    """at_call up to the entry block, event up to a block that a scan passed, else detected; null without a rug."""
    return F.when(rug <= entry, "at_call").when((rug <= scanned) | (rug <= latest), "event").when(rug.isNotNull(), "detected")


def merge_rugs(rows: DataFrame, key: str) -> DataFrame:
    """One rug (key, rug_at, rug_kind, written) per key: the last written, but `price` never replaces a drained kind."""
    place = F.struct((F.col("rug_kind") != "price").alias("drained"), "written", "rug_at", "rug_kind")
    return rows.where("rug_at is not null").groupBy(key).agg(F.max(place).alias("r")).select(key, "r.rug_at", "r.rug_kind")


def price_rug_at(entries: DataFrame, results: DataFrame, candles: DataFrame) -> DataFrame:
    """call_id, rug_s and rug_source of calls with a done horizon, where the rug is known by price only.

    In order: the end of the first hourly candle that closed under RUG_SHARE of the entry price, at most the last done
    horizon's due time; the earliest done horizon with such a price; the last done horizon's due time.
    entries: call_id, entry_price; results: call_id, due_s, price of done horizons; candles: call_id, bucket_s, close.
    """
    low = F.col("entry_price") * RUG_SHARE
    done = results.join(entries.select("call_id", "entry_price"), "call_id").groupBy("call_id", "entry_price").agg(F.max("due_s").alias("last_due"), F.min(F.when(F.col("price") < low, F.col("due_s"))).alias("of_horizon"))
    under = candles.where("interval_s = 3600").select("call_id", "bucket_s", "close").join(done.select("call_id", "entry_price", "last_due"), "call_id")
    of_candle = under.where((F.col("bucket_s") < F.col("last_due")) & (F.col("close") < low)).groupBy("call_id").agg((F.min("bucket_s") + 3600).alias("of_candle"))
    source = F.when(F.col("of_candle").isNotNull(), "candle").when(F.col("of_horizon").isNotNull(), "horizon").otherwise("last_due")
    at = F.coalesce(F.least("of_candle", F.when(F.col("of_candle").isNotNull(), F.col("last_due"))), "of_horizon", "last_due")
    return done.join(of_candle, "call_id", "left").select("call_id", at.alias("rug_s"), source.alias("rug_source"))


def final_rug(price: Column, entry: Column, quote_side: Column, least_usd: float) -> Column:
    """At the end of tracking: a price under RUG_SHARE of the entry price, an empty quote side or one under the threshold."""
    return F.coalesce(price < entry * RUG_SHARE, F.lit(False)) | F.coalesce((quote_side == 0) | (quote_side < least_usd), F.lit(False))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def attach_scores(calls: DataFrame, scores: DataFrame, buckets: list[str], within_us: int = 86400 * 1_000_000) -> DataFrame:
    """calls (call_id, call_t) with version, scored_t and one column of scores per bucket.

    Only scores stored within a day of the call count. The earliest fixes the version; of one bucket the latest score of
    that version counts; numbers that aren't finite are null; calls with none of the buckets get nulls only.
    """
    timely = scores.join(calls.select("call_id", "call_t"), "call_id").where(F.col("scored_t") - F.col("call_t") <= within_us)
    first = timely.groupBy("call_id").agg(F.min(F.struct("scored_t", "score_id", "version")).alias("f")).select("call_id", F.col("f.version").alias("version"), F.col("f.scored_t").alias("first_t"))
    of_version = timely.drop("call_t").join(first, ["call_id", "version"])
    last = lambda b: F.max_by(finite(F.col("score")), F.when(F.col("bucket") == b, F.struct("scored_t", "score_id"))).alias(f"score_{b}")
    wide = of_version.where(F.col("bucket").isin(buckets)).groupBy("call_id", "version", "first_t").agg(*map(last, buckets))
    return calls.join(wide.withColumnRenamed("first_t", "scored_t"), "call_id", "left")


def model_live(scores: DataFrame, calls: DataFrame) -> DataFrame:
    """Versions with their number of calls and scores and the median seconds from call to score, most used first in `place`."""
    joined = scores.join(calls.select("call_id", "call_t"), "call_id")
    by = joined.groupBy("version").agg(F.countDistinct("call_id").alias("n_calls"), F.count(F.lit(1)).alias("n_scores"), F.round(F.expr("percentile((scored_t - call_t) / 1e6, 0.5)"), 3).alias("median_s"))
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_calls"), "version")))  # one row per version
