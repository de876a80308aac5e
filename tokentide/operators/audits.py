"""Reports on the state of the tables: counts, conflicts, stale and stuck rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def horizon_status(results: DataFrame) -> DataFrame:
    return results.groupBy("horizon", "status").agg(F.count(F.lit(1)).alias("n"))


def later_calls(rows: DataFrame) -> DataFrame:
    """Calls of each state: how many aren't the first of their token, and how many of these have results all the same."""
    n = F.row_number().over(Window.partitionBy("token").orderBy("message_date", "call_id"))
    later = rows.where("not (post_kind <=> 'update')").withColumn("later", n > 1)
    return later.groupBy("tracking_status").agg(F.count(F.lit(1)).alias("n"), F.count_if("later").alias("later"), F.count_if(F.col("later") & F.col("ret_late_7d").isNotNull()).alias("later_with_result"))


def rug_conflicts(rows: DataFrame) -> DataFrame:
    """Rugged calls that still show a 30-day result above -90 %, by kind of rug."""
    return rows.where("rugged").groupBy("rug_kind").agg(F.count(F.lit(1)).alias("rugged"), F.count_if(F.col("ret_late_30d") > -90).alias("conflicts"))


def dead_by_week(rows: DataFrame, dead: int, name: str) -> DataFrame:
    """Dead calls of each Monday week, of all and of exchanges with `name` in their name."""
    week = F.date_format(F.date_trunc("week", F.col("message_date")), "yyyy-MM-dd")
    mine, is_dead = F.coalesce(F.lower(F.col("dex")).contains(name), F.lit(False)), F.col("trades_24h") < dead
    known = rows.where(F.col("trades_24h").isNotNull())
    return known.groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_dead).alias("dead"), F.count_if(mine).alias("n_named"), F.count_if(mine & is_dead).alias("dead_named"))


def names(rows: DataFrame, name: str, time: str) -> DataFrame:
    """Posted names with their number and first and last time."""
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def stale_timing(rows: DataFrame) -> DataFrame:
    """Timed calls whose figures can't all hold, by what is wrong first."""
    first, held, fall = F.col("first_2x_s"), F.col("above_2x_s"), F.col("fall_below_2x_s")
    why = F.when(first.isNull() & (held > 0), "held without a touch").when(first.isNull() & fall.isNotNull(), "fall without a touch").when(fall < first, "fall before the touch").when(F.col("censored") & fall.isNotNull(), "censored with a fall")
    return rows.select(why.alias("problem")).where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def given_up(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows by state whose note says that a look-up was given up."""
    return rows.groupBy("tracking_status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(text).rlike(pattern)).alias("given_up"))


def stuck(calls: DataFrame, answers: DataFrame, before: Column) -> DataFrame:
    """Calls of an earlier time that no answer refers to."""
    return calls.where(before).join(answers.where("call_id is not null").select("call_id").distinct(), "call_id", "left_anti").select("call_id", "token")


def state_audit(rows: DataFrame, state: str, field: str, limits: tuple[int, int]) -> DataFrame:
    """Rows by what a number in their JSON state says: missing, low, middle or high."""
    v = F.get_json_object(state, f"$.{field}").try_cast("long")
    kind = F.when(v.isNull(), "missing").when(v < limits[0], "low").when(v < limits[1], "middle").otherwise("high")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))


def feed_pairs(pairs: DataFrame, ticker: str, asset: str, good: Column) -> DataFrame:
    """Pairs with the number of assets of their ticker, and whether any pair of the ticker is good."""
    per = pairs.groupBy(ticker).agg(F.count_distinct(asset).alias("assets"), F.max(F.coalesce(good, F.lit(False))).alias("any_good"))
    return pairs.select(asset, ticker, F.coalesce(good, F.lit(False)).alias("good")).join(per, ticker)
