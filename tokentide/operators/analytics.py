"""Groups, bands, survival curves and exit rules over call results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.functions.expressions import BANDS, band, outcome
from tokentide.functions.ranks import running


def group_stats(rows: DataFrame, keys: list, value: str = "return_pct") -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("with_data"), F.count_if(v > 0).alias("wins"), F.count_if(v <= -50).alias("collapses"), F.count_if(v >= 50).alias("runners"),
        F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"),
    )


def _split(parts: int, neg: int, pos: int, neg_values: int, pos_values: int) -> tuple[int, int]:
    """Groups that the negative and the positive values get: by their counts, one at least, no more than distinct values."""
    if not neg or not pos:
        return (parts if neg else 0, parts if pos else 0)
    total = max(2, parts)
    below = min(total - 1, max(1, math.floor(total * neg / (neg + pos) + 0.5)))
    above = total - below
    if below > neg_values:
        above, below = above + below - neg_values, neg_values
    if above > pos_values:
        below, above = min(neg_values, below + above - pos_values), pos_values
    return below, above


def equal_count_groups(rows: DataFrame, column: str, k: int, own_zero: float = 0.1) -> DataFrame:
    """low, high, n and zero of groups of about equal counts: equal values stay together.

    A group ends at the value that holds the place ceil(g n / k), for each g. Where zeros are at least `own_zero` of the
    values they are a group of their own, and the negative and the positive values are cut apart, by their counts, into
    the other k - 1. Values that are no numbers don't count. Bounds come from the counts of distinct values, summed up slice by slice.
    """
    v = F.col(column).cast("double")
    counts = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy((v + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    size = lambda test: [F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)), F.count_if(test)]
    about = counts.agg(*[c.alias(a + b) for a, t in (("neg", F.col("v") < 0), ("zero", F.col("v") == 0), ("pos", F.col("v") > 0)) for c, b in zip(size(t), ("", "_values"), strict=True)]).first()
    n = about["neg"] + about["zero"] + about["pos"]
    apart = about["zero"] > 0 and about["zero"] >= own_zero * n
    below, above = _split(max(1, k - 1), about["neg"], about["pos"], about["neg_values"], about["pos_values"]) if apart else (0, 0)
    side = F.signum("v").cast("int") if apart else F.lit(2)
    parts = F.when(F.col("side") < 0, below).when(F.col("side") == 1, above).when(F.col("side") == 2, max(1, k)).otherwise(1)
    placed = running(counts.withColumn("side", side), "v", ["n"], ["side"])
    # ends before a value, of those g n / k: as many as its group's number
    group = F.floor((F.col("n_upto") - F.col("n")) * parts / F.col("n_all"))
    return placed.groupBy("side", group.alias("g")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n")).select("low", "high", "n", (F.col("side") == 0).alias("zero"))


def group_of(rows: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """rows with group: the place (from 0) of the group that their value belongs to, -1 for none.

    Values outside every group go to the nearest one on their side of zero; zero, and values of a side without a group,
    to the zero group where there is one. groups: at most a few, as `equal_count_groups` makes them.
    """
    known = groups.orderBy("low").collect()  # at most k + 1 rows
    v = F.col(column).cast("double")
    zero = next((k for k, g in enumerate(known) if g["zero"]), None)

    def among(places: list[int]) -> Column:
        found = F.lit(places[-1])
        for k in reversed(places[:-1]):
            found = F.when(v <= known[k]["high"], k).otherwise(found)
        return found

    if not known:
        place = F.lit(-1)
    elif zero is None:
        place = among(list(range(len(known))))
    else:
        left, right = list(range(zero)), list(range(zero + 1, len(known)))
        place = F.when((v < 0) & F.lit(bool(left)), among(left or [zero])).when((v > 0) & F.lit(bool(right)), among(right or [zero])).otherwise(zero)
    return rows.withColumn("group", F.when(v.isNull() | F.isnan(v), -1).otherwise(place))


def histogram(rows: DataFrame, value: str = "return_pct") -> DataFrame:
    """Rows of each return band, empty bands too."""
    spark = rows.sparkSession
    counts = rows.where(F.col(value).isNotNull()).groupBy(band(F.col(value)).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    bands = spark.range(len(BANDS) + 1).select(F.col("id").cast("int").alias("band"))
    return bands.join(counts, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


def outcome_mix(rows: DataFrame, keys: list, value: Column, rugged: Column) -> DataFrame:
    return rows.groupBy(*keys, outcome(value, rugged).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def heat(rows: DataFrame, time: str, value: str) -> DataFrame:
    """Weekday (Monday 0) x hour grid."""
    return rows.groupBy(F.weekday(time).alias("weekday"), F.hour(time).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))


def cumulative_pl(rows: DataFrame, time: str, key: str, value: str, cap: float, stake: float = 100.0) -> DataFrame:
    """Profit of a stake on each call, summed up in order of time: sums within a day, plus the days before."""
    gain = F.least(F.col(value), F.lit(cap)) * stake / 100
    day = F.col(time).cast("date")
    rows = rows.where(F.col(value).isNotNull()).select(key, time, day.alias("day"), gain.alias("gain"))
    days = rows.groupBy("day").agg(F.sum("gain").alias("d"))
    days = days.select("day", (F.sum("d").over(Window.partitionBy(F.lit(0)).orderBy("day")) - F.col("d")).alias("before"))
    within = F.sum("gain").over(Window.partitionBy("day").orderBy(time, key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within", within).join(days, "day").select(key, F.round(F.col("before") + F.col("within"), 4).alias("total"))


def exit_rules(rows: DataFrame, peak: str, value: str, multiples: tuple[float, ...] = (1.5, 2.0, 3.0, 5.0)) -> DataFrame:
    """Selling at a multiple: the multiple's gain where the peak reached it, else the result at the end."""
    rule = F.explode(F.array(*map(F.lit, multiples))).alias("multiple")
    got = F.when(F.col(peak) >= (F.col("multiple") - 1) * 100, (F.col("multiple") - 1) * 100).otherwise(F.col(value))
    rows = rows.where(F.col(peak).isNotNull() & F.col(value).isNotNull()).select(peak, value, rule)
    return rows.groupBy("multiple").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(peak) >= (F.col("multiple") - 1) * 100).alias("hits"), F.round(F.avg(got), 6).alias("mean"), F.round(F.median(got), 6).alias("median"))


def kaplan_meier(items: DataFrame, t: str, event: str, keys: list[str] | None = None) -> DataFrame:
    """Survival after each time with an event; items censored at that time are still at risk."""
    keys = keys or []
    at = items.groupBy(*keys, t).agg(F.count_if(F.col(event)).alias("events"), F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    at = at.withColumn("at_risk", F.sum("n").over(part.orderBy(F.desc(t))))
    step = F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk")))
    ended = F.max(F.when(F.col("events") == F.col("at_risk"), 1).otherwise(0)).over(part.orderBy(t))
    survival = F.when(ended == 1, F.lit(0.0)).otherwise(F.exp(F.sum(step).over(part.orderBy(t))))
    return at.withColumn("survival", F.round(survival, 6)).where("events > 0").select(*keys, t, "events", "at_risk", "survival")


def top_n_other(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, the rest as Other, nulls as Not given."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    place = F.row_number().over(Window.partitionBy(F.col(column).isNull()).orderBy(F.desc("c"), column))
    name = F.when(F.col(column).isNull(), "Not given").when(place <= n, F.col(column)).otherwise("Other")
    return counts.withColumn("value", name).groupBy("value").agg(F.sum("c").alias("n"))
