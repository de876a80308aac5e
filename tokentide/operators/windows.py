"""What became of calls in a window: classes of rows, time held above twice the entry, bands, health of weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.functions.expressions import EXTREME, outcome
from tokentide.functions.ranks import running

#: Lower ends of the time bands, in seconds; seconds above twice the entry that count as having reached it.
TIME_BANDS = [0, 300, 900, 3600, 14400, 86400, 259200, 604800]
LEAST_HELD = 3600


def row_class(value: Column, due: Column, usd: Column, tracked: Column, no_data: Column) -> Column:
    """data, or the first reason why a window has none."""
    return F.when(usd & value.isNotNull(), "data").when(~due, "notDue").when(~tracked, "untracked").when(~usd, "noUsd").when(no_data, "noData").otherwise("pending")


def window_groups(rows: DataFrame, keys: list[Column], kind: Column, ret: Column, peak: Column, rugged: Column) -> DataFrame:
    """Counts of each class, and over rows with data wins, collapses, peaks of 100 % and more, rugged, outcomes, means and medians."""
    data = kind == "data"
    of = lambda c: F.when(data, c)
    classes = [F.count_if(kind == k).alias(k) for k in ("data", "notDue", "untracked", "noUsd", "noData", "pending")]
    mix = [F.count_if(data & (outcome(ret, rugged) == k)).alias(f"mix_{k}") for k in ("rugged", "collapse", "loss", "gain", "runner")]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), *classes, F.count_if(data & (ret > 0)).alias("wins"), F.count_if(data & (ret <= -50)).alias("collapses"), F.count_if(data & (peak >= 100)).alias("peak100"),
        F.count_if(data & F.coalesce(rugged, F.lit(False))).alias("rugged"), *mix, F.round(F.avg(of(ret)), 6).alias("mean_ret"), F.round(F.median(of(ret)), 6).alias("median_ret"), F.round(F.avg(of(peak)), 6).alias("mean_peak"), F.round(F.median(of(peak)), 6).alias("median_peak"),
    )


def is_extreme(columns: list[str]) -> Column:
    """Some value lies above the cap; missing ones don't."""
    return F.greatest(*[F.coalesce(F.col(c) > EXTREME, F.lit(False)) for c in columns], F.lit(False))


def gave_back(rows: DataFrame, keys: list[Column], peak: Column, ret: Column) -> DataFrame:
    """Of the rows with a peak above 0, those that ended below half of it."""
    counts = rows.where(peak.isNotNull() & ret.isNotNull() & (peak > 0)).groupBy(*keys)
    return counts.agg(F.count(F.lit(1)).alias("n"), F.count_if(ret < peak / 2).alias("k"))


def can_reach(window_s: int) -> bool:
    """Whether any call can hold twice its entry long enough in a window of this length."""
    return window_s - 1 >= LEAST_HELD


def timing(rows: DataFrame, first: str, held: str, fall: str, censored: str) -> DataFrame:
    """rows with touched, reached (held long enough), short, held_s, and hold_t and fell: an item of the survival curve.

    Where it was never touched 0 is held. A call still above at the end is censored at what it held; another fell back after
    what it held, or at its first fall if that came earlier.
    """
    t, h, f = F.col(first), F.col(held), F.col(fall)
    reached = F.coalesce(t.isNotNull() & (h >= LEAST_HELD), F.lit(False))
    still = F.coalesce(F.col(censored), F.lit(False))
    until = F.when(still | f.isNull(), h).otherwise(F.least(h, f - t))
    return rows.select(
        "*", t.isNotNull().alias("touched"), reached.alias("reached"), (t.isNotNull() & h.isNotNull() & ~reached).alias("short"), F.when(t.isNull(), 0).otherwise(h).alias("held_s"),
        F.when(reached, F.greatest(until, F.lit(0))).alias("hold_t"), F.when(reached, ~still).alias("fell"),
    )


def time_band(seconds: Column) -> Column:
    number = F.lit(-1)
    for low in TIME_BANDS:
        number = number + (seconds >= low).cast("int")
    return F.when(seconds >= 0, number)


def held_histogram(timed: DataFrame) -> DataFrame:
    """Calls by time held: category 0 (nothing held), then the time bands, split into zero, short and reached."""
    held = F.col("held_s")
    category = F.when(held == 0, 0).otherwise(time_band(held) + 1)
    counts = timed.where(held.isNotNull()).groupBy(category.alias("category")).agg(F.count_if(held == 0).alias("zero"), F.count_if(F.col("short") & (held > 0)).alias("short"), F.count_if(F.col("reached") & (held > 0)).alias("reached"))
    every = timed.sparkSession.range(len(TIME_BANDS) + 1).select(F.col("id").cast("int").alias("category"))
    return every.join(counts, "category", "left").fillna(0)


def cumulative_share(rows: DataFrame, time: str) -> DataFrame:
    """Share of all rows whose time is at most t, for each time there is; times below 0 count at 0."""
    t = F.greatest(F.col(time), F.lit(0))
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    steps = running(rows.where(F.col(time).isNotNull()).groupBy(t.alias("t")).agg(F.count(F.lit(1)).alias("c")), "t", ["c"])
    return steps.crossJoin(F.broadcast(n)).select("t", F.col("c_upto").alias("k"), F.round(F.col("c_upto") / F.col("_n"), 6).alias("share"))  # one row


def step_at(points: DataFrame, at: list[float], t: str, value: str) -> DataFrame:
    """Value of a step curve at each moment: that of the last point at or before it."""
    wanted = F.explode(F.array(*[F.lit(float(x)) for x in at])).alias("at")
    return points.select(t, value, wanted).where(F.col(t) <= F.col("at")).groupBy("at").agg(F.max_by(value, t).alias(value))


def rug_timing(kind: Column, rug_s: Column, window_s: int) -> Column:
    """Where a rug lies in respect to a window: at the call, by price or by comparison (no moment of its own), in the window, later, none."""
    return F.when(kind.isNull(), "none").when(kind.isin("at_call", "detected", "price"), kind).when(rug_s <= window_s, "in window").otherwise("later")


def week_health(rows: DataFrame, period: Column, verdict: Column, known: Column, quiet: Column, rugged: Column) -> DataFrame:
    """Calls of each period: with a verdict, with a known number of trades, quiet ones of these, rugged ones."""
    return rows.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(verdict).alias("verdicts"), F.count_if(known).alias("known"), F.count_if(known & quiet).alias("quiet"), F.count_if(rugged).alias("rugged"))


def quiet_by_family(rows: DataFrame, period: Column, family: Column, known: Column, quiet: Column) -> DataFrame:
    return rows.where(known).groupBy(period.alias("period"), family.alias("family")).agg(F.count_if(quiet).alias("k"), F.count(F.lit(1)).alias("n"))


def grid(rows: DataFrame, a: Column, b: Column, value: Column) -> DataFrame:
    """n and mean of each pair of two categories; a missing one is `Not given`."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("Not given"))
    return rows.groupBy(name(a).alias("a"), name(b).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))


def paths(rows: DataFrame, group: Column, columns: dict[str, str], same_calls: bool) -> DataFrame:
    """Mean and median of each group over the horizons; with same_calls only of rows that have all of them."""
    whole = F.lit(True)
    for c in columns.values():
        whole = whole & F.col(c).isNotNull()
    rows = rows.where(whole) if same_calls else rows
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("v")) for h, c in columns.items()])).alias("x")
    long = rows.select(group.alias("group"), cells).select("group", "x.*").where("v is not null")
    return long.groupBy("group", "horizon").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("median"))
