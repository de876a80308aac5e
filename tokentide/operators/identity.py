"""Calls and what was known at each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentide.plans.domain import HORIZONS

HOUR = 3600 * 1_000_000


def first_calls(calls: DataFrame) -> DataFrame:
    """The first post of each token that isn't an update; a null kind reads as a call."""
    w = Window.partitionBy(F.lower("token")).orderBy("message_date", "call_id")
    return calls.where(~F.col("post_kind").eqNullSafe("update")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def call_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("n_calls"), F.max("message_date").alias("last_call"))


def prior_calls(calls: DataFrame) -> DataFrame:
    """Earlier rows of the same address, updates too, and seconds since the last; rows of one instant don't count."""
    t = F.unix_micros(F.col("message_date").cast("timestamp"))
    w = Window.partitionBy("token").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    with_t = calls.withColumn("_t", t)
    since = (F.col("_t") - F.max("_t").over(w)) / 1e6
    return with_t.select("call_id", F.count(F.lit(1)).over(w).alias("prior_calls"), since.alias("since_prior_s"))


def busyness(rows: DataFrame, key: str, t: str, hours: tuple[int, ...] = (1, 24)) -> DataFrame:
    """Rows of the whole table in the hours before each row, [t - h, t).

    No window over all rows: rows are numbered within hours, and hour totals are summed up over the small table of
    hours. A count is then the difference of two exact positions, looked up in the hours where the bounds lie.
    """
    hour = lambda c: F.floor(F.col(c) / HOUR).cast("long")
    totals = rows.groupBy(hour(t).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_h")) - F.col("_n")).drop("_n")
    bounds = rows.select(key, F.col(t).alias("_t"), F.explode(F.array(*[F.struct(F.lit(h).alias("h"), (F.col(t) - h * HOUR).alias("at")) for h in (0, *hours)])).alias("_b"))
    bounds = bounds.select(key, F.col("_b.h").alias("h"), F.col("_b.at").alias("_at"), F.lit(0).alias("_row"))
    marks = rows.select(F.lit(None).cast("long").alias(key), F.lit(None).cast("int").alias("h"), F.col(t).alias("_at"), F.lit(1).alias("_row"))
    at = Window.partitionBy("_h").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    placed = bounds.unionByName(marks).withColumn("_h", hour("_at")).withColumn("_in", F.coalesce(F.sum("_row").over(at), F.lit(0))).where("_row = 0")
    last = Window.partitionBy(F.lit(0)).orderBy("_h").rowsBetween(0, Window.unboundedFollowing)
    known = placed.select("_h").distinct().join(before, "_h", "full_outer")
    total = totals.agg(F.sum("_n").alias("_all"))
    filled = known.crossJoin(F.broadcast(total)).select("_h", F.coalesce(F.first("_before", ignorenulls=True).over(last), F.col("_all")).alias("_before"))  # one row
    position = placed.join(filled, "_h").select(key, "h", (F.col("_before") + F.col("_in")).alias("_pos"))
    wide = position.groupBy(key).agg(*[F.max(F.when(F.col("h") == h, F.col("_pos"))).alias(f"_p{h}") for h in (0, *hours)])
    return wide.select(key, *[(F.col("_p0") - F.col(f"_p{h}")).cast("long").alias(f"rows_{h}h") for h in hours])


def live_buy_max(buys: DataFrame) -> DataFrame:
    return buys.groupBy("call_id").agg(F.max("amount_usd").alias("largest_buy_usd"))


def tier_volume(buys: DataFrame) -> DataFrame:
    amount = F.coalesce("amount_usd", F.lit(0.0))
    return buys.groupBy("call_id").agg(*[x for t in ("elite", "good") for x in (F.count_if(F.col("tier") == t).alias(f"{t}_count"), F.round(F.sum(F.when(F.col("tier") == t, amount).otherwise(0.0)), 4).alias(f"{t}_usd"))])


def pivot_measures(results: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per call: each measure of each horizon as <short name>_<horizon>, done results only."""
    cell = lambda m, h: F.max(F.when((F.col("horizon") == h) & (F.col("status") == "done"), F.col(m))).alias(f"{names[m]}_{h}")
    return results.groupBy("call_id").agg(*[cell(m, h) for m in names for h in HORIZONS])


def predictions_with_outcomes(scores: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each score that names a bucket, with the call's outcomes; scores of unknown calls are left out."""
    return scores.where("bucket is not null").join(outcomes, "call_id")


def calls_with_metrics(calls: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every call, with the figures parsed from its post where there are any."""
    return calls.join(metrics, "call_id", "left")


def pivot_returns(returns: DataFrame) -> DataFrame:
    return returns.groupBy("call_id").agg(*[F.max(F.when(F.col("horizon") == h, F.col("return_pct"))).alias(f"ret_{h}") for h in HORIZONS])


def horizon_bits(returns: DataFrame, condition) -> DataFrame:
    bit = F.lit(0)
    for i, h in enumerate(HORIZONS):
        bit = F.when(F.col("horizon") == h, 1 << i).otherwise(bit)
    return returns.groupBy("call_id").agg(F.coalesce(F.bit_or(F.when(condition, bit)), F.lit(0)).cast("long").alias("bits"))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """Codes of the values of a column, the most frequent first, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("code", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), column)) - 1)


def diff_snapshots(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Change events between two states: new, gone, and one for each column that differs (nulls compare equal)."""
    a, b = (df.select(key, *[F.col(c).alias(f"{s}_{c}") for c in columns], F.lit(True).alias(f"{s}_here")) for df, s in ((before, "a"), (after, "b")))
    joined = a.join(b, key, "full_outer")
    new = F.when(F.col("a_here").isNull(), "new").when(F.col("b_here").isNull(), "gone")
    changed = [F.when(new.isNull() & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c} changed") for c in columns]
    return joined.select(key, F.explode(F.array_compact(F.array(new, *changed))).alias("event"))


def upsert(target: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """target with updates merged in by key: an update's value where it has one, else the old value."""
    rest = [c for c in target.columns if c not in key]
    named = updates.select(*key, *[F.col(c).alias(f"_{c}") for c in rest])
    return target.join(named, key, "full_outer").select(*key, *[F.coalesce(f"_{c}", c).alias(c) for c in rest])
