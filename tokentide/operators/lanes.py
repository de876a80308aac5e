"""Next states of tracked rows, what to queue or scan again, and audits of stored outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First wait after an error, the longest one, failures after which a call isn't scanned again.
FIRST_WAIT_S, LONGEST_WAIT_S, FAILED_LIMIT = 900, 6 * 3600, 2
OPEN = ("pending", "tracking", "no_pool", "error", "gave_up")
#: A return in percent above which an outcome is impossible.
IMPOSSIBLE = 1e5


def backoff(attempts: Column) -> Column:
    """Seconds to wait: doubled with each attempt after the first, six hours at most."""
    doublings = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(20))
    return F.least(F.lit(FIRST_WAIT_S) * F.pow(F.lit(2.0), doublings), F.lit(float(LONGEST_WAIT_S))).cast("long")


def give_up(attempts: Column, past_deadline: Column, progressed: Column, most: int) -> Column:
    return F.lit(most > 0) & (attempts >= most) & past_deadline & ~progressed


def mark_repeats(tracked: DataFrame, calls: DataFrame, firsts: DataFrame) -> DataFrame:
    """tracked (call_id, status, attempts) with the next status, and attempts begun anew where a call is revived.

    Open calls that aren't first, and unfinished updates, become repeats; first calls marked as repeats are pending again.
    """
    joined = tracked.join(calls.select("call_id", "post_kind"), "call_id").join(firsts.select("call_id", F.lit(True).alias("_first")), "call_id", "left")
    first, status = F.coalesce("_first", F.lit(False)), F.col("status")
    changes = (~first & status.isin(*OPEN)) | ((F.col("post_kind") == "update") & ~status.isin("done", "repeat")) | (first & (status == "repeat"))
    changes = F.coalesce(changes, F.lit(False))
    revived = changes & first
    return joined.select("call_id", F.when(revived, "pending").when(changes, "repeat").otherwise(status).alias("status"), F.when(revived, 0).otherwise(F.col("attempts")).alias("attempts"), changes.alias("changed"))


def requeue(calls: DataFrame, completed: DataFrame, stuck: tuple[str, ...], since: Column) -> DataFrame:
    """Stuck calls without a completed scan of their own: whether they are recent, and whether their token has any scan."""
    open_ = calls.where(F.col("status").isin(*stuck)).join(completed.select("call_id").distinct(), "call_id", "left_anti")
    seen = completed.select(F.lower("token").alias("_token")).distinct().withColumn("_seen", F.lit(True))
    joined = open_.withColumn("_token", F.lower("token")).join(seen, "_token", "left")
    return joined.select("call_id", "token", "message_date", (F.col("message_date") >= since).alias("recent"), F.coalesce("_seen", F.lit(False)).alias("investigated"))


def requeue_plan(rows: DataFrame, n: int) -> DataFrame:
    """call_id and plan: the newest call of a token is kept, others are duplicates; the newest n of the kept go live."""
    newest = F.struct("message_date", "call_id")
    kept = rows.groupBy(F.lower("token").alias("_token")).agg(F.max(newest).alias("k")).select(F.col("k.call_id").alias("call_id"), F.col("k.message_date").alias("message_date"))
    live = kept.orderBy(F.desc("message_date"), F.desc("call_id")).limit(n).select("call_id", F.lit("live").alias("_plan"))  # a top-k
    marked = kept.select("call_id").join(F.broadcast(live), "call_id", "left").select("call_id", F.coalesce("_plan", F.lit("stored")).alias("plan"))
    return rows.select("call_id").join(marked, "call_id", "left").select("call_id", F.coalesce("plan", F.lit("duplicate")).alias("plan"))


def rescan_summary(pool: DataFrame, age_s: Column, oldest_s: int) -> DataFrame:
    """Rows per exclusion (the first that holds: too old, rugged, wiped, failed) and, of the others, per status and age."""
    reason = F.when(age_s > oldest_s, "too old").when(F.col("rugged"), "rugged").when(F.col("wiped"), "wiped").when(F.col("failed") >= FAILED_LIMIT, "failed").otherwise("candidate")
    day = 86400
    age = F.when(age_s < day, "<1d").when(age_s < 7 * day, "1-7d").when(age_s < 30 * day, "7-30d").otherwise(">30d")
    named = pool.withColumns({"reason": reason, "_age": age})
    chosen = F.col("reason") == "candidate"
    return named.groupBy("reason", F.when(chosen, F.col("status")).alias("status"), F.when(chosen, F.col("_age")).alias("age")).agg(F.count(F.lit(1)).alias("n"))


def deliver_gate(investigations: DataFrame, key: str, gates: dict[str, list[str]]) -> DataFrame:
    """Keys for which every gate tool has answered, each with an allowed level."""
    passed = [F.coalesce(F.bool_and(F.when(F.col("tool") == tool, F.coalesce(F.col("level").isin(levels), F.lit(False)))), F.lit(False)) for tool, levels in gates.items()]
    return investigations.groupBy(key).agg(reduce(Column.__and__, passed, F.lit(True)).alias("deliver"))


def impossible_outcomes(tracked: DataFrame, returns: DataFrame, group: str) -> DataFrame:
    """Calls with an impossible return, latest return or state price per group, with a TOTAL; calls without any are left out.

    tracked: call_id, group, latest_return_pct, state_price, token_dec, quote_dec. A price above 2^128 quote units a
    token unit (38 powers of ten, net of decimals) is the bound of a drained pool.
    """
    big = returns.where(F.col("return_pct") > IMPOSSIBLE).select("call_id").distinct().withColumn("ret_big", F.lit(True))
    flags = tracked.join(big, "call_id", "left").select(
        group,
        F.coalesce("ret_big", F.lit(False)).alias("ret_big"),
        F.coalesce(F.col("latest_return_pct") > IMPOSSIBLE, F.lit(False)).alias("latest_big"),
        F.coalesce((F.col("state_price") > 0) & (F.log10("state_price") - (F.col("token_dec") - F.col("quote_dec")) > 38), F.lit(False)).alias("bound_price"),
    )
    some = flags.where("ret_big or latest_big or bound_price")
    sums = some.rollup(group).agg(F.grouping(group).alias("_total"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(f"n_{c}") for c in ("ret_big", "latest_big", "bound_price")])
    return sums.select(F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col(group)).alias(group), "n", "n_ret_big", "n_latest_big", "n_bound_price")


def repair_reasons(rows: DataFrame, reasons: dict[str, Column], keys: list[str]) -> DataFrame:
    """Rows per reason (a row may have several) for each key alone and in all: one pass over grouping sets."""
    hit = rows.select(*keys, F.explode(F.array_compact(F.array(*[F.when(c, r) for r, c in reasons.items()]))).alias("reason"))
    sets = [["reason"], *[["reason", k] for k in keys]]
    sums = hit.groupingSets(sets, "reason", *keys).agg(*[F.grouping(k).alias(f"_{k}") for k in keys], F.count(F.lit(1)).alias("n"))
    return sums.select("reason", *[F.when(F.col(f"_{k}") == 0, F.coalesce(F.col(k).cast("string"), F.lit("null"))).alias(k) for k in keys], "n")


def fate(ids: DataFrame, tracked: DataFrame) -> DataFrame:
    """What became of listed calls (an array column `ids`): their number by list and status; lost ones are `missing`."""
    listed = ids.select("list", F.explode("ids").alias("call_id")).distinct()
    return listed.join(tracked.select("call_id", "status"), "call_id", "left").groupBy("list", F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def classify_rugs(rows: DataFrame) -> DataFrame:
    """Rows per class of what their rug needs; the classes exclude each other and add up to all rows.

    rows: rugged, rug_kind, has_done, has_candle, entry_price.
    """
    kind = (
        F.when(~F.coalesce("rugged", F.lit(False)), "not rugged").when(F.col("rug_kind").isin("at_call", "event", "detected"), "drained").when(F.col("rug_kind") == "price", "by price")
        .when(F.col("entry_price").isNull() | (F.col("entry_price") <= 0), "no entry price").when(~F.col("has_done"), "no done horizon").when(F.col("has_candle"), "fill from candles").otherwise("fill from horizons")
    )
    return rows.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def by_group(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, missing share, quartiles and mean of a feature in each group."""
    quartile = lambda q: F.round(F.expr(f"percentile({value}, {q})"), 6)
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(value).isNull().cast("double")), 6).alias("missing_share"),
        quartile(0.25).alias("q1"), quartile(0.5).alias("median"), quartile(0.75).alias("q3"), F.round(F.avg(value), 6).alias("mean"),
    )


def strata(rows: DataFrame, size: str, age: str, band: float) -> DataFrame:
    """rows with stratum: tercile of size (cuts are exact quantiles) x age band; null where either is missing."""
    cuts = rows.agg(F.expr(f"percentile({size}, array(1/3D, 2/3D))").alias("_cuts"))
    joined = rows.crossJoin(F.broadcast(cuts))  # one row
    tier = F.when(F.col(size) <= F.col("_cuts")[0], "T1").when(F.col(size) <= F.col("_cuts")[1], "T2").when(F.col(size).isNotNull(), "T3")
    side = F.when(F.col(age) < band, "young").when(F.col(age).isNotNull(), "old")
    return joined.withColumn("stratum", F.concat_ws(" ", F.when(side.isNotNull(), tier), F.when(tier.isNotNull(), side))).withColumn("stratum", F.nullif("stratum", F.lit(""))).drop("_cuts")


def residuals(rows: DataFrame, y: str, x: str) -> DataFrame:
    """rows with residual: y less its least-squares line over x."""
    line = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_base"))
    return rows.crossJoin(F.broadcast(line)).withColumn("residual", F.col(y) - F.col("_slope") * F.col(x) - F.col("_base")).drop("_slope", "_base")  # one row


def value_ranks(long: DataFrame, slices: int = 200) -> DataFrame:
    """feature, x and rank (the mean of tied places) of each distinct value, from (feature, x).

    Values are cut at approximate quantiles; a rank is the number of values in the slices before plus the place within.
    """
    counts = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("c"))
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = counts.groupBy("feature").agg(F.percentile_approx("x", shares).alias("cuts"))
    cut = counts.join(F.broadcast(cuts), "feature").withColumn("slice", F.size(F.filter("cuts", lambda q: q < F.col("x")))).drop("cuts")  # a row per feature
    before = cut.groupBy("feature", "slice").agg(F.sum("c").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("feature").orderBy("slice")) - F.col("n")).drop("n")  # at most `slices` rows a feature
    within = F.sum("c").over(Window.partitionBy("feature", "slice").orderBy("x"))
    placed = cut.withColumn("upto", within).join(F.broadcast(before), ["feature", "slice"])
    return placed.select("feature", "x", (F.col("before") + F.col("upto") - (F.col("c") - 1) / 2).alias("rank"))


def permuted_null(rows: DataFrame, y: str, features: list[str], block: str, key: str, reps: int, seed: int = 3) -> DataFrame:
    """The 95th percentile over `reps` of the best oriented AUC of the features when y is shuffled within blocks.

    A shuffle gives the y of the n-th row of a block, by id, to the n-th row by a hash. AUCs are
    sums of ranks of each feature, which the shuffle doesn't change.
    """
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(block).orderBy(key)))
    labels = ranked.select(block, "_n", F.col(y).alias("_y"))
    values = rows.select(block, key, *features)
    long = values.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f")).select(key, "f.*").where("x is not null")
    below = value_ranks(long)
    drawn = values.select(block, key, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("rep", block).orderBy(F.xxhash64(F.lit(seed), "rep", key), key)))
    shuffled = drawn.join(labels, [block, "_n"]).select("rep", key, "_y")
    joined = long.join(below, ["feature", "x"]).select(key, "feature", "rank").join(shuffled, key)
    sums = joined.groupBy("rep", "feature").agg(F.sum(F.when(F.col("_y") == 1, F.col("rank"))).alias("r"), F.count_if(F.col("_y") == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    auc = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    best = sums.select("rep", F.greatest(auc, 1 - auc).alias("a")).groupBy("rep").agg(F.max("a").alias("a"))
    return best.agg(F.expr("percentile(a, 0.95)").alias("null_auc"), F.count("a").alias("reps"))
