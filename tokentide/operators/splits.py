"""Splits of rows by time that leak neither outcomes nor tokens, as columns and intervals: rows are never copied per fold or week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.functions.ranks import running

DAY_US = 86_400_000_000
WEEK_US = 7 * DAY_US


def _timed(rows: DataFrame, time: str, key: str, token: str) -> DataFrame:
    """key, token, t and the first t of the token, in microseconds; a row without a token is a token of its own."""
    r = rows.where(F.col(time).isNotNull()).select(key, F.lower(F.col(token).cast("string")).alias("_token"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"))
    first = r.where("_token is not null").groupBy(F.col("_token").alias("_k")).agg(F.min("t").alias("_first"))
    return r.join(first, F.col("_token") == F.col("_k"), "left").select(key, "_token", "t", F.coalesce("_first", "t").alias("first_t"))


def _moment(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def forward_split(rows: DataFrame, time: str, key: str, token: str, horizon_days: float, test_days: float = 14) -> DataFrame:
    """key, part (train, test) and dropped (embargo, token): the test part begins at a midnight, `test_days` before the newest row."""
    r = _timed(rows, time, key, token)
    bound = r.agg(((F.floor((F.max("t") - int(test_days * DAY_US)) / DAY_US)) * DAY_US).cast("long").alias("t_test"))
    j = r.crossJoin(F.broadcast(bound)).withColumn("cut", F.col("t_test") - int(horizon_days * DAY_US))  # one row
    zone = F.when(F.col("t") < F.col("cut"), "train").when(F.col("t") >= F.col("t_test"), "test")
    kept = ((F.col("first_t") < F.col("cut")) & (F.col("t") < F.col("cut"))) | (F.col("first_t") >= F.col("t_test"))
    return j.select(key, F.when(kept, zone).alias("part"), F.when(zone.isNull(), "embargo").when(~kept, "token").alias("dropped"))


def at_ranks(values: DataFrame, value: str, ranks: list[Column]) -> DataFrame:
    """One row with v0, v1, ...: the values at the places (from 0) that `ranks` gives in terms of n_all, the number of rows."""
    counts = running(values.groupBy(value).agg(F.count(F.lit(1)).alias("n")), value, ["n"])
    hit = [F.max(F.when((F.col("n_upto") - F.col("n") <= r) & (r < F.col("n_upto")), F.col(value))).alias(f"v{i}") for i, r in enumerate(ranks)]
    return counts.agg(*hit)


def purged_folds(rows: DataFrame, time: str, key: str, token: str, horizon_days: float, k: int = 5) -> DataFrame:
    """key, fold (1 to k, contiguous in time, equal moments together) and fit: the folds whose fit part holds the row.

    A fit row lies more than a horizon before the first or behind the last row of the fold, and no row of the fold has
    its token.
    """
    r = _timed(rows, time, key, token)
    bounds = at_ranks(r, "t", [F.least(F.floor(F.lit(i) * F.col("n_all") / k), F.col("n_all") - 1) for i in range(k)])
    fold = F.lit(0)
    for i in range(k):
        fold = fold + (F.col("t") >= F.col(f"v{i}")).cast("int")
    placed = r.crossJoin(F.broadcast(bounds)).withColumn("fold", fold).select(key, "_token", "t", "fold")  # one row
    ends = placed.groupBy("fold").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    ends = ends.agg(F.collect_list(F.struct("fold", "lo", "hi")).alias("ends"))  # k entries
    tokens = placed.where("_token is not null").groupBy(F.col("_token").alias("_k")).agg(F.collect_set("fold").alias("held"))
    gap = int(horizon_days * DAY_US)
    joined = placed.join(tokens, F.col("_token") == F.col("_k"), "left").crossJoin(F.broadcast(ends))
    free = F.filter("ends", lambda e: ((F.col("t") < e["lo"] - gap) | (F.col("t") > e["hi"] + gap)) & ~F.coalesce(F.array_contains("held", e["fold"]), F.lit(False)))
    return joined.select(key, "fold", F.array_sort(F.transform(free, lambda e: e["fold"])).alias("fit"))


def walk_forward(rows: DataFrame, time: str, key: str, token: str, horizon_days: float, train_weeks: float | None = None) -> DataFrame:
    """key, train_from, train_to and test_week: the weeks (2, 3, ...) in whose training part a row is, and the one it tests.

    Weeks count from the first row's midnight. A week trains on rows a horizon and more before it, of tokens first seen
    before it; with `train_weeks` only on that many weeks. train_to is the last week of all where nothing else ends it.
    """
    r = _timed(rows, time, key, token)
    ends = r.agg((F.floor(F.min("t") / DAY_US) * DAY_US).cast("long").alias("_start"), F.max("t").alias("_end"))
    gap = int(horizon_days * DAY_US)
    j = r.crossJoin(F.broadcast(ends)).withColumn("_last", F.floor((F.col("_end") - F.col("_start")) / WEEK_US) + 1)  # one row
    week = lambda t: F.floor((t - F.col("_start")) / WEEK_US) + 1
    begins = week(F.col("t") + gap) + 1
    stops = F.least(F.col("_last"), week(F.col("t") + gap + int(train_weeks * WEEK_US))) if train_weeks is not None else F.col("_last")
    tests = F.when((week(F.col("t")) >= 2) & (week(F.col("first_t")) >= week(F.col("t"))), week(F.col("t")))
    trains = begins <= stops
    return j.select(key, F.when(trains, begins).alias("train_from"), F.when(trains, stops).alias("train_to"), tests.alias("test_week"))


def week_sizes(placed: DataFrame) -> DataFrame:
    """week, n_train and n_test of walk_forward's weeks, from counts of its intervals."""
    steps = placed.where("train_from is not null").select(F.explode(F.array(F.struct(F.col("train_from").alias("week"), F.lit(1).alias("d")), F.struct((F.col("train_to") + 1).alias("week"), F.lit(-1).alias("d")))).alias("x")).select("x.*")
    steps = steps.groupBy("week").agg(F.sum("d").alias("d")).select("week", F.sum("d").over(Window.partitionBy(F.lit(0)).orderBy("week")).alias("n_train"))  # a row a week
    tests = placed.where("test_week is not null").groupBy(F.col("test_week").alias("week")).agg(F.count(F.lit(1)).alias("n_test"))
    both = steps.join(tests, "week", "full_outer").withColumn("n_train", F.coalesce("n_train", F.last("n_train", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("week")), F.lit(0)))
    return both.where("n_test is not null").select("week", "n_train", "n_test")


def share_split(rows: DataFrame, time: str, key: str, share: float, embargo_us: int) -> DataFrame:
    """key and part: the newest `share` of the rows (rounded; ties by key) test, earlier ones train, or are embargoed before the first test row."""
    r = rows.select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("t"))
    counts = running(r.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "t", ["n"])
    n_test = F.round(F.lit(share) * F.col("n_all")).cast("long")
    first = F.col("n_all") - n_test  # place of the first test row
    edge = counts.where((F.col("n_upto") - F.col("n") <= first) & (first < F.col("n_upto"))).select(F.col("t").alias("_edge"), (first - F.col("n_upto") + F.col("n")).alias("_skip"))
    j = r.join(F.broadcast(edge), F.lit(True), "left")  # one row, none without a test part
    tie = F.col("t") == F.col("_edge")
    place = F.row_number().over(Window.partitionBy(tie, F.when(~F.coalesce(tie, F.lit(False)), F.xxhash64(key))).orderBy(key)) - 1
    test = F.coalesce((F.col("t") > F.col("_edge")) | (tie & (place >= F.col("_skip"))), F.lit(False))
    return j.select(key, F.when(test, "test").when(F.col("t") >= F.col("_edge") - embargo_us, "embargoed").otherwise("train").alias("part"))


def maturity(rows: DataFrame, time: str, usable: Column, bucket: Column, least_rows: int, least_days: float) -> DataFrame:
    """Rows and days that each bucket's usable rows span, and whether that is enough to judge."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    found = rows.where(usable).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round((F.max(t) - F.min(t)) / DAY_US, 6).alias("span_days"))
    return found.withColumn("enough", (F.col("n") >= least_rows) & (F.col("span_days") >= least_days))


def pre_test_rows(rows: DataFrame, time: str, low: Column, high: Column, test: Column) -> DataFrame:
    """Rows a fixed cut-off may be taken from: after the training rows, before the test part, and no test row."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    return rows.where((t >= low) & (t < high) & ~F.coalesce(test, F.lit(False)))
