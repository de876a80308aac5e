"""Labels, wallet reputation, time splits and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.functions.expressions import EXTREME, net_pct, wilson
from tokentide.functions.ranks import running


def labels(returns: DataFrame, horizon: str = "7d") -> DataFrame:
    """Net return, runner (at least +50 % net) and collapse (at most -70 %) of the 7-day bucket; null where the result is
    missing or extreme. `labels.build_labels` has all four buckets and the rules of use.
    """
    rows = returns.where(F.col("horizon") == horizon)
    usable = F.col("return_pct").isNotNull() & ~F.isnan("return_pct") & (F.col("return_pct") <= EXTREME)
    net = F.when(usable, net_pct(F.col("return_pct"), F.col("tax_pct"), F.col("tax_pct")))
    return rows.select("call_id", usable.alias("usable"), F.round(net, 6).alias("net_pct"), (net >= 50).cast("int").alias("runner"), (net <= -70).cast("int").alias("collapse"))


def wallet_key(prefix: Column, suffix: Column) -> Column:
    """The shown ends of a wallet's address in lower case; null if one is missing."""
    return F.when((F.coalesce(prefix, F.lit("")) != "") & (F.coalesce(suffix, F.lit("")) != ""), F.concat(F.lower(prefix), F.lower(suffix)))


def wallet_history(buys: DataFrame, calls: DataFrame, outcomes: DataFrame, delay_us: int, back_us: int | None = None) -> DataFrame:
    """For each (call, wallet): earlier calls of the wallet whose outcome was known strictly before, and how many ran.

    Other calls of the same token don't count; with `back_us` only outcomes known in that time before do. One union, two
    windows over the moment an outcome became known.
    """
    t = F.unix_micros(F.col("message_date").cast("timestamp"))
    pairs = buys.select("call_id", "wallet").distinct().join(calls.select("call_id", "token", t.alias("t")), "call_id")
    known = pairs.join(outcomes.where("runner is not null").select("call_id", "runner"), "call_id")
    rows = pairs.select("call_id", "wallet", "token", F.col("t").alias("at"), F.lit(None).cast("int").alias("runner")).unionByName(known.select(F.lit(None).cast("long").alias("call_id"), "wallet", "token", (F.col("t") + delay_us).alias("at"), "runner"))
    start = Window.unboundedPreceding if back_us is None else -back_us
    before = lambda *keys: Window.partitionBy(*keys).orderBy("at").rangeBetween(start, -1)
    n = F.count("runner").over(before("wallet")) - F.count("runner").over(before("wallet", "token"))
    ran = F.coalesce(F.sum("runner").over(before("wallet")), F.lit(0)) - F.coalesce(F.sum("runner").over(before("wallet", "token")), F.lit(0))
    return rows.select("call_id", "wallet", n.alias("n"), ran.alias("ran")).where("call_id is not null")


def wallet_coverage(history: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls of each Monday week, those with a wallet of known history, and the mean number of such wallets."""
    per = history.groupBy("call_id").agg(F.count_if(F.col("n") > 0).alias("known"))
    week = F.date_format(F.date_trunc("week", F.col("message_date")), "yyyy-MM-dd")
    return calls.join(per, "call_id").groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("known") > 0).alias("covered"), F.round(F.avg("known"), 6).alias("mean_known"))


def wallet_features(history: DataFrame, base_rate: float = 0.2, weight: float = 5.0) -> DataFrame:
    """Per call: wallets, those with history, mean and best smoothed share of runners."""
    share = (F.col("ran") + base_rate * weight) / (F.col("n") + weight)
    return history.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("wallets"), F.count_if(F.col("n") > 0).alias("known_wallets"), F.round(F.avg(share), 6).alias("mean_share"), F.round(F.max(share), 6).alias("best_share")
    )


def time_split(rows: DataFrame, time: str, key: str, token: str, embargo_us: int, shares: tuple[float, float] = (0.7, 0.85)) -> DataFrame:
    """Part of each row by time: train, valid, test; tokens and the embargo before a boundary are kept apart.

    Boundaries are exact ranks, found from counts per day and the rank within one day. A row belongs to the part of its
    token's first row, and is dropped if that isn't its own or if its outcome reaches over the boundary.
    """
    t = F.unix_micros(F.col(time).cast("timestamp"))
    r = rows.select(key, token, t.alias("t"))
    day = F.floor(F.col("t") / 86_400_000_000)
    days = r.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("day")
    days = days.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    # the day that holds each boundary rank, then the rank inside that day
    cuts = [F.floor(F.col("all") * s).cast("long") for s in shares]
    at = days.select("day", "before", F.explode(F.array(*[F.when((F.col("before") <= c) & (c < F.col("before") + F.col("n")), F.struct(F.lit(i).alias("i"), c.alias("rank"))) for i, c in enumerate(cuts)])).alias("c")).where("c is not null").select("day", "before", "c.i", "c.rank")
    inside = r.withColumn("day", day).join(F.broadcast(at), "day")  # two rows
    placed = inside.withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("day", "i").orderBy("t", key)) - 1).where("place = rank")
    bounds = placed.agg(*[F.max(F.when(F.col("i") == i, F.col("t"))).alias(f"b{i}") for i in range(2)])
    part = lambda c: F.when(F.col(c) < F.col("b0"), "train").when(F.col(c) < F.col("b1"), "valid").otherwise("test")
    first = r.groupBy(token).agg(F.min("t").alias("first_t"))
    joined = r.join(first, token).crossJoin(F.broadcast(bounds))  # one row
    own, group = part("t"), part("first_t")
    reaches = ((own == "train") & (F.col("t") + embargo_us >= F.col("b0"))) | ((own == "valid") & (F.col("t") + embargo_us >= F.col("b1")))
    cause = F.when(own != group, "token").when(reaches, "embargo")
    return joined.select(key, F.when(cause.isNull(), own).alias("part"), cause.alias("dropped"))


def _per_score(scored: DataFrame, y: str, s: str, by: list[str]) -> DataFrame:
    """pos and n of each distinct score."""
    return scored.where(F.col(y).isNotNull() & F.col(s).isNotNull()).groupBy(*by, s).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))


def auc(scored: DataFrame, y: str, s: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve with ties at one half, from counts per distinct score; null with one class only."""
    by = by or []
    counts = _per_score(scored, y, s, by).withColumn("neg", F.col("n") - F.col("pos"))
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    sums = running(counts, s, ["neg"], by).groupBy(*by).agg(F.sum(wins).alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sums.select(*by, "pos", "neg", F.round(F.try_divide("wins", F.col("pos") * F.col("neg")), 6).alias("auc"))


def average_precision(scored: DataFrame, y: str, s: str, by: list[str] | None = None) -> DataFrame:
    """Area under the precision-recall steps over distinct scores, highest first."""
    by = by or []
    steps = running(_per_score(scored, y, s, by), s, ["pos", "n"], by, down=True).withColumn("p", F.col("pos_upto") / F.col("n_upto"))
    return steps.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("pos")), F.sum("pos")), 6).alias("average_precision"))


def top_rows(scored: DataFrame, s: str, key: str, share: float, by: list[str] | None = None) -> DataFrame:
    """scored with `top`: among the ceil(share x n) highest scores of its group (at least one row; ties by key).

    The score of the last place is found from counts per score; only the rows that tie with it are ordered.
    """
    by = by or []
    rows = scored.where(F.col(s).isNotNull())
    counts = running(rows.groupBy(*by, s).agg(F.count(F.lit(1)).alias("n")), s, ["n"], by, down=True)
    k = F.greatest(F.lit(1), F.ceil(F.col("n_all") * share))
    edge = counts.where((F.col("n_upto") >= k) & (F.col("n_upto") - F.col("n") < k)).select(*[F.col(c).alias(f"_e{c}") for c in by], F.col(s).alias("_edge"), (k - F.col("n_upto") + F.col("n")).alias("_need"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_e{c}"))
    met = rows.join(edge, same) if by else rows.crossJoin(F.broadcast(edge))  # one row a group
    # rows that don't tie with the edge are dealt by key: their place isn't asked for
    tie = F.col(s) == F.col("_edge")
    place = F.row_number().over(Window.partitionBy(*by, tie, F.when(~tie, F.xxhash64(key))).orderBy(key))
    return met.withColumn("top", (F.col(s) > F.col("_edge")) | (tie & (place <= F.col("_need")))).select(*scored.columns, "top")


def top_share(scored: DataFrame, y: str, s: str, key: str, share: float) -> DataFrame:
    """Hits among the ceil(share x n) highest scores (ties by key), the lift over all rows, and the interval of the share."""
    rows = top_rows(scored.where(F.col(y).isNotNull()), s, key, share)
    one = F.col(y).cast("long")
    out = rows.agg(F.count_if("top").alias("k"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("top"), one)).alias("hits"), F.sum(one).alias("all_pos"))
    low, high = wilson(F.col("hits"), F.col("k"))
    lift = F.try_divide(F.col("hits") / F.col("k"), F.col("all_pos") / F.col("n"))
    return out.where("n > 0").select("k", "n", "hits", F.round(lift, 6).alias("lift"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks of ties, from counts per value."""
    def ranked(d: DataFrame, c: str) -> DataFrame:
        n = running(d.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), c, ["_n"])
        return d.join(n.select(c, (F.col("_n_upto") - (F.col("_n") - 1) / 2).alias(f"_r{c}")), c)

    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return ranked(ranked(rows, a), b).agg(F.round(F.corr(f"_r{a}", f"_r{b}"), 6).alias("spearman"), F.count(F.lit(1)).alias("n"))


def week_sums(rows: DataFrame, time: str, y: Column, top: Column) -> DataFrame:
    return rows.groupBy(F.date_format(F.date_trunc("week", F.col(time)), "yyyy-MM-dd").alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y.cast("long")).alias("pos"), F.count_if(top).alias("top_n"), F.sum(F.when(top, y.cast("long")).otherwise(0)).alias("top_pos")
    )


def bootstrap_lift(weeks: DataFrame, reps: int = 500, seed: int = 7) -> DataFrame:
    """Percentile interval of the pooled lift over draws of whole weeks; draws without a defined lift are dropped."""
    indexed = weeks.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("week")) - 1)
    n = weeks.agg(F.count(F.lit(1)).alias("m"))
    draws = weeks.sparkSession.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(n))  # one row
    draws = draws.select("rep", F.explode(F.expr("sequence(1, m)")).alias("k"), "m").where("m > 0").select("rep", F.pmod(F.xxhash64(F.lit(seed), "rep", "k"), F.col("m")).cast("int").alias("i"))
    sums = draws.join(indexed, "i").groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "top_n", "top_pos")])
    lift = F.try_divide(F.try_divide(F.col("top_pos"), F.col("top_n")), F.try_divide(F.col("pos"), F.col("n")))
    return sums.select(lift.alias("lift")).where("lift is not null").agg(F.percentile("lift", 0.025).alias("low"), F.percentile("lift", 0.5).alias("middle"), F.percentile("lift", 0.975).alias("high"), F.count(F.lit(1)).alias("reps"))


def calibration(scored: DataFrame, y: str, s: str, key: str) -> DataFrame:
    """Ten groups by score with linear rank cuts, ties by key."""
    rows = scored.where(F.col(y).isNotNull() & F.col(s).isNotNull()).select(key, y, s)
    counts = running(rows.groupBy(s).agg(F.count(F.lit(1)).alias("c")), s, ["c"])
    r = rows.withColumn("in", F.row_number().over(Window.partitionBy(s).orderBy(key))).join(counts, s).withColumn("r", F.col("c_upto") - F.col("c") + F.col("in"))
    group = F.when(F.col("c_all") > 1, F.greatest(F.lit(1), F.ceil((F.col("r") - 1) * 10 / (F.col("c_all") - 1)))).otherwise(1)
    return r.groupBy(group.cast("int").alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("mean_score"), F.round(F.avg(F.col(y).cast("double")), 6).alias("rate"))
