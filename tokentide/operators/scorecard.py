"""From scored rows to metrics and verdicts, for each bucket, seed or week at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.functions.expressions import ratio, wilson
from tokentide.operators import evaluation, resampling

#: Share bought by runner score, share skipped by collapse score, cap of a return, least lift and caught share.
TOP_SHARE, SKIP_SHARE, RETURN_CAP = 0.10, 0.30, 1000.0
LEAST_LIFT, LEAST_REMOVED = 2.0, 0.40
#: Fixed value: training rows below which a walk-forward week doesn't count.
LEAST_TRAIN = 1000


def model_metrics(scored: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """n, base rate, ROC AUC, average precision and Brier score of each group; ranks are null with one class only."""
    basic = scored.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(y).cast("double")), 6).alias("base_rate"), F.round(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))), 6).alias("brier"), F.sum(F.col(y).cast("long")).alias("_pos")
    )
    ranks = evaluation.auc(scored, y, p, by).select(*by, F.col("auc").alias("roc_auc"))
    steps = evaluation.average_precision(scored, y, p, by)
    both = (F.col("_pos") > 0) & (F.col("_pos") < F.col("n"))
    return basic.join(ranks, by, "left").join(steps, by, "left").select(*by, "n", "base_rate", "roc_auc", F.when(both, F.col("average_precision")).alias("pr_auc"), "brier")


def trading_metrics(scored: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Lift of the top tenth by runner score with its interval, collapses removed by skipping, and capped mean returns.

    scored: runner, collapse, runner_score, collapse_score, net_ret.
    """
    top = evaluation.top_rows(scored, "runner_score", key, TOP_SHARE, by)
    ret = F.least(F.col("net_ret"), F.lit(RETURN_CAP))
    y = F.col("runner").cast("long")
    sums = top.groupBy(*by).agg(
        F.count_if("top").alias("top_n"), F.count(F.lit(1)).alias("all_n"), F.sum(F.when(F.col("top"), y).otherwise(0)).alias("top_pos"), F.sum(y).alias("all_pos"),
        F.round(F.avg(F.when(F.col("top"), ret)), 6).alias("sim_top_mean"), F.round(F.avg(ret), 6).alias("sim_all_mean"),
    )
    base = ratio(F.col("all_pos"), F.col("all_n"))
    low, high = wilson(F.col("top_pos"), F.col("top_n"))
    rates = {"top_lift": F.try_divide(F.col("top_pos") / F.col("top_n"), F.nullif(base, F.lit(0.0))), "top_lift_lo": F.try_divide(F.greatest(low, F.lit(0.0)), F.nullif(base, F.lit(0.0))), "top_lift_hi": F.try_divide(F.least(high, F.lit(1.0)), F.nullif(base, F.lit(0.0)))}
    skipped = evaluation.top_rows(scored, "collapse_score", key, SKIP_SHARE, by)
    c = F.col("collapse").cast("long")
    removed = skipped.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.when(F.col("top"), c).otherwise(0)), F.nullif(F.sum(c), F.lit(0))), 6).alias("collapse_removed"))
    return sums.join(removed, by).select(*by, "top_pos", "top_n", "all_pos", "all_n", *[F.round(v, 6).alias(k) for k, v in rates.items()], "collapse_removed", "sim_top_mean", "sim_all_mean", (F.col("sim_top_mean") > F.col("sim_all_mean")).alias("sim_beats_all"))


def filter_sums(rows: DataFrame, flag: Column, by: list[str], weight: Column | None = None) -> DataFrame:
    """Counts and capped returns of all and of flagged rows, weighted if asked."""
    w = F.lit(1) if weight is None else weight
    ret = F.least(F.col("net_ret"), F.lit(RETURN_CAP))
    f = F.coalesce(flag, F.lit(False))
    sums = []
    for name, v in (("n", F.lit(1)), ("coll", F.coalesce("collapse", F.lit(0))), ("run", F.coalesce("runner", F.lit(0))), ("ret", ret)):
        sums += [F.sum(v * w).alias(f"{name}_all"), F.sum(F.when(f, v * w).otherwise(0)).alias(f"{name}_flag")]
    return rows.groupBy(*by).agg(*sums)


def filter_rates(sums: DataFrame, by: list[str]) -> DataFrame:
    """The ten rates of a filter that skips the flagged rows; null where nothing is below the line."""
    c = F.col
    r = lambda a, b: F.try_divide(a, F.when(b > 0, b))
    kept = {k: c(f"{k}_all") - c(f"{k}_flag") for k in ("n", "coll", "run", "ret")}
    all_mean, kept_mean = r(c("ret_all"), c("n_all")), r(kept["ret"], kept["n"])
    rates = {
        "flagged_share": r(c("n_flag"), c("n_all")), "collapses_caught": r(c("coll_flag"), c("coll_all")), "collapse_rate_flagged": r(c("coll_flag"), c("n_flag")), "collapse_rate_kept": r(kept["coll"], kept["n"]),
        "runners_lost": r(c("run_flag"), c("run_all")), "runner_rate_flagged": r(c("run_flag"), c("n_flag")), "runner_rate_kept": r(kept["run"], kept["n"]), "all_mean": all_mean, "kept_mean": kept_mean, "kept_minus_all": kept_mean - all_mean,
    }
    return sums.select(*by, *[F.round(v, 6).alias(k) for k, v in rates.items()])


def cutoff(rows: DataFrame, score: str, by: list[str], share: float = SKIP_SHARE) -> DataFrame:
    """The fixed cut-off that about `share` of the rows reach: an exact quantile."""
    return rows.where(F.col(score).isNotNull()).groupBy(*by).agg(F.percentile(score, 1 - share).alias("cutoff"), F.count(F.lit(1)).alias("n_cutoff"))


def top_stats(scored: DataFrame, y: str, s: str, key: str, by: list[str], shares: tuple[float, ...] = (0.10, 0.30)) -> DataFrame:
    """For each share of highest scores: precision and lift with intervals, and the share of positives caught."""
    out = None
    one = F.col(y).cast("long")
    for share in shares:
        sums = evaluation.top_rows(scored.where(F.col(y).isNotNull()), s, key, share, by).groupBy(*by).agg(F.count_if("top").alias("n_top"), F.sum(F.when(F.col("top"), one).otherwise(0)).alias("hits"), F.sum(one).alias("pos"), F.count(F.lit(1)).alias("n"))
        low, high = wilson(F.col("hits"), F.col("n_top"))
        base = F.nullif(F.col("pos") / F.col("n"), F.lit(0.0))
        precision = F.col("hits") / F.col("n_top")
        found = sums.select(*by, F.lit(share).alias("share"), "n_top", "hits", *[F.round(v, 6).alias(k) for k, v in {"precision": precision, "low": low, "high": high, "lift": precision / base, "lift_low": low / base, "lift_high": high / base, "caught": F.try_divide(F.col("hits"), F.nullif(F.col("pos"), F.lit(0)))}.items()])
        out = found if out is None else out.unionByName(found)
    return out


def gates(metrics: DataFrame, weeks: DataFrame, by: list[str]) -> DataFrame:
    """Single-run verdict of each group: lift, collapses removed, and every counted week beating buy-everything.

    weeks: n_train, sim_beats_all (null where the week was skipped). Missing figures never pass; reasons names each gate that fails.
    """
    ran = F.col("sim_beats_all").isNotNull()
    counted = ran & (F.col("n_train") >= LEAST_TRAIN)
    per = weeks.groupBy(*by).agg(F.count_if(counted).alias("windows_evaluated"), F.count_if(counted & F.col("sim_beats_all")).alias("windows_beating"), F.count_if(ran & ~counted).alias("windows_not_counted"))
    j = metrics.join(per, by, "left").fillna(0, ["windows_evaluated", "windows_beating", "windows_not_counted"])
    ok = {"lift": F.coalesce(F.col("top_lift") >= LEAST_LIFT, F.lit(False)), "collapse": F.coalesce(F.col("collapse_removed") >= LEAST_REMOVED, F.lit(False)), "walk_forward": (F.col("windows_evaluated") > 0) & (F.col("windows_beating") == F.col("windows_evaluated"))}
    reasons = F.array_compact(F.array(*[F.when(~v, k) for k, v in ok.items()]))
    return j.select(*by, *[v.alias(f"{k}_ok") for k, v in ok.items()], "windows_evaluated", "windows_beating", "windows_not_counted", (F.size(reasons) == 0).alias("passed"), F.concat_ws(",", reasons).alias("reasons"))


def seed_median(values: DataFrame, value: str, by: list[str], seeds: int) -> DataFrame:
    """Median, least and most over the seeds; null unless each of them has a value."""
    found = values.groupBy(*by).agg(F.count(value).alias("n_seeds"), F.median(value).alias("_m"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    whole = F.col("n_seeds") == seeds
    return found.select(*by, "n_seeds", *[F.round(F.when(whole, F.col(c)), 6).alias(n) for c, n in (("_m", "median"), ("_lo", "low"), ("_hi", "high"))])


def reference_quantiles(scores: DataFrame, score: str, by: list[str], n: int = 101) -> DataFrame:
    """n evenly spaced exact quantiles of the scores: what a rank is read from."""
    return scores.groupBy(*by).agg(F.percentile(score, F.array(*[F.lit(i / (n - 1)) for i in range(n)])).alias("reference"))


def rank_percent(score: Column, reference: Column) -> Column:
    """Percentile of a score among reference quantiles, ties in the middle."""
    below, upto = F.size(F.filter(reference, lambda q: q < score)), F.size(F.filter(reference, lambda q: q <= score))
    return F.when(score.isNotNull(), 100.0 * (below + upto) / (2 * F.size(reference)))


#: Fixed values of the pooled verdicts: weeks needed, and what the lower ends of the intervals must exceed.
LEAST_WEEKS, LIFT_LOWER, GAIN_LOWER = 2, 1.0, 0.0
CAUGHT_LOWER, KEPT_LOWER = 0.30, 0.0
#: What a week hands on: everything that the pooled figures need.
WEEK_SUMS = ["top_pos", "top_n", "all_pos", "all_n", "ret_top", "ret_all", "coll_all", "flag_n", "coll_flag", "run_flag", "ret_flag"]


def week_sums(scored: DataFrame, key: str, by: list[str], week: str) -> DataFrame:
    """Sums of each group and week, ranked within it: the top tenth by runner score, and the share skipped by collapse score."""
    top = evaluation.top_rows(scored, "runner_score", key, TOP_SHARE, [*by, week]).withColumnRenamed("top", "_bought")
    rows = evaluation.top_rows(top, "collapse_score", key, SKIP_SHARE, [*by, week]).withColumnRenamed("top", "_skipped")
    c = F.col
    ret = F.least(c("net_ret"), F.lit(RETURN_CAP))
    run, coll = F.coalesce(c("runner").cast("long"), F.lit(0)), F.coalesce(c("collapse").cast("long"), F.lit(0))
    when = lambda flag, v: F.sum(F.when(c(flag), v).otherwise(0))
    return rows.groupBy(*by, week).agg(
        when("_bought", run).alias("top_pos"), F.count_if("_bought").alias("top_n"), F.sum(run).alias("all_pos"), F.count(F.lit(1)).alias("all_n"), when("_bought", ret).alias("ret_top"), F.sum(ret).alias("ret_all"),
        F.sum(coll).alias("coll_all"), F.count_if("_skipped").alias("flag_n"), when("_skipped", coll).alias("coll_flag"), when("_skipped", run).alias("run_flag"), when("_skipped", ret).alias("ret_flag"),
    )


def pooled_stats() -> dict[str, Column]:
    """Lift, gain over buying everything, and the filter's rates, from pooled sums; null where nothing is below the line."""
    c = F.col
    r = lambda a, b: F.try_divide(a, F.when(b > 0, b))
    top, every = r(c("ret_top"), c("top_n")), r(c("ret_all"), c("all_n"))
    kept = r(c("ret_all") - c("ret_flag"), c("all_n") - c("flag_n"))
    return {"lift": r(r(c("top_pos"), c("top_n")), r(c("all_pos"), c("all_n"))), "sim_gain": top - every, "sim_top_mean": top, "sim_all_mean": every, "collapses_caught": r(c("coll_flag"), c("coll_all")), "runners_lost": r(c("run_flag"), c("all_pos")), "kept_minus_all": kept - every}


def pooled(weeks: DataFrame, by: list[str], week: str = "week", reps: int = resampling.REPS) -> DataFrame:
    """Pooled figures of the weeks of each group, with intervals over drawn weeks (null with fewer than two), and the number of weeks."""
    counted = weeks.groupBy(*by).agg(F.count(F.lit(1)).alias("weeks"))
    stats = resampling.drawn_stats(resampling.drawn_blocks(weeks, by, week, WEEK_SUMS, reps), by, pooled_stats())
    rows = stats.join(counted, by)
    ends = [c for c in stats.columns if c.endswith(("_lo", "_hi"))]
    return rows.withColumns({c: F.when(F.col("weeks") >= 2, F.col(c)) for c in ends})


def _reasons(rules: dict[str, tuple[Column, Column]]) -> Column:
    """Of each rule (holds, its value): its name where it fails, with `undefined` where there is no value."""
    said = [F.when(~F.coalesce(ok, F.lit(False)), F.when(value.isNull(), f"{name} undefined").otherwise(name)) for name, (ok, value) in rules.items()]
    return F.concat_ws("; ", F.array_compact(F.array(*said)))


def pooled_gates(figures: DataFrame, seed_lifts: DataFrame, test: DataFrame, by: list[str], seeds: int) -> DataFrame:
    """Verdict of each group from the pooled weeks: all four rules must hold, and what is missing never passes.

    figures: `pooled` of the saved seed. seed_lifts: the pooled lift of each seed; their median must reach LEAST_LIFT and
    every one of `seeds` be there. test: collapse_removed of the test part. The lower ends of lift and gain must lie above
    one and zero. Groups without counted weeks fail. sim_top_mean is for information.
    """
    median = seed_median(seed_lifts, "lift", by, seeds).select(*by, F.col("n_seeds").alias("seeds_defined"), F.col("median").alias("median_lift"))
    j = test.select(*by, "collapse_removed").join(figures, by, "left").join(median, by, "left").withColumn("weeks", F.coalesce("weeks", F.lit(0)))
    c, enough = F.col, F.col("weeks") >= LEAST_WEEKS
    ok = {"pooled_lift": (enough & (c("median_lift") >= LEAST_LIFT), c("median_lift")), "pooled_lift_lower": (enough & (c("lift_lo") > LIFT_LOWER), c("lift_lo")), "sim_diff": (enough & (c("sim_gain_lo") > GAIN_LOWER), c("sim_gain_lo")), "collapse": (c("collapse_removed") >= LEAST_REMOVED, c("collapse_removed"))}
    few = F.when(~enough, F.lit("too few weeks"))
    reasons = F.concat_ws("; ", few, F.nullif(_reasons(ok), F.lit("")))
    numbers = ["median_lift", "lift", "lift_lo", "lift_hi", "sim_gain", "sim_gain_lo", "sim_gain_hi", "sim_top_mean", "collapse_removed"]
    flags = {k: F.coalesce(v[0], F.lit(False)) for k, v in ok.items()}
    passed = flags["pooled_lift"] & flags["pooled_lift_lower"] & flags["sim_diff"] & flags["collapse"]
    return j.select(*by, "weeks", F.coalesce("seeds_defined", F.lit(0)).alias("seeds_defined"), *[F.round(n, 6).alias(n) for n in numbers], *[v.alias(f"{k}_ok") for k, v in flags.items()], passed.alias("passed"), reasons.alias("reasons"))


def filter_verdict(figures: DataFrame, by: list[str], applies: Column) -> DataFrame:
    """Whether skipping beats skipping at random on the pooled weeks: both lower ends defined and above their limits, where the filter applies."""
    c, enough = F.col, F.col("weeks") >= LEAST_WEEKS
    ok = {"collapses caught": (enough & (c("collapses_caught_lo") > CAUGHT_LOWER), c("collapses_caught_lo")), "kept minus all": (enough & (c("kept_minus_all_lo") > KEPT_LOWER), c("kept_minus_all_lo"))}
    caught, kept = (F.coalesce(v[0], F.lit(False)) for v in ok.values())
    reasons = F.concat_ws("; ", F.when(~applies, "not a filter bucket"), F.when(~enough, "too few weeks"), F.nullif(_reasons(ok), F.lit("")))
    return figures.select(*by, "weeks", applies.alias("applies"), F.round("collapses_caught_lo", 6).alias("caught_lo"), caught.alias("caught_ok"), F.round("kept_minus_all_lo", 6).alias("kept_minus_all_lo"), kept.alias("kept_ok"), (applies & caught & kept).alias("validated"), reasons.alias("reasons"))
