"""Trials of a new input: weekly windows without the pilot's rows, a confirming split, a check forward in time, and the rules.

Two arms, with and without the input, score the same test rows. Each rule has a status PASS, FAIL or n/a (its figure is
undefined); a trial passes if all rules do, fails if any does, and is not judged otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.operators import evaluation, models, resampling, scorecard

#: Rows a counted week needs to train on, to test, and tested rows of the group; counted weeks.
LEAST_TRAIN, LEAST_TEST, LEAST_GROUP, LEAST_WEEKS = 1000, 50, 5, 2
#: Rise of the drift AUC allowed, drifting inputs looked at, share of the gain that counts as drifting.
MOST_RISE, DRIFT_TOP, DRIFT_SHARE = 0.02, 3, 0.40
#: Rows of a class needed to train and to test in the check forward in time.
CLASS_TRAIN, CLASS_TEST = 30, 10


def windows(rows: DataFrame, placed: DataFrame, y: str, pilot: str, key: str, least: tuple[int, int, int] = (LEAST_TRAIN, LEAST_TEST, LEAST_GROUP)) -> DataFrame:
    """One row for each tested week: training and test rows, those of the group and of the pilot, whether it counts, and why not.

    placed: `splits.walk_forward`'s weeks of each row. Pilot rows train but are never tested. A week's training rows are a
    running sum of where they begin and end; no row is copied to its weeks.
    """
    j = rows.select(key, F.col(y).cast("int").alias("y"), F.col(pilot).alias("pilot")).join(placed, key)
    measures = {"n_train": F.lit(1), "pilot_in_train": F.col("pilot").cast("int"), "train_pos": F.col("y")}
    step = lambda week, sign: j.where("train_from is not null").groupBy(week.alias("week")).agg(*[(sign * F.sum(v)).alias(k) for k, v in measures.items()])
    tests = j.where("test_week is not null").groupBy(F.col("test_week").alias("week")).agg(F.count_if(~F.col("pilot")).alias("n_test"), F.count_if("pilot").alias("pilot_removed"), F.sum(F.when(~F.col("pilot"), F.col("y")).otherwise(0)).alias("n_group"))
    steps = step(F.col("train_from"), 1).unionByName(step(F.col("train_to") + 1, -1)).groupBy("week").agg(*[F.sum(k).alias(k) for k in measures])
    running = Window.partitionBy(F.lit(0)).orderBy("week")  # a row a week
    each = tests.join(steps, "week", "full_outer").select("week", "n_test", "pilot_removed", "n_group", *[F.coalesce(F.sum(k).over(running), F.lit(0)).alias(k) for k in measures]).where("n_test is not null")
    c = F.col
    short = [F.when(c(n) < least[k], F.concat(F.lit(f"{n} "), c(n).cast("string"), F.lit(f" < {least[k]}"))) for k, n in enumerate(("n_train", "n_test", "n_group"))]
    why = F.concat_ws("; ", *short)
    one_class = F.least(c("train_pos"), c("n_train") - c("train_pos")) < 1
    reason = F.when(why != "", why).when(one_class, "training part has one class only").otherwise("")
    return each.select("week", "n_train", "pilot_in_train", "pilot_removed", "n_test", "n_group", (reason == "").alias("counted"), reason.alias("reason"))


def confirm_split(rows: DataFrame, time: str, pilot: Column, train_end: str, test_start: str) -> DataFrame:
    """rows with part: train before train_end (the pilot too), test from test_start on without the pilot, else null."""
    t = F.col(time)
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return rows.withColumn("part", F.when(t < at(train_end), "train").when((t >= at(test_start)) & ~pilot, "test"))


def status(value: float | None, holds: bool) -> str:
    return "n/a" if value is None else "PASS" if holds else "FAIL"


def combined(parts: list[str]) -> str:
    return "FAIL" if "FAIL" in parts else "n/a" if "n/a" in parts or not parts else "PASS"


def _flags(rows: DataFrame, score: str, key: str, block: str) -> DataFrame:
    """Sums of each block, with the share skipped that scores highest in it."""
    flagged = evaluation.top_rows(rows, score, key, scorecard.SKIP_SHARE, [block])
    ret = F.least(F.col("net_ret"), F.lit(scorecard.RETURN_CAP))
    y, run = F.coalesce(F.col("y").cast("int"), F.lit(0)), F.coalesce(F.col("runner").cast("int"), F.lit(0))
    both = lambda name, v: [F.sum(v).alias(f"{name}_all"), F.sum(F.when(F.col("top"), v).otherwise(0)).alias(f"{name}_flag")]
    return flagged.groupBy(block).agg(*both("n", F.lit(1)), *both("coll", y), *both("run", run), *both("ret", ret))


SUMS = ["n_all", "n_flag", "coll_all", "coll_flag", "run_all", "run_flag", "ret_all", "ret_flag"]


def _rates() -> dict[str, Column]:
    c = F.col
    r = lambda a, b: F.try_divide(a, F.when(b > 0, b))
    return {"caught": r(c("coll_flag"), c("coll_all")), "kept_minus_all": r(c("ret_all") - c("ret_flag"), c("n_all") - c("n_flag")) - r(c("ret_all"), c("n_all"))}


def filter_intervals(rows: DataFrame, score: str, key: str, block: str, weekly: bool = True, reps: int = resampling.REPS) -> DataFrame:
    """One row: share of the group caught by skipping, and mean return kept over all, with intervals.

    Weekly: over drawn blocks, from their sums. Else over draws of rows, each weighted in all draws at once.
    """
    if weekly:
        drawn = resampling.drawn_blocks(_flags(rows, score, key, block), [], block, SUMS, reps)
    else:
        flagged = evaluation.top_rows(rows, score, key, scorecard.SKIP_SHARE, [block])
        ret = F.least(F.col("net_ret"), F.lit(scorecard.RETURN_CAP))
        parts = {"n": F.lit(1), "coll": F.col("y"), "run": F.col("runner"), "ret": ret}
        wide = flagged.select(key, *[e.alias(n) for k, v in parts.items() for n, e in ((f"{k}_all", v), (f"{k}_flag", F.when(F.col("top"), v)))])
        drawn = resampling.weighted_sums(wide, SUMS, key, reps)
    return resampling.drawn_stats(drawn, [], _rates())


def verdict(rows: DataFrame, key: str, block: str, seeds: list[int], saved: int, drift: DataFrame, feature: str, weekly: bool = True, reps: int = resampling.REPS) -> DataFrame:
    """rule, status and figures of R1 to R5 and the result, from the pooled test rows.

    rows: y, runner, net_ret, x (the input's value), pd_low and pd_high (scores with the input at its quartiles), and
    with_<seed> and without_<seed>. R1: median gain in AUC over the seeds above zero. R2: lower end of the paired
    interval of the saved seed's gain above zero. R3: skipping by the score with the input catches enough, keeps more than
    it loses, and catches no less than without. R4: the input itself points up, and so does the model's dependence on it.
    R5: drift (arm, auc, top: the most used inputs and their shares) doesn't rise, and the input isn't what drifts.
    """
    auc = lambda s: evaluation.auc(rows, "y", s).select(F.col("auc")).first()
    number = lambda r: None if r is None or r["auc"] is None else float(r["auc"])
    gains = []
    for s in seeds:
        a, b = number(auc(f"with_{s}")), number(auc(f"without_{s}"))
        gains.append(None if a is None or b is None else round(a - b, 6))
    median = sorted(gains)[len(gains) // 2] if gains and None not in gains and len(gains) % 2 else None
    if gains and None not in gains and len(gains) % 2 == 0:
        median = sum(sorted(gains)[len(gains) // 2 - 1 : len(gains) // 2 + 1]) / 2
    out = [("R1", status(median, median is not None and median > 0), f"median {median}")]
    pair = resampling.paired_gain(rows, "y", [f"without_{saved}"], [f"with_{saved}"], key, reps).first()
    out.append(("R2", status(pair["low"], (pair["low"] or 0) > 0), f"gain {pair['gain']}, low {pair['low']}, high {pair['high']}"))
    mine = filter_intervals(rows, f"with_{saved}", key, block, weekly, reps).first()
    other = filter_intervals(rows, f"without_{saved}", key, block, weekly, 1).first()
    more = None if mine["caught"] is None or other["caught"] is None else mine["caught"] - other["caught"]
    parts = [status(mine["caught_lo"], (mine["caught_lo"] or 0) > scorecard.CAUGHT_LOWER), status(mine["kept_minus_all_lo"], (mine["kept_minus_all_lo"] or 0) > scorecard.KEPT_LOWER), status(more, (more or 0) >= 0)]
    out.append(("R3", combined(parts), f"caught {mine['caught']}, low {mine['caught_lo']}, kept low {mine['kept_minus_all_lo']}, more than without {more}"))
    raw = number(auc("x"))
    moved = rows.agg(F.avg(F.col("pd_high") - F.col("pd_low")).alias("m")).first()["m"]
    out.append(("R4", combined([status(raw, (raw or 0) > 0.5), status(moved, (moved or 0) > 0)]), f"raw {raw}, moved {moved}"))
    arms = {r["arm"]: r for r in drift.collect()}  # two rows
    a, b = (arms.get(n) for n in ("with", "without"))
    rise = None if not a or not b or a["auc"] is None or b["auc"] is None else round(a["auc"] - b["auc"], 9)
    drifting = bool(a) and any(t["feature"] == feature and t["share"] >= DRIFT_SHARE for t in (a["top"] or [])[:DRIFT_TOP])
    out.append(("R5", combined([status(rise, (rise or 0) <= MOST_RISE), "n/a" if not a or a["auc"] is None else status(1.0, not drifting)]), f"rise {rise}, drifting {drifting}"))
    whole = combined([s for _, s, _ in out])
    out.append(("result", "NOT JUDGED" if whole == "n/a" else whole, ""))
    return rows.sparkSession.createDataFrame(out, "rule string, status string, figures string")


def forward_check(rows: DataFrame, y: str, base: list[str], feature: str, key: str, reps: int = resampling.REPS) -> DataFrame:
    """One row: what an input adds to a baseline that was fitted on the rows of part train, on those of part test.

    Counts come with it, and a reason in `na` where a class is too small to judge by.
    """
    usable = rows.where(F.col(y).isNotNull() & F.col(feature).isNotNull() & F.col("part").isin("train", "test"))
    counts = usable.agg(*[F.count_if((F.col("part") == p) & (F.col(y) == v)).alias(f"{p}_{n}") for p in ("train", "test") for v, n in ((1, "pos"), (0, "neg"))]).first()
    numbers = ", ".join(f"{counts[c]}L AS {c}" for c in ("train_pos", "train_neg", "test_pos", "test_neg"))
    spark = rows.sparkSession
    if min(counts["train_pos"], counts["train_neg"]) < CLASS_TRAIN or min(counts["test_pos"], counts["test_neg"]) < CLASS_TEST:
        gone = ", ".join(f"cast(null as double) AS {c}" for c in ("auc_base", "auc_more", "gain", "low", "high"))
        return spark.sql(f"SELECT {gone}, {numbers}, 'too few rows of a class' AS na")
    train, test = usable.where("part = 'train'"), usable.where("part = 'test'")
    one, two = (models.scores(models.fit_baseline(train, y, c), test, c, [key, y]).select(key, y, F.col("prob").alias(n)) for c, n in ((base, "base"), ([*base, feature], "more")))
    found = resampling.paired_gain(one.join(two.drop(y), key), y, ["base"], ["more"], key, reps)
    return found.select("auc_base", "auc_more", "gain", "low", "high").crossJoin(F.broadcast(spark.sql(f"SELECT {numbers}, cast(null as string) AS na")))  # one row
