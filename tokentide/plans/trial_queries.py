"""Pooled verdicts over weeks, trials of an input, and intervals of paired scores. Scores are fixed functions of the call's id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import models, resampling, scorecard, splits, trials
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.domain import with_tables
from tokentide.plans.model_queries import INPUTS, labelled
from tokentide.plans.score_queries import BASE, TIMED, _weeks, scored
from tokentide.sources.tables import written

SEEDS, SAVED = (7, 11, 23), 7
#: Calls that a week's training part needs here to count; a tenth of what is needed of real calls.
LEAST = 100
SEED_SCORE = "(call_id * 7919 + k * 31 + {seed} * 131) % 997 / 997.0"


def seeded(rows: DataFrame) -> DataFrame:
    """Scored rows once for each seed, with their week."""
    rows = rows.withColumn("week", F.date_trunc("week", "message_date").cast("timestamp_ntz"))
    each = [rows.withColumns({"seed": F.lit(s), "runner_score": F.expr(SEED_SCORE.format(seed=s))}) for s in SEEDS]
    return reduce(DataFrame.unionByName, each)


def counted_weeks(rows: DataFrame) -> DataFrame:
    """Sums of each bucket, seed and week of scored rows that counts: enough calls up to a week before it began."""
    from pyspark.sql import Window

    weeks = written(scorecard.week_sums(seeded(rows), "call_id", ["bucket", "seed"], "week"))
    before = Window.partitionBy("bucket", "seed").orderBy("week").rowsBetween(Window.unboundedPreceding, -2)  # a row a week
    return weeks.withColumn("n_train", F.coalesce(F.sum("all_n").over(before), F.lit(0))).where(F.col("n_train") >= LEAST)


COUNTED = f"""seeded AS (SELECT * EXCLUDE (runner_score), date_trunc('week', message_date) AS week, {SEED_SCORE.format(seed='seed')} AS runner_score FROM scored CROSS JOIN (VALUES {', '.join(f'({s})' for s in SEEDS)}) v(seed)),
  ranked AS (SELECT *, least(net_ret, 1000) AS ret, row_number() OVER (PARTITION BY bucket, seed, week ORDER BY runner_score DESC, call_id) <= greatest(1, ceil(0.1 * count(*) OVER (PARTITION BY bucket, seed, week))) AS bought,
      row_number() OVER (PARTITION BY bucket, seed, week ORDER BY collapse_score DESC, call_id) <= greatest(1, ceil(0.3 * count(*) OVER (PARTITION BY bucket, seed, week))) AS skipped FROM seeded),
  weeks AS (SELECT bucket, seed, week, coalesce(sum(runner) FILTER (bought), 0) AS top_pos, count(*) FILTER (bought) AS top_n, coalesce(sum(runner), 0) AS all_pos, count(*) AS all_n, sum(ret) FILTER (bought) AS ret_top, sum(ret) AS ret_all, coalesce(sum(collapse), 0) AS coll_all,
      count(*) FILTER (skipped) AS flag_n, coalesce(sum(collapse) FILTER (skipped), 0) AS coll_flag, coalesce(sum(runner) FILTER (skipped), 0) AS run_flag, sum(ret) FILTER (skipped) AS ret_flag FROM ranked GROUP BY 1, 2, 3),
  counted AS (SELECT * FROM (SELECT *, coalesce(sum(all_n) OVER (PARTITION BY bucket, seed ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS n_train FROM weeks) WHERE n_train >= {LEAST})"""
#: Draws of the saved seed's weeks, as drawn_blocks makes them, and the pooled figures of each.
POOLED = f"""{COUNTED}, nth AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY week) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS m FROM counted WHERE seed = {SAVED}),
  draws AS (SELECT bucket, rep, CAST(('0x' || substr(md5('7:' || rep || ':' || k), 1, 8)) AS BIGINT) % m AS i FROM (SELECT DISTINCT bucket, m FROM nth) CROSS JOIN range({resampling.REPS}) r(rep) CROSS JOIN range(1, 4000) g(k) WHERE k <= m),
  sums AS (SELECT d.bucket, rep, {', '.join(f'sum({n}) AS {n}' for n in scorecard.WEEK_SUMS)} FROM draws d JOIN nth n ON n.bucket = d.bucket AND n.i = d.i GROUP BY 1, 2
    UNION ALL SELECT bucket, -1, {', '.join(f'sum({n})' for n in scorecard.WEEK_SUMS)} FROM nth GROUP BY 1),
  figures AS (SELECT bucket, rep, (top_pos / nullif(top_n, 0)) / nullif(all_pos / nullif(all_n, 0), 0) AS lift, ret_top / nullif(top_n, 0) - ret_all / nullif(all_n, 0) AS sim_gain, ret_top / nullif(top_n, 0) AS sim_top_mean,
      coll_flag / nullif(coll_all, 0) AS caught, (ret_all - ret_flag) / nullif(all_n - flag_n, 0) - ret_all / nullif(all_n, 0) AS kept FROM sums),
  pooled AS (SELECT f.bucket, (SELECT count(*) FROM nth WHERE nth.bucket = f.bucket) AS weeks, max(lift) FILTER (rep < 0) AS lift, quantile_cont(lift, 0.025) FILTER (rep >= 0) AS lift_lo, quantile_cont(lift, 0.975) FILTER (rep >= 0) AS lift_hi,
      max(sim_gain) FILTER (rep < 0) AS sim_gain, quantile_cont(sim_gain, 0.025) FILTER (rep >= 0) AS sim_gain_lo, quantile_cont(sim_gain, 0.975) FILTER (rep >= 0) AS sim_gain_hi, max(sim_top_mean) FILTER (rep < 0) AS sim_top_mean,
      quantile_cont(caught, 0.025) FILTER (rep >= 0) AS caught_lo, quantile_cont(kept, 0.025) FILTER (rep >= 0) AS kept_lo FROM figures f GROUP BY 1)"""
SAID = lambda ok, value, name: f"CASE WHEN {value} IS NULL THEN '{name} undefined' WHEN NOT {ok} THEN '{name}' END"


@query(BASE + f""", {POOLED}, lifts AS (SELECT bucket, seed, (sum(top_pos) / sum(top_n)) / nullif(sum(all_pos) / sum(all_n), 0) AS lift FROM counted GROUP BY 1, 2),
  medians AS (SELECT bucket, count(lift) AS seeds_defined, CASE WHEN count(lift) = {len(SEEDS)} THEN round(median(lift), 6) END AS median_lift FROM lifts GROUP BY 1),
  tested AS (SELECT bucket, round(CAST(sum(collapse) FILTER (skip) AS DOUBLE) / nullif(sum(collapse), 0), 6) AS collapse_removed FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY collapse_score DESC, call_id) <= greatest(1, ceil(0.3 * count(*) OVER (PARTITION BY bucket))) AS skip FROM scored) GROUP BY 1),
  j AS (SELECT t.bucket, coalesce(weeks, 0) AS weeks, coalesce(seeds_defined, 0) AS seeds_defined, median_lift, lift, CASE WHEN weeks >= 2 THEN lift_lo END AS lift_lo, CASE WHEN weeks >= 2 THEN lift_hi END AS lift_hi, sim_gain, CASE WHEN weeks >= 2 THEN sim_gain_lo END AS sim_gain_lo, CASE WHEN weeks >= 2 THEN sim_gain_hi END AS sim_gain_hi, sim_top_mean, collapse_removed
    FROM tested t LEFT JOIN pooled p USING (bucket) LEFT JOIN medians USING (bucket)),
  ok AS (SELECT *, coalesce(weeks >= 2 AND median_lift >= 2, false) AS pooled_lift_ok, coalesce(weeks >= 2 AND lift_lo > 1, false) AS pooled_lift_lower_ok, coalesce(weeks >= 2 AND sim_gain_lo > 0, false) AS sim_diff_ok, coalesce(collapse_removed >= 0.4, false) AS collapse_ok FROM j)
  SELECT bucket, weeks, seeds_defined, {', '.join(f'round({n}, 6) AS {n}' for n in ('median_lift', 'lift', 'lift_lo', 'lift_hi', 'sim_gain', 'sim_gain_lo', 'sim_gain_hi', 'sim_top_mean', 'collapse_removed'))}, pooled_lift_ok, pooled_lift_lower_ok, sim_diff_ok, collapse_ok,
    pooled_lift_ok AND pooled_lift_lower_ok AND sim_diff_ok AND collapse_ok AS passed,
    concat_ws('; ', CASE WHEN weeks < 2 THEN 'too few weeks' END, {SAID('pooled_lift_ok', 'median_lift', 'pooled_lift')}, {SAID('pooled_lift_lower_ok', 'lift_lo', 'pooled_lift_lower')}, {SAID('sim_diff_ok', 'sim_gain_lo', 'sim_diff')}, {SAID('collapse_ok', 'collapse_removed', 'collapse')}) AS reasons FROM ok""")
def pooled_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of each bucket over its counted weeks: median lift of the seeds, lower ends over drawn weeks, collapses removed."""
    rows = written(scored(spark, sf))
    weeks = written(counted_weeks(rows))
    lifts = weeks.groupBy("bucket", "seed").agg(F.expr("try_divide(sum(top_pos) / sum(top_n), nullif(sum(all_pos) / sum(all_n), 0))").alias("lift"))
    figures = scorecard.pooled(weeks.where(F.col("seed") == SAVED), ["bucket"])
    test = scorecard.trading_metrics(rows, "call_id", ["bucket"]).select("bucket", "collapse_removed")
    return scorecard.pooled_gates(figures, lifts, test, ["bucket"], len(SEEDS))


@query(BASE + f""", {POOLED}, j AS (SELECT bucket, weeks, bucket = 'medium' AS applies, round(CASE WHEN weeks >= 2 THEN caught_lo END, 6) AS caught_lo, coalesce(weeks >= 2 AND caught_lo > 0.3, false) AS caught_ok, round(CASE WHEN weeks >= 2 THEN kept_lo END, 6) AS kept_minus_all_lo, coalesce(weeks >= 2 AND kept_lo > 0, false) AS kept_ok FROM pooled)
  SELECT *, applies AND caught_ok AND kept_ok AS validated, concat_ws('; ', CASE WHEN NOT applies THEN 'not a filter bucket' END, CASE WHEN weeks < 2 THEN 'too few weeks' END, {SAID('caught_ok', 'caught_lo', 'collapses caught')}, {SAID('kept_ok', 'kept_minus_all_lo', 'kept minus all')}) AS reasons FROM j""")
def filter_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether skipping the highest collapse scores beats chance on the pooled weeks."""
    weeks = counted_weeks(written(scored(spark, sf))).where(F.col("seed") == SAVED)
    return scorecard.filter_verdict(scorecard.pooled(written(weeks), ["bucket"]), ["bucket"], F.col("bucket") == "medium")


def trial_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Calls with the group that a trial predicts, and every eleventh one in the pilot."""
    return d.facts(spark, sf).select("call_id", "token", "message_date", F.expr("call_id % 6 = 0").alias("y"), F.expr("call_id % 11 = 3").alias("pilot"))


@query(with_tables("facts") + _weeks("").replace("SELECT week, count(*) FILTER (ft < lo", """, n AS (SELECT week, CAST(sum(CASE WHEN ft < lo AND t < lo - 604800000000 AND call_id % 11 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS pilot_in_train, sum(CASE WHEN ft < lo AND t < lo - 604800000000 AND call_id % 6 = 0 THEN 1 ELSE 0 END) AS train_pos,
    count(*) FILTER (ft >= lo AND t >= lo AND t < hi AND call_id % 11 = 3) AS pilot_removed, count(*) FILTER (ft >= lo AND t >= lo AND t < hi AND call_id % 11 <> 3) AS n_test, count(*) FILTER (ft >= lo AND t >= lo AND t < hi AND call_id % 11 <> 3 AND call_id % 6 = 0) AS n_group, count(*) FILTER (ft < lo""", 1)
       .replace("AS n_train, count(*) FILTER (ft >= lo AND t >= lo AND t < hi) AS n_test FROM w", "AS n_train FROM w", 1) + f"""), r AS (SELECT *, concat_ws('; ', CASE WHEN n_train < {LEAST} THEN 'n_train ' || n_train || ' < {LEAST}' END, CASE WHEN n_test < 2 THEN 'n_test ' || n_test || ' < 2' END, CASE WHEN n_group < 1 THEN 'n_group ' || n_group || ' < 1' END) AS why FROM n)
  SELECT week, n_train, pilot_in_train, pilot_removed, n_test, n_group, why = '' AND least(train_pos, n_train - train_pos) >= 1 AS counted, CASE WHEN why <> '' THEN why WHEN least(train_pos, n_train - train_pos) < 1 THEN 'training part has one class only' ELSE '' END AS reason FROM r""")
def trial_weeks(spark: SparkSession, sf: str) -> DataFrame:
    rows = trial_rows(spark, sf)
    placed = splits.walk_forward(rows, "message_date", "call_id", "token", 7)
    return trials.windows(rows, placed, "y", "pilot", "call_id", (LEAST, 2, 1))


@query(with_tables("facts") + " SELECT call_id, CASE WHEN message_date < TIMESTAMP '1996-01-01' THEN 'train' WHEN message_date >= TIMESTAMP '1996-01-08' AND call_id % 11 <> 3 THEN 'test' END AS part FROM facts")
def confirm_parts(spark: SparkSession, sf: str) -> DataFrame:
    return trials.confirm_split(trial_rows(spark, sf), "message_date", F.col("pilot"), "1996-01-01", "1996-01-08").select("call_id", "part")


def paired(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of two arms for two repeats and three seeds, one arm a little better; as functions of the id."""
    rows = d.facts(spark, sf).select("call_id", F.date_trunc("week", "message_date").alias("block"), F.expr("cast(call_id % 6 = 0 as int)").alias("y"), F.expr("cast(call_id % 5 = 0 as int)").alias("runner"), (F.col("entry_price") * 100).alias("net_ret"), (F.col("call_id") % 6 + F.col("call_id") % 13).cast("double").alias("x"))
    noise = lambda s: F.expr(f"(call_id * 7919 + {s} * 131) % 997 / 997.0")
    arms = {f"{arm}_{s}": noise(s) + F.col("y") * lift for s in SEEDS for arm, lift in (("without", 0.3), ("with", 0.45))}
    return written(rows.withColumns(arms).withColumns({"pd_low": F.col("with_7"), "pd_high": F.col("with_7") + 0.01}))


@query()
def paired_gain(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of both arms and the gain with its interval over 2,000 paired draws, two repeats."""
    return resampling.paired_gain(paired(spark, sf), "y", ["without_7", "without_11"], ["with_7", "with_11"], "call_id")


@query()
def trial_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Rules R1 to R5 of a trial over all its weeks, with the drift of both arms' inputs from models fitted here."""
    rows = labelled(spark, sf).where("part in ('train', 'test')")
    test = F.col("part") == "test"
    trees = models.fit_trees(rows.withColumn("_test", test.cast("int")), "_test", INPUTS, rounds=3, depth=3)
    top = models.importance(trees, INPUTS, spark).orderBy(F.desc("share"), "feature").limit(trials.DRIFT_TOP).agg(F.collect_list(F.struct("feature", "share")).alias("top"))
    arms = [models.drift(rows, test, c, "call_id").select(F.lit(a).alias("arm"), F.col("drift_auc").alias("auc")) for a, c in (("with", INPUTS), ("without", INPUTS[1:]))]
    return trials.verdict(paired(spark, sf), "call_id", "block", list(SEEDS), SAVED, arms[0].unionByName(arms[1]).crossJoin(F.broadcast(top)), INPUTS[0])  # one row


@query()
def forward_gain(spark: SparkSession, sf: str) -> DataFrame:
    """What an input adds to the others forward in time, with its interval on the test part."""
    return trials.forward_check(labelled(spark, sf), "y", INPUTS[1:], INPUTS[0], "call_id")
