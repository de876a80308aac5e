"""Queries over splits and scorecards. Scores are a fixed function of the call's id, so that they can be followed by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import labels, scorecard, splits
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.domain import with_tables
from tokentide.plans.label_queries import FLAGGED, LABELLED
from tokentide.sources.tables import written

DAY = 86_400_000_000
TIMED = "timed AS (SELECT call_id, token, epoch_us(message_date) AS t, min(epoch_us(message_date)) OVER (PARTITION BY token) AS ft FROM facts)"


@query(with_tables("facts") + f""", {TIMED}, b AS (SELECT ((max(t) - 14 * {DAY}) // {DAY}) * {DAY} AS tt, ((max(t) - 14 * {DAY}) // {DAY}) * {DAY} - 30 * {DAY} AS cut FROM timed),
  z AS (SELECT call_id, CASE WHEN t < cut THEN 'train' WHEN t >= tt THEN 'test' END AS zone, (ft < cut AND t < cut) OR ft >= tt AS kept FROM timed CROSS JOIN b)
  SELECT call_id, CASE WHEN kept THEN zone END AS part, CASE WHEN zone IS NULL THEN 'embargo' WHEN NOT kept THEN 'token' END AS dropped FROM z""")
def forward_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.forward_split(d.facts(spark, sf), "message_date", "call_id", "token", 30)


FOLDS = f"""{TIMED}, o AS (SELECT t, row_number() OVER (ORDER BY t, call_id) - 1 AS r, count(*) OVER () AS n FROM timed),
  bounds AS (SELECT i, max(t) AS lo FROM o, range(5) g(i) WHERE r = least(i * n // 5, n - 1) GROUP BY i),
  placed AS (SELECT call_id, token, timed.t, (SELECT count(*) FROM bounds WHERE lo <= timed.t) AS fold FROM timed),
  ends AS (SELECT fold, min(t) AS lo, max(t) AS hi FROM placed GROUP BY 1), held AS (SELECT DISTINCT fold, token FROM placed)"""


@query(with_tables("facts") + f""", {FOLDS} SELECT e.fold AS fold, count(*) FILTER (p.fold = e.fold) AS held, count(*) FILTER ((p.t < e.lo - 7 * {DAY} OR p.t > e.hi + 7 * {DAY}) AND h.token IS NULL) AS fit
  FROM placed p CROSS JOIN ends e LEFT JOIN held h ON h.fold = e.fold AND h.token = p.token GROUP BY 1""")
def purged_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Rows held out and fitted on in each fold."""
    placed = splits.purged_folds(d.facts(spark, sf), "message_date", "call_id", "token", 7)
    held = placed.groupBy("fold").agg(F.count(F.lit(1)).alias("held"))
    fit = placed.select(F.explode("fit").alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("fit"))
    return held.join(fit, "fold", "left").select("fold", "held", F.coalesce("fit", F.lit(0)).alias("fit"))


def _weeks(limit: str) -> str:
    return f""", {TIMED}, b AS (SELECT (min(t) // {DAY}) * {DAY} AS s, max(t) AS e FROM timed), w AS (SELECT k + 1 AS week, s + k * 7 * {DAY} AS lo, s + (k + 1) * 7 * {DAY} AS hi FROM b, range(1, 2000) g(k) WHERE s + k * 7 * {DAY} <= e)
  SELECT week, count(*) FILTER (ft < lo AND t < lo - 7 * {DAY}{limit}) AS n_train, count(*) FILTER (ft >= lo AND t >= lo AND t < hi) AS n_test FROM w CROSS JOIN timed GROUP BY 1 HAVING count(*) FILTER (ft >= lo AND t >= lo AND t < hi) > 0"""


@query(with_tables("facts") + _weeks(""))
def walk_forward_weeks(spark: SparkSession, sf: str) -> DataFrame:
    return splits.week_sizes(splits.walk_forward(d.facts(spark, sf), "message_date", "call_id", "token", 7))


@query(with_tables("facts") + _weeks(f" AND t >= lo - 7 * {DAY} - 8 * 7 * {DAY}"))
def rolling_weeks(spark: SparkSession, sf: str) -> DataFrame:
    return splits.week_sizes(splits.walk_forward(d.facts(spark, sf), "message_date", "call_id", "token", 7, train_weeks=8))


@query(with_tables("facts") + f""", {TIMED}, r AS (SELECT *, row_number() OVER (ORDER BY t DESC, call_id DESC) AS back, CAST(round(0.3 * count(*) OVER ()) AS BIGINT) AS k FROM timed),
  e AS (SELECT min(t) AS edge FROM r WHERE back <= k) SELECT call_id, CASE WHEN back <= k THEN 'test' WHEN t >= edge - 2 * {DAY} THEN 'embargoed' ELSE 'train' END AS part FROM r CROSS JOIN e""")
def share_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.share_split(d.facts(spark, sf), "message_date", "call_id", 0.3, 2 * DAY)


@query(with_tables("facts") + f""", {FLAGGED}, {LABELLED} """ + " UNION ALL ".join(
    f"""SELECT '{b}' AS bucket, count(*) AS n, round((max(epoch_us(message_date)) - min(epoch_us(message_date))) / {DAY}, 6) AS span_days, count(*) >= 1000 AND (max(epoch_us(message_date)) - min(epoch_us(message_date))) / {DAY} >= 60 AS enough FROM labelled WHERE "usable_{b}" HAVING count(*) > 0"""
    for b in labels.BUCKETS))
def bucket_maturity(spark: SparkSession, sf: str) -> DataFrame:
    facts = d.facts(spark, sf)
    labelled = labels.build_labels(facts).join(facts.select("call_id", "message_date"), "call_id")
    each = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"usable_{b}").alias("usable")) for b in labels.BUCKETS])
    return splits.maturity(labelled.select("message_date", F.explode(each).alias("x")).select("message_date", "x.*"), "message_date", F.col("usable"), F.col("bucket"), 1000, 60)


#: Each usable row of two buckets with a runner and a collapse score; equal scores occur.
SCORED = """scored AS (SELECT *, (call_id * 7919 + k * 31) % 997 / 997.0 AS runner_score, (call_id * 104729 + k * 17) % 499 / 499.0 AS collapse_score FROM (
    SELECT call_id, message_date, 'short' AS bucket, 1 AS k, runner_short AS runner, collapse_short AS collapse, net_ret_short AS net_ret FROM labelled WHERE usable_short
    UNION ALL SELECT call_id, message_date, 'medium', 2, runner_medium, collapse_medium, net_ret_medium FROM labelled WHERE usable_medium))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    facts = d.facts(spark, sf)
    labelled = labels.build_labels(facts).join(facts.select("call_id", "message_date"), "call_id")
    part = lambda b, k: labelled.where(f"usable_{b}").select("call_id", "message_date", F.lit(b).alias("bucket"), F.lit(k).alias("k"), *[F.col(f"{c}_{b}").alias(c) for c in ("runner", "collapse", "net_ret")])
    both = part("short", 1).unionByName(part("medium", 2))
    return both.withColumns({"runner_score": ((F.col("call_id") * 7919 + F.col("k") * 31) % 997) / 997.0, "collapse_score": ((F.col("call_id") * 104729 + F.col("k") * 17) % 499) / 499.0})


BASE = with_tables("facts") + f", {FLAGGED}, {LABELLED}, {SCORED}"


@query(BASE + """, c AS (SELECT bucket, runner_score AS s, sum(runner) AS p, count(*) AS n FROM scored GROUP BY 1, 2),
  u AS (SELECT *, sum(n - p) OVER up - (n - p) AS below, sum(p) OVER down AS cp, sum(n) OVER down AS cn FROM c WINDOW up AS (PARTITION BY bucket ORDER BY s), down AS (PARTITION BY bucket ORDER BY s DESC)),
  m AS (SELECT bucket, round(sum(p * (below + (n - p) / 2)) / (sum(p) * sum(n - p)), 6) AS roc_auc, round(sum(cp / cn * p) / sum(p), 6) AS pr_auc FROM u GROUP BY 1)
  SELECT bucket, count(*) AS n, round(avg(CAST(runner AS DOUBLE)), 6) AS base_rate, any_value(m.roc_auc) AS roc_auc, any_value(m.pr_auc) AS pr_auc, round(avg((runner_score - runner) * (runner_score - runner)), 6) AS brier FROM scored JOIN m USING (bucket) GROUP BY 1""")
def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard.model_metrics(scored(spark, sf), "runner", "runner_score", ["bucket"])


TOPPED = """topped AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY runner_score DESC, call_id) <= greatest(1, ceil(0.1 * count(*) OVER (PARTITION BY bucket))) AS top,
    row_number() OVER (PARTITION BY bucket ORDER BY collapse_score DESC, call_id) <= greatest(1, ceil(0.3 * count(*) OVER (PARTITION BY bucket))) AS skip FROM scored)"""
TRADING = """trading AS (SELECT bucket, CAST(sum(runner) FILTER (top) AS BIGINT) AS top_pos, count(*) FILTER (top) AS top_n, CAST(sum(runner) AS BIGINT) AS all_pos, count(*) AS all_n,
    round(CAST(sum(collapse) FILTER (skip) AS DOUBLE) / sum(collapse), 6) AS collapse_removed, round(avg(least(net_ret, 1000)) FILTER (top), 6) AS sim_top_mean, round(avg(least(net_ret, 1000)), 6) AS sim_all_mean FROM topped GROUP BY 1),
  lifted AS (SELECT *, top_pos / top_n AS p, all_pos / all_n AS base, (top_pos / top_n + 1.96 * 1.96 / (2 * top_n)) / (1 + 1.96 * 1.96 / top_n) AS mid,
    1.96 * sqrt(top_pos / top_n * (1 - top_pos / top_n) / top_n + 1.96 * 1.96 / (4 * top_n * top_n)) / (1 + 1.96 * 1.96 / top_n) AS half FROM trading),
  metrics AS (SELECT bucket, top_pos, top_n, all_pos, all_n, round(p / base, 6) AS top_lift, round(greatest(0, mid - half) / base, 6) AS top_lift_lo, round(least(1, mid + half) / base, 6) AS top_lift_hi, collapse_removed, sim_top_mean, sim_all_mean, sim_top_mean > sim_all_mean AS sim_beats_all FROM lifted)"""


@query(BASE + f", {TOPPED}, {TRADING} SELECT * FROM metrics")
def trading_metrics(spark: SparkSession, sf: str) -> DataFrame:
    # scored once: both rankings read the rows more than once
    return scorecard.trading_metrics(written(scored(spark, sf)), "call_id", ["bucket"])


def _rates(group: str) -> str:
    return f"""SELECT {group}, round(nf / n, 6) AS flagged_share, round(cf / nullif(c, 0), 6) AS collapses_caught, round(cf / nullif(nf, 0), 6) AS collapse_rate_flagged, round((c - cf) / nullif(n - nf, 0), 6) AS collapse_rate_kept,
  round(rf / nullif(r, 0), 6) AS runners_lost, round(rf / nullif(nf, 0), 6) AS runner_rate_flagged, round((r - rf) / nullif(n - nf, 0), 6) AS runner_rate_kept, round(x / n, 6) AS all_mean, round((x - xf) / nullif(n - nf, 0), 6) AS kept_mean, round((x - xf) / nullif(n - nf, 0) - x / n, 6) AS kept_minus_all"""


@query(BASE + f""", {TOPPED} {_rates("bucket")} FROM (SELECT bucket, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (skip) AS DOUBLE) AS nf, CAST(sum(collapse) AS DOUBLE) AS c, CAST(sum(CASE WHEN skip THEN collapse ELSE 0 END) AS DOUBLE) AS cf, CAST(sum(runner) AS DOUBLE) AS r,
  CAST(sum(CASE WHEN skip THEN runner ELSE 0 END) AS DOUBLE) AS rf, sum(least(net_ret, 1000)) AS x, sum(CASE WHEN skip THEN least(net_ret, 1000) ELSE 0 END) AS xf FROM topped GROUP BY 1)""")
def filter_rates(spark: SparkSession, sf: str) -> DataFrame:
    from tokentide.operators.evaluation import top_rows

    flagged = top_rows(scored(spark, sf), "collapse_score", "call_id", scorecard.SKIP_SHARE, ["bucket"])
    return scorecard.filter_rates(scorecard.filter_sums(flagged, F.col("top"), ["bucket"]), ["bucket"])


@query(BASE + f""", cut AS (SELECT bucket, quantile_cont(collapse_score, 0.7) AS cutoff FROM scored WHERE message_date < TIMESTAMP '1995-10-01' GROUP BY 1), f AS (SELECT s.*, collapse_score >= cutoff AS skip, round(cutoff, 6) AS cutoff FROM scored s JOIN cut USING (bucket) WHERE message_date >= TIMESTAMP '1995-10-01')
  {_rates("bucket, cutoff")} FROM (SELECT bucket, cutoff, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (skip) AS DOUBLE) AS nf, CAST(sum(collapse) AS DOUBLE) AS c, CAST(sum(CASE WHEN skip THEN collapse ELSE 0 END) AS DOUBLE) AS cf, CAST(sum(runner) AS DOUBLE) AS r,
  CAST(sum(CASE WHEN skip THEN runner ELSE 0 END) AS DOUBLE) AS rf, sum(least(net_ret, 1000)) AS x, sum(CASE WHEN skip THEN least(net_ret, 1000) ELSE 0 END) AS xf FROM f GROUP BY 1, 2)""")
def fixed_cutoff_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The skip filter with a cut-off taken from rows before October 1995, on the rows from then on."""
    rows = scored(spark, sf)
    split = F.lit("1995-10-01").cast("timestamp_ntz")
    cut = scorecard.cutoff(rows.where(F.col("message_date") < split), "collapse_score", ["bucket"])
    later = rows.where(F.col("message_date") >= split).join(F.broadcast(cut), "bucket").withColumn("flag", F.col("collapse_score") >= F.col("cutoff")).withColumn("cutoff", F.round("cutoff", 6))  # a row a bucket
    return scorecard.filter_rates(scorecard.filter_sums(later, F.col("flag"), ["bucket", "cutoff"]), ["bucket", "cutoff"])


@query(BASE + """, x AS (SELECT bucket, share, CAST(r AS BIGINT) AS r, runner, count(*) OVER (PARTITION BY bucket, share) AS n, CAST(sum(runner) OVER (PARTITION BY bucket, share) AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY runner_score DESC, call_id) AS r FROM scored) CROSS JOIN (SELECT unnest([0.1, 0.3])::DOUBLE AS share)),
  s AS (SELECT bucket, share, any_value(n) AS n, any_value(pos) AS pos, count(*) AS n_top, CAST(sum(runner) AS BIGINT) AS hits FROM x WHERE r <= greatest(1, ceil(n * share)) GROUP BY 1, 2),
  i AS (SELECT *, hits / n_top AS p, pos / n AS base, (hits / n_top + 1.96 * 1.96 / (2 * n_top)) / (1 + 1.96 * 1.96 / n_top) AS mid, 1.96 * sqrt(hits / n_top * (1 - hits / n_top) / n_top + 1.96 * 1.96 / (4 * n_top * n_top)) / (1 + 1.96 * 1.96 / n_top) AS half FROM s)
  SELECT bucket, share, n_top, hits, round(p, 6) AS "precision", round(mid - half, 6) AS low, round(mid + half, 6) AS high, round(p / base, 6) AS lift, round((mid - half) / base, 6) AS lift_low, round((mid + half) / base, 6) AS lift_high, round(hits / pos, 6) AS caught FROM i""")
def top_stats(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard.top_stats(scored(spark, sf), "runner", "runner_score", "call_id", ["bucket"])


WEEKLY = """weekly AS (SELECT bucket, date_trunc('week', message_date) AS week, avg(least(net_ret, 1000)) FILTER (runner_score >= 0.9) > avg(least(net_ret, 1000)) AS beats, count(*) * 250 AS n_train FROM scored GROUP BY 1, 2)"""


@query(BASE + f""", {TOPPED}, {TRADING}, {WEEKLY}, w AS (SELECT bucket, count(*) FILTER (beats IS NOT NULL AND n_train >= 1000) AS windows_evaluated, count(*) FILTER (beats AND n_train >= 1000) AS windows_beating, count(*) FILTER (beats IS NOT NULL AND n_train < 1000) AS windows_not_counted FROM weekly GROUP BY 1),
  g AS (SELECT bucket, top_lift >= 2 AS lift_ok, collapse_removed >= 0.4 AS collapse_ok, windows_evaluated > 0 AND windows_beating = windows_evaluated AS walk_forward_ok, windows_evaluated, windows_beating, windows_not_counted FROM metrics JOIN w USING (bucket))
  SELECT *, lift_ok AND collapse_ok AND walk_forward_ok AS passed, concat_ws(',', CASE WHEN NOT lift_ok THEN 'lift' END, CASE WHEN NOT collapse_ok THEN 'collapse' END, CASE WHEN NOT walk_forward_ok THEN 'walk_forward' END) AS reasons FROM g""")
def scorecard_gates(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    ret = F.least(F.col("net_ret"), F.lit(scorecard.RETURN_CAP))
    weeks = rows.groupBy("bucket", F.date_trunc("week", "message_date").alias("week")).agg((F.avg(F.when(F.col("runner_score") >= 0.9, ret)) > F.avg(ret)).alias("sim_beats_all"), (F.count(F.lit(1)) * 250).alias("n_train"))
    return scorecard.gates(scorecard.trading_metrics(rows, "call_id", ["bucket"]), weeks, ["bucket"])


@query(BASE + """, l AS (SELECT bucket, call_id % 4 AS seed, avg(CAST(runner AS DOUBLE)) FILTER (runner_score >= 0.8) / nullif(avg(CAST(runner AS DOUBLE)), 0) AS lift FROM scored GROUP BY 1, 2)
  SELECT bucket, count(lift) AS n_seeds, CASE WHEN count(lift) = 4 THEN round(median(lift), 6) END AS median, CASE WHEN count(lift) = 4 THEN round(min(lift), 6) END AS low, CASE WHEN count(lift) = 4 THEN round(max(lift), 6) END AS high FROM l GROUP BY 1""")
def seed_medians(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("runner").cast("double")
    lifts = scored(spark, sf).groupBy("bucket", (F.col("call_id") % 4).alias("seed")).agg(F.try_divide(F.avg(F.when(F.col("runner_score") >= 0.8, y)), F.nullif(F.avg(y), F.lit(0.0))).alias("lift"))
    return scorecard.seed_median(lifts, "lift", ["bucket"], 4)


@query(BASE + """, q AS (SELECT bucket, quantile_cont(runner_score, [i / 100.0 for i in range(101)]) AS reference FROM scored WHERE message_date < TIMESTAMP '1995-10-01' GROUP BY 1)
  SELECT call_id, bucket, round(100.0 * (len(list_filter(reference, lambda x: x < runner_score)) + len(list_filter(reference, lambda x: x <= runner_score))) / 202, 4) AS rank_pct FROM scored JOIN q USING (bucket) WHERE message_date >= TIMESTAMP '1995-10-01'""")
def score_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile of each newer score among 101 quantiles of the older ones."""
    rows = scored(spark, sf)
    split = F.lit("1995-10-01").cast("timestamp_ntz")
    reference = scorecard.reference_quantiles(rows.where(F.col("message_date") < split), "runner_score", ["bucket"])
    later = rows.where(F.col("message_date") >= split).join(F.broadcast(reference), "bucket")  # 101 numbers a bucket
    return later.select("call_id", "bucket", F.round(scorecard.rank_percent(F.col("runner_score"), F.col("reference")), 4).alias("rank_pct"))
