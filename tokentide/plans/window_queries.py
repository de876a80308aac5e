"""Queries over windows, timing, bands and grids of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import analytics, labels, windows
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.domain import with_tables
from tokentide.plans.label_queries import WITH_FAMILY

COLUMNS = ["ret_late_1h", "max_gain_late_1h", "ret_late_1d", "max_gain_late_1d", "ret_late_3d", "max_gain_late_3d", "ret_late_7d", "max_gain_late_7d", "ret_late_30d", "max_gain_late_30d"]
SANE = " AND ".join(f"NOT coalesce({c} > 100000, false)" for c in COLUMNS)
CLASS = """CASE WHEN price_unit = 'usd' AND ret_late_7d IS NOT NULL THEN 'data' WHEN message_date + INTERVAL 7 DAY > TIMESTAMP '2001-07-30' THEN 'notDue' WHEN tracking_status IS NULL THEN 'untracked'
    WHEN price_unit <> 'usd' THEN 'noUsd' WHEN tracking_status = 'no_pool' THEN 'noData' ELSE 'pending' END"""
OUT = "CASE WHEN rugged THEN 'rugged' WHEN ret_late_7d <= -50 THEN 'collapse' WHEN ret_late_7d <= 0 THEN 'loss' WHEN ret_late_7d < 100 THEN 'gain' ELSE 'runner' END"


def sane(spark: SparkSession, sf: str) -> DataFrame:
    """Calls without an extreme outcome."""
    return d.facts(spark, sf).where(~windows.is_extreme(COLUMNS))


@query(with_tables("facts") + f""", x AS (SELECT *, {CLASS} AS kind, {OUT} AS mix FROM facts WHERE {SANE}) SELECT verdict, count(*) AS calls, """
       + ", ".join(f"""count(*) FILTER (kind = '{k}') AS "{k}" """ for k in ("data", "notDue", "untracked", "noUsd", "noData", "pending"))
       + """, count(*) FILTER (kind = 'data' AND ret_late_7d > 0) AS wins, count(*) FILTER (kind = 'data' AND ret_late_7d <= -50) AS collapses, count(*) FILTER (kind = 'data' AND max_gain_late_7d >= 100) AS peak100, count(*) FILTER (kind = 'data' AND rugged) AS rugged, """
       + ", ".join(f"count(*) FILTER (kind = 'data' AND mix = '{k}') AS mix_{k}" for k in ("rugged", "collapse", "loss", "gain", "runner"))
       + """, round(avg(ret_late_7d) FILTER (kind = 'data'), 6) AS mean_ret, round(median(ret_late_7d) FILTER (kind = 'data'), 6) AS median_ret, round(avg(max_gain_late_7d) FILTER (kind = 'data'), 6) AS mean_peak, round(median(max_gain_late_7d) FILTER (kind = 'data'), 6) AS median_peak FROM x GROUP BY 1""")
def window_groups(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    due = c("message_date") + F.expr("interval 7 days") <= F.lit("2001-07-30").cast("timestamp_ntz")
    kind = windows.row_class(c("ret_late_7d"), due, c("price_unit") == "usd", c("tracking_status").isNotNull(), F.coalesce(c("tracking_status") == "no_pool", F.lit(False)))
    return windows.window_groups(sane(spark, sf), [c("verdict")], kind, c("ret_late_7d"), c("max_gain_late_7d"), c("rugged"))


@query(with_tables("facts") + f" SELECT verdict, count(*) AS n, count(*) FILTER (ret_late_7d < max_gain_late_7d / 2) AS k FROM facts WHERE {SANE} AND max_gain_late_7d > 0 AND ret_late_7d IS NOT NULL GROUP BY 1")
def gave_back(spark: SparkSession, sf: str) -> DataFrame:
    return windows.gave_back(sane(spark, sf), [F.col("verdict")], F.col("max_gain_late_7d"), F.col("ret_late_7d"))


TIMED = """timed AS (SELECT *, first_2x_s IS NOT NULL AS touched, coalesce(first_2x_s IS NOT NULL AND above_2x_s >= 3600, false) AS reached, CASE WHEN first_2x_s IS NULL THEN 0 ELSE above_2x_s END AS held_s FROM facts WHERE ret_late_7d IS NOT NULL),
  items AS (SELECT *, CASE WHEN reached THEN greatest(0, CASE WHEN coalesce(censored, false) OR fall_below_2x_s IS NULL THEN above_2x_s ELSE least(above_2x_s, fall_below_2x_s - first_2x_s) END) END AS hold_t, CASE WHEN reached THEN NOT coalesce(censored, false) END AS fell FROM timed)"""


def timed(spark: SparkSession, sf: str) -> DataFrame:
    return windows.timing(d.facts(spark, sf).where("ret_late_7d is not null"), "first_2x_s", "above_2x_s", "fall_below_2x_s", "censored")


@query(with_tables("facts") + f", {TIMED} SELECT call_id, touched, reached, touched AND above_2x_s IS NOT NULL AND NOT reached AS short, held_s, hold_t, fell FROM items")
def reached_2x(spark: SparkSession, sf: str) -> DataFrame:
    return timed(spark, sf).select("call_id", "touched", "reached", "short", "held_s", "hold_t", "fell")


@query(with_tables("facts") + f""", {TIMED}, b AS (SELECT CASE WHEN held_s = 0 THEN 0 ELSE (held_s >= 0)::INT + (held_s >= 300)::INT + (held_s >= 900)::INT + (held_s >= 3600)::INT + (held_s >= 14400)::INT + (held_s >= 86400)::INT + (held_s >= 259200)::INT + (held_s >= 604800)::INT END AS category, held_s, touched, reached FROM timed)
  SELECT CAST(g.range AS INT) AS category, count(*) FILTER (held_s = 0) AS zero, count(*) FILTER (touched AND NOT reached AND held_s > 0) AS short, count(*) FILTER (reached AND held_s > 0) AS reached FROM range(9) g LEFT JOIN b ON b.category = g.range GROUP BY 1""")
def held_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return windows.held_histogram(timed(spark, sf))


@query(with_tables("facts") + """ SELECT CAST((first_2x_s >= 300)::INT + (first_2x_s >= 900)::INT + (first_2x_s >= 3600)::INT + (first_2x_s >= 14400)::INT + (first_2x_s >= 86400)::INT + (first_2x_s >= 259200)::INT + (first_2x_s >= 604800)::INT AS INT) AS band, count(*) AS n FROM facts WHERE first_2x_s >= 0 GROUP BY 1""")
def time_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return d.facts(spark, sf).where("first_2x_s >= 0").groupBy(windows.time_band(F.col("first_2x_s")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("facts") + f""", {TIMED}, a AS (SELECT hold_t AS t, count(*) FILTER (fell) AS events, count(*) AS n FROM items WHERE hold_t IS NOT NULL GROUP BY 1), r AS (SELECT *, CAST(sum(n) OVER (ORDER BY t DESC) AS BIGINT) AS at_risk FROM a),
  s AS (SELECT t, CASE WHEN max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER (ORDER BY t) = 1 THEN 0.0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER (ORDER BY t)) END AS survival, events FROM r)
  SELECT x.at, round(arg_max(survival, t), 6) AS survival FROM s, (SELECT unnest([3600.0, 4500.0, 6000.0, 7200.0])::DOUBLE AS at) x WHERE events > 0 AND t <= x.at GROUP BY 1""")
def still_above(spark: SparkSession, sf: str) -> DataFrame:
    """Share of calls still above twice their entry after given times, read off the survival curve."""
    curve = analytics.kaplan_meier(timed(spark, sf).where("hold_t is not null").select(F.col("hold_t").alias("t"), F.col("fell").alias("event")), "t", "event")
    return windows.step_at(curve, [3600, 4500, 6000, 7200], "t", "survival")


@query(with_tables("facts") + ", c AS (SELECT greatest(first_2x_s, 0) AS t, count(*) AS c FROM facts WHERE first_2x_s IS NOT NULL GROUP BY 1) SELECT t, CAST(sum(c) OVER (ORDER BY t) AS BIGINT) AS k, round(sum(c) OVER (ORDER BY t) / (SELECT count(*) FROM facts), 6) AS share FROM c")
def share_by_time(spark: SparkSession, sf: str) -> DataFrame:
    return windows.cumulative_share(d.facts(spark, sf), "first_2x_s")


@query(with_tables("facts") + f""", {TIMED}, x AS (SELECT *, CASE WHEN rug_kind IS NULL THEN 'none' WHEN rug_kind IN ('at_call', 'price') THEN rug_kind WHEN call_id * 100 <= 604800 THEN 'in window' ELSE 'later' END AS rug FROM items)
  SELECT rug, count(*) AS n, count(*) FILTER (touched) AS touched, count(*) FILTER (reached) AS reached, round(median(held_s), 4) AS median_held_s, round(avg(CASE WHEN reached THEN first_2x_s END), 4) AS mean_first_2x_s FROM x GROUP BY 1""")
def timing_by_rug(spark: SparkSession, sf: str) -> DataFrame:
    rug = windows.rug_timing(F.col("rug_kind"), F.col("call_id") * 100, 604800)
    return timed(spark, sf).groupBy(rug.alias("rug")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("touched").alias("touched"), F.count_if("reached").alias("reached"), F.round(F.median("held_s"), 4).alias("median_held_s"), F.round(F.avg(F.when(F.col("reached"), F.col("first_2x_s"))), 4).alias("mean_first_2x_s")
    )


@query(with_tables("facts") + """ SELECT strftime(date_trunc('month', message_date), '%Y-%m-%d') AS period, count(*) AS calls, count(verdict) AS verdicts, count(trades_24h) AS known, count(*) FILTER (trades_24h < 50) AS quiet, count(*) FILTER (rugged) AS rugged FROM facts GROUP BY 1""")
def period_health(spark: SparkSession, sf: str) -> DataFrame:
    month = F.date_format(F.date_trunc("month", F.col("message_date")), "yyyy-MM-dd")
    return windows.week_health(d.facts(spark, sf), month, F.col("verdict").isNotNull(), F.col("trades_24h").isNotNull(), F.col("trades_24h") < 50, F.col("rugged"))


@query(with_tables("facts") + f""", {WITH_FAMILY} SELECT strftime(date_trunc('week', message_date), '%Y-%m-%d') AS period, coalesce(family, 'missing') AS family, count(*) FILTER (trades_24h < 50) AS k, count(*) AS n FROM fam WHERE trades_24h IS NOT NULL GROUP BY 1, 2""")
def quiet_by_family(spark: SparkSession, sf: str) -> DataFrame:
    week = F.date_format(F.date_trunc("week", F.col("message_date")), "yyyy-MM-dd")
    return windows.quiet_by_family(d.facts(spark, sf), week, F.coalesce(labels.exchange_family(F.col("dex")), F.lit("missing")), F.col("trades_24h").isNotNull(), F.col("trades_24h") < 50)


@query(with_tables("facts") + f""", {WITH_FAMILY} SELECT coalesce(verdict, 'Not given') AS a, coalesce(family, 'Not given') AS b, count(*) AS n, round(avg(ret_late_7d), 6) AS mean FROM fam WHERE {SANE} GROUP BY 1, 2""")
def verdict_by_family(spark: SparkSession, sf: str) -> DataFrame:
    return windows.grid(sane(spark, sf), F.col("verdict"), labels.exchange_family(F.col("dex")), F.col("ret_late_7d"))


H = ("1h", "1d", "3d", "7d", "30d")
PATH = "SELECT verdict AS \"group\", h.horizon, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM facts, LATERAL (VALUES " + ", ".join(f"('{h}', ret_late_{h})" for h in H) + ") h(horizon, v) WHERE v IS NOT NULL AND " + SANE


@query(with_tables("facts") + f" {PATH} GROUP BY 1, 2")
def return_paths(spark: SparkSession, sf: str) -> DataFrame:
    return windows.paths(sane(spark, sf), F.col("verdict"), {h: f"ret_late_{h}" for h in H}, same_calls=False)


@query(with_tables("facts") + f" {PATH} AND " + " AND ".join(f"ret_late_{h} IS NOT NULL" for h in H) + " GROUP BY 1, 2")
def return_paths_same_calls(spark: SparkSession, sf: str) -> DataFrame:
    return windows.paths(sane(spark, sf), F.col("verdict"), {h: f"ret_late_{h}" for h in H}, same_calls=True)
