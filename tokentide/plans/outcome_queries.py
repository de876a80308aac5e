"""Outcomes of all horizons with late entries and rugs, their pivots and masks, and scores and posts next to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import candles, identity
from tokentide.plans import call_queries as c
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.domain import HORIZONS, with_tables
from tokentide.plans.position_queries import HORIZON_VALUES, LATE, entries
from tokentide.plans.timing_queries import SOURCES, all_horizon_timing
from tokentide.sources.tables import written

#: Measures of a horizon, and the names that begin their columns in a pivot.
MEASURES = {"return_pct": "ret", "max_gain_pct": "max_gain", "max_drawdown_pct": "max_dd", "return_late_pct": "ret_late", "max_gain_late_pct": "max_gain_late", "max_drawdown_late_pct": "max_dd_late"}
#: Every ninth call is rugged between an hour and some three days after its entry.
RUG_T = "CASE WHEN call_id % 9 = 4 THEN entry_t + 3600000000 + call_id * 7919 % 250000 * 1000000 END"


def full(spark: SparkSession, sf: str) -> DataFrame:
    trades = d.trades(spark, sf).drop("ts")
    priced = candles.entry_price(trades, d.calls_on_events(spark, sf)).select("call_id", "entry_price")
    late = entries(spark, sf).join(priced, "call_id").withColumn("rug_t", F.expr(RUG_T))
    return candles.full_results(trades, written(late), c.NOW_T)


FULL = f"""based AS (SELECT l.*, e.entry_price, {RUG_T.replace('call_id', 'l.call_id').replace('entry_t', 'l.entry_t')} AS rug_t FROM late l JOIN entries e USING (call_id)),
  each AS (SELECT b.call_id, horizon, b.entry_price, b.late_price, b.late_t, b.rug_t, b.token, b.entry_t, b.entry_t + s::BIGINT * 1000000 AS due_t FROM based b CROSS JOIN (VALUES {HORIZON_VALUES}) h(horizon, s)),
  ends AS (SELECT e.*, arg_max(price, (t, seq)) AS last, max(price) AS high, min(price) AS low, max(price) FILTER (t > late_t) AS late_high, min(price) FILTER (t > late_t) AS late_low
    FROM each e LEFT JOIN trades t ON t.token = e.token AND t.t > entry_t AND t.t <= due_t AND (rug_t IS NULL OR t.t < rug_t) GROUP BY ALL),
  judged AS (SELECT *, coalesce(rug_t <= due_t, false) AS gone, CASE WHEN due_t > {c.NOW_T} THEN 'pending' WHEN NOT coalesce(entry_price > 0, false) OR (last IS NULL AND NOT coalesce(rug_t <= due_t, false)) THEN 'no_data' ELSE 'done' END AS status FROM ends),
  full_rows AS (SELECT call_id, horizon, status, CASE WHEN status = 'done' THEN gone END AS rugged,
    CASE WHEN status = 'done' AND entry_price > 0 THEN round((CASE WHEN gone THEN 0 ELSE last END / entry_price - 1) * 100, 6) END AS return_pct, CASE WHEN status = 'done' AND entry_price > 0 THEN round((high / entry_price - 1) * 100, 6) END AS max_gain_pct,
    CASE WHEN status = 'done' AND entry_price > 0 THEN round((CASE WHEN gone THEN 0 ELSE low END / entry_price - 1) * 100, 6) END AS max_drawdown_pct, CASE WHEN status = 'done' AND late_price > 0 THEN round((CASE WHEN gone THEN 0 ELSE last END / late_price - 1) * 100, 6) END AS return_late_pct,
    CASE WHEN status = 'done' AND late_price > 0 THEN round((late_high / late_price - 1) * 100, 6) END AS max_gain_late_pct, CASE WHEN status = 'done' AND late_price > 0 THEN round((CASE WHEN gone THEN 0 ELSE late_low END / late_price - 1) * 100, 6) END AS max_drawdown_late_pct FROM judged)"""
WITH_FULL = with_tables("price_events", "event_calls", "trades") + f", {c.ENTRY}, {LATE}, {FULL}"
CELLS = ", ".join(f"max({m}) FILTER (horizon = '{h}' AND status = 'done') AS {n}_{h}" for m, n in MEASURES.items() for h in HORIZONS)


@query(WITH_FULL + " SELECT * FROM full_rows")
def full_results(spark: SparkSession, sf: str) -> DataFrame:
    return full(spark, sf)


@query(WITH_FULL + f" SELECT call_id, {CELLS} FROM full_rows GROUP BY 1")
def pivot_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Five horizons by six measures, done horizons only."""
    return identity.pivot_measures(full(spark, sf), MEASURES)


TIMES = {"peak_late_after_s": "peak", "first_2x_after_s": "first_2x", "above_2x_s": "above_2x", "fall_below_2x_after_s": "fall"}
BIT = "CASE horizon WHEN '1h' THEN 1 WHEN '1d' THEN 2 WHEN '3d' THEN 4 WHEN '7d' THEN 8 ELSE 16 END"


@query(SOURCES + f""", out AS (SELECT call_id, horizon, CASE WHEN at_entry THEN 0 ELSE peak_s - entry_s END AS peak_late_after_s, CASE WHEN reached THEN first_s - entry_s END AS first_2x_after_s, CAST(held AS BIGINT) AS above_2x_s, CASE WHEN reached THEN fall - entry_s END AS fall_below_2x_after_s FROM timed WHERE outcome = 'timed')
  SELECT call_id, {', '.join(f"max({t}) FILTER (horizon = '{h}') AS {n}_{h}" for t, n in TIMES.items() for h in HORIZONS)} FROM out GROUP BY 1""")
def pivot_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Five horizons by four times, timed horizons only."""
    return identity.pivot_measures(all_horizon_timing(spark, sf).where("outcome = 'timed'").withColumn("status", F.lit("done")), TIMES)


@query(SOURCES + f""" SELECT call_id, CAST(coalesce(bit_or(CASE WHEN outcome = 'no late entry' THEN {BIT} END), 0) AS BIGINT) AS no_data, CAST(coalesce(bit_or(CASE WHEN outcome = 'timed' THEN {BIT} END), 0) AS BIGINT) AS timed,
  CAST(coalesce(bit_or(CASE WHEN outcome = 'timed' AND reached AND fall IS NULL THEN {BIT} END), 0) AS BIGINT) AS censored FROM timed GROUP BY 1""")
def horizon_masks(spark: SparkSession, sf: str) -> DataFrame:
    """A bit for each horizon: without data, timed, still above twice the entry at its end."""
    rows = written(all_horizon_timing(spark, sf))
    masks = {"no_data": F.col("outcome") == "no late entry", "timed": F.col("outcome") == "timed", "censored": F.col("censored")}
    found = None
    for name, condition in masks.items():
        one = identity.horizon_bits(rows, condition).withColumnRenamed("bits", name)
        found = one if found is None else found.join(one, "call_id")
    return found


SCORES = "scores AS (SELECT o_orderkey AS call_id, 'v' || (o_custkey % 3) AS model_version, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'short' ELSE 'medium' END AS bucket, (o_orderkey * 7919) % 997 / 997.0 AS runner_prob, o_orderdate AS scored_at FROM orders)"


@query(with_tables("facts") + f""", {SCORES} SELECT s.*, f.token, f.message_date, f.price_unit, f.rugged, f.ret_late_1d, f.max_gain_late_1d, f.ret_late_3d, f.ret_late_7d, f.ret_late_30d FROM scores s JOIN facts f USING (call_id) WHERE bucket IS NOT NULL""")
def predictions_and_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Scores next to what happened; scores of no bucket are left out."""
    o = d.read(spark, sf, "orders")
    bucket = F.when(F.col("o_orderkey") % 4 == 1, "short").when(F.col("o_orderkey") % 4 > 1, "medium")
    scores = o.select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("v"), (F.col("o_custkey") % 3).cast("string")).alias("model_version"), bucket.alias("bucket"), ((F.col("o_orderkey") * 7919) % 997 / 997.0).alias("runner_prob"), F.col("o_orderdate").alias("scored_at"))
    return identity.predictions_with_outcomes(scores, d.facts(spark, sf).select("call_id", "token", "message_date", "price_unit", "rugged", "ret_late_1d", "max_gain_late_1d", "ret_late_3d", "ret_late_7d", "ret_late_30d"))


@query("SELECT o_orderkey AS call_id, concat('0x', lpad(lower(hex(o_custkey)), 40, '0')) AS token, o_orderdate AS message_date, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'P' THEN 'update' ELSE 'call' END AS post_kind, m.* EXCLUDE (l_orderkey) FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_buys, round(max(l_extendedprice), 4) AS largest_buy, round(sum(l_extendedprice), 4) AS bought FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) m ON l_orderkey = o_orderkey")
def calls_with_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Every call with the figures parsed from it, where there are any."""
    buys = d.read(spark, sf, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.count(F.lit(1)).alias("n_buys"), F.round(F.max("l_extendedprice"), 4).alias("largest_buy"), F.round(F.sum("l_extendedprice"), 4).alias("bought"))
    return identity.calls_with_metrics(d.calls(spark, sf).drop("o_totalprice"), buys)
