"""Timing of all horizons from stored candles, and the counters of a backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import candles, timing
from tokentide.plans import call_queries as c
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.domain import HORIZONS, with_tables
from tokentide.plans.position_queries import HORIZON_VALUES, LATE, entries
from tokentide.sources.tables import written

S = 1_000_000
#: Every seventh call is rugged some half day to a day and a half after its entry; of some of these the time isn't known.
RUG_S = "CASE WHEN call_id % 7 = 0 AND call_id % 5 > 0 THEN entry_s + 40000 + call_id * 61 % 90000 END"


def horizon_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each call and horizon with its late entry, the highest gain over it until the horizon or the rug, and the rug."""
    base = entries(spark, sf).withColumn("entry_s", F.expr(f"entry_t div {S}")).withColumns({"rugged": F.expr("call_id % 7 = 0"), "rug_s": F.expr(RUG_S)})
    base = written(base)
    found = candles.pieces(d.trades(spark, sf).drop("ts"), base.withColumn("rug_t", F.col("rug_s") * S), "late_t", ("rug_t",))
    # whole seconds after the entry lie in the hour of the exact moment, so these ends are cut too
    stop = lambda s: F.least((F.expr(f"entry_t div {S}") + s) * S, "rug_t")
    tops = found.groupBy("call_id").agg(*[F.max(F.when(F.col("to_t") <= stop(s), F.col("high"))).alias(f"top_{h}") for h, s in HORIZONS.items()])
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(s).cast("long").alias("s"), F.col(f"top_{h}").alias("top")) for h, s in HORIZONS.items()])).alias("x")
    rows = base.join(tops.hint("merge"), "call_id", "left").select("call_id", "entry_s", "late_price", "rugged", "rug_s", each).select("*", "x.*")
    gain = (F.greatest("top", "late_price") / F.nullif("late_price", F.lit(0.0)) - 1) * 100
    return rows.select("call_id", "horizon", "entry_s", (F.col("entry_s") + 60).alias("late_s"), (F.col("entry_s") + F.col("s")).alias("due_s"), F.col("late_price").alias("entry_late"), gain.alias("peak_gain_pct"), "rugged", "rug_s")


ROWS = f"""rows AS (SELECT l.call_id, horizon, entry_t // {S} AS entry_s, entry_t // {S} + 60 AS late_s, entry_t // {S} + s AS due_s, late_price AS entry_late, l.call_id % 7 = 0 AS rugged,
      (SELECT {RUG_S} FROM (SELECT l.call_id AS call_id, l.entry_t // {S} AS entry_s)) AS rug_s, token, late_t FROM late l CROSS JOIN (VALUES {HORIZON_VALUES}) h(horizon, s)),
  peaked AS (SELECT r.* EXCLUDE (token, late_t), (greatest(max(price), any_value(entry_late)) / nullif(any_value(entry_late), 0) - 1) * 100 AS peak_gain_pct
    FROM rows r LEFT JOIN trades t ON t.token = r.token AND t.t > late_t AND t.t <= {S} * CASE WHEN rugged AND rug_s IS NOT NULL THEN least(due_s, rug_s) ELSE due_s END GROUP BY ALL)"""
TIMED = f"""{ROWS}, base AS (SELECT *, entry_s + 86400 AS day, greatest(CASE WHEN rugged THEN least(due_s, rug_s) ELSE due_s END, entry_s) AS stop, entry_late * (1 + peak_gain_pct / 100) AS peak, 2 * entry_late * (1 - 1e-9) AS two,
      CASE WHEN NOT coalesce(entry_late > 0, false) OR peak_gain_pct IS NULL THEN 'no late entry' WHEN rugged AND rug_s IS NULL THEN 'no rug time' END AS refused FROM peaked),
  segs AS (SELECT b.*, interval_s, bucket_s AS st, high, close, bucket_s < late_s AS straddle, CASE interval_s WHEN 300 THEN least(bucket_s + 300, day) ELSE bucket_s + 3600 END AS e,
      CASE WHEN bucket_s < late_s THEN greatest(bucket_s, CASE interval_s WHEN 300 THEN entry_s ELSE day END, late_s) ELSE greatest(bucket_s, CASE interval_s WHEN 300 THEN entry_s ELSE day END) END AS s
    FROM base b JOIN candles c ON c.call_id = b.call_id AND refused IS NULL AND bucket_s + interval_s > late_s AND ((interval_s = 300 AND bucket_s < day) OR (interval_s = 3600 AND stop > day AND bucket_s + 3600 > day))),
  nth AS (SELECT *, row_number() OVER (PARTITION BY call_id, horizon ORDER BY interval_s, st) AS i FROM segs WHERE s < stop),
  marks AS (SELECT call_id, horizon, coalesce(min(i) FILTER (abs(high - peak) <= 1e-9 * peak AND NOT straddle), min(i) FILTER (abs(high - peak) <= 1e-9 * peak), min(i) FILTER (high >= peak * (1 - 1e-9) AND NOT straddle), min(i) FILTER (high >= peak * (1 - 1e-9))) AS peak_i,
      coalesce(min(i) FILTER (high >= two AND NOT straddle), min(i) FILTER (high >= two)) AS two_i, max(i) FILTER (straddle) AS straddle_i FROM nth GROUP BY 1, 2),
  placed AS (SELECT b.*, peak_i, peak <= entry_late * (1 + 1e-9) AS at_entry, peak >= two AS reached, CASE WHEN peak >= two THEN CASE WHEN peak > entry_late * (1 + 1e-9) AND peak_i = straddle_i THEN peak_i ELSE two_i END END AS first_i FROM base b LEFT JOIN marks USING (call_id, horizon)),
  steps AS (SELECT n.call_id, n.horizon, n.close >= n.two AS above, e, coalesce(lead(e) OVER (PARTITION BY n.call_id, n.horizon ORDER BY i), n.stop) AS until FROM nth n JOIN placed p ON p.call_id = n.call_id AND p.horizon = n.horizon AND i >= first_i WHERE e <= n.stop),
  held AS (SELECT call_id, horizon, sum(CASE WHEN above THEN until - e ELSE 0 END) AS held, min(e) FILTER (NOT above) AS fall FROM steps GROUP BY 1, 2),
  timed AS (SELECT p.*, coalesce(p.refused, CASE WHEN (NOT at_entry AND peak_i IS NULL) OR (reached AND first_i IS NULL) THEN 'inconsistent' ELSE 'timed' END) AS outcome, x.s AS peak_s, y.s AS first_s, coalesce(held, 0) AS held, coalesce(fall, CASE WHEN p.rugged THEN p.stop END) AS fall
    FROM placed p LEFT JOIN held USING (call_id, horizon) LEFT JOIN nth x ON x.call_id = p.call_id AND x.horizon = p.horizon AND x.i = peak_i LEFT JOIN nth y ON y.call_id = p.call_id AND y.horizon = p.horizon AND y.i = first_i)"""
SOURCES = with_tables("price_events", "event_calls", "trades") + f", {LATE}, {c.CANDLES}, {TIMED}"


@query(SOURCES + """ SELECT call_id, horizon, outcome, CASE WHEN outcome = 'timed' THEN CASE WHEN at_entry THEN 0 ELSE peak_s - entry_s END END AS peak_late_after_s, CASE WHEN outcome = 'timed' AND reached THEN first_s - entry_s END AS first_2x_after_s,
  CASE WHEN outcome = 'timed' THEN CAST(held AS BIGINT) END AS above_2x_s, CASE WHEN outcome = 'timed' AND reached THEN fall - entry_s END AS fall_below_2x_after_s, CASE WHEN outcome = 'timed' THEN reached AND fall IS NULL END AS censored FROM timed""")
def all_horizon_timing(spark: SparkSession, sf: str) -> DataFrame:
    stored = candles.candles(d.trades(spark, sf).drop("ts"), d.calls_on_events(spark, sf))
    return timing.horizon_timing(horizon_rows(spark, sf), stored)


@query(SOURCES + f""", chosen AS (SELECT * FROM timed WHERE due_s <= {c.NOW_T} // {S} AND call_id % 3 > 0)
  SELECT count(*) AS horizons, count(DISTINCT call_id) AS calls, count(*) FILTER (outcome = 'timed') AS written, count(*) FILTER (outcome = 'no rug time') AS no_rug_time, count(*) FILTER (outcome = 'inconsistent') AS inconsistent, count(*) FILTER (outcome = 'no late entry') AS failed FROM chosen""")
def timing_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """A backfill of the due horizons of calls whose state kept candles (two in three)."""
    stored = candles.candles(d.trades(spark, sf).drop("ts"), d.calls_on_events(spark, sf))
    rows = written(horizon_rows(spark, sf).withColumns({"status": F.lit("done"), "timing_at": F.lit(None).cast("timestamp")}))
    states = rows.select("call_id", (F.col("call_id") % 3).alias("version")).distinct()
    chosen = timing.todo(rows, states, 1, c.NOW_T // S)
    return timing.counters(chosen, timing.horizon_timing(chosen, stored))
