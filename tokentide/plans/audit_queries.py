"""Queries over audits, holders and results from candles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import audits, candles, evaluation, holders
from tokentide.plans import call_queries as c
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.domain import with_tables
from tokentide.sources import tables

MONDAY = "strftime(date_trunc('week', message_date), '%Y-%m-%d')"


@query(with_tables("price_events", "event_calls", "trades") + f", {c.ENTRY}, {c.RETURNS} SELECT horizon, status, count(*) AS n FROM results GROUP BY 1, 2")
def horizon_status(spark: SparkSession, sf: str) -> DataFrame:
    return audits.horizon_status(c.results(spark, sf))


@query(with_tables("facts") + """ SELECT tracking_status, count(*) AS n, count(*) FILTER (later) AS later, count(*) FILTER (later AND ret_late_7d IS NOT NULL) AS later_with_result FROM (
  SELECT *, row_number() OVER (PARTITION BY token ORDER BY message_date, call_id) > 1 AS later FROM facts WHERE post_kind IS DISTINCT FROM 'update') GROUP BY 1""")
def later_calls(spark: SparkSession, sf: str) -> DataFrame:
    return audits.later_calls(d.facts(spark, sf))


@query(with_tables("facts") + " SELECT rug_kind, count(*) AS rugged, count(*) FILTER (ret_late_30d > -90) AS conflicts FROM facts WHERE rugged GROUP BY 1")
def rug_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return audits.rug_conflicts(d.facts(spark, sf))


@query(with_tables("facts") + f" SELECT {MONDAY} AS week, count(*) AS n, count(*) FILTER (trades_24h < 50) AS dead, count(*) FILTER (dex ILIKE '%uniswap%') AS n_named, count(*) FILTER (dex ILIKE '%uniswap%' AND trades_24h < 50) AS dead_named FROM facts WHERE trades_24h IS NOT NULL GROUP BY 1")
def dead_by_week(spark: SparkSession, sf: str) -> DataFrame:
    return audits.dead_by_week(d.facts(spark, sf), 50, "uniswap")


@query(with_tables("facts") + ' SELECT dex, count(*) AS n, min(message_date) AS "first", max(message_date) AS "last" FROM facts GROUP BY 1')
def posted_names(spark: SparkSession, sf: str) -> DataFrame:
    return audits.names(d.facts(spark, sf), "dex", "message_date")


@query(with_tables("facts") + """ SELECT problem, count(*) AS n FROM (SELECT CASE WHEN first_2x_s IS NULL AND above_2x_s > 0 THEN 'held without a touch' WHEN first_2x_s IS NULL AND fall_below_2x_s IS NOT NULL THEN 'fall without a touch'
  WHEN fall_below_2x_s < first_2x_s THEN 'fall before the touch' WHEN censored AND fall_below_2x_s IS NOT NULL THEN 'censored with a fall' END AS problem FROM facts) WHERE problem IS NOT NULL GROUP BY 1""")
def stale_timing(spark: SparkSession, sf: str) -> DataFrame:
    return audits.stale_timing(d.facts(spark, sf))


@query(with_tables("facts") + " SELECT tracking_status, count(*) AS n, count(*) FILTER (regexp_matches(entry_source, '^onchain-(v2|pons)$')) AS given_up FROM facts GROUP BY 1")
def given_up(spark: SparkSession, sf: str) -> DataFrame:
    return audits.given_up(d.facts(spark, sf), "entry_source", "^onchain-(v2|pons)$")


@query(with_tables("facts", "reports") + " SELECT call_id, token FROM facts WHERE message_date < TIMESTAMP '1998-01-01' AND NOT EXISTS (SELECT 1 FROM reports WHERE reports.call_id = facts.call_id)")
def stuck_calls(spark: SparkSession, sf: str) -> DataFrame:
    return audits.stuck(d.facts(spark, sf), d.reports(spark, sf), F.col("message_date") < F.lit("1998-01-01").cast("timestamp_ntz"))


@query("SELECT CASE WHEN v IS NULL THEN 'missing' WHEN v < 30 THEN 'low' WHEN v < 70 THEN 'middle' ELSE 'high' END AS kind, count(*) AS n, min(v) AS least, max(v) AS most FROM (SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events) GROUP BY 1")
def state_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audits.state_audit(d.read(spark, sf, "events"), "props", "k", (30, 70))


@query("WITH p AS (SELECT p_partkey AS asset, p_brand AS ticker, p_size > 45 AS good FROM part) SELECT asset, ticker, good, assets, any_good FROM p JOIN (SELECT ticker, count(DISTINCT asset) AS assets, bool_or(good) AS any_good FROM p GROUP BY 1) USING (ticker)")
def feed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = d.read(spark, sf, "part").select(F.col("p_partkey").alias("asset"), F.col("p_brand").alias("ticker"), "p_size")
    return audits.feed_pairs(pairs, "ticker", "asset", F.col("p_size") > 45)


RUNS = "runs AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS status, CASE WHEN o_orderstatus = 'O' THEN lower(substr(o_orderpriority, 3)) END AS skip_reason, o_orderkey % 97 AS requests FROM orders)"


@query(f"WITH {RUNS} SELECT (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT coalesce(status, 'none') || ':' || coalesce(skip_reason, '-') || ':' || count(*) AS x FROM runs GROUP BY status, skip_reason)) AS counts, count(*) AS n, CAST(sum(requests) AS BIGINT) AS requests, quantile_disc(requests, 0.5) AS median, quantile_disc(requests, 0.9) AS p90, max(requests) AS most FROM runs")
def run_record(spark: SparkSession, sf: str) -> DataFrame:
    o = d.read(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    return tables.run_record(o.select(status.alias("status"), F.when(F.col("o_orderstatus") == "O", F.lower(F.expr("substr(o_orderpriority, 3)"))).alias("skip_reason"), (F.col("o_orderkey") % 97).alias("requests")))


MOVES = """moves AS (SELECT l_partkey AS token, l_orderkey AS tx, epoch_us(l_shipdate) // 86400000000 AS block, l_linenumber AS idx, CAST(l_quantity AS BIGINT) AS value,
    CASE l_returnflag WHEN 'A' THEN 'V' || (l_partkey % 3) ELSE 'w' || (l_suppkey % 50) END AS sender,
    CASE WHEN l_linenumber = 7 THEN '0x000000000000000000000000000000000000dEaD' WHEN l_returnflag = 'R' THEN 'v' || (l_partkey % 3) ELSE 'W' || ((l_suppkey + l_linenumber) % 50) END AS receiver FROM lineitem),
  lp AS (SELECT DISTINCT 'v' || (l_partkey % 3) AS venue, l_orderkey AS tx, l_linestatus = 'F' AS takes, l_linestatus = 'O' AS puts FROM lineitem WHERE l_linenumber = 1),
  kinds AS (SELECT m.*, lower(sender) AS s, lower(receiver) AS r, lower(sender) IN ('v0', 'v1', 'v2') AS fv, lower(receiver) IN ('v0', 'v1', 'v2') AS tv FROM moves m),
  sided AS (SELECT *, value > 0 AND fv AND NOT tv AND r <> 'w7' AND r <> '0x000000000000000000000000000000000000dead' AS buy, value > 0 AND tv AND NOT fv AND s <> 'w7' AS sell FROM kinds),
  traded AS (SELECT token, tx, block, idx, value, sender, receiver, CASE WHEN buy THEN CASE WHEN coalesce((SELECT bool_or(takes) FROM lp WHERE lp.venue = s AND lp.tx = sided.tx), false) THEN 'liquidity' ELSE 'buy' END
    WHEN sell THEN CASE WHEN coalesce((SELECT bool_or(puts) FROM lp WHERE lp.venue = r AND lp.tx = sided.tx), false) THEN 'liquidity' ELSE 'sell' END ELSE 'none' END AS kind, CASE WHEN buy THEN r WHEN sell THEN s END AS wallet FROM sided),
  bal AS (SELECT token, address, CAST(sum(v) AS BIGINT) AS balance FROM (SELECT token, lower(sender) AS address, -value AS v FROM moves UNION ALL SELECT token, lower(receiver), value FROM moves) WHERE address <> '0x000000000000000000000000000000000000dead' GROUP BY 1, 2)"""


def moves(spark: SparkSession, sf: str) -> DataFrame:
    line = d.read(spark, sf, "lineitem")
    name = lambda p, v: F.concat(F.lit(p), v.cast("string"))
    sender = F.when(F.col("l_returnflag") == "A", name("V", F.col("l_partkey") % 3)).otherwise(name("w", F.col("l_suppkey") % 50))
    receiver = F.when(F.col("l_linenumber") == 7, "0x000000000000000000000000000000000000dEaD").when(F.col("l_returnflag") == "R", name("v", F.col("l_partkey") % 3)).otherwise(name("W", (F.col("l_suppkey") + F.col("l_linenumber")) % 50))
    return line.select(F.col("l_partkey").alias("token"), F.col("l_orderkey").alias("tx"), F.expr("unix_micros(cast(l_shipdate as timestamp)) div 86400000000").alias("block"), F.col("l_linenumber").alias("idx"), F.col("l_quantity").cast("long").alias("value"), sender.alias("sender"), receiver.alias("receiver"))


def traded(spark: SparkSession, sf: str) -> DataFrame:
    line = d.read(spark, sf, "lineitem").where("l_linenumber = 1")
    lp = line.groupBy(F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string")).alias("venue"), F.col("l_orderkey").alias("tx")).agg(F.max(F.col("l_linestatus") == "F").alias("takes"), F.max(F.col("l_linestatus") == "O").alias("puts"))
    venues = spark.range(3).select(F.concat(F.lit("V"), F.col("id").cast("string")).alias("address"))
    excluded = spark.range(1).select(F.lit("W7").alias("address"))
    return holders.classify_trades(moves(spark, sf), venues, excluded, lp)


@query(f"WITH {MOVES} SELECT token, tx, block, idx, value, sender, receiver, kind, wallet FROM traded")
def classified_trades(spark: SparkSession, sf: str) -> DataFrame:
    return traded(spark, sf)


@query(f"WITH {MOVES}, f AS (SELECT token, min(block) AS first_block FROM traded WHERE kind = 'buy' GROUP BY 1), x AS (SELECT token, max(n) AS max_tx_buyers FROM (SELECT token, tx, count(DISTINCT wallet) AS n FROM traded WHERE kind = 'buy' GROUP BY 1, 2) GROUP BY 1), "
       "h AS (SELECT token, count(*) AS holders, round(max(balance) / sum(balance), 6) AS top1_share FROM bal WHERE balance > 0 GROUP BY 1) "
       "SELECT token, count(*) FILTER (kind = 'buy') AS buys, count(*) FILTER (kind = 'sell') AS sells, count(*) FILTER (kind = 'liquidity') AS liquidity, count(DISTINCT wallet) FILTER (kind = 'buy') AS buyers, count(DISTINCT wallet) FILTER (kind = 'sell') AS sellers, "
       "round(sum(value) FILTER (kind = 'sell') / sum(value) FILTER (kind = 'buy'), 6) AS sell_buy_ratio, count(DISTINCT wallet) FILTER (kind = 'buy' AND block = first_block) AS first_block_buyers, any_value(max_tx_buyers) AS max_tx_buyers, any_value(holders) AS holders, any_value(top1_share) AS top1_share "
       "FROM traded LEFT JOIN f USING (token) LEFT JOIN x USING (token) LEFT JOIN h USING (token) GROUP BY 1")
def holder_features(spark: SparkSession, sf: str) -> DataFrame:
    trades = tables.written(traded(spark, sf).select("token", "tx", "block", "value", "kind", "wallet"))  # read three times
    return holders.features(trades, holders.token_balances(moves(spark, sf), "token"), "token")


DEPLOYERS = "dep AS (SELECT p_partkey AS token, 'w' || (p_size % 50) AS deployer FROM part)"


@query(f"WITH {MOVES}, {DEPLOYERS} SELECT token, EXISTS (SELECT 1 FROM traded t WHERE t.token = dep.token AND lower(t.sender) = deployer AND t.value > 0 AND lower(t.receiver) <> deployer AND lower(t.receiver) <> '0x000000000000000000000000000000000000dead' AND t.kind <> 'liquidity') AS deployer_sold FROM dep")
def deployers_sold(spark: SparkSession, sf: str) -> DataFrame:
    deployers = d.read(spark, sf, "part").select(F.col("p_partkey").alias("token"), F.concat(F.lit("w"), (F.col("p_size") % 50).cast("string")).alias("deployer"))
    return holders.deployer_sold(traded(spark, sf), deployers, "token")


@query(f"WITH {MOVES}, w AS (SELECT DISTINCT token, wallet FROM traded WHERE kind = 'buy' AND idx <= 2) SELECT b.token, round(coalesce(sum(balance) FILTER (w.wallet IS NOT NULL), 0) / sum(balance), 6) AS held_share FROM bal b LEFT JOIN w ON w.token = b.token AND w.wallet = b.address WHERE balance > 0 GROUP BY 1")
def early_buyers_hold(spark: SparkSession, sf: str) -> DataFrame:
    early = traded(spark, sf).where("kind = 'buy' and idx <= 2").select("token", "wallet")
    return holders.held_share(holders.token_balances(moves(spark, sf), "token"), early, "token")


@query(f"WITH {MOVES} SELECT CASE WHEN block <= 9800 THEN 'pre' WHEN block <= 10200 THEN 'post' END AS phase, kind, count(*) AS n FROM traded GROUP BY 1, 2")
def trade_phases(spark: SparkSession, sf: str) -> DataFrame:
    return holders.phases(traded(spark, sf), "block", F.lit(9800), F.lit(10200)).groupBy("phase", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MOVES} SELECT venue, tx, kind, pool_id FROM (SELECT venue, tx, CASE WHEN tx % 4 = 0 THEN 'v4' ELSE 'v2' END AS kind, tx % 100 AS pool_id FROM lp) WHERE venue IN ('v0', 'v1') AND (kind <> 'v4' OR pool_id IN (SELECT p_partkey FROM part WHERE p_size > 25))")
def token_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    line = d.read(spark, sf, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string")).alias("venue"), F.col("l_orderkey").alias("tx"), (F.col("l_linestatus") == "F").alias("f")).distinct().drop("f")
    events = line.select("venue", "tx", F.when(F.col("tx") % 4 == 0, "v4").otherwise("v2").alias("kind"), (F.col("tx") % 100).alias("pool_id"))
    venues = spark.range(2).select(F.concat(F.lit("V"), F.col("id").cast("string")).alias("address"))
    return holders.liquidity_for(events, venues, d.read(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("pool_id")))


@query(with_tables("facts") + " SELECT call_id, CASE WHEN call_id % 19 = 0 THEN 'skipped:not in the list' WHEN entry_price IS NULL THEN 'skipped:no entry block' WHEN rug_kind IS NOT NULL THEN 'failed:' || rug_kind WHEN rugged THEN 'incomplete' ELSE 'done' END AS status FROM facts")
def holder_row_status(spark: SparkSession, sf: str) -> DataFrame:
    return d.facts(spark, sf).select("call_id", holders.row_status(F.col("call_id") % 19 != 0, F.col("entry_price"), F.col("rugged"), F.col("rug_kind")).alias("status"))


@query("SELECT o_orderkey AS call_id FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AND o_orderstatus <> 'F'")
def export_plan(spark: SparkSession, sf: str) -> DataFrame:
    o = d.read(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"), "o_custkey", "o_orderstatus")
    return holders.plan(o.where("call_id % 3 = 0"), o.where("o_custkey % 2 = 0"), o.where("o_orderstatus = 'F'"))


HOURS = "hours AS (SELECT token, CAST(floor(t / 3.6e9) AS BIGINT) * 3600 AS bucket_s, arg_min(price, (t, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (t, seq)) AS close FROM trades GROUP BY 1, 2)"
CANDLE_ENTRY = """centry AS (SELECT c.call_id, c.token, c.entry_t, coalesce(CASE WHEN c.entry_t // 1000000 - b.bucket_s <= 90000 AND b.close > 0 THEN b.close END, CASE WHEN a.bucket_s - c.entry_t // 1000000 <= 90000 AND a.open > 0 THEN a.open END) AS entry_price
    FROM event_calls c ASOF LEFT JOIN (SELECT *, bucket_s * 1000000 AS bt FROM hours) b ON b.token = c.token AND c.entry_t >= b.bt ASOF LEFT JOIN (SELECT *, bucket_s * 1000000 AS at FROM hours) a ON a.token = c.token AND c.entry_t < a.at)"""


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    return candles.token_candles(d.trades(spark, sf), 3600)


@query(with_tables("price_events", "event_calls", "trades") + f", {HOURS}, {CANDLE_ENTRY} SELECT * FROM centry")
def candle_entries(spark: SparkSession, sf: str) -> DataFrame:
    return candles.entry_from_candles(_hours(spark, sf), d.calls_on_events(spark, sf), 3600, 86400)


@query(with_tables("price_events", "event_calls", "trades") + f""", {HOURS}, {CANDLE_ENTRY}, r AS (SELECT e.call_id, h.horizon, any_value(e.entry_price) AS p, any_value((e.entry_t // 1000000 + h.s) * 1000000) AS due, arg_max(close, bucket_s) AS last,
    max(high) FILTER (bucket_s >= e.entry_t // 3600000000 * 3600) AS high, min(low) FILTER (bucket_s >= e.entry_t // 3600000000 * 3600 AND low > 0) AS low
    FROM centry e CROSS JOIN (VALUES {c.HORIZON_VALUES}) h(horizon, s) LEFT JOIN hours x ON x.token = e.token AND x.bucket_s < e.entry_t // 1000000 + h.s GROUP BY e.call_id, h.horizon),
  s AS (SELECT *, CASE WHEN due > {c.NOW_T} THEN 'pending' WHEN last IS NULL OR NOT coalesce(p > 0, false) THEN 'no_data' ELSE 'done' END AS status FROM r)
  SELECT call_id, horizon, status, CASE WHEN status = 'done' THEN round((last / p - 1) * 100, 6) END AS return_pct, CASE WHEN status = 'done' THEN round((coalesce(high, last) / p - 1) * 100, 6) END AS max_gain_pct, CASE WHEN status = 'done' THEN round((coalesce(low, last) / p - 1) * 100, 6) END AS max_drawdown_pct FROM s""")
def candle_returns(spark: SparkSession, sf: str) -> DataFrame:
    hours = tables.written(_hours(spark, sf))  # read four times
    entries = tables.written(candles.entry_from_candles(hours, d.calls_on_events(spark, sf), 3600, 86400))
    return candles.horizons_from_candles(hours, entries, c.NOW_T)


@query(with_tables("price_events", "trades") + f", {HOURS} SELECT token, bucket_s, round(open * u, 6) AS open, round(high * u, 6) AS high, round(low * u, 6) AS low, round(close * u, 6) AS close FROM (SELECT *, 1 + (bucket_s // 3600) % 10 / 10 AS u FROM hours WHERE (bucket_s // 3600) % 7 > 0)")
def usd_candles(spark: SparkSession, sf: str) -> DataFrame:
    hours = _hours(spark, sf).withColumn("quote", F.lit("weth"))
    rates = hours.select("quote", F.col("bucket_s").alias("hour_s"), (1 + F.expr("(bucket_s div 3600) % 10") / 10).alias("usd")).distinct().where("(hour_s div 3600) % 7 > 0")
    return candles.scaled(hours, rates, "quote").select("token", "bucket_s", *[F.round(x, 6).alias(x) for x in ("open", "high", "low", "close")])


@query(with_tables("price_events", "trades") + f", {HOURS} SELECT token, CAST(row_number() OVER (PARTITION BY token ORDER BY bucket_s) - 1 AS INT) AS pos, bucket_s, open, high, low, close FROM hours WHERE (bucket_s // 3600) % 5 > 0")
def listed_candles(spark: SparkSession, sf: str) -> DataFrame:
    """Candles that arrive as arrays of numbers, some of them cut off."""
    cell = F.array(F.col("bucket_s").cast("double"), "open", "high", "low", "close")
    arrays = _hours(spark, sf).groupBy("token").agg(F.collect_list(F.when(F.expr("(bucket_s div 3600) % 5 > 0"), cell).otherwise(F.slice(cell, 1, 3))).alias("cells"))
    return candles.from_arrays(arrays, "cells")


@query(with_tables("price_events", "event_calls") + f" SELECT call_id, round(buy_vol_60m * coalesce(u, 1), 4) AS buy_vol_60m, CASE WHEN u IS NOT NULL THEN 'usd' ELSE 'quote' END AS vol_unit FROM (SELECT *, CASE WHEN call_id % 3 > 0 THEN 1.5 END AS u FROM ({c.PRECALL}))")
def usd_precall(spark: SparkSession, sf: str) -> DataFrame:
    pre = candles.precall(d.pool_activity(spark, sf), d.calls_on_events(spark, sf))
    return candles.scaled_precall(pre, F.when(F.col("call_id") % 3 > 0, 1.5)).select("call_id", "buy_vol_60m", "vol_unit")


@query(with_tables("price_events", "event_calls", "trades") + f", {c.ENTRY}, {c.RETURNS} SELECT call_id, horizon FROM results WHERE status = 'done' AND NOT (horizon = '7d' AND call_id % 2 = 0)")
def timing_todo(spark: SparkSession, sf: str) -> DataFrame:
    found = tables.written(c.results(spark, sf))
    return candles.timing_todo(found, found.where("horizon = '7d' and call_id % 2 = 0"))


BACK = 180 * 86400 * 1_000_000


@query(with_tables("calls", "buys", "returns") + f""", {c.LABELS}, {c.PAIRS}, known AS (SELECT p.wallet, p.token, p.t + 626400000000 AS at, l.runner FROM pairs p JOIN labels_ l USING (call_id) WHERE l.runner IS NOT NULL)
  SELECT p.call_id, p.wallet, count(k.runner) AS n, CAST(coalesce(sum(k.runner), 0) AS BIGINT) AS ran FROM pairs p LEFT JOIN known k ON k.wallet = p.wallet AND k.token <> p.token AND k.at < p.t AND k.at >= p.t - {BACK} GROUP BY 1, 2""")
def recent_wallet_history(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.wallet_history(d.live_buys(spark, sf), d.calls(spark, sf), c.bucket_labels(spark, sf), c.DELAY, BACK)


@query(with_tables("calls", "buys", "returns") + f""", {c.LABELS}, {c.PAIRS}, {c.WALLETS}, k AS (SELECT call_id, count(*) FILTER (n > 0) AS known FROM hist GROUP BY 1)
  SELECT {MONDAY} AS week, count(*) AS calls, count(*) FILTER (known > 0) AS covered, round(avg(known), 6) AS mean_known FROM calls JOIN k USING (call_id) GROUP BY 1""")
def wallet_coverage(spark: SparkSession, sf: str) -> DataFrame:
    history = evaluation.wallet_history(d.live_buys(spark, sf), d.calls(spark, sf), c.bucket_labels(spark, sf), c.DELAY)
    return evaluation.wallet_coverage(history, d.calls(spark, sf))


@query("SELECT c_custkey AS id, CASE WHEN length(c_name) > 0 AND c_custkey % 4 > 0 THEN lower(left(c_name, 4)) || lower(right(c_name, 4)) END AS wallet FROM customer")
def wallet_keys(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.when(F.col("c_custkey") % 4 > 0, F.expr("right(c_name, 4)")).otherwise("")
    return d.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), evaluation.wallet_key(F.expr("left(c_name, 4)"), suffix).alias("wallet"))
