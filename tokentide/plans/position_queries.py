"""Queries over entries, extremes, pool ranks, launches, transfer logs, deliveries and display rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import positions
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.domain import HORIZONS, with_tables

LATE = """late AS (SELECT c.call_id, c.token, c.entry_t, c.entry_t + 60000000 AS late_t, arg_max(price, (t, seq)) FILTER (t <= entry_t + 60000000) AS late_price
  FROM event_calls c LEFT JOIN trades USING (token) GROUP BY 1, 2, 3)"""
HOUR = 3_600_000_000
HORIZON_VALUES = ", ".join(f"('{h}', {s})" for h, s in HORIZONS.items())


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return positions.late_entry(d.trades(spark, sf).drop("ts"), d.calls_on_events(spark, sf).drop("entry_at"))


@query(with_tables("price_events", "event_calls", "trades") + f", {LATE} SELECT call_id, late_price FROM late")
def late_entries(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select("call_id", "late_price")


@query(with_tables("price_events", "event_calls", "trades") + f""", {LATE}, usd AS (SELECT token, t, price * (1 + (t // {HOUR}) % 7 / 8.0) AS usd FROM trades WHERE (t // {HOUR}) % 11 <> 0)
  SELECT call_id, horizon, round(max(usd), 6)::DOUBLE AS high, round(min(usd), 6)::DOUBLE AS low, round(max(usd) FILTER (t > late_t), 6)::DOUBLE AS late_high, round(min(usd) FILTER (t > late_t), 6)::DOUBLE AS late_low
  FROM late JOIN usd USING (token) CROSS JOIN (VALUES {HORIZON_VALUES}) h(horizon, s) WHERE t > entry_t AND t <= entry_t + s::BIGINT * 1000000 GROUP BY 1, 2""")
def running_extremes(spark: SparkSession, sf: str) -> DataFrame:
    trades = d.trades(spark, sf).drop("ts")
    hours = trades.select(F.floor(F.col("t") / HOUR).alias("hour")).distinct()
    rates = hours.where("hour % 11 <> 0").select("hour", (1 + F.col("hour") % 7 / 8.0).cast("double").alias("rate"))
    found = positions.extremes(trades, entries(spark, sf), rates)
    return found.select("call_id", "horizon", *[F.round(c, 6).alias(c) for c in ("high", "low", "late_high", "late_low")])


@query(with_tables("price_events", "event_calls", "trades") + """ SELECT call_id, arg_max(kind, (t, kind = 'view', seq)) AS pool, round(arg_max(price * CASE kind WHEN 'view' THEN 2.5 ELSE 1 END, (t, kind = 'view', seq)), 6)::DOUBLE AS price_usd
  FROM event_calls LEFT JOIN (SELECT token, t // 86400000000 * 86400000000 AS t, seq, kind, price FROM trades) x ON x.token = event_calls.token AND t <= entry_t GROUP BY 1""")
def prices_via_pools(spark: SparkSession, sf: str) -> DataFrame:
    native = F.col("kind") == "view"
    trades = d.trades(spark, sf).select("token", F.expr("t div 86400000000 * 86400000000").alias("t"), "seq", F.col("kind").alias("pool"), "price", native.alias("native"), F.when(native, 2.5).otherwise(1.0).alias("quote_usd"))
    found = positions.price_via_pools(d.calls_on_events(spark, sf), trades, "entry_t")
    return found.select("call_id", "pool", F.round("price_usd", 6).alias("price_usd"))


@query("""SELECT token, pool, n_txs, row_number() OVER (PARTITION BY token ORDER BY n_txs DESC, pool) AS rank
  FROM (SELECT o_custkey AS token, l_suppkey AS pool, count(DISTINCT l_orderkey) AS n_txs FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)""")
def pool_ranks(spark: SparkSession, sf: str) -> DataFrame:
    pools = d.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pool"), F.col("l_orderkey").alias("tx"))
    return positions.rank_pools(pools, d.read(spark, sf, "orders").select(F.col("o_custkey").alias("token"), F.col("o_orderkey").alias("tx")))


@query("""SELECT l_partkey AS token, m[1] AS launch_block, o_custkey AS deployer, m[1] = 9000 AS capped FROM (
    SELECT l_partkey, min(row(epoch_us(l_shipdate) // 86400000000, l_linenumber, l_orderkey)) AS m FROM lineitem WHERE l_returnflag = 'N' AND epoch_us(l_shipdate) // 86400000000 >= 9000 GROUP BY 1)
  LEFT JOIN orders ON o_orderkey = m[3]""")
def launches(spark: SparkSession, sf: str) -> DataFrame:
    block = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 86400000000")
    mints = d.read(spark, sf, "lineitem").where("l_returnflag = 'N'").select(F.col("l_partkey").alias("token"), block.alias("block"), F.col("l_linenumber").alias("log_index"), F.col("l_orderkey").alias("tx"))
    return positions.launch(mints, d.read(spark, sf, "orders").select(F.col("o_orderkey").alias("tx"), F.col("o_custkey").alias("sender")), 9000)


@query("""SELECT l_orderkey, l_linenumber, ok AS valid, CASE WHEN ok THEN printf('0x%040x', l_suppkey) END AS sender, CASE WHEN ok THEN printf('0x%040x', l_partkey) END AS receiver,
  CASE WHEN ok THEN printf('%064x', CAST(l_quantity AS BIGINT)) END AS amount FROM (SELECT *, l_linenumber < 6 AS ok FROM lineitem)""")
def decoded_transfers(spark: SparkSession, sf: str) -> DataFrame:
    word = lambda c: F.lpad(F.lower(F.hex(F.col(c).cast("long"))), 64, "0")
    topic = lambda c: F.concat(F.lit("0x"), word(c))
    n = F.col("l_linenumber")
    topics = F.when(n == 6, F.array(F.lit("0xtransfer"), topic("l_suppkey"))).otherwise(F.array(F.lit("0xtransfer"), topic("l_suppkey"), topic("l_partkey")))
    data = F.concat(F.lit("0x"), word("l_quantity"), F.when(n == 7, "00").otherwise(""))
    logs = d.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", topics.alias("topics"), data.alias("data"))
    return positions.decode_transfers(logs).drop("topics", "data")


@query("""SELECT call_id, m[1] AS sent_day, m[2] AS attempt FROM (SELECT l_orderkey AS call_id, min(row(epoch_us(l_shipdate) // 86400000000, l_linenumber)) AS m FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)""")
def first_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    day = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 86400000000")
    rows = d.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call_id"), day.alias("sent_day"), F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") != "R").alias("sent"))
    return positions.first_delivery(rows, "call_id", ["sent_day", "attempt"])


@query(with_tables("price_events", "inv") + " SELECT verdict, count(*) FILTER (requested_t >= 1706572800000000) AS n_since, max(requested_t) AS newest FROM inv GROUP BY 1")
def verdict_stats(spark: SparkSession, sf: str) -> DataFrame:
    return positions.kind_stats(d.investigations(spark, sf), "verdict", "requested_t", F.lit(1706572800000000))


@query(with_tables("returns") + f""", due AS (SELECT o_orderkey AS call_id, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) + s AS due_s, horizon FROM orders CROSS JOIN (VALUES {HORIZON_VALUES}) h(horizon, s))
  SELECT call_id, min(due_s) FILTER (r.horizon IS NULL) AS next_s FROM due LEFT JOIN returns r USING (call_id, horizon) GROUP BY 1""")
def next_checks(spark: SparkSession, sf: str) -> DataFrame:
    calls = d.read(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"), F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000").alias("entry_s"))
    return positions.next_check(calls, d.returns(spark, sf))


@query("""SELECT o_orderkey AS call_id, CASE WHEN o_custkey % 6 > 0 AND o_orderstatus <> 'F' THEN o_totalprice END AS peak, CASE WHEN o_custkey % 6 > 0 AND o_orderkey % 4 > 0 THEN o_totalprice END AS latest FROM orders""")
def shown_rows(spark: SparkSession, sf: str) -> DataFrame:
    rug = F.when(F.col("o_orderstatus") == "F", "event").when(F.col("o_orderstatus") == "P", "price")
    rows = d.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("call_id"), F.when(F.col("o_custkey") % 6 > 0, "USD").otherwise("EUR").alias("currency"), rug.alias("rug_kind"), F.col("o_totalprice").alias("peak"), F.col("o_totalprice").alias("latest"),
        F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate")).alias("latest_at"),
    )
    return positions.display_rules(rows).select("call_id", "peak", "latest")
