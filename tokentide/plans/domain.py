"""Domain tables (calls, price events, returns, live buys, verdicts, transfers) as projections of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Horizons and their seconds, shortest first.
HORIZONS = {"1h": 3600, "1d": 86400, "3d": 259200, "7d": 604800, "30d": 2592000}
#: The moment that "now" is in queries over the price events, which end on 2024-01-30.
NOW = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, read as UTC; fractions kept to the microsecond, as a long of µs."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def address(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number)), 40, "0"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per posted call: id, token, time, kind (null reads as a call)."""
    o = read(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") == "5-LOW", None).when(F.col("o_orderstatus") == "P", "update").otherwise("call")
    return o.select(F.col("o_orderkey").alias("call_id"), address(F.col("o_custkey")).alias("token"), F.col("o_orderdate").alias("message_date"), kind.alias("post_kind"), "o_totalprice")


def price_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("token"), "ts", seconds("ts").alias("t"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("value").alias("price"))


def pool_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All price events with the side that a trade has, and its amount."""
    side = F.when(F.col("kind") == "purchase", "buy").when(F.col("kind") == "click", "sell")
    return price_events(spark, sf_dir).select("token", "t", "seq", "price", side.alias("side"), F.col("price").alias("amount"))


def calls_on_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_events(spark, sf_dir).where("kind = 'signup'").select(F.col("seq").alias("call_id"), "token", F.col("ts").alias("entry_at"), F.col("t").alias("entry_t"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price events that are trades of a usable price."""
    return price_events(spark, sf_dir).where("kind in ('view', 'click', 'purchase') and price > 0")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per call and horizon: return in percent, tax in percent; repeated rows collapse to the largest."""
    names = list(HORIZONS)
    line = read(spark, sf_dir, "lineitem")
    horizon = F.element_at(F.array(*map(F.lit, names)), F.pmod(F.col("l_linenumber") - 1, F.lit(len(names))).cast("int") + 1)
    return (
        line.groupBy(F.col("l_orderkey").alias("call_id"), horizon.alias("horizon"))
        .agg(F.max(F.round((F.col("l_discount") - 0.05) * 2000, 6)).alias("return_pct"), F.max(F.round(F.col("l_tax") * 100, 6)).alias("tax_pct"))
    )


def live_buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    tier = F.when(F.col("l_returnflag") == "A", "elite").when(F.col("l_returnflag") == "R", "good").otherwise(None)
    return line.select(F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("wallet"), F.col("l_extendedprice").alias("amount_usd"), tier.alias("tier"))


def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("kind") == "view", "clean").when(F.col("kind") == "click", "caution").otherwise("red_flags")
    return price_events(spark, sf_dir).where("kind in ('view', 'click', 'error')").select(F.col("seq").alias("id"), "token", F.col("t").alias("requested_t"), level.alias("verdict"))


#: The same projections for the SQL that results are held against.
SQL = {
    "calls": """calls AS (SELECT o_orderkey AS call_id, printf('0x%040x', o_custkey) AS token, o_orderdate AS message_date,
      CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'P' THEN 'update' ELSE 'call' END AS post_kind, o_totalprice FROM orders)""",
    "price_events": """price_events AS (SELECT user_id AS token, ts, epoch_us(ts) AS t, event_id AS seq, event_type AS kind, value AS price FROM events)""",
    "event_calls": """event_calls AS (SELECT seq AS call_id, token, ts AS entry_at, t AS entry_t FROM price_events WHERE kind = 'signup')""",
    "trades": """trades AS (SELECT * FROM price_events WHERE kind IN ('view', 'click', 'purchase') AND price > 0)""",
    "returns": """returns AS (SELECT l_orderkey AS call_id, ['1h', '1d', '3d', '7d', '30d'][(l_linenumber - 1) % 5 + 1] AS horizon,
      max(round((l_discount - 0.05) * 2000, 6)) AS return_pct, max(round(l_tax * 100, 6)) AS tax_pct FROM lineitem GROUP BY 1, 2)""",
    "buys": """buys AS (SELECT l_orderkey AS call_id, l_suppkey AS wallet, l_extendedprice AS amount_usd,
      CASE l_returnflag WHEN 'A' THEN 'elite' WHEN 'R' THEN 'good' END AS tier FROM lineitem)""",
    "inv": """inv AS (SELECT seq AS id, token, t AS requested_t, CASE kind WHEN 'view' THEN 'clean' WHEN 'click' THEN 'caution' ELSE 'red_flags' END AS verdict
      FROM price_events WHERE kind IN ('view', 'click', 'error'))""",
}


def with_tables(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)


#: One row per posted call with what is known of it, as a projection of orders and their lines, for the label, feature,
#: split and list queries. Plain SQL that Spark and other engines read alike.
FACTS = """SELECT o.o_orderkey AS call_id, o.o_custkey AS token, o.o_orderdate AS message_date,
    CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL WHEN o.o_orderstatus = 'P' THEN 'update' ELSE 'call' END AS post_kind,
    CASE o.o_orderkey % 11 WHEN 0 THEN 'no_pool' WHEN 1 THEN 'repeat' WHEN 2 THEN 'tracking' WHEN 3 THEN 'gave_up' WHEN 4 THEN NULL ELSE 'done' END AS tracking_status,
    CASE WHEN o.o_orderkey % 9 = 4 THEN 'weth' ELSE 'usd' END AS price_unit,
    o.o_orderkey % 13 = 5 AS rugged,
    CASE o.o_orderkey % 39 WHEN 5 THEN 'event' WHEN 18 THEN 'price' WHEN 31 THEN 'at_call' END AS rug_kind,
    CASE WHEN o.o_orderkey % 17 <> 3 THEN o.o_totalprice / 1000000 END AS entry_price,
    CASE WHEN o.o_orderkey % 17 <> 3 AND o.o_orderkey % 23 <> 2 THEN o.o_totalprice * 1.02 / 1000000 END AS entry_late_price,
    CASE WHEN o.o_orderkey % 14 <> 3 THEN o.o_totalprice * (o.o_orderkey % 7) / 2000000 END AS latest_price,
    CASE o.o_orderkey % 5 WHEN 0 THEN 'onchain-v2' WHEN 1 THEN 'onchain-v3' WHEN 2 THEN 'minute' WHEN 4 THEN 'onchain-pons' END AS entry_source,
    CASE WHEN o.o_orderkey % 6 > 0 THEN o.o_totalprice * 3 END AS mcap_usd,
    CASE WHEN o.o_orderkey % 8 > 0 THEN o.o_totalprice * 2 END AS called_at_mcap_usd,
    o.o_totalprice * (o.o_orderkey % 4) AS liq_usd,
    CASE WHEN o.o_orderkey % 10 > 2 THEN o.o_totalprice * 1000 END AS token_supply,
    CASE WHEN o.o_orderkey % 7 > 0 THEN CAST(o.o_orderkey % 7 AS DOUBLE) END AS tax_buy_pct,
    CASE WHEN o.o_orderkey % 10 > 0 THEN CAST(o.o_orderkey % 10 AS DOUBLE) END AS tax_sell_pct,
    CASE o.o_orderkey % 8 WHEN 0 THEN 'Uniswap V3' WHEN 1 THEN 'uniswap_v2' WHEN 2 THEN 'Pons V2' WHEN 3 THEN 'Flap Stocks' WHEN 4 THEN ' O1 Rwa ' WHEN 5 THEN NULL WHEN 6 THEN 'Orbofi' ELSE 'UniswapV4' END AS dex,
    CASE WHEN o.o_orderkey % 12 <> 7 THEN (o.o_orderkey * 37) % 400 END AS trades_24h,
    CASE o.o_orderkey % 6 WHEN 0 THEN 'clean' WHEN 1 THEN 'caution' WHEN 2 THEN 'red_flags' WHEN 3 THEN 'insufficient' WHEN 4 THEN NULL ELSE 'unknown' END AS verdict,
    (o.o_orderkey * 7) % 23 AS pre_buys, (o.o_orderkey * 5) % 19 AS pre_sells,
    CASE WHEN o.o_orderkey % 3 > 0 THEN CAST((o.o_orderkey * 11) % 500 AS DOUBLE) END AS pre_buy_vol, CAST((o.o_orderkey * 13) % 300 AS DOUBLE) AS pre_sell_vol,
    x.elite_usd, x.good_usd,
    x.ret_late_1h, x.ret_late_1d, x.ret_late_3d, x.ret_late_7d, x.ret_late_30d, x.max_gain_late_1h, x.max_gain_late_1d, x.max_gain_late_3d, x.max_gain_late_7d, x.max_gain_late_30d,
    x.above_2x_s, x.first_2x_s, x.fall_below_2x_s, x.censored
  FROM {orders} o LEFT JOIN (
    SELECT call_id, max(elite) AS elite_usd, max(good) AS good_usd,
      max(CASE WHEN h = 0 THEN ret END) AS ret_late_1h, max(CASE WHEN h = 1 THEN ret END) AS ret_late_1d, max(CASE WHEN h = 2 THEN ret END) AS ret_late_3d,
      max(CASE WHEN h = 3 THEN ret END) AS ret_late_7d, max(CASE WHEN h = 4 THEN ret END) AS ret_late_30d,
      max(CASE WHEN h = 0 THEN peak END) AS max_gain_late_1h, max(CASE WHEN h = 1 THEN peak END) AS max_gain_late_1d, max(CASE WHEN h = 2 THEN peak END) AS max_gain_late_3d,
      max(CASE WHEN h = 3 THEN peak END) AS max_gain_late_7d, max(CASE WHEN h = 4 THEN peak END) AS max_gain_late_30d,
      max(CASE WHEN h = 3 THEN held END) AS above_2x_s, max(CASE WHEN h = 3 THEN first_2x END) AS first_2x_s, max(CASE WHEN h = 3 THEN fall END) AS fall_below_2x_s, max(CASE WHEN h = 3 THEN cens END) = 1 AS censored
    FROM (SELECT l_orderkey AS call_id, (l_linenumber - 1) % 5 AS h,
        CASE WHEN l_quantity >= 50 AND l_discount >= 0.1 THEN 200000.0 ELSE greatest(-100.0, round((l_discount - 0.04) * 2500 + (l_tax - 0.04) * 500, 4)) END AS ret,
        CASE WHEN l_quantity >= 50 AND l_discount >= 0.1 THEN 200000.0 ELSE greatest(0.0, round((l_discount - 0.04) * 2500 + (l_tax - 0.04) * 500, 4)) + l_quantity * 3 END AS peak,
        CAST(l_quantity * 150 AS BIGINT) AS held, CASE WHEN l_discount >= 0.05 THEN CAST(floor(l_extendedprice) AS BIGINT) % 500000 END AS first_2x,
        CASE WHEN l_tax < 0.06 THEN CAST(floor(l_extendedprice) AS BIGINT) % 500000 + CAST(l_quantity * 100 AS BIGINT) END AS fall, CASE WHEN l_linestatus = 'F' AND l_tax >= 0.06 THEN 1 ELSE 0 END AS cens,
        CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS elite, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS good
      FROM {lineitem}) l GROUP BY call_id) x ON x.call_id = o.o_orderkey"""
SQL["facts"] = "facts AS (" + FACTS.format(orders="orders", lineitem="lineitem") + ")"


def facts(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Facts of all calls, or of those whose call_id is in ids."""
    orders = read(spark, sf_dir, "orders")
    if ids is not None:
        orders = orders.join(ids, orders["o_orderkey"] == ids["call_id"], "left_semi")
    return spark.sql(FACTS, orders=orders, lineitem=read(spark, sf_dir, "lineitem"))


#: One row per answer of a report tool to a call, as a projection of conversations and orders. Plain SQL as above.
REPORTS = """SELECT c.id, o.o_custkey AS token, CASE WHEN c.id % 4 > 0 THEN o.o_orderkey END AS call_id, o.o_orderdate AS posted_at,
    CASE WHEN c.id % 2 = 0 THEN 'gate' ELSE 'second' END AS tool,
    CASE c.id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'timeout' WHEN 2 THEN 'rate_limited' ELSE 'completed' END AS status,
    CASE c.id % 5 WHEN 0 THEN 'rescan' WHEN 1 THEN 'reask' ELSE 'live' END AS scan_kind,
    CASE WHEN c.id * 5 % 11 < 2 THEN 'clean' WHEN c.id * 5 % 11 < 4 THEN 'caution' WHEN c.id * 5 % 11 < 5 THEN 'red_flags' WHEN c.id * 5 % 11 < 8 THEN 'insufficient' WHEN c.id * 5 % 11 < 10 THEN 'unknown' END AS verdict_level,
    CASE c.id % 9 WHEN 0 THEN '' WHEN 1 THEN ' Not enough PUBLIC signals yet' WHEN 2 THEN 'too little liquidity to say more ' WHEN 3 THEN NULL ELSE c.text END AS report_text,
    CASE c.id % 3 WHEN 0 THEN 'see https://reports.example/r/0123456789abcdef0123456789ABCDEF?x=1' WHEN 1 THEN 'https://reports.example/none' END AS link,
    788918400000000 + c.id * 3700000000 AS requested_t, c.id % 11 = 0 AS delivered
  FROM (SELECT conv_id * 8 + turn AS id, text FROM {conversations}) c JOIN {orders} o ON o.o_orderkey = c.id"""
SQL["reports"] = "reports AS (" + REPORTS.format(orders="orders", conversations="conversations") + ")"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPORTS, orders=read(spark, sf_dir, "orders"), conversations=read(spark, sf_dir, "conversations"))
