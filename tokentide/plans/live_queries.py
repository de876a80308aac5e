"""Live scores by bucket, posts without a kind, blocks of two chains, depth and periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import live_model, windows
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.chain_queries import DECODED, LOGS, decoded
from tokentide.plans.domain import with_tables


LIVE = """live AS (SELECT call_id, message_date AS t, CASE WHEN call_id % 2 = 0 THEN 'short' ELSE 'medium' END AS bucket, 'v' || (call_id * 7 % 3) AS version, call_id % 3 > 0 AS passed, CASE WHEN call_id % 9 > 0 THEN (call_id * 37 % 1000) / 10.0 END AS rank,
    CASE WHEN call_id % 2 = 0 THEN max_gain_late_1d ELSE ret_late_7d END AS x, CASE WHEN call_id % 2 = 0 THEN ret_late_1d ELSE ret_late_7d END AS ret FROM facts WHERE tracking_status IS NOT NULL)"""


@query(with_tables("facts") + f""", {LIVE}, j AS (SELECT *, x IS NOT NULL AND ret IS NOT NULL AS known, x IS NOT NULL AND ret IS NOT NULL AND coalesce(rank >= 90, false) AS top, CASE WHEN bucket = 'short' THEN x >= 100 ELSE x >= 50 END AS hit, least(ret, 1000) AS r FROM live),
  s AS (SELECT bucket, count(*) AS scored, count(*) FILTER (known) AS known, count(*) FILTER (top) AS top_n, count(*) FILTER (top AND hit) AS top_k, round(avg(r) FILTER (top), 6) AS top_mean, count(*) FILTER (known AND hit) AS all_k, round(avg(r) FILTER (known), 6) AS all_mean, min(t) AS first_t FROM j GROUP BY 1),
  v AS (SELECT bucket, version, count(*) AS version_n, min((t, call_id)) AS first, arg_min(passed, (t, call_id)) AS passed FROM live GROUP BY 1, 2), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY version_n DESC, first) = 1)
  SELECT s.*, round((top_k / nullif(top_n, 0)) / nullif(all_k / known, 0), 6) AS lift, version, version_n, passed FROM s JOIN b USING (bucket)""")
def live_bucket_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(f"WITH {LIVE.replace('FROM facts', 'FROM {facts}').replace(chr(39) + 'v' + chr(39) + ' || (call_id * 7 % 3)', 'concat(' + chr(39) + 'v' + chr(39) + ', call_id * 7 % 3)')} SELECT * FROM live", facts=d.facts(spark, sf))
    return live_model.live_bucket_stats(rows, ["bucket"], F.when(F.col("bucket") == "short", F.col("x") >= 100).otherwise(F.col("x") >= 50))


TEXTS = "CASE o_orderkey % 5 WHEN 0 THEN '$X hit ' || o_orderkey % 9 || 'x' WHEN 1 THEN '$X hit 2.5x' WHEN 2 THEN 'call body saying hit 3x' || chr(10) || 'Mcap $52k, Liq $20k' WHEN 3 THEN 'hit 3xyz' ELSE ' ' END"


@query(f"""WITH p AS (SELECT o_orderkey, {TEXTS} AS t FROM orders WHERE o_orderpriority = '5-LOW'), k AS (SELECT o_orderkey % 5 <= 1 AS upd FROM p)
  SELECT count(*) FILTER (NOT upd) AS calls, count(*) FILTER (upd) AS updates FROM k""")
def classified_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts without a kind, by what their text says."""
    o = d.read(spark, sf, "orders")
    text = F.expr(TEXTS.replace("|| o_orderkey % 9 ||", "|| cast(o_orderkey % 9 as string) ||"))
    return live_model.classified_counts(o.select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", "call").alias("post_kind"), text.alias("message_text")))


BLOCKS = "mine AS (SELECT o_custkey % 5 AS chain, o_orderkey AS block, epoch_us(o_orderdate) // 1000000 + o_orderkey % 1000 AS t FROM orders), other AS (SELECT l_suppkey % 5 AS chain, l_orderkey * 10 + l_linenumber AS block, epoch_us(l_shipdate) // 1000000 + l_partkey % 900 AS t FROM lineitem)"


@query(f"""WITH {BLOCKS}, x AS (SELECT m.*, (SELECT max((o.t, o.block)) FROM other o WHERE o.chain = m.chain AND o.t <= m.t) AS f FROM mine m)
  SELECT chain, block, t, CASE WHEN t - f[1] <= 600 THEN f[2] END AS other_block, CASE WHEN t - f[1] <= 600 THEN f[1] END AS other_t FROM (SELECT chain, block, t, [struct_extract_at(f, 1), struct_extract_at(f, 2)] AS f FROM x)""")
def aligned_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Each block with the other chain's block of the same moment."""
    sec = lambda c: F.expr(f"unix_micros(cast({c} as timestamp)) div 1000000")
    mine = d.read(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("chain"), F.col("o_orderkey").alias("block"), (sec("o_orderdate") + F.col("o_orderkey") % 1000).alias("t"))
    other = d.read(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("chain"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block"), (sec("l_shipdate") + F.col("l_partkey") % 900).alias("t"))
    return live_model.aligned_blocks(mine, other)


@query(f"WITH {LOGS}, {DECODED} SELECT seq, token, round(2 * liq_q, 2) AS depth FROM priced WHERE liq_known")
def pool_depth(spark: SparkSession, sf: str) -> DataFrame:
    return decoded(spark, sf).where("liq_known").select("seq", "token", F.round(live_model.depth(F.col("liq_q")), 2).alias("depth"))


@query(with_tables("facts") + " SELECT strftime(date_trunc('month', message_date), '%Y-%m-%d') AS a, coalesce(verdict, 'Not given') AS b, count(*) AS n, round(avg(ret_late_7d), 6) AS mean FROM facts GROUP BY 1, 2")
def verdicts_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Period x verdict matrix."""
    month = F.date_format(live_model.period_start(F.col("message_date"), "month"), "yyyy-MM-dd")
    return windows.grid(d.facts(spark, sf), month, F.col("verdict"), F.col("ret_late_7d"))
