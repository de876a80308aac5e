"""Queries over posts, reports, due rows and the state of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import candles, identity, posts, selection, verdicts
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.call_queries import CANDLES, ENTRY, FIRST, NOW_T
from tokentide.plans.domain import with_tables


def call_posts(spark: SparkSession, sf: str) -> DataFrame:
    """A call post for each order, written out from its columns."""
    o = d.read(spark, sf, "orders")
    whole = F.floor(F.col("o_totalprice")).cast("long")
    update = F.when(F.col("o_orderstatus") == "P", F.lit("$TKN hit 2.5x")).otherwise(
        F.concat(
            F.lit("$TKN"), F.col("o_custkey").cast("string"), F.lit(" called at $"), whole.cast("string"), F.lit("k\nMcap: $"), F.format_string("%,d", whole), F.lit(" Liq: $"), (whole % 1000).cast("string"), F.lit("k | "),
            (whole % 100).cast("string"), F.lit("%\nTax: B "), (F.col("o_orderkey") % 7).cast("string"), F.lit("% | S "), (F.col("o_orderkey") % 5).cast("string"), F.lit(".5%\nAge: "), (F.col("o_orderkey") % 9).cast("string"), F.lit("d "),
            (F.col("o_orderkey") % 23).cast("string"), F.lit("h\nHolders: "), F.format_string("%,d", F.col("o_custkey") * 3), F.lit("\n"), d.address(F.col("o_custkey")),
        )
    )
    return o.select(F.lit(1).cast("long").alias("channel_id"), F.col("o_orderkey").alias("message_id"), F.col("o_orderdate").alias("message_date"), update.alias("text"), F.array(F.concat(F.lit("https://scan.example/token/"), F.upper(d.address(F.col("o_custkey")))), F.lit("https://scan.example/tx/0x" + "ab" * 20)).alias("urls"))


@query("""SELECT o_orderkey AS message_id, CASE WHEN o_orderstatus = 'P' THEN 'TKN' ELSE 'TKN' || o_custkey END AS token_symbol,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) * 1000.0 END::DOUBLE AS called_at_mcap_usd, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice) END::DOUBLE AS mcap_usd,
  CASE WHEN o_orderstatus <> 'P' THEN (CAST(floor(o_totalprice) AS BIGINT) % 1000) * 1000.0 END::DOUBLE AS liq_usd, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) % 100 END::DOUBLE AS liq_pct,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 7 END::DOUBLE AS tax_buy_pct, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 5 + 0.5 END::DOUBLE AS tax_sell_pct,
  CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 9) * 86400 + (o_orderkey % 23) * 3600 END::BIGINT AS age_seconds, CASE WHEN o_orderstatus <> 'P' THEN o_custkey * 3 END::BIGINT AS holders,
  CASE o_orderstatus WHEN 'P' THEN 'update' ELSE 'call' END AS post_kind FROM orders""")
def parsed_posts(spark: SparkSession, sf: str) -> DataFrame:
    return posts.parse_metrics(call_posts(spark, sf)).drop("channel_id", "message_date", "urls")


@query("SELECT o_orderkey AS message_id, printf('0x%040x', o_custkey) AS address_key FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, printf('0x%040x', o_custkey) FROM orders WHERE o_orderstatus = 'P'")
def post_addresses(spark: SparkSession, sf: str) -> DataFrame:
    rows = call_posts(spark, sf).withColumn("urls", F.transform("urls", lambda u: F.regexp_replace(u, "0X", "0x")))
    return posts.extract_addresses(rows).select("message_id", "address_key")


@query("""SELECT l_orderkey AS message_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS position,
  CASE l_returnflag WHEN 'A' THEN 'elite' ELSE 'good' END AS tier, CAST(l_quantity AS DOUBLE) * 1000 AS amount_usd, printf('%04x', l_suppkey) AS wallet_prefix, printf('%04x', l_partkey % 65536) AS wallet_suffix FROM lineitem""")
def parsed_live_buys(spark: SparkSession, sf: str) -> DataFrame:
    line = d.read(spark, sf, "lineitem")
    text = F.concat(F.when(F.col("l_returnflag") == "A", "Elite").otherwise("Good"), F.lit(" $"), F.col("l_quantity").cast("long").cast("string"), F.lit("k "), F.format_string("%04x...%04x", "l_suppkey", F.col("l_partkey") % 65536))
    by_post = line.groupBy(F.col("l_orderkey").alias("message_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", text.alias("line")))).alias("lines"))
    return posts.live_buys(by_post.select("message_id", F.concat(F.lit("header\nLive buys\n"), F.array_join(F.col("lines.line"), "\n")).alias("text")))


@query(r"""SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\S') THEN 'insufficient' WHEN regexp_matches(' ' || regexp_replace(lower(text), '(^|[^0-9])0 that', '\1 ', 'g'), '[^\p{L}\p{N}]api') THEN 'red_flags'
  WHEN regexp_matches(' ' || regexp_replace(lower(text), '(^|[^0-9])0 that', '\1 ', 'g'), '[^\p{L}\p{N}]enthe') THEN 'caution' ELSE 'clean' END AS verdict FROM documents""")
def report_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return d.read(spark, sf, "documents").select("doc_id", posts.text_verdict(F.col("text"), "0 that", ["enthe"], ["api"]).alias("verdict"))


#: Markers and safe phrases of the query below, in lower case, and what a report says beside a document's text.
MARKERS, SAFE = ["red flag", "honeypot", "mintable", "scam", "caution", "\U0001f6a9"], ["no red flag", "honeypot: no", "0 warnings"]
SAID = "CASE doc_id % 11 WHEN 0 THEN ' 0 red flags' WHEN 1 THEN ' Red flags: 3' WHEN 2 THEN ' no red flags, honeypot' WHEN 3 THEN ' $ABC on-chain check: not enough data yet' WHEN 4 THEN ' non-mintable, honeypot: no' WHEN 5 THEN ' Caution!' WHEN 6 THEN ' No red flags found' WHEN 7 THEN ' \U0001f6a9' WHEN 8 THEN ' unmintable precaution' WHEN 9 THEN ' 20 warnings' ELSE '' END"
FOUND = lambda m: f"regexp_matches(' ' || rest, '[^\\p{{L}}\\p{{Nd}}]{m}')" if m.isascii() else f"contains(rest, '{m}')"


@query(rf"""WITH said AS (SELECT doc_id, lower(regexp_replace(text || {SAID}, '(?i)\b(?:0|zero)\s+red\s+flags?\b|\bred\s+flags?\s*:\s*(?:0|none|zero)\b', 'no red flags', 'g')) AS t, text || {SAID} AS text FROM documents),
  r AS (SELECT *, regexp_replace(regexp_replace(replace(replace(t, 'no red flag', ' '), 'honeypot: no', ' '), '(^|[^\p{{L}}\p{{Nd}}])0 warnings', '\1 ', 'g'), '(^|[^\p{{L}}\p{{Nd}}])non-', '\1nonx', 'g') AS rest FROM said),
  m AS (SELECT *, CASE {' '.join(f"WHEN {FOUND(m)} THEN '{m}'" for m in MARKERS)} END AS marker, CASE WHEN contains(t, 'no red flag') THEN 'clean' WHEN contains(t, 'red flag') THEN 'red_flags' WHEN contains(t, 'caution') OR contains(t, 'warning') THEN 'caution' WHEN contains(t, 'not enough data yet') THEN 'insufficient' ELSE 'unknown' END AS phrase FROM r),
  l AS (SELECT *, CASE WHEN phrase = 'insufficient' THEN phrase WHEN marker = 'caution' THEN 'caution' WHEN marker IS NOT NULL THEN 'red_flags' WHEN phrase = 'clean' THEN 'clean' ELSE 'unknown' END AS level FROM m)
  SELECT doc_id, level, CASE WHEN level = 'insufficient' THEN 'not enough data yet' WHEN marker IS NOT NULL THEN marker WHEN level = 'clean' THEN 'No red flags found' END AS label, CASE WHEN phrase = 'insufficient' THEN nullif(regexp_extract(text, '(?i)(\$[^\s$]+)\s+on-chain check', 1), '') END AS ticker FROM l""")
def text_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Level, label and ticker of every document's text with a report's words behind it."""
    rows = d.read(spark, sf, "documents").select("doc_id", F.expr(f"concat(text, {SAID})").alias("text"))
    return verdicts.text_verdict(rows, "text", MARKERS, SAFE).drop("text")


@query(r"SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return posts.page_titles(d.read(spark, sf, "pages"))


@query(with_tables("calls") + f", {FIRST} SELECT call_id, token, message_date, o_totalprice FROM firsts ORDER BY o_totalprice DESC NULLS LAST, call_id DESC LIMIT 50 OFFSET 20")
def ranked_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return selection.ranked(identity.first_calls(d.calls(spark, sf)).select("call_id", "token", "message_date", "o_totalprice"), "o_totalprice", "call_id", 50, 20)


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 100")
def due_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.read(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return selection.due(rows, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"), ["o_orderpriority", "o_orderdate", "o_orderkey"], 100)


@query(with_tables("price_events") + f" SELECT percentile_disc(0.95) WITHIN GROUP (ORDER BY greatest(0.0, ({NOW_T} - t) / 1e6)) AS lag_s, count(*) AS n FROM price_events")
def check_lag(spark: SparkSession, sf: str) -> DataFrame:
    return selection.lag_percentile(d.price_events(spark, sf), "t", NOW_T)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def never_called(spark: SparkSession, sf: str) -> DataFrame:
    done = d.read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return selection.without(d.read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), done, "c_custkey")


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'TOTAL' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS o_orderpriority,
  count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return selection.status_rollup(d.read(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")


@query(with_tables("price_events", "event_calls", "trades") + f", {CANDLES} SELECT DISTINCT call_id, CAST(floor(t / 3.6e9) * 3600 AS BIGINT) AS bucket_s FROM event_calls JOIN trades USING (token) WHERE t < entry_t AND t >= entry_t - 86400000000 AND (call_id, CAST(floor(t / 3.6e9) * 3600 AS BIGINT)) NOT IN (SELECT call_id, bucket_s FROM candles WHERE interval_s = 3600)")
def candle_gaps(spark: SparkSession, sf: str) -> DataFrame:
    calls, trades = d.calls_on_events(spark, sf), d.trades(spark, sf).drop("ts")
    day_before = calls.join(trades, "token").where("t < entry_t and t >= entry_t - 86400000000L").select("call_id", (F.floor(F.col("t") / 3.6e9) * 3600).cast("long").alias("hour_s"))
    return selection.candle_gaps(day_before, candles.candles(trades, calls))


@query(with_tables("price_events", "event_calls", "trades") + f", {ENTRY} SELECT strftime(date_trunc('week', c.entry_at), '%Y-%m-%d') AS week, count(*) AS n, count(e.entry_price) AS with_entry, count(*) FILTER (e.entry_source = 'after') AS late FROM event_calls c JOIN entries e USING (call_id) GROUP BY 1")
def weekly_coverage(spark: SparkSession, sf: str) -> DataFrame:
    calls = d.calls_on_events(spark, sf)
    entries = candles.entry_price(d.trades(spark, sf).drop("ts"), calls).select("call_id", "entry_price", "entry_source")
    week = F.date_format(F.date_trunc("week", F.col("entry_at")), "yyyy-MM-dd").alias("week")
    return calls.join(entries, "call_id").groupBy(week).agg(F.count(F.lit(1)).alias("n"), F.count("entry_price").alias("with_entry"), F.count_if(F.col("entry_source") == "after").alias("late"))


@query("SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'new' ELSE 'lang changed' END AS event FROM documents WHERE doc_id % 50 = 0 OR (doc_id % 7 = 0 AND lang IS DISTINCT FROM 'en')")
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    before = docs.where("doc_id % 50 <> 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "en").otherwise(F.col("lang")))
    return identity.diff_snapshots(before, docs, "doc_id", ["lang", "n_chars"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def upserted_balances(spark: SparkSession, sf: str) -> DataFrame:
    target = d.read(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    updates = target.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return identity.upsert(target, updates, ["c_custkey"])


@query(with_tables("price_events", "event_calls", "trades") + f", {CANDLES} SELECT call_id, interval_s, bucket_s, open, high, low, close, CAST(2 * events AS BIGINT) AS events FROM candles")
def merged_candles(spark: SparkSession, sf: str) -> DataFrame:
    one = candles.candles(d.trades(spark, sf).drop("ts"), d.calls_on_events(spark, sf))
    return candles.merge_candles(one, one)
