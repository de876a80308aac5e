"""Queries over the token list, answers of report tools, and the lanes that take rows up again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import identity, listing, pools
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.domain import with_tables

REAL = "('clean', 'caution', 'red_flags')"
DECLINED = r"coalesce(length(regexp_replace(report_text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) <= 300 AND (contains(lower(report_text), 'not enough public') OR contains(lower(report_text), 'too little liquidity')), false)"
FIRSTS = """firsts AS (SELECT *, CASE WHEN rugged THEN -100.0 ELSE round((latest_price / entry_price - 1) * 100, 6) END AS latest_return_pct FROM facts WHERE post_kind IS DISTINCT FROM 'update' QUALIFY row_number() OVER (PARTITION BY token ORDER BY message_date, call_id) = 1)"""
NOW_T = 1_000_000_000_000_000


def firsts(spark: SparkSession, sf: str) -> DataFrame:
    facts = d.facts(spark, sf)
    first = identity.first_calls(facts.withColumn("token", F.col("token").cast("string"))).select("call_id")
    return facts.join(first, "call_id", "left_semi").join(listing.latest_return(facts).select("call_id", "latest_return_pct"), "call_id")


def latest(tool: str, kind: str) -> str:
    return f"""(SELECT token, CASE WHEN verdict_level IN ('clean', 'caution', 'red_flags', 'insufficient') THEN verdict_level ELSE 'unknown' END AS verdict, requested_t FROM reports WHERE tool = '{tool}' AND status = 'completed' AND scan_kind = '{kind}'
    QUALIFY row_number() OVER (PARTITION BY token ORDER BY coalesce(verdict_level IN {REAL}, false) DESC, requested_t DESC, id DESC) = 1)"""


@query(with_tables("reports") + f" SELECT * FROM {latest('gate', 'live')}")
def latest_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return listing.latest_verdict(d.reports(spark, sf), "gate", "live")


BEST = f"""(SELECT token, id AS report, scan_kind, requested_t AS report_t FROM reports WHERE tool = 'second' AND status = 'completed' AND scan_kind IN ('live', 'reask') AND regexp_matches(report_text, '\\S')
    QUALIFY row_number() OVER (PARTITION BY token ORDER BY {DECLINED}, scan_kind <> 'live', requested_t DESC, id DESC) = 1)"""


@query(with_tables("reports") + f" SELECT * FROM {BEST}")
def best_reports(spark: SparkSession, sf: str) -> DataFrame:
    return listing.best_report(d.reports(spark, sf), "second")


VALUES = """vals AS (SELECT call_id, CASE WHEN price_unit = 'usd' THEN coalesce(CASE WHEN called_at_mcap_usd > 0 THEN called_at_mcap_usd END, CASE WHEN mcap_usd > 0 THEN mcap_usd END) END AS call_mcap,
    CASE WHEN price_unit = 'usd' AND latest_price > 0 AND entry_price > 0 THEN round(coalesce(CASE WHEN mcap_usd > 0 THEN mcap_usd END, CASE WHEN called_at_mcap_usd > 0 THEN called_at_mcap_usd END) * latest_price / entry_price, 3) END AS latest_mcap,
    CASE WHEN price_unit = 'usd' AND entry_price > 0 AND token_supply > 0 AND entry_price * token_supply <= 1e13 THEN round(entry_price * token_supply, 2) END AS supply_mcap FROM facts)"""


@query(with_tables("facts") + f", {VALUES} SELECT * FROM vals")
def market_values(spark: SparkSession, sf: str) -> DataFrame:
    return listing.market_values(d.facts(spark, sf))


@query(with_tables("facts") + " SELECT call_id, CASE WHEN rugged THEN -100.0 ELSE round((latest_price / entry_price - 1) * 100, 6) END AS latest_return_pct, rugged OR (latest_price IS NOT NULL AND entry_price IS NOT NULL) AS known FROM facts")
def latest_returns(spark: SparkSession, sf: str) -> DataFrame:
    return listing.latest_return(d.facts(spark, sf))


SHOWN = f"""CASE WHEN l.verdict IS NULL THEN t.verdict WHEN t.verdict IS NULL THEN l.verdict WHEN l.verdict IN {REAL} AND t.verdict NOT IN {REAL} THEN l.verdict WHEN t.verdict IN {REAL} AND l.verdict NOT IN {REAL} THEN t.verdict WHEN l.requested_t > t.requested_t THEN l.verdict ELSE t.verdict END"""


@query(with_tables("facts", "reports") + f""", {FIRSTS}, {VALUES} SELECT f.call_id, f.token, f.tracking_status, f.entry_price, f.ret_late_7d, c.n_calls, c.last_call, l.verdict AS live_verdict, t.verdict AS today_verdict, {SHOWN} AS shown_verdict, b.report, b.scan_kind, b.report_t, v.call_mcap, v.latest_mcap, v.supply_mcap
  FROM firsts f LEFT JOIN (SELECT token, count(*) AS n_calls, max(message_date) AS last_call FROM facts GROUP BY 1) c USING (token) LEFT JOIN {latest("gate", "live")} l USING (token) LEFT JOIN {latest("gate", "rescan")} t USING (token) LEFT JOIN {BEST} b USING (token) LEFT JOIN vals v USING (call_id)""")
def token_list(spark: SparkSession, sf: str) -> DataFrame:
    facts, reports = d.facts(spark, sf), d.reports(spark, sf)
    counts = facts.groupBy("token").agg(F.count(F.lit(1)).alias("n_calls"), F.max("message_date").alias("last_call"))
    calls = facts.select("call_id", "token", "tracking_status", "entry_price", "ret_late_7d")
    return listing.token_list(calls, firsts(spark, sf).select("call_id"), counts, listing.latest_verdict(reports, "gate", "live"), listing.latest_verdict(reports, "gate", "rescan"), listing.best_report(reports, "second"), listing.market_values(facts))


@query(with_tables("facts") + """ SELECT count(*) AS imported, count(tracking_status) AS tracked, count(*) FILTER (tracking_status = 'done') AS done, count(*) FILTER (tracking_status = 'tracking') AS tracking, count(*) FILTER (tracking_status = 'no_pool') AS no_pool,
  count(*) FILTER (tracking_status = 'gave_up') AS gave_up, count(*) FILTER (tracking_status = 'repeat') AS repeats, count(*) FILTER (post_kind = 'update') AS updates, count(*) FILTER (price_unit <> 'usd') AS no_usd FROM facts""")
def list_summary(spark: SparkSession, sf: str) -> DataFrame:
    return listing.summary(d.facts(spark, sf))


@query(with_tables("facts") + " SELECT coalesce(verdict, 'not scanned') AS verdict, price_unit = 'usd' AS usd, count(*) AS n FROM facts GROUP BY 1, 2")
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return d.facts(spark, sf).groupBy(F.coalesce("verdict", F.lit("not scanned")).alias("verdict"), (F.col("price_unit") == "usd").alias("usd")).agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("reports") + """ SELECT call_id, max(verdict_level) FILTER (tool = 'gate' AND status = 'completed') AS gate_level, max(verdict_level) FILTER (tool = 'second' AND status = 'completed') AS second_level, bool_or(delivered) AS delivered, count(*) AS answers FROM reports WHERE call_id IS NOT NULL GROUP BY 1""")
def tool_answers(spark: SparkSession, sf: str) -> DataFrame:
    return listing.answers(d.reports(spark, sf))


@query(with_tables("reports") + " SELECT id, token, verdict_level FROM reports WHERE tool = 'second' AND status = 'completed' AND token IN (SELECT token FROM reports WHERE tool = 'gate' AND status = 'completed' AND verdict_level = 'clean')")
def passed_reports(spark: SparkSession, sf: str) -> DataFrame:
    return listing.passed_reports(d.reports(spark, sf))


@query(with_tables("reports") + " SELECT requested_t // 86400000000 AS day, tool, count(*) AS n, count(*) FILTER (status = 'completed') AS completed, round(count(*) FILTER (status = 'completed') / count(*), 6) AS share FROM reports GROUP BY 1, 2")
def tool_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return listing.reliability(d.reports(spark, sf), F.expr("requested_t div 86400000000"))


@query(with_tables("reports") + f""" SELECT id, CASE WHEN status <> 'completed' THEN status WHEN NOT coalesce(regexp_matches(report_text, '\\S'), false) THEN 'empty' WHEN {DECLINED} THEN 'declined' ELSE 'report' END AS reply,
  CASE WHEN contains(lower(report_text), 'not enough public') THEN 'not enough public signals' WHEN contains(lower(report_text), 'too little liquidity') THEN 'too little liquidity or trading' ELSE 'no reason given' END AS reason,
  lower(nullif(regexp_extract(link, '/([0-9a-fA-F]{{32}})', 1), '')) AS report_key FROM reports""")
def reply_classes(spark: SparkSession, sf: str) -> DataFrame:
    return d.reports(spark, sf).select("id", listing.reply_class(F.col("status"), F.col("report_text")).alias("reply"), listing.decline_reason(F.col("report_text")).alias("reason"), listing.report_id(F.col("link")).alias("report_key"))


@query(with_tables("facts") + """ SELECT call_id, left(trim(dex), 8) AS name, regexp_replace(lower(dex), '[^a-z0-9]+', '', 'g') AS place, CASE WHEN entry_source IS NULL THEN 'untracked' WHEN starts_with(entry_source, 'onchain-') THEN substr(entry_source, 9) ELSE 'gecko' END AS pool FROM facts""")
def plain_names(spark: SparkSession, sf: str) -> DataFrame:
    return d.facts(spark, sf).select("call_id", listing.clean_name(F.col("dex"), 8).alias("name"), listing.plain_name(F.col("dex")).alias("place"), listing.pool_family(F.col("entry_source")).alias("pool"))


@query(with_tables("facts") + """ SELECT call_id, coalesce(dex, first_value(dex IGNORE NULLS) OVER (PARTITION BY token ORDER BY message_date DESC, call_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS dex,
  coalesce(token_supply, first_value(token_supply IGNORE NULLS) OVER (PARTITION BY token ORDER BY message_date, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS token_supply FROM facts""")
def filled_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Names from the newest, supplies from the oldest call of the token that has one."""
    rows = d.facts(spark, sf).select("call_id", "token", "message_date", "dex", "token_supply")
    order = [F.col("message_date"), F.col("call_id")]
    rows = listing.filled(rows, F.col("token"), "dex", order, newest=True)
    return listing.filled(rows, F.col("token"), "token_supply", order, newest=False).select("call_id", "dex", "token_supply")


@query(with_tables("facts") + """ SELECT token, max(call_id) AS newest, arg_min(pre_buys, call_id) FILTER (entry_price IS NOT NULL) AS first_block FROM facts GROUP BY 1 HAVING count(CASE WHEN call_id % 5 = 0 THEN dex END) = 0""")
def tokens_without_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.facts(spark, sf).withColumn("known_name", F.when(F.col("call_id") % 5 == 0, F.col("dex")))
    return listing.missing_attribute(rows, "token", "known_name", "call_id", F.col("entry_price").isNotNull(), "pre_buys")


@query("""SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(md5('{"call_id":' || o_orderkey || ',"status":"' || o_orderstatus || '","token":' || o_custkey || '}'), 1, 12)) AS HUGEINT)) AS VARCHAR) AS content FROM orders""")
def list_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return listing.fingerprint(d.read(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("token"), F.col("o_orderstatus").alias("status")))


@query(with_tables("facts") + " SELECT count(*) FILTER (mcap_usd = called_at_mcap_usd) AS equal, count(*) FILTER (mcap_usd <> called_at_mcap_usd) AS differ, count(*) FILTER (mcap_usd IS NOT NULL AND called_at_mcap_usd IS NULL) AS only_a, count(*) FILTER (mcap_usd IS NULL AND called_at_mcap_usd IS NOT NULL) AS only_b FROM facts")
def figure_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return listing.agreement(d.facts(spark, sf), "mcap_usd", "called_at_mcap_usd")


@query(with_tables("facts", "reports") + " SELECT r.id, r.tool, r.verdict_level, f.call_id, f.message_date, EXISTS (SELECT 1 FROM reports x WHERE x.delivered AND x.call_id = f.call_id) AS delivered FROM reports r LEFT JOIN facts f ON f.call_id = r.call_id")
def answers_with_calls(spark: SparkSession, sf: str) -> DataFrame:
    reports = d.reports(spark, sf)
    sent = reports.where("delivered and call_id is not null").select("call_id").distinct().withColumn("sent", F.lit(True))
    joined = reports.drop("delivered").join(d.facts(spark, sf).select(F.col("call_id").alias("c"), "message_date"), F.col("call_id") == F.col("c"), "left").join(sent, "call_id", "left")
    return joined.select("id", "tool", "verdict_level", F.col("c").alias("call_id"), "message_date", F.coalesce("sent", F.lit(False)).alias("delivered"))


DUE = f"""due_rows_ AS (SELECT call_id, epoch_us(message_date) AS entry_t, CASE WHEN call_id % 4 > 0 THEN {NOW_T} - (call_id % 50) * 3600000000 END AS checked_t, coalesce(tracking_status, '') AS status, entry_price, rugged FROM facts)"""


def _tracked(spark: SparkSession, sf: str) -> DataFrame:
    checked = F.when(F.col("call_id") % 4 > 0, F.lit(NOW_T) - (F.col("call_id") % 50) * F.lit(3_600_000_000).cast("long"))
    return d.facts(spark, sf).select("call_id", d.seconds("message_date").alias("entry_t"), checked.alias("checked_t"), F.coalesce("tracking_status", F.lit("")).alias("status"), "entry_price", "rugged")


@query(with_tables("facts") + f""", {DUE} SELECT call_id, entry_t > {NOW_T} - 43200000000000 AS young FROM due_rows_ WHERE status IN ('tracking', 'done') AND entry_price IS NOT NULL
  AND (checked_t IS NULL OR checked_t <= CASE WHEN entry_t > {NOW_T} - 43200000000000 AND NOT rugged THEN {NOW_T} - 7200000000 ELSE {NOW_T} - 86400000000 END)""")
def due_prices(spark: SparkSession, sf: str) -> DataFrame:
    return pools.due_latest(_tracked(spark, sf), NOW_T, 43_200_000_000_000, 7_200_000_000, 86_400_000_000).select("call_id", "young")


@query(with_tables("facts") + f", {DUE} SELECT status, count(*) AS n, min(checked_t) AS next_t FROM due_rows_ GROUP BY 1")
def tracking_stats(spark: SparkSession, sf: str) -> DataFrame:
    return pools.tracking_stats(_tracked(spark, sf))


RESCAN = f"""rescan AS (SELECT f.call_id, f.token, f.message_date, f.rugged, coalesce(f.latest_return_pct <= -99, false) AS wiped, (SELECT count(*) FROM reports r WHERE r.token = f.token AND r.tool = 'gate' AND r.scan_kind = 'rescan' AND (r.status IN ('failed', 'timeout') OR (r.status = 'completed' AND NOT coalesce(r.verdict_level IN {REAL}, false)))) AS failed_rescans
    FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.token = f.token AND r.tool = 'gate' AND r.status = 'completed' AND r.verdict_level IN {REAL}))"""


@query(with_tables("facts", "reports") + f", {FIRSTS}, {RESCAN} SELECT * FROM rescan")
def rescan_pool(spark: SparkSession, sf: str) -> DataFrame:
    return pools.rescan_pool(firsts(spark, sf), d.reports(spark, sf))


REASK = f"""last_live AS (SELECT call_id, status, report_text FROM reports WHERE tool = 'second' AND scan_kind = 'live' AND call_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY requested_t DESC, id DESC) = 1),
  reask AS (SELECT f.call_id, f.token, CASE WHEN i.status <> 'completed' THEN i.status WHEN NOT coalesce(regexp_matches(report_text, '\\S'), false) THEN 'empty' ELSE 'declined' END AS reason, f.rugged, coalesce(f.latest_return_pct <= -99, false) AS wiped,
    EXISTS (SELECT 1 FROM reports r WHERE r.token = f.token AND r.scan_kind = 'reask') AS reasked,
    EXISTS (SELECT 1 FROM reports WHERE token = f.token AND tool = 'second' AND status = 'completed' AND scan_kind = 'live' AND coalesce(regexp_matches(report_text, '\\S'), false) AND NOT {DECLINED}) AS has_report
    FROM firsts f JOIN last_live i USING (call_id) WHERE i.status <> 'completed' OR NOT coalesce(regexp_matches(i.report_text, '\\S'), false) OR {DECLINED})"""


@query(with_tables("facts", "reports") + f", {FIRSTS}, {REASK} SELECT * FROM reask")
def reask_pool(spark: SparkSession, sf: str) -> DataFrame:
    return pools.reask_pool(firsts(spark, sf), d.reports(spark, sf))


@query(with_tables("facts", "reports") + f", {FIRSTS}, {REASK} SELECT CASE WHEN rugged THEN 'rugged' WHEN wiped THEN 'wiped' WHEN reasked THEN 'asked again' WHEN has_report THEN 'has a report' ELSE 'ready' END AS state, reason, count(*) AS n FROM reask GROUP BY 1, 2")
def reask_summary(spark: SparkSession, sf: str) -> DataFrame:
    return pools.reask_summary(pools.reask_pool(firsts(spark, sf), d.reports(spark, sf)))


RECHECK = f"""held AS (SELECT call_id, arg_min(id, (requested_t, id)) AS held_id, min(requested_t) AS held_t FROM reports WHERE tool = 'gate' AND status = 'completed' AND scan_kind = 'live' AND NOT coalesce(verdict_level IN {REAL}, false) AND call_id IS NOT NULL GROUP BY 1),
  per AS (SELECT token, bool_or(coalesce(verdict_level IN {REAL}, false)) AS usable, count(*) FILTER (scan_kind = 'rescan') AS rechecks FROM reports WHERE tool = 'gate' AND status = 'completed' GROUP BY 1), sent AS (SELECT call_id, bool_or(delivered) AS delivered FROM reports WHERE call_id IS NOT NULL GROUP BY 1),
  recheck AS (SELECT f.call_id, f.token, h.held_id, h.held_t, coalesce(p.usable, false) AS usable, coalesce(p.rechecks, 0) AS rechecks, coalesce(s.delivered, false) AS delivered FROM firsts f JOIN held h USING (call_id) LEFT JOIN per p USING (token) LEFT JOIN sent s USING (call_id))"""


@query(with_tables("facts", "reports") + f", {FIRSTS}, {RECHECK} SELECT * FROM recheck")
def recheck_pool(spark: SparkSession, sf: str) -> DataFrame:
    return pools.recheck_pool(firsts(spark, sf), d.reports(spark, sf))


@query(with_tables("facts", "reports") + f""", {FIRSTS}, {RECHECK}, x AS (SELECT *, call_id % 20 AS age, rechecks >= 1 AND NOT delivered AND usable AS deliver, rechecks < 1 AND NOT delivered AS ask FROM recheck)
  SELECT call_id, CASE WHEN deliver AND age <= 6 THEN 'deliver' WHEN usable THEN 'nothing' WHEN ask AND age < 3 THEN 'wait' WHEN ask AND age <= 6 THEN 'first' WHEN rechecks >= 2 THEN 'nothing' WHEN age < 9 THEN 'wait' WHEN age <= 14 THEN 'second' ELSE 'nothing' END AS step,
    deliver AND age > 6 AS deliver_missed, NOT usable AND ask AND age > 6 AS first_missed, NOT usable AND NOT (ask AND age <= 6) AND rechecks < 2 AND age > 14 AS second_missed FROM x""")
def recheck_steps(spark: SparkSession, sf: str) -> DataFrame:
    return pools.recheck_steps(pools.recheck_pool(firsts(spark, sf), d.reports(spark, sf)), F.col("call_id") % 20, 3, 6, 9, 14)


@query("SELECT event_id FROM events WHERE event_id > 4000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = event_id AND o_orderstatus = 'F')")
def unseen_posts(spark: SparkSession, sf: str) -> DataFrame:
    known = d.read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return pools.gap(d.read(spark, sf, "events").select("event_id"), known, 4000, "event_id", ["event_id"])


@query(with_tables("facts") + " SELECT tracking_status, regexp_replace(lower(dex), '[^a-z0-9]+', '', 'g') AS place, count(*) AS n, max(call_id) AS newest FROM facts WHERE tracking_status IN ('gave_up', 'no_pool') AND regexp_replace(lower(dex), '[^a-z0-9]+', '', 'g') IN ('uniswapv2', 'uniswapv3', 'o1rwa') GROUP BY 1, 2")
def retry_groups(spark: SparkSession, sf: str) -> DataFrame:
    return pools.retry_groups(d.facts(spark, sf), ["gave_up", "no_pool"], ["uniswapv2", "uniswapv3", "o1rwa"], "dex")


@query(with_tables("facts") + " SELECT call_id, CASE WHEN tracking_status = 'gave_up' AND price_unit = 'usd' THEN 'tracking' ELSE tracking_status END AS tracking_status, CASE WHEN tracking_status = 'gave_up' AND price_unit = 'usd' THEN 0 ELSE CAST(pre_buys AS INT) END AS attempts FROM facts")
def retry_reset(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.facts(spark, sf).select("call_id", "tracking_status", "price_unit", F.col("pre_buys").cast("int").alias("attempts"))
    chosen = F.coalesce((F.col("tracking_status") == "gave_up") & (F.col("price_unit") == "usd"), F.lit(False))
    return pools.reset(rows, chosen).select("call_id", "tracking_status", "attempts")


@query(with_tables("reports") + " SELECT id, token FROM reports WHERE tool = 'gate' AND verdict_level = 'caution' AND scan_kind IN ('live', 'reask') AND requested_t >= 788918400000000 AND requested_t < 900000000000000")
def found_answers(spark: SparkSession, sf: str) -> DataFrame:
    return pools.find_answers(d.reports(spark, sf), "gate", "caution", ["live", "reask"], 788_918_400_000_000, 900_000_000_000_000).select("id", "token")


@query(with_tables("reports") + " SELECT id, CASE WHEN verdict_level = 'unknown' AND coalesce(lower(report_text) LIKE '%not enough%', false) THEN 'insufficient' ELSE verdict_level END AS verdict_level FROM reports")
def relabelled_answers(spark: SparkSession, sf: str) -> DataFrame:
    return pools.relabelled(pools.relabelled(d.reports(spark, sf))).select("id", "verdict_level")


@query(with_tables("reports") + " SELECT id, token FROM reports WHERE id % 3 > 0 UNION ALL SELECT id, token FROM reports WHERE id % 3 = 0 AND token NOT IN (SELECT token FROM reports WHERE id % 3 > 0)")
def migrated_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.reports(spark, sf).select("id", "token")
    return pools.migrated(rows.where("id % 3 = 0"), rows.where("id % 3 > 0"), ["token"])
