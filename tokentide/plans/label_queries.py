"""Queries over labels, features and families of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import labels
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.domain import with_tables

CAP = 100000.0
FLAGGED = f"""flagged AS (SELECT *, coalesce(post_kind = 'update', false) AS is_update,
    coalesce(post_kind = 'update', false) = false AND (coalesce(tracking_status = 'repeat', false) OR EXISTS (SELECT 1 FROM facts g WHERE g.token = facts.token AND g.post_kind IS DISTINCT FROM 'update' AND g.message_date IS NOT NULL AND (g.message_date, g.call_id) < (facts.message_date, facts.call_id))) AS is_repeat,
    entry_late_price IS NULL OR coalesce(tracking_status IN ('no_pool', 'gave_up'), false) AS is_no_pool, price_unit <> 'usd' AS is_not_usd,
    coalesce(max_gain_late_1d > {CAP}, false) OR coalesce(ret_late_1d > {CAP}, false) OR coalesce(ret_late_3d > {CAP}, false) OR coalesce(ret_late_7d > {CAP}, false) OR coalesce(ret_late_30d > {CAP}, false) AS is_extreme,
    coalesce(trades_24h < 50, false) AS is_dead FROM facts),
  netted AS (SELECT *, NOT (is_update OR is_repeat OR is_no_pool OR is_not_usd OR is_extreme) AS free, (1 - coalesce(tax_buy_pct, 0) / 100) AS fb, (1 - coalesce(tax_sell_pct, 0) / 100) AS fs FROM flagged)"""


def _bucket(name: str, gain: str, test: str, ret: str, most: str, rugged: bool) -> str:
    net = lambda c: f"((1 + {c} / 100) * fb * fs - 1) * 100"
    usable = f"(free AND {gain} IS NOT NULL AND {ret} IS NOT NULL)"
    fall = f"{net(ret)} <= {most}" + (" OR rugged" if rugged else "")
    return (
        f'{usable} AS "usable_{name}", CASE WHEN {usable} THEN CAST({net(gain)} {test} AS INT) END AS "runner_{name}", CASE WHEN {usable} THEN CAST(({fall}) AS INT) END AS "collapse_{name}", '
        f'CASE WHEN {usable} THEN CAST(({fall}) AS INT) END AS "collapse_plain_{name}", CASE WHEN {usable} THEN round({net(ret)}, 6) END AS "net_ret_{name}"'
    )


LABELLED = f"""labelled AS (SELECT call_id, message_date, token, rugged, trades_24h, is_update AS "update", is_repeat AS "repeat", is_no_pool AS no_pool, is_not_usd AS not_usd, is_extreme AS "extreme", is_dead AS dead,
  {_bucket("short", "max_gain_late_1d", ">= 100", "ret_late_1d", "-50", False)}, {_bucket("3day", "ret_late_3d", ">= 50", "ret_late_3d", "-60", False)},
  {_bucket("medium", "ret_late_7d", ">= 50", "ret_late_7d", "-70", False)}, {_bucket("long", "ret_late_30d", "> 0", "ret_late_30d", "-90", True)} FROM netted)"""
FAMILY = "CASE " + " ".join(f"WHEN starts_with(plain, '{p}') THEN '{f}'" for p, f in labels.FAMILIES) + " WHEN plain IS NULL THEN NULL ELSE 'other' END"
WITH_FAMILY = f"fam AS (SELECT *, {FAMILY} AS family FROM (SELECT *, nullif(regexp_replace(lower(dex), '[\\s_\\-./]+', '', 'g'), '') AS plain FROM facts))"


@query(with_tables("facts") + f", {FLAGGED}, {LABELLED} SELECT * EXCLUDE (message_date, token, rugged, trades_24h) FROM labelled")
def call_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.build_labels(d.facts(spark, sf))


@query(with_tables("facts") + f", {FLAGGED}, {LABELLED} SELECT call_id, CASE WHEN usable_medium THEN CAST(collapse_medium = 1 OR dead AS INT) END AS dead_collapse, CASE WHEN usable_short THEN CAST(runner_short = 1 AND NOT coalesce(trades_24h < 100, false) AS INT) END AS traded_runner FROM labelled")
def label_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Labels under the two switches: dead calls as collapses, and runners that need trades."""
    found = labels.build_labels(d.facts(spark, sf), dead_collapses=True, needs_trades=True)
    return found.select("call_id", F.col("collapse_medium").alias("dead_collapse"), F.col("runner_short").alias("traded_runner"))


@query(with_tables("facts") + f""", {FLAGGED}, {LABELLED} SELECT CASE WHEN "update" THEN 'update' WHEN "repeat" THEN 'repeat' WHEN no_pool THEN 'no pool' WHEN not_usd THEN 'not usd' WHEN "extreme" THEN 'extreme' ELSE 'no 7d outcome' END AS reason, count(*) AS n FROM labelled WHERE NOT usable_medium GROUP BY 1""")
def not_usable(spark: SparkSession, sf: str) -> DataFrame:
    return labels.not_usable_reasons(labels.build_labels(d.facts(spark, sf)))


@query(with_tables("facts") + f", {FLAGGED}, {LABELLED} " + " UNION ALL ".join(
    f"""SELECT '{b}' AS bucket, count(*) AS n, round(avg(CAST("runner_{b}" AS DOUBLE)), 6) AS runner_rate, round(avg(CAST("collapse_{b}" AS DOUBLE)), 6) AS collapse_rate, round(avg("net_ret_{b}"), 4) AS mean_net_ret FROM labelled WHERE "usable_{b}" """ for b in labels.BUCKETS))
def label_rates(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_rates(labels.build_labels(d.facts(spark, sf)))


@query(with_tables("facts") + f""", {WITH_FAMILY} SELECT call_id, round(liq_usd / CASE WHEN mcap_usd > 0 THEN mcap_usd END, 6) AS liq_to_mcap,
  round(live / CASE WHEN liq_usd > 0 THEN liq_usd END, 6) AS live_usd_to_liq, round(live / CASE WHEN mcap_usd > 0 THEN mcap_usd END, 6) AS live_usd_to_mcap, round(mcap_usd / CASE WHEN called_at_mcap_usd > 0 THEN called_at_mcap_usd END, 6) AS mcap_vs_called,
  round((pre_buys + 1) / (pre_sells + 1), 6) AS pre_buy_sell_ratio, round(vol / CASE WHEN vol + pre_sell_vol > 0 THEN vol + pre_sell_vol END, 6) AS pre_buy_vol_share, vol AS pre_buy_vol,
  CAST(hour(message_date) AS INT) AS hour_utc, CAST(isodow(message_date) - 1 AS INT) AS weekday_utc, family AS dex_family
  FROM (SELECT *, CASE WHEN elite_usd IS NOT NULL OR good_usd IS NOT NULL THEN coalesce(elite_usd, 0) + coalesce(good_usd, 0) END AS live, CASE WHEN price_unit = 'usd' THEN pre_buy_vol END AS vol FROM fam)""")
def call_features(spark: SparkSession, sf: str) -> DataFrame:
    return labels.features(d.facts(spark, sf))


@query(with_tables("facts") + f""", {WITH_FAMILY}, cells AS (SELECT 'dex_family' AS "column", nullif(trim(lower(family)), '') AS level FROM fam WHERE call_id % 4 < 3 UNION ALL SELECT 'dex', nullif(trim(lower(dex)), '') FROM fam WHERE call_id % 4 < 3
  UNION ALL SELECT 'verdict', nullif(trim(lower(verdict)), '') FROM fam WHERE call_id % 4 < 3) SELECT "column", level, count(*) AS n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY level) - 1 AS INT) AS code FROM cells WHERE level IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20""")
def category_levels(spark: SparkSession, sf: str) -> DataFrame:
    train = d.facts(spark, sf).where("call_id % 4 < 3")  # the training part, so that levels don't know the rest
    return labels.category_levels(train, {"dex_family": labels.exchange_family(F.col("dex")), "dex": F.col("dex"), "verdict": F.col("verdict")})


@query(with_tables("facts") + f""", {WITH_FAMILY}, dead AS (SELECT strftime(date_trunc('week', message_date), '%Y-%m-%d') AS week, coalesce(family, 'missing') AS family, count(*) AS n FROM fam WHERE trades_24h < 50 AND post_kind IS DISTINCT FROM 'update' GROUP BY 1, 2)
  SELECT week, CAST(sum(n) AS BIGINT) AS n_dead, round(sum(n) / (SELECT sum(n) FROM dead), 6) AS share, arg_max(family, (n, family)) AS top_family, max(n) AS top_family_n FROM dead GROUP BY 1""")
def dead_waves(spark: SparkSession, sf: str) -> DataFrame:
    return labels.dead_waves(d.facts(spark, sf))


@query(with_tables("facts") + """ SELECT strftime(date_trunc('week', message_date), '%Y-%m-%d') AS part, count(*) AS n, count(trades_24h) AS known, count(*) FILTER (trades_24h < 50) AS dead,
  round(count(*) FILTER (trades_24h < 50) / nullif(count(trades_24h), 0), 6) AS dead_share FROM facts GROUP BY 1""")
def dead_by_part(spark: SparkSession, sf: str) -> DataFrame:
    return labels.dead_stats(d.facts(spark, sf), F.date_format(F.date_trunc("week", F.col("message_date")), "yyyy-MM-dd"))


#: A call's inputs as the training view names them: some read from text that is no number, some volumes not in USD.
VIEW = """view_rows AS (SELECT call_id, message_date, dex, called_at_mcap_usd, mcap_usd, liq_usd, tax_buy_pct, tax_sell_pct, elite_usd AS live_buys_elite_usd, good_usd AS live_buys_good_usd, pre_buys AS pre_buys_5m, pre_sells AS pre_sells_5m,
    pre_buy_vol AS pre_buy_vol_5m, pre_sell_vol AS pre_sell_vol_5m, price_unit AS pre_vol_unit, call_id % 5 AS calls_prev_1h, CASE WHEN call_id % 7 > 0 THEN call_id % 7 * 3 - 3 END AS calls_prev_24h,
    CASE WHEN call_id % 4 = 0 THEN 'unknown' ELSE CAST(call_id % 900 AS VARCHAR(9)) END AS holders FROM facts)"""
NUM = {"holders": "TRY_CAST(holders AS DOUBLE)"}
FEATURE_SQL = ", ".join([f"CAST({NUM.get(n, n)} AS DOUBLE) AS {n}" for n in ("called_at_mcap_usd", "mcap_usd", "liq_usd", "tax_buy_pct", "tax_sell_pct", "holders", "live_buys_elite_usd", "live_buys_good_usd", "calls_prev_1h", "calls_prev_24h")])


@query(with_tables("facts") + f""", {VIEW}, e AS (SELECT *, CASE WHEN live_buys_elite_usd IS NOT NULL OR live_buys_good_usd IS NOT NULL THEN coalesce(live_buys_elite_usd, 0) + coalesce(live_buys_good_usd, 0) END AS live, CASE WHEN pre_vol_unit = 'usd' THEN pre_buy_vol_5m END AS bv, CASE WHEN pre_vol_unit = 'usd' THEN pre_sell_vol_5m END AS sv FROM view_rows)
  SELECT call_id, {FEATURE_SQL}, CAST(pre_buys_5m AS DOUBLE) AS pre_buys_5m, CAST(pre_sells_5m AS DOUBLE) AS pre_sells_5m, bv AS pre_buy_vol_5m, sv AS pre_sell_vol_5m, round((pre_buys_5m + 1) / (pre_sells_5m + 1), 9) AS pre_buy_sell_ratio_5m, round(bv / CASE WHEN bv + sv > 0 THEN bv + sv END, 9) AS pre_buy_vol_share_5m,
    round(liq_usd / CASE WHEN mcap_usd > 0 THEN mcap_usd END, 9) AS liq_to_mcap, round(live / CASE WHEN liq_usd > 0 THEN liq_usd END, 9) AS live_usd_to_liq, round(live / CASE WHEN mcap_usd > 0 THEN mcap_usd END, 9) AS live_usd_to_mcap, round(mcap_usd / CASE WHEN called_at_mcap_usd > 0 THEN called_at_mcap_usd END, 9) AS mcap_vs_called,
    calls_prev_1h * 24 / CASE WHEN calls_prev_24h IS NOT NULL THEN greatest(calls_prev_24h, 1) END AS calls_prev_burst FROM e""")
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """The inputs that the domain tables have; those of a real view are named in `labels.RAW`."""
    rows = spark.sql(f"WITH {VIEW.replace('FROM facts', 'FROM {facts}')} SELECT * FROM view_rows", facts=d.facts(spark, sf))
    raw = ("called_at_mcap_usd", "mcap_usd", "liq_usd", "tax_buy_pct", "tax_sell_pct", "holders", "live_buys_elite_usd", "live_buys_good_usd", "calls_prev_1h", "calls_prev_24h")
    ratios = ("pre_buy_sell_ratio_5m", "pre_buy_vol_share_5m", "liq_to_mcap", "live_usd_to_liq", "live_usd_to_mcap", "mcap_vs_called")
    found = labels.feature_table(rows, raw, ("5m",))
    return found.drop("pre_swaps_5m", "pre_price_chg_5m_pct", "hour_utc", "weekday_utc", "dex_family").withColumns({c: F.round(c, 9) for c in ratios})
