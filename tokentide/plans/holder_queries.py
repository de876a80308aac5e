"""Venue plans and holder rows over a ledger derived from the given tables: four kinds of pool, two calls a token."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import holder_rows as h
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.sources.tables import written

MANAGER, FACTORY = "0xManager", "0xFactory"
KIND = "CASE {p} % 5 WHEN 0 THEN 'v2' WHEN 1 THEN 'v3' WHEN 2 THEN 'v4' WHEN 3 THEN 'pons' ELSE 'other' END"
VENUE = "CASE WHEN l_partkey % 5 = 2 OR (l_partkey % 5 = 3 AND l_linenumber % 3 = 2) THEN '0xManager' WHEN l_partkey % 5 = 3 AND l_linenumber % 3 = 1 THEN concat('0xCurve', l_partkey) ELSE concat('0xPool', l_partkey) END"
STATES = f"""SELECT p_partkey * 2 + k AS call_id, concat('0xT', p_partkey) AS token, {KIND.format(p='p_partkey')} AS kind,
    CASE WHEN p_partkey % 5 <> 2 THEN concat('0xPool', p_partkey) END AS pool, CASE WHEN p_partkey % 5 = 3 THEN concat('ID', p_partkey) END AS pool_id,
    CASE WHEN p_partkey % 5 = 3 THEN concat('0xCurve', p_partkey) END AS curve, CASE WHEN p_partkey % 5 = 2 THEN '0xw7' END AS hook, CASE WHEN p_partkey % 5 = 3 AND p_size % 2 = 0 THEN CAST(9300 AS BIGINT) END AS grad_block,
    CASE WHEN p_size % 25 > 0 THEN CAST(8900 + p_size * 12 + k * 60 AS BIGINT) END AS entry_block, CASE WHEN p_size % 25 > 0 THEN CAST(8990 + p_size * 12 + k * 60 AS BIGINT) END AS end_block,
    CASE WHEN p_size % 7 > 0 THEN concat('0xW', p_size % 50) END AS deployer, CAST(p_size * 60 AS BIGINT) AS launch_age_s"""
IDS = "SELECT concat('0xt', p_partkey) AS token, concat(CASE WHEN k = 0 THEN 'id' ELSE 'Jd' END, p_partkey) AS pool_id, CAST(8900 + p_size * 11 + k * 40 AS BIGINT) AS init_block"
SIDES = f"""concat('0xt', l_partkey) AS token, CASE l_returnflag WHEN 'A' THEN {VENUE} ELSE concat('0xW', l_suppkey % 50) END AS sender,
    CASE WHEN l_linenumber = 7 THEN '0x000000000000000000000000000000000000dEaD' WHEN l_returnflag = 'R' THEN {VENUE} ELSE concat('0xw', (l_suppkey + l_linenumber) % 50) END AS receiver,
    CAST(l_quantity AS DECIMAL(38, 0)) AS value"""
MINTS = "SELECT concat('0xt', p_partkey) AS token, '0x0000000000000000000000000000000000000000' AS sender, CASE k WHEN 50 THEN concat('0xPool', p_partkey) WHEN 51 THEN concat('0xCurve', p_partkey) WHEN 52 THEN '0xManager' ELSE concat('0xw', k) END AS receiver, CAST(100 + k AS DECIMAL(38, 0)) AS value, CAST(1 AS BIGINT) AS block, CAST(k AS BIGINT) AS idx, 'mint' AS tx"
EVENT = f"CASE WHEN {VENUE} = '0xManager' THEN 'v4' ELSE 'v2' END AS protocol, {VENUE} AS venue, CASE WHEN {VENUE} = '0xManager' THEN concat(CASE WHEN l_suppkey % 2 = 0 THEN 'id' ELSE 'jd' END, l_partkey) END AS pool_id, CASE WHEN l_linestatus = 'O' THEN 'add' WHEN l_returnflag = 'A' THEN 'remove' ELSE 'collect' END AS kind"


def tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """calls, transfers, liquidity and pool ids."""
    part, line = d.read(spark, sf, "part"), d.read(spark, sf, "lineitem")
    fields = lambda df, sql: df.selectExpr(*_split(sql))
    times = lambda df, n: df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    block = "unix_micros(cast(l_shipdate as timestamp)) div 86400000000 AS block"
    place = ["l_orderkey * 10 + l_linenumber AS idx", "cast(l_orderkey as string) AS tx"]
    moved = line.selectExpr(*_split("SELECT " + SIDES), block, *place)
    # a small file is one task, which would make all these rows
    spread = part.select("p_partkey").where("p_partkey % 3 > 0").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    minted = fields(times(spread, 53), MINTS)
    return fields(times(part, 2), STATES), moved.unionByName(minted), line.where("l_linenumber = 1").selectExpr(*_split("SELECT " + EVENT), block, *place), fields(times(part, 2).where("p_partkey % 5 in (2, 3)"), IDS)


def _split(sql: str) -> list[str]:
    """The columns of a SELECT list: cut at commas outside brackets."""
    out, depth, now = [], 0, ""
    for ch in sql.removeprefix("SELECT "):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out, now = [*out, now], ""
        else:
            now += ch
    return [c.strip() for c in (*out, now)]


AT = "epoch_us(l_shipdate) // 86400000000 AS block, l_orderkey * 10 + l_linenumber AS idx, CAST(l_orderkey AS VARCHAR) AS tx"
LEDGER = f"""calls AS ({STATES} FROM part CROSS JOIN range(2) g(k)), ids AS ({IDS} FROM part CROSS JOIN range(2) g(k) WHERE p_partkey % 5 IN (2, 3)),
  moved AS (SELECT lower(token) AS token, lower(sender) AS s, lower(receiver) AS r, value, block, idx, tx FROM (SELECT {SIDES}, {AT} FROM lineitem UNION ALL BY NAME {MINTS} FROM part CROSS JOIN range(53) g(k) WHERE p_partkey % 3 > 0)),
  events AS (SELECT protocol, lower(venue) AS venue, pool_id, kind, block, idx, tx FROM (SELECT {EVENT}, {AT} FROM lineitem WHERE l_linenumber = 1)),
  seen AS (SELECT token, a, min(block) AS block FROM (SELECT token, s AS a, block FROM moved UNION ALL SELECT token, r, block FROM moved) WHERE a LIKE '0xpool%' GROUP BY 1, 2),
  seen_lp AS (SELECT venue, min(block) AS block FROM events GROUP BY 1),
  based AS (SELECT call_id, lower(c.token) AS token, c.kind, lower(pool) AS pool, lower(curve) AS curve, hook, grad_block, entry_block, end_block, lower(deployer) AS deployer, launch_age_s,
      coalesce(grad_block <= entry_block, false) AS grad_pre, coalesce(grad_block <= end_block, false) AS grad_post, coalesce(least(seen.block, seen_lp.block) <= entry_block, false) AS pool_seen,
      list_sort(list_distinct(list_concat(coalesce((SELECT list(lower(i.pool_id)) FROM ids i WHERE i.token = lower(c.token) AND init_block <= entry_block), []), CASE WHEN grad_block <= entry_block THEN [lower(pool_id)] ELSE [] END))) AS pool_ids_pre,
      list_sort(list_distinct(list_concat(coalesce((SELECT list(lower(i.pool_id)) FROM ids i WHERE i.token = lower(c.token)), []), CASE WHEN pool_id IS NOT NULL THEN [lower(pool_id)] ELSE [] END))) AS pool_ids_all
    FROM calls c LEFT JOIN seen ON seen.token = lower(c.token) AND seen.a = lower(pool) LEFT JOIN seen_lp ON seen_lp.venue = lower(pool)),
  planned AS (SELECT *, list_filter([CASE WHEN kind = 'pons' OR (kind IN ('v2', 'v3') AND pool_seen) THEN pool END, CASE WHEN kind = 'pons' THEN curve END, CASE WHEN kind IN ('v4', 'pons') AND (kind = 'v4' OR grad_pre) AND len(pool_ids_pre) > 0 THEN '0xmanager' END], lambda x: x IS NOT NULL) AS venues_pre,
      list_filter([CASE WHEN kind IN ('pons', 'v2', 'v3') THEN pool END, CASE WHEN kind = 'pons' THEN curve END, CASE WHEN kind = 'v4' OR (kind = 'pons' AND grad_post) THEN '0xmanager' END], lambda x: x IS NOT NULL) AS venues_post FROM based),
  plans AS (SELECT *, list_sort(list_distinct(list_filter(list_concat([token, '0x0000000000000000000000000000000000000000', '0x000000000000000000000000000000000000dead', '0xmanager', CASE WHEN kind = 'pons' THEN '0xfactory' END, hook], venues_pre), lambda x: x IS NOT NULL))) AS excluded_pre,
      list_sort(list_distinct(list_filter(list_concat([token, '0x0000000000000000000000000000000000000000', '0x000000000000000000000000000000000000dead', '0xmanager', CASE WHEN kind = 'pons' THEN '0xfactory' END, hook], venues_post), lambda x: x IS NOT NULL))) AS excluded_post,
      coalesce((kind IN ('v2', 'v3') AND len(venues_pre) > 0) OR list_contains(venues_pre, '0xmanager'), false) AS lp_pre, coalesce(kind IN ('v2', 'v3') OR (list_contains(venues_post, '0xmanager') AND len(pool_ids_all) > 0), false) AS lp_post FROM planned)"""


@query(f"WITH {LEDGER} SELECT call_id, array_to_string(venues_pre, ';') AS venues_pre, array_to_string(venues_post, ';') AS venues_post, array_to_string(excluded_pre, ';') AS excluded_pre, array_to_string(excluded_post, ';') AS excluded_post, array_to_string(pool_ids_pre, ';') AS pool_ids_pre, array_to_string(pool_ids_all, ';') AS pool_ids_all, lp_pre, lp_post FROM plans")
def venue_plans(spark: SparkSession, sf: str) -> DataFrame:
    found = h.venue_plan(*tables(spark, sf), MANAGER, FACTORY)
    lists = ("venues_pre", "venues_post", "excluded_pre", "excluded_post", "pool_ids_pre", "pool_ids_all")
    return found.select("call_id", *[F.array_join(c, ";").alias(c) for c in lists], "lp_pre", "lp_post")


#: Each call replayed on its own: the transfers of its token are read once for each call and phase.
REPLAY = f"""{LEDGER}, points AS (SELECT call_id, 'pre' AS phase, token, entry_block AS block, CAST(-1 AS BIGINT) AS since, entry_block, deployer, venues_pre AS venues, excluded_pre AS excluded, pool_ids_pre AS ids, lp_pre AS lp FROM plans WHERE entry_block > 0
    UNION ALL SELECT call_id, 'post', token, end_block, entry_block, entry_block, deployer, venues_post, excluded_post, pool_ids_all, lp_post FROM plans WHERE entry_block > 0),
  sides AS (SELECT token, s AS a, -value AS v, block, idx, 0 AS side FROM moved UNION ALL SELECT token, r, value, block, idx, 1 FROM moved),
  running AS (SELECT token, block, sum(v) OVER (PARTITION BY token, a ORDER BY block, idx, side, v ROWS UNBOUNDED PRECEDING) AS after FROM sides WHERE a NOT IN ('0x0000000000000000000000000000000000000000', '0x000000000000000000000000000000000000dead')),
  over AS (SELECT token, min(block) AS overdrawn FROM running WHERE after < 0 GROUP BY 1),
  lists AS (SELECT call_id, phase, sides.a, sum(v) AS balance FROM points JOIN sides ON sides.token = points.token AND sides.block <= points.block WHERE a NOT IN ('0x0000000000000000000000000000000000000000', '0x000000000000000000000000000000000000dead') GROUP BY 1, 2, 3),
  supplied AS (SELECT call_id, phase, sum(CASE WHEN s LIKE '0x00000000%' THEN value ELSE 0 END) - sum(CASE WHEN r LIKE '0x00000000%' THEN value ELSE 0 END) AS supply, count(*) FILTER (moved.block > since) AS transfers FROM points JOIN moved ON moved.token = points.token AND moved.block <= points.block GROUP BY 1, 2),
  free AS (SELECT l.*, row_number() OVER (PARTITION BY l.call_id, l.phase ORDER BY balance DESC) AS place FROM lists l JOIN points p ON p.call_id = l.call_id AND p.phase = l.phase WHERE NOT list_contains(excluded, a)),
  held AS (SELECT call_id, phase, count(*) FILTER (balance > 0) AS holders, sum(balance) FILTER (balance > 0 AND place <= 1) AS top1, sum(balance) FILTER (balance > 0 AND place <= 10) AS top10 FROM free GROUP BY 1, 2),
  off AS (SELECT l.call_id, l.phase, sum(balance) AS off FROM lists l JOIN points p ON p.call_id = l.call_id AND p.phase = l.phase WHERE list_contains(excluded, a) GROUP BY 1, 2),
  mine AS (SELECT p.call_id, p.phase, p.since, e.* FROM points p JOIN events e ON list_contains(venues, e.venue) AND e.block <= p.block AND (e.protocol <> 'v4' OR list_contains(ids, e.pool_id))),
  txs AS (SELECT call_id, phase, venue, tx, bool_or(kind = 'add') AS puts, bool_or(kind <> 'add') AS takes FROM mine GROUP BY 1, 2, 3, 4),
  sided AS (SELECT p.*, m.s, m.r, m.value, m.block AS moved_at, m.idx, m.tx, list_contains(venues, s) AND NOT list_contains(venues, r) AND NOT list_contains(excluded, r) AS buys, list_contains(venues, r) AND NOT list_contains(venues, s) AND NOT list_contains(excluded, s) AS sells FROM points p JOIN moved m ON m.token = p.token AND m.block <= p.block WHERE value > 0),
  traded AS (SELECT t.*, CASE WHEN buys AND NOT coalesce(a.takes, false) THEN 'buy' WHEN sells AND NOT coalesce(b.puts, false) THEN 'sell' END AS kind FROM sided t LEFT JOIN txs a ON a.call_id = t.call_id AND a.phase = t.phase AND a.venue = s AND a.tx = t.tx LEFT JOIN txs b ON b.call_id = t.call_id AND b.phase = t.phase AND b.venue = r AND b.tx = t.tx),
  flow AS (SELECT call_id, phase, count(*) FILTER (kind = 'buy' AND moved_at > since) AS buys, count(*) FILTER (kind = 'sell' AND moved_at > since) AS sells, count(DISTINCT r) FILTER (kind = 'buy' AND moved_at > since) AS buyers, count(DISTINCT s) FILTER (kind = 'sell' AND moved_at > since) AS sellers,
      coalesce(sum(value) FILTER (kind = 'sell' AND moved_at > since), 0) / sum(value) FILTER (kind = 'buy' AND moved_at > since) AS ratio, min(moved_at) FILTER (kind = 'buy') AS first_buy FROM traded GROUP BY 1, 2),
  snipe AS (SELECT t.call_id, count(DISTINCT r) FILTER (moved_at <= first_buy + 50) AS snipers, count(DISTINCT r) FILTER (moved_at = first_buy) AS first_block FROM traded t JOIN flow f ON f.call_id = t.call_id AND f.phase = 'pre' WHERE t.phase = 'pre' AND kind = 'buy' GROUP BY 1),
  lps AS (SELECT call_id, phase, count(*) FILTER (kind = 'add') AS adds, count(*) FILTER (kind = 'remove') AS removes, count(*) FILTER (kind = 'collect') AS collects FROM mine WHERE block > since GROUP BY 1, 2),
  rows AS (SELECT p.*, coalesce(overdrawn > p.block, true) AS complete, coalesce(transfers, 0) AS transfers, coalesce(supply, 0) - coalesce(off, 0) AS circulating, coalesce(holders, 0) AS holders, coalesce(top1, 0) AS top1, coalesce(top10, 0) AS top10, coalesce(f.buys, 0) AS n_buys, coalesce(f.sells, 0) AS n_sells, coalesce(buyers, 0) AS buyers, coalesce(sellers, 0) AS sellers, ratio, first_buy, snipers, first_block, coalesce(adds, 0) AS adds, coalesce(removes, 0) AS removes, coalesce(collects, 0) AS collects
    FROM points p LEFT JOIN over ON over.token = p.token LEFT JOIN supplied USING (call_id, phase) LEFT JOIN held USING (call_id, phase) LEFT JOIN off USING (call_id, phase) LEFT JOIN flow f USING (call_id, phase) LEFT JOIN snipe USING (call_id) LEFT JOIN lps USING (call_id, phase))"""


def _columns(phase: str) -> str:
    share = lambda n: f"round(CASE WHEN complete AND circulating > 0 THEN CAST({n} AS DOUBLE) / CAST(circulating AS DOUBLE) END, 9)"
    c = {"incomplete": "NOT complete", "transfers": "transfers", "holders": "CASE WHEN complete THEN holders END", "top1_share": share("top1"), "top10_share": share("top10")}
    c |= {n: f"CASE WHEN complete THEN {v} END" for n, v in (("buys", "n_buys"), ("sells", "n_sells"), ("buyers", "buyers"), ("sellers", "sellers"), ("sell_buy_ratio", "round(CAST(ratio AS DOUBLE), 9)"))}
    c |= {f"lp_{n}": f"CASE WHEN complete AND lp THEN {n} END" for n in ("adds", "removes", "collects")}
    c |= {"first_buy_block": "CASE WHEN complete THEN first_buy END", "snipers": "CASE WHEN complete THEN snipers END", "first_block_buyers": "CASE WHEN complete THEN first_block END"} if phase == "pre" else {}
    return ", ".join(f"{v} AS {phase}_{n}" for n, v in c.items())


@query(f"WITH {REPLAY}, a AS (SELECT call_id, {_columns('pre')} FROM rows WHERE phase = 'pre'), b AS (SELECT call_id, {_columns('post')} FROM rows WHERE phase = 'post') SELECT calls.call_id, a.* EXCLUDE (call_id), b.* EXCLUDE (call_id) FROM calls LEFT JOIN a USING (call_id) LEFT JOIN b USING (call_id)")
def holder_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The columns that the SQL replays; `holder_rows_full` has all."""
    full = holder_rows_full(spark, sf)
    both = ["incomplete", "transfers", "holders", "top1_share", "top10_share", "buys", "sells", "buyers", "sellers", "sell_buy_ratio", "lp_adds", "lp_removes", "lp_collects"]
    names = [f"pre_{n}" for n in (*both, "first_buy_block", "snipers", "first_block_buyers")] + [f"post_{n}" for n in both]
    return full.select("call_id", *[F.round(n, 9).alias(n) if n.endswith(("share", "ratio")) else F.col(n) for n in names])


@query()
def holder_rows_full(spark: SparkSession, sf: str) -> DataFrame:
    return h.holder_rows(*tables(spark, sf), MANAGER, FACTORY, keep=written)
