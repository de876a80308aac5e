"""Queries over calls, candles, returns, labels and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import analytics, candles, evaluation, identity, ledger
from tokentide.operators.asof import as_of
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.domain import with_tables
from tokentide.sources import tables

NOW_T = 1706659200 * 1_000_000
FIRST = "firsts AS (SELECT * FROM calls WHERE post_kind IS DISTINCT FROM 'update' QUALIFY row_number() OVER (PARTITION BY lower(token) ORDER BY message_date, call_id) = 1)"


@query(with_tables("calls") + f", {FIRST} SELECT call_id, token, message_date FROM firsts")
def first_calls(spark: SparkSession, sf: str) -> DataFrame:
    return identity.first_calls(d.calls(spark, sf)).select("call_id", "token", "message_date")


@query(with_tables("calls") + " SELECT lower(token) AS token, count(*) AS n_calls, max(message_date) AS last_call FROM calls GROUP BY 1")
def call_counts(spark: SparkSession, sf: str) -> DataFrame:
    return identity.call_counts(d.calls(spark, sf))


PRIOR = """SELECT call_id, count(*) OVER w AS prior_calls, (epoch_us(message_date) - max(epoch_us(message_date)) OVER w) / 1e6 AS since_prior_s
  FROM calls WINDOW w AS (PARTITION BY token ORDER BY epoch_us(message_date) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(with_tables("calls") + " " + PRIOR)
def prior_calls(spark: SparkSession, sf: str) -> DataFrame:
    return identity.prior_calls(d.calls(spark, sf))


@query(with_tables("price_events") + """ SELECT seq, count(*) OVER (ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS rows_1h,
  count(*) OVER (ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS rows_24h FROM price_events""")
def busyness(spark: SparkSession, sf: str) -> DataFrame:
    return identity.busyness(d.price_events(spark, sf), "seq", "t")


@query(with_tables("buys") + " SELECT call_id, max(amount_usd) AS largest_buy_usd FROM buys GROUP BY 1")
def live_buy_max(spark: SparkSession, sf: str) -> DataFrame:
    return identity.live_buy_max(d.live_buys(spark, sf))


@query(with_tables("buys") + """ SELECT call_id, count(*) FILTER (tier = 'elite') AS elite_count, round(coalesce(sum(amount_usd) FILTER (tier = 'elite'), 0), 4) AS elite_usd,
  count(*) FILTER (tier = 'good') AS good_count, round(coalesce(sum(amount_usd) FILTER (tier = 'good'), 0), 4) AS good_usd FROM buys GROUP BY 1""")
def tier_volume(spark: SparkSession, sf: str) -> DataFrame:
    return identity.tier_volume(d.live_buys(spark, sf))


PIVOT = "SELECT call_id, " + ", ".join(f"max(return_pct) FILTER (horizon = '{h}') AS \"ret_{h}\"" for h in d.HORIZONS) + " FROM returns GROUP BY 1"


@query(with_tables("returns") + " " + PIVOT)
def pivot_returns(spark: SparkSession, sf: str) -> DataFrame:
    return identity.pivot_returns(d.returns(spark, sf))


@query(with_tables("returns") + """ SELECT call_id, CAST(coalesce(bit_or(CASE WHEN return_pct <= -50 THEN CASE horizon WHEN '1h' THEN 1 WHEN '1d' THEN 2 WHEN '3d' THEN 4 WHEN '7d' THEN 8 ELSE 16 END END), 0) AS BIGINT) AS bits
  FROM returns GROUP BY 1""")
def collapse_bits(spark: SparkSession, sf: str) -> DataFrame:
    return identity.horizon_bits(d.returns(spark, sf), F.col("return_pct") <= -50)


VERDICT = """SELECT c.call_id, i.verdict, i.requested_t FROM event_calls c LEFT JOIN (
    SELECT c.call_id, i.verdict, i.requested_t, row_number() OVER (PARTITION BY c.call_id ORDER BY i.requested_t DESC, i.id DESC) AS n
    FROM event_calls c JOIN inv i ON i.token = c.token AND i.requested_t <= c.entry_t) i ON i.call_id = c.call_id AND n = 1"""


@query(with_tables("price_events", "event_calls", "inv") + " " + VERDICT)
def verdict_at_call(spark: SparkSession, sf: str) -> DataFrame:
    found = as_of(d.calls_on_events(spark, sf), d.investigations(spark, sf), "token", "entry_t", "requested_t", ["verdict", "requested_t"], "id")
    return found.select("call_id", "verdict", "requested_t")


@query(with_tables("price_events", "event_calls", "inv") + """ SELECT c.call_id, min(i.requested_t) AS next_report_t FROM event_calls c
  LEFT JOIN inv i ON i.token = c.token AND i.requested_t >= c.entry_t GROUP BY 1""")
def next_report(spark: SparkSession, sf: str) -> DataFrame:
    found = as_of(d.calls_on_events(spark, sf), d.investigations(spark, sf), "token", "entry_t", "requested_t", ["requested_t"], "id", forward=True)
    return found.select("call_id", F.col("requested_t").alias("next_report_t"))


CANDLES = """candles AS (SELECT call_id, interval_s, CAST(floor(t / 1e6 / interval_s) * interval_s AS BIGINT) AS bucket_s, arg_min(price, (t, seq)) AS open, max(price) AS high,
    min(price) AS low, arg_max(price, (t, seq)) AS close, count(*) AS events
  FROM event_calls c JOIN trades USING (token) CROSS JOIN (VALUES (300), (3600)) v(interval_s) WHERE t >= entry_t AND t < entry_t + CASE interval_s WHEN 300 THEN 86400000000 ELSE 2592000000000 END GROUP BY 1, 2, 3)"""


@query(with_tables("price_events", "event_calls", "trades") + f", {CANDLES} SELECT * FROM candles")
def call_candles(spark: SparkSession, sf: str) -> DataFrame:
    return candles.candles(d.trades(spark, sf).drop("ts"), d.calls_on_events(spark, sf))


@query(with_tables("price_events", "event_calls", "trades") + f""", {CANDLES} SELECT c.call_id, CAST(CASE WHEN entry_t + 86400000000 <= {NOW_T} THEN coalesce(n, 0) END AS BIGINT) AS trades_24h
  FROM event_calls c LEFT JOIN (SELECT call_id, sum(events) AS n FROM candles WHERE interval_s = 300 GROUP BY 1) x USING (call_id)""")
def trades_24h(spark: SparkSession, sf: str) -> DataFrame:
    calls = d.calls_on_events(spark, sf)
    return candles.trades_24h(candles.candles(d.trades(spark, sf).drop("ts"), calls), calls, NOW_T)


ENTRY = """entries AS (SELECT c.call_id, c.token, c.entry_t, coalesce(arg_max(price, (t, seq)) FILTER (t <= entry_t), arg_min(price, (t, seq)) FILTER (t > entry_t)) AS entry_price,
    CASE WHEN count(*) FILTER (t <= entry_t) > 0 THEN 'before' WHEN count(*) FILTER (t > entry_t) > 0 THEN 'after' ELSE 'none' END AS entry_source
  FROM event_calls c LEFT JOIN trades USING (token) GROUP BY 1, 2, 3)"""


@query(with_tables("price_events", "event_calls", "trades") + f", {ENTRY} SELECT * FROM entries")
def entry_prices(spark: SparkSession, sf: str) -> DataFrame:
    return candles.entry_price(d.trades(spark, sf).drop("ts"), d.calls_on_events(spark, sf))


HORIZON_VALUES = ", ".join(f"('{h}', {s})" for h, s in d.HORIZONS.items())
RETURNS = f"""results AS (SELECT call_id, horizon, status, CASE WHEN status = 'done' THEN round((last / entry_price - 1) * 100, 6) END AS return_pct,
    CASE WHEN status = 'done' THEN round((high / entry_price - 1) * 100, 6) END AS max_gain_pct, CASE WHEN status = 'done' THEN round((low / entry_price - 1) * 100, 6) END AS max_drawdown_pct
  FROM (SELECT e.call_id, h.horizon, any_value(e.entry_price) AS entry_price, arg_max(price, (t, seq)) AS last, max(price) AS high, min(price) AS low,
      CASE WHEN any_value(e.entry_t) + h.s::BIGINT * 1000000 > {NOW_T} THEN 'pending' WHEN count(price) = 0 OR any_value(e.entry_price) IS NULL THEN 'no_data' ELSE 'done' END AS status
    FROM entries e CROSS JOIN (VALUES {HORIZON_VALUES}) h(horizon, s) LEFT JOIN trades t ON t.token = e.token AND t.t > e.entry_t AND t.t <= e.entry_t + h.s::BIGINT * 1000000 GROUP BY e.call_id, h.horizon, h.s))"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    trades = d.trades(spark, sf).drop("ts")
    entries = tables.written(candles.entry_price(trades, d.calls_on_events(spark, sf)))  # read twice
    return candles.horizon_returns(trades, entries, NOW_T)


@query(with_tables("price_events", "event_calls", "trades") + f", {ENTRY}, {RETURNS} SELECT * FROM results")
def horizon_returns(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf)


TIMING = """SELECT call_id, min((t - entry_t) / 1e6) FILTER (price = peak) AS peak_after_s, min((first_t - entry_t) / 1e6) AS first_2x_after_s,
    coalesce(sum((until - t) / 1e6) FILTER (above), 0) AS above_2x_s, min((t - entry_t) / 1e6) FILTER (t >= first_t AND NOT above) AS fall_below_2x_after_s, arg_max(above, (t, seq)) AS censored
  FROM (SELECT *, min(t) FILTER (above) OVER (PARTITION BY call_id) AS first_t, max(price) OVER (PARTITION BY call_id) AS peak
    FROM (SELECT e.*, t, seq, price, coalesce(lead(t) OVER (PARTITION BY call_id ORDER BY t, seq), entry_t + 604800000000) AS until, price >= 2 * entry_price AS above
      FROM entries e JOIN trades USING (token) WHERE entry_price > 0 AND t > entry_t AND t <= entry_t + 604800000000)) GROUP BY 1"""


@query(with_tables("price_events", "event_calls", "trades") + f", {ENTRY} {TIMING}")
def horizon_timing(spark: SparkSession, sf: str) -> DataFrame:
    trades = d.trades(spark, sf).drop("ts")
    return candles.horizon_timing(trades, candles.entry_price(trades, d.calls_on_events(spark, sf)))


PRECALL = """SELECT c.call_id, x.* EXCLUDE (cid) REPLACE (""" + ", ".join(f"coalesce({c}_{m}m, 0) AS {c}_{m}m" for m in (5, 15, 60) for c in ("swaps", "buys", "sells", "buy_vol", "sell_vol")) + """)
  FROM event_calls c LEFT JOIN (SELECT call_id AS cid, (max(entry_t - t)) / 1e6 AS first_trade_age_s, """ + ", ".join(
    f"count(*) FILTER (ago < {m * 60000000}) AS swaps_{m}m, count(*) FILTER (ago < {m * 60000000} AND kind = 'purchase') AS buys_{m}m, count(*) FILTER (ago < {m * 60000000} AND kind = 'click') AS sells_{m}m, "
    f"round(coalesce(sum(price) FILTER (ago < {m * 60000000} AND kind = 'purchase'), 0), 4) AS buy_vol_{m}m, round(coalesce(sum(price) FILTER (ago < {m * 60000000} AND kind = 'click'), 0), 4) AS sell_vol_{m}m, "
    f"round((arg_max(price, (t, seq)) / coalesce(arg_max(price, (t, seq)) FILTER (ago >= {m * 60000000}), arg_min(price, (t, seq))) - 1) * 100, 6) AS price_chg_{m}m"
    for m in (5, 15, 60)
) + """ FROM (SELECT c.call_id, c.entry_t, p.t, p.seq, p.kind, p.price, c.entry_t - p.t AS ago FROM event_calls c JOIN price_events p USING (token) WHERE p.price > 0 AND c.entry_t - p.t BETWEEN 0 AND 3600000000) GROUP BY 1) x ON x.cid = c.call_id"""


@query(with_tables("price_events", "event_calls") + " " + PRECALL)
def precall_activity(spark: SparkSession, sf: str) -> DataFrame:
    return candles.precall(d.pool_activity(spark, sf), d.calls_on_events(spark, sf))


BUSY_CALLS = "busy AS (SELECT call_id, count(*) OVER (ORDER BY entry_t RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS calls_prev_1h, count(*) OVER (ORDER BY entry_t RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS calls_prev_24h FROM event_calls)"
PRIOR_CALLS = """prior AS (SELECT call_id, count(*) OVER w AS prior_calls, (entry_t - max(entry_t) OVER w) / 1e6 AS since_prior_s FROM event_calls
  WINDOW w AS (PARTITION BY token ORDER BY entry_t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
LIVE = """live AS (SELECT call_id, max(price) FILTER (kind = 'purchase') AS largest_buy_usd FROM event_calls c JOIN price_events p ON p.token = c.token AND p.t > c.entry_t - 3600000000 AND p.t <= c.entry_t GROUP BY 1)"""
MEASURES = ("return_pct", "max_gain_pct", "max_drawdown_pct")
SHORT = {"return_pct": "ret", "max_gain_pct": "max_gain", "max_drawdown_pct": "max_dd"}


@query(with_tables("price_events", "event_calls", "trades", "inv") + f""", {CANDLES}, {ENTRY}, {RETURNS}, {BUSY_CALLS}, {PRIOR_CALLS}, {LIVE}, verdicts AS ({VERDICT}), pre AS ({PRECALL}),
  t24 AS (SELECT c.call_id, CAST(CASE WHEN entry_t + 86400000000 <= {NOW_T} THEN coalesce(n, 0) END AS BIGINT) AS trades_24h FROM event_calls c LEFT JOIN (SELECT call_id, sum(events) AS n FROM candles WHERE interval_s = 300 GROUP BY 1) x USING (call_id)),
  wide AS (SELECT call_id, """ + ", ".join(f"max({m}) FILTER (horizon = '{h}') AS \"{SHORT[m]}_{h}\"" for m in MEASURES for h in d.HORIZONS) + """ FROM results GROUP BY 1)
  SELECT e.call_id, e.token, e.entry_price, e.entry_source, b.calls_prev_1h, b.calls_prev_24h, p.prior_calls, p.since_prior_s, l.largest_buy_usd, v.verdict, pre.* EXCLUDE (call_id), t24.trades_24h, wide.* EXCLUDE (call_id)
  FROM entries e LEFT JOIN busy b USING (call_id) LEFT JOIN prior p USING (call_id) LEFT JOIN live l USING (call_id) LEFT JOIN verdicts v USING (call_id) LEFT JOIN pre USING (call_id) LEFT JOIN t24 USING (call_id) LEFT JOIN wide USING (call_id)""")
def training_view(spark: SparkSession, sf: str) -> DataFrame:
    """One row per call: entry, how busy it was, earlier calls, the largest buy, the verdict known then, activity before it, trades of its first day, and return, peak and drawdown of each horizon."""
    trades, calls = d.trades(spark, sf).drop("ts"), d.calls_on_events(spark, sf)
    entries = tables.written(candles.entry_price(trades, calls))  # read three times
    wide = identity.pivot_measures(candles.horizon_returns(trades, entries, NOW_T), SHORT)
    pre = candles.precall(d.pool_activity(spark, sf), calls)
    busy = identity.busyness(calls, "call_id", "entry_t").withColumnsRenamed({"rows_1h": "calls_prev_1h", "rows_24h": "calls_prev_24h"})
    prior = identity.prior_calls(calls.withColumn("message_date", F.col("entry_at").cast("timestamp")))
    near = candles.within(calls, d.price_events(spark, sf).where("kind = 'purchase'").select("token", "t", "price"), 3600, 0, span=3600).where("t > entry_t - 3600000000 and t <= entry_t")
    live = near.groupBy("call_id").agg(F.max("price").alias("largest_buy_usd"))
    day = candles.trades_24h(candles.candles(trades, calls), calls, NOW_T)
    rows = entries.drop("entry_t")
    for side in (busy, prior, live, verdict_at_call(spark, sf).drop("requested_t"), pre, day, wide):
        rows = rows.join(side, "call_id", "left")
    return rows


LABELS = """labels_ AS (SELECT call_id, usable, round(net, 6) AS net_pct, CAST(net >= 50 AS INT) AS runner, CAST(net <= -70 AS INT) AS collapse
  FROM (SELECT call_id, return_pct IS NOT NULL AND return_pct <= 1e5 AS usable, ((1 + return_pct / 100) * (1 - coalesce(tax_pct, 0) / 100) * (1 - coalesce(tax_pct, 0) / 100) - 1) * 100 AS net FROM returns WHERE horizon = '7d'))"""


@query(with_tables("returns") + f", {LABELS} SELECT * FROM labels_")
def bucket_labels(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.labels(d.returns(spark, sf))


WALLETS = """known AS (SELECT p.wallet, p.token, p.t + 626400000000 AS at, l.runner FROM pairs p JOIN labels_ l USING (call_id) WHERE l.runner IS NOT NULL),
  hist AS (SELECT p.call_id, p.wallet, count(k.runner) AS n, CAST(coalesce(sum(k.runner), 0) AS BIGINT) AS ran FROM pairs p LEFT JOIN known k ON k.wallet = p.wallet AND k.token <> p.token AND k.at < p.t GROUP BY 1, 2)"""
PAIRS = "pairs AS (SELECT DISTINCT b.call_id, b.wallet, c.token, epoch_us(c.message_date) AS t FROM buys b JOIN calls c USING (call_id))"
DELAY = (7 * 86400 + 6 * 3600) * 1_000_000


@query(with_tables("calls", "buys", "returns") + f""", {LABELS}, {PAIRS}, {WALLETS} SELECT call_id, count(*) AS wallets, count(*) FILTER (n > 0) AS known_wallets,
  round(avg((ran + 1.0) / (n + 5)), 6) AS mean_share, round(max((ran + 1.0) / (n + 5)), 6) AS best_share FROM hist GROUP BY 1""")
def wallet_reputation(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.wallet_features(evaluation.wallet_history(d.live_buys(spark, sf), d.calls(spark, sf), bucket_labels(spark, sf), DELAY))


@query(with_tables("calls") + """, r AS (SELECT call_id, token, epoch_us(message_date) AS t, row_number() OVER (ORDER BY epoch_us(message_date), call_id) - 1 AS rank, count(*) OVER () AS n FROM calls),
  b AS (SELECT max(t) FILTER (rank = CAST(floor(n * 0.7) AS BIGINT)) AS b0, max(t) FILTER (rank = CAST(floor(n * 0.85) AS BIGINT)) AS b1 FROM r),
  p AS (SELECT r.*, b0, b1, min(t) OVER (PARTITION BY token) AS ft FROM r CROSS JOIN b),
  q AS (SELECT *, CASE WHEN t < b0 THEN 'train' WHEN t < b1 THEN 'valid' ELSE 'test' END AS own, CASE WHEN ft < b0 THEN 'train' WHEN ft < b1 THEN 'valid' ELSE 'test' END AS grp FROM p),
  c AS (SELECT *, CASE WHEN own <> grp THEN 'token' WHEN (own = 'train' AND t + 604800000000 >= b0) OR (own = 'valid' AND t + 604800000000 >= b1) THEN 'embargo' END AS dropped FROM q)
  SELECT call_id, CASE WHEN dropped IS NULL THEN own END AS part, dropped FROM c""")
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.time_split(d.calls(spark, sf), "message_date", "call_id", "token", 604_800_000_000)


SCORED = "scored AS (SELECT l.doc_id, l.quality AS y, l.toxic, CAST(d.n_chars AS DOUBLE) AS s FROM labels l JOIN documents d USING (doc_id))"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.read(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("s"))
    return d.read(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), "toxic", "s")


AUC = """SELECT CAST(sum(p) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS neg, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM (
    SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM scored GROUP BY s))"""


@query(f"WITH {SCORED} {AUC}")
def rank_auc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.auc(scored(spark, sf), "y", "s")


@query(f"WITH {SCORED} SELECT toxic, CAST(sum(p) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS neg, round(sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0), 6) AS auc FROM ("
       "SELECT *, coalesce(sum(n) OVER (PARTITION BY toxic ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT toxic, s, sum(y) AS p, count(*) - sum(y) AS n FROM scored GROUP BY toxic, s)) GROUP BY toxic")
def stratified_auc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.auc(scored(spark, sf), "y", "s", ["toxic"])


@query(f"WITH {SCORED} SELECT round(sum(cp / cn * p) / sum(p), 6) AS average_precision FROM (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM (SELECT s, sum(y) AS p, count(*) AS n FROM scored GROUP BY s) WINDOW w AS (ORDER BY s DESC))")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.average_precision(scored(spark, sf), "y", "s")


@query(f"""WITH {SCORED}, r AS (SELECT y, row_number() OVER (ORDER BY s DESC, doc_id) AS r, count(*) OVER () AS n, sum(y) OVER () AS p FROM scored),
  t AS (SELECT greatest(1, CAST(ceil(n * 0.1) AS BIGINT)) AS k, any_value(n) AS n, any_value(p) AS p, sum(y) FILTER (r <= greatest(1, ceil(n * 0.1))) AS hits FROM r GROUP BY 1)
  SELECT k, n, CAST(hits AS BIGINT) AS hits, round((hits / k) / (p / n), 6) AS lift,
    round(((hits / k) + 1.96 * 1.96 / (2 * k)) / (1 + 1.96 * 1.96 / k) - 1.96 * sqrt((hits / k) * (1 - hits / k) / k + 1.96 * 1.96 / (4 * k * k)) / (1 + 1.96 * 1.96 / k), 6) AS low,
    round(((hits / k) + 1.96 * 1.96 / (2 * k)) / (1 + 1.96 * 1.96 / k) + 1.96 * sqrt((hits / k) * (1 - hits / k) / k + 1.96 * 1.96 / (4 * k * k)) / (1 + 1.96 * 1.96 / k), 6) AS high FROM t""")
def top_share(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.top_share(scored(spark, sf), "y", "s", "doc_id", 0.1)


@query("""WITH v AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem), x AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM v)
  SELECT round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM x""")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.spearman(d.read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query(f"""WITH {SCORED}, r AS (SELECT y, s, row_number() OVER (ORDER BY s, doc_id) AS r, count(*) OVER () AS m FROM scored)
  SELECT CAST(greatest(1, ceil((r - 1) * 10 / (m - 1))) AS INT) AS decile, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(CAST(y AS DOUBLE)), 6) AS rate FROM r GROUP BY 1""")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.calibration(scored(spark, sf), "y", "s", "doc_id")


WEEKS = """SELECT strftime(date_trunc('week', c.message_date), '%Y-%m-%d') AS week, count(*) AS n, CAST(sum(l.runner) AS BIGINT) AS pos, count(*) FILTER (c.o_totalprice >= 200000) AS top_n,
  CAST(sum(CASE WHEN c.o_totalprice >= 200000 THEN l.runner ELSE 0 END) AS BIGINT) AS top_pos FROM calls c JOIN labels_ l USING (call_id) WHERE l.runner IS NOT NULL GROUP BY 1"""


@query(with_tables("calls", "returns") + f", {LABELS} {WEEKS}")
def week_sums(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.calls(spark, sf).join(bucket_labels(spark, sf).where("runner is not null"), "call_id")
    return evaluation.week_sums(rows, "message_date", F.col("runner"), F.col("o_totalprice") >= 200000)


@query()
def bootstrap_lift(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.bootstrap_lift(week_sums(spark, sf))


@query(with_tables("returns") + """ SELECT horizon, count(*) AS n, count(return_pct) AS with_data, count(*) FILTER (return_pct > 0) AS wins, count(*) FILTER (return_pct <= -50) AS collapses,
  count(*) FILTER (return_pct >= 50) AS runners, round(avg(return_pct), 6) AS mean, round(median(return_pct), 6) AS median FROM returns GROUP BY 1""")
def return_groups(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.group_stats(d.returns(spark, sf), ["horizon"])


#: Discounts around 3 %: values of both signs and many zeros. Bounds are picked by their places in the sorted values.
EQUAL_GROUPS = """vals AS (SELECT round(l_discount * 100) - 3 AS v FROM lineitem), about AS (SELECT count(*) FILTER (v < 0) AS neg, count(*) FILTER (v > 0) AS pos, count(*) FILTER (v = 0) AS zeros, count(*) AS n FROM vals),
  share AS (SELECT *, least(3, greatest(1, floor(4 * neg / (neg + pos) + 0.5))) AS below FROM about),
  sides AS (SELECT 'neg' AS side, CAST(below AS INT) AS k, (SELECT list(v ORDER BY v) FROM vals WHERE v < 0) AS sorted FROM share UNION ALL SELECT 'pos', CAST(4 - below AS INT), (SELECT list(v ORDER BY v) FROM vals WHERE v > 0) FROM share),
  uppers AS (SELECT DISTINCT side, sorted[CAST(ceil(g * len(sorted) / k) AS INT)] AS u FROM sides CROSS JOIN range(1, 6) r(g) WHERE g <= k),
  placed AS (SELECT v, CASE WHEN v < 0 THEN 'neg' WHEN v > 0 THEN 'pos' ELSE 'zero' END AS side, (SELECT min(u) FROM uppers WHERE u >= v AND side = CASE WHEN v < 0 THEN 'neg' ELSE 'pos' END) AS u FROM vals)"""


@query(f"WITH {EQUAL_GROUPS} SELECT min(v) AS low, max(v) AS high, count(*) AS n, side = 'zero' AS zero FROM placed GROUP BY side, CASE WHEN side <> 'zero' THEN u END")
def equal_count_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.read(spark, sf, "lineitem").select((F.round(F.col("l_discount") * 100) - 3).alias("v"))
    return analytics.equal_count_groups(rows, "v", 5, 0.05)


@query(with_tables("returns") + """, b AS (SELECT CAST((return_pct > -75)::INT + (return_pct > -50)::INT + (return_pct > -25)::INT + (return_pct > 0)::INT + (return_pct >= 25)::INT + (return_pct >= 50)::INT + (return_pct >= 100)::INT + (return_pct >= 300)::INT AS INT) AS band FROM returns)
  SELECT CAST(r.range AS INT) AS band, count(b.band) AS n FROM range(9) r LEFT JOIN b ON b.band = r.range GROUP BY 1""")
def return_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.histogram(d.returns(spark, sf))


@query(with_tables("returns") + """ SELECT horizon, CASE WHEN tax_pct >= 8 THEN 'rugged' WHEN return_pct <= -50 THEN 'collapse' WHEN return_pct <= 0 THEN 'loss' WHEN return_pct < 100 THEN 'gain' ELSE 'runner' END AS outcome, count(*) AS n FROM returns GROUP BY 1, 2""")
def outcome_mix(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.outcome_mix(d.returns(spark, sf), ["horizon"], F.col("return_pct"), F.col("tax_pct") >= 8)


@query("SELECT CAST((isodow(ts) - 1) AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def activity_heat(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.heat(d.read(spark, sf, "events"), "ts", "value")


@query(with_tables("calls", "returns") + """ SELECT call_id, round(sum(least(return_pct, 50.0)) OVER (ORDER BY message_date, call_id ROWS UNBOUNDED PRECEDING), 4) AS total
  FROM calls JOIN returns USING (call_id) WHERE horizon = '7d' AND return_pct IS NOT NULL""")
def cumulative_pl(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.calls(spark, sf).join(d.returns(spark, sf).where("horizon = '7d'"), "call_id")
    return analytics.cumulative_pl(rows, "message_date", "call_id", "return_pct", 50.0)


@query(with_tables("price_events", "event_calls", "trades") + f""", {ENTRY}, {RETURNS} SELECT multiple, count(*) AS n, count(*) FILTER (max_gain_pct >= (multiple - 1) * 100) AS hits,
  round(avg(CASE WHEN max_gain_pct >= (multiple - 1) * 100 THEN (multiple - 1) * 100 ELSE return_pct END), 6) AS mean, round(median(CASE WHEN max_gain_pct >= (multiple - 1) * 100 THEN (multiple - 1) * 100 ELSE return_pct END), 6) AS median
  FROM results CROSS JOIN (SELECT unnest([1.5, 2.0, 3.0, 5.0])::DOUBLE AS multiple) WHERE horizon = '7d' AND status = 'done' GROUP BY 1""")
def exit_rules(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.exit_rules(results(spark, sf).where("horizon = '7d'"), "max_gain_pct", "return_pct")


@query("""WITH items AS (SELECT l_returnflag AS grp, datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 30 AS t, l_linestatus = 'F' AS event FROM lineitem),
  a AS (SELECT grp, t, count(*) FILTER (event) AS events, count(*) AS n FROM items GROUP BY 1, 2), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY grp ORDER BY t DESC) AS BIGINT) AS at_risk FROM a),
  s AS (SELECT *, CASE WHEN max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY t) = 1 THEN 0.0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER (PARTITION BY grp ORDER BY t)) END AS survival FROM r)
  SELECT grp, CAST(t AS BIGINT) AS t, events, at_risk, round(survival, 6) AS survival FROM s WHERE events > 0""")
def kaplan_meier(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    items = d.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.expr("1").alias("_"), F.floor(days / 30).cast("long").alias("t"), (F.col("l_linestatus") == "F").alias("event"))
    return analytics.kaplan_meier(items, "t", "event", ["grp"])


@query("""WITH c AS (SELECT p_type AS v, count(*) AS c FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, v) AS n FROM c) SELECT CASE WHEN n <= 5 THEN v ELSE 'Other' END AS value, CAST(sum(c) AS BIGINT) AS n FROM r GROUP BY 1""")
def top_types(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.top_n_other(d.read(spark, sf, "part"), "p_type", 5)


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, CAST(row_number() OVER (ORDER BY n DESC, event_type) - 1 AS INT) AS code FROM c")
def event_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return identity.dictionary(d.read(spark, sf, "events"), "event_type")


TRANSFERS = """transfers AS (SELECT l_suppkey AS sender, o_custkey + 1000000 AS receiver, CAST(l_quantity AS BIGINT) AS value, epoch_us(l_shipdate) // 86400000000 AS block,
    row_number() OVER (PARTITION BY epoch_us(l_shipdate) // 86400000000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) + 1000000 AS idx FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT NULL, s_suppkey, 20000, 0, s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)"""


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    block = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 86400000000")
    place = Window.partitionBy("block").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = d.read(spark, sf, "lineitem").join(d.read(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("block", block)
    moved = line.select(F.col("l_suppkey").alias("sender"), (F.col("o_custkey") + 1000000).alias("receiver"), F.col("l_quantity").cast("long").alias("value"), "block", (F.row_number().over(place) + 1000000).cast("long").alias("idx"))
    minted = d.read(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.lit(None).cast("long").alias("sender"), F.col("s_suppkey").alias("receiver"), F.lit(20000).cast("long").alias("value"), F.lit(0).cast("long").alias("block"), F.col("s_suppkey").alias("idx"))
    return moved.unionByName(minted)


BALANCES = """moves AS (SELECT block, idx, sender AS address, -value AS delta, 0 AS side FROM transfers WHERE sender IS NOT NULL UNION ALL SELECT block, idx, receiver, value, 1 FROM transfers),
  run AS (SELECT *, sum(delta) OVER (PARTITION BY address ORDER BY block, idx, side) AS after FROM moves),
  balances AS (SELECT address, CAST(sum(delta) AS BIGINT) AS balance, coalesce(bool_or(after < 0 AND side = 0), false) AS negative FROM run GROUP BY 1)"""


@query(f"WITH {TRANSFERS}, {BALANCES} SELECT * FROM balances")
def ledger_balances(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.balances(transfers(spark, sf))


@query(f"""WITH {TRANSFERS}, {BALANCES}, h AS (SELECT balance, row_number() OVER (ORDER BY balance DESC, address) AS n FROM balances WHERE balance > 0)
  SELECT count(*) AS holders, CAST(sum(balance) AS BIGINT) AS circulating, round(sum(balance) FILTER (n <= 1) / sum(balance), 6) AS top1_share, round(sum(balance) FILTER (n <= 5) / sum(balance), 6) AS top5_share, round(sum(balance) FILTER (n <= 10) / sum(balance), 6) AS top10_share FROM h""")
def holder_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.holder_stats(ledger.balances(transfers(spark, sf)))


def ledger_trades(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy")
    return d.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("token"), F.col("l_suppkey").alias("trader"), side.alias("side"), F.col("l_quantity").cast("long").alias("amount"), F.expr("unix_micros(cast(l_shipdate as timestamp)) div 86400000000").alias("block"), F.col("l_orderkey").alias("idx"))


FLOW = "flow AS (SELECT l_partkey AS token, l_suppkey AS trader, CASE l_returnflag WHEN 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(l_quantity AS BIGINT) AS amount, epoch_us(l_shipdate) // 86400000000 AS block, l_orderkey AS idx FROM lineitem)"


@query(f"WITH {FLOW} SELECT token, count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side = 'sell') AS sells, count(DISTINCT trader) FILTER (side = 'buy') AS buyers, count(DISTINCT trader) FILTER (side = 'sell') AS sellers, CAST(coalesce(sum(amount) FILTER (side = 'buy'), 0) AS BIGINT) AS bought, CAST(coalesce(sum(amount) FILTER (side = 'sell'), 0) AS BIGINT) AS sold FROM flow GROUP BY 1")
def trade_flow(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.trade_flow(ledger_trades(spark, sf), "token")


@query(f"WITH {FLOW}, b AS (SELECT *, min(block) OVER (PARTITION BY token) AS first_block FROM flow WHERE side = 'buy') SELECT token, first_block, count(DISTINCT trader) AS snipers FROM b WHERE block <= first_block + 30 GROUP BY 1, 2")
def snipers(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.snipers(ledger_trades(spark, sf).where("side = 'buy'"), "token", 30)


@query(f"WITH {FLOW}, b AS (SELECT token, trader, min((block, idx)) AS start FROM flow WHERE side = 'buy' GROUP BY 1, 2) SELECT token, trader, CAST(row_number() OVER (PARTITION BY token ORDER BY start, trader) AS INT) AS place FROM b QUALIFY place <= 10")
def first_buyers(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.first_buyers(ledger_trades(spark, sf).where("side = 'buy'"), "token", 10)
