"""Queries over rugs, scores, lanes, audits and feature groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import candles, identity, lanes, rugs
from tokentide.plans import call_queries as c
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.plans.domain import with_tables
from tokentide.sources.tables import written

STATUSES = ("pending", "tracking", "no_pool", "error", "gave_up", "done", "repeat")
TRACKED = "tracked AS (SELECT o_orderkey AS call_id, ['pending', 'tracking', 'no_pool', 'error', 'gave_up', 'done', 'repeat'][o_orderkey % 7 + 1] AS status, o_custkey % 9 AS attempts FROM orders)"


def tracked(spark: SparkSession, sf: str) -> DataFrame:
    o = d.read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("call_id"), F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("status"), (F.col("o_custkey") % 9).alias("attempts"))


@query("""SELECT CASE WHEN rug IS NULL THEN 'none' WHEN rug <= entry THEN 'at_call' WHEN rug <= entry + 20 OR rug <= latest THEN 'event' ELSE 'detected' END AS kind, count(*) AS n
  FROM (SELECT CASE WHEN o_custkey % 5 > 0 THEN o_orderkey % 100 END AS rug, o_custkey % 100 AS entry, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 100 + 40 END AS latest FROM orders) GROUP BY 1""")
def rug_kinds(spark: SparkSession, sf: str) -> DataFrame:
    key, entry = F.col("o_orderkey"), F.col("o_custkey") % 100
    rug, latest = F.when(F.col("o_custkey") % 5 > 0, key % 100), F.when(F.col("o_custkey") % 2 == 0, entry + 40)
    kind = F.coalesce(rugs.rug_kind(rug, entry, entry + 20, latest), F.lit("none"))
    return d.read(spark, sf, "orders").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT call_id, r[3] AS rug_at, r[4] AS rug_kind FROM (SELECT l_orderkey AS call_id, max(row(l_returnflag <> 'R', l_linenumber, epoch_us(l_shipdate) // 86400000000, CASE l_returnflag WHEN 'A' THEN 'event' WHEN 'R' THEN 'price' ELSE 'at_call' END)) AS r FROM lineitem GROUP BY 1)""")
def merged_rugs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "event").when(F.col("l_returnflag") == "R", "price").otherwise("at_call")
    rows = d.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.expr("unix_micros(cast(l_shipdate as timestamp)) div 86400000000").alias("rug_at"), kind.alias("rug_kind"), F.col("l_linenumber").alias("written"))
    return rugs.merge_rugs(rows, "call_id")


@query(with_tables("price_events", "event_calls", "trades") + f""", {c.CANDLES}, {c.ENTRY}, {c.RETURNS}, hs AS (SELECT * FROM (VALUES {c.HORIZON_VALUES}) h(horizon, s)),
  done AS (SELECT call_id, max(entry_t // 1000000 + s) AS last_due, min(entry_t // 1000000 + s) FILTER (return_pct < -95) AS of_horizon FROM results JOIN entries USING (call_id) JOIN hs USING (horizon) WHERE status = 'done' GROUP BY 1),
  low AS (SELECT call_id, min(bucket_s) + 3600 AS of_candle FROM candles JOIN entries USING (call_id) JOIN done USING (call_id) WHERE interval_s = 3600 AND bucket_s < last_due AND close < entry_price * 0.05 GROUP BY 1)
  SELECT call_id, CAST(coalesce(CASE WHEN of_candle IS NOT NULL THEN least(of_candle, last_due) END, of_horizon, last_due) AS BIGINT) AS rug_s, CASE WHEN of_candle IS NOT NULL THEN 'candle' WHEN of_horizon IS NOT NULL THEN 'horizon' ELSE 'last_due' END AS rug_source FROM done LEFT JOIN low USING (call_id)""")
def price_rug_times(spark: SparkSession, sf: str) -> DataFrame:
    trades, calls = d.trades(spark, sf).drop("ts"), d.calls_on_events(spark, sf)
    entries = written(candles.entry_price(trades, calls))  # read four times
    seconds = F.create_map(*[F.lit(x) for h in d.HORIZONS.items() for x in h])
    results = candles.horizon_returns(trades, entries, c.NOW_T).where("status = 'done'").join(entries.select("call_id", "entry_t", F.col("entry_price").alias("_e")), "call_id")
    done = results.select("call_id", (F.expr("entry_t div 1000000") + seconds[F.col("horizon")]).cast("long").alias("due_s"), (F.col("_e") * (1 + F.col("return_pct") / 100)).alias("price"))
    return rugs.price_rug_at(entries, done, candles.candles(trades, calls))


@query("SELECT o_orderstatus, count(*) FILTER (coalesce(o_totalprice < 100000 * (o_custkey % 40) * 0.05, false) OR coalesce(side = 0 OR side < 500, false)) AS n_rugs, count(*) AS n FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4000 END AS side FROM orders) GROUP BY 1")
def final_rugs(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 4000)
    rug = rugs.final_rug(F.col("o_totalprice"), F.lit(100000) * (F.col("o_custkey") % 40), side, 500.0)
    return d.read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_if(rug).alias("n_rugs"), F.count(F.lit(1)).alias("n"))


BUCKETS = ["mid_7d", "mid_3d", "high_1d"]
SCORES = """sc AS (SELECT l_orderkey AS call_id, 'v' || l_suppkey % 3 AS version, ['mid_7d', 'mid_3d', 'high_1d', 'other'][l_linenumber % 4 + 1] AS bucket, CASE WHEN l_tax > 0 THEN l_discount END AS score, epoch_us(o_orderdate) AS call_t,
  epoch_us(o_orderdate) + CAST(l_quantity - 1 AS BIGINT) * 3600000000 AS scored_t, l_linenumber * 1000000000::BIGINT + l_partkey * 10000 + l_suppkey AS score_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def scores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    calls = d.read(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"), d.seconds("o_orderdate").alias("call_t"))
    bucket = F.element_at(F.array(*map(F.lit, [*BUCKETS, "other"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    line = d.read(spark, sf, "lineitem").join(calls, F.col("call_id") == F.col("l_orderkey"))
    return calls, line.select(
        "call_id", F.concat(F.lit("v"), (F.col("l_suppkey") % 3).cast("string")).alias("version"), bucket.alias("bucket"), F.when(F.col("l_tax") > 0, F.col("l_discount")).otherwise(float("nan")).alias("score"),
        (F.col("call_t") + (F.col("l_quantity") - 1).cast("long") * 3600000000).alias("scored_t"), (F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("score_id"),
    )


@query(f"""WITH {SCORES}, timely AS (SELECT * FROM sc WHERE scored_t - call_t <= 86400000000), f AS (SELECT call_id, arg_min(version, (scored_t, score_id)) AS version, min(scored_t) AS first_t FROM timely GROUP BY 1),
  wide AS (SELECT call_id, t.version, first_t, {', '.join(f"arg_max({{'s': score}}, (scored_t, score_id)) FILTER (bucket = '{b}') AS s_{b}" for b in BUCKETS)} FROM timely t JOIN f USING (call_id, version) WHERE bucket <> 'other' GROUP BY 1, 2, 3)
  SELECT o_orderkey AS call_id, version, first_t AS scored_t, {', '.join(f"s_{b}.s AS score_{b}" for b in BUCKETS)} FROM orders LEFT JOIN wide ON call_id = o_orderkey""")
def attached_scores(spark: SparkSession, sf: str) -> DataFrame:
    calls, found = scores(spark, sf)
    return rugs.attach_scores(calls, found, BUCKETS).select("call_id", "version", "scored_t", *[f"score_{b}" for b in BUCKETS])


@query(f"WITH {SCORES} SELECT version, count(DISTINCT call_id) AS n_calls, count(*) AS n_scores, round(quantile_cont((scored_t - call_t) / 1e6, 0.5), 3) AS median_s, CAST(row_number() OVER (ORDER BY count(DISTINCT call_id) DESC, version) AS INT) AS place FROM sc GROUP BY 1")
def model_versions(spark: SparkSession, sf: str) -> DataFrame:
    calls, found = scores(spark, sf)
    return rugs.model_live(found, calls)


@query(f"WITH {TRACKED} SELECT attempts, CAST(least(900 * pow(2, greatest(attempts - 1, 0)), 21600) AS BIGINT) AS wait_s, count(*) FILTER (attempts >= 5 AND call_id % 2 = 0 AND NOT call_id % 3 = 0) AS given_up, count(*) AS n FROM tracked WHERE status = 'error' GROUP BY 1, 2")
def error_waits(spark: SparkSession, sf: str) -> DataFrame:
    gone = lanes.give_up(F.col("attempts"), F.col("call_id") % 2 == 0, F.col("call_id") % 3 == 0, 5)
    return tracked(spark, sf).where("status = 'error'").groupBy("attempts", lanes.backoff(F.col("attempts")).alias("wait_s")).agg(F.count_if(gone).alias("given_up"), F.count(F.lit(1)).alias("n"))


@query(with_tables("calls") + f", {c.FIRST}, {TRACKED}" + """, x AS (SELECT t.*, f.call_id IS NOT NULL AS first, coalesce((f.call_id IS NULL AND status IN ('pending', 'tracking', 'no_pool', 'error', 'gave_up')) OR (calls.post_kind = 'update' AND status NOT IN ('done', 'repeat')) OR (f.call_id IS NOT NULL AND status = 'repeat'), false) AS changed
    FROM tracked t JOIN calls USING (call_id) LEFT JOIN firsts f USING (call_id))
  SELECT call_id, CASE WHEN changed AND first THEN 'pending' WHEN changed THEN 'repeat' ELSE status END AS status, CASE WHEN changed AND first THEN 0 ELSE attempts END AS attempts, changed FROM x""")
def marked_repeats(spark: SparkSession, sf: str) -> DataFrame:
    calls = d.calls(spark, sf)
    return lanes.mark_repeats(tracked(spark, sf), calls, identity.first_calls(calls))


QUEUE = with_tables("calls") + f", {TRACKED}, c AS (SELECT * FROM calls JOIN tracked USING (call_id)), done AS (SELECT call_id, token FROM c WHERE call_id % 11 = 0)" + """,
  q AS (SELECT call_id, token, message_date, message_date >= TIMESTAMP '1998-01-01' AS recent, lower(token) IN (SELECT lower(token) FROM done) AS investigated FROM c WHERE status IN ('pending', 'error') AND call_id NOT IN (SELECT call_id FROM done))"""


def queue(spark: SparkSession, sf: str) -> DataFrame:
    calls = d.calls(spark, sf).join(tracked(spark, sf), "call_id")
    return lanes.requeue(calls, calls.where("call_id % 11 = 0"), ("pending", "error"), F.expr("timestamp_ntz '1998-01-01 00:00:00'"))


@query(QUEUE + " SELECT * FROM q")
def requeued_calls(spark: SparkSession, sf: str) -> DataFrame:
    return queue(spark, sf)


@query(QUEUE + """, k AS (SELECT call_id, message_date, row_number() OVER (PARTITION BY lower(token) ORDER BY message_date DESC, call_id DESC) AS r FROM q WHERE recent), l AS (SELECT call_id FROM k WHERE r = 1 ORDER BY message_date DESC, call_id DESC LIMIT 40)
  SELECT call_id, CASE WHEN r > 1 THEN 'duplicate' WHEN call_id IN (SELECT call_id FROM l) THEN 'live' ELSE 'stored' END AS plan FROM k""")
def requeue_plan(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.requeue_plan(queue(spark, sf).where("recent"), 40)


@query(f"""WITH {TRACKED}, p AS (SELECT status, (o_custkey % 90) * 43200 AS age_s, o_orderkey % 5 = 0 AS rugged, o_orderkey % 4 = 1 AS wiped, attempts AS failed FROM tracked JOIN orders ON o_orderkey = call_id),
  r AS (SELECT *, CASE WHEN age_s > 3456000 THEN 'too old' WHEN rugged THEN 'rugged' WHEN wiped THEN 'wiped' WHEN failed >= 2 THEN 'failed' ELSE 'candidate' END AS reason FROM p)
  SELECT reason, CASE WHEN reason = 'candidate' THEN status END AS status, CASE WHEN reason = 'candidate' THEN CASE WHEN age_s < 86400 THEN '<1d' WHEN age_s < 604800 THEN '1-7d' WHEN age_s < 2592000 THEN '7-30d' ELSE '>30d' END END AS age, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def rescan_report(spark: SparkSession, sf: str) -> DataFrame:
    o = d.read(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"), (F.col("o_custkey") % 90 * 43200).alias("age_s"), (F.col("o_orderkey") % 5 == 0).alias("rugged"), (F.col("o_orderkey") % 4 == 1).alias("wiped"))
    pool = tracked(spark, sf).withColumnRenamed("attempts", "failed").join(o, "call_id")
    return lanes.rescan_summary(pool, F.col("age_s"), 40 * 86400)


@query("""SELECT user_id AS token, coalesce(bool_and(event_type <> 'view' OR CAST(floor(value) AS BIGINT) % 40 <> 0) AND bool_or(event_type = 'view'), false) AND coalesce(bool_and(event_type <> 'error' OR CAST(floor(value) AS BIGINT) % 30 > 1) AND bool_or(event_type = 'error'), false) AS deliver FROM events GROUP BY 1""")
def delivery_gates(spark: SparkSession, sf: str) -> DataFrame:
    e = d.price_events(spark, sf)
    whole = F.floor("price").cast("long")
    level = F.when(F.col("kind") == "view", F.when(whole % 40 == 0, "bad").otherwise("clean")).when(whole % 30 <= 1, "bad").otherwise("clean")
    return lanes.deliver_gate(e.select("token", F.col("kind").alias("tool"), level.alias("level")), "token", {"view": ["clean"], "error": ["clean"]})


IMPOSSIBLE = """t AS (SELECT o_orderkey AS call_id, o_orderpriority AS dex, CASE WHEN o_custkey % 50 = 0 THEN 2e5 ELSE o_totalprice / 1e3 END AS latest, pow(10, o_custkey % 60) AS state_price FROM orders),
  b AS (SELECT DISTINCT l_orderkey AS call_id FROM lineitem WHERE l_quantity * 2100 > 1e5), f AS (SELECT dex, b.call_id IS NOT NULL AS ret_big, latest > 1e5 AS latest_big, log10(state_price) - 12 > 38.5 AS bound_price FROM t LEFT JOIN b USING (call_id))"""


@query(f"""WITH {IMPOSSIBLE} SELECT CASE WHEN grouping(dex) = 1 THEN 'TOTAL' ELSE dex END AS dex, count(*) AS n, count(*) FILTER (ret_big) AS n_ret_big, count(*) FILTER (latest_big) AS n_latest_big, count(*) FILTER (bound_price) AS n_bound_price
  FROM f WHERE ret_big OR latest_big OR bound_price GROUP BY ROLLUP (dex)""")
def impossible_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    o = d.read(spark, sf, "orders")
    latest = F.when(F.col("o_custkey") % 50 == 0, 2e5).otherwise(F.col("o_totalprice") / 1e3)
    rows = o.select(F.col("o_orderkey").alias("call_id"), F.col("o_orderpriority").alias("dex"), latest.alias("latest_return_pct"), (F.pow(F.lit(10.0), F.col("o_custkey") % 60) / 2.0).alias("state_price"), F.lit(18).alias("token_dec"), F.lit(6).alias("quote_dec"))
    returns = d.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call_id"), (F.col("l_quantity") * 2100).alias("return_pct"))
    return lanes.impossible_outcomes(rows, returns, "dex")


@query("""WITH h AS (SELECT unnest(list_filter([CASE WHEN l_tax = 0 THEN 'no tax' END, CASE WHEN l_discount > 0.08 THEN 'price far off' END, CASE WHEN l_quantity < 3 THEN 'no size' END], lambda x: x IS NOT NULL)) AS reason, l_returnflag, l_linestatus FROM lineitem)
  SELECT reason, l_returnflag, l_linestatus, count(*) AS n FROM h GROUP BY GROUPING SETS ((reason), (reason, l_returnflag), (reason, l_linestatus))""")
def repair_reasons(spark: SparkSession, sf: str) -> DataFrame:
    reasons = {"no tax": F.col("l_tax") == 0, "price far off": F.col("l_discount") > 0.08, "no size": F.col("l_quantity") < 3}
    return lanes.repair_reasons(d.read(spark, sf, "lineitem"), reasons, ["l_returnflag", "l_linestatus"])


@query(f"""WITH {TRACKED}, ids AS (SELECT DISTINCT l_suppkey AS list, l_orderkey * 2 AS call_id FROM lineitem WHERE l_linenumber = 1)
  SELECT list, coalesce(status, 'missing') AS status, count(*) AS n FROM ids LEFT JOIN tracked USING (call_id) GROUP BY 1, 2""")
def listed_fates(spark: SparkSession, sf: str) -> DataFrame:
    lists = d.read(spark, sf, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("list"), F.expr("l_orderkey div 1000").alias("part")).agg(F.collect_set(F.col("l_orderkey") * 2).alias("ids"))
    return lanes.fate(lists, tracked(spark, sf))


@query(f"""WITH {TRACKED}, r AS (SELECT call_id, status IN ('done', 'error', 'gave_up') AS rugged, CASE attempts WHEN 0 THEN 'price' WHEN 1 THEN 'event' WHEN 2 THEN 'at_call' END AS rug_kind, call_id % 5 > 0 AS has_done, call_id % 3 = 0 AS has_candle, CASE WHEN call_id % 13 > 0 THEN 1.0 END AS entry_price FROM tracked)
  SELECT CASE WHEN NOT rugged THEN 'not rugged' WHEN rug_kind IN ('at_call', 'event') THEN 'drained' WHEN rug_kind = 'price' THEN 'by price' WHEN entry_price IS NULL THEN 'no entry price' WHEN NOT has_done THEN 'no done horizon' WHEN has_candle THEN 'fill from candles' ELSE 'fill from horizons' END AS class, count(*) AS n FROM r GROUP BY 1""")
def rug_classes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("attempts") == 0, "price").when(F.col("attempts") == 1, "event").when(F.col("attempts") == 2, "at_call")
    rows = tracked(spark, sf).select(F.col("status").isin("done", "error", "gave_up").alias("rugged"), kind.alias("rug_kind"), (F.col("call_id") % 5 > 0).alias("has_done"), (F.col("call_id") % 3 == 0).alias("has_candle"), F.when(F.col("call_id") % 13 > 0, 1.0).alias("entry_price"))
    return lanes.classify_rugs(rows)


@query("""SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(avg(v), 6) AS mean
  FROM (SELECT l_returnflag, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS v FROM lineitem) GROUP BY 1""")
def feature_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.read(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("v"))
    return lanes.by_group(rows, "l_returnflag", "v")


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 9 > 0 THEN p_size END AS size, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice END AS age FROM part), q AS (SELECT quantile_cont(size, 1/3) AS a, quantile_cont(size, 2/3) AS b FROM p)
  SELECT CASE WHEN size IS NULL OR age IS NULL THEN NULL ELSE CASE WHEN size <= a THEN 'T1' WHEN size <= b THEN 'T2' ELSE 'T3' END || CASE WHEN age < 1200 THEN ' young' ELSE ' old' END END AS stratum, count(*) AS n FROM p, q GROUP BY 1""")
def size_age_strata(spark: SparkSession, sf: str) -> DataFrame:
    part = d.read(spark, sf, "part").select(F.when(F.col("p_partkey") % 9 > 0, F.col("p_size")).alias("size"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_retailprice")).alias("age"))
    return lanes.strata(part, "size", "age", 1200.0).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
  SELECT l_returnflag, round(avg(l_extendedprice - m * l_quantity - b), 3) AS mean, round(sqrt(avg(pow(l_extendedprice - m * l_quantity - b, 2))), 3) AS rms FROM lineitem, l GROUP BY 1""")
def residual_spread(spark: SparkSession, sf: str) -> DataFrame:
    rows = lanes.residuals(d.read(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return rows.groupBy("l_returnflag").agg(F.round(F.avg("residual"), 3).alias("mean"), F.round(F.sqrt(F.avg(F.col("residual") * F.col("residual"))), 3).alias("rms"))


@query()
def permuted_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Chance level of the best of two features at telling good documents, shuffled within sources."""
    labels = d.read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = d.read(spark, sf, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id").withColumn("lines", F.col("n_chars") % 17)
    return lanes.permuted_null(rows, "quality", ["n_chars", "lines"], "source", "doc_id", 100)
