"""Edge rows of labels, splits, scorecards, lanes, holders, look-ups and streams."""

import random

import pytest
from pyspark.sql import functions as F

from tokentide.functions.ranks import running
from tokentide.operators import candles, evaluation, holders, labels, listing, models, pools, scorecard, splits, windows
from tokentide.operators.asof import as_of
from tokentide.sources import tables
from tokentide.streaming import live, stateful

S = 1_000_000
CALL = "call_id long, token string, message_date timestamp, post_kind string, tracking_status string, price_unit string, entry_price double, tax_buy_pct double, tax_sell_pct double, rugged boolean, trades_24h long, dex string"
OUTCOMES = ("max_gain_late_1d", "ret_late_1d", "ret_late_3d", "ret_late_7d", "ret_late_30d")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def calls(spark, *rows):
    """Calls with defaults; each row names what differs."""
    base = dict(token="t", message_date="2024-01-01 00:00:00", post_kind=None, tracking_status="done", price_unit="usd", entry_price=1.0, tax_buy_pct=None, tax_sell_pct=None, rugged=False, trades_24h=100, dex="x", **dict.fromkeys(OUTCOMES, 0.0))
    full = [{**base, "call_id": i, "token": f"t{i}", **r} for i, r in enumerate(rows)]
    names = [f.split(" ")[0] for f in CALL.split(", ")] + list(OUTCOMES)
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in full], CALL.replace("message_date timestamp", "message_date string") + ", " + ", ".join(f"{c} double" for c in OUTCOMES))
    return df.withColumn("message_date", F.col("message_date").cast("timestamp"))


def test_labels_of_each_bucket(spark):
    rows = calls(
        spark, dict(max_gain_late_1d=100.0, ret_late_1d=-50.0), dict(ret_late_3d=50.0), dict(ret_late_7d=-70.0), dict(ret_late_30d=0.1, rugged=True), dict(ret_late_7d=50.0, tax_buy_pct=10.0),
        dict(ret_late_3d=-60.0), dict(ret_late_30d=-90.0), dict(ret_late_7d=None), dict(ret_late_7d=float("nan")), dict(ret_late_1d=1e5 + 1), dict(ret_late_1d=1e5), dict(max_gain_late_1d=float("inf")),
    )
    got = {r["call_id"]: r for r in labels.build_labels(rows).collect()}
    assert (got[0]["runner_short"], got[0]["collapse_short"]) == (1, 1) and got[1]["runner_3day"] == 1 and got[2]["collapse_medium"] == 1
    assert (got[3]["runner_long"], got[3]["collapse_long"]) == (1, 1)  # rugged counts at 30 days only
    assert got[3]["collapse_medium"] == 0 and got[4]["runner_medium"] == 0 and got[5]["collapse_3day"] == 1 and got[6]["collapse_long"] == 1
    assert not got[7]["usable_medium"] and got[7]["runner_medium"] is None and got[7]["usable_short"] and not got[8]["usable_medium"]
    assert got[9]["extreme"] and not got[9]["usable_long"] and not got[10]["extreme"] and got[11]["extreme"]


def test_rows_that_labels_leave_out(spark):
    rows = calls(spark, dict(post_kind="update", token="A"), dict(token="a", message_date="2024-01-02 00:00:00"), dict(token="A", message_date="2024-01-03 00:00:00"), dict(tracking_status="repeat"), dict(tracking_status="no_pool"), dict(entry_price=None), dict(price_unit=None), dict(trades_24h=49), dict(trades_24h=None))
    got = {r["call_id"]: r for r in labels.build_labels(rows, dead_collapses=True, needs_trades=True).collect()}
    assert got[0]["update"] and not got[0]["repeat"] and not got[1]["repeat"] and got[2]["repeat"] and got[3]["repeat"]
    assert got[4]["no_pool"] and got[5]["no_pool"] and got[6]["not_usd"]
    assert got[7]["dead"] and got[7]["usable_medium"] and (got[7]["collapse_medium"], got[7]["collapse_plain_medium"]) == (1, 0) and not got[8]["dead"]
    reasons = {r["reason"]: r["n"] for r in labels.not_usable_reasons(labels.build_labels(rows)).collect()}
    assert reasons == {"update": 1, "repeat": 2, "no pool": 2, "not usd": 1}


def test_first_call_is_the_earliest_dated_one(spark):
    rows = calls(spark, dict(token="0xA", message_date=None), dict(token=" 0xa ", message_date="2024-01-02 00:00:00"), dict(token="0xa", message_date="2024-01-03 00:00:00"), dict(token=None), dict(token=None), dict(token=""), dict(token=""))
    got = {r["call_id"]: r["repeat"] for r in labels.build_labels(rows).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_pool_is_told_by_the_late_entry(spark):
    rows = calls(spark, dict(), dict(entry_price=None), dict()).withColumn("entry_late_price", F.when(F.col("call_id") < 2, 1.0).otherwise(float("nan")))
    assert {r["call_id"]: r["no_pool"] for r in labels.build_labels(rows).collect()} == {0: False, 1: False, 2: True}


def test_feature_table(spark):
    rows = spark.createDataFrame([(1, "usd", 10.0, 30.0, 3, 0, "12", 2, 0, 4.0, None), (2, "weth", 10.0, 30.0, 3, 1, "many", 2, None, None, None), (3, None, None, None, None, 1, "NaN", None, 5, None, 3.0)],
                                 "call_id long, pre_vol_unit string, pre_buy_vol_15m double, pre_sell_vol_15m double, pre_buys_60m int, pre_sells_60m int, holders string, calls_prev_1h int, calls_prev_24h int, live_buys_elite_usd double, live_buys_good_usd double").withColumn("liq_usd", F.lit(0.0))
    table = labels.feature_table(rows)
    got = {r["call_id"]: r for r in table.collect()}
    assert len(table.columns) == 1 + len(labels.RAW) + 3 * 8 + 5 + 3
    assert got[1]["pre_buy_vol_share_15m"] == 0.25 and got[2]["pre_buy_vol_share_15m"] is None and got[2]["pre_buy_vol_15m"] is None
    assert got[1]["pre_buy_sell_ratio_60m"] == 4.0 and got[2]["pre_buy_sell_ratio_60m"] == 2.0 and got[3]["pre_buy_sell_ratio_60m"] is None
    assert [got[k]["holders"] for k in (1, 2, 3)] == [12.0, None, None] and [got[k]["calls_prev_burst"] for k in (1, 2, 3)] == [48.0, None, None]
    assert got[1]["live_usd_to_liq"] is None and got[1]["hour_utc"] is None and got[3]["live_buys_good_usd"] == 3.0


def test_exchange_families(spark):
    want = {"Uniswap V4": "uniswap_v4", "uniswap_v2": "uniswap_v2", "UNISWAP": "uniswap", "Pons V2": "pons", "O1 Rwa": "o1", "Orbofi": "other", " - ": None, "": None, None: None}
    got = spark.createDataFrame([(k,) for k in want], "n string").select("n", labels.exchange_family(F.col("n")).alias("f"))
    assert {r["n"]: r["f"] for r in got.collect()} == want
    assert one(spark, labels.burst(F.lit(3), F.lit(0))) == 72.0 and one(spark, labels.burst(F.lit(2), F.lit(12))) == 4.0


def test_running_sums_by_slices(spark):
    rng = random.Random(1)
    rows = [(g, float(v), rng.randint(1, 5)) for g in ("a", None) for v in rng.sample(range(-500, 500), 300)]
    df = spark.createDataFrame(rows, "g string, v double, c int")
    for down in (False, True):
        got = {(r["g"], r["v"]): (r["c_upto"], r["c_all"]) for r in running(df, "v", ["c"], ["g"], down=down, slices=7).collect()}
        for g, v, _ in rows:
            assert got[g, v] == (sum(c for h, w, c in rows if h == g and (w >= v if down else w <= v)), sum(c for h, _, c in rows if h == g))
    assert running(df.where("c > 9"), "v", ["c"], ["g"]).count() == 0


def test_top_rows_break_ties_by_key(spark):
    df = spark.createDataFrame([(i, "g" if i < 10 else "h", float(s)) for i, s in enumerate([1, 2, 2, 2, 2, 0, 0, 0, 0, 3, 5, 5])], "id long, g string, s double")
    got = sorted(r["id"] for r in evaluation.top_rows(df, "s", "id", 0.3, ["g"]).where("top").collect())
    assert got == [1, 2, 9, 10]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_as_of_over_spans(spark, strict, forward):
    rng = random.Random(2)
    left = [(i, rng.choice("ab"), rng.randint(0, 1000)) for i in range(80)] + [(99, None, 5), (100, "c", 5)]
    right = [(rng.choice("ab"), rng.randint(0, 1000), k) for k in range(60)] + [(None, 4, 70), ("a", None, 71)]
    want = {}
    for i, k, t in left:
        fits = [r for r in right if k is not None and r[0] == k and r[1] is not None and ((r[1] > t if strict else r[1] >= t) if forward else (r[1] < t if strict else r[1] <= t))]
        best = (min if forward else max)(fits, key=lambda r: (r[1], r[2]), default=None)
        want[i] = best[2] if best else None
    a, b = spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, at long, n long")
    got = as_of(a, b, "k", "t", "at", ["n"], "n", strict=strict, forward=forward, span=50)
    assert {r["id"]: r["n"] for r in got.collect()} == want


def test_a_busy_token_has_the_same_results(spark):
    """Candles and horizons of one token with many calls and trades, against all trades held against all calls."""
    rng = random.Random(3)
    trades = sorted((rng.randint(0, 40 * 86400) * S, k, rng.choice([0.5, 1.0, 2.0, 3.0])) for k in range(1500))
    entries = [(c, rng.randint(0, 5 * 86400) * S, 1.0) for c in range(12)]
    t = spark.createDataFrame([("x", *r) for r in trades], "token string, t long, seq long, price double")
    e = spark.createDataFrame([(c, "x", at, p) for c, at, p in entries], "call_id long, token string, entry_t long, entry_price double")
    got = {(r["call_id"], r["horizon"]): (r["return_pct"], r["max_gain_pct"], r["max_drawdown_pct"]) for r in candles.horizon_returns(t, e, 1 << 60).collect()}
    for c, at, _ in entries:
        for h, s in (("1h", 3600), ("1d", 86400), ("3d", 259200), ("7d", 604800), ("30d", 2592000)):
            seen = [p for x, _, p in trades if at < x <= at + s * S]
            assert got[c, h] == (((seen[-1] - 1) * 100, (max(seen) - 1) * 100, (min(seen) - 1) * 100) if seen else (None, None, None))
    made = {(r["call_id"], r["interval_s"], r["bucket_s"]): (r["open"], r["high"], r["low"], r["close"], r["events"]) for r in candles.candles(t, e.drop("entry_price")).collect()}
    want = {}
    for c, at, _ in entries:
        for interval, length in ((300, 86400), (3600, 2592000)):
            for x, _, p in trades:
                if at <= x < at + length * S:
                    want.setdefault((c, interval, x // (interval * S) * interval), []).append(p)
    assert made == {k: (v[0], max(v), min(v), v[-1], len(v)) for k, v in want.items()}


def test_precall_price_change(spark):
    m = 60 * S
    events = [("a", 100 * m - 50 * m, 1, 2.0, "buy", 5.0), ("a", 100 * m - 10 * m, 2, 4.0, "sell", 1.0), ("a", 100 * m - 5 * m, 3, 5.0, None, 1.0), ("a", 100 * m, 4, 10.0, "buy", 2.0), ("a", 101 * m, 5, 99.0, "buy", 2.0), ("b", 100 * m - 2 * m, 6, 3.0, "buy", 1.0)]
    e = spark.createDataFrame(events, "token string, t long, seq long, price double, side string, amount double")
    c = spark.createDataFrame([(1, "a", 100 * m), (2, "b", 100 * m), (3, "none", 100 * m)], "call_id long, token string, entry_t long")
    got = {r["call_id"]: r for r in candles.precall(e, c).collect()}
    assert (got[1]["swaps_5m"], got[1]["swaps_15m"], got[1]["swaps_60m"], got[1]["buys_60m"], got[1]["sells_60m"], got[1]["buy_vol_60m"]) == (1, 3, 4, 2, 1, 7.0)
    assert (got[1]["price_chg_5m"], got[1]["price_chg_15m"], got[1]["price_chg_60m"], got[1]["first_trade_age_s"]) == (100.0, 400.0, 400.0, 3000.0)
    assert (got[2]["price_chg_60m"], got[2]["swaps_5m"]) == (0.0, 1) and (got[3]["swaps_60m"], got[3]["price_chg_60m"]) == (0, None)


def test_purged_folds_keep_tokens_and_horizons_apart(spark):
    day = 86_400
    rows = [(i, "same" if i in (0, 9) else f"t{i}", i * day) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, token string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r["id"]: (r["fold"], r["fit"]) for r in splits.purged_folds(df, "at", "id", "token", 1, k=5).collect()}
    assert [got[i][0] for i in range(10)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert got[0][1] == [2, 3, 4] or got[0][1] == [3, 4] or got[0][1] == [2, 3, 4]  # not 5: its token is held out there
    for i in range(10):
        for f in range(1, 6):
            held = [j for j in range(10) if got[j][0] == f]
            apart = i < min(held) - 1 or i > max(held) + 1
            shared = any(rows[j][1] == rows[i][1] for j in held)
            assert (f in got[i][1]) == (apart and not shared)


def test_gates_never_pass_on_missing_figures(spark):
    metrics = spark.createDataFrame([("a", 2.5, 0.5), ("b", None, 0.5), ("c", 2.5, 0.5)], "bucket string, top_lift double, collapse_removed double")
    weeks = spark.createDataFrame([("a", 1000, True), ("a", 999, False), ("b", 2000, True), ("c", 2000, None)], "bucket string, n_train long, sim_beats_all boolean")
    got = {r["bucket"]: (r["passed"], r["reasons"], r["windows_not_counted"]) for r in scorecard.gates(metrics, weeks, ["bucket"]).collect()}
    assert got == {"a": (True, "", 1), "b": (False, "lift", 0), "c": (False, "walk_forward", 0)}
    seeds = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None)], "bucket string, lift double")
    assert {r["bucket"]: r["median"] for r in scorecard.seed_median(seeds, "lift", ["bucket"], 2).collect()} == {"a": 2.0, "b": None}
    assert one(spark, scorecard.rank_percent(F.lit(2.0), F.array(*map(F.lit, (1.0, 2.0, 2.0, 3.0))))) == 50.0


def test_declines_and_replies(spark):
    long = "x" * 300 + " too little liquidity"
    cases = {" Not enough PUBLIC signals ": True, long: False, "fine": False, None: False, "\n too little liquidity" + " " * 400: True}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", listing.is_decline(F.col("t")).alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == cases
    assert one(spark, listing.latest_of(F.lit("unknown"), F.lit(9), F.lit("clean"), F.lit(1))) == "clean"
    assert one(spark, listing.latest_of(F.lit("clean"), F.lit(5), F.lit("caution"), F.lit(5))) == "caution"
    assert one(spark, listing.latest_of(F.lit("clean"), F.lit(6), F.lit("caution"), F.lit(5))) == "clean"


def test_recheck_steps(spark):
    rows = [(1, False, 0, False, 1), (2, False, 0, False, 5), (3, False, 0, False, 8), (4, True, 1, False, 4), (5, True, 1, False, 9), (6, False, 1, False, 8), (7, False, 1, True, 12), (8, False, 2, False, 12), (9, False, 1, False, 20)]
    pool = spark.createDataFrame(rows, "call_id long, usable boolean, rechecks long, delivered boolean, age long")
    got = {r["call_id"]: (r["step"], r["deliver_missed"], r["first_missed"], r["second_missed"]) for r in pools.recheck_steps(pool, F.col("age"), 3, 6, 9, 14).collect()}
    assert got[1][0] == "wait" and got[2][0] == "first" and got[3] == ("wait", False, True, False) and got[4][0] == "deliver" and got[5] == ("nothing", True, False, False)
    assert got[6][0] == "wait" and got[7][0] == "second" and got[8][0] == "nothing" and got[9] == ("nothing", False, False, True)


def test_trades_at_venues(spark):
    moves = [(1, "V", "w1", 5), (2, "w1", "v", 3), (3, "w1", "w2", 1), (4, "v", "0x000000000000000000000000000000000000dEaD", 9), (5, "v", "ex", 2), (6, "v", "w3", 7), (7, "w3", "V", 2), (8, "v", "w4", 0), (9, "v", "u", 1)]
    df = spark.createDataFrame([(n, s, r, v, str(n)) for n, s, r, v in moves], "n long, sender string, receiver string, value long, tx string")
    venues, ex = spark.createDataFrame([("v",), ("U",)], "address string"), spark.createDataFrame([("EX",)], "address string")
    lp = spark.createDataFrame([("v", "6", True, False), ("V", "7", False, True), ("v", "2", True, False)], "venue string, tx string, takes boolean, puts boolean")
    got = {r["n"]: (r["kind"], r["wallet"]) for r in holders.classify_trades(df, venues, ex, lp).collect()}
    assert got == {1: ("buy", "w1"), 2: ("sell", "w1"), 3: ("none", None), 4: ("none", None), 5: ("none", None), 6: ("liquidity", "w3"), 7: ("liquidity", "w3"), 8: ("none", None), 9: ("none", None)}


def test_time_held_above_twice_the_entry(spark):
    rows = [(1, None, None, None, None), (2, 100, 3600, 5000, False), (3, 100, 7200, 1000, False), (4, 100, 3599, None, True), (5, 100, 9000, None, True)]
    df = spark.createDataFrame(rows, "id long, first long, held long, fall long, cens boolean")
    got = {r["id"]: (r["reached"], r["short"], r["held_s"], r["hold_t"], r["fell"]) for r in windows.timing(df, "first", "held", "fall", "cens").collect()}
    assert got == {1: (False, False, 0, None, None), 2: (True, False, 3600, 3600, True), 3: (True, False, 7200, 900, True), 4: (False, True, 3599, None, None), 5: (True, False, 9000, 9000, False)}
    assert not windows.can_reach(3600) and windows.can_reach(86400)


def test_ids_and_checked_updates(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("call_id,group\n 1 , Pilot\n2,confirm\n")
    assert sorted(map(tuple, tables.load_ids(spark, str(tmp_path / "ids.csv"), {"pilot": "p"}).collect())) == [(1, "p"), (2, "confirm")]
    (tmp_path / "bad.csv").write_text("call_id,group\n1,a\n1,b\nx,c\n")
    with pytest.raises(ValueError, match="1 ids aren't whole numbers, 1 repeat"):
        tables.load_ids(spark, str(tmp_path / "bad.csv"))
    df = spark.range(4)
    assert [r["id"] for r in tables.checked_update(df, F.col("id") > 2, {"id": F.lit(9).cast("long")}, 1).orderBy("id").collect()] == [0, 1, 2, 9]
    with pytest.raises(ValueError, match="nothing changed"):
        tables.checked_update(df, F.col("id") > 2, {}, 2)


def test_models_find_a_clear_signal(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        x = rng.gauss(0, 1)
        rows.append((i, x if i % 10 else None, float("nan") if i % 7 == 0 else rng.random(), int(x + 0.3 * rng.gauss(0, 1) > 0), i * 86_400_000_000))
    df = spark.createDataFrame(rows, "id long, x double, z double, y int, t long")
    model = models.fit_baseline(df.where("id < 300"), "y", ["x", "z"], ["z"])
    held = models.scores(model, df.where("id >= 300"), ["x", "z"], ["id", "y", "t"])
    assert evaluation.auc(held, "y", "prob").first()["auc"] > 0.9
    platt, which = models.choose_platt(held, "y", "t")
    assert platt[0] > 0 and which.startswith("all")
    gain = models.delta_auc(df, "y", ["z"], ["x"], "id", k=2).first()
    assert gain["delta"] > 0.2
    block = models.auc_interval(df, "y", "x", "id", reps=40)
    r = models.screening(block).first()
    assert r["low"] <= r["auc"] <= r["high"] and r["low"] > 0.8 and r["verdict"] == "CONTINUE"


def test_due_horizons_as_time_goes_on(spark, tmp_path):
    base = 1704067200
    batches = [[(1, base), (2, base + 60)], [(1, base + 500), (3, base + 2 * 86400)], [(4, base + 40 * 86400)], [(5, base + 41 * 86400)]]
    schema = "call_id long, s long"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).select("call_id", F.timestamp_seconds("s").alias("entry_at")).coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
    stream = spark.readStream.schema("call_id long, entry_at timestamp, b int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("b")
    q = stateful.due_horizons(stream).writeStream.format("memory").queryName("due_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination()
    got = {(r["call_id"], r["horizon"]): r["due_ms"] for r in spark.table("due_out").collect()}
    assert got[1, "1h"] == (base + 3600) * 1000 and got[1, "1d"] == (base + 86400) * 1000  # the first entry stays
    assert {k[0] for k in got} == {1, 2, 3, 4} and max(got.values()) <= (base + 41 * 86400) * 1000  # nothing before its time


def test_upserts_keep_the_latest_and_runs_catch_up(spark, tmp_path):
    row = lambda *rows: spark.createDataFrame(list(rows), "id long, v string, n long").coalesce(1)
    row((1, "a", 1), (2, "b", 1)).write.parquet(f"{tmp_path}/in/b=0")
    schema = row((1, "a", 1)).schema
    run = lambda: live.catch_up(spark, schema, f"{tmp_path}/in/*", f"{tmp_path}/ck", live.into_table(f"{tmp_path}/out", ["id"], "n"))
    run()
    row((1, "edited", 2), (3, "c", 1), (2, "stale", 0)).write.parquet(f"{tmp_path}/in/b=1")
    run()
    run()  # nothing new
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/version=1").collect())) == [(1, "edited", 2), (2, "b", 1), (3, "c", 1)]


def test_weeks_are_fitted_at_once(spark, monkeypatch):
    """All weeks together give what a fit of each on its own rows gives; a week of one outcome predicts it."""
    import random

    from tokentide.operators import models

    rng = random.Random(3)
    rows, placed = [], []
    for k in range(1200):
        week, a, b = k // 100 + 1, rng.gauss(0, 3), rng.expovariate(1) if rng.random() < 0.8 else None
        rows.append((k, int(k >= 100 and rng.random() < 1 / (1 + 2.7 ** (0.4 - 0.5 * a - (b or 1)))), a, b, 5.0))
        placed.append((k, week + 1, 12 if week < 12 else None, week if week > 1 else None) if week < 12 else (k, None, None, week))
    rows, placed = spark.createDataFrame(rows, "id long, y int, a double, b double, c double"), spark.createDataFrame(placed, "id long, train_from long, train_to long, test_week long")
    joined, want = rows.join(placed, "id"), {}
    for w in (5, 12):
        model = models.fit_baseline(joined.where(f"train_from <= {w} and train_to >= {w}"), "y", ["a", "b", "c"])
        want |= {r["id"]: r["prob"] for r in models.scores(model, joined.where(f"test_week = {w}"), ["a", "b", "c"], ["id"]).collect()}
    monkeypatch.setattr(models, "fit_baseline", None)  # no fit for a single week
    got = {r["id"]: r for r in models.walk_forward(rows, placed, "y", ["a", "b", "c"], "id", list(range(2, 13))).collect()}
    assert len(got) == 1100 and {r["week"] for r in got.values()} == set(range(2, 13))
    assert max(abs(got[i]["prob"] - p) for i, p in want.items()) < 2e-3 and len(want) == 200
    assert all(got[i]["prob"] == 0 for i in range(100, 200))


def test_folds_are_fitted_at_once(spark, monkeypatch):
    """All folds and sets of inputs together give what a fit of each on its own rows gives; equal rows score alike, and a row without outcome is in no fit."""
    rng = random.Random(4)
    rows = []
    for k in range(900):
        a, b = rng.gauss(0, 3), rng.expovariate(1) if rng.random() < 0.8 else None
        rows.append((k, int(rng.random() < 1 / (1 + 2.7 ** (0.4 - 0.5 * a - (b or 1)))) if k % 100 else None, a, b if k % 50 != 7 else float("nan"), 5.0, k % 7))
    rows += [(k, k % 2, 1.0, 2.0, 5.0, 3) for k in range(900, 960)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, c double, d int")
    sets, dealt, want = {"few": ["b", "c"], "all": ["b", "c", "a", "d"]}, df.withColumn("f", models.folds(F.col("id"), 3, 5)), {}
    for name, columns in sets.items():
        for i in range(3):
            model = models.fit_baseline(dealt.where(f"f <> {i} and y is not null"), "y", columns)
            want |= {(name, r["id"]): r["prob"] for r in models.scores(model, dealt.where(f"f = {i}"), columns, ["id"]).collect()}
    monkeypatch.setattr(models, "fit_baseline", None)  # no fit for a single fold
    got = models.out_of_folds(df, "y", sets, "id").join(dealt.select("id", "f"), "id").collect()
    assert len(got) == 960 and sum(r["y"] is None for r in got) == 9 and len(want) == 1920
    assert max(abs(r[n] - want[n, r["id"]]) for r in got for n in sets) < 2e-3
    assert len({(r["f"], r["few"], r["all"]) for r in got if r["id"] >= 900}) == 3
    one = models.out_of_fold(df.where("id = 1"), "y", ["a"], "id").first()
    assert one["prob"] is None  # no row to fit on
    alike = models.out_of_fold(df.where("id > 100 and y = 1"), "y", ["a", "b"], "id").agg(F.min("prob"), F.max("prob")).first()
    assert tuple(alike) == (1.0, 1.0)
