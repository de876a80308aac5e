"""Pool logs, rugs, lanes and stateful streams on small hand-made rows."""

from pyspark.sql import functions as F

from tokentide.operators import chain, lanes, rugs
from tokentide.streaming import stateful

LOG = "token long, seq long, kind string, token_is_0 boolean, token_dec int, quote_dec int, event string, data string, block long, log_index long, removed boolean"


def words(*numbers):
    return "0x" + "".join(f"{n % 2**256:064x}" for n in numbers)


def log(seq, kind, data, event="swap", is0=True, block=1, removed=False):
    return (1, seq, kind, is0, 18, 6, event, data, block, seq, removed)


def decode(spark, *rows):
    return {r["seq"]: r for r in chain.decode_pool_events(chain.clean_logs(spark.createDataFrame(list(rows), LOG))).collect()}


def test_words_of_256_bits(spark):
    big = [0, 1, 2**64 - 1, 2**64, 2**130 + 2**100, 2**255 - 2**220]
    df = spark.createDataFrame([(words(n), n >= 0, float(n)) for n in [*big, -1, -(2**52), -(2**140), -(2**255)]], "data string, up boolean, want double")
    for r in df.select(chain.signed(chain.word(F.col("data"), 0)).alias("got"), "want").collect():
        assert r["got"] == r["want"]
    short = spark.createDataFrame([("0x12",), ("",), (None,)], "data string").select(chain.word(F.col("data"), 0).alias("w"))
    assert [r["w"] for r in short.collect()] == [None] * 3


def test_decoding_prices_and_drains(spark):
    x96 = 2**96
    got = decode(
        spark,
        log(1, "v2", words(2 * 10**18, 3 * 10**6)),
        log(2, "v2", words(3 * 10**6, 2 * 10**18), is0=False),
        log(3, "v2", words(0, 5 * 10**6)),
        log(4, "v3", words(-5, 7, x96 * 2, 10**12, -10)),
        log(5, "v3", words(-5, 7, x96 * 2, 10**12, -887200)),
        log(6, "v4", words(-5, 7, x96 * 2, 0, 0)),
        log(7, "v3", words(-5, 7, x96 * 2)),
        log(8, "curve", words(1_000_000, 10**18, 10_000, 5_000), event="buy"),
        log(9, "curve", words(10**18, 985_000, 10_000, 5_000), event="sell"),
        log(10, "curve", words(1, 1, 1, 1), event="completed"),
        log(11, "v2", "0x"),
        log(12, "v2", words(1, 1), removed=True),
    )
    assert 12 not in got and len(got) == 11
    assert got[1]["price"] == 1.5 and got[1]["liq_q"] == 3.0 and not got[1]["drained"]
    assert abs(got[2]["price"] - 1.5) < 1e-12
    assert got[3]["drained"] and got[3]["price"] is None and got[3]["liq_q"] == 5.0
    assert got[4]["price"] == 4e12 and got[4]["liq_q"] == 2e6
    assert got[5]["drained"] and got[6]["drained"] and got[6]["liq_q"] == 0.0
    assert got[7]["price"] == 4e12 and not got[7]["liq_known"] and not got[7]["drained"]
    assert abs(got[8]["price"] - 0.985) < 1e-12 and abs(got[9]["price"] - 1.0) < 1e-12 and not got[8]["liq_known"]
    assert got[10]["price"] is None and got[11]["price"] is None and not got[11]["drained"]


def test_v2_trades_compare_reserves(spark):
    rows = [log(1, "v2", words(1000, 1000)), log(2, "v2", words(900, 1100), block=2), log(3, "v2", words(1900, 2100), block=3), log(4, "v2", words(2000, 2000), block=4)]
    got = {r["seq"]: (r["buy"], r["vol"]) for r in chain.trades(chain.decode_pool_events(chain.clean_logs(spark.createDataFrame(rows, LOG)))).collect()}
    assert got == {2: (True, 1e-4), 4: (False, 1e-4)}


def test_rug_needs_a_known_price_or_a_certain_sign(spark):
    rows = spark.createDataFrame([(True, 10.0, False), (True, 0.0, False), (False, None, False), (False, None, True)], "liq_known boolean, liq_q double, drained boolean")
    flags = lambda usd: [r[0] for r in rows.select(chain.rug_flag(F.lit(usd).cast("double"), 500.0)).collect()]
    assert flags(1.0) == [True, True, False, True]
    assert flags(None) == [False, True, False, True] and flags(100.0) == [False, True, False, True]


def test_nothing_counts_from_the_rug_on(spark):
    rows = spark.createDataFrame([(1, 1, 1, False), (1, 2, 2, True), (1, 2, 3, False), (2, 5, 1, False)], "token long, block long, log_index long, rug boolean")
    assert sorted((r["token"], r["log_index"]) for r in chain.until_rug(rows, F.col("rug")).collect()) == [(1, 1), (2, 1)]
    assert chain.until_rug(rows.limit(0), F.col("rug")).count() == 0


def test_feed_looks_back_a_limited_time_only(spark):
    asked = spark.createDataFrame([(1, 7, 1000), (2, 7, 1100), (3, 7, 1101), (4, 8, 1000), (5, None, 1000)], "id long, asset long, at long")
    answers = spark.createDataFrame([(7, 1000, 1, 5.0), (7, 1000, 2, 6.0), (7, 1050, 3, -1.0)], "asset long, t long, seq long, answer double")
    got = {r["id"]: r["usd"] for r in chain.feed_asof(asked, answers, "asset", "at", 100, "usd").collect()}
    assert got == {1: 6.0, 2: 6.0, 3: None, 4: None, 5: None}


def test_a_price_rug_never_replaces_a_drained_one(spark):
    rows = spark.createDataFrame([(1, 10, "event", 1), (1, 20, "price", 2), (2, 5, "price", 1), (2, 6, "price", 2), (3, None, "event", 1)], "k long, rug_at long, rug_kind string, written long")
    assert {r["k"]: (r["rug_at"], r["rug_kind"]) for r in rugs.merge_rugs(rows, "k").collect()} == {1: (10, "event"), 2: (6, "price")}


def test_waits_double_up_to_six_hours(spark):
    got = [r[0] for r in spark.range(0, 9).select(lanes.backoff(F.col("id"))).collect()]
    assert got == [900, 900, 1800, 3600, 7200, 14400, 21600, 21600, 21600]


def test_value_ranks_are_mean_places(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in [3, 1, 3, 2, 9, 9, 9]], "feature string, x double")
    assert {r["x"]: r["rank"] for r in lanes.value_ranks(rows, 3).collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 3.5, 9.0: 6.0}


def test_chance_level_of_the_best_feature(spark):
    rows = spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).alias("week"), F.xxhash64("id").cast("double").alias("f"), F.lit(None).cast("double").alias("g"))
    r = lanes.permuted_null(rows, "y", ["f", "g"], "week", "id", 40).first()
    assert r["reps"] == 40 and 0.5 < r["null_auc"] < 0.7


def stream(spark, tmp_path, df, transform, name, mode):
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = transform(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_only_the_first_post_of_a_token_is_first(spark, tmp_path):
    df = spark.createDataFrame([(1, "0xA", 5), (2, "0xa", 4), (3, "0xb", 1), (4, None, 1)], "post_id long, token string, s long").select("post_id", "token", F.timestamp_seconds("s").alias("message_date"))
    got = {r["post_id"]: (r["first_post_id"], r["status"]) for r in stream(spark, tmp_path, df, stateful.first_seen, "seen_out", "append")}
    assert got == {1: (2, "duplicate"), 2: (2, "first"), 3: (3, "first")}


def test_running_state_ends_at_the_rug(spark, tmp_path):
    rows = [("a", 1, 1, 2.0, False), ("a", 2, 1, 5.0, False), ("a", 3, 1, None, True), ("a", 4, 1, 9.0, False), ("b", 1, 1, 3.0, False), ("c", 1, 1, None, None)]
    df = spark.createDataFrame(rows, "token string, block long, log_index long, price double, rug boolean")
    got = {r["token"]: tuple(r)[1:] for r in stream(spark, tmp_path, df, stateful.running_state, "running_out", "update")}
    assert got == {"a": (2, 5.0, 5.0, 2.0, 3), "b": (1, 3.0, 3.0, 3.0, None), "c": (0, None, None, None, None)}


def test_dust_is_no_drain_for_the_query(spark, tmp_path):
    import datetime as dt

    import duckdb
    import pandas as pd

    from tokentide import registry

    rows = [(k, u, "view", dt.datetime(2024, 1, 2, 3, k), v) for k, (u, v) in enumerate([(4, 0.004), (4, 0.5), (5, 0.02), (1, 0.004), (2, 7.25), (3, 0.001)], 1)]
    pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "ts", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    got = registry.queries()["decoded_pool_events"](spark, str(tmp_path)).select("seq", "drained").collect()
    want = duckdb.sql(registry.oracle_sql()["decoded_pool_events"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).df()
    assert {r["seq"]: r["drained"] for r in got} == dict(zip(want["seq"], want["drained"], strict=True))
    # the decoder itself takes any empty reserve for a drain
    assert decode(spark, log(1, "v2", words(5, 0)))[1]["drained"]


def test_prices_to_the_last_bit(spark):
    """A price 10/3 times another must come out on the same side of a bound in every engine."""
    cases = [(a, k) for a in (3, 7, 101, 977, 12345, 99991) for k in (1, 3, 7, 11, 13)]
    logs = [log(i, "curve", words(a * 10**4, k * 10**17, a * 100, a * 50), event="buy") for i, (a, k) in enumerate(cases)]
    logs += [log(1000 + i, "v3", words(-5, 7, (1 + a) << 80, k * 10**12, 3), is0=i % 2 == 0) for i, (a, k) in enumerate(cases)]
    got = decode(spark, *logs)
    for i, (a, k) in enumerate(cases):
        root = (1 + a) / 65536.0
        assert got[i]["price"] == a * 9850.0 / 1e6 / (k * 1e17 / 1e18)
        assert got[1000 + i]["price"] == (root**2 if i % 2 == 0 else 1 / root**2) * 1e12
        assert got[1000 + i]["liq_q"] == (k * 1e12 * root if i % 2 == 0 else k * 1e12 / root) / 1e6
