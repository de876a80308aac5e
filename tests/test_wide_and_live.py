"""Numbers of 256 bits, scoring of calls in flight, and latest prices by timers."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from tests.test_chain import LOG, log, words
from tokentide.functions import wide
from tokentide.operators import chain, models
from tokentide.streaming import latest, scoring


def test_differences_of_words_are_exact(spark):
    rng = random.Random(1)
    numbers = [0, 1, 2**60, 2**60 - 1, 2**120, 2**240, 2**240 - 1, 2**256 - 1, 10**27, 10**27 + 1, 10**38, 10**38 - 1] + [rng.randrange(2 ** rng.randrange(1, 257)) for _ in range(60)]
    pairs = [(f"{a:064x}", f"{b:064x}", str(a), str(b)) for a in numbers for b in rng.sample(numbers, 9) + [a]] + [(None, "0" * 64, None, None), ("12", "0" * 64, None, None)]
    rows = spark.createDataFrame(pairs, "a string, b string, x string, y string").select("x", "y", wide.difference(F.col("a"), F.col("b")).alias("d"), wide.compared(F.col("a"), F.col("b")).alias("c"), wide.whole(F.col("a")).alias("w")).collect()
    for r in rows:
        if r["x"] is None:
            assert r["d"] is None and r["w"] is None
            continue
        x, y = int(r["x"]), int(r["y"])
        assert r["c"] == (x > y) - (x < y) and abs(r["d"] - float(x - y)) <= 4e-16 * abs(x - y)
        assert (int(r["w"]) if r["w"] is not None else None) == (x if x < 10**38 else None)


def test_small_trades_of_large_reserves(spark):
    """At a reserve of 10^27 a double's step is above 10^11: smaller trades, and liquidity that moves the other side too, keep their sign."""
    big = 10**27
    rows = [log(1, "v2", words(big, big)), log(2, "v2", words(big - 5, big + 7), block=2), log(3, "v2", words(big + 1, big + 8), block=3), log(4, "v2", words(big + 2, big + 1), block=4), log(5, "v2", words(2**200, big), block=5)]
    got = {r["seq"]: (r["buy"], r["vol"]) for r in chain.trades(chain.decode_pool_events(chain.clean_logs(spark.createDataFrame(rows, LOG)))).collect()}
    assert got == {2: (True, 7e-6), 4: (False, 7e-6), 5: (False, 1e-6)}


def model(spark, slope):
    rows = spark.createDataFrame([(float(k), int(k % 10 >= 5) if slope > 0 else int(k % 10 < 5)) for k in range(10)] * 4, "x double, y int")
    return models.fit_baseline(rows, "y", ["x"], ridge=0.1)


def publish(spark, registry, version, slope, passed=True):
    scoring.publish(spark, registry, version, {"short": scoring.Published(model(spark, slope), ["x"], (1.0, 0.0), passed, [0.0, 0.25, 0.5, 0.75, 1.0])})


def test_calls_are_scored_once_by_the_newest_version(spark, tmp_path):
    registry, source, out = f"{tmp_path}/models", f"{tmp_path}/calls", f"{tmp_path}/scores"
    publish(spark, registry, 1, 1)
    schema = "call_id long, message_date timestamp, x double"
    put = lambda name, *rows: spark.createDataFrame(rows, "call_id long, message_date string, x double").withColumn("message_date", F.col("message_date").cast("timestamp")).coalesce(1).write.parquet(f"{source}/b={name}")

    def run():
        stream = scoring.once(spark.readStream.schema(schema).parquet(f"{source}/*"))
        stream.writeStream.foreachBatch(scoring.scorer(registry, out)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()

    put(0, (1, "2024-01-01 00:00:00", 9.0), (2, "2024-01-01 00:01:00", 0.0), (1, "2024-01-01 00:00:00", 9.0))
    run()
    publish(spark, registry, 2, -1, passed=None)
    spark.range(1).write.parquet(f"{registry}/version=3/bucket=short")  # a version that is still being written
    put(1, (3, "2024-01-02 00:00:00", 9.0), (2, "2024-01-01 00:01:00", 5.0))
    run()
    put(2, (1, "2024-03-01 00:00:00", 9.0), (4, "2024-03-01 00:00:00", None))  # call 1 again, long after the watermark
    run()
    run()
    rows = {r["call_id"]: r for r in spark.read.parquet(*[str(p) for p in sorted((tmp_path / "scores").iterdir()) if p.name.startswith("epoch=")]).collect()}
    n = spark.read.parquet(*[str(p) for p in sorted((tmp_path / "scores").iterdir()) if p.name.startswith("epoch=")]).count()
    assert n == len(rows) == 4 and [rows[k]["model_version"] for k in (1, 2, 3, 4)] == [1, 1, 2, 2]
    assert rows[1]["prob"] > 0.5 > rows[2]["prob"] and rows[3]["prob"] < 0.5 and rows[1]["passed"] and rows[3]["passed"] is None
    assert rows[1]["rank_pct"] > rows[2]["rank_pct"]


def test_no_version_is_an_error(spark, tmp_path):
    batch = spark.createDataFrame([(1, 2.0)], "call_id long, x double")
    try:
        scoring.scorer(f"{tmp_path}/none", f"{tmp_path}/out")(batch, 0)
    except RuntimeError as e:
        assert "no complete model version" in str(e)
    else:
        raise AssertionError


def frame(*rows):
    return pd.DataFrame(rows, columns=["kind", "call_id", "ms", "seq", "price"])


def test_state_of_a_token():
    state = latest.take_in(None, frame(("price", None, 50, 1, 2.0), ("call", 7, 100, 0, 2.0), ("call", 6, 100, 0, 2.5), ("price", None, 40, 9, 1.0)))
    assert state[:6] == (6, 100, 2.5, 50, 2.0, False)
    state = latest.take_in(state, frame(("price", None, 45, 1, 9.0), ("price", None, 60, 2, 5.0), ("price", None, 60, 1, 4.0)))
    row, state = latest.told_of("t", state, 1000)
    assert row.iloc[0]["latest_price"] == 5.0 and row.iloc[0]["return_pct"] == 100.0 and row.iloc[0]["changed"] and row.iloc[0]["trade_ms"] == 60
    row, state = latest.told_of("t", state, 2000)
    assert not row.iloc[0]["changed"]
    state = latest.take_in(state, frame(("rug", None, 70, 1, None), ("price", None, 80, 1, 6.0)))
    row, _ = latest.told_of("t", state, 3000)
    assert row.iloc[0]["latest_price"] == 0.0 and row.iloc[0]["return_pct"] == -100.0 and row.iloc[0]["rugged"] and row.iloc[0]["changed"]
    row, _ = latest.told_of("t", latest.take_in(None, frame(("call", 1, 5, 0, None))), 10)
    assert row.iloc[0]["latest_price"] is None and row.iloc[0]["return_pct"] is None and not row.iloc[0]["changed"]


def test_cadence():
    day = 86_400_000
    assert latest.cadence(29 * day, 0, False) == 15 * 60_000 and latest.cadence(30 * day, 0, False) == day and latest.cadence(day, 0, True) == day


def test_checks_go_on_without_new_rows(spark, tmp_path):
    """Short cadences: a whole young call is checked again and again, a rugged one once more only after the long cadence."""
    now = int(time.time() * 1000)
    rows = [("A", "call", 1, now, 0, 2.0), ("a", "price", None, now + 1, 1, 3.0), ("b", "call", 2, now, 0, 2.0), ("b", "rug", None, now + 1, 1, None), ("c", "price", None, now, 1, 1.0), (None, "call", 3, now, 0, 1.0)]
    schema = "token string, kind string, call_id long, ms long, seq long, price double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b=0")
    stream = latest.latest_prices(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), often=300, seldom=600_000)
    query = stream.writeStream.format("memory").queryName("latest_checks").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("latest_checks").where("call_id = 1").count() < 3:
            time.sleep(0.5)
        found = spark.table("latest_checks").collect()
    finally:
        query.stop()
    mine = sorted((r for r in found if r["call_id"] == 1), key=lambda r: r["checked_ms"])
    assert len(mine) >= 3 and [r["changed"] for r in mine[:3]] == [True, False, False] and {r["return_pct"] for r in mine} == {50.0}
    assert [(r["rugged"], r["return_pct"]) for r in found if r["call_id"] == 2] == [(True, -100.0)] and {r["call_id"] for r in found} == {1, 2}
