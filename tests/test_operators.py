"""Edge rows of the analytics operators, and streams against batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tokentide.functions.expressions import age_seconds, band, net_pct, outcome, parse_usd, wilson
from tokentide.operators import analytics, candles, evaluation, identity, ledger, posts
from tokentide.sources import tables
from tokentide.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_first_calls_keep_null_kind_and_ignore_case(spark):
    rows = [(1, "0xAB", "2024-01-02", "update"), (2, "0xab", "2024-01-03", None), (3, "0xAB", "2024-01-03", "call"), (4, "0xcd", "2024-01-01", "update")]
    df = spark.createDataFrame(rows, "call_id long, token string, message_date string, post_kind string").withColumn("message_date", F.col("message_date").cast("timestamp"))
    assert [r["call_id"] for r in identity.first_calls(df).collect()] == [2]


def test_prior_calls_leave_out_the_same_instant(spark):
    rows = [(1, "a", 0), (2, "a", 10), (3, "a", 10), (4, "a", 15)]
    df = spark.createDataFrame(rows, "call_id long, token string, s long").withColumn("message_date", F.timestamp_seconds("s")).withColumn("post_kind", F.lit("call"))
    got = {r["call_id"]: (r["prior_calls"], r["since_prior_s"]) for r in identity.prior_calls(df).collect()}
    assert got == {1: (0, None), 2: (1, 10.0), 3: (1, 10.0), 4: (3, 5.0)}


def test_text_helpers(spark):
    assert one(spark, parse_usd(F.lit("1,150.5"), F.lit("K"))) == 1150500.0
    assert one(spark, age_seconds(F.lit("1d 2h 3m"))) == 93780 and one(spark, age_seconds(F.lit("new"))) is None
    assert one(spark, net_pct(F.lit(100.0), F.lit(10.0), F.lit(None).cast("double"))) == pytest.approx(80.0)
    assert [one(spark, band(F.lit(v))) for v in (-75.0, -50.0, -25.0, 0.0, 25.0, 24.9, 100.0, 300.0, 1e9)] == [0, 1, 2, 3, 5, 4, 7, 8, 8]
    assert one(spark, outcome(F.lit(500.0), F.lit(True))) == "rugged" and one(spark, outcome(F.lit(0.0), F.lit(False))) == "loss"
    low, high = wilson(F.lit(5), F.lit(10))
    assert one(spark, low) == pytest.approx(0.2366, abs=1e-3) and one(spark, high) == pytest.approx(0.7634, abs=1e-3)


def test_markers_and_post_kind(spark):
    cases = {"$X hit 2.5x": "update", "hit 3xyz": "call", "": "call", "Mcap: $1k Liq: $2k hit 3x": "call", None: "call"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", posts.post_kind(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in df.collect()} == cases
    texts = {"precaution": False, "a caution": True, "non-caution": False, "canon-caution": True}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", posts.has_marker(F.col("t"), "caution").alias("k"))
    assert {r["t"]: r["k"] for r in df.collect()} == texts


def test_survival_curve(spark):
    items = [(0, True), (300, True), (900, True), (300, False), (600, False), (1200, False)]
    got = analytics.kaplan_meier(spark.createDataFrame(items, "t long, e boolean"), "t", "e").orderBy("t").collect()
    assert [(r["at_risk"], r["survival"]) for r in got] == [(6, 0.833333), (5, 0.666667), (2, 0.333333)]
    got = analytics.kaplan_meier(spark.createDataFrame([(10, True), (20, True), (20, True), (40, True)], "t long, e boolean"), "t", "e").orderBy("t").collect()
    assert [r["survival"] for r in got] == [0.75, 0.25, 0.0]


@pytest.mark.parametrize(("values", "k", "want"), [
    (list(range(1, 11)), 5, [(1, 2, 2, False), (3, 4, 2, False), (5, 6, 2, False), (7, 8, 2, False), (9, 10, 2, False)]),
    (list(range(1, 11)), 3, [(1, 4, 4, False), (5, 7, 3, False), (8, 10, 3, False)]),
    ([1, 1, 1, 1, 2, 3, 4, 5], 3, [(1, 1, 4, False), (2, 3, 2, False), (4, 5, 2, False)]),
    ([1] * 6 + [2, 3, 4, 5], 5, None),
    ([-3, -2, -1, 0, 0, 1, 2, 3, 4, 5, 6], 4, [(-3, -1, 3, False), (0, 0, 2, True), (1, 3, 3, False), (4, 6, 3, False)]),
    ([-1] * 8 + [0, 1, 2], 4, [(-1, -1, 8, False), (0, 0, 1, False), (1, 2, 2, False)]),  # one zero in eleven is no group of its own
    ([-1] * 8 + [0, 0, 1, 2], 4, [(-1, -1, 8, False), (0, 0, 2, True), (1, 1, 1, False), (2, 2, 1, False)]),
    ([0, 0], 3, [(0, 0, 2, True)]), ([float("nan"), None], 3, []), ([-0.0, 0.0, 5], 2, [(0, 0, 2, True), (5, 5, 1, False)]),
])
def test_equal_count_groups(spark, values, k, want):
    rows = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    groups = analytics.equal_count_groups(rows, "v", k)
    got = sorted(tuple(r) for r in groups.collect())
    assert sum(n for _, _, n, _ in got) == sum(v is not None and v == v for v in values) and all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))
    if want is not None:
        assert got == want
    placed = {(r["v"], r["group"]) for r in analytics.group_of(rows, "v", groups).collect()}
    assert all(g == -1 if v is None or v != v else got[g][0] <= v <= got[g][1] for v, g in placed)


def test_values_outside_all_groups_go_to_the_nearest(spark):
    groups = spark.createDataFrame([(-3.0, -2.0, 1, False), (0.0, 0.0, 2, True), (1.0, 3.0, 2, False), (5.0, 6.0, 1, False)], "low double, high double, n long, zero boolean")
    rows = spark.createDataFrame([(v,) for v in (-9.0, -1.0, 0.0, 0.5, 4.0, 99.0, None)], "v double")
    assert [r["group"] for r in analytics.group_of(rows, "v", groups).collect()] == [0, 0, 1, 2, 3, 3, -1]
    assert [r["group"] for r in analytics.group_of(rows, "v", groups.where("low >= 0")).collect()] == [0, 0, 0, 1, 2, 2, -1]


def test_self_transfer_beyond_the_balance_is_negative(spark):
    rows = [(None, 1, 10, 0, 0), (1, 1, 50, 1, 0), (None, 2, 5, 0, 1), (2, 3, 5, 2, 0)]
    got = {r["address"]: (r["balance"], r["negative"]) for r in ledger.balances(spark.createDataFrame(rows, "sender long, receiver long, value long, block long, idx long")).collect()}
    assert got == {1: (10, True), 2: (0, False), 3: (5, False)}


def test_history_known_at_the_same_moment_does_not_count(spark):
    calls = spark.createDataFrame([(1, "a", 0), (2, "b", 100), (3, "c", 101), (4, "a", 500)], "call_id long, token string, s long").withColumn("message_date", F.timestamp_seconds("s"))
    buys = spark.createDataFrame([(i, 7) for i in (1, 2, 3, 4)], "call_id long, wallet long")
    outcomes = spark.createDataFrame([(1, 1), (2, 0)], "call_id long, runner int")
    got = {r["call_id"]: (r["n"], r["ran"]) for r in evaluation.wallet_history(buys, calls, outcomes, 100 * 1_000_000).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 1), 4: (1, 0)}


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 1.0), (1, 2.0), (0, 0.0)], "y int, s double")
    assert evaluation.auc(df, "y", "s").first()["auc"] == 0.875
    assert evaluation.auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def test_merging_candles_is_associative(spark):
    schema = "call_id long, interval_s int, bucket_s long, open double, high double, low double, close double, events long"
    a, b, c = (spark.createDataFrame([(1, 300, 0, float(i), float(i + 5), float(i - 3), float(i + 1), i)], schema) for i in (1, 2, 3))
    left, right = candles.merge_candles(candles.merge_candles(a, b), c).first(), candles.merge_candles(a, candles.merge_candles(b, c)).first()
    assert left == right and left["events"] == 6 and (left["open"], left["close"]) == (1.0, 4.0)


def test_csv_and_json_conventions(spark, tmp_path):
    df = spark.createDataFrame([(1, None, True), (2, "x", False)], "id long, s string, b boolean").withColumn("at", F.lit(dt.datetime(2024, 1, 2, 3, 4, 5)))
    tables.write_csv(df, f"{tmp_path}/csv", ["id"])
    got = tables.read_csv(spark, f"{tmp_path}/csv", df.schema).orderBy("id").collect()
    assert [(r["id"], r["s"], r["b"]) for r in got] == [(1, None, True), (2, "x", False)]
    (tmp_path / "rows.jsonl").write_text('{"id": 1, "s": "a"}\n{"id": 2, "s": "b"}\n{"id": 3, "s')
    assert [r["id"] for r in tables.read_rows(spark, str(tmp_path / "rows.jsonl"), df.select("id", "s").schema).collect()] == [1, 2]
    with pytest.raises(ValueError, match="differ"):
        tables.check_columns(df, ["id"], "id")
    feeds = lambda *rows: spark.createDataFrame(rows, "asset string, feed string")
    merged = {r["asset"]: (r["feed"], r["conflict"]) for r in tables.merge_feeds(feeds(("a", "1"), ("b", "2")), feeds(("b", "3"), ("c", "4"))).collect()}
    assert merged == {"a": ("1", False), "b": ("2", True), "c": ("4", False)}


def test_streaming_candles_equal_batch(spark, tmp_path):
    rows = [("a", 1704067200 + 17 * i, i, float((i * 7) % 11 + 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "token string, s long, seq long, price double").select("token", F.timestamp_seconds("s").alias("ts"), "seq", "price")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = live.live_candles(stream).writeStream.format("memory").queryName("candles_out").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination()
    key = lambda r: (r["token"], r["bucket"])
    assert sorted(spark.table("candles_out").collect(), key=key) == sorted(live.live_candles(df).collect(), key=key)


def test_streamed_posts_come_once(spark, tmp_path):
    rows = [(1, 1, "x", 0), (1, 1, "x", 60), (1, 2, "x", 0), (1, 1, "y", 0)]
    df = spark.createDataFrame(rows, "channel_id long, message_id long, address_key string, s long").select("channel_id", "message_id", "address_key", F.timestamp_seconds(F.col("s") + 1704067200).alias("message_date"))  # the first watermark is 1970
    df.write.parquet(f"{tmp_path}/in")
    q = live.new_posts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("posts_out").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination()
    assert spark.table("posts_out").count() == 3
