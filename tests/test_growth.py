"""Plans and steps whose shuffled bytes must grow no faster than the tables: the same joins at every size, rows that meet once."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tokentide import registry
from tokentide.operators import chain, labels, timing, verdicts
from tokentide.operators.asof import as_of
from tokentide.plans import domain as d
from tokentide.plans import model_queries
from tokentide.sources import tables

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
plan = lambda df: df._jdf.queryExecution().executedPlan().toString()


@given
@pytest.mark.parametrize("name", ["horizon_returns", "full_results"])
def test_small_tables_take_the_plan_of_large_ones(spark, name):
    """Tables small enough for a broadcast hide what is shuffled beyond it, and a call is sent on without its list of hours."""
    made = plan(registry.queries()[name](spark, DATA))
    assert "BroadcastExchange" not in made
    assert not re.search(r"Exchange hashpartitioning\([^)]*\)[^\n]*\n[^\n]*cut#", made) and "array_contains" not in made


def test_horizons_and_candles_meet_once(spark):
    horizons = spark.createDataFrame([], "call_id long, horizon string, entry_s long, late_s long, due_s long, entry_late double, peak_gain_pct double, rugged boolean, rug_s long")
    stored = spark.createDataFrame([], "call_id long, interval_s int, bucket_s long, high double, close double")
    assert plan(timing.horizon_timing(horizons, stored)).count("Exchange hashpartitioning") == 2


def test_a_row_without_time_finds_nothing(spark):
    left = spark.createDataFrame([(1, 7, None), (2, 7, 5)], "id long, k long, at long")
    right = spark.createDataFrame([(7, 6, 60, 1)], "k long, t long, v long, n long")
    for forward, want in ((True, {1: None, 2: 60}), (False, {1: None, 2: None})):
        assert {r["id"]: r["v"] for r in as_of(left, right, "k", "at", "t", ["v"], "n", forward=forward).collect()} == want


@given
@pytest.mark.parametrize(("name", "reads"), [("holder_features", 1), ("trading_metrics", 0)])
def test_shared_rows_are_made_once(spark, name, reads):
    """What several branches read is a written table; only balances still read the transfers themselves."""
    made = plan(registry.queries()[name](spark, DATA))
    assert len(re.findall(r"FileScan parquet \[[^\]]*\bl_", made)) == reads


@given
def test_liquidity_logs_are_read_and_decoded_once(spark):
    """One scan for the logs and one for the transfers; the three words of a log's data are built in one place."""
    made = plan(registry.queries()["liquidity_summary"](spark, DATA))
    assert len(re.findall(r"FileScan parquet \[[^\]]*\bl_", made)) == 2 and made.count("lpad(") <= 3


def test_liquidity_of_transactions(spark):
    """A deployer counts as paid only in a transaction with a removal, both up to the entry block; events without a transaction count, but pay nobody."""
    events = spark.createDataFrame([(1, "a", 5, "remove"), (1, "b", 20, "remove"), (1, None, 6, "add"), (2, None, 5, "remove"), (2, "", 10, "remove"), (3, "c", 5, "add"), (4, "d", 10, "remove"), (5, "e", 30, "add"), (6, "f", 1, "collect")], "token long, tx string, block long, lp string")
    transfers = spark.createDataFrame([(1, "a", 5, 7, 1.0), (1, "a", 5, 7, 2.0), (2, None, 5, 7, 1.0), (2, "", 5, 7, 1.0), (3, "c", 5, 7, 1.0), (4, "d", 9, 7, 0.0), (4, "d", 9, 9, 1.0), (5, "e", 1, 7, 1.0), (6, "f", 1, 7, 1.0)], "token long, tx string, block long, receiver long, value double")
    deployers = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7), (5, 7), (6, None)], "token long, deployer long")
    entries = spark.createDataFrame([(k, 10) for k in range(1, 7)], "token long, entry_block long")
    got = {tuple(r) for r in chain.liquidity_stats(events, transfers, deployers, entries).collect()}
    assert got == {(1, 1, 1, 0, True, True), (2, 0, 2, 0, True, False), (3, 1, 0, 0, False, False), (4, 0, 1, 0, False, False), (6, 0, 0, 1, False, None)}


def test_report_texts_are_searched_once(spark):
    """Each phrase is taken out of a text in one place, whatever the number of markers and uses."""
    rows = spark.range(1).select("id", F.col("id").cast("string").alias("text"))
    found = verdicts.text_verdict(rows, "text", ["red flag", "honeypot", "scam"], ["no red flag", "0 warnings"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Q0 warnings") == 1


@given
def test_labelled_calls_read_the_tables_once(spark, monkeypatch):
    """Orders are read for their own flags and for what these leave, lines once; before, each of five uses made all facts three times."""
    made, written = [], tables.written
    monkeypatch.setattr(tables, "written", lambda df: made.append(plan(df)) or written(df))
    rows = model_queries.labelled(spark, DATA)
    assert sum(len(re.findall(r"FileScan parquet \[[^\]]*\bl_", p)) for p in made) == 1
    assert sum(len(re.findall(r"FileScan parquet \[[^\]]*\bo_", p)) for p in made) == 2
    facts = d.facts(spark, DATA)
    usable = labels.build_labels(facts).where("usable_short").select("call_id", F.col("runner_short").alias("y"))
    want = labels.features(facts).join(usable, "call_id").join(facts.select("call_id", "token", "message_date"), "call_id")
    assert want.count() == rows.count() > 0 and want.exceptAll(rows.select(*want.columns)).count() == 0
