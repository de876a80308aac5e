"""Venue plans and holder rows against a replay of each call."""

import os

import pytest
from pyspark.sql import functions as F
from tests.holder_brute import check

from tokentide.operators import holder_rows
from tokentide.plans import holder_queries
from tokentide.sources.tables import written

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", [2, 3])
def test_rows_equal_a_replay_of_each_call(spark, seed):
    check(spark, seed, written)


def test_stretches_cover_each_number_once(spark):
    cases = [(a, b) for a in range(17) for b in range(a, 18)]
    rows = spark.createDataFrame(cases, "a long, b long").select("a", "b", holder_rows.stretches("a", "b", 5).alias("x")).collect()
    for r in rows:
        numbers = [n for x in r["x"] for n in range(x["node"] << x["level"], (x["node"] + 1) << x["level"])]
        assert sorted(numbers) == list(range(r["a"], r["b"]))


def test_overdraft_across_spans(spark):
    far = holder_rows.SPAN
    moves = [("t", "a", 0, 5, 1, 10), ("t", "a", 0, far + 3, 2, -7), ("t", "a", 0, 3 * far, 3, -4), ("t", "b", 0, far, 1, 1), ("u", "a", 0, 1, 1, 1), ("v", "a", 0, 9, 2, 5), ("v", "a", 0, 9, 1, -5)]
    table = spark.createDataFrame([(*m, 1 if m[5] > 0 else 0) for m in moves], "token string, address string, cut long, block long, idx long, delta long, side int")
    assert {r["token"]: r["overdrawn_at"] for r in holder_rows.first_overdraft(table).collect()} == {"t": 3 * far, "v": 9}


def test_no_calls(spark):
    from tests.holder_brute import CALLS, LIQUIDITY, TRANSFERS

    empty = [spark.createDataFrame([], s) for s in (CALLS, TRANSFERS, LIQUIDITY, "token string, pool_id string, init_block long")]
    assert holder_rows.holder_rows(*empty, keep=written).count() == 0


def test_no_table_goes_through_the_driver(spark):
    """The joins of the last step were broadcasts, of tables that are small as files but not in memory."""
    from decimal import Decimal

    from tests.holder_brute import CALLS, LIQUIDITY, TRANSFERS, ledger

    calls, transfers, events, pools = ledger(4)
    args = [written(spark.createDataFrame(rows, s)) for rows, s in ((calls, CALLS), ([(*r[:3], Decimal(r[3]), *r[4:]) for r in transfers], TRANSFERS), (events, LIQUIDITY), (pools, "token string, pool_id string, init_block long"))]
    plans = []

    def keep(df):
        if "top10" in df.columns or "kind" in df.columns:
            plans.append(df)
        return written(df)

    plans.append(holder_rows.holder_rows(*args, keep=keep))
    assert len(plans) > 2
    assert not [p for p in plans if "Broadcast" in p._jdf.queryExecution().sparkPlan().toString()]


def test_transfers_are_read_once(spark):
    """Transfers meet all of their token, blocks and venues, in one place; before, two steps read them, each for both sides."""
    from decimal import Decimal

    from tests.holder_brute import CALLS, LIQUIDITY, TRANSFERS, ledger

    calls, transfers, events, pools = ledger(4)
    args = [written(spark.createDataFrame(rows, s)) for rows, s in ((calls, CALLS), ([(*r[:3], Decimal(r[3]), *r[4:]) for r in transfers], TRANSFERS), (events, LIQUIDITY), (pools, "token string, pool_id string, init_block long"))]
    given, plans = set(args[1].inputFiles()), []
    plans.append(holder_rows.holder_rows(*args, keep=lambda df: plans.append(df) or written(df)))
    assert sum(bool(given & set(p.inputFiles())) for p in plans) == 1


def test_hot_tokens_give_the_same_rows(spark, monkeypatch):
    """Balances of tokens with many transfers are summed span by span."""
    monkeypatch.setattr(holder_rows, "HOT", 50)
    monkeypatch.setattr(holder_rows, "SPAN", 16)
    check(spark, 2, written)


def test_cuts_of_a_token_with_many_calls(spark):
    asked = {"t": list(range(5, 1000, 7)), "u": [3]}
    cuts = spark.createDataFrame([(t, b, n) for t, blocks in asked.items() for n, b in enumerate(blocks)], "token string, block long, cut long")
    rows = spark.createDataFrame([(t, b) for t in "tuv" for b in [*range(1010), None]], "token string, block long")
    got = {(r["token"], r["block"]): r["cut"] for r in holder_rows.with_cut(rows, holder_rows.runs(cuts)).collect()}
    assert got == {(t, b): sum(x < b for x in blocks) for t, blocks in asked.items() for b in range(blocks[-1] + 1)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_mints_are_made_by_many_tasks(spark):
    moved = holder_queries.tables(spark, DATA)[1].where("tx = 'mint'")
    assert moved.select(F.spark_partition_id()).distinct().count() > 4
