"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tokentide import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


def plain(v):
    if v is None or (not isinstance(v, list | dict) and pd.isna(v)):
        return "null"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    try:
        return f"{float(v):.4f}"
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert registry.entry(spark).count() > 0


def test_bootstrap_interval_is_ordered(spark):
    r = registry.queries()["bootstrap_lift"](spark, DATA).first()
    assert r["low"] <= r["middle"] <= r["high"] and r["reps"] > 0
