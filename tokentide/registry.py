"""All registered queries of the analytics operators, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokentide.plans import audit_queries, call_queries, chain_queries, holder_queries, label_queries, lane_queries, list_queries, live_queries, model_queries, outcome_queries, position_queries, post_queries, score_queries, timing_queries, trial_queries, window_queries
from tokentide.plans.book import QUERIES, SQL, Query

assert audit_queries and live_queries and outcome_queries and holder_queries and timing_queries and trial_queries and model_queries and label_queries and list_queries and score_queries and window_queries and post_queries and chain_queries and lane_queries and position_queries  # they register their queries as they are imported
ENTRY_DATA = "/root/testdata/sf0.001"


def entry(spark: SparkSession, sf_dir: str = ENTRY_DATA) -> DataFrame:
    """The training view: one row per call with everything known at that moment, and its returns."""
    return call_queries.training_view(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
