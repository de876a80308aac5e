"""Queries that fit models on labelled calls. SQL can't express a fit; tests hold the parts against known results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import evaluation, labels, models, splits
from tokentide.plans import domain as d
from tokentide.plans.book import query
from tokentide.sources import tables

INPUTS = ["liq_to_mcap", "live_usd_to_mcap", "mcap_vs_called", "pre_buy_sell_ratio", "pre_buy_vol_share", "hour_utc", "weekday_utc"]
SKEWED = ["liq_to_mcap", "live_usd_to_mcap", "mcap_vs_called"]


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Usable calls of the short bucket with their inputs and the part each belongs to, written once.

    The flags that orders tell by themselves come first: of each token one call at most is left, and only what is left is
    labelled. What the split reads several times is written.
    """
    free = tables.written(labels.flags(d.facts(spark, sf)).where("not (update or repeat or no_pool or not_usd)").select("call_id"))
    facts = d.facts(spark, sf, free)
    usable = labels.build_labels(facts, keep=[c for c in facts.columns if c != "call_id"]).where("usable_short")
    rows = tables.written(labels.features(usable, [F.col("runner_short").alias("y"), "token", "message_date", d.seconds("message_date").alias("t"), F.length("dex").alias("name_length")]))
    parts = evaluation.time_split(rows, "message_date", "call_id", "token", 86_400_000_000)
    return tables.written(rows.join(parts, "call_id"))


@query()
def baseline_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline fitted on the training part, calibrated on the validation part, scoring every other call."""
    rows = labelled(spark, sf)
    model = models.fit_baseline(rows.where("part = 'train'"), "y", INPUTS, SKEWED)
    held = tables.written(models.scores(model, rows.where("part = 'valid'"), INPUTS, ["call_id", "y", "t"]))
    platt, _ = models.choose_platt(held, "y", "t")
    return models.calibrated(models.scores(model, rows.where("part <> 'train' or part is null"), INPUTS, ["call_id", "y"]), platt).select("call_id", "y", "prob")


@query()
def boosted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees that stop by the validation part, scoring the test part."""
    rows = labelled(spark, sf).withColumn("held", F.col("part") == "valid")
    model = models.fit_trees(rows.where("part in ('train', 'valid')"), "y", INPUTS, "held", rounds=10)
    return models.scores(model, rows.where("part = 'test'"), INPUTS, ["call_id", "y"]).select("call_id", "y", "prob")


@query()
def input_drift(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled(spark, sf).where("part in ('train', 'test')")
    return models.drift(rows, F.col("part") == "test", INPUTS, "call_id")


@query()
def gain_of_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """What two inputs add to the others, out of fold."""
    return models.delta_auc(labelled(spark, sf), "y", INPUTS[:5], INPUTS[5:], "call_id")


@query()
def input_effect(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled(spark, sf)
    return models.partial_dependence(models.fit_baseline(rows, "y", INPUTS, SKEWED), rows, INPUTS, "liq_to_mcap")


@query()
def screened_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Each input's AUC with its interval, and whether to go on with it."""
    rows = labelled(spark, sf)
    blocks = [models.auc_interval(rows, "y", c, "call_id").withColumn("feature", F.lit(c)) for c in INPUTS]
    return models.screening(reduce(DataFrame.unionByName, blocks))


@query()
def weekly_refits(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every counted week by a model refitted for it."""
    rows = labelled(spark, sf)
    placed = tables.written(splits.walk_forward(rows, "message_date", "call_id", "token", 1))
    sizes = splits.week_sizes(placed).where("n_train >= 300 and n_test >= 3")
    weeks = sorted(r["week"] for r in sizes.collect())  # a number for each week
    if not weeks:
        return rows.select("call_id", "y", F.lit(None).cast("double").alias("prob"), F.lit(0).alias("week")).limit(0)
    return models.walk_forward(rows.select("call_id", "y", *INPUTS), placed, "y", INPUTS, "call_id", weeks).select("call_id", "y", "prob", "week")
