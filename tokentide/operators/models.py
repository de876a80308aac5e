"""Models of runners and collapses with Spark ML: baseline, boosted trees, calibration, drift, and checks by week and by feature."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.operators.evaluation import auc
from tokentide.operators.refits import fitted_folds, fitted_weeks, fold_scores, week_scores
from tokentide.operators.resampling import REPS, auc_draws, interval
from tokentide.sources.tables import written

#: Days before the newest row that count as recent for calibration, and rows of either class needed there.
RECENT_DAYS, CLASS_ROWS = 14, 20


def _inputs(columns: list[str], skewed: list[str]) -> list:
    logs = ", ".join(f"log1p(greatest(`{c}_full`, 0)) AS `{c}_in`" if c in skewed else f"`{c}_full` AS `{c}_in`" for c in columns)
    return [Imputer(strategy="median", inputCols=columns, outputCols=[f"{c}_full" for c in columns]), SQLTransformer(statement=f"SELECT *, {logs} FROM __THIS__"), VectorAssembler(inputCols=[f"{c}_in" for c in columns], outputCol="_inputs")]


def as_doubles(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Inputs as doubles; what isn't finite is missing."""
    value = lambda c: F.col(c).cast("double")
    return rows.withColumns({c: F.when(~F.isnan(value(c)) & (F.abs(value(c)) < float("inf")), value(c)) for c in columns})


def fit_baseline(train: DataFrame, y: str, columns: list[str], skewed: list[str] | None = None, ridge: float = 1e-3) -> PipelineModel:
    """Logistic regression on medians for missing values, logs of skewed inputs, and standardised columns."""
    stages = [*_inputs(columns, skewed or []), StandardScaler(inputCol="_inputs", outputCol="_scaled", withMean=True, withStd=True), LogisticRegression(featuresCol="_scaled", labelCol=y, regParam=ridge, maxIter=50)]
    return Pipeline(stages=stages).fit(as_doubles(train, columns))


def fit_trees(train: DataFrame, y: str, columns: list[str], held_out: str | None = None, rounds: int = 30, depth: int = 4, seed: int = 7) -> PipelineModel:
    """Boosted trees; where rows are marked as held out, boosting stops once they no longer improve."""
    trees = GBTClassifier(featuresCol="_inputs", labelCol=y, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed)
    if held_out:
        trees = trees.setValidationIndicatorCol(held_out)
    return Pipeline(stages=[*_inputs(columns, []), trees]).fit(as_doubles(train, columns))


def scores(model: PipelineModel, rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """keep, the margin and the probability of each row."""
    out = model.transform(as_doubles(rows, columns))
    p = vector_to_array("probability")[1]
    return out.select(*keep, F.log(F.greatest(p, F.lit(1e-12)) / F.greatest(1 - p, F.lit(1e-12))).alias("margin"), p.alias("prob"))


def fit_platt(held: DataFrame, y: str) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of the outcome on the margin."""
    one = VectorAssembler(inputCols=["margin"], outputCol="_m").transform(held)
    m = LogisticRegression(featuresCol="_m", labelCol=y, regParam=0.0, maxIter=100).fit(one)
    return float(m.coefficients[0]), float(m.intercept)


def calibrated(rows: DataFrame, platt: tuple[float, float]) -> DataFrame:
    return rows.withColumn("prob", 1 / (1 + F.exp(-(F.lit(platt[0]) * F.col("margin") + platt[1]))))


def choose_platt(held: DataFrame, y: str, time: str) -> tuple[tuple[float, float], str]:
    """Calibration on recent held-out rows or on all: the one of the smaller Brier score on the later half, then fitted anew.

    Recent rows with too few of a class, or a slope that turns the order round, fall back to all.
    """
    t = F.col(time)
    ends = held.agg(F.percentile(t.cast("double"), 0.5).alias("middle"), F.max(t).alias("newest")).first()
    begin = ends["newest"] - RECENT_DAYS * 86_400_000_000
    counts = held.where(t >= begin).agg(F.sum(F.col(y).cast("int")).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    if min(counts["pos"] or 0, counts["n"] - (counts["pos"] or 0)) < CLASS_ROWS:
        return fit_platt(held, y), "all (too few recent rows)"
    recent = fit_platt(held.where(t >= begin), y)
    if recent[0] <= 0:
        return fit_platt(held, y), "all (recent rows turn the order round)"
    later = held.where(t >= ends["middle"])
    brier = lambda p: calibrated(later, p).agg(F.avg((F.col("prob") - F.col(y)) * (F.col("prob") - F.col(y)))).first()[0]
    early = held.where(t < ends["middle"])
    old = fit_platt(early, y)
    return (recent, "recent") if brier(recent) < brier(old) else (fit_platt(held, y), "all")


def folds(key: Column, k: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k))


def out_of_fold(rows: DataFrame, y: str, columns: list[str], key: str, k: int = 3, seed: int = 5) -> DataFrame:
    """key, y and the baseline's probability for each row by a model that wasn't fitted on it."""
    return out_of_folds(rows, y, {"prob": columns}, key, k, seed)


def out_of_folds(rows: DataFrame, y: str, sets: dict[str, list[str]], key: str, k: int = 3, seed: int = 5, ridge: float = 1e-3) -> DataFrame:
    """key, y and, under each set's name, the probability of each row by a baseline on that set of inputs that wasn't fitted on the row.

    All sets and folds are fitted at once by shared passes over the rows (`refits.fitted_folds`); rows and scores are written once.
    """
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    dealt = rows.select(F.col(key).alias("_key"), F.col(y).alias("_out"), F.col(y).cast("double").alias("_y"), folds(F.col(key), k, seed).alias("_fold"), *columns)
    dealt = written(as_doubles(dealt, columns))
    fit = fitted_folds(dealt, columns, list(sets.values()), k, ridge)
    return written(fold_scores(dealt, columns, ["_key", "_out"], list(sets), k, *fit).withColumnsRenamed({"_key": key, "_out": y}))


def delta_auc(rows: DataFrame, y: str, base: list[str], more: list[str], key: str, k: int = 3) -> DataFrame:
    """AUC of out-of-fold scores without and with further inputs, and the gain."""
    scored = out_of_folds(rows, y, {"prob_base": base, "prob_more": [*base, *more]}, key, k)
    a, b = (auc(scored, y, s).select(F.col("auc").alias(n)) for s, n in (("prob_base", "auc_base"), ("prob_more", "auc_more")))
    return a.crossJoin(F.broadcast(b)).withColumn("delta", F.round(F.col("auc_more") - F.col("auc_base"), 6))  # one row each


def drift(rows: DataFrame, is_test: Column, columns: list[str], key: str, k: int = 3) -> DataFrame:
    """How well test rows can be told from training rows by their inputs alone: out-of-fold AUC, 0.5 for no drift."""
    marked = rows.withColumn("_test", is_test.cast("int"))
    return auc(out_of_fold(marked, "_test", columns, key, k), "_test", "prob").select(F.col("auc").alias("drift_auc"), F.col("pos").alias("n_test"), F.col("neg").alias("n_train"))


def importance(model: PipelineModel, columns: list[str], spark) -> DataFrame:
    """Share of each input in the trees' gains."""
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, model.stages[-1].featureImportances.toArray(), strict=True)], "feature string, share double")


def partial_dependence(model: PipelineModel, rows: DataFrame, columns: list[str], feature: str) -> DataFrame:
    """Mean probability with a feature set to its lower and upper quartile on every row, and the difference."""
    cuts = rows.agg(F.percentile(feature, F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first()["q"]
    at = lambda v, name: scores(model, rows.withColumn(feature, F.lit(float(v))), columns, []).agg(F.round(F.avg("prob"), 6).alias(name))
    low, high = at(cuts[0], "low"), at(cuts[1], "high")
    return low.crossJoin(F.broadcast(high)).select(F.lit(feature).alias("feature"), "low", "high", F.round(F.col("high") - F.col("low"), 6).alias("effect"))  # one row each


def walk_forward(rows: DataFrame, placed: DataFrame, y: str, columns: list[str], key: str, weeks: list[int], ridge: float = 1e-3) -> DataFrame:
    """key, y, margin, probability and week of each tested row, by a baseline refitted for its week, all weeks at once. placed: splits.walk_forward's intervals."""
    joined = written(as_doubles(rows, columns).withColumn("_y", F.col(y).cast("double")).join(placed, key))
    fit = fitted_weeks(joined, columns, weeks, ridge)
    return rows.select(key, y).join(week_scores(joined, columns, key, weeks, *fit), key)


def auc_interval(rows: DataFrame, y: str, x: str, key: str, reps: int = REPS, seed: int = 9) -> DataFrame:
    """AUC of a feature with its bootstrap interval; the direction is that of all rows.

    One sweep over the rows in order of the feature weighs them in all draws (`resampling.auc_draws`).
    """
    found = auc_draws(rows.withColumn("_y", F.col(y).cast("int")), "_y", x, key, [-1, *range(reps)], seed)
    draws = found.select(F.col("auc")[0].alias("a"), F.slice("auc", 2, reps).alias("draws")).withColumn("turned", F.col("a") < 0.5)
    flip = lambda c: F.when(F.col("turned"), 1 - c).otherwise(c)
    ends = draws.withColumn("ends", interval(F.transform("draws", lambda v: F.when(F.col("turned"), 1 - v).otherwise(v))))
    return ends.select(F.round(flip(F.col("a")), 6).alias("auc"), F.round("ends.low", 6).alias("low"), F.round("ends.high", 6).alias("high"), "turned", F.size(F.filter("draws", lambda v: v.isNotNull())).cast("long").alias("reps"))


def screening(blocks: DataFrame, least: float = 0.55) -> DataFrame:
    """Verdict of each feature from its interval: passes where all of it lies above one half and the value is large enough."""
    verdict = F.when(F.col("auc").isNull() | F.col("low").isNull(), "NOT JUDGED").when((F.col("low") > 0.5) & (F.col("auc") >= least), "CONTINUE").otherwise("STOP")
    return blocks.withColumn("verdict", verdict)
