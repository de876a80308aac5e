"""Scores of calls in flight: each call once, by the newest published model; versions change only between micro-batches.

A registry is a folder of versions. A version has a folder with a pipeline for each bucket and a table `meta` (bucket,
columns, slope, intercept, passed, reference), written last: a version without it doesn't count. Scores go to a folder
for each micro-batch that a repeated batch overwrites, so that a restart neither loses nor doubles one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import models, scorecard

META = "bucket string, columns array<string>, slope double, intercept double, passed boolean, reference array<double>"


@dataclass
class Published:
    """One bucket's model: its inputs, calibration, whether its gates passed, and the quantiles its ranks are read from."""

    model: PipelineModel
    columns: list[str]
    platt: tuple[float, float]
    passed: bool | None
    reference: list[float]


def _names(spark: SparkSession, path: str) -> list[str]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def publish(spark: SparkSession, registry: str, version: int, buckets: dict[str, Published]) -> None:
    """Write a version's models, and then its meta table, which makes it known."""
    for name, b in buckets.items():
        b.model.write().overwrite().save(f"{registry}/version={version}/bucket={name}")
    rows = [(name, b.columns, *map(float, b.platt), b.passed, [float(q) for q in b.reference]) for name, b in buckets.items()]
    spark.createDataFrame(rows, META).coalesce(1).write.mode("overwrite").parquet(f"{registry}/version={version}/meta")


def newest(spark: SparkSession, registry: str) -> int | None:
    """The highest version whose meta table is complete."""
    found = sorted((int(n.split("=")[1]) for n in _names(spark, registry) if n.startswith("version=")), reverse=True)
    return next((v for v in found if "_SUCCESS" in _names(spark, f"{registry}/version={v}/meta")), None)


def load(spark: SparkSession, registry: str, version: int) -> list[tuple[Row, PipelineModel]]:
    meta = spark.read.schema(META).parquet(f"{registry}/version={version}/meta").orderBy("bucket").collect()  # a row for each bucket
    return [(m, PipelineModel.load(f"{registry}/version={version}/bucket={m['bucket']}")) for m in meta]


def score(rows: DataFrame, key: str, version: int, loaded: list[tuple[Row, PipelineModel]]) -> DataFrame:
    """key, model_version, bucket, prob, rank_pct and passed of every row and bucket: features in, verdicts out."""

    def one(meta: Row, model: PipelineModel) -> DataFrame:
        found = models.calibrated(models.scores(model, rows, list(meta["columns"]), [key]), (meta["slope"], meta["intercept"]))
        reference = F.array(*map(F.lit, meta["reference"])).cast("array<double>")
        rank = F.when(F.size(reference) > 0, scorecard.rank_percent(F.col("prob"), reference))
        return found.select(key, F.lit(version).cast("long").alias("model_version"), F.lit(meta["bucket"]).alias("bucket"), "prob", rank.alias("rank_pct"), F.lit(meta["passed"]).cast("boolean").alias("passed"))

    return reduce(DataFrame.unionByName, [one(m, model) for m, model in loaded])


def once(calls: DataFrame, key: str = "call_id", time: str = "message_date", late: str = "7 days") -> DataFrame:
    """Each call once, however often its post is edited or read again within the watermark."""
    return calls.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def scorer(registry: str, path: str, key: str = "call_id") -> Callable[[DataFrame, int], None]:
    """A sink that scores a micro-batch with the newest version and appends it under `path` as epoch=<number>.

    A version is loaded once and kept until a newer one is there at the beginning of a batch. Calls that an earlier batch
    scored are left out, also those that come back long after the watermark. Without a version nothing is scored, and the
    batch fails, so that it is taken up again.
    """
    held: dict[int, list[tuple[Row, PipelineModel]]] = {}

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        version = newest(spark, registry)
        if version is None:
            raise RuntimeError(f"no complete model version in {registry}")
        if version not in held:
            held.clear()
            held[version] = load(spark, registry, version)
        earlier = [n for n in _names(spark, path) if n.startswith("epoch=") and int(n.split("=")[1]) < epoch]
        rows = batch.dropDuplicates([key])
        if earlier:
            done = spark.read.parquet(*[f"{path}/{n}" for n in earlier]).select(key).distinct()
            rows = rows.join(done, key, "left_anti")
        score(rows, key, version, held[version]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink
