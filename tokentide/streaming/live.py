"""Streaming counterparts: posts once, candles as events arrive, first-seen tokens, reports joined to calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.operators.posts import parse_metrics


def new_posts(addresses: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (channel, message, address) once, however often a post is edited or read again within the watermark."""
    return addresses.withWatermark("message_date", late).dropDuplicatesWithinWatermark(["channel_id", "message_id", "address_key"])


def live_candles(trades: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling candles per token; open and close by event order."""
    at = F.struct("ts", "seq")
    return (
        trades.withWatermark("ts", late).groupBy(F.window("ts", width), "token")
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("events"))
        .select("token", F.col("window.start").alias("bucket"), "open", "high", "low", "close", "events")
    )


def activity(events: DataFrame, width: str = "1 hour", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Sliding counts per token."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "token").agg(F.count(F.lit(1)).alias("n")).select("token", F.col("window.end").alias("until"), "n")


def bursts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a token's events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "token").agg(F.count(F.lit(1)).alias("n")).select("token", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def reports_of_calls(calls: DataFrame, reports: DataFrame, within: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Calls with the reports that arrive up to some time after them; calls without one come out with nulls."""
    c = calls.withWatermark("entry_at", late).alias("c")
    r = reports.select(F.col("token").alias("report_token"), "requested_at", "verdict").withWatermark("requested_at", late).alias("r")
    near = F.expr(f"report_token = token AND requested_at >= entry_at AND requested_at <= entry_at + interval {within}")
    return c.join(r, near, "left_outer").select("call_id", "token", "entry_at", "requested_at", "verdict")


def upsert_into(merge: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that skips empty batches and caches the others while `merge` uses them."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                merge(batch, epoch)
        finally:
            batch.unpersist()

    return sink


def parsed(posts: DataFrame) -> DataFrame:
    """Each post in flight with its numbers and kind: the batch parser, row by row."""
    return parse_metrics(posts)


def into_table(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the latest row of each key, by `order`, in a Parquet table of versions: edits and re-reads replace earlier rows.

    Each micro-batch writes a new version beside the last one and is safe to repeat: its number names the version, and a
    version is made from the newest one before it.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        older = sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and int(n.split("=")[1]) < epoch)
        rows = spark.read.schema(batch.schema).parquet(f"{path}/version={older[-1]}").unionByName(batch) if older else batch
        latest = rows.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("_row")).select("_row.*")
        latest.write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return upsert_into(merge)


def late_rows(events: DataFrame, time: str, newest: str, late: str) -> DataFrame:
    """How many rows of each batch lie further behind the newest time than the watermark allows."""
    behind = F.col(time) < F.col(newest) - F.expr(f"interval {late}")
    return events.agg(F.count(F.lit(1)).alias("n"), F.count_if(behind).alias("late"))


def catch_up(spark: SparkSession, schema: T.StructType, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Take in what arrived since the last run and stop: the checkpoint is the cursor, so nothing is read twice or missed."""
    stream = spark.readStream.schema(schema).parquet(path)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
