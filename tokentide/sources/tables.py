"""Reading and writing the domain's files: fixed schemas, CSV and JSON lines with explicit conventions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header: empty is null, booleans are true/t/1, anything that doesn't fit its type is null."""
    raw = spark.read.option("header", True).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).csv(path)

    def typed(f: T.StructField) -> Column:
        text = F.nullif(F.trim(F.col(f.name)), F.lit(""))
        if isinstance(f.dataType, T.BooleanType):
            return F.when(text.isNotNull(), F.lower(text).isin("true", "t", "1", "1.0")).alias(f.name)
        return text.try_cast(f.dataType.simpleString()).alias(f.name)

    return raw.select(*map(typed, schema))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV in the given order; null is empty, times are UTC in RFC 3339."""
    times = {f.name for f in df.schema if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType)}
    text = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) if c in times else F.col(c) for c in df.columns]
    df.orderBy(*order).select(*text).write.option("header", True).option("nullValue", "").option("emptyValue", "").mode("overwrite").csv(path)


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a line that was cut off is left out."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).json(path).where("_corrupt_record is null").drop("_corrupt_record")


def missing_rows(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Ids that a resumed export still has to write."""
    return ids.join(done.select(key).distinct(), key, "left_anti")


def check_columns(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Problems of an export: unknown or missing columns at once, repeated or missing keys as rows."""
    if df.columns != columns:
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(columns)) or 'order'}")
    repeated = df.groupBy(key).count().where("count > 1 or " + key + " is null")
    return repeated.select(F.col(key).cast("string").alias("key"), F.when(F.col(key).isNull(), "missing").otherwise("repeated").alias("problem"), F.col("count").alias("n"))


def rows_json(df: DataFrame, key: str) -> DataFrame:
    """Each row as JSON, null fields included."""
    return df.select(key, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def merge_feeds(env: DataFrame, stored: DataFrame) -> DataFrame:
    """asset -> feed from two maps: the environment wins, differing entries are flagged."""
    a, b = env.select("asset", F.col("feed").alias("env_feed")), stored.select("asset", F.col("feed").alias("stored_feed"))
    return a.join(b, "asset", "full_outer").select("asset", F.coalesce("env_feed", "stored_feed").alias("feed"), F.coalesce(F.col("env_feed") != F.col("stored_feed"), F.lit(False)).alias("conflict"))


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared scratch folder, for rows that a query reads more than once."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-scratch-")
    path = f"{folder.rstrip('/')}/tokentide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load_ids(spark: SparkSession, path: str, groups: dict[str, str] | None = None) -> DataFrame:
    """call_id and group of a CSV list of ids: trimmed, group labels mapped. Ids that aren't whole numbers or repeat are an error."""
    raw = spark.read.option("header", True).csv(path)
    label = F.lower(F.trim(F.col(raw.columns[1]))) if len(raw.columns) > 1 else F.lit(None).cast("string")
    for name, to in (groups or {}).items():
        label = F.when(label == name, to).otherwise(label)
    rows = raw.select(F.trim(F.col(raw.columns[0])).alias("raw"), label.alias("group"))
    ids = rows.select("raw", F.when(F.col("raw").rlike("^[0-9]+$"), F.col("raw").try_cast("long")).alias("call_id"), "group")
    bad = ids.agg(F.count_if(F.col("call_id").isNull()).alias("wrong"), (F.count("call_id") - F.count_distinct("call_id")).alias("repeated")).first()
    if bad["wrong"] or bad["repeated"]:
        raise ValueError(f"{bad['wrong']} ids aren't whole numbers, {bad['repeated']} repeat")
    return ids.select("call_id", "group")


def run_record(rows: DataFrame) -> DataFrame:
    """One row on an export: rows by status and reason, and sum, median, 90th percentile (nearest rank) and most requests of a row."""
    by = rows.groupBy("status", "skip_reason").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce("status", F.lit("none")), F.coalesce("skip_reason", F.lit("-")), F.col("n").cast("string")))).alias("counts"))
    nearest = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY requests)")
    asked = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("requests").alias("requests"), nearest(0.5).alias("median"), nearest(0.9).alias("p90"), F.max("requests").alias("most"))
    return asked.crossJoin(F.broadcast(by)).select(F.concat_ws(",", "counts").alias("counts"), "n", "requests", "median", "p90", "most")  # one row


def export_buys(buys: DataFrame, path: str) -> None:
    """Live buys in order of call and place."""
    write_csv(buys, path, ["call_id", "position"])


def rebuild_csv(spark: SparkSession, rows_path: str, schema: T.StructType, columns: list[str], path: str) -> None:
    """JSON lines as CSV with a fixed list of columns; a column that the lines lack is empty."""
    rows = read_rows(spark, rows_path, schema)
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.option("header", True).option("nullValue", "").mode("overwrite").csv(path)


def checked_update(rows: DataFrame, chosen: Column, changes: dict[str, Column], expected: int) -> DataFrame:
    """rows with `changes` where chosen; refused unless exactly `expected` rows are chosen."""
    n = rows.where(chosen).count()
    if n != expected:
        raise ValueError(f"{n} rows chosen, {expected} expected: nothing changed")
    return rows.withColumns({c: F.when(chosen, v).otherwise(F.col(c)) for c, v in changes.items()})
