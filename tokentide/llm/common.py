"""What the corpus operators share: the scratch folder, Arrow output in bounded pieces, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a missing doc_id in orders: after every other.
LAST = (1 << 63) - 1

_own_scratch: list[str] = []
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where that is unset, a temporary one in local mode, as in tests; on a cluster that is an error, since executors
    don't share the driver's disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="spark-scratch-"))
    return _own_scratch[0]


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tokentide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the tables that `materialise` wrote so far; returns how many. Results not yet saved are lost with them."""
    paths, _written[:] = _written[:], []
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_id(column: str = "doc_id") -> Column:
    """doc_id for orders and minima; a missing one comes last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_pieces(rows: Iterable[tuple], schema: pa.Schema, weigh: int | None = None, piece: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples; a new one after 4,096 rows, or when column `weigh` holds `piece` bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[weigh] or b"") if weigh is not None else 0
        if len(held) >= 4096 or size >= piece:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
