"""As-of look-ups: the last (or next) row of a key at a time.

Time is cut into spans. Within a span one window over both sides finds the row; where a span has none so far, the last
row of the spans before is carried over, from a table of one row for each key and span. So a busy key is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Units of time in a span: a day of microseconds.
SPAN = 86_400_000_000


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], order: str, strict: bool = False, forward: bool = False, span: int = SPAN) -> DataFrame:
    """left with `values` of the last row of right at or before its time (strict: before; forward: first at or after).

    `order` breaks ties of right's time. Rows of left without a match get nulls; right's rows without time don't count.
    """
    kind = right.schema
    found_type = "struct<" + ",".join(f"`{v}`:{kind[v].dataType.simpleString()}" for v in values) + ">"
    row = F.struct(*left.columns)
    row_type = left.select(row.alias("_row")).schema["_row"].dataType
    first_side = 0 if (strict != forward) else 1
    mine = left.select(row.alias("_row"), F.col(key).alias("_key"), F.col(left_time).alias("_t"), F.lit(first_side).alias("_side"), F.lit(None).cast(kind[order].dataType).alias("_order"), F.lit(None).cast(found_type).alias("_found"))
    theirs = right.where(F.col(right_time).isNotNull()).select(F.lit(None).cast(row_type).alias("_row"), F.col(key).alias("_key"), F.col(right_time).alias("_t"), F.lit(1 - first_side).alias("_side"), F.col(order).alias("_order"), F.struct(*values).alias("_found"))
    both = mine.unionByName(theirs).withColumn("_span", F.floor(F.col("_t") / span))
    near = Window.partitionBy("_key", "_span").orderBy("_t", "_side", "_order")
    by_span = Window.partitionBy("_key").orderBy("_span")
    at = F.struct("_t", "_order")
    if forward:
        found = F.first("_found", ignorenulls=True).over(near.rowsBetween(0, Window.unboundedFollowing))
        edge = F.min_by("_found", at)
    else:
        found = F.last("_found", ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, 0))
        edge = F.max_by("_found", at)
    # spans of right only; a span of left between them looks to the nearest one
    edges = theirs.withColumn("_span", F.floor(F.col("_t") / span)).groupBy("_key", "_span").agg(edge.alias("_edge"))
    wanted = mine.select("_key", F.floor(F.col("_t") / span).alias("_span"), F.lit(None).cast(found_type).alias("_edge")).distinct()
    spans = edges.unionByName(wanted).groupBy("_key", "_span").agg(F.max_by("_edge", F.col("_edge").isNotNull()).alias("_edge"))
    side = by_span.rowsBetween(1, Window.unboundedFollowing) if forward else by_span.rowsBetween(Window.unboundedPreceding, -1)
    carry = (F.first if forward else F.last)("_edge", ignorenulls=True).over(side)
    carried = spans.select(F.col("_key").alias("_ck"), F.col("_span").alias("_cs"), carry.alias("_carry"))
    # plain equality: the rows stay where the window had them; a missing key or time finds nothing
    joined = both.withColumn("_found", found).where("_row is not null").join(carried.hint("merge"), (F.col("_key") == F.col("_ck")) & (F.col("_span") == F.col("_cs")), "left")
    got = F.when(F.col("_key").isNotNull(), F.coalesce("_found", "_carry"))
    return joined.withColumn("_found", got).select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])
