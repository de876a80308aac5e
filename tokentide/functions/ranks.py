"""Running sums and ranks over values that can be as many as the rows: no window runs over all of them.

Values are cut into slices at approximate quantiles. A running sum is what lies in the slices before plus what lies
before it in its own slice. The cuts decide only how even the slices are, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256


def _same(names: list[str]) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_k{c}"))
    return on


def running(counts: DataFrame, value: str, sums: list[str], by: list[str] | None = None, down: bool = False, slices: int = SLICES) -> DataFrame:
    """counts with `<c>_upto` (sum of c up to and with the row) and `<c>_all` (over the group) for each c of sums.

    counts has one row for each value of a group `by`; `down` sums from the highest value.
    """
    by = by or []
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = counts.agg(F.percentile_approx(F.col(value).cast("double"), shares).alias("_cuts"))
    cut = counts.crossJoin(F.broadcast(cuts)).withColumn("_slice", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda q: q < F.col(value)))).drop("_cuts")  # one row
    whole = Window.partitionBy(*(by or [F.lit(0)]))  # over slices: SLICES rows of a group at most
    order = whole.orderBy(F.desc("_slice") if down else F.asc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    per = cut.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_s{c}") for c in sums])
    per = per.select(*[F.col(c).alias(f"_k{c}") for c in (*by, "_slice")], *[F.coalesce(F.sum(f"_s{c}").over(order), F.lit(0)).alias(f"_b{c}") for c in sums], *[F.sum(f"_s{c}").over(whole).alias(f"{c}_all") for c in sums])
    within = Window.partitionBy(*by, "_slice").orderBy(F.desc(value) if down else F.asc(value))
    placed = cut.withColumns({f"_w{c}": F.sum(c).over(within) for c in sums}).join(per, _same([*by, "_slice"]))
    return placed.select(*counts.columns, *[(F.col(f"_b{c}") + F.col(f"_w{c}")).alias(f"{c}_upto") for c in sums], *[f"{c}_all" for c in sums])
