"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.llm.common import materialise


#: Edges that one task of a step gets, where there are fewer than fill the session's shuffle partitions.
EDGES = 1 << 18


def _least(edges: DataFrame, tasks: int) -> DataFrame:
    """Smallest neighbour, or the node itself if that is smaller."""
    return materialise(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return both.join(_least(both, tasks), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = down.join(_least(down, tasks), "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) of every node but the roots, from edges(u, v).

    Tasks of a step follow the number of edges, at most the session's shuffle partitions: a few edges don't wait for
    hundreds of empty tasks.
    """
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(edges)
    while seen[0]:
        tasks = -(-2 * seen[0] // EDGES)
        edges = materialise(_small_star(materialise(_large_star(edges, tasks).coalesce(tasks)), tasks).coalesce(tasks))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
