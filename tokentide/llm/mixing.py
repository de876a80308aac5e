"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected the same number of times, target / source_size. Expected copies are summed up in
the order of the documents within the source; one random offset is added, and a document is taken once for each integer
boundary that its step crosses. Documents lie by size class and then at random, so every size gets its share and the
words taken come near the target. The place of a document comes from counts of small groups (source, size class, first
hash digit) and its rank within its group, so that no source has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentide.llm.common import materialise, word_count

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sizes(source, source_size) with the words each source should give: shares by weight, none above most x its size.

    The weights repeat over the sources by code point, null last. Excess goes to the others by weight until none is
    above: with sources in order of the level at which each is full, the first that isn't full at the level left for it
    and all after it sets that level.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_level = Window.partitionBy(F.lit(0)).orderBy("full_at", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("full_at", F.lit(most) * F.col("source_size") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - (F.sum(F.col("source_size") * most).over(by_level) - F.col("source_size") * most))
        .withColumn("weight_left", F.sum("weight").over(everything) - (F.sum("weight").over(by_level) - F.col("weight")))
        .withColumn("n_below", F.count(F.when(F.col("left") / F.col("weight_left") <= F.col("full_at"), 1)).over(by_level))
        .withColumn("first_level", F.max(F.when((F.col("n_below") == 1) & (F.col("left") / F.col("weight_left") <= F.col("full_at")), F.col("left") / F.col("weight_left"))).over(everything))
        .withColumn("target", F.when(F.col("n_below") == 0, (F.col("source_size") * most).cast("double")).otherwise(F.col("first_level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 11, key: str = "doc_id", order: tuple[str, ...] = ()) -> DataFrame:
    """Every document with size, source_size, target, copies (how often the mix takes it) and taken (words, repeats counted).

    A null text has size 0. A null source is a source, the last one. A source without words has target 0 and gives no
    copies. Rows that agree in key and size share places in the order of the columns `order`, which the result carries, or
    in either order; rows without a key lie at random by the first of them. Reruns agree. Other columns are ignored.
    """
    slim = materialise(docs.select(F.col(key), *order, F.col("source"), word_count(F.col("text")).alias("size")))
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = materialise(targets.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))

    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(*[F.col(c).cast("string") for c in (key, *order[:1])], F.lit("null"))))
    bits = F.length(F.bin("size"))
    placed = slim.withColumns({"digest": digest, "bits": bits, "top": F.expr("shiftright(size, greatest(0, length(bin(size)) - 4))"), "salt": F.substring(digest, 1, 1)})
    group = ["source", "bits", "top", "salt"]
    groups = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bits", "top", "salt")) - F.col("n"))
    named = lambda df, names: df.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in df.columns])
    placed = placed.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy("digest", key, *order)))
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = placed.join(named(groups.drop("n"), group), same)
    placed = placed.drop("_source", "_bits", "_top", "_salt").join(named(targets, ["source"]), F.col("source").eqNullSafe(F.col("_source")))
    start = (F.conv(F.substring(F.md5(F.concat(F.lit(f"offset:{seed}:"), F.coalesce("source", F.lit("null")))), 1, 2), 16, 10).cast("double") + 0.5) / 256
    rank = F.col("before") + F.col("at")
    copies = F.floor(start + rank * F.col("share")) - F.floor(start + (rank - 1) * F.col("share"))
    return placed.select(key, *order, "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
