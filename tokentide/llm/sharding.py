"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows lie in hash blocks. How many rows of each block go to each shard of a uniformly random arrangement is one draw from
a multivariate hypergeometric distribution; the draws for all blocks form the communication matrix. With the matrix
fixed, each block permutes its own rows and deals them out, and each shard permutes what it received. No sort of all
rows is needed, and every shard has its exact size. Only keys, sizes and checksums move, never the texts.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentide.llm.common import materialise

#: Bounds of the number of blocks (and of the parts that each shard is permuted in); the matrix has blocks x shards cells.
LEAST_BLOCKS, MOST_BLOCKS = 96, 16384
#: Equal rows that are dealt out again at once.
RUN = 1 << 16


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows taken without putting back are among `good`: inversion, outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-18 and p_down < 1e-18:
            break
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard; row sums are `blocks`, column sums `shards`."""
    rng = random.Random(seed)
    room = list(shards)
    matrix = []
    for rows in blocks:
        left, rest, line = rows, sum(room), []
        for k, free in enumerate(room):
            rest -= free
            n = hypergeometric(rng, free, rest, left) if k < len(room) - 1 else left
            line.append(n)
            left -= n
        room = [a - b for a, b in zip(room, line, strict=True)]
        matrix.append(line)
    return matrix


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 17, rows_per_block: int = 1 << 18, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard and slot of every row: a uniform shuffle into shards whose counts differ by one at most.

    A null or empty text has size 8; a null text has checksum null. Rows that are equal in all three are counted and dealt
    out again with a number each, so that a million of them lie in as many blocks as others do. A null key is a key like
    any other. An empty table gives an empty result; other columns are ignored. Texts are only measured, whole, where they
    lie. Seeds and rows decide alone: a rerun agrees.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
    )
    alike = slim.groupBy(key, "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    # two steps, so that no array is longer than RUN
    runs = alike.withColumn("run", F.explode(F.expr(f"sequence(0, (n - 1) div {RUN})")))
    numbered = runs.withColumn("no", F.explode(F.expr(f"sequence(run * {RUN}, least(n, (run + 1) * {RUN}) - 1)")))
    slim = materialise(numbered.select(key, "size", "text_crc32", "no"))
    total = slim.count()
    n_blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, math.ceil(total / rows_per_block)))
    n_parts = min(MOST_BLOCKS // shards, max(8, math.ceil(total / shards / rows_per_block)))
    mix = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col(key), F.col("text_crc32"), F.col("no"))

    rows = slim.withColumn("block", F.pmod(mix(1), F.lit(n_blocks)))
    counts = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST_BLOCKS rows at most
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(n_blocks)], sizes, seed)
    ends = [[sum(line[: k + 1]) for k in range(shards)] for line in matrix]
    dealt = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("block_no", "ends"))

    local = Window.partitionBy("block").orderBy(mix(2), F.col(key), F.col("text_crc32"), F.col("size"), F.col("no"))
    sent = (
        rows.withColumn("at", F.row_number().over(local) - 1)
        .join(F.broadcast(dealt), F.col("block") == F.col("block_no"))  # n_blocks rows
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at"))))
        .withColumn("part", F.pmod(mix(3), F.lit(n_parts)))
        .select(key, "size", "text_crc32", "no", "shard", "part")
    )
    sent = materialise(sent)
    offsets = (
        sent.groupBy("shard", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n"))
        .select(F.col("shard").alias("to_shard"), F.col("part").alias("to_part"), "offset")
    )
    again = Window.partitionBy("shard", "part").orderBy(mix(4), F.col(key), F.col("text_crc32"), F.col("size"), F.col("no"))
    return (
        sent.withColumn("at", F.row_number().over(again) - 1)
        .join(F.broadcast(offsets), (F.col("shard") == F.col("to_shard")) & (F.col("part") == F.col("to_part")))  # MOST_BLOCKS rows at most
        .select(key, "size", "text_crc32", "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"))
    )


def shard_report(sharded: DataFrame, key: str = "doc_id") -> DataFrame:
    return sharded.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
