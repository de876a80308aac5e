"""How the live scores of each bucket did, small rules over posts and blocks, and grids by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.operators.asof import as_of
from tokentide.operators.posts import post_kind

#: Least rank of a top score, cap of a return, and how old the other chain's block may be, in seconds.
TOP_RANK, RETURN_CAP, MOST_BEHIND = 90.0, 1000.0, 600


def live_bucket_stats(rows: DataFrame, by: list[str], runner: Column, cap: float = RETURN_CAP) -> DataFrame:
    """scored, known, rates and mean capped returns of top-ranked and of all known calls, lift, first call and majority version.

    rows: t (time of the call), call_id, rank, passed, version, x and ret (both there once a call's window is over), one
    for each scored call. The majority version scored most calls; a tie goes to the one that comes first in order of t and
    call_id, and `passed` is that of its first call.
    """
    c = F.col
    known = c("x").isNotNull() & c("ret").isNotNull()
    top = known & F.coalesce(c("rank") >= TOP_RANK, F.lit(False))
    hit, ret = F.coalesce(runner, F.lit(False)), F.least(c("ret"), F.lit(cap))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(known).alias("known"), F.count_if(top).alias("top_n"), F.count_if(top & hit).alias("top_k"), F.count_if(known & hit).alias("all_k"),
        F.round(F.avg(F.when(top, ret)), 6).alias("top_mean"), F.round(F.avg(F.when(known, ret)), 6).alias("all_mean"), F.min("t").alias("first_t"),
    )
    first = F.struct("t", "call_id")
    votes = rows.groupBy(*by, "version").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"), F.min_by("passed", first).alias("passed"))
    best = votes.groupBy(*by).agg(F.min_by(F.struct("version", "n", "passed"), F.struct((-c("n")).alias("n"), "first")).alias("best"))
    lift = F.try_divide(c("top_k") / F.when(c("top_n") > 0, c("top_n")), F.when(c("all_k") > 0, c("all_k") / c("known")))
    joined = sums.join(best, by)
    return joined.select(*by, "scored", "known", "top_n", "top_k", "top_mean", "all_k", "all_mean", F.round(lift, 6).alias("lift"), "first_t", c("best.version").alias("version"), c("best.n").alias("version_n"), c("best.passed").alias("passed"))


def classify_missing(posts: DataFrame, text: str = "message_text") -> DataFrame:
    """posts with their kind, taken from the text where it was not kept; the kinds that are there stay."""
    return posts.withColumn("post_kind", F.coalesce("post_kind", post_kind(F.col(text))))


def classified_counts(posts: DataFrame, text: str = "message_text") -> DataFrame:
    """One row: how many posts without a kind turn out as calls and as updates."""
    kind = post_kind(F.col(text))
    return posts.where("post_kind is null").agg(F.count_if(kind == "call").alias("calls"), F.count_if(kind == "update").alias("updates"))


def aligned_blocks(blocks: DataFrame, other: DataFrame, chain: str = "chain") -> DataFrame:
    """blocks with the other chain's last block that is not later, and its time; null where that is over ten minutes older.

    blocks and other: chain (what pairs them), block, t (seconds).
    """
    theirs = other.select(chain, F.col("block").alias("other_block"), F.col("t").alias("other_t"), F.col("t").alias("_t"))
    found = as_of(blocks, theirs, chain, "t", "_t", ["other_block", "other_t"], "other_block", span=86_400)
    near = F.col("t") - F.col("other_t") <= MOST_BEHIND
    return found.withColumns({"other_block": F.when(near, F.col("other_block")), "other_t": F.when(near, F.col("other_t"))})


def depth(quote_side: Column) -> Column:
    """Liquidity on both sides of a pool, from its quote side."""
    return 2 * quote_side


def period_start(time: Column, period: str) -> Column:
    """Midnight of the Monday of a time's week, or of the first day of its month."""
    return F.date_trunc({"week": "week", "month": "month"}[period], time).cast("timestamp_ntz")
