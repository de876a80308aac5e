"""Bootstrap intervals at scale: draws are arrays beside a value, never rows times draws.

A row's weights in all draws come from a hash of its key, Poisson(1) each, so that two scores of one row are drawn alike
and nothing has to be gathered to draw. Rows sorted by score pass through their task once; a task keeps three numbers for
each draw and hands them on, and as the tasks' ranges are in order, what they hand on adds up to the AUC of each draw.
Intervals over whole weeks need only the weeks' sums: drawn weeks are joined with those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Draws, and the ends of an interval.
REPS, LOW, HIGH = 2000, 0.025, 0.975
#: Rows weighed at once, and keys hashed at once.
CHUNK, NEAR = 256, 8
#: Poisson(1): where a number from 0 to 2^64 counts as 1, 2, ... 8 or more.
CUTS = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253])

#: The weight by a number's first 16 bits; -1 where a cut lies among those that begin so.
_ends = (np.arange(1 << 16)[:, None] + [0, 1]) / 2.0**16
BY_HEAD = np.where(((_ends[:, :1] <= CUTS) & (CUTS <= _ends[:, 1:])).any(axis=1), -1, (_ends[:, :1] > CUTS).sum(axis=1)).astype(np.int8)


def weights(keys: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weights, a row for each key hash and a column for each draw; draw -1 weighs every row once.

    A few keys at a time, so that what a step writes is still in the cache at the next.
    """
    step, mix, stir = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
    out = np.empty((len(keys), len(draws)), np.int8)
    with np.errstate(over="ignore"):
        shift = (draws.astype(np.int64).view(np.uint64) * np.uint64(2654435761) + np.uint64(seed))[None] * step
        for at in range(0, len(keys), NEAR):
            z = keys[at : at + NEAR].astype(np.int64).view(np.uint64)[:, None] + shift
            z = (z ^ (z >> np.uint64(30))) * mix
            z = (z ^ (z >> np.uint64(27))) * stir
            z ^= z >> np.uint64(31)
            found = BY_HEAD[z >> np.uint64(48)]
            open_ = found < 0
            if open_.any():
                found[open_] = (z[open_][:, None] / 2.0**64 > CUTS).sum(axis=1, dtype=np.int8)
            out[at : at + NEAR] = found
    out[:, draws < 0] = 1
    return out


PARTS = "part int, stratum string, wins array<double>, pos array<double>, neg array<double>"


class Sweep:
    """Weighted wins of positives over the negatives that came before, ties one half, for every draw."""

    def __init__(self, n: int) -> None:
        self.wins, self.pos, self.neg = np.zeros(n), np.zeros(n), np.zeros(n)
        self.x, self.tie_pos, self.tie_neg = None, np.zeros(n), np.zeros(n)

    def close(self) -> None:
        self.wins += self.tie_pos * (self.neg + self.tie_neg / 2)
        self.pos += self.tie_pos
        self.neg += self.tie_neg
        self.tie_pos, self.tie_neg = np.zeros_like(self.pos), np.zeros_like(self.neg)

    def add(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        both, pos = (np.add.reduceat(v, cuts, axis=0, dtype=np.int32) for v in (w, w * y.astype(np.int8)[:, None]))
        neg = both - pos
        for k, at in enumerate(cuts):
            if self.x is None or x[at] != self.x:
                self.close()
                self.x = x[at]
            self.tie_pos += pos[k]
            self.tie_neg += neg[k]


def _swept(draws: np.ndarray, seed: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sweep, now = TaskContext.get().partitionId(), None, None

        def row() -> pa.RecordBatch:
            sweep.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([now], pa.string()), *(pa.array([c], pa.list_(pa.float64())) for c in (sweep.wins, sweep.pos, sweep.neg))], ["part", "stratum", "wins", "pos", "neg"])

        for b in batches:
            stratum, key, y, x = b.column(0).to_pylist(), *(b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            at = 0
            while at < len(b):
                end = at + 1
                while end < min(len(b), at + CHUNK) and stratum[end] == stratum[at]:
                    end += 1
                if sweep is None or stratum[at] != now:
                    if sweep is not None:
                        yield row()
                    sweep, now = Sweep(len(draws)), stratum[at]
                sweep.add(x[at:end], y[at:end].astype(np.int64), weights(key[at:end], draws, seed))
                at = end
        if sweep is not None:
            yield row()

    return work


def auc_draws(rows: DataFrame, y: str, score: str, key: str, draws: list[int], seed: int = 7, stratum: str | None = None) -> DataFrame:
    """One row: `auc`, an array with the AUC of each draw (-1: all rows once); null where a draw has no pair.

    Rows without a score or outcome don't count. With strata only pairs of one stratum do; a row without one has no pair.
    """
    ready = rows.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    within = F.col(stratum).cast("string") if stratum else F.lit("")
    ready = ready.select(within.alias("stratum"), F.xxhash64(key).alias("key"), F.col(y).cast("int").alias("y"), F.col(score).cast("double").alias("x")).where("stratum is not null")
    dealt = ready.repartitionByRange("stratum", "x").sortWithinPartitions("stratum", "x")
    parts = dealt.mapInArrow(_swept(np.array(draws), seed), PARTS)

    def joined(found: pd.DataFrame) -> pd.DataFrame:
        wins, pairs = np.zeros(len(draws)), np.zeros(len(draws))
        for _, one in found.groupby("stratum"):  # a row for each task and stratum
            pos, neg = np.zeros(len(draws)), np.zeros(len(draws))
            for r in one.sort_values("part").itertuples():
                wins += r.wins + r.pos * neg
                pos += r.pos
                neg += r.neg
            pairs += pos * neg
        with np.errstate(invalid="ignore", divide="ignore"):
            auc = np.where(pairs > 0, wins / pairs, np.nan)
        return pd.DataFrame({"auc": [[None if np.isnan(a) else a for a in auc]]})

    return parts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(joined, "auc array<double>")  # a row for each task and stratum


def interval(values: Column, low: float = LOW, high: float = HIGH) -> Column:
    """Ends of the percentile interval of an array's defined values, by linear interpolation; null where there is none."""
    known = F.array_sort(F.filter(values, lambda v: v.isNotNull()))

    def at(q: float) -> Column:
        place = (F.size(known) - 1) * F.lit(q)
        below = F.get(known, F.floor(place).cast("int"))
        above = F.get(known, F.ceil(place).cast("int"))
        return F.when(F.size(known) > 0, below + (above - below) * (place - F.floor(place)))

    return F.struct(at(low).alias("low"), at(high).alias("high"))


def paired_gain(rows: DataFrame, y: str, base: list[str], more: list[str], key: str, reps: int = REPS, seed: int = 7, stratum: str | None = None) -> DataFrame:
    """AUC of two scores and the gain of the second, with its interval over draws in which both weigh every row alike.

    base and more name the scores of each repeat of the cross-validation. The values are those of a row's mean score over
    the repeats. Each draw takes one repeat's scores, chosen by its number, so that the interval holds the noise of the
    folds too; the gain's least, mean and largest value over the repeats show that noise alone.
    """
    mean = lambda names: F.try_divide(sum((F.col(c) for c in names[1:]), F.col(names[0])), F.lit(len(names)))
    rows = rows.withColumns({"_base": mean(base), "_more": mean(more)})
    pick = np.random.default_rng(seed).integers(0, len(base), reps)
    runs = [("_base", "_more", [])] + [(b, m, np.flatnonzero(pick == k).tolist()) for k, (b, m) in enumerate(zip(base, more, strict=True))]
    found = None
    for k, (b, m, draws) in enumerate(runs):  # a sweep for each repeat
        one, two = (auc_draws(rows, y, s, key, [-1, *draws], seed, stratum).select(F.col("auc").alias(n)) for s, n in ((b, "a"), (m, "b")))
        pair = one.crossJoin(F.broadcast(two)).select(F.lit(k).alias("run"), F.col("a")[0].alias("base"), F.col("b")[0].alias("more"), F.slice(F.zip_with("a", "b", lambda p, q: q - p), 2, max(1, len(draws))).alias("gains"))  # one row each
        found = pair if found is None else found.unionByName(pair)
    whole, each = F.col("run") == 0, F.col("run") > 0
    gain = F.when(each, F.col("more") - F.col("base"))
    out = found.agg(
        F.max(F.when(whole, F.col("base"))).alias("auc_base"), F.max(F.when(whole, F.col("more"))).alias("auc_more"),
        F.flatten(F.collect_list(F.when(each, F.col("gains")))).alias("gains"), F.min(gain).alias("repeat_least"), F.avg(gain).alias("repeat_mean"), F.max(gain).alias("repeat_most"),
    ).withColumn("ends", interval(F.col("gains")))
    return out.select(
        "auc_base", "auc_more", (F.col("auc_more") - F.col("auc_base")).alias("gain"), F.col("ends.low").alias("low"), F.col("ends.high").alias("high"),
        "repeat_least", "repeat_mean", "repeat_most", F.size(F.filter("gains", lambda v: v.isNotNull())).alias("reps"),
    )


def weighted_sums(rows: DataFrame, names: list[str], key: str, reps: int = REPS, seed: int = 7) -> DataFrame:
    """rep and the sums of each column under the rows' weights in that draw: draw -1 weighs every row once; nulls add nothing.

    A task adds up all draws of its rows and hands on one row for each draw.
    """
    draws = np.arange(-1, reps)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(draws), len(names)))
        for b in batches:
            v = np.nan_to_num(np.stack([b.column(k + 1).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(len(names))], axis=1)) if len(b) else np.zeros((0, len(names)))
            for at in range(0, len(b), CHUNK):
                total += weights(b.column(0).to_numpy()[at : at + CHUNK], draws, seed).T @ v[at : at + CHUNK]
        yield pa.RecordBatch.from_arrays([pa.array(draws), *(pa.array(total[:, k]) for k in range(len(names)))], ["rep", *names])

    ready = rows.select(F.xxhash64(key).alias("_k"), *[F.col(n).cast("double").alias(n) for n in names])
    parts = ready.mapInArrow(work, "rep long, " + ", ".join(f"`{n}` double" for n in names))
    return parts.groupBy("rep").agg(*[F.sum(n).alias(n) for n in names])


def drawn_blocks(blocks: DataFrame, by: list[str], block: str, names: list[str], reps: int = REPS, seed: int = 7) -> DataFrame:
    """by, rep and the sums over as many blocks as a group has, drawn with replacement; rep -1 has each block once.

    blocks: one row for each group and block (weeks, say), with the block's sums. A draw's k-th block is the one whose
    place is the first 32 bits of md5('seed:rep:k'), modulo the number of blocks.
    """
    w = Window.partitionBy(*by)  # over blocks: a row a week
    placed = blocks.select(*by, block, *names, (F.row_number().over(w.orderBy(block)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_m"))
    groups = placed.select(*by, "_m").distinct()
    draws = groups.select(*by, "_m", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).select(*by, "_m", "rep", F.explode(F.sequence(F.lit(1), "_m")).alias("k"))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rep", "k").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("_m")
    picked = draws.select(*by, "rep", place.cast("int").alias("_i"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"d.{c}"))
    met = picked.alias("d").join(F.broadcast(placed).alias("p") if not by else placed.alias("p"), same & (F.col("p._i") == F.col("d._i")))
    sums = met.groupBy(*[F.col(f"d.{c}").alias(c) for c in by], "d.rep").agg(*[F.sum(F.col(f"p.{n}").cast("double")).alias(n) for n in names])
    whole = blocks.groupBy(*by).agg(*[F.sum(F.col(n).cast("double")).alias(n) for n in names]).withColumn("rep", F.lit(-1))
    return sums.unionByName(whole.select(*by, "rep", *names))


def drawn_stats(drawn: DataFrame, by: list[str], stats: dict[str, Column]) -> DataFrame:
    """by, each statistic of all rows (rep -1), and `<name>_lo` and `<name>_hi`: its interval over the draws where it is defined."""
    each = drawn.select(*by, "rep", *[v.alias(k) for k, v in stats.items()])
    point = lambda k: F.max(F.when(F.col("rep") < 0, F.col(k)))
    end = lambda k, q: F.percentile(F.when(F.col("rep") >= 0, F.col(k)), q)
    return each.groupBy(*by).agg(*[c for k in stats for c in (point(k).alias(k), end(k, LOW).alias(f"{k}_lo"), end(k, HIGH).alias(f"{k}_hi"))])
