"""Periodic runs: every maximal stretch of words that repeats with a period, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
max(shortest, 2 q) words that no neighbour extends. Periods below FIRST are found by direct scans: one comparison of the
words with themselves at each lag. Longer ones fall into scales [W, 2W). A scale hashes grams of W/4 words and picks
those that are least in some window of W/8 grams. A pick depends on nothing but the words of its window, so inside a
run the picks repeat at the distance of its period: equal picks at a distance within the scale are the seeds, and each
seed is extended to both sides word by word. Hashes seed only; what is reported was compared.

Grams that lie inside a run of a period up to W/16, known from smaller scales, would pair with each other all along it.
They seed nothing. Instead the two grams across the run's ends do, and two runs of one period that touch seed the lags
at which they agree. This loses no run: let P have a period p of the scale, and let no pick of its first period be
usable. Then all these picks lie in one such run R, since neighbours overlap by more than two of its periods. If an end
of R lies inside P, so does its copy a period away, and the grams across both ends pair up. Else R covers the whole
first period, and its copy lies in a run of the same period that touches R. Grams that are no such part recur at least
W/16 words apart, so a pick has at most sixteen partners: seeds grow with the words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.llm.common import in_pieces

#: Least period of the scales; a power of two, 64 at least, so that grams have as many words as the shortest run.
FIRST = 64
#: Words that are searched together; a longer text is searched alone.
TOGETHER = 1 << 18
A, B, C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _doubled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of grams of 2n words from those of n words; grams that leave the array keep the end's separator."""
    far = np.zeros_like(h)
    far[:-n] = h[n:]
    z = (h * A) ^ ((far + C) * B)
    z ^= z >> np.uint64(32)
    z *= C
    return z ^ (z >> np.uint64(29))


def _over(f: np.ufunc, v: np.ndarray, width: int, fill: int) -> np.ndarray:
    """f over v[i : i + width], width a power of two; beyond the end stands fill."""
    n = 1
    while n < width:
        far = np.full_like(v, fill)
        far[:-n] = v[n:]
        v = f(v, far)
        n *= 2
    return v


def _stretches(x: np.ndarray, lag: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Where at least `need` words on end equal those `lag` further on."""
    same = np.zeros(max(0, len(x) - lag) + 2, np.int8)
    same[1:-1] = x[lag:] == x[: len(x) - lag]
    edges = np.flatnonzero(same[1:] != same[:-1])
    start, end = edges[::2], edges[1::2]
    long = end - start >= need
    return start[long], end[long]


def _extended(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around `at` whose words equal those `lag` further on; empty if those at `at` differ."""
    top, step, end = len(x) - lag, 64, at
    while end < top:
        to = min(end + step, top)
        other = np.flatnonzero(x[end:to] != x[end + lag : to + lag])
        if len(other):
            end += int(other[0])
            break
        end, step = to, min(2 * step, 1 << 16)
    start, step = at, 64
    while start > 0 and end > at:
        low = max(0, start - step)
        other = np.flatnonzero(x[low:start] != x[low + lag : start + lag])
        if len(other):
            start = low + int(other[-1]) + 1
            break
        start, step = low, min(2 * step, 1 << 16)
    return start, end


def _pairs(at: np.ndarray, value: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of equal values `low` to 2 low - 1 apart; `at` ascends."""
    order = np.argsort(value, kind="stable")
    at, value = at[order], value[order]
    places, lags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    k, off = np.arange(len(at)), 1
    while True:
        k = k[k + off < len(at)]
        k = k[(value[k] == value[k + off]) & (at[k + off] - at[k] < 2 * low)]
        if not len(k):
            return np.concatenate(places), np.concatenate(lags)
        far = at[k + off] - at[k]
        places.append(at[k][far >= low])
        lags.append(far[far >= low])
        off += 1


def _touching(x: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray, low: int) -> Iterator[tuple[int, int]]:
    """Seeds of two runs of one period that touch: the lags of the scale that bring the first onto the second."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    for k in np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1]) & (end[1:] > end[:-1])).tolist():
        (a, b), (f, g), q = start[k : k + 2].tolist(), end[k : k + 2].tolist(), int(period[k])
        for turn in range(q):
            if np.array_equal(x[a + turn : a + turn + q], x[b : b + q]):
                first = b - a - turn
                first += -((first - low) // q) * q
                for lag in range(first, min(2 * low - 1, f - a, g - b) + 1, q):
                    yield max(a, b - lag), lag
                break


def find_runs(words: list[np.ndarray], shortest: int = 12) -> list[np.ndarray]:
    """Of each word sequence (numbers from 0, equal for equal words): rows start, length, period, by start, then period."""
    lengths = np.array([len(w) for w in words], np.int64)
    doc = np.arange(len(words))
    x = np.full(int(lengths.sum()) + len(words), -1, np.int64)
    inside = np.ones(len(x), bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    if len(words):
        x[inside] = np.concatenate(words)
    x[~inside] = -1 - doc  # a separator equals nothing else
    base = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    found: list[np.ndarray] = []  # rows doc, start, end, period

    def keep(start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> None:
        d = np.searchsorted(base, start, "right") - 1
        found.append(np.stack([doc[d], start - base[d], end + lag - base[d], lag], axis=1))

    for lag in range(1, min(FIRST, int(lengths.max(initial=0)) // 2 + 1)):
        start, end = _stretches(x, lag, max(shortest - lag, lag))
        if len(start):
            keep(start, end, np.full(len(start), lag))
    h, gram, low = x.astype(np.uint64), 1, FIRST
    while (stay := lengths >= 2 * low).any():
        if not stay.all():
            in_use = np.repeat(stay, lengths + 1)
            x, h, lengths, doc = x[in_use], h[in_use], lengths[stay], doc[stay]
            base = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        while gram < low // 4:
            h = _doubled(h, gram)
            gram *= 2
        width = gram // 2
        least = _over(np.minimum, h, width, np.iinfo(np.uint64).max)
        most = _over(np.maximum, least[::-1], width, 0)[::-1]
        pick = h == most
        known = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        known = known[(known[:, 3] <= gram // 4) & (known[:, 2] - known[:, 1] >= gram)]
        place = np.minimum(np.searchsorted(doc, known[:, 0]), len(doc) - 1)
        here = doc[place] == known[:, 0]
        known, place = known[here], place[here]
        start, end = base[place] + known[:, 1], base[place] + known[:, 2]
        depth = np.zeros(len(x) + 1, np.int32)
        np.add.at(depth, start, 1)
        np.add.at(depth, end - gram + 1, -1)
        pick &= np.cumsum(depth[:-1]) == 0
        pick[start[known[:, 1] > 0] - 1] = True
        pick[(end - gram + 1)[known[:, 2] < lengths[place]]] = True
        at = np.flatnonzero(pick)
        seeds, lags = _pairs(at, h[at], low)
        long = end - start >= low
        more = np.array(list(_touching(x, start[long], end[long], known[long, 3], low)), np.int64).reshape(-1, 2)
        seeds, lags = np.concatenate((seeds, more[:, 0])), np.concatenate((lags, more[:, 1]))
        order = np.lexsort((seeds, lags))
        before, until, new = 0, -1, []
        for seed, lag in zip(seeds[order].tolist(), lags[order].tolist(), strict=True):
            if lag != before or seed >= until:
                first, until = _extended(x, seed, lag)
                before = lag
                if until - first >= max(shortest - lag, lag):
                    new.append((first, until, lag))
        if new:
            keep(*np.array(new, np.int64).T)
        low *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    # a multiple of a run's period spans the same words: the smallest stays
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    runs = runs[first]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    cuts = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
    rows = np.stack([runs[:, 1], runs[:, 2] - runs[:, 1], runs[:, 3]], axis=1)
    return [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside the repetitions: each run keeps its first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, shortest: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (start, length, period; by start, then period) and collapsed_text of every row.

    Words are maximal runs of characters other than space and \\t \\n \\v \\f \\r. A null or empty text has no word, no run
    and an empty collapsed text; rows are judged each, so missing and repeated keys and repeated rows stay as they are; an
    empty table gives an empty result; other columns are ignored. Nothing is shuffled. A very long text is searched
    alone: its task holds the words and some twenty times 8 bytes for each of them.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple[object, list[bytes], np.ndarray]] = []
            number: dict[bytes, int] = {}
            size = 0
            schema = pa.schema([(key, b.schema.types[0]), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed_text", pa.string())])

            def rows(held: list[tuple[object, list[bytes], np.ndarray]]) -> Iterator[tuple]:
                for (k, words, _), runs in zip(held, find_runs([ids for _, _, ids in held], shortest), strict=True):
                    yield k, len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()], collapsed(words, runs).decode()

            for k, t in zip(b.column(0), b.column(1), strict=True):
                words = (t.as_py() or "").encode().split()
                if held and size + len(words) > TOGETHER:
                    yield from in_pieces(rows(held), schema, weigh=3)
                    held, number, size = [], {}, 0
                held.append((k.as_py(), words, np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))))
                size += len(words)
            yield from in_pieces(rows(held), schema, weigh=3)

    kind = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", kind), T.StructField("collapsed_text", T.StringType())]
    return docs.select(key, text).mapInArrow(work, T.StructType(fields))


def run_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and digests of all runs and the collapsed text."""
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (best, r) -> if(best is null or r.length > best.length, r, best))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    named = found.withColumns({"best": best, "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")})
    return named.select(
        key, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
