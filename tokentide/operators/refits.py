"""Logistic baselines of many weeks or folds fitted at once: each pass over the rows brings every fit one Newton step on.

A fit of its own for each week reads the rows some fifty times for each of hundreds of weeks, and folds do so for each set of
inputs. Here a row is the vector u of
its inputs (in units of all rows, missing ones zero), their missing marks and a one. A week's imputed and standardised
inputs are a linear map of u, so its gradient and Hessian follow from sums of u and u u^T over its training rows. A task
multiplies its rows with the coefficients of all weeks; only sums by week, of a size that the inputs give, leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of the grid that medians are read from (the error of a rank is one cell), rows multiplied at once, Newton passes at most.
EDGES, ROWS, PASSES = 1024, 2048, 60


def _matrix(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1)


def _medians(rows: DataFrame, columns: list[str], weeks: np.ndarray) -> np.ndarray:
    """Median of each input over each week's training rows (weeks by columns); NaN where all are missing."""
    grid = rows.agg(*[F.percentile_approx(c, F.array(*[F.lit((k + 0.5) / EDGES) for k in range(EDGES)]), 20 * EDGES).alias(c) for c in columns], *[F.max(c).alias(f"{c}_top") for c in columns]).first()
    edges = [np.unique([*grid[c], grid[f"{c}_top"]]) if grid[c] is not None else np.zeros(0) for c in columns]
    span = len(weeks) + 1

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, from_to = _matrix(b, columns), _matrix(b, ["train_from", "train_to"])
            first, behind = np.searchsorted(weeks, from_to[:, 0]), np.searchsorted(weeks, from_to[:, 1], "right")
            for c, e in enumerate(edges):
                there = ~np.isnan(x[:, c])
                at = np.searchsorted(e, x[there, c]) * span
                for step, n in ((first, 1), (behind, -1)):
                    cell, count = np.unique(at + step[there], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), c)), pa.array(cell), pa.array(n * count)], ["c", "cell", "n"])

    def middle(t: pa.Table) -> pa.Table:
        c = t["c"][0].as_py()
        counts = np.zeros((len(edges[c]), span), np.int64)
        np.add.at(counts.reshape(-1), t["cell"].to_numpy(), t["n"].to_numpy())
        upto = counts.cumsum(axis=1)[:, :-1].cumsum(axis=0)
        found = np.where(upto[-1] > 0, edges[c][(2 * upto < upto[-1]).sum(axis=0).clip(max=len(edges[c]) - 1)], np.nan)
        return pa.table({"c": np.full(len(weeks), c), "k": np.arange(len(weeks)), "median": found})

    sums = rows.select(*columns, "train_from", "train_to").mapInArrow(cells, "c long, cell long, n long").groupBy("c", "cell").agg(F.sum("n").alias("n")).where("n <> 0")
    out = np.full((len(weeks), len(columns)), np.nan)
    for r in sums.groupBy("c").applyInArrow(middle, "c long, k long, median double").collect():  # a number a week and input
        out[r["k"], r["c"]] = r["median"]
    return out


def _vectors(b: pa.RecordBatch, columns: list[str], centre: np.ndarray, unit: np.ndarray) -> np.ndarray:
    x = (_matrix(b, columns) - centre) / unit
    missing = np.isnan(x)
    return np.concatenate([np.where(missing, 0.0, x), missing, np.ones((len(x), 1))], axis=1)


def _probability(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def _sums(rows: DataFrame, columns: list[str], fits: int, inside_of: Callable, to_u: Callable, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each fit: loss, gradient and Hessian over u at coefficients `a`; without these the sums of 1, y u and u u^T."""
    size = 2 * len(columns) + 1
    i, j = np.triu_indices(size)
    names = [f"s{k}" for k in range(1 + size + len(i))]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((fits, len(names)))
        for big in batches:
            for at in range(0, len(big), ROWS):
                b = big.slice(at, ROWS)
                u, y, inside = to_u(b), _matrix(b, ["_y"]), inside_of(b)
                if a is None:
                    loss, first, second = inside, inside * y, inside
                else:
                    z = u @ a.T
                    p = _probability(z)
                    loss, first, second = inside * (np.logaddexp(0, z) - y * z), inside * (p - y), inside * (p * (1 - p))
                total += np.concatenate([loss.sum(axis=0)[:, None], first.T @ u, second.T.astype(float) @ (u[:, i] * u[:, j])], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(fits)), *map(pa.array, total.T)], ["k", *names])

    found = rows.mapInArrow(work, "k long, " + ", ".join(f"{n} double" for n in names)).groupBy("k").agg(*[F.sum(n).alias(n) for n in names])
    table = np.zeros((fits, len(names)))
    for r in found.collect():  # a row a fit
        table[r["k"]] = r[1:]
    square = np.zeros((fits, size, size))
    square[:, i, j] = square[:, j, i] = table[:, 1 + size :]
    return table[:, 0], table[:, 1 : 1 + size], square


def fitted_weeks(rows: DataFrame, columns: list[str], weeks: list[int], ridge: float) -> tuple[Callable, np.ndarray]:
    """The map of a batch to u, and each week's coefficients over u.

    rows: the inputs as doubles, _y, train_from, train_to; written, since each pass reads it. A week whose outcomes are all
    alike predicts that outcome.
    """
    order = np.array(weeks, float)

    def inside(b: pa.RecordBatch) -> np.ndarray:
        ends = _matrix(b, ["train_from", "train_to"])
        return (ends[:, :1] <= order) & (order <= ends[:, 1:])

    train = rows.where("train_from is not null")
    return _fitted(train, columns, inside, _medians(train, columns, order), np.ones((len(order), len(columns)), bool), ridge)


def fitted_folds(rows: DataFrame, columns: list[str], sets: list[list[str]], k: int, ridge: float) -> tuple[Callable, np.ndarray]:
    """The map of a batch to u, and coefficients over u: for each set of inputs one fit for each fold, on the rows of the other folds.

    rows: the inputs as doubles, _y, _fold from 0 to k - 1; written, since each pass reads it. A row without _y is in no fit.
    A fit whose outcomes are all alike predicts that outcome, one without rows NaN.
    """
    train = rows.where("_y is not null").select(*columns, "_y", "_fold")
    left_out = np.tile(np.arange(k), len(sets))
    middle = [F.percentile_approx(F.when(F.col("_fold") != i, F.col(c)), 0.5).alias(f"m{i}_{j}") for i in range(k) for j, c in enumerate(columns)]
    found = train.agg(*middle).first()
    medians = np.array([[np.nan if found[f"m{i}_{j}"] is None else found[f"m{i}_{j}"] for j in range(len(columns))] for i in left_out])
    used = np.repeat([[c in s for c in columns] for s in sets], k, axis=0)
    return _fitted(train, columns, lambda b: _matrix(b, ["_fold"]) != left_out, medians, used, ridge)


def _fitted(train: DataFrame, columns: list[str], inside: Callable, raw_medians: np.ndarray, used: np.ndarray, ridge: float) -> tuple[Callable, np.ndarray]:
    """The map of a batch to u, and each fit's coefficients over u. inside: of a batch, which rows (down) are in which fits (across).

    Medians for what is missing, standardised columns, mean loss plus ridge / 2 times the squared coefficients: what
    `models.fit_baseline` minimises. An input that a fit doesn't use counts as a constant there.
    """
    fits = len(used)
    known = train.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"d{k}") for k, c in enumerate(columns)]).first()
    centre = np.array([known[f"m{k}"] or 0.0 for k in range(len(columns))])
    unit = np.array([known[f"d{k}"] or 1.0 for k in range(len(columns))])
    unit = np.where(np.isfinite(unit) & (unit > 0), unit, 1.0)
    n_in = len(columns)
    to_u = lambda b: _vectors(b, columns, centre, unit)
    medians = np.nan_to_num((raw_medians - centre) / unit)
    n, y_u, moments = _sums(train, columns, fits, inside, to_u, None)
    full = np.zeros((fits, n_in + 1, 2 * n_in + 1))  # u to imputed inputs and the one
    for c in range(n_in):
        full[:, c, c], full[:, c, n_in + c] = 1.0, medians[:, c]
    full[:, n_in, 2 * n_in] = 1.0
    many = np.maximum(n, 2)
    m = full @ moments @ full.transpose(0, 2, 1)
    mean = m[:, :n_in, n_in] / many[:, None]
    spread = np.sqrt(np.maximum(m[:, range(n_in), range(n_in)] - many[:, None] * mean**2, 0) / (many[:, None] - 1))
    scale = np.where(used & (spread > 1e-9), 1 / np.maximum(spread, 1e-9), 0.0)
    to_f = full.copy()
    to_f[:, :n_in] = scale[:, :, None] * full[:, :n_in]
    to_f[:, :n_in, 2 * n_in] -= scale * mean
    held = np.full(n_in + 1, ridge)
    held[n_in] = 0.0
    positive = y_u[:, -1]
    alike = (positive <= 0) | (positive >= n)
    over_u = lambda b: np.einsum("wf,wfu->wu", b, to_f)
    b, step, best = np.zeros((fits, n_in + 1)), np.zeros((fits, n_in + 1)), np.full(fits, np.inf)
    for _ in range(PASSES):
        loss, gradient, hessian = _sums(train, columns, fits, inside, to_u, over_u(b + step))
        trial = b + step
        loss = loss / many + (held * trial**2).sum(axis=1) / 2
        better = loss <= best + 1e-12
        b, best = np.where(better[:, None], trial, b), np.where(better, loss, best)
        g = np.einsum("wfu,wu->wf", to_f, gradient) / many[:, None] + held * trial
        h = to_f @ hessian @ to_f.transpose(0, 2, 1) / many[:, None, None] + np.diag(held + 1e-12)
        step = np.where(better[:, None], -np.linalg.solve(h, g[:, :, None])[:, :, 0], step / 2)
        if np.abs(step[~alike]).max(initial=0.0) < 1e-8:
            break
    a = over_u(b)
    a[alike] = 0.0
    a[alike, -1] = np.where(positive[alike] > 0, np.inf, -np.inf)
    a[n == 0] = np.nan
    return to_u, a


def fold_scores(rows: DataFrame, columns: list[str], keep: list[str], names: list[str], k: int, to_u: Callable, a: np.ndarray) -> DataFrame:
    """keep and, under each set's name, the probability by the set's fit that left the row's fold out; null without a fit."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, fold = to_u(b), b.column("_fold").to_numpy()
            # row by row, so that equal rows of a fold have equal scores wherever they lie
            found = [_probability((u * a[k * j + fold]).sum(axis=1)) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(p, mask=np.isnan(p)) for p in found)], [*keep, *names])

    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.select(*dict.fromkeys([*keep, *columns, "_fold"])).mapInArrow(work, ", ".join([*kept, *[f"`{n}` double" for n in names]]))


def week_scores(rows: DataFrame, columns: list[str], key: str, weeks: list[int], to_u: Callable, a: np.ndarray) -> DataFrame:
    """key, margin, prob and week of the rows that the weeks test."""
    order = np.array(weeks)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            week = b.column("test_week").to_numpy()
            z = (to_u(b)[:, :-1] * a[np.searchsorted(order, week), :-1]).sum(axis=1) + a[np.searchsorted(order, week), -1]
            p = _probability(z)
            margin = np.log(np.maximum(p, 1e-12) / np.maximum(1 - p, 1e-12))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(margin), pa.array(p), pa.array(week.astype(np.int32))], [key, "margin", "prob", "week"])

    kind = rows.schema[key].dataType.simpleString()
    tested = rows.where(F.col("test_week").isin(weeks)).select(key, *columns, F.col("test_week").cast("long").alias("test_week"))
    return tested.mapInArrow(work, f"`{key}` {kind}, margin double, prob double, week int")
