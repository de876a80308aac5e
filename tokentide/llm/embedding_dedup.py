"""Embedding near-dedup with an inverted multi-index.

Two codebooks, fitted on the two halves of a bounded sample of unit vectors, span a grid of product cells, and every
distinct vector is indexed in the cell of its two nearest centroids. A partner y of x whose half lies with centroid c,
while x's nearest is s, is at least (|x-c|^2 - |x-s|^2) / (2 |c-s|) away in that half. The multi-sequence walk goes
through the cells in the order of the summed squares of these bounds, until the radius at which `recall` of the links
are reached. The radius is calibrated, not guessed: links of a sample of queries against all vectors, and random partners
of sample vectors at the very threshold. At recall 1 it is the threshold's own distance, and the bound proves that no link
is missed. What a walk visits is verified by the cosine in double precision.

Equal vectors are one class with a weight. A dense spot, such as thousands of near copies of one vector, would be
compared in the square of its size. So centres of spots that stand out in the sample become cores: all vectors within half
the link angle of a centre are linked with each other, which needs no comparison, and only what lies within one and a half
angles beside them is held against them. A cell with more owners than a block holds is dealt over blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.llm.common import materialise
from tokentide.llm.components import components
from tokentide.llm.simhash import Forest

#: Vectors that the codebooks and the dense spots are fitted on, at most so many components in all.
SAMPLE, SAMPLE_PARTS = 8192, 1 << 22
#: Vectors of a cell, on average, that the codebooks aim at; centroids of a codebook, at most.
IN_CELL, MOST_CENTROIDS = 50, 256
#: Queries whose links calibrate the walk, and random partners of each sample vector used for it.
QUERIES, PARTNERS = 512, 8
#: Owners of a block; visitors that are compared at once.
BLOCK, CHUNK = 4096, 1024
#: Neighbours in the sample that make a dense spot.
DENSE = 32
BINS = 2000


def vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and v: the components as bytes, null where the vector links with nothing: null, zero, with null or non-finite parts."""
    wide = "double" if dict(table.dtypes)[vector] != "array<float>" else "float"
    kind = np.dtype(np.float64 if wide == "double" else np.float32)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, out = b.column(1), []
            ends, parts = lists.offsets.to_numpy(), lists.values
            flat = parts.to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # a null is NaN; -0 becomes 0
            good = np.concatenate(([0], np.cumsum(~np.isfinite(flat)))), np.concatenate(([0], np.cumsum(flat != 0)))
            for k, there in enumerate(lists.is_valid().to_pylist()):
                lo, hi = ends[k], ends[k + 1]
                usable = there and good[0][hi] == good[0][lo] and good[1][hi] > good[1][lo]
                out.append(flat[lo:hi].tobytes() if usable else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [key, "v"])

    fields = [T.StructField(key, table.schema[key].dataType), T.StructField("v", T.BinaryType())]
    return table.select(key, F.col(vector).cast(f"array<{wide}>")).mapInArrow(work, T.StructType(fields))


def _units(raw: list[bytes], kind: np.dtype, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, filled up with zeros to `wide` components, and their own numbers of components."""
    parts = np.array([len(r) // kind.itemsize for r in raw], np.int64)
    if len(raw) and (parts == wide).all():
        x = np.frombuffer(b"".join(raw), kind).reshape(-1, wide).astype(np.float64)
    else:
        x = np.zeros((len(raw), wide))
        for k, r in enumerate(raw):
            x[k, : parts[k]] = np.frombuffer(r, kind)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-320)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), parts


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means from evenly spaced rows of the sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class MultiIndex:
    """Two codebooks, the radius of the walk, and the centres of dense spots with their numbers of components."""

    kind: np.dtype
    wide: int
    books: tuple[np.ndarray, np.ndarray]
    threshold: float
    radius: float
    centres: np.ndarray
    centre_parts: np.ndarray

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each half: least squared distance of a partner in each centroid's region, and the nearest centroid."""
        half, squares, near = (self.wide + 1) // 2, [], []
        for part, c in zip((x[:, :half], x[:, half:]), self.books, strict=True):
            d = (part * part).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * part @ c.T
            s = d.argmin(axis=1)
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))[s]
            over = np.maximum(0, d - d[np.arange(len(x)), s][:, None] - 1e-9)
            squares.append(np.where(apart > 0, over / (2 * np.maximum(apart, 1e-12)), 0) ** 2)
            near.append(s)
        return squares, near

    def cell(self, near: list[np.ndarray], parts: np.ndarray) -> np.ndarray:
        return (parts * len(self.books[0]) + near[0]) * len(self.books[1]) + near[1]

    def walk(self, x: np.ndarray, parts: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and the cells that they visit: those behind their own cell, nearest first, up to the radius."""
        (one, two), _ = self.bounds(x)
        second = np.argsort(two, axis=1)
        rows, cells = [], []
        for k in range(len(x)):
            reach = np.searchsorted(two[k, second[k]], self.radius - one[k], "right")
            first = np.repeat(np.arange(len(one[k])), reach)
            then = second[k, np.arange(len(first)) - np.repeat(np.cumsum(reach) - reach, reach)]
            at = (parts[k] * len(self.books[0]) + first) * len(self.books[1]) + then
            behind = at > cell[k]
            order = np.argsort((one[k, first] + two[k, then])[behind], kind="stable")
            cells.append(at[behind][order])
            rows.append(np.full(len(order), k))
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, int), np.zeros(0, int))

    def core(self, x: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The core that a vector belongs to (-1: none), and the angles to all centres (infinite where parts differ)."""
        if not len(self.centres):
            return np.full(len(x), -1), np.zeros((len(x), 0))
        angle = np.where(parts[:, None] == self.centre_parts, np.arccos(np.clip(x @ self.centres.T, -1, 1)), np.inf)
        inside = angle <= math.acos(self.threshold) / 2 - 1e-6
        return np.where(inside.any(axis=1), inside.argmax(axis=1), -1), angle


def _spots(x: np.ndarray, parts: np.ndarray, threshold: float) -> list[int]:
    """Sample vectors, each of a dense spot of its own, and their neighbours: the densest first."""
    neighbours = [np.flatnonzero((x[k : k + 512] @ x.T >= threshold) & (parts[k : k + 512, None] == parts)) for k in range(0, len(x), 512)]
    rows = np.concatenate([n // len(x) + 512 * k for k, n in enumerate(neighbours)])
    cols = np.concatenate([n % len(x) for n in neighbours])
    open_, found = np.ones(len(x), bool), []
    while True:
        use = open_[rows] & open_[cols]
        n = np.bincount(rows[use], minlength=len(x))
        if not len(n) or n.max() <= DENSE:
            return found
        best = int(n.argmax())
        mine = cols[(rows == best) & open_[cols]]
        found.append(mine)
        open_[mine] = False


def fit(classes: DataFrame, threshold: float, recall: float, kind: np.dtype, seed: int = 5) -> MultiIndex:
    """The index of classes(v), fitted on those of the smallest hashes (at most SAMPLE vectors, SAMPLE_PARTS components).

    What reaches the driver is that sample, three numbers, and counts of links in bins of needed radius.
    """
    about = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("v")).alias("wide")).first()
    n, wide = about["n"], (about["wide"] or 0) // kind.itemsize
    most = max(QUERIES, min(SAMPLE, SAMPLE_PARTS // max(1, wide)))
    raw = [bytes(r["v"]) for r in classes.select("v").orderBy(F.xxhash64("v"), "v").limit(most).collect()]
    x, parts = _units(raw, kind, wide)
    k = min(MOST_CENTROIDS, max(1, len(x)), max(4, round(math.sqrt(n / IN_CELL))))
    half = (wide + 1) // 2
    second = x[:, half:]
    books = _centroids(x[:, :half], k) if len(x) else np.zeros((1, half)), _centroids(second, k if second.shape[1] else 1) if len(x) else np.zeros((1, wide - half))
    spots = _spots(x, parts, threshold) if len(x) else []
    centres = np.stack([x[s].mean(axis=0) for s in spots]) if spots else np.zeros((0, wide))
    centres /= np.sqrt((centres * centres).sum(axis=1, keepdims=True)) if spots else 1
    far = 2 - 2 * threshold
    index = MultiIndex(kind, wide, books, threshold, far, centres, np.array([parts[s[0]] for s in spots], np.int64))
    if recall >= 1 or not len(x):
        return index
    free = np.flatnonzero(index.core(x, parts)[0] < 0)  # links with a core are found without the walk
    x, parts = x[free], parts[free]
    q, q_parts = x[:QUERIES], parts[:QUERIES]
    squares, _ = index.bounds(q)

    def reach(near: list[np.ndarray], of: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
        need = bounds[0][of, near[0]] + bounds[1][of, near[1]]
        return np.minimum(BINS - 1, np.ceil(np.sqrt(need / far) * (BINS - 1))).astype(np.int64)

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BINS, np.int64)
        for b in batches:
            y, y_parts = _units([v.as_py() for v in b.column(0)], kind, wide)
            at, of = np.nonzero(((cos := y @ q.T) >= threshold) & (cos < 1 - 1e-12) & (y_parts[:, None] == q_parts))
            _, near = index.bounds(y[np.unique(at)])
            place = np.searchsorted(np.unique(at), at)
            seen += np.bincount(reach([c[place] for c in near], of, squares), minlength=BINS)
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(seen[hit])], ["bin", "n"])

    counted = classes.select("v").mapInArrow(links, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    real = np.zeros(BINS, np.int64)
    for r in counted:
        real[r["bin"]] = r["n"]
    draw = np.random.default_rng(seed)
    of = np.repeat(np.arange(len(x))[: QUERIES * 4], PARTNERS)
    aside = draw.normal(size=(len(of), wide)) * (np.arange(wide) < parts[of][:, None])
    aside -= (aside * x[of]).sum(axis=1, keepdims=True) * x[of]
    aside /= np.maximum(1e-300, np.sqrt((aside * aside).sum(axis=1, keepdims=True)))
    bounds, _ = index.bounds(x[: QUERIES * 4])
    _, near = index.bounds(threshold * x[of] + math.sqrt(1 - threshold**2) * aside)
    drawn = np.bincount(reach(near, of, bounds), minlength=BINS)
    cut = max(int(np.searchsorted(np.cumsum(h), recall * h.sum())) for h in (real, drawn))
    index.radius = far * ((min(cut, BINS - 1)) / (BINS - 1)) ** 2 if cut < BINS - 1 else far
    return index


VISITS = "cell long, block long, visitor boolean, cls long, n long, v binary"


def _visits(index: MultiIndex, blocks: dict[int, int]) -> object:
    """Rows of VISITS: a vector in its own cell's block, in blocks behind it, and in all blocks of the cells it visits.

    Cores are cells of negative numbers; their owners aren't compared with each other.
    """
    angle = 1.5 * math.acos(index.threshold) + 1e-6

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                cls, n = (b.column(k).to_numpy() for k in (0, 1))
                raw = [v.as_py() for v in b.column(2)]
                x, parts = _units(raw, index.kind, index.wide)
                core, angles = index.core(x, parts)
                _, near = index.bounds(x)
                cell = np.where(core >= 0, -1 - core, index.cell(near, parts))
                free = np.flatnonzero(core < 0)
                rows, cells = index.walk(x[free], parts[free], cell[free])
                beside = (angles <= angle) & (np.where(core < 0, angles.shape[1], core)[:, None] > np.arange(angles.shape[1]))
                shell, of = np.nonzero(beside)
                rows, cells = np.concatenate((free[rows], shell)), np.concatenate((cells, -1 - of))
                many = np.array([blocks.get(c, 1) for c in cell.tolist()])
                own = cls % many
                later = np.where(cell >= 0, many - 1 - own, 0)
                back = np.repeat(np.arange(len(x)), later)
                back_block = own[back] + 1 + np.arange(len(back)) - np.repeat(np.cumsum(later) - later, later)
                seen = np.array([blocks.get(c, 1) for c in cells.tolist()], np.int64)
                out = np.repeat(np.arange(len(rows)), seen)
                out_block = np.arange(len(out)) - np.repeat(np.cumsum(seen) - seen, seen)
                who = np.concatenate((np.arange(len(x)), back, rows[out]))
                to = np.concatenate((cell, cell[back], cells[out])), np.concatenate((own, back_block, out_block))
                for k in range(0, len(who), 8192):
                    part = who[k : k + 8192]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[0][k : k + 8192]), pa.array(to[1][k : k + 8192]), pa.array(np.arange(k, k + len(part)) >= len(x)), pa.array(cls[part]), pa.array(n[part]), pa.array([raw[p] for p in part], pa.binary())],
                        ["cell", "block", "visitor", "cls", "n", "v"],
                    )

    return work


class Block:
    """The owners of a block, what they link with, and a forest that joins them."""

    def __init__(self, cell: int) -> None:
        self.cell, self.cls, self.n, self.x, self.parts = cell, *(np.zeros(0, np.int64),) * 2, None, np.zeros(0, np.int64)

    def own(self, cls: np.ndarray, n: np.ndarray, x: np.ndarray, parts: np.ndarray) -> None:
        self.cls, self.n, self.parts = (np.concatenate(p) for p in ((self.cls, cls), (self.n, n), (self.parts, parts)))
        self.x = x if self.x is None else np.concatenate((self.x, x))

    def settle(self, threshold: float) -> None:
        """Links of the owners with each other; a core's are known without looking."""
        self.links, self.forest = np.zeros(len(self.cls), np.int64), Forest(len(self.cls))
        for k in range(0, len(self.cls) if self.cell >= 0 else 0, CHUNK):
            near = (self.x[k : k + CHUNK] @ self.x.T >= threshold) & (self.parts[k : k + CHUNK, None] == self.parts)
            a, b = np.nonzero(near)
            a, b = a[a + k != b] + k, b[a + k != b]
            np.add.at(self.links, a, self.n[b])
            self.forest.join(a, b)

    def visited(self, cls: np.ndarray, n: np.ndarray, x: np.ndarray, parts: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Number of links of each visitor that has one, and an owner it is linked with."""
        for k in range(0, len(cls), CHUNK):
            v, o = np.nonzero((x[k : k + CHUNK] @ self.x.T >= threshold) & (parts[k : k + CHUNK, None] == self.parts))
            if len(v):
                np.add.at(self.links, o, n[v + k])
                who, first, of = np.unique(v, return_index=True, return_inverse=True)
                self.forest.join(o, o[first][of])
                yield cls[who + k], np.bincount(of, self.n[o]).astype(np.int64), self.cls[o[first]]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        peer = self.forest.label
        tell = (self.links > 0) | (peer != np.arange(len(peer)))
        return self.cls[tell], self.links[tell], self.cls[peer[tell]]


def _compare(index: MultiIndex) -> object:
    """cls, links found and a peer, from VISITS sorted by cell, block and visitor: at most one block is held at a time."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda found: pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["cls", "links", "peer"])
        at: tuple[int, int] | None = None
        block, settled = None, False
        for b in batches:
            cell, place, cls, n = (b.column(k).to_numpy() for k in (0, 1, 3, 4))
            visitor = b.column(2).to_numpy(zero_copy_only=False)
            x, parts = _units([v.as_py() for v in b.column(5)], index.kind, index.wide)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(place) != 0) | (np.diff(visitor.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                if lo == hi:
                    continue
                if (here := (int(cell[lo]), int(place[lo]))) != at:
                    if block is not None:
                        if not settled:
                            block.settle(index.threshold)
                        yield pack(block.result())
                    at, block, settled = here, Block(here[0]), False
                part = cls[lo:hi], n[lo:hi], x[lo:hi], parts[lo:hi]
                if not visitor[lo]:
                    block.own(*part)
                    continue
                if not settled:
                    block.settle(index.threshold)
                    settled = True
                if block.x is not None:  # a visited cell may have no owners
                    for found in block.visited(*part, index.threshold):
                        yield pack(found)
        if block is not None:
            if not settled:
                block.settle(index.threshold)
            yield pack(block.result())

    return work


def near_vectors(table: DataFrame, threshold: float = 0.95, recall: float = 0.999, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, n_links, component_id and kept of every row, linked at a cosine of `threshold` (above 0) or more.

    n_links counts the other rows that a row is linked with directly, equal vectors included. component_id is the smallest
    key reachable by links, the row's own included; kept says that it is the row's own key. Vectors that are null, empty,
    zero or have null or non-finite components link with nothing; vectors of different lengths don't link with each
    other. Rows without a key take the component of the others; a component without any key has a null id, and its rows
    stay. Rows that share a component's smallest key stay all. Other columns are ignored; an empty table gives an empty result.
    """
    kind = np.dtype(np.float32 if dict(table.dtypes)[vector] == "array<float>" else np.float64)
    rows = materialise(vectors(table, key, vector))
    grouped = rows.where("v is not null").groupBy("v").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = materialise(grouped.withColumn("cls", F.monotonically_increasing_id()))
    index = fit(classes, threshold, recall, kind)
    placed = materialise(classes.select("cls", "n", "v").mapInArrow(_places(index), "cls long, n long, v binary, cell long"))
    # a row for each cell with more owners than a block: fewer than one for each BLOCK vectors of the index
    large = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("owners")).where(F.col("owners") > BLOCK).collect()
    blocks = {r["cell"]: -(-r["owners"] // BLOCK) for r in large}
    visits = placed.select("cls", "n", "v").mapInArrow(_visits(index, blocks), VISITS)
    dealt = visits.repartition("cell", "block").sortWithinPartitions("cell", "block", "visitor")
    found = materialise(dealt.mapInArrow(_compare(index), "cls long, links long, peer long"))
    cores = placed.where("cell < 0").groupBy("cell").agg(F.min("cls").alias("peer"), F.sum("n").alias("all"))  # a row for each centre
    inside = placed.where("cell < 0").join(F.broadcast(cores), "cell").select("cls", (F.col("all") - F.col("n")).alias("links"), "peer")
    every = found.unionByName(materialise(inside))
    roots = components(every.where("cls <> peer").select(F.col("cls").alias("u"), F.col("peer").alias("v")))
    links = every.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = classes.drop("v").join(links, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
    member = materialise(joined.select("cls", "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root")))
    least = materialise(member.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = materialise(member.join(least, "root").select("cls", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"))
    of_v = materialise(classes.select("cls", "v").join(named, "cls").drop("cls"))
    out = rows.join(of_v, "v", "left").withColumn("own", F.when(F.col("v").isNull(), F.col(key)).otherwise(F.col("component_id")))
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("own").alias("component_id"), F.col(key).eqNullSafe(F.col("own")).alias("kept"))


def _places(index: MultiIndex) -> object:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, parts = _units([v.as_py() for v in b.column(2)], index.kind, index.wide)
            core, _ = index.core(x, parts)
            _, near = index.bounds(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(core >= 0, -1 - core, index.cell(near, parts)))], ["cls", "n", "v", "cell"])

    return work
