"""Suffix-array dedup with a logarithmic family of indexes: bytes that a 100-byte string repeats are removed.

Sparse suffixes stand for all. A 100-byte string is indexed by its anchor: the place of the least hash among its
20-byte pieces, the leftmost on ties. Equal strings have their anchor at the same distance, so strings that repeat meet
at equal anchors. A context is what all strings of one anchor cover together; it goes to the partition that owns its
anchor. There, arriving batches become sorted arrays of (anchor, context), each is merge-scanned against the sorted
levels so far, the places that aren't first are reported, and levels of equal size merge geometrically.

Equal contexts settle all their strings at once. Contexts that share an anchor but differ (at the edges of a copied
passage) may still have strings in common. A common string holds the anchor's piece and one of four cores: 0, 20, 40 or
60 bytes before the piece and what is missing to 60 behind it. Contexts that share a core with another are contested:
their strings are hashed one by one and go through a second index in the same way.

An anchor can be hot: a frequent phrase in thousands of otherwise different contexts. A reading task that meets more than
CROWD contexts of one anchor hands them on as contested at once, dealt out by document, and tells the anchor's owner, who
then holds all its contexts of that anchor to be contested too. So an owner gets CROWD contexts from a task at most, and
nothing is lost: contested strings are compared each.

A document is known by its key and a hash of its text, so rows that share a key but not the text stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.llm.common import LAST, materialise

SPAN, PIECE, CORE = 100, 20, 80
#: Strings of one document whose anchors are found at once; bytes of small documents taken together.
BLOCK = 1 << 20
#: Rows that a reading task holds before it hands them on without their copies; rows in a batch of the index.
HELD, BATCH = 1 << 18, 1 << 16
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
BYTE_HASH = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of contested stretches up to which they are broadcast (a document's row and a stretch count as below); beyond,
#: the texts are shuffled to them.
FEW, ROW_BYTES, STRETCH_BYTES = 64 << 20, 64, 16
#: Contexts of one anchor that a reading task hands to its owner; with more of them all are contested.
CROWD = 64
MARK, ENTRY, CONTESTED, HOT = 0, 1, 2, 3
SCHEMA = pa.schema([("kind", pa.int8()), ("k1", pa.int32()), ("k2", pa.int64()), ("d", pa.int64()), ("t", pa.int32()), ("p", pa.int32()), ("n", pa.int32()), ("c", pa.int64())])
SPARK_SCHEMA = "kind tinyint, k1 int, k2 long, d long, t int, p int, n int, c long"
Rows = tuple[np.ndarray, ...]  # k1, k2, d, t, p, n, c
Places = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # d, t, p, n


def piece_hashes(b: np.ndarray, widths: tuple[int, ...] = (PIECE, CORE)) -> list[np.ndarray]:
    """64-bit hashes of all strings of each width, by doubling."""
    h, width, power = BYTE_HASH[b], 1, np.array(ODD)
    kept = {1: (h, power)}
    while width * 2 <= min(max(widths), len(b)):
        h = h[:-width] * power + h[width:]
        width, power = width * 2, np.multiply(power, power, dtype=np.uint64)
        kept[width] = h, power
    found = []
    for goal in widths:
        whole, at = None, 0
        for w in sorted(kept, reverse=True):
            if goal - at >= w:
                h, power = kept[w]
                n = max(0, len(b) - at - w + 1)
                whole = h.copy() if whole is None else whole[:n] * power + h[at : at + n]
                at += w
        whole ^= whole >> np.uint64(29)
        whole *= MIX
        whole ^= whole >> np.uint64(32)
        found.append(whole)
    return found


def anchors(b: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of the anchor of the string that starts at each byte."""
    packed = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    width, span = 1, SPAN - PIECE + 1
    while width * 2 <= span:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    n = len(packed) - (span - width)
    return (np.minimum(packed[:n], packed[span - width : span - width + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def contexts(docs: list[tuple[int, int, int, bytes]]) -> Rows:
    """One entry for each anchor: its hash, its context's hash, document (key and text hash), first string, number of strings.

    docs: key, text hash, offset of the piece in its document, bytes.
    """
    joined = b"".join(x[3] for x in docs)
    b = np.frombuffer(joined, np.uint8)
    lengths = np.array([len(x[3]) for x in docs])
    begin = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - SPAN + 1, 0)
    total = int(counts.sum())
    if not total:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    owner = np.repeat(np.arange(len(docs)), counts)
    place = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
    hashes, cores = piece_hashes(b)
    anchor = anchors(b, hashes)[place]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    n = np.diff(np.append(first, total))
    start, view, digest = place[first], memoryview(joined), xxhash.xxh3_64_intdigest
    k2 = np.fromiter((digest(view[s:e]) for s, e in zip(start.tolist(), (start + n + SPAN - 1).tolist(), strict=True)), np.uint64, len(first)).view(np.int64)
    own = owner[first]
    order, text, offset = (np.array([x[i] for x in docs], np.int64) for i in range(3))
    end = start + n + SPAN - 1
    c = np.zeros(len(first), np.uint64)
    for i in range(4):  # 16 bits for each core that lies within the context, 0 for none
        at = anchor[first] - i * PIECE
        inside = (at >= start) & (at + CORE <= end)
        c |= np.where(inside, (cores[np.where(inside, at, 0)] >> np.uint64(48)) | np.uint64(1), np.uint64(0)) << np.uint64(16 * i)
    k1 = (hashes[anchor[first]] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return k1.astype(np.int64), k2, order[own], text[own], start - begin[own] + offset[own], n, c.view(np.int64)


def firsts(rows: Rows) -> tuple[Rows, Places]:
    """Rows in order of (k1, k2) with the first place of each, and the places after it."""
    order = np.lexsort((rows[4], rows[3], rows[2], rows[1], rows[0]))
    k1, k2, d, t, p, n, c = (x[order] for x in rows)
    new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) if len(k1) else np.zeros(0, bool)
    # a row that repeats a place is the same place, not a later one
    place = np.maximum.accumulate(np.where(new, np.arange(len(k1)), 0))
    later = ~new & ((d != d[place]) | (t != t[place]) | (p != p[place]))
    return tuple(x[new] for x in (k1, k2, d, t, p, n, c)), (d[later], t[later], p[later], n[later])


def runs(d: np.ndarray, t: np.ndarray, p: np.ndarray, n: np.ndarray) -> Places:
    """Neighbouring stretches of strings as one."""
    if not len(d):
        return d, t, p, n
    order = np.lexsort((p, t, d))
    d, t, p, n = d[order], t[order], p[order].astype(np.int64), n[order].astype(np.int64)
    apart = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))) << 40  # no stretch reaches from one document into the next
    end = np.maximum.accumulate(p + n + apart)
    new = np.concatenate(([True], (p + apart)[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return d[at], t[at], p[at], np.maximum.reduceat(p + n, at) - p[at]


def batch_of(kind: int, d: np.ndarray, t: np.ndarray, p: np.ndarray, n: np.ndarray, k1: np.ndarray | None = None, k2: np.ndarray | None = None, c: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches; what has no key of its own is dealt out by its document."""
    k1 = ((d.astype(np.uint64) * ODD + p.astype(np.uint64) * MIX) >> np.uint64(33)).view(np.int64) if k1 is None else k1
    k2 = np.zeros(len(d), np.int64) if k2 is None else k2
    c = np.zeros(len(d), np.int64) if c is None else c
    for at in range(0, len(d), BATCH):
        s = slice(at, at + BATCH)
        small = lambda x: pa.array(x[s].astype(np.int32))  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d[s]), kind, np.int8)), small(k1), pa.array(k2[s]), pa.array(d[s]), small(t), small(p), small(n), pa.array(c[s])], schema=SCHEMA)


def handed_on(parts: list[Rows], crowd: int | None) -> Iterator[pa.RecordBatch]:
    """First places as entries; later ones of this task are marked at once, so a frequent string moves once per task.

    Contexts of an anchor that has more than `crowd` of them here are contested at once, and its owner is told.
    """
    rows = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    kept, later = firsts(rows)
    yield from batch_of(MARK, *runs(*later))
    if crowd is not None:
        anchor, at, times = np.unique(kept[0], return_inverse=True, return_counts=True)
        hot = times > crowd
        if hot.any():
            many = hot[at]
            yield from batch_of(CONTESTED, *runs(*(x[many] for x in kept[2:6])))
            none = np.zeros(int(hot.sum()), np.int64)
            yield from batch_of(HOT, none, none, none, none, anchor[hot])
            kept = tuple(x[~many] for x in kept)
    k1, k2, d, t, p, n, c = kept
    yield from batch_of(ENTRY, d, t, p, n, k1, k2, c)


def held_back(found: Iterable[Rows], crowd: int | None = None) -> Iterator[pa.RecordBatch]:
    parts: list[Rows] = []
    for rows in found:
        parts.append(rows)
        if sum(len(x[0]) for x in parts) >= HELD:
            yield from handed_on(parts, crowd)
            parts = []
    if parts:
        yield from handed_on(parts, crowd)


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[Rows]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for b in batches:
            for d, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = x.as_py()
                for at in range(0, max(1, len(data) - SPAN + 1), BLOCK):
                    held.append((d, t, at, data[at : at + BLOCK + SPAN - 1]))
                    size += len(held[-1][3])
                    if size >= BLOCK:
                        yield contexts(held)
                        held, size = [], 0
        if held:
            yield contexts(held)

    yield from held_back(found(), CROWD)


def _strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An entry for each contested string, by 96 bits of hash."""

    def found() -> Iterator[Rows]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for d, t, x, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                view = memoryview(x.as_py())
                one = np.array([(s["p"], s["n"]) for s in spans], np.int64)
                for at in range(0, len(one), 4096):
                    s, n = one[at : at + 4096].T
                    p = np.repeat(s, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    keys = np.frombuffer(b"".join([digest(view[i : i + SPAN]) for i in p.tolist()]), "<i8").reshape(-1, 2)
                    yield keys[:, 0].astype(np.int32).astype(np.int64), keys[:, 1].copy(), np.full(len(p), d, np.int64), np.full(len(p), t, np.int64), p, np.ones(len(p), np.int64), np.zeros(len(p), np.int64)

    yield from held_back(found())


class LevelFamily:
    """Sorted levels of first places; a batch is merge-scanned against each, and levels of equal size merge."""

    def __init__(self) -> None:
        self.levels: list[Rows] = []
        self.hot: list[np.ndarray] = []

    def add(self, rows: Rows) -> Places:
        """Take a batch in; returns the places found not to be first."""
        batch, later = firsts(rows)
        late = [later]
        for i, level in enumerate(self.levels):
            code, own = self.code(level), self.code(batch)
            order = np.argsort(code, kind="stable")
            at = np.minimum(np.searchsorted(code, own, sorter=order), len(code) - 1)
            at = order[at]
            met = (level[0][at] == batch[0]) & (level[1][at] == batch[1])
            if not met.any():
                continue
            a = at[met]
            mine, theirs = tuple(x[met] for x in batch[2:6]), tuple(x[a] for x in level[2:6])
            same = (mine[0] == theirs[0]) & (mine[1] == theirs[1])
            earlier = (mine[0] < theirs[0]) | (mine[0] == theirs[0]) & (mine[1] < theirs[1]) | same & (mine[2] < theirs[2])
            same &= mine[2] == theirs[2]
            late.append(tuple(np.where(earlier, y, x)[~same] for x, y in zip(mine, theirs, strict=True)))  # type: ignore[arg-type]
            level = tuple(x.copy() for x in level)  # type: ignore[assignment]
            for k in (2, 3, 4, 5):
                level[k][a[earlier]] = batch[k][met][earlier]
            self.levels[i] = level
            batch = tuple(x[~met] for x in batch)  # type: ignore[assignment]
        if len(batch[0]):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self.levels[-2:] = [self.merged(self.levels[-2:])]
        return tuple(np.concatenate(x) for x in zip(*late, strict=True))  # type: ignore[return-value]

    @staticmethod
    def code(rows: Rows) -> np.ndarray:
        return rows[0].view(np.uint64) * ODD + rows[1].view(np.uint64)

    @staticmethod
    def merged(levels: list[Rows]) -> Rows:
        rows = tuple(np.concatenate(x) for x in zip(*levels, strict=True))
        order = np.lexsort((rows[1], rows[0]))
        return tuple(x[order] for x in rows)  # type: ignore[return-value]

    def contested(self) -> Places:
        """First places that share a core with another context of their anchor, or whose anchor is hot."""
        if not self.levels:
            return tuple(np.zeros(0, np.int64) for _ in range(4))  # type: ignore[return-value]
        k1, _, d, t, p, n, c = self.merged(self.levels)
        shared = np.isin(k1, np.concatenate(self.hot)) if self.hot else np.zeros(len(k1), bool)
        for i in range(4):
            core = (c.view(np.uint64) >> np.uint64(16 * i)) & np.uint64(0xFFFF)
            has = np.flatnonzero(core)
            key = (k1[has].astype(np.uint64) << np.uint64(16)) | core[has]
            _, at, times = np.unique(key, return_inverse=True, return_counts=True)
            shared[has] |= times[at] > 1
        return d[shared], t[shared], p[shared], n[shared]


def _index(batches: Iterable[pa.RecordBatch], contest: bool) -> Iterator[pa.RecordBatch]:
    """Marks of places that aren't first and, from contexts, contested places."""
    family = LevelFamily()
    held: list[Rows] = []

    def taken() -> Iterator[pa.RecordBatch]:
        rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        yield from batch_of(MARK, *runs(*family.add(rows)))  # type: ignore[arg-type]

    for b in batches:
        kind = b.column(0).to_numpy(zero_copy_only=False)
        columns = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 8)]
        for known in (MARK, CONTESTED):
            these = kind == known
            if these.any():
                yield from batch_of(known, *(x[these] for x in columns[2:6]))
        if (kind == HOT).any():
            family.hot.append(np.unique(columns[0][kind == HOT]))
        entry = kind == ENTRY
        if entry.any():
            held.append(tuple(x[entry] for x in columns))
        if sum(len(x[0]) for x in held) >= BATCH:
            yield from taken()
    if held:
        yield from taken()
    if contest:
        yield from batch_of(CONTESTED, *runs(*family.contested()))


def _removed(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        schema = pa.schema([(key, b.schema.field(0).type), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])
        for at in range(0, len(b), 256):
            part = b.slice(at, 256)
            sizes, spans, kept = [], [], []
            for x, marks in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                data = x.as_py()
                sizes.append(len(data))
                if not marks:
                    spans.append([])
                    kept.append(data)
                    continue
                p = np.array([m["p"] for m in marks], np.int64)
                n = np.array([m["n"] for m in marks], np.int64)
                _, _, start, length = runs(np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), p, n + SPAN - 1)
                cut = list(zip(start.tolist(), np.minimum(start + length, len(data)).tolist(), strict=True))
                spans.append([{"start": s, "end": e} for s, e in cut])
                edges = [0, *(x for c in cut for x in c), len(data)]
                kept.append(b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], schema=schema)


def indexed(entries: DataFrame, contest: bool) -> DataFrame:
    return entries.repartition("k1").mapInArrow(lambda it: _index(it, contest), SPARK_SCHEMA)


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, spans (start, end in bytes of the maximal removed runs) and kept (the remaining bytes) of every row.

    A byte is removed if a 100-byte string covers it that also starts earlier: in a document with a smaller key, or
    earlier in the same one. Rows that share a key come in the order of a hash of their text; rows that share key and
    text are one document and get one result. A null text is empty. Rows without a key come last, in the order of a hash
    of their text; keys that aren't whole numbers are ordered by a hash. A text of any length is read in blocks; a task
    holds one text and its result. An empty table gives an empty result.
    """
    whole = isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    hashed = F.pmod(F.xxhash64(text), F.lit(1 << 40))
    named = F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 62)))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    source = docs.select(F.col(key).alias("_key"), F.coalesce(named, F.lit(LAST) - hashed).alias("d"), F.hash(text).alias("t"), body.alias("body"))
    work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]] = _contexts
    settled = materialise(indexed(source.select("d", "t", "body").mapInArrow(work, SPARK_SCHEMA), True))
    spans = lambda df: df.groupBy("d", "t").agg(F.collect_list(F.struct("p", "n")).alias("spans"))
    contested = materialise(spans(settled.where(F.col("kind") == CONTESTED)))
    few = contested.agg(F.count(F.lit(1)), F.sum(F.size("spans"))).first()
    if ROW_BYTES * few[0] + STRETCH_BYTES * (few[1] or 0) <= FEW:
        contested = F.broadcast(contested)
    strings = source.select("d", "t", "body").join(contested, ["d", "t"]).select("d", "t", "body", "spans").mapInArrow(_strings, SPARK_SCHEMA)
    later = indexed(strings, False)
    marks = materialise(spans(settled.where(F.col("kind") == MARK).unionByName(later)))
    joined = source.join(marks, ["d", "t"], "left").select("_key", "body", "spans")
    return joined.mapInArrow(lambda it: _removed(it, key), f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def removal_digest(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed.select(key, "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
