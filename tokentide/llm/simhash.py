"""SimHash near-dedup: fingerprints, and a binary trie self-join with a budget of differing bits.

Equal fingerprints are one class. Two classes within three bits agree on one of four 16-bit blocks, and on one of four
12-bit blocks of the rest; a class is sent to each of its sixteen pairs of blocks, so that any link is found in one of
them. There the fingerprints form a binary trie (ranges of a sorted array), and the join walks pairs of nodes level by
level: where two ranges take different branches a differing bit is added, and a pair over the budget goes no further.
Links found in one place are joined at once, so what leaves it is a forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.llm.common import in_pieces, materialise
from tokentide.llm.components import components

BUDGET = 3
#: Shingles hashed at once, node pairs walked at once.
CHUNK, PAIRS = 1 << 16, 1 << 18
ONE = np.uint64(1)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """A bit is set where over half of the shingles' XXH64 have it; A-Z in lower case; no words: zero."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = w[at : at + CHUNK + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the 64 bits as a signed long) of every row; a null or empty text has 0; other columns are ignored."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), words) for x in b.column(1)), np.uint64, len(b)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], [key, "fp"])

    return docs.select(key, text).mapInArrow(work, T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fp", T.LongType())]))


class Forest:
    """Labels of places in an array; joining keeps the smaller label."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != label[label]).any():
                label[:] = label[label]


def trie_self_join(fp: np.ndarray, roots: list[tuple[int, int]], budget: int = BUDGET) -> np.ndarray:
    """Labels that join the places of fp (sorted within each root's range, distinct there) within the budget."""
    forest = Forest(len(fp))
    pair = lambda lo, hi: (lo, hi, lo, hi, np.zeros(len(lo), np.int8))
    start = np.array(roots, np.int64).reshape(-1, 2)
    start = start[start[:, 1] - start[:, 0] > 1]
    stack = [(63, pair(start[:, 0], start[:, 1]))]
    zeros_before: dict[int, np.ndarray] = {}
    while stack:
        bit, nodes = stack.pop()
        if len(nodes[0]) > PAIRS:
            half = len(nodes[0]) // 2
            stack += [(bit, tuple(x[:half] for x in nodes)), (bit, tuple(x[half:] for x in nodes))]
            continue
        alo, ahi, blo, bhi, err = nodes
        leaves = (ahi - alo == 1) & (bhi - blo == 1) & (alo != blo)
        if leaves.any():  # compressed paths: both ends are known, so the rest is counted at once
            a, b = alo[leaves], blo[leaves]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= budget
            forest.join(a[near], b[near])
            alo, ahi, blo, bhi, err = (x[~leaves] for x in (alo, ahi, blo, bhi, err))
        if bit < 0 or not len(alo):
            continue
        if bit not in zeros_before:
            zeros_before[bit] = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & ONE == 0)))
        z = zeros_before[bit]
        acut, bcut = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        own = alo == blo
        parts = [(alo, acut, blo, bcut, err), (acut, ahi, bcut, bhi, err), (alo, acut, bcut, bhi, err + 1)]
        parts.append(tuple(x[~own] for x in (acut, ahi, blo, bcut, err + 1)))
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (ahi > alo) & (bhi > blo) & (err <= budget) & ~((alo == blo) & (ahi - alo == 1))
        if keep.any():
            stack.append((bit - 1, tuple(x[keep] for x in (alo, ahi, blo, bhi, err))))
    return forest.label


def _links(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Forest edges from rows sorted by slot; the last slot of a batch waits for its other rows."""
    slot, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def found(slot: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fp, slot))
        slot, fp = slot[order], fp[order]
        cuts = np.flatnonzero(np.diff(slot)) + 1
        lo, hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(slot)]))
        label = trie_self_join(fp, list(zip(lo.tolist(), hi.tolist(), strict=True)), budget)
        child = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child].view(np.int64)), pa.array(fp[label[child]].view(np.int64))], ["u", "v"])

    for b in batches:
        slot = np.concatenate((slot, b.column(0).to_numpy(zero_copy_only=False)))
        fp = np.concatenate((fp, b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        if len(slot) < CHUNK or slot[0] == slot[-1]:
            continue
        done = int(np.searchsorted(slot, slot[-1]))
        yield found(slot[:done], fp[:done])
        slot, fp = slot[done:], fp[done:]
    if len(slot):
        yield found(slot, fp)


def near_links(classes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges u, v that join all fingerprints of classes(fp) within the budget."""
    keys = []
    for block in range(4):
        whole = F.shiftrightunsigned("fp", 16 * block).bitwiseAND(F.lit(0xFFFF))
        rest = F.lit(0).cast("long")
        for k, other in enumerate(b for b in range(4) if b != block):
            rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 16 * other).bitwiseAND(F.lit(0xFFFF)), 16 * k))
        for sub in range(4):
            part = F.shiftrightunsigned(rest, 12 * sub).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((block * 4 + sub) << 28).cast("long") + F.shiftleft(whole, 12) + part)
    slots = classes.select(F.explode(F.array(*keys)).alias("slot"), "fp")
    return slots.repartition("slot").sortWithinPartitions("slot").mapInArrow(lambda it: _links(it, budget), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id: the smallest key reachable over links of at most `budget` bits.

    Null and empty texts have fingerprint zero and link like any other. A row without a key takes the component of the
    others; a component without any key has a null id. An empty table gives an empty result.
    """
    rows = materialise(fingerprints(docs, words, key, text))
    classes = materialise(rows.groupBy("fp").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("n")))
    roots = components(near_links(classes, budget))
    member = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    member = materialise(member)
    least = materialise(member.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("n").alias("size")).where("size > 1"))
    named = materialise(member.join(least, "root").select("fp", "component_id"))
    joined = rows.join(named, "fp", "left")
    return joined.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", key).alias("component_id"))
