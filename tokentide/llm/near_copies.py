"""Near copies by SimHash where links are looser than a few bits: similarity of the sets of five-word shingles.

The closest copies come first: the trie self-join of `simhash` finds fingerprints (64 bits) within its budget, and what it
joins, and documents of equal fingerprints, are settled by the exact similarity of both whole texts.

At similarity 0.8 some 15 % of the bits differ: a trie walk with such a budget prunes next to nothing, and blocks of bits
no longer agree. So looser pairs are sought in slots: a document has BANDS of them, each a hash of five of its min-wise
shingles, and two documents of similarity 0.8 share one with a probability of 0.9996. In a slot, documents that the trie's
links do not join with it already are first held against the one with the smallest id by the differing bits of 256-bit
fingerprints: one comparison each, whatever the size of the slot. Every such candidate is settled in the same way.

Once these links are known, all pairs of a slot that they do not join are held against each other, in blocks, and those
within the bit budget are settled too. Of a pair that no link joins, one document is outside the component that has most of
the slot's documents: only such documents visit the slot's blocks, all others stay in theirs. Short texts one word apart lie near that budget in great numbers, so these pairs
must also agree in enough min-wise hashes (a second, independent estimate of similarity) and have sizes that allow
the similarity at all. They come in two rounds: a document first names the few that agree with it most, which mostly join
it, then all that are left among those not joined by then. Nothing is dropped, and a group that does join takes a few pairs
for each document, not all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.llm.common import in_pieces, materialise
from tokentide.llm.components import components
from tokentide.llm.simhash import near_links

BANDS, ROWS = 20, 5
BITS = 256
#: Shingles sketched at once; documents of a slot that meet in one group of a task.
CHUNK, BLOCK = 4096, 2048
#: Pairs of documents whose fingerprints a task holds against each other at once.
CELLS = 1 << 16
#: Candidates that a document names in the first of the two rounds that follow its slots' smallest; in the second, all.
FIRST_TRIES, ALL = 4, 1 << 62
#: Pairs of one document that one task settles.
PARTNERS = 256
_draw = np.random.Generator(np.random.PCG64(5))
MULTIPLY = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
MIX = _draw.integers(0, 1 << 63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)
FP = [f"f{k}" for k in range(BITS // 64)]


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct XXH64 of the shingles, ascending; A-Z in lower case; fewer words: the whole sequence; no word: none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketch(hashes: np.ndarray) -> tuple[list[int], list[int], bytes]:
    """Words of the fingerprint and slots, as signed longs, and a byte of each min-wise hash."""
    ones, least = np.zeros(BITS, np.int64), np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at : at + CHUNK]
        mixed = (h[:, None] ^ (h[:, None] >> np.uint64(32))) * MIX
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (h[:, None] * MULTIPLY + ADD).min(axis=0))
    fp = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)
    slots = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return fp.tolist(), np.array(slots, np.uint64).view(np.int64).tolist(), (least >> np.uint64(24)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """key, digest of the shingle set, fingerprint, slots, min-wise bytes and number of shingles of every row."""
    fields = [T.StructField(f, T.LongType()) for f in FP]
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("digest", T.StringType()), *fields, T.StructField("slots", T.ArrayType(T.LongType())), T.StructField("mins", T.BinaryType()), T.StructField("size", T.IntegerType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([(key, b.schema.field(0).type), ("digest", pa.string()), *[(f, pa.int64()) for f in FP], ("slots", pa.list_(pa.int64())), ("mins", pa.binary()), ("size", pa.int32())])

            def rows(b: pa.RecordBatch = b) -> Iterator[tuple]:
                for k, x in zip(*b.columns, strict=True):
                    h = shingle_hashes(x.as_py(), words)
                    fp, slots, mins = sketch(h)
                    yield k.as_py(), xxhash.xxh3_128_hexdigest(h.tobytes()), *fp, slots, mins, len(h)

            yield from in_pieces(rows(), schema)

    return docs.select(key, text).mapInArrow(work, out)


def budget(similarity: float) -> int:
    """Differing bits that pairs of this similarity hardly ever exceed."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(BITS * p + 3.5 * math.sqrt(BITS * p * (1 - p)))


def _differing() -> Column:
    bits = F.lit(0)
    for f in FP:
        bits = bits + F.bit_count(F.col(f).bitwiseXOR(F.col(f"pivot.{f}")))
    return bits


def least_agreeing(similarity: float) -> int:
    """Min-wise hashes, of all, in which pairs of this similarity hardly ever agree less often."""
    n = BANDS * ROWS
    return math.floor(n * similarity - 3.5 * math.sqrt(n * similarity * (1 - similarity)))


def _hold(met: pa.Table, loose: int, similarity: float, tries: int) -> pa.Table:
    """Pairs of a block's visitors and its own documents that differ in root and may be similar enough: of each visitor the `tries` that agree most.

    A pair that shares several slots is named in the first of them only, and once where both documents are visitors. Where a visitor has more, a row with `cut` says so.
    """
    met = met.sort_by("rep")
    rep, root, size = (met[c].to_numpy() for c in ("rep", "root", "size"))
    visits = met["visits"].to_numpy()
    fp = np.stack([met[f].to_numpy() for f in FP], axis=1).view(np.uint64)
    mins = np.frombuffer(b"".join(met["mins"].to_pylist()), np.uint8).reshape(len(rep), BANDS * ROWS)
    found, cut = [np.zeros((0, 2), np.int64)], False
    slots = met["slots"].combine_chunks().flatten().to_numpy().reshape(len(rep), BANDS)
    here, most = met["slot"][0].as_py(), met["most"][0].as_py()
    one, other = np.flatnonzero(visits), np.flatnonzero(~visits)
    step = max(1, CELLS // max(1, len(other)))
    for at in range(0, len(one), step):
        k = one[at : at + step, None]
        fits = (root[k] != root[other]) & (np.minimum(size[k], size[other]) >= similarity * np.maximum(size[k], size[other]) - 1e-9)
        fits &= np.bitwise_count(fp[k] ^ fp[other]).sum(axis=2, dtype=np.int64) <= loose
        row, column = np.nonzero(fits)
        i, j = k[row, 0], other[column]
        first = (slots[i] == slots[j]).argmax(axis=1)
        once = (slots[i, first] == here) & ((root[j] == most) | (rep[i] > rep[j]))
        i, j = i[once], j[once]
        agree = (mins[i] == mins[j]).sum(axis=1)
        among = np.flatnonzero(agree >= least_agreeing(similarity))
        among = among[np.lexsort((j[among], -agree[among], i[among]))]
        i, j = i[among], j[among]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        cut |= bool((place >= tries).any())
        i, j = rep[i[place < tries]], rep[j[place < tries]]
        found.append(np.stack([np.maximum(i, j), np.minimum(i, j)], axis=1))
    pairs = np.concatenate([np.unique(np.concatenate(found), axis=0), np.zeros((int(cut), 2), np.int64)])
    return pa.table({"u": pairs[:, 0], "v": pairs[:, 1], "cut": np.arange(len(pairs)) >= len(pairs) - int(cut)})


def _dealt(rows: DataFrame, slots: DataFrame, sketched: DataFrame) -> DataFrame:
    """Rows of some slots, with what is known of them, in blocks of own documents (a) and of visitors (b) that meet.

    A document lies in its own block once for each block of visitors. Those outside the slot's largest component visit all
    blocks: with few of them, nearly every row is sent once.
    """
    dealt = rows.join(slots.hint("merge"), "slot").join(sketched.hint("merge"), "rep")
    own, comes = "cast(pmod(xxhash64(rep), k) as int)", "cast(pmod(xxhash64(rep, 1), visitors) as int)"
    places = f"concat(transform(sequence(0, visitors - 1), b -> struct(false as visits, {own} as a, b)), if(root <> most, transform(sequence(0, k - 1), a -> struct(true as visits, a, {comes} as b)), array()))"
    known = ["slot", "most", "rep", "root", *FP, "slots", "mins", "size"]
    return dealt.select(*known, F.explode(F.expr(places)).alias("at")).select(*known, "at.*")


def _sketched(classes: DataFrame) -> DataFrame:
    return classes.select("rep", *FP, "slots", "mins", "size")


def strangers(classes: DataFrame, roots: DataFrame, loose: int, similarity: float, tries: int) -> DataFrame:
    """Distinct pairs u > v that share a slot, may be similar enough and lie in different components of roots(node, root); rows with `cut` say that there are more."""
    named = classes.select("rep", "slots").join(roots.hint("merge"), F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    rows = materialise(named.select(F.explode("slots").alias("slot"), "rep", "root"))
    counts = rows.groupBy("slot", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("slot").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most")).where("most.n < n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = materialise(mixed.select("slot", blocks(F.col("n")).alias("k"), blocks(F.col("n") - F.col("most.n")).alias("visitors"), F.col("most.root").alias("most")))
    met = _dealt(rows, mixed, _sketched(classes)).groupBy("slot", "a", "b")
    return met.applyInArrow(lambda rows: _hold(rows, loose, similarity, tries), "u long, v long, cut boolean").distinct()


def close_pairs(classes: DataFrame) -> DataFrame:
    """Distinct pairs u > v of classes(rep, fingerprint, ...) that the trie self-join of the first 64 bits joins, or whose 64 bits are equal."""
    firsts = materialise(classes.groupBy(F.col(FP[0]).alias("fp")).agg(F.min("rep").alias("first")))
    equal = classes.join(firsts.hint("merge"), F.col(FP[0]) == F.col("fp")).where("rep > first").select(F.col("rep").alias("u"), F.col("first").alias("v"))
    links = materialise(near_links(firsts.select("fp")).distinct())
    one, other = (firsts.select(F.col("fp").alias(end), F.col("first").alias(name)).hint("merge") for end, name in (("u", "a"), ("v", "b")))
    near = links.join(one, "u").join(other, "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return equal.union(near).distinct()


def candidates(classes: DataFrame, roots: DataFrame, loose: int) -> DataFrame:
    """Distinct pairs u > v of classes(rep, fingerprint, slots, ...): each document of a slot with its smallest, if similar enough by bits and not joined by roots(node, root)."""
    named = classes.select("rep", "slots", *FP).join(roots.hint("merge"), F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    rows = materialise(named.select(F.explode("slots").alias("slot"), "rep", "root", *FP))
    crowded = materialise(rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rep", "root", *FP)).alias("pivot")).where("n > 1").drop("n"))
    met = rows.join(crowded.hint("merge"), "slot").where("root <> pivot.root").where(_differing() <= loose)
    return met.select(F.col("rep").alias("u"), F.col("pivot.rep").alias("v")).distinct()


def _settled(batches: Iterable[pa.RecordBatch], words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links from rows (v, part, u, text) in order of v, part, u: the row without u has the text of v itself."""
    at, own = None, np.zeros(0, np.uint64)
    for b in batches:
        near = []
        for v, part, u, x in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
            hashes = shingle_hashes(x.as_py(), words)
            if u is None:
                at, own = (v, part), hashes
            near.append(u is not None and at == (v, part) and similarity_of(own, hashes) >= similarity)
        kept = b.filter(pa.array(near, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(2), kept.column(0)], ["u", "v"])


def settle(pairs: DataFrame, docs: DataFrame, words: int, similarity: float, key: str, text: str) -> DataFrame:
    """The pairs u, v whose whole texts have the similarity.

    The text of v is sent once for PARTNERS of its pairs, to the task that gets the texts of their u: what moves is one
    text a pair, and a v with many partners is spread over many tasks.
    """
    pairs = materialise(pairs.select("u", "v"))
    parts = materialise(pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts")))
    ends = materialise(pairs.select(F.col("u").alias("_id")).union(parts.select("v")).distinct())
    named = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    texts = materialise(named.join(ends.hint("merge"), "_id", "left_semi").dropDuplicates(["_id"]))
    own = parts.join(texts.hint("merge"), F.col("v") == F.col("_id")).select("v", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(None).cast("long").alias("u"), "_text")
    dealt = pairs.join(parts.hint("merge"), "v").select("v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), "u")
    others = dealt.join(texts.hint("merge"), F.col("u") == F.col("_id")).select("v", "part", "u", "_text")
    met = own.union(others).repartition("v", "part").sortWithinPartitions("v", "part", F.col("u").asc_nulls_first())
    return met.mapInArrow(lambda it: _settled(it, words, similarity), "u long, v long")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and component_id: the smallest key reachable over links of at least this similarity.

    Texts with equal shingle sets are one class; null and empty texts are one as well. A row without a key takes the
    component of its class (null if no row of it has a key). Rows that share a key should have equal texts. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = materialise(sketches(docs, words, key, text))
    first = [F.first(c).alias(c) for c in (*FP, "slots", "mins", "size")]
    classes = materialise(rows.groupBy("digest").agg(F.min(F.col(key).cast("long")).alias("rep"), *first).where("rep is not null"))
    loose = budget(similarity)
    tested = materialise(close_pairs(classes))
    roots = components(settle(tested, docs, words, similarity, key, text))
    looser = materialise(candidates(classes, roots, loose).join(tested.hint("merge"), ["u", "v"], "left_anti"))
    links = settle(looser, docs, words, similarity, key, text)
    roots = materialise(components(links.union(roots.select("node", "root"))))
    tested = tested.union(looser)
    for tries in (FIRST_TRIES, ALL):
        found = materialise(strangers(classes, roots, loose, similarity, tries))
        more = materialise(found.where("not cut").select("u", "v").join(tested.hint("merge"), ["u", "v"], "left_anti"))
        if not more.isEmpty():
            links = settle(more, docs, words, similarity, key, text)
            roots = materialise(components(links.union(roots.select("node", "root"))))
            tested = tested.union(more)
        if found.where("cut").isEmpty():
            break
    named = classes.select("digest", "rep").join(roots, F.col("rep") == F.col("node"), "left")
    named = materialise(named.select("digest", F.coalesce("root", "rep").alias("component_id")))
    return rows.select(key, "digest").join(named.hint("merge"), "digest", "left").select(key, "component_id")
