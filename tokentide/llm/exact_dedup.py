"""Exact dedup by Patricia-trie owners.

Texts go to the partition that owns their length and content hash. There, full byte strings are inserted into one
compressed radix trie per partition, whose terminal nodes keep the largest doc_id and the number of copies. Strings that
share a beginning share its edges. A reading task first inserts what it reads into a trie of its own, so that a text moves
once per task however many copies it has; when the trie outgrows its memory, the heaviest subtree is written out and
forgotten. An owner reads its strings in byte order (Spark's sort does the spilling): a string that leaves a subtree ends
it, so finished subtrees are written out at once and only the path to the last string stays in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.llm.common import in_pieces, materialise

#: Bytes that a reading task's trie may take before its heaviest subtree is written out.
HELD = 32 << 20
#: Bytes that a node takes besides its label (objects and the dictionary of its children).
NODE_BYTES = 400


class Terminal:
    __slots__ = ("count", "keep")

    def __init__(self) -> None:
        self.keep: int | None = None
        self.count = 0

    def add(self, doc_id: int | None, count: int = 1) -> None:
        self.count += count
        if doc_id is not None and (self.keep is None or doc_id > self.keep):
            self.keep = doc_id


class Node:
    __slots__ = ("children", "label", "terminal")

    def __init__(self, label: bytes = b"") -> None:
        self.label = label
        self.children: dict[int, Node] = {}
        self.terminal: Terminal | None = None


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common beginning of a and of b from `at` on, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Byte strings in a compressed radix trie; every chain of single children is one edge.

    `weights` has the bytes under each child of the root, labels and nodes.
    """

    def __init__(self) -> None:
        self.root = Node()
        self.weights: dict[int, int] = {}
        self.nodes = 1

    @property
    def weight(self) -> int:
        return sum(self.weights.values())

    def _grown(self, key: bytes, size: int) -> None:
        self.nodes += 1
        self.weights[key[0]] = self.weights.get(key[0], 0) + size + NODE_BYTES

    def insert(self, key: bytes) -> Terminal:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self._grown(key, len(key) - at)
                node = child
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            same = shared_prefix(child.label, key, at)
            middle = Node(child.label[:same])
            child.label = child.label[same:]
            middle.children[child.label[0]] = child
            node.children[key[at]] = middle
            self._grown(key, 0)
            node, at = middle, at + same
        if node.terminal is None:
            node.terminal = Terminal()
        return node.terminal

    @staticmethod
    def below(node: Node, path: bytes) -> Iterator[tuple[bytes, Terminal]]:
        """Strings of a subtree in byte order; path is what leads to the node."""
        stack = [(node, path)]
        while stack:
            node, path = stack.pop()
            path += node.label
            if node.terminal is not None:
                yield path, node.terminal
            stack += [(node.children[c], path) for c in sorted(node.children, reverse=True)]

    def items(self) -> Iterator[tuple[bytes, Terminal]]:
        return self.below(self.root, b"")

    def spill(self) -> Iterator[tuple[bytes, Terminal]]:
        """Write out and forget the heaviest subtree of the root."""
        first = max(self.weights, key=self.weights.__getitem__)
        del self.weights[first]
        return self.below(self.root.children.pop(first), b"")


class OrderedTrie:
    """The trie of strings that arrive in byte order: only the path to the last one, since the rest is finished.

    `add` gives back the strings that the new one ends, in byte order.
    """

    def __init__(self) -> None:
        self.path: list[tuple[int, Terminal]] = []  # ends of the terminal nodes on the path to the last string
        self.last = b""

    def add(self, key: bytes, doc_id: int | None, count: int) -> Iterator[tuple[bytes, Terminal]]:
        same = shared_prefix(self.last, key, 0)
        yield from self._end(same)
        self.last = key
        if not self.path or self.path[-1][0] != len(key):
            self.path.append((len(key), Terminal()))
        self.path[-1][1].add(doc_id, count)

    def _end(self, upto: int) -> Iterator[tuple[bytes, Terminal]]:
        while self.path and self.path[-1][0] > upto:
            end, terminal = self.path.pop()
            yield self.last[:end], terminal

    def finish(self) -> Iterator[tuple[bytes, Terminal]]:
        yield from self._end(-1)


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; other letters stay."""
    return (text or "").encode().lower()


def _read(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0: doc_id and digest) and of the texts seen in this task (kind 1)."""

    def handed_on(found: Iterable[tuple[bytes, Terminal]]) -> Iterator[tuple]:
        for body, end in found:
            yield 1, end.keep, len(body), xxhash.xxh3_64_intdigest(body) - (1 << 63), body, end.count, None

    trie = PatriciaTrie()
    for b in batches:
        rows: list[tuple] = []
        for k, x in zip(b.column(0), b.column(1), strict=True):
            body = normalised(x.as_py())
            trie.insert(body).add(k.as_py())
            rows.append((0, k.as_py(), None, None, None, None, hashlib.sha256(body).hexdigest()))
        yield from in_pieces(rows, schema)
        while trie.weight > HELD:
            yield from in_pieces(handed_on(trie.spill()), schema, weigh=4)
    yield from in_pieces(handed_on(trie.items()), schema, weigh=4)


def _own(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Classes of equal texts from an owner's texts in byte order."""

    def ended() -> Iterator[tuple[bytes, Terminal]]:
        trie = OrderedTrie()
        for b in batches:
            for body, keep, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from trie.add(body, keep, count)
        yield from trie.finish()

    yield from in_pieces(((hashlib.sha256(body).hexdigest(), end.keep, end.count) for body, end in ended() if end.count > 1), schema)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal when they agree after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest key stays. A row without a key stays only if it is alone; rows that share the largest key all stay. A task
    holds HELD bytes of texts besides the batch it reads.
    """
    from_py = pa.schema([("kind", pa.int8()), (key, pa.int64()), ("length", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()), ("n", pa.int64()), ("text_sha256", pa.string())])
    read = T.StructType([T.StructField(n, t) for n, t in (("kind", T.ByteType()), (key, T.LongType()), ("length", T.LongType()), ("hash", T.LongType()), ("body", T.BinaryType()), ("n", T.LongType()), ("text_sha256", T.StringType()))])
    both = docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(lambda it: _read(it, from_py), read)
    both = materialise(both)
    rows = both.where("kind = 0").select(key, "text_sha256")
    texts = both.where("kind = 1").select("body", key, "n", "length", "hash")
    own = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    classes = texts.repartition("length", "hash").sortWithinPartitions("body").select("body", key, "n").mapInArrow(lambda it: _own(it, own), "text_sha256 string, keep_id long, group_size long")
    classes = materialise(classes)
    joined = rows.join(classes, "text_sha256", "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col(key)).otherwise(F.col("keep_id"))
    return joined.select(key, keep.alias("keep_id"), size.alias("group_size"), ((size == 1) | F.coalesce(F.col(key) == F.col("keep_id"), F.lit(False))).alias("kept"), "text_sha256")
