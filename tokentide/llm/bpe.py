"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

The merge list decides how far ahead a token can depend on what follows: a merge (u, v) may be prevented only by an
earlier merge whose left part is a suffix of v, and so on along a chain of ever earlier merges. The longest such chain
is the sufficient lookahead: a token that ends that many symbols before the end of what has been read is stable and can
be emitted. Every word passes through a window of fixed size, so the working memory does not depend on the text; a word
that ends within its first window is stable as a whole. Encoding keeps ids only. Decoding reads nothing but ids: a state
machine takes them in pieces and gives out the text as it goes, holding no more than one unfinished character.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.llm.common import in_pieces

#: Characters of a text that are normalised and split at once, up to the next white space.
SLICE = 1 << 16
#: Ids that the decoder takes at once.
PIECE = 1 << 14
#: Words kept with their tokens by each Python worker; all are forgotten when there are more.
CACHED = 300_000

END = "</w>"
SPACE = re.compile("[\t-\r \x85\xa0  -     　]")
ODD_SPACE = re.compile("[\x1c-\x1f]")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\p{Z}\p{L}\p{N}]+")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: The same rule for texts of Latin letters only, which the standard module splits faster.
LATIN_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\t-\r \x85{_class('Z')}{_class('L')}{_class('N')}]+")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Transducer:
    """Encoder and decoder of a word-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.bytes_of = {c: b for b, c in enumerate(self.symbols)}
        self.lookahead = self.sufficient_lookahead(pairs)
        self.window = 2 * self.lookahead + 64
        self.cache: dict[str, bytes] = {}
        self.packers = [struct.Struct(f"<{n}I").pack for n in range(24)]

    @staticmethod
    def sufficient_lookahead(pairs: list[tuple[str, str]]) -> int:
        """Longest reach to the right, in symbols, of a chain of merges each of which can prevent the one before it."""
        length = lambda s: len(s.removesuffix(END)) or 1
        reach: dict[str, int] = {}
        most = 1
        for u, v in pairs:  # earliest first: only those before can prevent this one
            r = length(v) + max(reach.get(v[i:], 0) for i in range(len(v)))
            reach[u] = max(reach.get(u, 0), r)
            most = max(most, r)
        return most

    def merge(self, parts: list[str]) -> list[str]:
        """Apply the merge of the lowest rank, leftmost first, until none applies."""
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word from its symbols, each emitted once the lookahead behind it has been read."""
        held: list[str] = []
        ended = False
        source = iter(symbols)
        while not ended or held:
            while not ended and len(held) < self.window:
                s = next(source, None)
                if s is None:
                    ended = True
                else:
                    held.append(s)
            if not held:
                return
            merged = self.merge([*held[:-1], held[-1] + END] if ended else held[:])
            if ended:
                yield from merged
                return
            used = 0
            for token in merged:
                if used + len(token) > len(held) - self.lookahead:
                    break
                used += len(token)
                yield token
            held = held[used:]

    def word(self, word: str) -> Iterator[str]:
        """Tokens of one word, through the window."""
        if word.isascii() and word.isprintable():
            return self.stream(word)
        step, symbols = self.window, self.symbols
        return self.stream(symbols[b] for i in range(0, len(word), step) for b in word[i : i + step].encode())

    def piece(self, piece: str) -> bytes:
        """Packed ids of one piece of the splitting rule."""
        found = self.cache.get(piece)
        if found is None:
            ids = [self.ids[t] for t in self.word(piece)]
            found = self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        """Packed ids of text without white space."""
        if chunk.isalpha():
            return self.piece(chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ",.!?;:":
            return self.piece(chunk[:-1]) + self.piece(chunk[-1])
        pieces = PIECES if BEYOND_LATIN.search(chunk) else LATIN_PIECES
        return b"".join([self.piece(m[0]) for m in pieces.finditer(chunk)])

    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter by itself: no final sigma
        return text.lower()

    def slices(self, text: str) -> Iterator[str]:
        start = 0
        while start < len(text):
            end = start + SLICE
            if end < len(text):
                space = SPACE.search(text, end)
                end = space.start() if space else len(text)
            yield text[start:end]
            start = end

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ids: list[bytes] = []
        text = text or ""
        parts = self.special_split.split(text) if self.special_split and "<|" in text else [text]
        chunk, cache = self.chunk, self.cache
        for part in parts:
            if part in self.special:
                ids.append(struct.pack("<I", self.special[part]))
                continue
            for piece in self.slices(part):
                piece = self.normalise(piece)
                chunks = SPACE.split(piece) if ODD_SPACE.search(piece) else piece.split()
                ids.extend([cache.get(c) or chunk(c) for c in chunks])
        return b"".join(ids)

    def decoder(self) -> Decoder:
        return Decoder(self)

    def decode_joined(self, ids: bytes) -> str:
        """The tokens joined by spaces: what a tokenizer file without a decoder decodes to. Unknown ids are left out."""
        machine = self.decoder()
        return "".join([machine.joined(ids[at : at + 4 * PIECE]) for at in range(0, len(ids), 4 * PIECE)])

    def decode_text(self, ids: bytes) -> Iterator[str]:
        """Plain text, piece by piece: word ends as spaces."""
        machine = self.decoder()
        for at in range(0, len(ids), 4 * PIECE):
            yield machine.plain(ids[at : at + 4 * PIECE])
        yield machine.rest()


class Decoder:
    """Text from packed ids that arrive in pieces (of whole ids): a state machine that holds what isn't complete yet.

    `joined` has one state: whether a token came before, so that a space goes between. `plain` has the bytes of a
    character that isn't complete: token bytes go through an incremental UTF-8 machine.
    """

    def __init__(self, owner: Transducer) -> None:
        self.owner = owner
        self.begun = False
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def joined(self, ids: bytes) -> str:
        numbers = memoryview(ids).cast("I") if sys.byteorder == "little" else [i for (i,) in struct.iter_unpack("<I", ids)]
        try:
            tokens = [*map(self.owner.tokens.__getitem__, numbers)]
        except KeyError:
            tokens = [t for t in map(self.owner.tokens.get, numbers) if t is not None]
        if not tokens:
            return ""
        lead, self.begun = " " if self.begun else "", True
        return lead + " ".join(tokens)

    def plain(self, ids: bytes) -> str:
        out = []
        for (i,) in struct.iter_unpack("<I", ids):
            token = self.owner.tokens.get(i, "")
            if token in self.owner.special:
                out.append(self.machine.decode(token.encode()))
                continue
            ends = token.endswith(END)
            raw = bytes(map(self.owner.bytes_of.__getitem__, token[: -len(END)] if ends else token))
            out.append(self.machine.decode(raw + b" " if ends else raw))
        return "".join(out)

    def rest(self) -> str:
        return self.machine.decode(b"", final=True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", decode: bool = False) -> DataFrame:
    """key and ids (binary: little-endian unsigned 32-bit integers) of each whole text.

    With decode=True also `decoded`: what the ids, and nothing else, decode to, tokens joined by spaces; it is made in
    the task that made the ids, so they don't travel twice. A null or empty text has no ids. Repeated rows are each
    encoded; a null key stays null; other columns are ignored. Each row needs memory for its own text and ids only.
    """
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.StringType())] if decode else []

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)

        def row(k: pa.Scalar, x: pa.Scalar) -> tuple:
            ids = t.encode(x.as_py())
            return (k.as_py(), ids, t.decode_joined(ids)) if decode else (k.as_py(), ids)

        for b in batches:
            schema = pa.schema([(key, b.schema.field(0).type), ("ids", pa.binary()), *([("decoded", pa.string())] if decode else [])])
            yield from in_pieces((row(k, x) for k, x in zip(b.column(0), b.column(1), strict=True)), schema, weigh=1)

    return docs.select(key, text).mapInArrow(work, T.StructType(fields))


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id", joined: bool = False) -> DataFrame:
    """key and text of packed ids: plain text, or with joined=True the tokens joined by spaces. Null ids give empty text."""
    out = T.StructType([T.StructField(key, encoded.schema[key].dataType), T.StructField("text", T.StringType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            schema = pa.schema([(key, b.schema.field(0).type), ("text", pa.string())])
            packed = ((k.as_py(), x.as_py() or b"") for k, x in zip(b.column(0), b.column(1), strict=True))
            yield from in_pieces(((k, t.decode_joined(x) if joined else "".join(t.decode_text(x)).rstrip(" ")) for k, x in packed), schema, weigh=1)

    return encoded.select(key, ids).mapInArrow(work, out)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of tokens and digests of ids and of the text decoded from them."""
    return encoded.select(
        key,
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
