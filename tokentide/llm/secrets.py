"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

A candidate (an unbroken string of any length from LEAST on, in a sensitive context on either side) is compressed with a
dictionary made of common identifiers and of the code around it. What it still costs is its marginal size: text that the
dictionary explains costs little, random key material costs close to its entropy. Candidates that stay incompressible
are reported with kind `novel`. Words compress no better than keys when they are short, so strings that read as words
(long parts of one kind of character, as in `getUserName` or `release-notes`) are no candidates.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.llm.common import in_pieces

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

#: A string that may be key material: a whole run of one alphabet; `=` only pads it.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{10,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Parts of a name: words (a capital may lead), capitals, digits.
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Characters that a candidate has at least; from LONG on, any string with a digit is one.
LEAST, LONG = 10, 20
#: Mean length of the parts up to which a string doesn't read as words, and length of a part beyond which it is no word.
MEAN_PART, LONGEST_PART = 3.0, 24
#: Words that make the text around a candidate sensitive.
SENSITIVE = re.compile(r"key|secret|token|passw|credential|auth|bearer|private|signature|akia", re.IGNORECASE)
#: Code points on either side of a candidate that are searched for such a word, and that prime the dictionary.
NEAR, AROUND = 48, 512
#: Marginal compressed bytes for each character from which a candidate counts as new. Short random strings are stored as
#: they are (about 1), long random base-64 needs 0.75; what the dictionary knows needs less than 0.5.
NOVEL_RATE = 0.7
#: What code commonly says around secrets; it primes every dictionary.
IDENTIFIERS = (
    "access_key_id secret_access_key client_id client_secret api_key apikey auth_token bearer_token refresh_token session_token "
    "private_key public_key password passwd credentials authorization signature username database connection_string endpoint "
    "config settings environment production staging development localhost http https true false null none return import export "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 12345678 xxxxxxxx example sample test"
)


class Novelty:
    """Marginal compressed size of strings given what surrounds them."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3) -> None:
        self.identifiers, self.level = identifiers.encode(), level

    def compressed(self, data: bytes, context: bytes) -> int:
        primed = zstandard.ZstdCompressionDict(self.identifiers + context, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        form = zstandard.ZstdCompressionParameters.from_level(self.level, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=primed, compression_params=form).compress(data))

    def marginal(self, candidate: str, before: str, after: str) -> int:
        """Bytes that the candidate adds to the last words before it, with everything around it in the dictionary."""
        context = (after + before).encode()
        lead = before[-32:].encode()
        return max(0, self.compressed(lead + candidate.encode(), context) - self.compressed(lead, context))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def may_be_key(s: str) -> bool:
    """Whether a string's shape is that of key material and not of words or dates."""
    parts = PARTS.findall(s)
    if not parts:
        return False
    digits = any(p.isdigit() for p in parts)
    if len(s) >= LONG and digits:
        return True
    mean = sum(map(len, parts)) / len(parts)
    if len(s) >= LONG:
        return mean <= MEAN_PART or max(map(len, parts)) > LONGEST_PART
    return digits and mean <= MEAN_PART and not all(p.isdigit() for p in parts)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, rate: float = NOVEL_RATE) -> list[tuple[int, int, int]]:
    """Incompressible candidates in a sensitive context that no fixed pattern covers; time is linear in the text."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, ends = [a for a, _ in words], [b for _, b in words]
    covered: list[tuple[int, int]] = []  # base spans, by start, merged where they overlap
    for a, _, b in base:
        if covered and a <= covered[-1][1]:
            covered[-1] = covered[-1][0], max(b, covered[-1][1])
        else:
            covered.append((a, b))
    cover_starts = [a for a, _ in covered]
    found = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        before, after = bisect_right(ends, s) - 1, bisect_left(starts, e)
        near = (before >= 0 and s - ends[before] <= NEAR) or (after < len(starts) and starts[after] - e <= NEAR)
        if not near or not may_be_key(m[0]):
            continue
        at = bisect_left(cover_starts, e) - 1
        if at >= 0 and covered[at][1] > s:
            continue
        if novelty.marginal(m[0], text[max(0, s - AROUND) : s], text[e : e + AROUND]) >= rate * (e - s):
            found.append((s, 3, e))
    return found


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rate: float = NOVEL_RATE) -> DataFrame:
    """key and spans (kind, start, end in code points, end exclusive) of each whole text, by start, then kind.

    A null or empty text has no spans. Repeated rows are scanned each; a null key stays null; other columns are ignored.
    Texts are scanned whole, in linear time; a task holds one batch of them and its spans.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("spans", T.ArrayType(span))])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:

            def rows(b: pa.RecordBatch = b) -> Iterator[tuple]:
                for k, x in zip(b.column(0), b.column(1), strict=True):
                    t = x.as_py() or ""
                    base = base_spans(t)
                    spans = sorted(base + novel_spans(t, base, novelty, rate))
                    yield k.as_py(), [{"kind": KINDS[n], "start": s, "end": e} for s, n, e in spans]

            yield from in_pieces(rows(), pa.schema([(key, b.schema.field(0).type), ("spans", kind)]))

    return docs.select(key, text).mapInArrow(work, out)


def secret_digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per kind, the digest of the fixed patterns' spans, and all spans in one string."""
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return spans.select(
        key,
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count("novel").alias("n_novel"),
    )
