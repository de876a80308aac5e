"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear support vector machines.

Texts are read as frequencies of hashed byte trigrams of the lower-cased text. A vote of pairwise machines picks the
family; within it, pairwise machines that were trained on those two languages alone pick the language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.llm.common import materialise

#: Language codes of each family. A code that isn't listed is in the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk",
    "semitic": "ar he am mt",
    "indic": "hi bn pa gu mr ne ur",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Buckets of hashed trigrams; labelled documents of each language that are learned from, at most (about).
BUCKETS, LEARN_FROM = 1 << 16, 600
UNDETERMINED = "und"
#: Bytes whose trigrams are looked up at once.
BLOCK = 1 << 20
SCALE = 20.0


def is_held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def trigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.unique(trigrams(text.lower().encode()), return_counts=True)
    return codes, SCALE * counts / counts.sum()


def train_svm(xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, c: float = 4.0, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Weights and, last, the bias of a linear machine with hinge loss, by dual coordinate descent; ys are 1 and -1."""
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(xs))
    share = {1: len(ys) / (2 * max(1, int((ys > 0).sum()))), -1: len(ys) / (2 * max(1, int((ys < 0).sum())))}
    norms = [float(v @ v) + 1.0 for _, v in xs]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(xs)):
            k, v = xs[i]
            y = ys[i]
            step = (1.0 - y * (float(w[k] @ v) + bias)) / norms[i]
            new = min(max(alpha[i] + step, 0.0), c * share[int(y)])
            if new != alpha[i]:
                w[k] += (new - alpha[i]) * y * v
                bias += (new - alpha[i]) * y
                alpha[i] = new
    return np.append(w, bias)


class LanguageModel:
    """Pairwise machines over families, and within each family over its languages."""

    def __init__(self, xs: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> None:
        """xs: features of the sample."""
        families = [FAMILY_OF.get(x.lower()[:2], "other") for x in langs]
        self.families = sorted(set(families))
        self.languages = {f: sorted({x for x, g in zip(langs, families, strict=True) if g == f}) for f in self.families}
        self.weights: list[np.ndarray] = []
        self.family_pairs = self._pairs(xs, families, self.families)
        self.language_pairs = {}
        for f in self.families:
            mine = [i for i, g in enumerate(families) if g == f]
            self.language_pairs[f] = self._pairs([xs[i] for i in mine], [langs[i] for i in mine], self.languages[f])
        self.table = np.ascontiguousarray(np.stack(self.weights), np.float32) if self.weights else np.zeros((0, BUCKETS + 1), np.float32)

    def _pairs(self, xs: list, names: list[str], kinds: list[str]) -> dict[tuple[int, int], int]:
        found = {}
        for a, b in combinations(range(len(kinds)), 2):
            mine = [i for i, n in enumerate(names) if n in (kinds[a], kinds[b])]
            found[a, b] = len(self.weights)
            self.weights.append(train_svm([xs[i] for i in mine], np.array([1 if names[i] == kinds[a] else -1 for i in mine])))
        return found

    def margins(self, texts: list[str]) -> np.ndarray:
        """One row of margins for each text; whole texts, a block of bytes at a time."""
        out = np.zeros((len(texts), len(self.table)))
        for i, text in enumerate(texts):
            data = text.lower().encode()
            n = 0
            for at in range(0, max(1, len(data)), BLOCK):
                codes = trigrams(data[max(0, at - 2) : at + BLOCK])
                n += len(codes)
                for m in range(len(self.table)):
                    out[i, m] += self.table[m].take(codes).sum(dtype=np.float64)
            out[i] = SCALE * out[i] / n + self.table[:, -1]
        return out

    @staticmethod
    def _vote(kinds: int, pairs: dict[tuple[int, int], int], margins: np.ndarray) -> tuple[int, float]:
        """The kind with most wins, ties by the sum of margins, and the surety of its weakest pair."""
        if kinds == 1:
            return 0, 1.0
        wins, sums = np.zeros(kinds), np.zeros(kinds)
        for (a, b), m in pairs.items():
            wins[a if margins[m] >= 0 else b] += 1
            sums[a] += margins[m]
            sums[b] -= margins[m]
        best = int(np.lexsort((sums, wins))[-1])
        least = min(margins[m] if a == best else -margins[m] for (a, b), m in pairs.items() if best in (a, b))
        return best, 1.0 / (1.0 + float(np.exp(-2.0 * np.clip(least, -30, 30))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.families else []
        found = [(UNDETERMINED, 0.0)] * len(texts)
        for i, margins in zip(known, self.margins([texts[i] for i in known]), strict=True):
            f, sure = self._vote(len(self.families), self.family_pairs, margins)
            family = self.families[f]
            k, surer = self._vote(len(self.languages[family]), self.language_pairs[family], margins)
            found[i] = self.languages[family][k], sure * surer
        return found


def learn(docs: DataFrame, learn_from: int = LEARN_FROM, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model from a sample of the labelled documents that aren't held out.

    The sample is bounded: about `learn_from` documents of each language, chosen by a hash of the key; a key that
    repeats counts once. Only their features come to the driver, BUCKETS numbers a document at most, however long it is.
    Rows without text or language, or without a letter, aren't learned from.
    """
    usable = docs.where(~is_held_out(key) & F.col(lang).isNotNull() & (F.col(lang) != UNDETERMINED))
    counts = usable.groupBy(lang).agg(F.count(F.lit(1)).alias("n"))
    share = materialise(counts.select(lang, (F.least(F.lit(1.0), F.lit(float(learn_from)) / F.col("n")) * (1 << 20)).alias("upto")))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20))
    chosen = materialise(usable.select(key, lang).join(share, lang).where(draw < F.col("upto")).select(key).distinct())
    texts = usable.select(key, text, lang).join(F.broadcast(chosen), key)  # about learn_from keys for each language
    rows = texts.where(F.col(text).rlike(r"\p{L}")).select(F.col(key).cast("string").alias("k"), F.col(lang).alias("lang"), F.col(text).alias("x"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                found = [features(x.as_py()) for x in part.column(2)]
                codes, values = pa.array([c.astype(np.int32) for c, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), codes, values], ["k", "lang", "codes", "counts"])

    found = rows.mapInArrow(work, "k string, lang string, codes array<int>, counts array<double>")
    once = found.groupBy("lang", "k").agg(F.min(F.struct("codes", "counts")).alias("x"))
    sample = sorted(once.collect(), key=lambda r: (r["lang"], r["k"]))
    return LanguageModel([(np.array(r["x"]["codes"], np.int64), np.array(r["x"]["counts"])) for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (0 to 1) of each whole text.

    `und` with score 0 where the text is null or has no letter, or nothing was learned. Repeated rows are judged each;
    a null key stays null; other columns, lang and source among them, aren't read. Long texts are read in blocks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights for each pair of languages

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                found = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [key, "lang_pred", "score"])

    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(key, text).mapInArrow(work, out)
