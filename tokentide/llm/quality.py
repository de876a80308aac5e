"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose measure is above a cutoff. A cutoff is used only where labelled good documents prove,
by an exact binomial bound, that it rejects at most a given share of good ones in the stratum (the language). The error
probability is split over all strata, rules and cutoffs tried (Bonferroni), and the admissible share over the rules, so
with the stated confidence no stratum loses more than `risk` of its good documents. Of the proven cutoffs the strictest
is used; a stratum with too few labels gets none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.llm.common import in_pieces, materialise

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")
#: Begins the names of columns that are added to a caller's.
OWN = "_quality_"
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
UPPER = bytes(range(65, 91))
#: Rules: measure and the cutoffs tried.
RULES: dict[str, list[float]] = {
    "symbols_per_word": [3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "duplicate_lines_per_word": [0.2, 0.1, 0.05, 0.02, 0.01],
    "repeated_share": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "chars_per_word": [40.0, 30.0, 25.0, 20.0, 15.0, 12.0],
    "upper_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
}
#: Share of good documents that a stratum may lose to all rules together, and the probability that any stratum loses more.
RISK, ERROR = 0.03, 0.05
#: Cutoffs of fewer strata than this are broadcast (some 100 bytes each).
STRATA = 10_000


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; a null text has none."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    spaces = len(data) - len(data.translate(None, SPACES))
    word_chars = len(text or "") - spaces
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    upper = len(data) - len(data.translate(None, UPPER))
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = [*zip(words, words[1:], words[2:], strict=False)]
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, upper


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """key, stratum and COUNTS of every row."""
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("stratum", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([(key, b.schema.field(0).type), ("stratum", pa.string()), *[(c, pa.int64()) for c in COUNTS]])
            yield from in_pieces(((k.as_py(), s.as_py(), *measure(x.as_py())) for k, s, x in zip(*b.columns, strict=True)), schema)

    return docs.select(key, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), text).mapInArrow(work, out)


def measured_rows(docs: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """All columns of docs with stratum and COUNTS, each after OWN: the rows stay where they are."""
    prepared = docs.withColumn(f"{OWN}stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    out = T.StructType([*prepared.schema.fields, *[T.StructField(f"{OWN}{c}", T.LongType()) for c in COUNTS]])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(x.as_py()) for x in b.column(b.schema.get_field_index(text))]
            counts = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns, *counts], [f.name for f in out])

    return prepared.mapInArrow(work, out)


def base_failed(own: str = "") -> Column:
    n = F.col(f"{own}n_words")
    return (n < 50) | (100 * F.col(f"{own}n_repeat_words") > 50 * n)


def rates(own: str = "") -> dict[str, Column]:
    words = F.greatest(f"{own}n_words", F.lit(1))
    return {
        "symbols_per_word": F.col(f"{own}n_symbols") / words,
        "duplicate_lines_per_word": F.col(f"{own}n_dup_lines") / words,
        "repeated_share": F.col(f"{own}n_repeat_words") / words,
        "chars_per_word": F.col(f"{own}word_chars") / words,
        "upper_share": F.col(f"{own}n_upper") / F.greatest(f"{own}word_chars", F.lit(1)),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n), each with probability p: all terms of either tail, outwards until they no longer count."""
    if k >= n:
        return 1.0
    below = k < n * p  # else the other tail is summed, whose terms fall as well
    i, step = (k, -1) if below else (k + 1, 1)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = 0.0
    while 0 <= i <= n and term > total * 1e-17:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p) if below else (n - i) * p / ((i + 1) * (1 - p))
        i += step
    return min(1.0, total) if below else max(0.0, 1.0 - total)


def choose_cutoffs(tallies: pd.DataFrame, risk: float = RISK, error: float = ERROR) -> pd.DataFrame:
    """Strictest proven cutoff for each stratum and rule, from rows (stratum, rule, cutoff, n, rejected, tests)."""
    share = risk / len(RULES)
    proven = [binomial_tail(int(r.rejected), int(r.n), share) <= error / r.tests for r in tallies.itertuples()]
    return tallies[proven].groupby(["stratum", "rule"], as_index=False)["cutoff"].min()


def cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, rule and cutoff. A document is good if every label it has says quality 1; labels without one don't count.

    A label is one observation: of rows that share a labelled key only one counts, the one with the largest measures in
    the order of RULES, so that repeated rows prove nothing more.
    """
    good = labels.where("quality is not null").groupBy(key).agg(F.min("quality").alias("quality")).where("quality = 1")
    labelled = measured.where(~base_failed()).join(good, key).select(key, "stratum", *[c.alias(r) for r, c in rates().items()])
    held = labelled.groupBy(key).agg(F.max(F.struct(*RULES, "stratum")).alias("x")).select("x.*")
    tried = [(r, c) for r, cuts in RULES.items() for c in cuts]
    tallies = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r) > c).alias(f"x{i}") for i, (r, c) in enumerate(tried)])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"x{i}").alias("rejected")) for i, (r, c) in enumerate(tried)])
    strata = tallies.agg(F.count(F.lit(1)).alias("strata"))
    long = tallies.crossJoin(F.broadcast(strata)).select("stratum", "n", "strata", F.explode(rows).alias("x"))  # one row
    long = long.select("stratum", "x.rule", "x.cutoff", "n", "x.rejected", (F.col("strata") * len(tried)).alias("tests"))
    return long.groupBy("stratum").applyInPandas(lambda t: choose_cutoffs(t, risk, error), "stratum string, rule string, cutoff double")


def _by_stratum(chosen: DataFrame, own: str = "") -> DataFrame:
    return chosen.groupBy(F.col("stratum").alias(f"{own}of_stratum")).agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{own}cut_{r}") for r in RULES])


def _above(own: str = "") -> Column:
    above = F.lit(False)
    for r, rate in rates(own).items():
        above = above | F.coalesce(rate > F.col(f"{own}cut_{r}"), F.lit(False))
    return above


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows that judge() keeps, with the columns of docs. Texts are measured where they lie and never shuffled.

    A stratum has cutoffs only where its labels prove them, so their table has a row for each well-labelled stratum: with
    fewer than STRATA of them it is broadcast, else rows are joined by stratum.
    Columns of docs may have any names that don't begin with OWN.
    """
    measured = materialise(measures(docs, key, text, stratum))
    by_stratum = materialise(_by_stratum(cutoffs(measured, labels.select(key, "quality"), key, risk, error), OWN))
    rows = measured_rows(docs, text, stratum)
    if by_stratum.count() < STRATA:
        by_stratum = F.broadcast(by_stratum)
    joined = rows.join(by_stratum, F.col(f"{OWN}stratum") == F.col(f"{OWN}of_stratum"), "left")
    return joined.where(~base_failed(OWN) & ~_above(OWN)).select(*docs.columns)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """key, COUNTS, base_failed and kept of every row.

    kept is false where the base rules fail or a measure is above its stratum's cutoff. A null text has no words and
    fails. A null stratum is the empty one. Without labels only the base rules hold. Rows that repeat are judged each;
    rows without a key are never labelled; extra columns are ignored. Texts are measured whole: a task holds one text and
    its words, some twenty times its bytes.
    """
    measured = materialise(measures(docs, key, text, stratum))
    by_stratum = materialise(_by_stratum(cutoffs(measured, labels.select(key, "quality"), key, risk, error)))
    joined = measured.join(by_stratum, F.col("stratum") == F.col("of_stratum"), "left")
    return joined.select(key, *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~_above()).alias("kept"))
