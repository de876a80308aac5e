"""From raw documents to a tokenised training mix: five stages, each over all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.llm import bpe, line_dedup, mixing, near_copies, quality
from tokentide.llm.common import materialise, order_id, table
from tokentide.llm.queries import word_tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def numbered(docs: DataFrame) -> DataFrame:
    """docs, written once, with a unique number `row`, and `content`, a hash of the whole row.

    doc_ids can be missing or repeated. Orders go by doc_id and content first: which row has which number can differ
    between runs, but the rows in question are equal then.
    """
    return materialise(docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("content"), F.monotonically_increasing_id().alias("row")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line runs that occur earlier; those of which no word is left go."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS), whole=True)
    text = F.col("kept_text")
    kept = found.where((F.col("n_removed") == 0) | text.rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more): that of the smallest doc_id, a missing one last."""
    rows = numbered(docs)
    groups = near_copies.similar_documents(rows, words=5, similarity=0.8, key="row")
    named = groups.join(rows.select("row", order_id().alias("d"), "content").hint("merge"), "row")
    stay = materialise(named.groupBy("component_id").agg(F.min(F.struct("d", "content", "row")).alias("first")).select("first.row"))
    return rows.join(stay.hint("merge"), "row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = numbered(docs)
    taken = mixing.mix_sources(rows, order=("content", "row")).where("copies > 0").select("row", "copies")
    # by merge at every size: texts and copies are dealt out by row, whatever fits into a broadcast
    return rows.join(materialise(taken).hint("merge"), "row").select(*COLUMNS, F.explode(F.expr("sequence(1, copies)")).alias("copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids, and of the text decoded from the ids, of every document of the mix."""
    return bpe.digests(bpe.encode_documents(docs, word_tokenizer(), decode=True))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", one_of_near_copies),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: SQL has no XXH64 and no exact binomial bound; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
