"""Line dedup: repeated runs of lines, found by distributed prefix doubling over sequences of line ids.

The suffixes are those that start at a line with a word. A line's first rank is the place of its first occurrence; a
doubling step ranks 2h lines by the pair of ranks of h lines, again by first occurrence, so suffixes with one rank form
one interval of the suffix array in which the longest common prefix is at least the length ranked. Lines that occur once
end every repeated run and are left out at the start. A suffix counts up to the least number of lines that hold
`min_words` words: where the interval of that depth has an earlier suffix, those lines repeat an earlier run. With
`whole`, a suffix found repeated counts at greater depths as well, as long as the lines behind its first hold less than
`min_words` words (with more, the next suffix says the same), so short lines at the end of a run belong to it; depth two
always counts, for lines without a word between the first and the next. The union
of such stretches then are the maximal repeated runs; they are deleted everywhere but at their first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.llm.common import materialise, order_id, word_count

#: Words that a repeated run must hold; shorter ones (headings, closing words) stay everywhere.
MIN_WORDS = 10
PLACE = ["d", "t", "i"]


def _ranked(rows: DataFrame, key: list[Column], rank: str) -> DataFrame:
    """rows with `rank`: the first place of their key; null where the key is null or has one place only."""
    named = [k.alias(f"_k{n}") for n, k in enumerate(key)]
    place = F.struct(*PLACE)
    known = rows.select(*named, place.alias("place")).dropna(subset=[f"_k{n}" for n in range(len(key))])
    firsts = known.groupBy(*[f"_k{n}" for n in range(len(key))]).agg(F.min("place").alias(rank), F.max("place").alias("_last"))
    firsts = materialise(firsts.where(F.col(rank) != F.col("_last")).drop("_last"))
    return rows.select("*", *named).join(firsts, [f"_k{n}" for n in range(len(key))], "left").drop(*[f"_k{n}" for n in range(len(key))])


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """d, t and runs (start, end in lines of the text, end exclusive) of the documents that lose lines."""
    lines = F.filter(
        F.transform(F.split(F.col(text), "\n"), lambda x, n: F.struct(n.alias("ln"), x.alias("line"))),
        lambda s: s["line"].rlike(r"[^\x20\x09-\x0D]"),
    )
    rows = docs.select(order_id(key).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(lines).alias("i", "s")).select(
        "d", "t", "i", F.col("s.ln").alias("ln"), word_count(F.col("s.line")).alias("words"),
        F.xxhash64(F.col("s.line")).alias("a"), F.xxhash64(F.lit("second"), F.col("s.line")).alias("b"),
    )
    rows = materialise(rows)
    rows = _ranked(rows, [F.col("a"), F.col("b")], "rank0").where(F.col("rank0").isNotNull()).drop("a", "b").dropDuplicates(PLACE)

    suffix = Window.partitionBy("d", "t").orderBy("i")
    ahead = lambda c, n: F.when(F.lead("i", n).over(suffix) == F.col("i") + n, F.lead(c, n).over(suffix)) if n else F.col(c)
    enough = [
        F.when((F.sum("words").over(suffix.rowsBetween(0, n - 1)) >= min_words) & ahead("ln", n - 1).isNotNull(), F.struct(F.lit(n).alias("depth"), (ahead("ln", n - 1) + 1).alias("end")))
        for n in range(1, min_words + 1)
    ]
    rows = rows.withColumn("need", F.coalesce(*enough))
    #: Which depths count depends on the lines alone, so that all suffixes of an interval are there.
    short = lambda n: F.lit(True) if n == 2 else F.sum("words").over(suffix.rowsBetween(1, n - 1)) < min_words
    beyond = [
        F.when(short(n) & (F.col("need.depth") < n) & ahead("ln", n - 1).isNotNull(), F.struct(F.lit(n).alias("depth"), (ahead("ln", n - 1) + 1).alias("end")))
        for n in range(2, max(min_words, 2) + 1)
    ]
    more = F.filter(F.array(*beyond), lambda x: x.isNotNull()) if whole else F.array().cast("array<struct<depth:int,end:int>>")
    rows = materialise(rows.withColumn("more", more))
    deepest = rows.agg(F.greatest(F.max("need.depth"), F.max(F.array_max("more.depth")))).first()[0]
    if deepest is None:
        deepest = 1
    step = 0
    while 2 << step <= deepest:
        paired = rows.withColumn("_next", ahead(f"rank{step}", 1 << step))
        rows = materialise(_ranked(paired, [F.col(f"rank{step}"), F.col("_next")], f"rank{step + 1}").drop("_next"))
        step += 1

    levels = []
    for n in range(1, deepest + 1):
        k = n.bit_length() - 1
        end = F.when(F.col("need.depth") == n, F.col("need.end")).otherwise(F.get("more.end", F.array_position("more.depth", n).cast("int") - 1))
        levels.append(F.struct(F.lit(n).alias("depth"), end.alias("end"), F.col(f"rank{k}").alias("head"), ahead(f"rank{k}", n - (1 << k)).alias("tail")))
    known = F.filter(F.array(*levels), lambda x: x["end"].isNotNull() & x["head"].isNotNull() & x["tail"].isNotNull())
    found = rows.select(*PLACE, "ln", known.alias("levels")).select(*PLACE, "ln", F.explode("levels").alias("level")).select(*PLACE, "ln", "level.*")
    found = _ranked(materialise(found), [F.col("depth"), F.col("head"), F.col("tail")], "first")
    spans = found.where(F.col("first").isNotNull() & (F.col("first") != F.struct(*PLACE))).select("d", "t", F.col("ln").alias("start"), "end")

    in_order = Window.partitionBy("d", "t").orderBy("start", "end")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(in_order))
    merged = islands.groupBy("d", "t", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """All columns of docs with kept_text, n_lines, n_removed and n_runs (a column of docs with such a name is replaced).

    First occurrence: smallest doc_id (a missing one last), then first line. Lines without a word belong to a run only
    between its lines. Without `whole`, runs end where they hold min_words words. A null text stays null and has no lines;
    a text whose lines all go becomes empty. Rows that share doc_id and text count as one and get one result. An empty
    table gives an empty result.
    """
    kept_names = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_removed", "n_runs")]
    runs = materialise(repeated_runs(docs, min_words, key, text, whole)).withColumnsRenamed({"d": "_line_d", "t": "_line_t", "runs": "_line_runs"})
    keyed = docs.select(*kept_names).withColumns({"_line_d": order_id(key), "_line_t": F.xxhash64(text)}).join(runs, ["_line_d", "_line_t"], "left")
    lines = F.split(F.col(text), "\n")
    n = F.size(lines)
    runs_ = F.coalesce("_line_runs", F.array().cast("array<struct<start:int,end:int>>"))
    ends = F.concat(F.array(F.lit(0)), F.transform(runs_, lambda r: r["end"]))
    starts = F.concat(F.transform(runs_, lambda r: r["start"]), F.array(n))
    kept = F.flatten(F.zip_with(ends, starts, lambda e, s: F.slice(lines, e + 1, s - e)))
    removed = F.aggregate(runs_, F.lit(0), lambda a, r: a + r["end"] - r["start"])
    return keyed.select(
        *kept_names,
        F.when(F.col("_line_runs").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
        F.size(runs_).cast("long").alias("n_runs"),
    )
