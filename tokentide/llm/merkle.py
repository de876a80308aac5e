"""Merkle manifest of a dataset: a tree of digests for each source, one above their roots, and proofs of single rows.

A leaf is the digest of a row's fields. Leaves are numbered within their source by a sort over the whole table. A level
is a table of nodes (tree, place, digest), and one equijoin for each sibling brings the siblings together: a node of slot
s looks for the places of its run's other slots, the place XOR 1 in a binary tree. Rows of slot zero then emit the
parents. The siblings of a node are kept, so that a second pass, from the top down, hands every node the siblings above
it; that is its proof. Only digests move; texts are read once, where they lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.llm.common import materialise

#: Levels of at most so many nodes (some 100 bytes each) are joined by broadcast; paths above so few nodes too (some 2 KB each).
SMALL, SMALL_PATHS = 1 << 16, 1 << 13
NO_PATH = "cast(array() as array<struct<before: binary, after: binary>>)"


def digest(*parts: Column) -> Column:
    """H as hex text: sha256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(columns: list[str], replaced: dict[str, Column] | None = None) -> Column:
    """H of the columns, each as `-` if null, else its number of bytes, a colon and itself; `replaced` stands for columns."""
    parts = []
    for c in columns:
        text = (replaced or {}).get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-")))
    return digest(*parts)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows, written, with tree (number of the group's first row in the whole order), place in the group and size of the group.

    The whole table is sorted by group (null first) and order; what is added up over tasks is one row for each task and group.
    """
    dealt = rows.repartitionByRange(F.col(group).asc_nulls_first(), *order).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    at = F.monotonically_increasing_id()
    written = materialise(dealt.withColumns({"task": F.shiftright(at, 33), "row": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = materialise(written.groupBy("task", group).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row")))
    tasks = parts.groupBy("task").agg(F.sum("n").alias("n")).select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("ahead"))
    own = Window.partitionBy(group)
    named = parts.join(F.broadcast(tasks), "task").select(  # one row for each task
        F.col("task").alias("task_"), F.col(group).alias("group_"), F.min(F.col("ahead") + F.col("first_row")).over(own).alias("tree"), F.sum("n").over(own).alias("size"), "ahead",
    )
    joined = written.join(materialise(named), (F.col("task") == F.col("task_")) & F.col(group).eqNullSafe(F.col("group_")))
    return joined.select(*rows.columns, "tree", (F.col("ahead") + F.col("row") - F.col("tree")).alias("place"), "size")


def _level(nodes: DataFrame, arity: int, small: bool) -> DataFrame:
    """nodes(tree, place, size, hash) with before and after: the digests of its run's other nodes, left and right of it."""
    slot = F.col("place") % arity
    look = F.broadcast if small else (lambda df: df)
    found, left, right = nodes, [], []
    for k in range(1, arity):
        sibling = F.col("place").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("place") - slot + (slot + k) % arity
        other = look(nodes.select(F.col("tree").alias("tree_"), F.col("place").alias("place_"), F.col("hash").alias(f"sibling{k}")))
        found = found.withColumn("look_at", sibling).join(other, (F.col("tree") == F.col("tree_")) & (F.col("look_at") == F.col("place_")), "left").drop("tree_", "place_", "look_at")
        hers, none = F.col(f"sibling{k}"), F.lit(b"")
        is_left = (slot + k) % arity < slot
        left.append(F.coalesce(F.when(is_left, hers), none))
        right.append(F.coalesce(F.when(~is_left, hers), none))
    return found.select("tree", "place", "size", "hash", F.concat(*left).alias("before"), F.concat(*right).alias("after"))


def _levels(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], list[int]]:
    """All levels with their siblings, the leaves' first, and their numbers of nodes; a tree ends at its level of one node."""
    levels, counts = [], []
    sizes = nodes.where("place = 0").agg(F.sum("size").alias("n"), F.max("size").alias("most")).first()
    n, most = sizes["n"] or 0, sizes["most"] or 0
    while n:
        level = _level(nodes, arity, n <= SMALL) if most > 1 else nodes.select("*", F.lit(b"").alias("before"), F.lit(b"").alias("after"))
        level = materialise(level.coalesce(1) if n <= SMALL else level)
        levels.append(level)
        counts.append(n)
        if most <= 1:
            break
        parents = level.where(f"size > 1 and place % {arity} = 0")
        nodes = parents.select("tree", F.expr(f"place div {arity}").alias("place"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"), F.unhex(digest(_hex(F.col("hash")), _hex(F.col("after")))).alias("hash"))
        sizes = nodes.where("place = 0").agg(F.sum("size").alias("n"), F.max("size").alias("most")).first()
        n, most = sizes["n"] or 0, sizes["most"] or 0
    return levels, counts


def _tops(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [level.where("size = 1").select("tree", "hash") for level in levels])


def _paths(levels: list[DataFrame], counts: list[int], arity: int, above: DataFrame) -> DataFrame:
    """tree, place, hash and path of every leaf: the siblings from it up, then the path `above` (tree, path) of its tree's top."""
    paths = None
    for level, n in zip(reversed(levels), reversed(counts), strict=True):
        tops = level.where("size = 1").join(above, "tree").select("tree", "place", "hash", "path")
        if paths is None:
            now = tops
        else:
            up = paths.select(F.col("tree").alias("tree_"), F.col("place").alias("place_"), F.col("path").alias("higher"))
            own = F.array(F.struct("before", "after"))
            inner = level.where("size > 1").join(F.broadcast(up) if n <= SMALL_PATHS else up, (F.col("tree") == F.col("tree_")) & (F.expr(f"place div {arity}") == F.col("place_")))
            now = tops.unionByName(inner.select("tree", "place", "hash", F.concat(own, "higher").alias("path")))
        paths = now if level is levels[0] else materialise(now.coalesce(1) if n <= SMALL else now)
    return paths


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, start, lambda h, x: digest(_hex(x["before"]), h, _hex(x["after"])))


def proof_digest(path: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(_hex(x["before"]), _hex(x["after"]))), "").cast("binary"), 256)


def manifest(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "source", arity: int = 3, also: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root and path of every row; `also` adds columns that are computed where the row is read.

    path is the proof: the siblings before and after the row's node at each level, as raw digests, up to the group's
    subroot and on to the root; `folded` leads from a leaf over it to the root. Within a group rows go by key, a missing
    key last, and rows of one key by leaf: equal rows are exchangeable. A group of one row has its leaf as subroot, a
    table of one group that subroot as root; an empty table gives an empty result. A null group is one of its own and
    comes first. Texts of any length are hashed where they lie. Columns other than `columns` are ignored.
    """
    named = {f"also{k}": c for k, c in enumerate((also or {}).values())}
    rows = docs.select(F.col(key).alias("_key"), F.col(group).alias("_in"), F.unhex(leaf(columns)).alias("hash"), *(c.alias(k) for k, c in named.items()))
    leaves = materialise(numbered(rows, "_in", [F.col("_key").asc_nulls_last(), F.col("hash")]))
    levels, counts = _levels(leaves.select("tree", "place", "size", "hash"), arity)
    if not levels:
        path = F.expr(NO_PATH)
        return leaves.select(F.col("_key").alias(key), _hex(F.col("hash")).alias("leaf"), _hex(F.col("hash")).alias("subroot"), _hex(F.col("hash")).alias("root"), path.alias("path"), *(F.col(k).alias(c) for k, c in zip(named, also or {}, strict=True)))
    tops = materialise(_tops(levels))
    # trees have numbers in the order of their groups, so the upper tree needs no names
    upper = materialise(numbered(tops.select(F.lit(0).alias("all"), F.col("tree").alias("lower"), "hash"), "all", [F.col("lower")]))
    upper_levels, upper_counts = _levels(upper.select("tree", "place", "size", "hash"), arity)
    ends = _paths(upper_levels, upper_counts, arity, upper.select("tree").distinct().select("tree", F.expr(NO_PATH).alias("path")))
    root = _tops(upper_levels).select(F.col("hash").alias("root"))  # one row
    above = materialise(ends.join(upper.select("place", "lower"), "place").select(F.col("lower").alias("tree"), "path", F.col("hash").alias("subroot")))
    paths = _paths(levels, counts, arity, above.select("tree", "path"))
    data = leaves.drop("size", "hash").join(paths, ["tree", "place"]).join(above.select("tree", "subroot"), "tree").crossJoin(F.broadcast(root))
    return data.select(
        F.col("_key").alias(key), _hex(F.col("hash")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), "path", *(F.col(k).alias(c) for k, c in zip(named, also or {}, strict=True))
    )


def verified(found: DataFrame, given: str) -> DataFrame:
    """found with folded_root (from the leaf in column `given`, the row's own where that is null) and whether it is the root."""
    return found.withColumn("folded_root", folded(F.coalesce(given, "leaf"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))
