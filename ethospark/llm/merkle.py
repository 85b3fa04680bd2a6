"""Merkle manifest: a hash tree over the rows of a table, per group and over all groups.

Rows are leaves; H is the lowercase hex SHA-256 of its inputs one after the other. Per group, leaves
stand in order; every two consecutive nodes become their H (a last single one the H of itself) until one
remains, the subroot; the subroots, in order of their groups, give the root in the same way.

Method: a block of ``2**HEIGHT`` leaves is one window ordered by rank. A node is kept on the row of
its first leaf, so at level l the sibling is ``2**l`` rows behind or ahead: fixed-offset ``lag`` and
``lead`` columns, masked by the row's slot and by the number of nodes left in the group, supply the
siblings, and rows of first children hash the parents. The siblings of a leaf are the last ones given
at or before its row. Block roots are the leaves of the next layer; a layer multiplies what a tree holds
by ``2**HEIGHT``, so three or four do for any table.

Scale: texts are read once and only digests move. Ranks come from a range partitioning by (group,
order) with one count per part and group, so a group with a third of all rows is spread over parts and
blocks; no window is larger than a part or a block, except the running sum of the counts: one row per part. The
blocks of a layer are joined with the layer above by block, and the leaves' side keeps its
partitioning. Only DataFrame functions.

Defined cases: null values are leaves' ``-``, so rows with nulls have distinct digests from those with
empty texts; the null group is first; null order keys are first. Rows equal in group and order key follow the
digest of the leaf; equal rows are equal leaves, each in its own place. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.llm.common import stored

HEIGHT = 10


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """H of the values, each as its number of UTF-8 bytes, a colon and itself; null is a dash."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(part, values))


def _key(group: str) -> Column:
    """A group as a key that is never null; the null group is first, others keep their bytewise order."""
    return F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` plus ``rank`` (0-based, in its group) and ``total`` (nodes of the group)."""
    keys = [F.col("group"), *[F.col(c).asc_nulls_first() for c in order]]
    # the last key only spreads rows that are equal in all others
    parted = stored(nodes.repartitionByRange(*keys, F.rand(0)).withColumn("part", F.spark_partition_id()), "merkle-nodes")
    counts = parted.groupBy("group", "part").agg(F.count("*").alias("n"))
    by_group = Window.partitionBy("group")
    counts = counts.select(
        "group", "part", (F.sum("n").over(by_group.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(by_group).alias("total"),
    )
    in_part = Window.partitionBy("group", "part").orderBy(*keys[1:])
    numbered = parted.withColumn("i", F.row_number().over(in_part) - 1).join(counts, ["group", "part"])
    return numbered.withColumn("rank", F.col("before") + F.col("i")).drop("part", "i", "before")


def layer(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``nodes`` (group, rank, total, node) plus ``block``, ``top`` (the node of the block, on its first
    row) and ``path``: [(sibling or '', on the left)] for each level where the group still has several nodes."""
    nodes = nodes.withColumn("block", F.shiftright("rank", height))
    in_order = Window.partitionBy("group", "block").orderBy("rank")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made, path = nodes.withColumn("n0", F.col("node")), []
    for level in range(height):
        step, node = 1 << level, F.col(f"n{level}")
        several = F.col("total") > step
        first = F.col("rank").bitwiseAND(F.lit(step - 1).cast("long")) == 0  # rows that hold a node of this level
        second = F.col("rank").bitwiseAND(F.lit(step).cast("long")) != 0  # its slot
        ahead, behind = F.lead(node, step).over(in_order), F.lag(node, step).over(in_order)
        made = made.withColumn(f"s{level}", F.when(first, F.coalesce(F.when(second, behind).otherwise(ahead), F.lit(""))))
        parent = F.when(several, digest(node, F.col(f"s{level}"))).otherwise(node)
        made = made.withColumn(f"n{level + 1}", F.when(first & ~second, parent))
        near = F.last(f"s{level}", ignorenulls=True).over(so_far)
        path.append(F.when(several, F.struct(near.alias("sibling"), second.alias("left"))))
    levels = F.filter(F.array(*path), lambda x: x.isNotNull())
    return made.select(*nodes.columns, F.col(f"n{height}").alias("top"), levels.alias("path"))


def _climb(nodes: DataFrame, most: int, height: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` with path, subroot and root. ``finish`` is given the subroots, one row per group."""
    if most <= 1:
        return finish(nodes.withColumn("subroot", F.col("node")))
    own = layer(nodes, height)
    blocks = own.filter(F.col("top").isNotNull()).select(
        "group", F.col("block").alias("rank"), F.ceil(F.col("total") / (1 << height)).alias("total"), F.col("top").alias("node")
    )
    above = _climb(stored(blocks, "merkle-blocks"), ceil(most / (1 << height)), height, finish)
    above = above.select("group", F.col("rank").alias("block"), F.col("path").alias("rest"), "subroot", "root")
    return own.join(above, ["group", "block"]).withColumn("path", F.concat("path", "rest")).drop("block", "top", "rest")


def _tree(nodes: DataFrame, order: list[str], height: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    places = ranked(nodes, order)
    most = places.agg(F.max("total")).first()[0] or 0
    return _climb(places, most, height, finish).drop("rank", "total")


def merkle_tree(leaves: DataFrame, group: str, order: list[str], height: int = HEIGHT) -> DataFrame:
    """``leaves`` plus ``subroot`` (of the group), ``root`` and ``path`` from the leaf to the root.

    ``leaves`` has a column ``node``, the digests; its other columns pass through, but for those named as the new ones."""
    def over_groups(subroots: DataFrame) -> DataFrame:
        kept = stored(subroots, "merkle-subroots")
        tops = kept.select(F.lit("").alias("group"), F.col("group").alias("name"), "node")
        top = _tree(tops, ["name"], height, lambda one: one.withColumns({"root": F.col("node"), "path": _no_path()}))
        return kept.join(top.select(F.col("name").alias("group"), "path", "root"), "group")

    keys = [f"o{k}" for k in range(len(order))]
    own = leaves.select(
        F.struct(*[leaves[c] for c in leaves.columns]).alias("row"), _key(group).alias("group"),
        *[F.col(c).alias(k) for c, k in zip(order, keys)], "node",
    )
    tree = _tree(own, [*keys, "node"], height, over_groups)
    kept = [F.col("row").getField(c).alias(c) for c in leaves.columns if c not in ("subroot", "root", "path")]
    return tree.select(*kept, "subroot", "root", "path")


def _no_path() -> Column:
    return F.array().cast("array<struct<sibling:string,left:boolean>>")


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    def step(hash_: Column, x: Column) -> Column:
        return F.when(x.left, digest(x.sibling, hash_)).otherwise(digest(hash_, x.sibling))

    return F.aggregate(path, node, step)


def siblings(path: Column) -> Column:
    """The siblings of a path, one after the other."""
    return F.array_join(F.transform(path, lambda x: x.sibling), "")
