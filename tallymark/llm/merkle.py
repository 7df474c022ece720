"""Merkle manifest of a table: a digest for every row, one root, and the proof that leads from each row to it.

The rows of a group, in their order, are the leaves of the group's tree.  While a tree has more than
one node, every ``FAN_OUT`` consecutive nodes become their parent: the SHA-256 of their digests as
lowercase hex, one after the other (a shorter last run, even one node, has a parent too).  What is
left is the group's *subroot*; the subroots, in the order of their groups (null first, then by
bytes), are the leaves of the tree above, whose last node is the *root*.

How it is built.  Rows get their rank within the group from a range sort: a table of (group, task)
counts, a row for each group and task, gives each task's offset, so no group is ever in one task.  The rank's digits
to the base ``FAN_OUT`` are columns; those of a block of ``FAN_OUT ** DIGITS`` rows are grouped away
one after the other, each time into a list of structs that nests the list before it.  All of a block's
groupings need one shuffle, on the block.  A tier of blocks is written; its digests, far fewer, are the
nodes of the next tier, until each tree is one block.  Proofs run the other way: a ``transform`` over
a block's nested structs puts the way up from each node before the way up from its block, and ``explode``
makes rows.  Rows of the table are never joined for it; only blocks (one for 256 rows) meet their
way up by a join on the block.

A step of a proof is what stands to the left and to the right of the own digest in its run;
:func:`folded` hashes a leaf up to a root, :func:`siblings` lists the digests of all steps.

* nulls: ``-`` in a leaf (:func:`leaf_digest`), first in any order; a null group is a group of its own
* ties in the order go by leaf, then arbitrarily; equal rows get a leaf, a rank and a proof each
* an empty table gives no rows; one row is its own subroot and, if alone in the table, the root: its proof is empty
* empty and very long texts are hashed whole, like any other
* other columns are ignored, whatever their names
* a group, an order key or equal rows may be any share of the table: none of them is gathered
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.scratch import discard, fresh_path, written

FAN_OUT = 16
#: Levels of a tree in one block; a block holds at most ``FAN_OUT ** DIGITS`` nodes.
DIGITS = 2
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of a tree that holds as many rows as a long can count.
MOST_LEVELS = 16


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def siblings(path: Column) -> Column:
    """The digests beside the way, step by step, left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to by ``path``."""
    return F.aggregate(path, leaf, lambda up, s: F.sha2(F.concat(s["left"], up, s["right"]), 256))


def _grown(nodes: DataFrame, order: Sequence[str]) -> list[DataFrame]:
    """The tiers of the trees over ``nodes (tree, *order, digest, it)`` from the leaves up; in the last one, each tree is a single block."""
    spark = nodes.sparkSession
    paths = [fresh_path(spark, f"merkle-{name}") for name in ("leaves", "placed", "offsets")]
    tiers = [_tier(_ranked(nodes, order, *paths), 0)]
    for path in paths:  # the first tier holds all that they did
        discard(spark, path)
    height = tiers[0].agg(F.max("levels")).first()[0] or 0
    while len(tiers) * DIGITS < height:
        nodes = tiers[-1].select("tree", "levels", F.col("block").alias("at"), "digest", F.col("block").alias("it"))
        tiers.append(_tier(nodes, len(tiers) * DIGITS))
    return tiers


def _ranked(nodes: DataFrame, order: Sequence[str], leaves: str, placed_at: str, offsets_at: str) -> DataFrame:
    """``nodes`` as ``tree, levels, at, digest, it``: place in the tree and the tree's height."""
    # written first, so that the sampling of the range sort does not hash the table once more
    nodes = written(nodes, "", leaves)
    keys = ["tree", *order, "digest", "row"]
    dealt = nodes.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(dealt.select("tree", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), "digest", "it"), "", placed_at)
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy("tree", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    total = F.sum("n").over(tree)
    levels = sum((total > FAN_OUT**k).cast("int") for k in range(MOST_LEVELS))
    offsets = written(counts.select("tree", "task", (before - F.col("first")).alias("shift"), levels.alias("levels")), "", offsets_at)
    return placed.join(offsets, ["tree", "task"]).select("tree", "levels", (F.col("at") + F.col("shift")).alias("at"), "digest", "it")


def _tier(nodes: DataFrame, level: int) -> DataFrame:
    """``tree, levels, block, digest, below``: the nodes of each block, nested run by run."""
    digits = [F.expr(f"at div {FAN_OUT**k} % {FAN_OUT}").cast("int").alias(f"d{k}") for k in range(DIGITS)]
    block = F.expr(f"at div {FAN_OUT**DIGITS}").alias("block")
    nested = nodes.select("tree", "levels", block, *digits, "digest", F.col("it").alias("below")).repartition("tree", "block")
    for k in range(DIGITS):
        kept = ["tree", "levels", "block", *[f"d{j}" for j in range(k + 1, DIGITS)]]
        run = F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("place"), "digest", "below")))
        nested = nested.groupBy(*kept).agg(run.alias("below"))
        parent = F.sha2(F.array_join("below.digest", ""), 256)
        # a tree that is one node already goes through the levels above as it is
        nested = nested.withColumn("digest", F.when(F.col("levels") > level + k, parent).otherwise(F.col("below")[0]["digest"]))
    return written(nested.select("tree", "levels", "block", "digest", "below"), "merkle-tier")


def _ways(below: Column, above: Column, levels: Column, level: int, k: int = DIGITS - 1) -> Column:
    """``array<struct<it, digest, path>>`` of all nodes of a block, given the way up from the block."""
    run = F.array_join(below["digest"], "")

    def one(node: Column, i: Column) -> Column:
        step = F.struct(run.substr(F.lit(1), i * HEX).alias("left"), run.substr((i + 1) * HEX + 1, F.lit(FAN_OUT * HEX)).alias("right"))
        path = F.when(levels > level + k, F.concat(F.array(step), above)).otherwise(above)
        if k:
            return _ways(node["below"], path, levels, level, k - 1)
        return F.struct(node["below"].alias("it"), node["digest"].alias("digest"), path.alias("path"))

    ways = F.transform(below, one)
    return F.flatten(ways) if k else ways


def _descended(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``tree, subroot, root, it, digest, path`` of every leaf; ``tops (tree, subroot, root, path)`` has the way up from each tree."""
    ways = tops.withColumn("block", F.lit(0).cast("long"))
    for t in reversed(range(len(tiers))):
        each = _ways(F.col("below"), F.col("path"), F.col("levels"), t * DIGITS)
        nodes = tiers[t].select("tree", "block", "levels", "below").join(ways, ["tree", "block"])
        nodes = nodes.select("tree", "subroot", "root", F.explode(each).alias("node")).select("tree", "subroot", "root", "node.*")
        ways = nodes.select("tree", F.col("it").alias("block"), "subroot", "root", "path") if t else nodes
    return ways


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf", carry: Sequence[str] = ()) -> DataFrame:
    """``*order, *carry, leaf, subroot, root, path`` for every row.

    ``path`` is the proof: an array of ``struct<left, right>`` from the leaf's run to the root's.
    """
    # a prefix keeps null apart from every string, and before it in the order of bytes
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree")
    it = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate([*order, *carry])]).alias("it")
    keys = [f"k{i}" for i in range(len(order))]
    nodes = rows.select(tree, *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], F.col(leaf).alias("digest"), it)
    tiers = _grown(nodes, keys)

    groups = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("k0"), "digest", F.struct("tree", F.col("digest").alias("subroot")).alias("it"))
    over = _grown(groups, ["k0"])
    start = F.lit(None).cast("array<struct<left:string,right:string>>")
    root = over[-1].select("tree", F.lit("").alias("subroot"), F.col("digest").alias("root"), F.coalesce(start, F.array()).alias("path"))
    tops = _descended(over, root).select("it.tree", "it.subroot", "root", "path")

    out = _descended(tiers, tops)
    named = [F.col(f"it.c{i}").alias(c) for i, c in enumerate([*order, *carry])]
    return out.select(*named, F.col("digest").alias(leaf), "subroot", "root", "path")
