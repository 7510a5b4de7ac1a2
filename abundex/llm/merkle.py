"""A Merkle manifest of a table: leaf digests, roots, and a proof for every row.

Rows are leaves; the leaves of a group are ordered and every eight nodes that follow each other
become one, until one remains; the groups' roots make the top tree in the same way.

The rank of a leaf, written in base eight, names its place on every level. Leaves are dealt out by
group and block of 4,096 ranks; in a block the rank's digits are grouped away one after another,
each grouping nesting the children as structs into their parent, so a block becomes one row. Its
digest is a leaf of the next round, until a group is one row. Proofs are made on the way down: what
stands beside a node is taken from the nested struct by a transform, and exploding the struct hands
it on to the children. A block meets the path above it in a grouping by its key; nothing is joined.

A block holds at most 4,096 nodes whatever a group's share of the rows; the only step that sees a
whole group is the running count of its rows per sorted partition, a row per partition. All is done
by built-in functions.

Defined results: a null value counts as ``-``, null ids come first and a null group is a group, the
first one; rows with one id are ordered by digest; a repeated row is a leaf of its own; a lone leaf
is its group's root and a lone group's root the root; an empty table gives an empty result; other
columns do not matter; texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundex.llm.common import written

# Bits of a rank digit: runs of eight; and digits in a block.
_BITS = 3
_DIGITS = 4
# Sorted rows with equal keys may go to different partitions.
_SALTS = 1024


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A value with its length in bytes, a null as ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def height(n: Column) -> Column:
    """Levels above ``n`` nodes: the base-eight digits of the last rank."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, 1 << _BITS)))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` in ``tree``, from 0, and the ``height`` of the tree; nulls come first."""
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The id counts on inside a partition, and its upper bits number the partitions in order.
    placed = written(sorted_.withColumn("at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    mine = Window.partitionBy(tree)
    before = F.sum("n").over(mine.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        F.col(tree).alias("_tree"),
        F.col("part").alias("_part"),
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        height(F.sum("n").over(mine)).alias("height"),
    )
    met = placed.join(runs, placed[tree].eqNullSafe(runs["_tree"]) & (placed["part"] == runs["_part"]))
    return met.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift", "_tree", "_part")


def roll(nodes: DataFrame, below: int) -> DataFrame:
    """Blocks (tree, block, height, digest, kids) of nodes (tree, rank, height, digest, load) on level ``below``."""
    digits = [f"d{i}" for i in range(_DIGITS)]
    df = nodes.select(
        "tree",
        F.shiftright("rank", _BITS * _DIGITS).alias("block"),
        *[
            F.shiftright("rank", _BITS * i).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int").alias(d)
            for i, d in enumerate(digits)
        ],
        "height",
        "digest",
        F.col("load").alias("kids"),
    ).repartition("tree", "block")
    for i, digit in enumerate(digits):
        keys = ["tree", "block", *digits[i + 1 :]]
        kids = F.array_sort(F.collect_list(F.struct(digit, "digest", "kids")))
        df = df.groupBy(*keys).agg(F.max("height").alias("height"), kids.alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: k["digest"]), "")
        # Above a tree's height there is one node, which stays as it is.
        up = F.when(F.col("height") > below + i, F.sha2(joined, 256)).otherwise(F.get("kids", F.lit(0))["digest"])
        df = df.withColumn("digest", up)
    return df


def unroll(blocks: DataFrame, below: int) -> DataFrame:
    """The nodes (tree, digest, load, path, info) of ``blocks`` with ``path`` and ``info`` from above.

    A path has, from the leaf up, what stands left and right of a node on each level.
    """

    def others(start: Column, length: Column) -> Column:
        return F.array_join(F.transform(F.slice("kids", start, length), lambda k: k["digest"]), "")

    def with_path(kid: Column, i: Column) -> Column:
        step = F.struct(
            others(F.lit(1), i).alias("left"), others(i + 2, F.greatest(F.size("kids") - i - 1, F.lit(0))).alias("right")
        )
        path = F.when(F.col("height") > level, F.concat(F.array(step), "path")).otherwise(F.col("path"))
        return F.struct(kid["digest"].alias("digest"), kid["kids"].alias("kids"), path.alias("path"))

    df = blocks.select("tree", "height", "kids", "path", "info")
    for level in reversed(range(below, below + _DIGITS)):
        df = df.select("tree", "height", "info", F.explode(F.transform("kids", with_path)).alias("kid"))
        df = df.select("tree", "height", "info", "kid.*")
    return df.select("tree", "digest", F.col("kids").alias("load"), "path", "info")


def build(nodes: DataFrame, highest: int) -> list[DataFrame]:
    """Blocks of every round, written; the last has a row per tree, whose digest is the tree's root."""
    rounds, below = [], 0
    while not rounds or below < highest:
        rounds.append(written(roll(nodes, below), "blocks"))
        below += _DIGITS
        nodes = rounds[-1].select(
            "tree", F.col("block").alias("rank"), "height", "digest", F.struct("block").alias("load")
        )
    return rounds


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves of ``rounds`` with their paths; ``tops`` has (tree, path, info) from above the trees' roots."""
    above = tops.select("tree", F.lit(0).cast("long").alias("block"), "path", "info")
    for number in reversed(range(len(rounds))):
        both = rounds[number].drop("digest").unionByName(above, allowMissingColumns=True)
        firsts = [F.first(c, ignorenulls=True).alias(c) for c in ("height", "kids", "path", "info")]
        nodes = unroll(both.groupBy("tree", "block").agg(*firsts), number * _DIGITS)
        if number:
            above = nodes.select("tree", F.col("load.block").alias("block"), "path", "info")
    return nodes


def manifest(
    rows: DataFrame, id_: str, group: str, columns: list[str], found: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row: id, group, ``leaf``, ``subroot``, ``root``, ``path``, and ``found_leaf``.

    A leaf covers ``columns``; ``found`` replaces some of them for ``found_leaf``, the digest of the
    row as it is found later (null where it is null for every replaced column).
    """
    later = None
    if found:
        changed = F.coalesce(*[F.isnotnull(v) for v in found.values()])
        later = F.when(changed, digest(*[encoded(F.coalesce(found[c], F.col(c)) if c in found else F.col(c)) for c in columns]))
    leaves = rows.select(
        F.col(id_).alias("id"),
        F.col(group).alias("tree"),
        digest(*[encoded(F.col(c)) for c in columns]).alias("digest"),
        (F.lit(None).cast("string") if later is None else later).alias("found_leaf"),
        F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).alias("salt"),
    )
    leaves = ranked(written(leaves, "leaves"), "tree", ["id", "digest", "salt"])
    nodes = leaves.select("tree", "rank", "height", "digest", F.struct("id", "found_leaf").alias("load"))
    rounds = build(nodes, leaves.agg(F.max("height")).first()[0] or 0)

    subroots = rounds[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("group"), "digest")
    subroots = ranked(subroots, "tree", ["group"])
    nodes = subroots.select("tree", "rank", "height", "digest", F.struct("group").alias("load"))
    top = build(nodes, subroots.agg(F.max("height")).first()[0] or 0)

    no_path = F.array().cast("array<struct<left:string,right:string>>")
    tops = top[-1].select("tree", no_path.alias("path"), F.col("digest").alias("info"))
    groups = descend(top, tops).select(
        F.col("load.group").alias("tree"), "path", F.struct(F.col("info").alias("root"), F.col("digest").alias("subroot")).alias("info")
    )
    return descend(rounds, groups).select(
        F.col("load.id").alias(id_),
        F.col("tree").alias(group),
        F.col("digest").alias("leaf"),
        "info.subroot",
        "info.root",
        "path",
        "load.found_leaf",
    )


def siblings(path: Column) -> Column:
    """All digests beside a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the digests beside its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))
