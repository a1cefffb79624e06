"""Merkle manifest of a table, with proofs by coordinates.

A leaf is the hash of a row's fields.  The leaves of a group (a source) stand in order, and every
FAN consecutive nodes of a level (the last run may be shorter, even a single one) become one node of
the next level, until one is left: the group's root.  The groups' roots are the leaves
of a tree of the same kind, whose root is the table's.  Every node has coordinates (tree, level,
number); trees are numbered as their groups are ordered, and the tree of roots is TOP.

The materialised node table is built bottom up, a block of FAN ** LEVELS nodes at a time, so that
the number of shuffles is that of levels divided by LEVELS and no task holds more than a block.  A proof is
looked up: from its number and its tree's size a leaf tells the coordinates of the siblings it needs, explodes
them, joins the node table and puts what it found in order.  That is done for LEVELS levels; above them
all leaves of a block share one path, which is looked up in the same way once for the block.

H of several parts is the lowercase hex SHA-256 of their concatenation; digests go in as hex text.

Defined cases: null fields are `-`, others their bytes' count, a colon and their value; rows without source
are a group of their own, the first one; rows without doc_id come first in their group; rows of one doc_id are ordered by
leaf, and equal rows are leaves of their own with equal proofs or such that only their places differ; empty
and very long texts are hashed like any others; a single row is a group's root and may be the
table's, with empty proofs; an empty table gives empty results; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import Stage, free_shuffles, table
from pairwright.operators.guards import union_all
from pairwright.operators.sampling import positions

FAN, LEVELS = 3, 6
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: No tree has more leaves than the last of these.
_POWERS = [FAN**k for k in range(39)]
_NO_PATH = "array<struct<before:binary,after:binary>>"


def spelled(value: Column) -> Column:
    """A field as it goes into a leaf."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hex_text(node: Column) -> Column:
    return F.lower(F.hex(node))


def leaf_of(*values: Column) -> Column:
    return digest(F.concat(*map(spelled, values)))


def levels_of(n: Column) -> Column:
    """How many levels are above a tree's n leaves."""
    return F.size(F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p < n))


# ------------------------------------------------------------------------------------- trees


def _parents(nodes: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(FAN))
    return F.transform(starts, lambda at: digest(F.array_join(F.transform(F.slice(nodes, at, F.lit(FAN)), hex_text), "")))


def grown(level: DataFrame, base: int) -> DataFrame:
    """tree, n, level, number, node of the next LEVELS levels over the nodes of level base (tree, n, number, node).

    Nothing is made over a level of one node.
    """
    held = F.transform(F.array_sort(F.collect_list(F.struct("number", "node"))), lambda x: x["node"])
    blocks = level.groupBy("tree", "n", F.floor(F.col("number") / FAN**LEVELS).alias("block")).agg(held.alias("l0"))


    def numbered(k: int) -> Column:
        first = F.col("block") * FAN ** (LEVELS - k)
        return F.transform(f"l{k}", lambda x, i: F.struct(F.lit(base + k).alias("level"), (first + i).alias("number"), x.alias("node")))

    for k in range(1, LEVELS + 1):
        wanted = levels_of(F.col("n")) >= base + k
        blocks = blocks.withColumn(f"l{k}", F.when(wanted, _parents(F.col(f"l{k - 1}"))).otherwise(F.array().cast("array<binary>")))
    made = [numbered(k) for k in range(1, LEVELS + 1)]
    return blocks.select("tree", "n", F.explode(F.concat(*made)).alias("x")).select("tree", "n", "x.level", "x.number", "x.node")


def _all_levels(leaves: DataFrame) -> list[Stage]:
    """The levels over leaves (tree, n, number, node), as they were written one block of levels after the other."""
    most, base, level, stages = leaves.agg(F.max("n")).first()[0] or 0, 0, leaves, []
    while FAN**base < most:
        stages.append(Stage(grown(level, base), "nodes"))
        base += LEVELS
        level = stages[-1].df.where(F.col("level") == base).select("tree", "n", "number", "node")
    return stages


@dataclass
class Manifest:
    """leaves: tree, n, number, node and what the rows had besides; trees: tree, n and the group; nodes: the table of all levels."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None
    stages: list[Stage] = field(default_factory=list)

    def drop(self) -> None:
        for stage in self.stages:
            stage.drop()


def manifest(rows: DataFrame, group: str, order: str) -> Manifest:
    """Trees over rows that have a leaf (binary); a row's other columns stay beside it."""
    kept = [Stage(rows, "hashed")]
    of_group = F.col(group).asc_nulls_first()
    placed = Stage(positions(kept[0].df, [of_group, F.col(order).asc_nulls_first(), F.col("leaf")], "_place"), "placed")
    sizes = placed.df.groupBy(group).agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
    trees = Stage(positions(sizes, [of_group], "tree"), "trees")
    by_group = trees.df.select(F.col(group).alias("_group"), "tree", "n", "_first")
    numbered = placed.df.join(by_group, F.col(group).eqNullSafe(F.col("_group"))).withColumn("number", F.col("_place") - F.col("_first"))
    leaves = Stage(numbered.withColumnRenamed("leaf", "node").drop("_group", "_place", "_first"), "leaves")
    kept[0].drop()
    placed.drop()
    kept = [trees, leaves]
    zero = leaves.df.select("tree", "n", F.lit(0).alias("level"), "number", "node")
    kept += (levels := _all_levels(zero.drop("level")))
    whole = union_all(zero, *(s.df for s in levels))
    count = trees.df.count()
    tops = whole.where(F.col("level") == levels_of(F.col("n"))).select(F.lit(TOP).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("number"), "node")
    kept.append(subroots := Stage(tops, "subroots"))
    kept += (above := _all_levels(subroots.df))
    nodes = union_all(whole, subroots.df.select("tree", "n", F.lit(0).alias("level"), "number", "node"), *(s.df for s in above))
    root = nodes.where((F.col("tree") == TOP) & (F.col("level") == levels_of(F.lit(count)))).select(hex_text(F.col("node"))).first()
    free_shuffles(rows.sparkSession)
    return Manifest(leaves.df, trees.df, nodes, subroots.df, root[0] if root else None, kept)


# ------------------------------------------------------------------------------------ proofs


def _coordinates(base: int) -> Column:
    """Of a node (n, number) of level base: level, number and side of every sibling on its way up, for LEVELS levels."""
    top = F.least(levels_of(F.col("n")), F.lit(base + LEVELS))

    def siblings(level: Column) -> Column:
        power = F.element_at(F.array(*map(F.lit, _POWERS)), level + 1)
        own = F.floor(F.col("number") / F.element_at(F.array(*map(F.lit, _POWERS)), level - base + 1))
        first, last = own - own % FAN, F.floor((F.col("n") - 1) / power)  # of the run, and of the level
        others = F.filter(F.sequence(first, F.least(first + FAN - 1, last)), lambda x: x != own)
        return F.transform(others, lambda x: F.struct(level.alias("level"), x.alias("sibling"), (x < own).alias("before")))

    return F.when(top > base, F.flatten(F.transform(F.sequence(F.lit(base), top - 1), siblings)))


def _looked_up(rows: DataFrame, nodes: DataFrame, base: int) -> DataFrame:
    """tree, number, path: the siblings of each node of level base (tree, n, number), level by level."""
    wanted = rows.select("tree", "n", "number", F.explode_outer(_coordinates(base)).alias("c")).select("tree", "n", "number", "c.level", "c.sibling", "c.before")
    have = nodes.where(F.col("level").between(base, base + LEVELS - 1)).select("tree", "level", F.col("number").alias("sibling"), "node")
    met = wanted.join(have, ["tree", "level", "sibling"], "left")
    found = F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("level", "sibling", "before", "node"))))
    held = met.groupBy("tree", "n", "number").agg(found.alias("found"))
    top = F.least(levels_of(F.col("n")), F.lit(base + LEVELS))

    def together(level: Column, before: bool) -> Column:
        side = F.filter("found", lambda x: (x["level"] == level) & (x["before"] == before))
        return F.reduce(side, F.lit(b""), lambda all_, x: F.concat(all_, x["node"]))

    step = lambda level: F.struct(together(level, True).alias("before"), together(level, False).alias("after"))
    path = F.when(top > base, F.transform(F.sequence(F.lit(base), top - 1), step)).otherwise(F.array().cast(_NO_PATH))
    return held.select("tree", "number", path.alias("path"))


def _paths(rows: DataFrame, nodes: DataFrame, most: int, after: DataFrame | None, kept: list[Stage]) -> DataFrame:
    """tree, number, path up to the root of the tree, and on along `after` (tree, path), of rows (tree, n, number)."""
    above = None
    for base in reversed(range(0, max(1, len([p for p in _POWERS if p < most])), LEVELS)):
        at = rows if not base else nodes.where((F.col("level") == base) & (levels_of(F.col("n")) > base)).select("tree", "n", "number")
        found = _looked_up(at, nodes, base)
        parts = [F.col("path")]
        if above is not None:
            higher = above.select("tree", F.col("number").alias("_block"), F.col("path").alias("_above"))
            found = found.withColumn("_block", F.floor(F.col("number") / FAN**LEVELS)).join(higher, ["tree", "_block"], "left")
            parts.append(F.col("_above"))
        if after is not None:
            found = found.join(after.select("tree", F.col("path").alias("_after")), "tree", "left")
        rest = F.coalesce(*([F.col("_above")] if above is not None else []), *([F.col("_after")] if after is not None else []), F.array().cast(_NO_PATH))
        found = found.select("tree", "number", F.concat("path", rest).alias("path"))
        if base:
            kept.append(stage := Stage(found, "paths"))
            above = stage.df
    return found


def proofs(m: Manifest) -> DataFrame:
    """The leaves with their paths to the table's root: an array of (before, after), the siblings' digests one after the other."""
    sizes = [df.agg(F.max("n")).first()[0] or 0 for df in (m.subroots, m.trees)]
    top = Stage(_paths(m.subroots.select("tree", "n", "number"), m.nodes.where(F.col("tree") == TOP), sizes[0], None, m.stages), "paths")
    m.stages.append(top)
    after = top.df.select(F.col("number").alias("tree"), "path")
    found = _paths(m.leaves.select("tree", "n", "number"), m.nodes.where(F.col("tree") != TOP), sizes[1], after, m.stages)
    return m.leaves.join(found, ["tree", "number"])


def siblings_text(path: Column) -> Column:
    """All siblings of a path as hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(hex_text(p["before"]), hex_text(p["after"]))), "")


def folded(node: Column, path: Column) -> Column:
    """The root (hex) that a node and the siblings of its path give."""
    return F.reduce(path, hex_text(node), lambda own, p: F.sha2(F.concat(hex_text(p["before"]), own, hex_text(p["after"])), 256))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fields = [F.col(c) for c in FIELDS]
    shorn = leaf_of(*fields[:-1], F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, shorn)
    m = manifest(docs.select("doc_id", "source", leaf_of(*fields).alias("leaf"), tampered.alias("tampered")), "source", "doc_id")
    roots = m.subroots.select(F.col("number").alias("tree"), hex_text(F.col("node")).alias("subroot"))
    shown = proofs(m).join(roots, "tree").select(
        "doc_id", hex_text(F.col("node")).alias("leaf"), "subroot", F.lit(m.root).alias("root"), F.sha2(siblings_text(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "node"), F.col("path")).alias("folded_root"),
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
