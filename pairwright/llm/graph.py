"""Connected components by alternating large and small stars, checkpointed every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import Stage, free_shuffles


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (least node reachable) of every node that has an edge in edges (a, b: long).

    A star's centre may have any number of edges: minima are taken with partial aggregation, and
    only the join that brings them back reads all edges of a node, which Spark may split.
    """
    now = Stage(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now.df)
    for _ in range(max_rounds):
        large = _large_star(now.df)
        after = Stage(_small_star(large), "edges")
        now.drop()
        now, before, mark = after, mark, _mark(after.df)
        free_shuffles(now.spark)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components are not stable after {max_rounds} rounds")
    roots = now.df.select(F.col("b").alias("node")).distinct()
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _brought_back(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges joined with the minimum m of their node a.

    Minima come dealt by a, as they were summed; dealt anew for the join, both sides are plain
    exchanges, of which Spark may split the one that holds a hot node's edges.
    """
    again = least.select(F.col("a").bitwiseXOR(F.lit(0)).alias("a"), "m")
    return edges.join(again, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node is joined to the least node about it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _brought_back(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and all its lesser neighbours are joined to the least of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    others = _brought_back(edges, least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return own.unionByName(others).distinct()
