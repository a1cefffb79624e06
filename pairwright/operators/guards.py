"""Checks on keys.  Each gives the offending rows; strict() turns them into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand in more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def id_gaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: key, side."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer").where("_l is null or _r is null")
    return both.select(key, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))


def missing_from(needed: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys of needed that have lacks."""
    return needed.select(key).distinct().join(have.select(key), key, "left_anti")


def common(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides: empty if the sides are disjoint."""
    return left.select(key).intersect(right.select(key))


def strict(df: DataFrame, bad: DataFrame, message: str) -> DataFrame:
    """df, if bad is empty; else ValueError with the message and up to three offenders."""
    rows = bad.limit(3).collect()
    if rows:
        raise ValueError(f"{message}: {[tuple(r) for r in rows]}")
    return df


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df, failing at a row for which ok does not hold, in the same pass that uses the rows."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def violations(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that a row fails; a check that gives null fails."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks)))


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One-to-one join: both keys unique and the same on both sides, else ValueError."""
    for side, df in (("left", left), ("right", right)):
        strict(df, duplicates(df, key), f"{side} ids must be unique")
    strict(left, id_gaps(left, right, key), "ids must match exactly")
    return left.join(right, key)


def version_gaps(found: Column, wanted: dict[str, str]) -> Column:
    """Names whose recorded version (map<string,string>) is not the one wanted, or is missing."""
    return F.array_compact(F.array(*(F.when(~found[name].eqNullSafe(F.lit(version)), F.lit(name)) for name, version in sorted(wanted.items()))))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def leaks(rows: DataFrame, key: str | Column, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split."""
    named = key if isinstance(key, Column) else F.col(key)
    return rows.groupBy(named.alias("key")).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def outcome_diff(base: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Each key of either side as resolved (base only), new (candidate only) or persistent."""
    a, b = base.select(key).distinct().withColumn("_b", F.lit(True)), candidate.select(key).distinct().withColumn("_c", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_c").isNull(), "resolved").when(F.col("_b").isNull(), "new").otherwise("persistent").alias("outcome"))


def counted(df: DataFrame, key: str) -> DataFrame:
    """Rows by value of a column, by ascending value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(key)


def count_map(df: DataFrame, key: str) -> DataFrame:
    """One row: a key-sorted map of counts."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n"))))
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.map_from_entries(entries).alias("counts"))
