"""Contracts that are declared once and checked in as few passes as their rules allow.

Row rules (a condition of one row) are all counted in one scan of the table.  Rules about keys are gathered by key: one
grouping of a key's values tells whether they are unique, whether columns follow from them, and whether another
table has them, so that a key is shuffled once whatever number of rules it has.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.guards import union_all


@dataclass
class Contract:
    """Rules of a table by name.

    rows        condition of a row; one that is null counts as broken
    unique      columns that together stand once
    functional  (columns, column): rows that agree in the columns agree in the column
    foreign     (columns, table, its columns): the table has the columns' values; those that hold a null are left out
    """

    rows: dict[str, Column] = field(default_factory=dict)
    unique: dict[str, tuple[str, ...]] = field(default_factory=dict)
    functional: dict[str, tuple[tuple[str, ...], str]] = field(default_factory=dict)
    foreign: dict[str, tuple[tuple[str, ...], DataFrame, tuple[str, ...]]] = field(default_factory=dict)

    def keys(self) -> list[tuple[str, ...]]:
        found = [*self.unique.values(), *(k for k, _ in self.functional.values()), *(k for k, *_ in self.foreign.values())]
        return list(dict.fromkeys(found))


def _row_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations of all row rules, from one scan."""
    broken = {name: F.count_if(~F.coalesce(ok, F.lit(False))) for name, ok in rules.items()}
    counts = df.agg(*(count.alias(name) for name, count in broken.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules))
    return counts.select(F.explode(pairs).alias("x")).select("x.rule", "x.violations")


def _key_report(df: DataFrame, key: tuple[str, ...], contract: Contract) -> DataFrame:
    """rule, violations of all rules about one key, from one grouping by it.

    A repeated key, one with several values of a column, and one that another table lacks, count once each.
    """
    unique = [name for name, columns in contract.unique.items() if columns == key]
    follows = {name: column for name, (columns, column) in contract.functional.items() if columns == key}
    foreign = {name: (other, names) for name, (columns, other, names) in contract.foreign.items() if columns == key}
    names = [f"k{i}" for i in range(len(key))]
    values = {f"v{i}": F.col(column) for i, column in enumerate(dict.fromkeys(follows.values()))}
    at = {column: f"v{i}" for i, column in enumerate(dict.fromkeys(follows.values()))}
    own = df.select(*(F.col(c).alias(n) for c, n in zip(key, names, strict=True)), *(v.alias(n) for n, v in values.items()), F.lit(-1).alias("side"))
    sides = [own]
    for i, (other, columns) in enumerate(foreign.values()):
        there = other.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))).distinct()
        sides.append(there.select(*names, *(F.lit(None).alias(n) for n in values), F.lit(i).alias("side")))
    # nulls are a value of a column that follows, as any other is
    several = {c: (F.min(n) != F.max(n)) | ((F.count_if(F.col(n).isNull() & (F.col("side") < 0)) > 0) & (F.count(n) > 0)) for c, n in at.items()}
    found = union_all(*sides).groupBy(*names).agg(
        F.count_if(F.col("side") < 0).alias("own"),
        *(F.coalesce(test, F.lit(False)).alias(f"s{i}") for i, test in enumerate(several.values())),
        *(F.count_if(F.col("side") == i).alias(f"f{i}") for i in range(len(foreign))),
    )
    whole = reduce(Column.__and__, (F.col(n).isNotNull() for n in names))
    tests = {name: F.col("own") > 1 for name in unique}
    tests |= {name: F.col(f"s{list(at).index(column)}") for name, column in follows.items()}
    tests |= {name: whole & (F.col("own") > 0) & (F.col(f"f{i}") == 0) for i, name in enumerate(foreign)}
    return _row_report(found, {name: ~test for name, test in tests.items()})


def report(df: DataFrame, contract: Contract) -> DataFrame:
    """rule, violations: broken rows of row rules, and broken keys of the others; rules that hold have none."""
    parts = [_row_report(df, contract.rows)] if contract.rows else []
    parts += [_key_report(df, key, contract) for key in contract.keys()]
    if not parts:
        return df.sparkSession.createDataFrame([], "rule string, violations long")
    return union_all(*parts)


def enforced(df: DataFrame, contract: Contract) -> DataFrame:
    """df, if it keeps the contract; else ValueError with the rules that it breaks and how often."""
    broken = report(df, contract).where("violations > 0").orderBy("rule").collect()  # a row a rule
    if broken:
        raise ValueError("the contract is broken: " + ", ".join(f"{r.rule} {r.violations}" for r in broken))
    return df
