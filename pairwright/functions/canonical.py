"""Canonical JSON and content hashes."""

from __future__ import annotations

import hashlib
import json
import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.udf import vectorized


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces; raises ValueError for non-finite numbers."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def finite_error(value: object, at: str = "value") -> str | None:
    """Where the first non-finite number is, as a message; None if there is none."""
    if isinstance(value, float) and not math.isfinite(value):
        return f"{at} contains a non-finite number"
    children = ()
    if isinstance(value, dict):
        children = ((f"{at}.{k}", v) for k, v in value.items())
    elif isinstance(value, list):
        children = ((f"{at}[{i}]", v) for i, v in enumerate(value))
    return next((e for e in (finite_error(v, where) for where, v in children) if e), None)


@vectorized("string")
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical form of JSON text (Spark's own form spells floats differently); null for bad JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


def json_string(text: Column) -> Column:
    """A string as a JSON literal."""
    return F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def sha256_of_string(text: Column) -> Column:
    """Hash of a string as a JSON value, that is with its quotes."""
    return F.sha2(json_string(text), 256)


def sha256_of_json(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


#: JSON that Spark spells as Python does: no escapes, no fractions or exponents, no integers of over 18 digits, none of Python's NaN and Infinity.
_PLAIN = r"\\|[0-9][.eE]|[0-9]{19}|NaN|Infinity|-0"


def plain_json(text: Column) -> Column:
    """Whether a text is JSON whose canonical form the JVM can give: VARIANT sorts keys, and spells what is left after _PLAIN as Python does."""
    ascii_only = ~F.regexp_like(text, F.lit(r"[^\x20-\x7e\s]"))  # keys of other letters are sorted in another order
    return ascii_only & ~F.regexp_like(text, F.lit(_PLAIN)) & F.try_parse_json(text).isNotNull()


def canonical_hashes(df: DataFrame, column: str, out: str) -> DataFrame:
    """df without its JSON text, but with the hash of the canonical form: null for bad JSON.

    Rows are split by a filter, so that only those whose numbers or strings Spark spells otherwise go through Python.
    """
    kept = [c for c in df.columns if c != column]
    marked = df.withColumn("_plain", F.coalesce(plain_json(F.col(column)), F.lit(False)))
    fast = marked.where("_plain").select(*kept, F.sha2(F.to_json(F.parse_json(F.col(column))), 256).alias(out))
    return fast.unionByName(marked.where("not _plain").select(*kept, sha256_of_json(F.col(column)).alias(out)))


def tokenizer_identity(kind: Column, template: Column, end_id: Column) -> Column:
    """Hash of what tells tokenizers apart: class, chat template (or null) and end id (or null), as canonical JSON."""
    text = lambda c: F.coalesce(json_string(c), F.lit("null"))
    parts = (F.lit('{"chat_template":'), text(template), F.lit(',"class":'), text(kind), F.lit(',"eos_token_id":'), F.coalesce(end_id.cast("string"), F.lit("null")), F.lit("}"))
    return F.sha2(F.concat(*parts), 256)


#: Digests that one task of a tree takes together.
TREE_WIDTH = 1000


def tree_digest(df: DataFrame, by: list[str], value: Column, order: list[Column], out: str, width: int = TREE_WIDTH) -> DataFrame:
    """One digest for each group: of all its values (JSON text) in order, by a tree as deep as the group needs.

    A node is the hash of the JSON list of up to `width` consecutive values, and above them of nodes, until a group has one
    node; so no task holds more than `width` of them, however many rows a group has.  A group of up to `width` values has the hash of
    the list of its values.  Equal orders must have equal values.
    """
    from pairwright.operators.sampling import positions
    from pairwright.staging import Stage

    keyed = df.select(*by, value.alias("_value"), *(o.alias(f"_o{i}") for i, o in enumerate(order)))
    keys = [*(F.col(c).asc_nulls_first() for c in by), *(F.col(f"_o{i}").asc_nulls_first() for i in range(len(order)))]
    placed = positions(keyed, keys, "_place")
    first = placed.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by))).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)), F.lit(True))
    joined = placed.join(first, same) if by else placed.join(F.broadcast(first))  # without groups it is one row
    level = joined.select(*by, "_n", (F.col("_place") - F.col("_first")).alias("_at"), "_value")
    most, stages = None, []
    while most is None or most > 1:
        node = json_string(F.col("_node"))
        if stages:  # groups of one node are done and are handed on as they are
            level = level.select(*by, "_n", "_at", node.alias("_value"))
        nodes = level.groupBy(*by, "_n", F.floor(F.col("_at") / width).alias("_up")).agg(ordered_digest(F.col("_value"), F.col("_at")).alias("_hash"), F.first("_value").alias("_only"))
        done = (F.col("_n") == 1) & F.lit(bool(stages))
        made = nodes.select(*by, F.ceil(F.col("_n") / width).alias("_n"), F.col("_up").alias("_at"), F.when(done, F.substring("_only", F.lit(2), F.length("_only") - 2)).otherwise(F.col("_hash")).alias("_node"))
        stages.append(Stage(made, "digests"))
        level = stages[-1].df
        most = level.agg(F.max("_n")).first()[0] or 0
    for stage in stages[:-1]:
        stage.drop()
    return level.select(*by, F.col("_node").alias(out))


def content_hash(df: DataFrame, column: str) -> str:
    """Hash of all values of a column in whatever order they lie: of the tree over their sorted hashes."""
    hashes = df.select(F.sha2(column, 256).alias("h"))
    found = tree_digest(hashes, [], json_string(F.col("h")), [F.col("h")], "d").first()
    return found.d if found else digest([])


def ordered_digest(value: Column, order: Column) -> Column:
    """Aggregate: hash of the JSON list of all values (JSON text) by ascending order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["v"]), ","), F.lit("]")), 256)
