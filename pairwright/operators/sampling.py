"""Deterministic selections: ranks within strata, round robin, first of each class, cycles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.canonical import sha256_of_string
from pairwright.functions.text import pair_of, stratum_of, variant_of
from pairwright.operators.guards import strict
from pairwright.staging import Stage


def balanced(df: DataFrame, cells: list[str], key: Column, per_cell: int) -> DataFrame:
    """The first per_cell rows of every cell by the hash of a key (a JSON string), in the order of that hash.

    ValueError if a cell has fewer.  A cell's rows are ranked with a bound, so Spark keeps per_cell of them.
    """
    ranked = df.withColumn("_hash", sha256_of_string(key))
    small = ranked.groupBy(*cells).agg(F.count("*").alias("n")).where(F.col("n") < per_cell)
    strict(df, small, "not enough rows for a cell")
    rank = F.row_number().over(Window.partitionBy(*cells).orderBy("_hash"))
    return ranked.withColumn("_rank", rank).where(F.col("_rank") <= per_cell).orderBy("_hash").drop("_hash", "_rank")


def round_robin(df: DataFrame, strata: list[str], key: str, limit: int) -> DataFrame:
    """limit rows, taking each stratum's next one (by key) in turn, strata in ascending order."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(key))
    return df.withColumn("_turn", turn).where(F.col("_turn") <= limit).orderBy("_turn", *strata).limit(limit).drop("_turn")


def balanced_pairs(examples: DataFrame, limit: int | None) -> DataFrame:
    """Complete pairs of examples (id, task_id), round robin over domain and class, in order of id.

    All of them if there are no more than limit; ValueError for an odd limit, broken pairs, or ids without a stratum.
    """
    if limit is None or examples.count() <= limit:
        return examples.orderBy("id")
    if limit % 2:
        raise ValueError("balanced limits must contain complete pairs")
    rows = examples.withColumns({"_pair": pair_of(F.col("task_id")), "_side": variant_of(F.col("task_id"))})
    pairs = rows.groupBy("_pair").agg(F.count("*").alias("n"), F.count_distinct("_side").alias("s")).withColumn("_stratum", stratum_of(F.col("_pair")))
    strict(rows, rows.where("_side = ''").select("task_id"), "invalid task variant")
    strict(rows, pairs.where("n != 2 or s != 2").select("_pair"), "selection requires complete unique pairs")
    strict(rows, pairs.where("_stratum is null").select("_pair"), "cannot derive domain and class")
    flat = pairs.select("_pair", F.col("_stratum.domain").alias("_d"), F.col("_stratum.label").alias("_l"))
    chosen = round_robin(flat, ["_d", "_l"], "_pair", limit // 2)
    if chosen.count() < limit // 2:
        raise ValueError("not enough complete pairs for requested limit")
    return rows.join(chosen.select("_pair"), "_pair", "left_semi").drop("_pair", "_side").orderBy("id")


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The earliest row of each value of a key, by order (ties by all columns of the struct)."""
    whole = F.struct(order, *(c for c in df.columns if c != order))
    return df.groupBy(F.col(key).alias("_k")).agg(F.min(whole).alias("w")).select(*(F.col(f"w.{c}").alias(c) for c in df.columns)).orderBy(order)


def smoke_pairs(tasks: DataFrame, order: str = "ord") -> DataFrame:
    """The first complete pair of each abstention class in file order; ValueError if a class has none."""
    sides = tasks.groupBy("pair_id").agg(F.count_distinct("variant").alias("v"), F.min(order).alias("_first"), F.max(F.when(F.col("variant") == "abstain", F.col("label"))).alias("_label"))
    chosen = first_of_each(sides.where("v = 2").select("pair_id", "_first", "_label"), "_label", "_first")
    if chosen.where("_label in ('ANSWER','CLARIFY','REFUSE','NOOP')").count() != 4:
        raise ValueError("a class has no complete pair")
    return tasks.join(chosen.select("pair_id", "_first"), "pair_id").orderBy("_first", order).drop("_first")


def positions(df: DataFrame, key: str | list[Column], out: str = "position", start: int = 0) -> DataFrame:
    """Place of every row by key (or several ones).  No task sorts all rows: ranges of keys are sorted and their rows counted first.

    The sorted ranges are written once and read again, as ranges that are computed twice may differ.
    """
    number = F.monotonically_increasing_id()  # range in the upper bits, place in it in the lower 33
    keys = [key] if isinstance(key, str) else key
    ranged = Stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", number), "positions").df
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    placed = ranged.join(F.broadcast(totals), F.shiftright("_id", 33) == F.col("_part"))  # one row a range
    return placed.withColumn(out, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + start).drop("_part", "_id", "_before")


def numbered(df: DataFrame, key: str, pattern: str = "audit-%03d") -> DataFrame:
    return positions(df, key, "_n", 1).withColumn("audit_id", F.format_string(pattern, F.col("_n"))).drop("_n")


def conflicting_first(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows whose value differs from the first one seen under their key."""
    first = df.groupBy(key).agg(F.min_by(value, order).alias("_first"))
    return df.join(first, key).where(~F.col(value).eqNullSafe(F.col("_first"))).drop("_first")


def cycled(order: list[int], steps: int, spark) -> DataFrame:  # noqa: ANN001
    """step (from 1) and the entry of a given permutation that it uses, around and around."""
    entries = spark.createDataFrame(list(enumerate(order)), "_at long, item long")
    return spark.range(1, steps + 1).select(F.col("id").alias("step"), F.pmod(F.col("id") - 1, F.lit(len(order))).alias("_at")).join(entries, "_at").select("step", "item")


#: Rounds of the permutation (an even number, so that the digits end where they began), and times that it is applied at most until it stays below n (see permuted).
ROUNDS, WALK = 4, 65


def permuted(place: Column, n: int, key: str | Column) -> Column:
    """Where a keyed permutation of 0..n-1 takes a place: a Feistel network on a x b >= n places, walked until it stays below n.

    A place is split into one digit below a and one below b; each round adds a hash of one digit to the other one.  At most a - 1
    of the a x b places are n or more, so a walk rarely takes a second step; none takes more than a, and for large n one of WALK
    steps has a probability of n ** -(WALK / 2), where it is an error.
    """
    a = math.isqrt(max(n - 1, 0)) + 1
    b = max(1, -(-n // a))
    key = F.lit(key) if isinstance(key, str) else key

    def once(x: Column) -> Column:
        def turn(digits: Column, r: Column) -> Column:
            mixed = F.conv(F.substring(F.sha2(F.concat_ws(":", key, r.cast("string"), digits["r"].cast("string")), 256), 1, 12), 16, 10).cast("long")
            return F.struct(digits["r"].alias("l"), ((digits["l"] + mixed) % F.when(r % 2 == 0, a).otherwise(b)).cast("long").alias("r"))

        start = F.struct((x % a).cast("long").alias("l"), F.floor(x / a).cast("long").alias("r"))
        return F.reduce(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda digits: digits["l"] + digits["r"] * a)

    walked = F.reduce(F.sequence(F.lit(1), F.lit(WALK)), F.lit(-1).cast("long"), lambda x, i: F.when((x >= 0) & (x < n), x).otherwise(once(F.when(x < 0, place).otherwise(x))))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk of the permutation is too long")))


def epoch_order(df: DataFrame, key: str, seed: str, epoch: int = 0, out: str = "turn") -> DataFrame:
    """Rows with their turn in an epoch: a permutation of their places by a unique key, another one for each seed and epoch.

    Nothing is sorted by random numbers: a turn follows from a row's place alone.
    """
    placed = positions(df, key, "_place")
    return placed.withColumn(out, permuted(F.col("_place"), placed.count(), f"{seed}:{epoch}")).drop("_place")


def cycled_turns(spark, n: int, steps: int, seed: str) -> DataFrame:  # noqa: ANN001
    """step (from 1) and the item of 0..n-1 that it uses, all items once an epoch, in another order each epoch."""
    step = spark.range(1, steps + 1).select(F.col("id").alias("step"))
    key = F.concat_ws(":", F.lit(seed), F.floor((F.col("step") - 1) / n).cast("string"))
    return step.select("step", permuted((F.col("step") - 1) % n, n, key).alias("item"))


def accumulated(df: DataFrame, step: str, every: int, value: str) -> DataFrame:
    """Means over runs of `every` steps."""
    return df.groupBy(F.floor((F.col(step) - 1) / every).alias("update")).agg(F.avg(value).alias(value), F.count("*").alias("n"))
