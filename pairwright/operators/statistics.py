"""Seed intervals and bootstrap comparisons."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.numbers import finite
from pairwright.operators.guards import matched, require, union_all
from pairwright.operators.sampling import positions
from pairwright.staging import Stage

#: Fixed value: Student's t at 97.5 % with two degrees of freedom, used whatever the number of values.
T_CRITICAL = 4.3026527299


def mean_interval(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """n, mean, sample deviation and t interval of a column, at least two finite values."""
    v = F.col(value).cast("double")
    flat = require(df, finite(v), "a value is not finite").groupBy(*([by] if by else [])).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sample_std"))
    flat = require(flat, F.col("n") >= 2, "two values at least are needed")
    half = F.lit(T_CRITICAL) * F.col("sample_std") / F.sqrt("n")
    return flat.withColumns({"ci95_low": F.col("mean") - half, "ci95_high": F.col("mean") + half})


def resampled(differences: list[float], samples: int, seed: int) -> tuple[float, float]:
    """Bounds by the order statistics at floor(.025 (B - 1)) and ceil(.975 (B - 1)) of resampled means."""
    draw, n = random.Random(seed).randrange, len(differences)
    means = sorted(sum(differences[draw(n)] for _ in range(n)) / n for _ in range(samples))
    return means[math.floor(0.025 * (samples - 1))], means[math.ceil(0.975 * (samples - 1))]


def paired_bootstrap(pairs: DataFrame, samples: int = 10_000) -> DataFrame:
    """For each comparison (comparison, seed, task_id, baseline, candidate): difference and interval.

    Draws are Python's, seeded, over ids in order, so that results repeat those of a single process.
    A comparison's tasks are one evaluation set and fit one task.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task_id")
        differences = [float(c) - float(b) for b, c in zip(rows.baseline, rows.candidate, strict=True)]
        seed = int(rows.seed.iloc[0])
        low, high = resampled(differences, samples, seed)
        return pd.DataFrame({"comparison": [rows.comparison.iloc[0]], "task_count": [len(rows)], "samples": [samples], "seed": [seed], "difference": [sum(differences) / len(rows)], "ci95_low": [low], "ci95_high": [high]})

    return pairs.groupBy("comparison").applyInPandas(one, "comparison string, task_count long, samples long, seed long, difference double, ci95_low double, ci95_high double")


def compared(baseline: DataFrame, candidate: DataFrame, name: str, seed: int) -> DataFrame:
    """Rows for paired_bootstrap from two evaluations (task_id, correct) of the same tasks."""
    a, b = (df.select("task_id", F.col("correct").alias(c)) for df, c in ((baseline, "baseline"), (candidate, "candidate")))
    rows = matched(a, b, "task_id")
    if rows.isEmpty():
        raise ValueError("the evaluations have no tasks to pair")
    return rows.select(F.lit(name).alias("comparison"), F.lit(seed).cast("long").alias("seed"), "task_id", "baseline", "candidate")


def hashed_bootstrap(df: DataFrame, key: str, value: str, samples: int, salt: str = "") -> DataFrame:
    """sample, mean: bootstrap means with draws from hashes of (salt, sample, place), for any number of rows.

    Rows have places 0..n-1 by key; draw i of a sample takes the place hash mod n.  A draw is a row of a range, which
    Spark deals over tasks; a sample's draws of a place are counted before they move.
    """
    placed = positions(df.select(key, value), key, "place").select("place", value)
    n = placed.count()
    draws = df.sparkSession.range(samples * n).select(F.floor(F.col("id") / n).alias("sample"), (F.col("id") % n).alias("i"))
    digest = F.substring(F.sha2(F.concat_ws(":", F.lit(salt), "sample", "i"), 256), 1, 13)
    drawn = draws.select("sample", F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(n)).alias("place")).groupBy("sample", "place").agg(F.count("*").alias("times"))
    return drawn.join(placed, "place").groupBy("sample").agg((F.sum(F.col("times") * F.col(value)) / n).alias("mean"))


#: Places of a range whose rows are drawn from together.
RANGE = 1 << 16


def generator(*key: int) -> np.random.Generator:
    """Random numbers that follow from a key alone."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(key)))


def draws_in_range(n: int, number: int, sample: int, seed: int, width: int = RANGE) -> int:
    """How many of a sample's n draws from the places 0..n-1 fall into a range of `width` places.

    The draws are split down a tree of ranges: of those that fall into a node, a binomial number fall into its lower half.
    A node's number follows from the seed, the sample and the node, so any task can tell it by itself.
    """
    ranges, low, count = -(-n // width), 0, n
    high = 1 << max(ranges - 1, 0).bit_length()
    while high - low > 1:
        middle = (low + high) // 2
        of = lambda a, b: max(0, min(b * width, n) - min(a * width, n))
        lower = int(generator(seed, sample, low, high).binomial(count, of(low, middle) / of(low, high))) if of(middle, high) else count
        low, high, count = (low, middle, lower) if number < middle else (middle, high, count - lower)
    return count


def range_total(values: np.ndarray, n: int, number: int, sample: int, seed: int, width: int = RANGE) -> float:
    """Sum of what a sample draws from a range's values."""
    count = draws_in_range(n, number, sample, seed, width)
    times = np.bincount(generator(seed, sample, number).integers(0, len(values), count), minlength=len(values))
    return float(times @ values)


def multinomial_bootstrap(df: DataFrame, key: str, value: str, samples: int, seed: int = 0, width: int = RANGE) -> DataFrame:
    """sample, mean: bootstrap means of a column's values in the order of a unique key.

    Rows are dealt by ranges of places, and each range draws its share of every sample (see draws_in_range): no draw is a
    row, none is shuffled, and a task holds a range of values whatever the number of rows.  Rows without a value are left out.
    """
    placed = positions(df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("value")), key, "place")
    n = placed.count()

    def totals(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        values, number = rows.column("value").to_numpy(), rows.column("range")[0].as_py()
        found = [range_total(values, n, number, sample, seed, width) for sample in range(samples)]
        return pa.table({"range": pa.array([number] * samples, pa.int64()), "sample": pa.array(range(samples), pa.int64()), "total": pa.array(found, pa.float64())})

    ranges = placed.select(F.floor(F.col("place") / width).alias("range"), "place", "value").groupBy("range").applyInArrow(totals, "range long, sample long, total double")
    return ranges.groupBy("sample").agg((F.sum("total") / n).alias("mean"))


#: Rows that a task may hold when a rank is looked up among them, and the accuracy of the sketches that narrow ranges.
SELECT_ROWS, ACCURACY = 100_000, 10_000


def order_statistics(df: DataFrame, by: list[str], value: str, quantiles: list[float], up: bool = False) -> DataFrame:
    """by ..., quantile, value: the exact value at place floor(q (n - 1)), or ceil, of a group's values in order; no interpolation.

    Ranges are narrowed: a sketch brackets each rank, equal values are counted together, those below the bracket are counted,
    and what is in it is looked at again, until a bracket has one value or SELECT_ROWS rows at most.  So no task holds a
    group's values.  Nulls are left out; groups without values give no rows.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    values = Stage(counted, "values").df
    total = values.groupBy(*by).agg(F.sum("_n").alias("_rows"))
    ask = F.explode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("quantile")
    place = F.col("quantile") * (F.col("_rows") - 1)
    wanted = Stage(total.select(*by, ask, "_rows").select(*by, "quantile", (F.ceil(place - 1e-9) if up else F.floor(place + 1e-9)).alias("_rank")), "ranks").df
    # rows of every rank that is looked for: value and count, and how many rows of the bracket lie before the rank
    open_rows = values.join(wanted, by).select(*by, "quantile", "_rank", "_v", "_n") if by else values.join(F.broadcast(wanted)).select("quantile", "_rank", "_v", "_n")  # without groups a row a quantile
    keys, done = [*by, "quantile"], []
    while True:
        sizes = open_rows.groupBy(*keys).agg(F.count("*").alias("_kinds"))
        small = open_rows.join(sizes.where(F.col("_kinds") <= SELECT_ROWS), keys)
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))
        done.append(Stage(small.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank"))).select(*keys, F.col("_v").alias("value")), "selected").df)
        large = open_rows.join(sizes.where(F.col("_kinds") > SELECT_ROWS), keys)
        if large.isEmpty():
            return union_all(*done)
        # the sketch is of different values; cuts that split them in parts tell, with their counts, the part that has the rank
        parts = [i / 64 for i in range(1, 64)]
        cuts = large.groupBy(*keys).agg(F.percentile_approx("_v", parts, ACCURACY).alias("_cuts"))
        part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        dealt = Stage(large.drop("_kinds").join(cuts, keys).withColumn("_part", part).drop("_cuts"), "dealt").df
        by_part = dealt.groupBy(*keys, "_rank", "_part").agg(F.sum("_n").alias("_in"))
        through = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_part"))  # 64 parts at most
        held = by_part.withColumn("_through", through).where((F.col("_through") > F.col("_rank")) & (F.col("_through") - F.col("_in") <= F.col("_rank")))
        chosen = held.select(*keys, "_part", (F.col("_rank") - (F.col("_through") - F.col("_in"))).alias("_next"))
        open_rows = Stage(dealt.join(chosen, [*keys, "_part"]).select(*keys, F.col("_next").alias("_rank"), "_v", "_n"), "narrowed").df


def order_interval(means: DataFrame, value: str, samples: int) -> DataFrame:
    """Discrete order statistics of one column of so many rows, no interpolation."""
    low, high = order_statistics(means, [], value, [0.025]), order_statistics(means, [], value, [0.975], up=True)
    return low.select(F.col("value").alias("ci95_low")).join(F.broadcast(high.select(F.col("value").alias("ci95_high"))))  # one row each
