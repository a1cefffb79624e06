"""Call attempts that are not valid, by cause, and how two runs differ in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.calls import malformed_category
from pairwright.operators.guards import count_map, outcome_diff


def classified(predictions: DataFrame, max_tokens: int = 256) -> DataFrame:
    """task_id, category of the malformed attempts."""
    rows = predictions.select("task_id", malformed_category(F.col("raw_text"), F.col("output_tokens"), max_tokens).alias("category"))
    return rows.where("category is not null")


def compared(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: counts, categories and sorted ids of new, resolved and persistent malformed attempts."""
    a, b = classified(base), classified(candidate)
    outcomes = outcome_diff(a, b, "task_id")
    ids = lambda kind: F.array_sort(F.collect_list(F.when(F.col("outcome") == kind, F.col("task_id"))))
    flat = outcomes.agg(*(F.count_if(F.col("outcome") == k).alias(f"{k}_count") for k in ("new", "resolved", "persistent")), *(ids(k).alias(f"{k}_ids") for k in ("new", "resolved", "persistent")))
    sizes = a.agg(F.count("*").alias("base_malformed_count")).crossJoin(b.agg(F.count("*").alias("candidate_malformed_count")))
    kinds = count_map(a, "category").withColumnRenamed("counts", "base_categories").crossJoin(count_map(b, "category").withColumnRenamed("counts", "candidate_categories"))
    return sizes.crossJoin(flat).crossJoin(kinds)  # one row each
