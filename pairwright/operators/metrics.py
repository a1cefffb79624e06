"""Aggregates over evaluated tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.numbers import safe_ratio, share
from pairwright.functions.text import LABELS
from pairwright.operators.guards import matched, strict

EVALUATOR_VERSION = "2.0.0"


def joined(tasks: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Tasks (id, pair_id, variant, label) with their evaluations, one to one, in complete pairs."""
    rows = matched(tasks.select(F.col("id").alias("task_id"), "pair_id", "variant", "label"), evaluations, "task_id")
    pairs = rows.groupBy("pair_id").agg(F.count("*").alias("n"), F.count_distinct("variant").alias("v"))
    return strict(rows, pairs.where("n != 2"), "a pair has not two evaluated tasks")


def per_class(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each of the five classes, also of those without tasks."""
    spark = rows.sparkSession
    classes = spark.createDataFrame([(i, c) for i, c in enumerate(LABELS)], "position int, class string")
    by_label = rows.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col("predicted_class").eqNullSafe(F.col("label"))).alias("tp"))
    by_guess = rows.where("predicted_class is not null").groupBy(F.col("predicted_class").alias("class")).agg(F.count("*").alias("guessed"))
    full = classes.join(by_label, "class", "left").join(by_guess, "class", "left").na.fill(0)
    p, r = safe_ratio(F.col("tp"), F.col("guessed")), safe_ratio(F.col("tp"), F.col("support"))
    return full.select("class", p.alias("precision"), r.alias("recall"), safe_ratio(2 * p * r, p + r).alias("f1"), "support")


def summary(rows: DataFrame) -> DataFrame:
    """One row with all accuracies; ValueError unless both variants are there."""
    act, other = F.col("variant") == "act", F.col("variant") != "act"
    when = lambda cond, value: F.avg(F.when(cond, value.cast("double")))
    flat = rows.agg(
        F.count("*").alias("task_count"),
        F.count_distinct("pair_id").alias("pair_count"),
        share(F.col("correct")).alias("accuracy"),
        share(F.col("behavior_correct")).alias("behavior_accuracy"),
        share(F.col("semantic_correct")).alias("semantic_accuracy"),
        share(F.col("protocol_correct")).alias("protocol_compliance_rate"),
        when(act, F.col("correct")).alias("act_accuracy"),
        when(other, F.col("correct")).alias("abstention_accuracy"),
        when(other, F.col("predicted_class").eqNullSafe("CALL")).alias("tool_hallucination_rate"),
    )
    paired = rows.groupBy("pair_id").agg(F.bool_and("correct").alias("ok")).agg(share(F.col("ok")).alias("paired_accuracy"))
    macro = per_class(rows).agg(F.avg("f1").alias("macro_f1"))
    return flat.crossJoin(paired).crossJoin(macro).withColumn("evaluator_version", F.lit(EVALUATOR_VERSION))  # one row each


def compute_metrics(tasks: DataFrame, evaluations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, per class) of evaluated tasks."""
    rows = joined(tasks, evaluations)
    sides = {r.variant for r in rows.select("variant").distinct().collect()}
    if not sides:
        raise ValueError("there are no tasks to measure")
    if sides != {"act", "abstain"}:
        raise ValueError("tasks of one variant only")
    return summary(rows), per_class(rows)


def external_metrics(evaluations: DataFrame) -> DataFrame:
    """One row of decision accuracies, rates over all records, and accuracy by category."""
    call, abstain = F.col("expected_decision") == "CALL", F.col("expected_decision") == "ABSTAIN"
    right = F.col("correct").cast("double")
    called = F.col("predicted_decision").eqNullSafe("CALL")
    flat = evaluations.agg(
        F.count("*").alias("task_count"),
        F.avg(right).alias("decision_accuracy"),
        F.avg(F.when(call, right)).alias("call_accuracy"),
        F.avg(F.when(abstain, right)).alias("abstain_accuracy"),
        share(called).alias("tool_call_rate"),
        share(called & ~F.col("protocol_correct")).alias("malformed_call_rate"),
    )
    by = evaluations.groupBy("category").agg(F.avg(right).alias("accuracy")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "accuracy")))).alias("per_category"))
    both = flat.withColumn("balanced_accuracy", (F.col("call_accuracy") + F.col("abstain_accuracy")) / 2)
    strict(both, both.where("call_accuracy is null or abstain_accuracy is null"), "records of one decision only")
    return both.crossJoin(by)
