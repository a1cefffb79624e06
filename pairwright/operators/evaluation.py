"""Scoring of predictions against tasks, row by row, as one projection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.calls import CALL, parsed_call, same_json, valid_external_call
from pairwright.functions.text import (
    NOTHING_TO_DO,
    answer_pieces,
    first_number,
    looks_like_call,
    mentions_any,
    mentions_slot,
    normalise,
    normalize_text,
    refuses,
    stripped_text,
)
from pairwright.functions.udf import vectorized
from pairwright.operators.guards import duplicates, missing_from, strict

PREDICTION = f"task_id string, raw_text string, tool_call {CALL}, latency_ms double, input_tokens long, output_tokens long, peak_memory_gb double, inference_error string"


@vectorized("array<string>")
def normalized_all(values: pd.Series) -> pd.Series:
    return values.map(lambda xs: None if xs is None else [normalise(x) for x in xs])


def text_class(text: Column, normalised: Column, kind: Column, slots: Column, markers: Column) -> Column:
    """Behaviour of a response that is no call; null for blank text.

    A question counts as clarifying only if the task expects one and a missing slot is named.
    """
    asks = F.contains(text, F.lit("?")) | F.regexp_like(normalised, F.lit(r"\A(?:which|what|who) "))
    idle = mentions_any(normalised, F.array(*map(F.lit, NOTHING_TO_DO))) | F.coalesce(mentions_any(normalised, markers), F.lit(False))
    return (
        F.when(stripped_text(text) == "", F.lit(None).cast("string"))
        .when(refuses(text), "REFUSE")
        .when((kind == "CLARIFY") & asks & F.coalesce(mentions_slot(normalised, slots), F.lit(False)), "CLARIFY")
        .when(idle, "NOOP")
        .otherwise("ANSWER")
    )


def answer_strict(v: Column, text: Column, normalised: Column, value: Column, unit: Column, values: Column) -> Column:
    """Whether a response is an answer as a validator wants it; the last three are v's parts, normalised."""
    number = first_number(text)
    near = number.isNotNull() & (F.abs(number - v["num_value"]) <= v["absolute_tolerance"])
    numeric = near & (F.coalesce(v["unit"], F.lit("")).eqNullSafe("") | F.contains(normalised, unit))
    pieces = answer_pieces(text)
    cased = F.array_sort(F.array_distinct(pieces)) == F.array_sort(F.array_distinct(v["values"]))
    folded = F.array_sort(F.array_distinct(normalized_all(pieces))) == F.array_sort(F.array_distinct(values))
    exact = F.when(v["case_sensitive"], stripped_text(text) == stripped_text(v["value"])).otherwise(normalised == value)
    found = F.when(v["kind"] == "exact", exact).when(v["kind"] == "normalized_text", normalised == value).when(v["kind"] == "numeric", numeric)
    return F.coalesce(found.when(v["kind"] == "set", F.when(v["case_sensitive"], cased).otherwise(folded)), F.lit(False))


def answer_semantic(v: Column, text: Column, normalised: Column, value: Column, unit: Column, values: Column) -> Column:
    """As answer_strict, but an exact or normalised answer may stand inside a sentence."""
    inside = F.contains(normalised, value)
    exact = F.when(v["case_sensitive"], F.contains(text, stripped_text(v["value"]))).otherwise(inside)
    found = F.when(v["kind"] == "exact", exact).when(v["kind"] == "normalized_text", inside)
    return F.coalesce(found.otherwise(answer_strict(v, text, normalised, value, unit, values)), F.lit(False))


def evaluate(tasks: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row for each prediction with its task: class, behaviour, semantics, protocol, reason, parsed call.

    tasks has id, label, expected (generate.TASK); tasks without a prediction are left out.
    """
    strict(predictions, duplicates(predictions, "task_id"), "a task has several predictions")
    strict(predictions, missing_from(predictions, tasks.select(F.col("id").alias("task_id")), "task_id"), "a prediction is of no task")
    rows = tasks.select(F.col("id").alias("task_id"), "label", F.col("expected").alias("e")).join(predictions, "task_id")
    v = F.col("e.validator")
    rows = rows.withColumns(
        {
            "call": F.coalesce("tool_call", F.when(F.col("inference_error").isNull(), parsed_call(F.when(F.contains("raw_text", F.lit("{")), F.col("raw_text"))))),  # a call has a brace
            "norm": normalize_text(F.col("raw_text")),
            "n_value": normalize_text(v["value"]),
            "n_unit": normalize_text(v["unit"]),
            "n_values": normalized_all(v["values"]),
            "n_markers": normalized_all(F.col("e.allowed_markers")),
        }
    )
    rows = rows.withColumn("call", F.when(F.col("call.name").isNotNull(), F.col("call")))
    text, kind = F.col("raw_text"), F.col("e.kind")
    rows = rows.withColumn("text_class", text_class(text, F.col("norm"), kind, F.col("e.missing_slots"), F.when(kind == "NOOP", F.col("n_markers"))))
    rows = rows.withColumn("same_arguments", same_json(F.col("call.arguments"), F.col("e.arguments")))
    failed, called, tried = F.col("inference_error").isNotNull(), F.col("call").isNotNull(), looks_like_call(text)
    predicted = F.when(failed, F.lit(None).cast("string")).when(called | tried, "CALL").otherwise(F.col("text_class"))
    behaves = F.coalesce(predicted == F.col("label"), F.lit(False))
    right_call = (kind == "CALL") & (F.col("call.name") == F.col("e.tool_name")) & F.col("same_arguments")
    parts = (F.col("n_value"), F.col("n_unit"), F.col("n_values"))
    text_right = (
        F.when(kind == "ANSWER", answer_semantic(v, text, F.col("norm"), *parts))
        .when(kind == "CLARIFY", mentions_slot(F.col("norm"), F.col("e.missing_slots")))
        .when(kind == "REFUSE", refuses(text))
        .when(kind == "NOOP", mentions_any(F.col("norm"), F.col("n_markers")))
    )
    semantic = F.when(failed, F.lit(False)).when(called, right_call).when(tried, F.lit(False)).otherwise(behaves & text_right)
    semantic = F.coalesce(semantic, F.lit(False))
    names = F.element_at(F.create_map(*(F.lit(x) for pair in (("ANSWER", "answer"), ("CLARIFY", "clarification"), ("REFUSE", "refusal"), ("NOOP", "noop")) for x in pair)), F.col("label"))
    reason = (
        F.when(failed, "inference_error")
        .when(called, F.when(behaves & semantic, "correct_tool_call").otherwise("incorrect_tool_call"))
        .when(tried, "malformed_tool_call")
        .when(F.col("text_class").isNull(), "empty_output")
        .when(behaves & F.col("label").isin("ANSWER", "CLARIFY", "REFUSE", "NOOP"), F.concat(F.when(semantic, "correct_").otherwise("incorrect_"), names))
        .otherwise("wrong_behavior")
    )
    protocol = F.when(failed, F.lit(False)).when(called, F.lit(True)).when(tried, F.lit(False)).otherwise(stripped_text(text) != "")
    return rows.select(
        "task_id", predicted.alias("predicted_class"), behaves.alias("behavior_correct"), semantic.alias("semantic_correct"), protocol.alias("protocol_correct"),
        (behaves & semantic).alias("correct"), reason.alias("reason_code"), F.when(~failed, F.col("call")).alias("parsed_tool_call"),
    )


def evaluate_external(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """CALL or ABSTAIN decision of each external record (id, category, expected_decision); a broken call is a call."""
    from pairwright.operators.guards import matched

    rows = matched(records.select(F.col("id").alias("task_id"), "category", "expected_decision"), predictions, "task_id")
    rows = rows.withColumns({"parsed": F.coalesce(F.col("tool_call.name"), parsed_call(F.col("raw_text"))["name"]).isNotNull(), "valid": valid_external_call(F.col("raw_text"))})
    failed, well = F.col("inference_error").isNotNull(), F.col("parsed") | F.col("valid")
    tried = well | looks_like_call(F.col("raw_text"))
    predicted = F.when(failed, F.lit(None).cast("string")).when(tried, "CALL").otherwise("ABSTAIN")
    correct = F.coalesce(predicted == F.col("expected_decision"), F.lit(False))
    protocol = F.when(failed, F.lit(False)).when(tried, well).otherwise(stripped_text(F.col("raw_text")) != "")
    reason = F.when(failed, "inference_error").when(correct, "correct_decision").otherwise("incorrect_decision")
    return rows.select("task_id", "category", "expected_decision", predicted.alias("predicted_decision"), correct.alias("correct"), protocol.alias("protocol_correct"), reason.alias("reason_code"))
