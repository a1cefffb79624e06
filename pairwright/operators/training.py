"""From tasks to training rows: prompts, gold responses, preference pairs and their tokens."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.calls import parsed_call
from pairwright.functions.canonical import canonical, canonical_json, digest, json_string
from pairwright.functions.text import general_format
from pairwright.functions.udf import vectorized
from pairwright.operators.evaluation import evaluate
from pairwright.operators.generate import obj
from pairwright.operators.guards import duplicates, strict
from pairwright.operators.sampling import balanced_pairs, positions

#: Prompt policies.
SYSTEM = """You are a tool-use decision agent. Choose exactly one behavior:
- Call one visible tool only when it is necessary and all required arguments exist.
- Answer directly when the answer is already present in the request or context.
- Ask a concise follow-up question when a required argument is missing.
- Explicitly refuse when no visible tool can provide the requested capability.
- State that no action is needed when the environment shows the task is complete.
Never invent a tool, argument, or result."""
SHORT = """Call one visible tool only when it is necessary and all
required arguments are present. Otherwise answer, clarify, refuse, or state that no
action is needed. Never invent tools or arguments."""
EMBEDDED = """Available tools (JSON): {tools}
When a tool is necessary, output exactly
<tool_call>{"name":"tool_name","arguments":{}}</tool_call>.
Otherwise respond directly with no tool-call tags."""
STRICT = """When calling a tool, emit exactly one complete
<tool_call>{"name":"visible_tool_name","arguments":{}}</tool_call> block. The
payload must be strict JSON: double-quoted keys and strings, balanced braces and
brackets, JSON true/false/null literals, the tool name at the payload root, and
only the tool's declared arguments. Do not include prose or schema definitions."""
POLICIES = {"native_full": SYSTEM, "native_short": SHORT, "embedded_tools": f"{SYSTEM}\n\n{EMBEDDED}", "protocol_strict": f"{SYSTEM}\n\n{STRICT}"}

FORMATTER_VERSION = "1.0.0"


def policy(variant: Column) -> Column:
    """The text of a prompt variant, without anything of a task."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in POLICIES.items() for x in kv)), variant)


def function_json(tool: Column) -> Column:
    """A tool as a function object, canonical JSON."""
    inner = obj(name=json_string(tool["name"]), description=json_string(tool["description"]), parameters=tool["parameters"])
    return obj(type=F.lit('"function"'), function=inner)


def tools_json(tools: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(tools, function_json), ","), F.lit("]"))


def messages(tasks: DataFrame, variant: str = "native_full") -> DataFrame:
    """tasks with messages array<struct<role,content>>: the policy and the task's state and request."""
    system = F.lit(POLICIES[variant])
    if variant == "embedded_tools":
        system = F.replace(system, F.lit("{tools}"), tools_json(F.col("tools")))
    user = F.concat(F.lit("Environment state: "), canonical_json("environment"), F.lit("\n\nRequest: "), F.col("query"))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return tasks.withColumn("messages", F.array(turn("system", system), turn("user", user)))


def call_text(name: Column, arguments: Column) -> Column:
    """A call block; arguments are canonical JSON."""
    return F.concat(F.lit('<tool_call>{"arguments":'), arguments, F.lit(',"name":'), json_string(name), F.lit("}</tool_call>"))


def malform(call: Column) -> Column:
    """The call block without its last brace."""
    mark = F.lit("}</tool_call>")
    return F.when(F.endswith(call, mark), F.concat(F.left(call, F.length(call) - 13), F.lit("</tool_call>"))).otherwise(F.raise_error(F.lit("only a canonical call block can be broken")))


#: The words of right replies, around what a task names.
REFUSAL = ("I cannot complete that request because the required capability '", "' is not available in the visible tools.")
QUESTION = ("Could you provide the missing ", "?")


def gold_text(e: Column) -> Column:
    """The right response to a task, from its expected behaviour."""
    v = e["validator"]
    number = F.concat(general_format(v["num_value"]), F.when(F.coalesce(v["unit"], F.lit("")) != "", F.concat(F.lit(" "), v["unit"])).otherwise(""))
    answers = (
        F.when(v["kind"].isin("exact", "normalized_text"), v["value"])
        .when(v["kind"] == "numeric", number)
        .when(v["kind"] == "set", F.array_join(v["values"], ", "))
        .otherwise(F.raise_error(F.lit("a domain validator names no answer to train on")))
    )
    refusal = F.concat(F.lit(REFUSAL[0]), e["unavailable_capability"], F.lit(REFUSAL[1]))
    return (
        F.when(e["kind"] == "CALL", call_text(e["tool_name"], canonical_json(e["arguments"])))
        .when(e["kind"] == "ANSWER", answers)
        .when(e["kind"] == "CLARIFY", F.concat(F.lit(QUESTION[0]), F.array_join(e["missing_slots"], ", "), F.lit(QUESTION[1])))
        .when(e["kind"] == "NOOP", F.try_element_at(e["allowed_markers"], F.lit(1)))
        .otherwise(refusal)
    )


def sft_examples(tasks: DataFrame, split: str) -> DataFrame:
    """id, messages with the gold turn, tools, of a split's tasks by id; ValueError for rows of another split."""
    strict(tasks, tasks.where(F.col("split") != split).select("id"), "tasks of another split")
    rows = messages(tasks)
    gold = F.array(F.struct(F.lit("assistant").alias("role"), gold_text(F.col("expected")).alias("content")))
    return rows.select("id", F.concat("messages", gold).alias("messages"), "tools").orderBy("id")


# ------------------------------------------------------------------------------ records as JSON


def _expected_dict(e: dict) -> dict:
    kind = e["kind"]
    if kind == "CALL":
        return {"kind": kind, "tool_name": e["tool_name"], "arguments": json.loads(e["arguments"]), "expected_result": json.loads(e["expected_result"])}
    if kind == "ANSWER":
        v = e["validator"]
        by_kind = {"exact": ("value", "case_sensitive"), "normalized_text": ("value",), "numeric": ("absolute_tolerance", "unit"), "set": ("values", "case_sensitive"), "domain": ("validator_id",)}
        out = {"kind": v["kind"]} | {k: list(v[k]) if k == "values" else v[k] for k in by_kind[v["kind"]]}
        out |= {"value": v["num_value"]} if v["kind"] == "numeric" else {}
        out |= {"parameters": json.loads(v["parameters"] or "{}")} if v["kind"] == "domain" else {}
        return {"kind": kind, "validator": out}
    keys = {"CLARIFY": ("missing_slots",), "REFUSE": ("unavailable_capability", "reason"), "NOOP": ("state_assertion", "allowed_markers")}[kind]
    return {"kind": kind} | {k: list(e[k]) if k in ("missing_slots", "allowed_markers") else e[k] for k in keys}


FLAT = ("id", "pair_id", "domain", "split", "variant", "generator_version", "query", "label", "perturbation")


def task_dict(row: dict) -> dict:
    tools = [{"name": t["name"], "description": t["description"], "parameters": json.loads(t["parameters"])} for t in row["tools"]]
    return {k: row[k] for k in FLAT} | {"tools": tools, "environment": json.loads(row["environment"]), "expected": _expected_dict(row["expected"])}


def with_task_json(tasks: DataFrame) -> DataFrame:
    """tasks with json, the canonical record, and task_hash, its hash."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            texts = [canonical(task_dict(r)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "json"])

    wide = tasks.mapInArrow(run, StructType([*tasks.schema.fields, StructField("json", StringType())]))
    return wide.withColumn("task_hash", F.sha2("json", 256))


# -------------------------------------------------------------------------------- preferences

#: Replies of rejected responses.
WRONG_DECISION = "I cannot complete this request with the visible tools."
NO_TOOL = "I cannot complete this request because no visible tool supports it."
ALREADY_DONE = "No action is needed; the request is already complete."
ACT_KINDS = ("wrong_decision_abstain", "wrong_tool", "wrong_arguments", "malformed_tool_call", "schema_copying")
ABSTAIN_KINDS = ("unnecessary_call", "wrong_abstention_class", "malformed_tool_call")


def preferences(tasks: DataFrame, sft_init_hash: str) -> DataFrame:
    """One chosen and rejected response for every train or validation task.

    The kind of rejection goes around by the task's place among all ids; abstain tasks see their
    pair's act call.
    """
    strict(tasks, tasks.where("split = 'test'").select("id"), "preferences are never made from test tasks")
    sides = tasks.groupBy("pair_id").agg(F.count_if(F.col("variant") == "act").alias("a"), F.count_if(F.col("variant") == "abstain").alias("b"))
    strict(tasks, sides.where("a != 1 or b != 1").select("pair_id"), "a pair lacks a side")
    rows = positions(with_task_json(tasks), "id", "at").withColumn("chosen", gold_text(F.col("expected")))
    acts = rows.where("variant = 'act'").select("pair_id", F.col("chosen").alias("act_call"))
    rows = rows.join(acts, "pair_id")
    e = F.col("expected")
    kinds = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("at") % len(names) + 1).cast("int"))
    kind = F.when(F.col("variant") == "act", kinds(ACT_KINDS)).otherwise(kinds(ABSTAIN_KINDS))
    rows = rows.withColumn("negative_type", kind)
    others = F.filter("tools", lambda t: t["name"] != e["tool_name"])
    own = F.filter("tools", lambda t: t["name"] == e["tool_name"])
    other = F.coalesce(F.try_element_at(others, F.lit(1))["name"], F.lit("invented_tool"))
    arguments = canonical_json(e["arguments"])
    act = (
        F.when(F.col("negative_type") == "wrong_decision_abstain", F.lit(WRONG_DECISION))
        .when(F.col("negative_type") == "wrong_tool", call_text(other, arguments))
        .when(F.col("negative_type") == "wrong_arguments", call_text(e["tool_name"], F.lit("{}")))
        .when(F.col("negative_type") == "schema_copying", call_text(e["tool_name"], canonical_json(F.try_element_at(own, F.lit(1))["parameters"])))
    )
    abstain = F.when(F.col("negative_type") == "unnecessary_call", F.col("act_call")).when(F.col("negative_type") == "wrong_abstention_class", F.when(F.col("label") == "REFUSE", ALREADY_DONE).otherwise(NO_TOOL))
    rejected = F.when(F.col("negative_type") == "malformed_tool_call", malform(F.col("act_call"))).when(F.col("variant") == "act", act).otherwise(abstain)
    provenance = F.struct(
        F.lit("internal_task").alias("source_kind"), F.col("task_hash").alias("source_task_hash"), F.lit(FORMATTER_VERSION).alias("generator_version"),
        F.lit(sft_init_hash).alias("sft_init_hash"), F.array().cast("array<string>").alias("external_sources"), F.lit(False).alias("test_consumed"),
    )
    return rows.select(F.concat(F.lit("pref-"), "id").alias("id"), F.col("id").alias("task_id"), "pair_id", "split", F.col("label").alias("target_class"), "negative_type", "chosen", rejected.alias("rejected"), provenance.alias("provenance"))


def checked(prefs: DataFrame, tasks: DataFrame) -> DataFrame:
    """prefs with violations: what the evaluator says of both responses, and whether the source still matches."""
    from pairwright.operators.guards import violations

    sources = with_task_json(tasks).select(F.col("id").alias("task_id"), F.col("split").alias("_s"), F.col("label").alias("_l"), F.col("pair_id").alias("_p"), "task_hash")
    rows = prefs.join(sources, "task_id", "left")
    for side in ("chosen", "rejected"):
        said = prefs.select("task_id", F.col(side).alias("raw_text"), F.lit(None).cast("struct<name:string,arguments:string>").alias("tool_call"), F.lit(None).cast("string").alias("inference_error"))
        found = evaluate(tasks, said).select("task_id", F.col("correct").alias(f"{side}_correct"), F.col("protocol_correct").alias(f"{side}_protocol"))
        rows = rows.join(found, "task_id", "left")
    broken = F.col("negative_type") == "malformed_tool_call"
    calls = F.col("negative_type").isin("wrong_tool", "wrong_arguments", "schema_copying")
    rows = rows.withColumn("_call", parsed_call(F.col("rejected"))["name"])
    source = (F.col("split") == F.col("_s")) & (F.col("target_class") == F.col("_l")) & (F.col("pair_id") == F.col("_p"))
    rows = rows.withColumn("violations", violations((source, "source"), (F.col("provenance.source_task_hash") == F.col("task_hash"), "task_hash"), (F.col("chosen_correct") & F.col("chosen_protocol"), "chosen"), (~F.col("rejected_correct"), "rejected"), (F.col("rejected_protocol") != broken, "protocol"), (~calls | F.col("_call").isNotNull(), "call_syntax")))
    return rows.select(*prefs.columns, "violations")


def dpo_examples(prefs: DataFrame, tasks: DataFrame, sft_init_hash: str, limit: int | None = None) -> DataFrame:
    """Preferences with their prompts, by id; ValueError for repeated, missing, stale or foreign ones."""
    strict(prefs, duplicates(prefs, "id"), "a preference id stands twice")
    strict(tasks, duplicates(tasks, "id"), "a task id stands twice")
    strict(tasks, tasks.where("split = 'test'").select("id"), "test tasks are not for training")
    named = messages(with_task_json(tasks)).select(F.col("id").alias("task_id"), "messages", "tools", "task_hash", F.col("split").alias("_split"))
    rows = prefs.join(named, "task_id", "left")
    strict(rows, rows.where("task_hash is null").select("task_id"), "a preference is of no known task")
    strict(rows, rows.where("provenance.source_task_hash != task_hash").select("task_id"), "a preference was made from another version of its task")
    strict(rows, rows.where(F.col("provenance.sft_init_hash") != sft_init_hash).select("task_id"), "a preference was made for another initial model")
    whole = with_preference_hash(rows)
    out = whole.select(F.concat(F.lit("dpo-"), "task_id").alias("id"), "task_id", F.col("_split").alias("split"), "messages", "tools", "chosen", "rejected", "negative_type", "preference_hash", "task_hash", F.col("provenance.sft_init_hash").alias("sft_init_hash"))
    return balanced_pairs(out, limit)


PREFERENCE = ("id", "task_id", "pair_id", "split", "target_class", "negative_type", "chosen", "rejected", "provenance")


@vectorized("string")
def _hashed(records: pd.DataFrame) -> pd.Series:
    def plain(v):  # noqa: ANN001, ANN202
        return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v.tolist() if hasattr(v, "tolist") else list(v) if isinstance(v, tuple) else v

    return pd.Series([digest({k: plain(v) for k, v in r.items()}) for r in records.to_dict("records")])


def with_preference_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("preference_hash", _hashed(F.struct(*PREFERENCE)))


def tokenized(examples: DataFrame, tokenizer: Callable[[list, bool], list[int]], max_length: int) -> DataFrame:
    """Token ids of prompt and both completions, cut at max_length, with the completions' offsets.

    tokenizer(messages, add_generation_prompt) gives ids; it is called in the workers.  ValueError if a
    completion does not continue the prompt, is cut away, or the two become the same.
    """
    shape = "id string, chosen array<int>, rejected array<int>, chosen_offset int, rejected_offset int, chosen_truncated boolean, rejected_truncated boolean"

    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            rows = []
            for row in frame.itertuples():
                turns = [dict(m) for m in row.messages]
                prompt = list(tokenizer(turns, True))
                sides = []
                for text in (row.chosen, row.rejected):
                    ids = list(tokenizer([*turns, {"role": "assistant", "content": text}], False))
                    if ids[: len(prompt)] != prompt:
                        raise ValueError(f"{row.id}: a completion does not go on from its prompt")
                    if min(len(ids), max_length) <= len(prompt):
                        raise ValueError(f"{row.id}: nothing of the completion is left")
                    sides.append((ids[:max_length], len(ids) > max_length))
                if sides[0][0] == sides[1][0]:
                    raise ValueError(f"{row.id}: cut to the same ids on both sides")
                rows.append((row.id, sides[0][0], sides[1][0], len(prompt), len(prompt), sides[0][1], sides[1][1]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in shape.split(", ")])

    return examples.select("id", "messages", "chosen", "rejected").mapInPandas(run, shape)


def reference_problems(examples: DataFrame, cache: DataFrame) -> DataFrame:
    """id, problem of cached log-probabilities: repeated, of one side only, or of another example (example_hash)."""
    repeated = duplicates(cache, "id").select("id", F.lit("repeated").alias("problem"))
    both = examples.select("id", F.col("example_hash").alias("now")).join(cache.select("id", F.col("example_hash").alias("then")), "id", "full_outer")
    gaps = both.where("now is null or then is null").select("id", F.lit("unmatched").alias("problem"))
    return repeated.unionByName(gaps).unionByName(both.where("now != then").select("id", F.lit("stale").alias("problem")))
