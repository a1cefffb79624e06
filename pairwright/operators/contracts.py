"""Record contracts: each adds violations array<string>, empty for a row that keeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.canonical import canonical_json
from pairwright.functions.numbers import finite
from pairwright.functions.schemas import argument_problem, schema_problem
from pairwright.functions.text import LABELS, fold, slug_ok
from pairwright.operators.generate import PERTURBATIONS
from pairwright.operators.guards import violations

SPLITS = ("train", "validation", "test")
NEGATIVES = ("wrong_decision_abstain", "wrong_abstention_class", "unnecessary_call", "wrong_tool", "wrong_arguments", "malformed_tool_call", "schema_copying")


def _checked(df: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    return df.withColumn("violations", violations(*checks))


def _filled(c: Column) -> Column:
    return F.length(c) >= 1


def _or_null(c: Column, ok: Column) -> Column:
    return c.isNull() | ok


def _version(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"\A[0-9]+\.[0-9]+\.[0-9]+\z"))


def _hex(c: Column, n: int) -> Column:
    return F.regexp_like(c, F.lit(rf"\A[0-9a-f]{{{n}}}\z"))


def _unique(items: Column) -> Column:
    return F.size(F.array_distinct(items)) == F.size(items)


def unknown_fields(raw: Column, *fields: str) -> Column:
    """Keys of a JSON object that a record does not have."""
    return F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, fields)))


def validator_ok(v: Column) -> Column:
    number = finite(v["num_value"]) & (v["absolute_tolerance"] >= 0)
    lowered = F.transform(v["values"], fold)
    return (
        F.when(v["kind"].isin("exact", "normalized_text"), _filled(v["value"]))
        .when(v["kind"] == "numeric", number)
        .when(v["kind"] == "set", (F.size(v["values"]) >= 1) & _unique(lowered) & F.forall(v["values"], _filled))
        .when(v["kind"] == "domain", slug_ok(v["validator_id"]))
    )


def expected_ok(e: Column) -> Column:
    """Whether an expected behaviour has what its kind needs."""
    slots, markers = e["missing_slots"], e["allowed_markers"]
    return (
        F.when(e["kind"] == "CALL", slug_ok(e["tool_name"]) & e["arguments"].isNotNull())
        .when(e["kind"] == "ANSWER", validator_ok(e["validator"]))
        .when(e["kind"] == "CLARIFY", (F.size(slots) >= 1) & _unique(slots) & F.forall(slots, slug_ok))
        .when(e["kind"] == "REFUSE", slug_ok(e["unavailable_capability"]) & e["reason"].isin("missing_tool", "unsupported_capability"))
        .when(e["kind"] == "NOOP", _filled(e["state_assertion"]) & (F.size(markers) >= 1) & _unique(F.transform(markers, fold)))
    )


def tasks(df: DataFrame) -> DataFrame:
    e, act = F.col("expected"), F.col("variant") == "act"
    named = F.filter("tools", lambda t: t["name"] == e["tool_name"])
    made = F.element_at(F.create_map(*(F.lit(x) for label, p in PERTURBATIONS.items() for x in (p, label))), F.col("perturbation"))
    call, first = e["kind"] == "CALL", F.try_element_at(named, F.lit(1))
    names = F.transform("tools", lambda t: t["name"])
    rows = df.withColumn("_problem", argument_problem(first["parameters"], e["arguments"]))
    checked = _checked(
        rows,
        (slug_ok(F.col("id")) & slug_ok(F.col("pair_id")) & slug_ok(F.col("domain")), "slug"),
        (F.col("split").isin(*SPLITS) & F.col("variant").isin("act", "abstain") & F.col("label").isin(*LABELS), "choice"),
        (_version(F.col("generator_version")), "generator_version"),
        (_filled(F.col("query")), "query"),
        (F.col("id") == F.concat_ws("-", "pair_id", "variant"), "id"),
        (e["kind"] == F.col("label"), "kind"),
        (F.when(act, F.col("label") == "CALL").otherwise(F.col("label") != "CALL"), "label"),
        (F.when(act, F.col("perturbation").isNull()).otherwise(made == F.col("label")), "perturbation"),
        (_unique(names) & F.forall("tools", lambda t: slug_ok(t["name"]) & _filled(t["description"])), "tools"),
        (~call | (F.size(named) == 1), "expected_tool"),
        (~call | F.col("_problem").isNull(), "arguments"),
        (expected_ok(e), "expected"),
    )
    return checked.drop("_problem")


def tools(df: DataFrame) -> DataFrame:
    """name, description, parameters (JSON)."""
    return _checked(df.withColumn("_p", schema_problem("parameters")), (slug_ok(F.col("name")), "name"), (_filled(F.col("description")), "description"), (F.col("_p").isNull(), "parameters")).drop("_p")


def pairs(df: DataFrame) -> DataFrame:
    """One row a pair from its tasks: roles, shared fields, and exactly the change that its perturbation declares."""
    side = lambda v: F.max_by(F.struct(*(c for c in df.columns)), F.when(F.col("variant") == v, 1))
    rows = df.groupBy("pair_id").agg(F.count("*").alias("n"), F.count_distinct("variant").alias("v"), side("act").alias("act"), side("abstain").alias("abstain"))
    a, b = F.col("act"), F.col("abstain")
    changes = F.array_compact(F.array(
        F.when(canonical_json(a["environment"]) != canonical_json(b["environment"]), F.lit("environment")),
        F.when(a["query"] != b["query"], F.lit("query")),
        F.when(F.to_json(a["tools"]) != F.to_json(b["tools"]), F.lit("tools")),
    ))
    declared = F.when(b["perturbation"].isin("answer_provided", "required_argument_removed"), F.array(F.lit("query"))).when(b["perturbation"] == "tool_removed", F.array(F.lit("tools"))).when(b["perturbation"] == "already_satisfied", F.array(F.lit("environment")))
    shared = F.lit(True)
    for c in ("domain", "split", "generator_version"):
        shared = shared & (a[c] == b[c])
    return _checked(rows.withColumn("changes", changes), ((F.col("n") == 2) & (F.col("v") == 2), "members"), (shared, "shared"), (F.col("changes") == declared, "changes"))


def predictions(df: DataFrame) -> DataFrame:
    """Numbers not negative and finite; a failed prediction has no output."""
    failed = F.col("inference_error").isNotNull()
    return _checked(
        df,
        (slug_ok(F.col("task_id")), "task_id"),
        (finite(F.col("latency_ms")) & (F.col("latency_ms") >= 0), "latency_ms"),
        *((_or_null(F.col(c), F.col(c) >= 0), c) for c in ("input_tokens", "output_tokens")),
        (_or_null(F.col("peak_memory_gb"), finite(F.col("peak_memory_gb")) & (F.col("peak_memory_gb") >= 0)), "peak_memory_gb"),
        (~failed | ((F.col("raw_text") == "") & F.col("tool_call.name").isNull()), "inference_error"),
    )


def evaluations(df: DataFrame) -> DataFrame:
    flags = F.col("behavior_correct") | F.col("semantic_correct") | F.col("correct")
    return _checked(df, (F.col("predicted_class").isNotNull() | ~flags, "unclassified"), (F.col("correct") == (F.col("behavior_correct") & F.col("semantic_correct")), "correct"), (slug_ok(F.col("reason_code")), "reason_code"))


def preferences(df: DataFrame) -> DataFrame:
    """Of a record by itself; operators.preferences.checked looks at it with its task."""
    p = F.col("provenance")
    return _checked(
        df,
        (F.col("id") == F.concat(F.lit("pref-"), "task_id"), "id"),
        (F.col("split").isin("train", "validation"), "split"),
        (F.col("negative_type").isin(*NEGATIVES), "negative_type"),
        (F.trim("chosen") != F.trim("rejected"), "texts"),
        (_hex(p["source_task_hash"], 64) & _hex(p["sft_init_hash"], 64) & _version(p["generator_version"]), "hashes"),
        ((p["source_kind"] == "internal_task") & (F.size(p["external_sources"]) == 0) & ~p["test_consumed"], "provenance"),
    )


def external(df: DataFrame) -> DataFrame:
    """External records: provenance of a benchmark must not allow training."""
    p = F.col("provenance")
    return _checked(
        df,
        (slug_ok(F.col("id")), "id"),
        (F.col("expected_decision").isin("CALL", "ABSTAIN") & F.col("category").isin("simple", "irrelevance"), "choice"),
        (F.startswith(p["source_uri"], F.lit("https://")), "source_uri"),
        (_hex(p["revision"], 40) & _hex(p["source_sha256"], 64), "revision"),
        (p["license"].isin("Apache-2.0", "CC-BY-4.0", "MIT"), "license"),
        (p["usage"] == "external_eval", "usage"),
        ((F.size("messages") >= 1) & F.exists("messages", lambda m: m["role"] == "user"), "messages"),
    )


def reference_logps(df: DataFrame) -> DataFrame:
    ok = finite(F.col("chosen_logp")) & finite(F.col("rejected_logp"))
    return _checked(df, (ok, "logps"), ((F.col("chosen_tokens") > 0) & (F.col("rejected_tokens") > 0), "tokens"), (_hex(F.col("example_hash"), 64), "example_hash"))


def dpo_examples(df: DataFrame) -> DataFrame:
    return _checked(df, (F.col("id") == F.concat(F.lit("dpo-"), "task_id"), "id"), (F.col("split") != "test", "split"), (F.trim("chosen") != F.trim("rejected"), "texts"))


def in_unit_range(df: DataFrame, *columns: str) -> DataFrame:
    """Rates between 0 and 1."""
    return _checked(df, *((F.col(c).between(0, 1), c) for c in columns))


def internal_only(manifest: dict) -> dict:
    """A manifest of generated data that no external source and no held-out row went into, else ValueError."""
    for key, want in (("source_kind", "internal_generated"), ("external_sources", []), ("test_consumed", False)):
        if manifest.get(key) != want:
            raise ValueError(f"provenance must have {key} = {want!r}")
    return manifest


def expected_count(df: DataFrame, want: int | None, what: str) -> DataFrame:
    """df, if it has as many rows as declared (or none are declared)."""
    if want is not None and (n := df.count()) != want:
        raise ValueError(f"{what}: expected {want} records, found {n}")
    return df
