"""Commands over files: python -m pairwright.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType, _parse_datatype_string

from pairwright.functions.canonical import canonical, content_hash, digest, json_string, ordered_digest
from pairwright.functions.text import LABELS, fold
from pairwright.functions.tools import TOOL
from pairwright.operators import agreement, contracts, evaluation, generate, malformed, metrics, overlap, reports, sampling, training
from pairwright.operators.evaluation import PREDICTION
from pairwright.operators.generate import TASK
from pairwright.operators.guards import common, count_map, duplicates, leaks, strict
from pairwright.sources import files
from pairwright.staging import write_text

EVALUATION = "task_id string, predicted_class string, behavior_correct boolean, semantic_correct boolean, protocol_correct boolean, correct boolean, reason_code string"
EXTERNAL = "id string, category string, expected_decision string, messages array<struct<role:string,content:string>>, functions array<struct<name:string,description:string,parameters:string>>"
PREFERENCE = "id string, task_id string, pair_id string, split string, target_class string, negative_type string, chosen string, rejected string, provenance struct<source_kind:string,source_task_hash:string,generator_version:string,sft_init_hash:string,external_sources:array<string>,test_consumed:boolean>"
#: Kinds of records that are validated and whose schemas are exported; a pair is its two tasks.
KINDS = {"task": TASK, "pair": TASK, "prediction": PREDICTION, "evaluation": EVALUATION, "preference": PREFERENCE}
#: Commands that need a model, a trainer or the network; they say so and stop.
ELSEWHERE = ("train-sft", "train-dpo", "cache-dpo-reference", "fetch-external", "infer", "infer-external")


def _tasks(spark: SparkSession, path: str) -> DataFrame:
    return files.read_tasks(spark, path)


def _predictions(spark: SparkSession, path: str) -> DataFrame:
    return files.read_jsonl(spark, path, PREDICTION).drop("ord")


def _out(df: DataFrame, path: str, order: str) -> None:
    files.write_jsonl(df.withColumn("_o", F.col(order)), path, "_o")


def _write_tasks(tasks: DataFrame, path: str) -> None:
    rows = training.with_task_json(tasks).select("id", "json")
    rows.repartitionByRange(1, "id").sortWithinPartitions("id").select("json").write.mode("overwrite").text(path)  # a generated corpus is a few hundred rows


def _show(df: DataFrame) -> None:
    """Print a report: aggregates of a row or a few."""
    for row in df.toLocalIterator():
        print(canonical(row.asDict(recursive=True)))


def _manifest(spark: SparkSession, output: str, **fields: object) -> None:
    """manifest.json beside what a command has written, and on the screen."""
    text = files.manifest(schema_version=1, **fields)
    write_text(spark, f"{output}/manifest.json", text)
    print(text, end="")


def _written(spark: SparkSession, output: str, **paths: str) -> dict:
    """Count and content hash of each file that was written, as manifest fields."""
    found = {}
    for name, path in paths.items():
        lines = spark.read.text(f"{output}/{path}")
        found |= {f"{name}_count": lines.count(), f"{name}_hash": content_hash(lines, "value")}
    return found


def _config(a: argparse.Namespace) -> str:
    return digest({"seed": a.seed, "pairs": a.pairs, "generator_version": generate.VERSION})


def _both(spark: SparkSession, root: str) -> DataFrame:
    """Tasks of train and validation, each file of its own split only."""
    found = []
    for split in contracts.SPLITS[:2]:
        rows = _tasks(spark, f"{root}/{split}.jsonl").drop("ord")
        found.append(strict(rows, rows.where(F.col("split") != split).select("id"), f"tasks of another split in {split}"))
    return strict(found[0].unionByName(found[1]), duplicates(found[0].unionByName(found[1]), "id"), "a task id stands twice")


#: What the manifests of generated data attest.
INTERNAL = {"source_kind": "internal_generated", "external_sources": [], "test_consumed": False}
#: Constraints on fields that the exported schemas tell beside their types.
SLUG = {"pattern": "^[a-z0-9][a-z0-9._-]*$"}
CONSTRAINTS = {
    "task": {"id": SLUG, "pair_id": SLUG, "domain": SLUG, "split": {"enum": list(contracts.SPLITS)}, "variant": {"enum": ["act", "abstain"]}, "label": {"enum": list(LABELS)}, "query": {"minLength": 1}},
    "prediction": {"task_id": SLUG, "latency_ms": {"minimum": 0}, "input_tokens": {"minimum": 0}, "output_tokens": {"minimum": 0}, "peak_memory_gb": {"minimum": 0}},
    "evaluation": {"reason_code": SLUG},
    "preference": {"split": {"enum": ["train", "validation"]}, "negative_type": {"enum": list(contracts.NEGATIVES)}},
    "external": {"id": SLUG, "expected_decision": {"enum": ["CALL", "ABSTAIN"]}, "category": {"enum": ["simple", "irrelevance"]}},
}


def json_schema(kind: DataType, rules: dict | None = None) -> dict:
    """JSON Schema of a Spark type; rules add constraints to the fields of a struct."""
    if isinstance(kind, StructType):
        fields = {f.name: json_schema(f.dataType) | (rules or {}).get(f.name, {}) for f in kind.fields}
        return {"type": "object", "properties": fields, "required": [f.name for f in kind.fields], "additionalProperties": False}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    return {"type": {"string": "string", "boolean": "boolean", "double": "number", "bigint": "integer", "int": "integer"}[kind.simpleString()]}


def run(spark: SparkSession, a: argparse.Namespace) -> None:  # noqa: C901
    name = a.command
    if name in ELSEWHERE:
        raise ValueError(f"{name} needs a model, a trainer or a network, which this engine leaves to others")
    if name == "validate-config":
        import yaml

        if not isinstance(yaml.safe_load(spark.read.text(a.config, wholetext=True).first()[0]), dict):
            raise ValueError("a configuration is a mapping")
    elif name == "export-schemas":
        for kind, ddl in (KINDS | {"external": EXTERNAL}).items():
            schema = json_schema(_parse_datatype_string(ddl), CONSTRAINTS["task" if kind == "pair" else kind])
            if kind == "pair":
                schema = {"type": "object", "properties": {"act": schema, "abstain": schema}, "required": ["act", "abstain"], "additionalProperties": False}
            write_text(spark, f"{a.output}/{kind}.schema.json", canonical(schema) + "\n")
    elif name == "validate-record":
        if a.kind not in KINDS:
            raise ValueError(f"kinds of records are {', '.join(KINDS)}")
        if a.kind in ("task", "pair"):  # a pair is given as its two tasks
            rows = contracts.tasks(_tasks(spark, a.input))
            rows = rows.select("violations").unionByName(contracts.pairs(rows.drop("violations", "ord")).select("violations")) if a.kind == "pair" else rows
        else:
            check = {"prediction": contracts.predictions, "evaluation": contracts.evaluations, "preference": contracts.preferences}[a.kind]
            rows = check(files.read_jsonl(spark, a.input, KINDS[a.kind]))
        bad = rows.where("size(violations) > 0").select("violations").limit(1).collect()
        if bad:
            raise ValueError(f"record breaks {bad[0].violations}")
    elif name == "generate-productivity":
        _write_tasks(generate.productivity_tasks(spark, a.seed, a.pairs), f"{a.output}/tasks.jsonl")
        _manifest(spark, a.output, generator="productivity", generator_version=generate.VERSION, seed=a.seed, pair_count=4 * a.pairs, config_hash=_config(a), **_written(spark, a.output, task="tasks.jsonl"))
    elif name == "generate-dataset":
        every = generate.corpus(spark, a.seed, a.pairs)
        strict(every, leaks(every, fold(F.col("query"))), "a query stands in several splits")
        strict(every, contracts.pairs(every).where("size(violations) > 0").select("pair_id", "violations"), "generated pairs break their contract")
        for split in contracts.SPLITS:
            _write_tasks(every.where(F.col("split") == split), f"{a.output}/{split}.jsonl")
        _manifest(spark, a.output, generator="full", generator_version=generate.VERSION, seed=a.seed, pair_count=12 * a.pairs, config_hash=_config(a), **_written(spark, a.output, **{s: f"{s}.jsonl" for s in contracts.SPLITS}))
    elif name == "generate-protocol-stress":
        every = generate.protocol_tasks(spark, a.seed)
        for split in contracts.SPLITS[:2]:
            _write_tasks(every.where(F.col("split") == split), f"{a.output}/{split}.jsonl")
        _manifest(spark, a.output, generator_version=generate.VERSION, config_hash=_config(a), **INTERNAL, **_written(spark, a.output, train="train.jsonl", validation="validation.jsonl"))
    elif name == "build-sft":
        for split in contracts.SPLITS[:2]:
            _out(training.sft_examples(_tasks(spark, f"{a.input}/{split}.jsonl"), split), f"{a.output}/{split}.jsonl", "id")
        source = {"formatter_version": training.FORMATTER_VERSION, "system_prompt_hash": digest(training.SYSTEM), "source_splits": list(contracts.SPLITS[:2])}
        _manifest(spark, a.output, **source, **INTERNAL, **_written(spark, a.output, train="train.jsonl", validation="validation.jsonl"))
    elif name == "build-protocol-repair-sft":
        for root in (a.input, a.other):
            contracts.internal_only(files.read_document(spark, f"{root}/manifest.json"))
        shape = f"id string, messages array<struct<role:string,content:string>>, tools array<{TOOL}>"
        for split in contracts.SPLITS[:2]:
            base = files.read_jsonl(spark, f"{a.input}/{split}.jsonl", shape).drop("ord")
            more = training.sft_examples(_tasks(spark, f"{a.other}/{split}.jsonl"), split)
            strict(base, common(base, more, "id"), "example ids stand on both sides")
            _out(base.unionByName(more), f"{a.output}/{split}.jsonl", "id")
        _manifest(spark, a.output, formatter_version=training.FORMATTER_VERSION, source_splits=list(contracts.SPLITS[:2]), **INTERNAL, **_written(spark, a.output, train="train.jsonl", validation="validation.jsonl"))
    elif name == "build-preferences":
        prefs = training.preferences(_both(spark, a.input), a.init_hash)
        for split in contracts.SPLITS[:2]:
            _out(prefs.where(F.col("split") == split), f"{a.output}/{split}.jsonl", "id")
        kinds = {f"{k}_distribution": count_map(prefs, c).first().counts for k, c in (("negative", "negative_type"), ("class", "target_class"))}
        _manifest(spark, a.output, sft_init_hash=a.init_hash, **INTERNAL, **kinds, **_written(spark, a.output, train="train.jsonl", validation="validation.jsonl"))
    elif name == "prepare-dpo":
        tasks = _both(spark, a.input)
        limits = {"train": a.limit, "validation": a.validation_limit}
        for split in contracts.SPLITS[:2]:
            prefs = files.read_jsonl(spark, f"{a.other}/{split}.jsonl", PREFERENCE).drop("ord")
            strict(prefs, prefs.where(F.col("split") != split).select("id"), f"preferences of another split in {split}")
            strict(prefs, training.checked(prefs, tasks).where("size(violations) > 0").select("id", "violations"), "preferences break their contract")
            _out(training.dpo_examples(prefs, tasks, a.init_hash, limits[split]), f"{a.output}/{split}.jsonl", "id")
        _manifest(spark, a.output, formatter_version=training.FORMATTER_VERSION, sft_init_hash=a.init_hash, **INTERNAL, **_written(spark, a.output, train="train.jsonl", validation="validation.jsonl"))
    elif name == "prepare-external":
        records = files.read_external(spark, a.input, a.revision, "Apache-2.0").withColumn("query", files.user_text(F.col("messages")))
        internal = None
        for i, split in enumerate(contracts.SPLITS):
            one = _tasks(spark, f"{a.other}/{split}.jsonl").select("id", "query", "split", (F.col("ord") + i * 1_000_000_000).alias("ord"))
            internal = one if internal is None else internal.unionByName(one)
        kept, report = overlap.quarantine(records, internal)
        _out(kept, f"{a.output}/records", "id")
        _out(report, f"{a.output}/quarantine", "external_id")
    elif name == "audit-pairs":
        for row in reports.pair_audit(_tasks(spark, a.input)).toLocalIterator():
            print(row.text)
    elif name == "evaluate":
        tasks, preds = _tasks(spark, a.input), _predictions(spark, a.other)
        found = evaluation.evaluate(tasks, preds)
        some = tasks.join(found.select(F.col("task_id").alias("id")), "id", "left_semi")
        _out(found, f"{a.output}/evaluations", "task_id")
        _show(metrics.compute_metrics(some, found)[0])
    elif name == "evaluate-external":
        found = evaluation.evaluate_external(files.read_jsonl(spark, a.input, EXTERNAL), _predictions(spark, a.other))
        _out(found, f"{a.output}/evaluations", "task_id")
        _show(metrics.external_metrics(found))
    elif name == "analyze-malformed":
        _show(malformed.compared(_predictions(spark, a.input), _predictions(spark, a.other)))
    elif name == "export-calibration":
        packet = reports.calibration_packet(_tasks(spark, a.input), _predictions(spark, a.other), a.per_cell)
        _out(packet.select("audit_id", "task_id"), f"{a.output}/mapping", "audit_id")
        blank = packet.select(*(F.col(f) if f == "audit_id" else F.lit("").alias(f) for f in agreement.FIELDS))
        files.write_csv(blank.coalesce(1), f"{a.output}/annotations.blank")
        write_text(spark, f"{a.output}/annotate.html", reports.packet_page(packet))
        chosen = packet.agg(ordered_digest(json_string(F.col("task_id")), F.col("audit_id")).alias("ids"), F.count("*").alias("n")).first()
        _manifest(spark, a.output, item_count=chosen.n, per_domain_class_cell=a.per_cell, selection_hash=chosen.ids)
    elif name == "validate-calibration":
        rows = files.read_annotations(spark, a.input)
        strict(rows, agreement.annotation_problems(rows, files.read_jsonl(spark, a.other, "audit_id string, task_id string")), "bad annotations")
        _show(agreement.annotation_summary(rows))
    elif name == "calibration-agreement":
        _show(agreement.annotator_agreement(files.read_annotations(spark, a.input), files.read_annotations(spark, a.other)))
    elif name == "compare-calibration":
        rows = agreement.judged(files.read_annotations(spark, a.input), files.read_jsonl(spark, a.other, "audit_id string, task_id string").drop("ord"), files.read_jsonl(spark, a.third, EVALUATION).drop("ord"))
        _show(agreement.evaluator_agreement(rows))
    elif name == "build-final-analysis":
        import yaml

        config = yaml.safe_load(spark.read.text(a.config, wholetext=True).first()[0])
        print(canonical(reports.final_analysis(spark, config, a.input)))
    elif name == "release-audit":
        print(canonical(reports.audit(spark, a.input, ["reports/final/manifest.json", "reports/final/summary.json"])))
    elif name == "select-smoke":
        _out(sampling.smoke_pairs(_tasks(spark, a.input)), a.output, "id")


COMMANDS = (
    "validate-config", "export-schemas", "validate-record", "generate-productivity", "generate-dataset", "build-sft", "generate-protocol-stress", "build-protocol-repair-sft", "build-preferences",
    "prepare-dpo", "prepare-external", "audit-pairs", "evaluate", "export-calibration", "validate-calibration", "calibration-agreement", "compare-calibration", "evaluate-external",
    "analyze-malformed", "build-final-analysis", "release-audit", "select-smoke", *ELSEWHERE,
)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pairwright")
    parser.add_argument("command", choices=COMMANDS)
    for option in ("--input", "--other", "--third", "--output", "--config", "--kind"):
        parser.add_argument(option)
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--pairs", type=int, default=25)
    parser.add_argument("--limit", type=int)
    parser.add_argument("--validation-limit", type=int)
    parser.add_argument("--per-cell", type=int, default=4)
    parser.add_argument("--init-hash", default="0" * 64)
    parser.add_argument("--revision", default="0" * 40)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("pairwright").getOrCreate()
    try:
        run(spark, args)
    except (OSError, ValueError, PySparkException) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
