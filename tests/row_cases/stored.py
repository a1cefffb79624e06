"""Scans, sinks, commands and resumable work: written to the shared folder, read again, and compared."""

from __future__ import annotations

import contextlib
import io
import json
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.canonical import canonical, tokenizer_identity
from pairwright.operators import agreement, evaluation, generate, guards, reports, training
from row_cases.cases import said
from row_cases.fixtures import literal
from pairwright.sources import files
from pairwright.staging import shared_dir, write_text
from pairwright.streaming import resume

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(run):  # noqa: ANN001, ANN202
        QUERIES[run.__name__] = lambda spark, sf_dir: run(spark)
        ORACLE_SQL[run.__name__] = sql
        return run

    return add


def _put(spark: SparkSession, root: str, **texts: str) -> dict[str, str]:
    paths = {name: f"{root}/{name}" for name in texts}
    for name, text in texts.items():
        write_text(spark, paths[name], text)
    return paths


def _lines(*records: dict) -> str:
    return "".join(json.dumps(r) + "\n" for r in records)


def command(spark: SparkSession, name: str, **options: object) -> None:
    from pairwright import cli

    given = {"input": None, "other": None, "third": None, "output": None, "config": None, "kind": None, "seed": 0, "pairs": 25, "limit": None, "validation_limit": None, "per_cell": 4, "init_hash": "0" * 64, "revision": "0" * 40}
    with contextlib.redirect_stdout(io.StringIO()):  # commands tell what they have written
        cli.run(spark, SimpleNamespace(command=name, **(given | options)))


# ------------------------------------------------------------------------------------- scans


@query(literal([("array", "ValueError"), ("blank", "ok"), ("broken", "ValueError"), ("empty", "ValueError"), ("good", "ok"), ("repeated", "ValueError"), ("split", "ValueError"), ("tail", "ValueError")], ("file", "outcome")))
def q_scan_errors(spark: SparkSession) -> DataFrame:
    paths = _put(spark, shared_dir(spark, "scans"), good='{"id":"a","split":"train"}\n\n', blank=" \n\t\n", broken='{"id":"a"}\n{oops\n', array="[1]\n", tail='{"id":"a"} {"id":"b"}\n', repeated='{"id":"a"}\n{"id":"a"}\n')
    scan = lambda name: said(lambda: files.read_jsonl(spark, paths[name], "id string, split string").count())
    found = [(n, scan(n)) for n in ("good", "blank", "broken", "array", "tail")]
    unique = lambda name: said(lambda: files.read_unique(spark, paths[name], "id string"))
    found += [("repeated", unique("repeated")), ("empty", unique("blank")), ("split", said(lambda: files.read_split(spark, paths["good"], "id string, split string", "test")))]
    return spark.createDataFrame(found, "file string, outcome string")


@query("SELECT 2 AS line, true AS named")
def q_scan_error_place(spark: SparkSession) -> DataFrame:
    """A broken line is told by its file and number."""
    path = _put(spark, shared_dir(spark, "scans"), broken='{"id":"a"}\n{oops\n{"id":"c"}\n')["broken"]
    try:
        files.read_jsonl(spark, path, "id string")
        line = "0"
    except ValueError as error:
        line = str(error).split("broken:")[1].split(":")[0]
    return spark.createDataFrame([(int(line), line != "0")], "line int, named boolean")


@query("""WITH d AS (SELECT unnest(['productivity', 'finance', 'weather']) AS domain), k AS (SELECT unnest(['answer', 'clarify', 'refuse', 'noop']) AS kind), i AS (SELECT range AS i FROM range(25)), v AS (SELECT unnest(['act', 'abstain']) AS variant)
SELECT printf('%s-%s-%03d-%s', domain, kind, i, variant) AS id, CASE WHEN i % 5 < 3 THEN 'train' WHEN i % 5 = 3 THEN 'validation' ELSE 'test' END AS split, true AS same FROM d, k, i, v""")
def q_stored_corpus(spark: SparkSession) -> DataFrame:
    """The generated corpus written by its command, read by the typed scan, and compared record by record with a fresh one."""
    root = shared_dir(spark, "corpus")
    command(spark, "generate-dataset", output=root)
    read = guards.union_all(*(files.read_tasks(spark, f"{root}/{s}.jsonl").drop("ord") for s in ("train", "validation", "test")))
    back = training.with_task_json(read).select("id", "split", "task_hash")
    fresh = training.with_task_json(generate.corpus(spark)).select("id", F.col("task_hash").alias("fresh"))
    return back.join(fresh, "id", "full_outer").select("id", "split", F.col("task_hash").eqNullSafe(F.col("fresh")).alias("same"))


BFCL = {"question": [[{"role": "system", "content": "s"}, {"role": "user", "content": "Add 2"}, {"role": "user", "content": "and 3"}]], "function": [{"name": "math.add", "description": "Adds.", "parameters": {"type": "dict", "properties": {"a": {"type": "float"}, "b": {"type": "tuple"}}}}]}
BFCL_TEXT = _lines(BFCL | {"id": "Simple_1"}, BFCL | {"id": "simple 2"})


@query(f"""SELECT id, 'simple' AS category, 'CALL' AS expected_decision, 'Add 2' || chr(10) || 'and 3' AS query, '{{"properties":{{"a":{{"type":"number"}},"b":{{"type":"array"}}}},"type":"object"}}' AS parameters, original, sha256('{BFCL_TEXT.replace(chr(10), "' || chr(10) || '")}') AS source_sha256
FROM (VALUES ('bfcl-simple-1', 'Simple_1'), ('bfcl-simple-2', 'simple 2')) t(id, original)""")
def q_external_scan(spark: SparkSession) -> DataFrame:
    """External call records: category by file name, ids as slugs, types rewritten, provenance."""
    path = f"{shared_dir(spark, 'external')}/BFCL_v3_simple.json"
    write_text(spark, path, BFCL_TEXT)
    rows = files.read_external(spark, path, "a" * 40, "Apache-2.0")
    return rows.select("id", "category", "expected_decision", files.user_text(F.col("messages")).alias("query"), F.col("functions")[0]["parameters"].alias("parameters"), F.col("provenance.original_id").alias("original"), F.col("provenance.source_sha256").alias("source_sha256"))


@query(literal([("a1", "CALL", "YES", "YES", "plain"), ("a2", "NOOP", "NO", "UNCERTAIN", 'with, comma and "quotes"'), ("a3", "ANSWER", "NO", "NO", "")], ("audit_id", "predicted_behavior", "semantic_correctness", "format_acceptable", "notes")))
def q_annotation_file(spark: SparkSession) -> DataFrame:
    path = shared_dir(spark, "annotations")
    rows = [("a1", "CALL", "YES", "YES", "plain"), ("a2", "NOOP", "NO", "UNCERTAIN", 'with, comma and "quotes"'), ("a3", "ANSWER", "NO", "NO", None)]
    frame = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in agreement.FIELDS))
    frame.coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    return files.read_annotations(spark, path)


@query(literal([("s/c1", "complete"), ("s/c1", "unknown environment env2"), ("s/c2", "incomplete pair"), ("s/c3", "complete"), ("s/c3", "missing task.yaml")], ("pair", "what")))
def q_paired_tree(spark: SparkSession) -> DataFrame:
    root = shared_dir(spark, "tree")
    paths = ["environments/env1/e.json", *(f"tasks/s/c1/{s}/task.yaml" for s in ("act", "abstain")), "tasks/s/c1/act/initial_states/env1.json", "tasks/s/c1/act/initial_states/env2.json", "tasks/s/c2/act/task.yaml", "tasks/s/c3/act/task.yaml", "tasks/s/c3/abstain/other.yaml", ".cache/tasks/x"]
    _put(spark, root, **{p: "x" for p in paths})
    pairs, problems = files.paired_tree(spark, root)
    return pairs.select("pair", F.lit("complete").alias("what")).unionByName(problems.select("pair", F.col("problem").alias("what")))


@query("SELECT path, sha256(text) AS sha256 FROM (VALUES ('a/x', 'hello' || chr(10)), ('b', ''), ('c/d/é', 'ß')) t(path, text)")
def q_inventory(spark: SparkSession) -> DataFrame:
    root = shared_dir(spark, "inventory")
    _put(spark, root, **{"a/x": "hello\n", "b": "", "c/d/é": "ß", ".cache/no": "x"})
    return files.inventory(spark, root).select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), "sha256")


@query(literal([("a/b", False), ("/a/b", True), ("a/TEST/b", True), ("a/tests/b", False)], ("path", "barred")))
def q_forbidden_paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in ("a/b", "/a/b", "a/TEST/b", "a/tests/b")], "path string").select("path", files.forbidden(F.col("path")).alias("barred"))


@query(literal([("document", "ok"), ("list", "ValueError"), ("outcomes", "ok"), ("outcomes lacking", "ValueError"), ("outcomes twice", "ValueError"), ("yaml", "ok"), ("yaml list", "ValueError"), ("yaml missing", "ValueError"), ("yaml type", "ValueError")], ("what", "outcome")))
def q_small_documents(spark: SparkSession) -> DataFrame:
    paths = _put(spark, shared_dir(spark, "documents"), doc='{"a":1}', list="[]", good=_lines({"task_id": "t", "correct": True, "x": 1}), lacking=_lines({"task_id": "t"}), twice=_lines({"task_id": "t", "correct": True}, {"task_id": "t", "correct": False}), yaml="seed: 1\nname: x\n", bad="- 1\n")
    fields = {"seed": int, "name": str}
    runs = {
        "document": lambda: files.read_document(spark, paths["doc"]), "list": lambda: files.read_document(spark, paths["list"]), "outcomes": lambda: files.read_correct(spark, paths["good"]), "outcomes lacking": lambda: files.read_correct(spark, paths["lacking"]),
        "outcomes twice": lambda: files.read_correct(spark, paths["twice"]), "yaml": lambda: files.load_yaml(spark, paths["yaml"], fields), "yaml list": lambda: files.load_yaml(spark, paths["bad"], fields),
        "yaml missing": lambda: files.load_yaml(spark, paths["yaml"], fields | {"more": int}), "yaml type": lambda: files.load_yaml(spark, paths["yaml"], {"seed": str, "name": str}),
    }
    return spark.createDataFrame([(name, said(run)) for name, run in runs.items()], "what string, outcome string")


# ---------------------------------------------------------------------------------- commands


@query(literal([("CALL", 60, 60), ("ANSWER", 15, 15), ("CLARIFY", 15, 15), ("REFUSE", 15, 15), ("NOOP", 15, 0)], ("label", "n", "correct")))
def q_evaluate_files(spark: SparkSession) -> DataFrame:
    """Stored tasks and predictions scored by the command: gold replies, but nothing for NOOP."""
    root = shared_dir(spark, "evaluate")
    command(spark, "generate-dataset", output=root)
    tasks = files.read_tasks(spark, f"{root}/validation.jsonl")
    reply = F.when(F.col("label") == "NOOP", "").otherwise(training.gold_text(F.col("expected")))
    predictions = tasks.select(F.col("id").alias("task_id"), reply.alias("raw_text"), F.lit(1.0).alias("latency_ms"), F.col("id").alias("o"))
    files.write_jsonl(predictions, f"{root}/predictions", "o")
    command(spark, "evaluate", input=f"{root}/validation.jsonl", other=f"{root}/predictions", output=f"{root}/scored")
    found = spark.read.schema("task_id string, correct boolean").json(f"{root}/scored/evaluations")
    return found.join(tasks.select(F.col("id").alias("task_id"), "label"), "task_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


@query(literal([("evaluation", 7, "task_id"), ("external", 5, "id"), ("pair", 2, "act"), ("prediction", 8, "task_id"), ("preference", 9, "id"), ("task", 12, "id")], ("kind", "fields", "first_")))
def q_exported_schemas(spark: SparkSession) -> DataFrame:
    root = shared_dir(spark, "schemas")
    command(spark, "export-schemas", output=root)
    found = []
    for kind in ("task", "pair", "prediction", "evaluation", "preference", "external"):
        schema = files.read_document(spark, f"{root}/{kind}.schema.json")
        found.append((kind, len(schema["properties"]), schema["required"][0]))
    return spark.createDataFrame(found, "kind string, fields int, first_ string")


def _pair_lines(spark: SparkSession) -> list[str]:
    tasks = generate.finance_tasks(spark, 1).where("pair_id = 'finance-clarify-000'")
    return [r.json for r in training.with_task_json(tasks).orderBy("id").collect()]


@query(literal([("evaluation", "ok"), ("external", "ValueError"), ("pair", "ok"), ("pair alone", "ValueError"), ("prediction", "ok"), ("prediction bad", "ValueError"), ("preference", "ok"), ("task", "ok"), ("task bad", "ValueError")], ("record", "outcome")))
def q_validated_records(spark: SparkSession) -> DataFrame:
    pair = _pair_lines(spark)
    good = {"task_id": "t-1", "raw_text": "x", "tool_call": None, "latency_ms": 1.0, "input_tokens": 1, "output_tokens": 1, "peak_memory_gb": None, "inference_error": None}
    scored = {"task_id": "t-1", "predicted_class": "CALL", "behavior_correct": True, "semantic_correct": True, "protocol_correct": True, "correct": True, "reason_code": "correct_tool_call"}
    source = {"source_kind": "internal_task", "source_task_hash": "0" * 64, "generator_version": "1.0.0", "sft_init_hash": "1" * 64, "external_sources": [], "test_consumed": False}
    preference = {"id": "pref-t-1", "task_id": "t-1", "pair_id": "t", "split": "train", "target_class": "CALL", "negative_type": "wrong_tool", "chosen": "a", "rejected": "b", "provenance": source}
    paths = _put(spark, shared_dir(spark, "records"), task=pair[1] + "\n", spoilt=pair[1].replace("-act", "-both") + "\n", pair="\n".join(pair) + "\n", prediction=_lines(good), late=_lines(good | {"latency_ms": -1.0}), evaluation=_lines(scored), preference=_lines(preference))
    runs = {"task": ("task", "task"), "task bad": ("task", "spoilt"), "pair": ("pair", "pair"), "pair alone": ("pair", "task"), "prediction": ("prediction", "prediction"), "prediction bad": ("prediction", "late"), "evaluation": ("evaluation", "evaluation"), "preference": ("preference", "preference"), "external": ("external", "evaluation")}
    return spark.createDataFrame([(name, said(lambda k=k, f=f: command(spark, "validate-record", kind=k, input=paths[f]))) for name, (k, f) in runs.items()], "record string, outcome string")


@query(literal([("data", "train", 360), ("data", "validation", 120), ("data", "test", 120), ("stress", "train", 32), ("stress", "validation", 8), ("sft", "train", 360), ("sft", "validation", 120), ("repair", "train", 392), ("repair", "validation", 128), ("prefs", "train", 360), ("prefs", "validation", 120), ("dpo", "train", 24), ("dpo", "validation", 120)], ("made", "split", "n")))
def q_built_sets(spark: SparkSession) -> DataFrame:
    """Every data command after the one it needs; the counts are those of the manifests."""
    root = shared_dir(spark, "built")
    at = {name: f"{root}/{name}" for name in ("data", "stress", "sft", "repair", "prefs", "dpo")}
    command(spark, "generate-dataset", output=at["data"])
    command(spark, "generate-protocol-stress", output=at["stress"])
    command(spark, "build-sft", input=at["data"], output=at["sft"])
    command(spark, "build-protocol-repair-sft", input=at["sft"], other=at["stress"], output=at["repair"])
    command(spark, "build-preferences", input=at["data"], output=at["prefs"])
    command(spark, "prepare-dpo", input=at["data"], other=at["prefs"], limit=24, output=at["dpo"])
    found = []
    for name, path in at.items():
        manifest = files.read_document(spark, f"{path}/manifest.json")
        found += [(name, k.removesuffix("_count"), v) for k, v in manifest.items() if k.removesuffix("_count") in ("train", "validation", "test") and isinstance(v, int) and not isinstance(v, bool)]
    return spark.createDataFrame(found, "made string, split string, n int")


@query(literal([("clean", "ok"), ("consumed", "ValueError"), ("web", "ValueError"), ("without", "error")], ("base", "outcome")))
def q_repair_provenance(spark: SparkSession) -> DataFrame:
    """The repair command takes only bases whose manifest says that they are generated and saw no test rows."""
    root = shared_dir(spark, "repair")
    command(spark, "generate-protocol-stress", output=f"{root}/stress")
    row = {"id": "t-1", "messages": [{"role": "user", "content": "x"}], "tools": []}
    good = {"source_kind": "internal_generated", "external_sources": [], "test_consumed": False}
    found = []
    for name, manifest in (("clean", good), ("consumed", good | {"test_consumed": True}), ("web", good | {"external_sources": ["web"]}), ("without", None)):
        _put(spark, f"{root}/{name}", **{f"{s}.jsonl": _lines(row | {"id": f"{s}-1"}) for s in ("train", "validation")}, **({"manifest.json": canonical(manifest)} if manifest else {}))
        try:
            outcome = said(lambda n=name: command(spark, "build-protocol-repair-sft", input=f"{root}/{n}", other=f"{root}/stress", output=f"{root}/{n}-out"))
        except Exception:  # noqa: BLE001  there is no file
            outcome = "error"
        found.append((name, outcome))
    return spark.createDataFrame(found, "base string, outcome string")


@query(literal([("items", 60), ("blank rows", 60), ("mapped", 60), ("manifest items", 60), ("cells of 4", 15)], ("what", "n")))
def q_calibration_export(spark: SparkSession) -> DataFrame:
    """Page, mapping, blank annotations and manifest of a blinded sample, by the command."""
    root = shared_dir(spark, "calibration")
    command(spark, "generate-dataset", output=root)
    tasks = files.read_tasks(spark, f"{root}/validation.jsonl")
    files.write_jsonl(tasks.select(F.col("id").alias("task_id"), F.lit("x").alias("raw_text"), F.lit(1.0).alias("latency_ms"), F.col("id").alias("o")), f"{root}/predictions", "o")
    command(spark, "export-calibration", input=f"{root}/validation.jsonl", other=f"{root}/predictions", output=f"{root}/packet")
    page = spark.read.text(f"{root}/packet/annotate.html", wholetext=True).first()[0]
    mapping = files.read_jsonl(spark, f"{root}/packet/mapping", "audit_id string, task_id string")
    cells = mapping.join(tasks, mapping.task_id == tasks.id).groupBy("domain", "label").count().where("count = 4").count()
    blank = files.read_annotations(spark, f"{root}/packet/annotations.blank")
    rows = [("items", page.count('"audit_id":"audit-')), ("blank rows", blank.where("predicted_behavior is null or predicted_behavior = ''").count()), ("mapped", mapping.count()), ("manifest items", files.read_document(spark, f"{root}/packet/manifest.json")["item_count"]), ("cells of 4", cells)]
    return spark.createDataFrame(rows, "what string, n int")


ANALYSIS = [("base", "internal-validation", "baseline", [True, False, False, True], 0.5), ("trained", "internal-validation", "selected", [True, True, True, True], 1.0)]


@query(literal([("accuracy base", 0.5), ("accuracy trained", 1.0), ("difference", 0.5), ("tasks base", 4.0), ("tasks compared", 4.0), ("tasks trained", 4.0), ("held out", 0.0)], ("what", "value")))
def q_final_analysis(spark: SparkSession) -> DataFrame:
    """Comparison rows and a paired bootstrap of stored metrics and evaluations."""
    root, experiments = shared_dir(spark, "analysis"), []
    for name, split, status, right, accuracy in ANALYSIS:
        _put(spark, root, **{f"{name}/metrics.json": canonical({"accuracy": accuracy}), f"{name}/evaluations.jsonl": _lines(*({"task_id": f"t{i}", "correct": r} for i, r in enumerate(right)))})
        experiments.append({"id": name, "family": "1.5b", "method": name, "split": split, "status": status, "metrics": f"{name}/metrics.json", "evaluations": f"{name}/evaluations.jsonl"})
    found = reports.final_analysis(spark, {"experiments": experiments, "paired_comparisons": [{"id": "gain", "baseline": "base", "candidate": "trained"}], "bootstrap_samples": 200}, root)
    rows = [(f"{k} {r['id']}", float(r[c])) for r in found["rows"] for k, c in (("accuracy", "accuracy"), ("tasks", "task_count"))]
    gain = found["paired_bootstrap"]["gain"]
    rows += [("difference", gain["difference"]), ("tasks compared", float(gain["task_count"])), ("held out", float(found["held_out_test_opened"]))]
    return spark.createDataFrame(rows, "what string, value double")


@query(literal([("whole", "ok"), ("artifact", "ValueError"), ("input", "ValueError"), ("attested", "ValueError"), ("barred", "ValueError"), ("empty", "ValueError"), ("lacking", "ValueError")], ("release", "outcome")))
def q_release_audit(spark: SparkSession) -> DataFrame:
    """The audit of a release, whole and spoilt in each way."""
    import hashlib

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    summary = {"inputs": [{"path": "r/in.json", "sha256": sha("in")}], "held_out_test_opened": False, "external_data_used_for_training": False}

    def release(name: str, manifest: dict | None = None, told: dict | None = None, **texts: str) -> str:
        root = shared_dir(spark, f"release-{name}")
        given = {"artifacts": {"a.csv": sha("rows")}, "config_sha256": sha("config")} if manifest is None else manifest
        _put(spark, root, **{"reports/final/a.csv": "rows", "configs/analysis/final.yaml": "config", "r/in.json": "in", "reports/final/manifest.json": canonical(given), "reports/final/summary.json": canonical(summary | (told or {}))} | texts)
        return said(lambda: reports.audit(spark, root, ["reports/final/manifest.json", *(["LICENSE"] if name == "lacking" else [])]))

    barred = {"inputs": [{"path": "r/test/in.json", "sha256": sha("in")}]}
    rows = [
        ("whole", release("whole")), ("artifact", release("artifact", **{"reports/final/a.csv": "other"})), ("input", release("input", **{"r/in.json": "other"})), ("attested", release("attested", told={"held_out_test_opened": True})),
        ("barred", release("barred", told=barred, **{"r/test/in.json": "in"})), ("empty", release("empty", manifest={"artifacts": {}, "config_sha256": sha("config")})), ("lacking", release("lacking")),
    ]
    return spark.createDataFrame(rows, "release string, outcome string")


# --------------------------------------------------------------------------------- resumption


def _backend():  # noqa: ANN202
    def predict(row: dict) -> dict:
        if "002" in row["id"] and row["id"].endswith("act"):
            raise RuntimeError("no")
        return {"raw_text": f"said {row['id']}", "latency_ms": 1.0}

    return predict


@query("""WITH k AS (SELECT unnest(['answer', 'clarify', 'refuse', 'noop']) AS kind), i AS (SELECT range AS i FROM range(3)), v AS (SELECT unnest(['act', 'abstain']) AS variant), t AS (SELECT printf('finance-%s-%03d-%s', kind, i, variant) AS task_id FROM k, i, v)
SELECT task_id, CASE WHEN task_id LIKE '%002-act' THEN '' ELSE 'said ' || task_id END AS raw_text, CASE WHEN task_id LIKE '%002-act' THEN 'RuntimeError: no' END AS inference_error FROM t""")
def q_resumed_predictions(spark: SparkSession) -> DataFrame:
    """Predictions of 24 tasks in three goes, each of which computes only what is left; failures count as done."""
    tasks, path = generate.finance_tasks(spark, 3).withColumn("ord", F.monotonically_increasing_id()), shared_dir(spark, "predictions")
    resume.resume(tasks, _backend, path, limit=5)
    resume.resume(tasks, _backend, path)
    found = resume.resume(tasks, _broken_backend, path)  # nothing is left for it
    return found.select("task_id", "raw_text", "inference_error")


def _broken_backend():  # noqa: ANN202
    raise AssertionError("there is nothing to compute")


@query(literal([("foreign", "ValueError"), ("repeated", "ValueError"), ("whole", "ok")], ("output", "outcome")))
def q_resume_refusals(spark: SparkSession) -> DataFrame:
    tasks = spark.createDataFrame([("a", 0), ("b", 1)], "id string, ord long")
    found = []
    for name, ids in (("whole", "a"), ("foreign", "ax"), ("repeated", "aa")):
        path = shared_dir(spark, f"resume-{name}")
        spark.createDataFrame([(i, "x", None, 0.0, None, None, None, None) for i in ids], evaluation.PREDICTION).write.parquet(path)
        found.append((name, said(lambda p=path: resume.resume(tasks, _backend, p))))
    return spark.createDataFrame(found, "output string, outcome string")


@query("SELECT 'p' || range AS task_id, 'said p' || range AS raw_text FROM range(10)")
def q_resumed_prompts(spark: SparkSession) -> DataFrame:
    """Generic prompts (id, messages) take the same way as tasks."""
    prompts = spark.range(10).select(F.concat(F.lit("p"), "id").alias("id"), F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))).alias("messages"))
    path = shared_dir(spark, "prompts")
    resume.resume_prompts(prompts, _backend, path, limit=4)
    return resume.resume_prompts(prompts, _backend, path).select("task_id", "raw_text")


@query("""WITH k AS (SELECT unnest(['answer', 'clarify', 'refuse', 'noop']) AS kind), i AS (SELECT range AS i FROM range(2)), v AS (SELECT unnest(['act', 'abstain']) AS variant)
SELECT printf('finance-%s-%03d-%s', kind, i, variant) AS task_id, 1 AS times FROM k, i, v""")
def q_streamed_predictions(spark: SparkSession) -> DataFrame:
    """A stream of tasks that brings every task twice, in several batches: each is predicted once."""
    root = shared_dir(spark, "stream")
    tasks = generate.finance_tasks(spark, 2).select("id", "query")
    for _ in range(2):
        tasks.write.mode("append").parquet(f"{root}/in")
    for _ in range(2):  # the second run finds its checkpoint and adds nothing
        source = spark.readStream.schema(tasks.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        resume.stream(source, _backend, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("task_id").agg(F.count("*").cast("int").alias("times"))


@query(literal([("a", -1.0, -2.0, 1, 2), ("b", -2.0, -4.0, 2, 4)], ("id", "chosen_logp", "rejected_logp", "chosen_tokens", "rejected_tokens")))
def q_reference_cache(spark: SparkSession) -> DataFrame:
    """Reference log-probabilities of examples by a scorer, cached once and checked against their examples."""

    def scorer():  # noqa: ANN202
        return lambda prompt, reply: (-float(len(reply)), len(reply))

    examples = spark.createDataFrame([("a", [("user", "x")], "1", "22", "h1"), ("b", [("user", "x")], "33", "4444", "h2")], "id string, messages array<struct<role:string,content:string>>, chosen string, rejected string, example_hash string")
    path = shared_dir(spark, "reference")
    resume.reference_cache(examples.limit(1), scorer, path)
    cached = resume.reference_cache(examples, scorer, path)
    guards.strict(cached, training.reference_problems(examples, cached), "the cache is not of these examples")
    return cached.select("id", "chosen_logp", "rejected_logp", "chosen_tokens", "rejected_tokens")


IDENTITIES = [(1, "Fast", "{% x %}", 7), (2, "Fast", None, 7), (3, "Slow", 'a "b"', None)]


@query("""SELECT i, sha256('{"chat_template":' || t || ',"class":"' || c || '","eos_token_id":' || e || '}') AS identity FROM (VALUES (1, '"{% x %}"', 'Fast', '7'), (2, 'null', 'Fast', '7'), (3, '"a \\"b\\""', 'Slow', 'null')) v(i, t, c, e)""")
def q_tokenizer_identity(spark: SparkSession) -> DataFrame:
    """The hash of a tokenizer's class, chat template and end id."""
    rows = spark.createDataFrame(IDENTITIES, "i int, kind string, template string, end_id long")
    return rows.select("i", tokenizer_identity(F.col("kind"), F.col("template"), F.col("end_id")).alias("identity"))


@query(literal([("same", ""), ("older", "transformers"), ("lacking", "torch")], ("run", "differs")))
def q_version_guard(spark: SparkSession) -> DataFrame:
    """Recorded versions of a run against those wanted."""
    wanted = {"torch": "2.1", "transformers": "4.40"}
    runs = {"same": wanted, "older": wanted | {"transformers": "4.39"}, "lacking": {"transformers": "4.40"}}
    rows = spark.createDataFrame([(n, v) for n, v in runs.items()], "run string, versions map<string,string>")
    return rows.select("run", F.array_join(guards.version_gaps(F.col("versions"), wanted), ",").alias("differs"))


