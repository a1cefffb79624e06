import json

import pytest
from pyspark.sql import functions as F

from pairwright import cli
from pairwright.operators import contracts, generate, training
from pairwright.sources import files


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("built")
    assert cli.main(["generate-dataset", "--output", str(root / "data")]) == 0
    return root


def test_generated_files_read_back(spark, built):
    tasks = files.read_tasks(spark, str(built / "data" / "validation.jsonl")).cache()
    assert tasks.count() == 120
    assert contracts.tasks(tasks).where("size(violations) > 0").isEmpty()
    fresh = training.with_task_json(generate.corpus(spark).where("split = 'validation'")).select("id", "task_hash")
    assert training.with_task_json(tasks.drop("ord")).select("id", "task_hash").exceptAll(fresh).isEmpty()


def test_numeric_validators_read_back(spark, tmp_path):
    row = training.task_dict({"tools": [], "environment": "{}", "expected": {"kind": "ANSWER", "validator": {"kind": "numeric", "num_value": 1.5, "absolute_tolerance": 0.1, "unit": None}}} | dict.fromkeys(training.FLAT, "x"))
    (tmp_path / "t.jsonl").write_text(json.dumps(row) + "\n")
    v = files.read_tasks(spark, str(tmp_path / "t.jsonl")).first().expected.validator
    assert (v.num_value, v.value, v.absolute_tolerance) == (1.5, None, 0.1)


def test_evaluate_command(spark, built, capsys):
    tasks = files.read_tasks(spark, str(built / "data" / "validation.jsonl"))
    said = tasks.select(F.col("id").alias("task_id"), training.gold_text(F.col("expected")).alias("raw_text"), F.lit(1.0).alias("latency_ms"))
    files.write_jsonl(said.withColumn("o", F.col("task_id")), str(built / "preds"), "o")
    assert cli.main(["evaluate", "--input", str(built / "data" / "validation.jsonl"), "--other", str(built / "preds"), "--output", str(built / "scored")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["accuracy"] == 1.0
    assert spark.read.text(str(built / "scored" / "evaluations")).count() == 120


def test_other_commands(built, capsys):
    data = built / "data"
    assert cli.main(["build-sft", "--input", str(data), "--output", str(built / "sft")]) == 0
    assert cli.main(["build-preferences", "--input", str(data), "--output", str(built / "prefs")]) == 0
    assert cli.main(["audit-pairs", "--input", str(data / "test.jsonl")]) == 0
    assert "changes=tools" in capsys.readouterr().out
    assert cli.main(["export-calibration", "--input", str(data / "validation.jsonl"), "--other", str(built / "preds"), "--output", str(built / "cal")]) == 0


def test_errors_are_status_two(built, capsys):
    assert cli.main(["train-sft"]) == 2
    assert cli.main(["evaluate", "--input", str(built / "data" / "test.jsonl"), "--other", str(built / "preds"), "--output", str(built / "x")]) == 2
    assert "error:" in capsys.readouterr().err


def test_gates(spark):
    good = {"source_kind": "internal_generated", "external_sources": [], "test_consumed": False}
    assert contracts.internal_only(good) == good
    for key, bad in (("source_kind", "web"), ("external_sources", ["x"]), ("test_consumed", True)):
        with pytest.raises(ValueError):
            contracts.internal_only(good | {key: bad})
    with pytest.raises(ValueError):
        contracts.expected_count(spark.range(3), 4, "file")
