import json

import pytest
from pyspark.sql import functions as F

from pairwright.operators import generate
from pairwright.sources import files
from pairwright.streaming import resume


def test_jsonl_round_trip_and_errors(spark, tmp_path):
    rows = spark.createDataFrame([(2, "é", [1.5]), (1, "b", [])], "ord int, s string, xs array<double>")
    files.write_jsonl(rows, str(tmp_path / "out"), "ord")
    back = files.read_jsonl(spark, str(tmp_path / "out"), "s string, xs array<double>")
    assert sorted((r.s, r.xs) for r in back.collect()) == [("b", []), ("é", [1.5])]
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == '{"s":"b","xs":[]}\n{"s":"é","xs":[1.5]}\n'
    (tmp_path / "blank.jsonl").write_text("\n  \n")
    assert files.read_jsonl(spark, str(tmp_path / "blank.jsonl"), "a int").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n{bad\n')
    with pytest.raises(ValueError, match=r"bad\.jsonl:2:"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int")
    (tmp_path / "list.jsonl").write_text("[1]\n")
    with pytest.raises(ValueError, match=":1:"):
        files.read_jsonl(spark, str(tmp_path / "list.jsonl"), "a int")


def test_file_hash_and_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".cache").mkdir()
    (tmp_path / "a" / "x").write_text("hello\n")
    (tmp_path / ".cache" / "y").write_text("no")
    rows = files.inventory(spark, str(tmp_path)).collect()
    assert [(r.path, r.sha256[:8], r.sha256[-4:]) for r in rows] == [("a/x", "5891b5b5", "be03")]
    wanted = spark.createDataFrame([("a/x", rows[0].sha256), ("a/z", "0")], "path string, sha256 string")
    assert [r.path for r in files.hash_mismatches(spark, str(tmp_path), wanted).collect()] == ["a/z"]
    assert [r.x for r in spark.createDataFrame([("/a",), ("a/Test/b",), ("a/b",)], "p string").select(files.forbidden(F.col("p")).alias("x")).collect()] == [True, True, False]


def test_external_scan(spark, tmp_path):
    row = {"id": "Simple_1", "question": [[{"role": "user", "content": "hi"}]], "function": [{"name": "F.x", "description": "d", "parameters": {"type": "dict", "properties": {"a": {"type": "float"}}}}]}
    (tmp_path / "BFCL_v3_simple.json").write_text(json.dumps(row) + "\n")
    got = files.read_external(spark, str(tmp_path / "BFCL_v3_simple.json"), "0" * 40, "Apache-2.0").first()
    assert (got.id, got.category, got.expected_decision) == ("bfcl-simple-1", "simple", "CALL")
    assert json.loads(got.functions[0].parameters) == {"type": "object", "properties": {"a": {"type": "number"}}}
    (tmp_path / "other.json").write_text(json.dumps(row) + "\n")
    with pytest.raises(ValueError):
        files.read_external(spark, str(tmp_path / "other.json"), "0" * 40, "Apache-2.0")


def test_paired_tree(spark, tmp_path):
    for side in ("act", "abstain"):
        d = tmp_path / "tasks" / "s" / "c1" / side
        (d / "initial_states").mkdir(parents=True)
        (d / "task.yaml").write_text("x")
        (d / "initial_states" / "env1.json").write_text("{}")
    (tmp_path / "tasks" / "s" / "c2" / "act").mkdir(parents=True)
    (tmp_path / "tasks" / "s" / "c2" / "act" / "task.yaml").write_text("x")
    (tmp_path / "environments" / "env1").mkdir(parents=True)
    (tmp_path / "environments" / "env1" / "e").write_text("x")
    pairs, problems = files.paired_tree(spark, str(tmp_path))
    assert [r.pair for r in pairs.collect()] == ["s/c1"]
    assert [(r.pair, r.problem) for r in problems.collect()] == [("s/c2", "incomplete pair")]


def backend():
    def predict(row):
        if row["id"].endswith("act") and "002" in row["id"]:
            raise RuntimeError("no")
        return {"raw_text": "said " + row["id"], "latency_ms": 1.0}

    return predict


def test_resume_adds_nothing_twice(spark, tmp_path):
    tasks = generate.finance_tasks(spark, 3).withColumn("ord", F.monotonically_increasing_id())
    path = str(tmp_path / "out")
    first = resume.resume(tasks, backend, path, limit=5).collect()
    assert len(first) == 5
    with pytest.raises(ValueError):
        resume.resume(tasks, backend, path, limit=2)
    every = resume.resume(tasks, backend, path)
    assert every.count() == 24 and every.where("inference_error = 'RuntimeError: no'").count() == 4
    before = spark.read.parquet(path).count()
    assert resume.resume(tasks, backend, path).count() == before == 24


def test_stream_is_idempotent(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    tasks = generate.finance_tasks(spark, 2).select("id", "query")
    tasks.write.parquet(source)
    for run in range(2):
        frame = spark.readStream.schema(tasks.schema).parquet(source)
        resume.stream(frame, backend, out, str(tmp_path / f"check{run}")).awaitTermination()
    assert spark.read.parquet(out).count() == 16


def test_configs(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("seed: 1\nname: x\n")
    assert files.load_yaml(spark, str(tmp_path / "c.yaml"), {"seed": int, "name": str}) == {"seed": 1, "name": "x"}
    with pytest.raises(ValueError):
        files.load_yaml(spark, str(tmp_path / "c.yaml"), {"seed": int})


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("audit_id,predicted_behavior,semantic_correctness,format_acceptable,notes\na1,CALL,YES,YES,\n")
    assert files.read_annotations(spark, str(tmp_path / "a.csv")).first().notes == ""
    (tmp_path / "b.csv").write_text("audit_id,notes\na1,\n")
    with pytest.raises(ValueError):
        files.read_annotations(spark, str(tmp_path / "b.csv"))
