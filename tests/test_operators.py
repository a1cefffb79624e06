import math

import pytest
from pyspark.sql import functions as F

from pairwright.operators import agreement, contracts, generate, guards, malformed, overlap, reports, rewards, sampling, statistics, training
from pairwright.operators.evaluation import PREDICTION


def test_mean_interval(spark):
    row = statistics.mean_interval(spark.createDataFrame([(0.9,), (0.8,), (1.0,)], "v double"), "v").first()
    assert row.n == 3 and abs(row["mean"] - 0.9) < 1e-12 and abs(row.sample_std - 0.1) < 1e-12
    assert abs(row.ci95_low - 0.651586) < 1e-6 and abs(row.ci95_high - 1.148414) < 1e-6
    for bad in ([(1.0,)], [(1.0,), (float("nan"),)]):
        with pytest.raises(Exception, match="value is not finite|two values at least"):
            statistics.mean_interval(spark.createDataFrame(bad, "v double"), "v").collect()


def test_paired_bootstrap(spark):
    base = spark.createDataFrame([(i, c) for i, c in zip("abcd", (True, False, False, True), strict=True)], "task_id string, correct boolean")
    cand = spark.createDataFrame([(i, c) for i, c in zip("abcd", (True, True, False, True), strict=True)], "task_id string, correct boolean")
    rows = statistics.compared(base, cand, "x", 7)
    one, two = (statistics.paired_bootstrap(rows.repartition(n), 100).first() for n in (1, 3))
    assert one == two and one.difference == 0.25 and one.ci95_low <= 0.25 <= one.ci95_high
    with pytest.raises(ValueError):
        statistics.compared(base, cand.where("task_id != 'a'"), "x", 7)


def test_order_interval(spark):
    row = statistics.order_interval(spark.range(10_000).select(F.col("id").cast("double").alias("m")), "m", 10_000).first()
    assert (row.ci95_low, row.ci95_high) == (249.0, 9750.0)


def logps(spark, rows):
    return spark.createDataFrame(rows, "policy_chosen double, policy_rejected double, reference_chosen double, reference_rejected double, chosen_tokens long, rejected_tokens long")


def test_dpo_metrics(spark):
    row = rewards.dpo_metrics(logps(spark, [(-1.0, -2.0, -1.0, -2.0, 2, 2)]), 0.1).first()
    assert abs(row.loss - math.log(2)) < 1e-12 and row.reward_margin == 0 and row.reward_accuracy == 0
    row = rewards.dpo_metrics(logps(spark, [(-2.0, -6.0, -4.0, -3.0, 2, 3)]), 1.0, normalization="mean").first()
    assert abs(row.reward_margin - 2.0) < 1e-12 and row.reward_accuracy == 1
    for bad in ((float("inf"), -1.0, -1.0, -1.0, 1, 1),):
        with pytest.raises(Exception, match="is not finite"):
            rewards.dpo_metrics(logps(spark, [bad]), 0.1).collect()
    with pytest.raises(Exception, match="has no tokens"):
        rewards.dpo_metrics(logps(spark, [(-1.0, -1.0, -1.0, -1.0, 0, 1)]), 0.1, normalization="mean").collect()
    with pytest.raises(ValueError):
        rewards.dpo_metrics(logps(spark, []), 0.1, label_smoothing=0.5)


def test_anchored_loss(spark):
    row = rewards.anchored_loss(logps(spark, [(-4.0, 0.0, 0.0, 0.0, 2, 1), (-9.0, 0.0, 0.0, 0.0, 3, 1)]), F.lit(0.5), 0.5).first()
    assert (row.dpo_loss, row.chosen_sft_loss, row.loss) == (0.5, 2.5, 1.75)


def test_sequence_logp(spark):
    df = spark.createDataFrame([([[0.0, 2.0], [1.0, 1.0], [5.0, 0.0]], [1, 0, 0], [1.0, 1.0, 0.0])], "l array<array<double>>, t array<int>, m array<double>")
    row = df.select(rewards.sequence_logp(F.col("l"), F.col("t"), F.col("m")).alias("x")).first().x
    assert abs(row.logp - (-math.log1p(math.exp(-2)) - math.log(2))) < 1e-12 and row.tokens == 2


def test_near_duplicates(spark):
    rows = [("Close ticket 7", "close   TICKET-7!"), ("please move the whole meeting to friday", "please move the whole meeting to fridays"), ("abc", "xyz"), ("", "?")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = [r.v.method for r in df.select("i", overlap.near_duplicate(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == ["exact", "five_gram_jaccard", None, "exact"]


def test_quarantine_takes_the_first_match(spark):
    external = spark.createDataFrame([("e1", "Close ticket 12 now"), ("e2", "unrelated words entirely"), ("e3", "transfer twenty dollars from acct one to acct two")], "id string, query string")
    internal = spark.createDataFrame([("i1", "something else", "train", 0), ("i2", "close ticket 12, now", "validation", 5), ("i3", "close ticket 12 now", "test", 9), ("i4", "transfer twenty dollars from acct one to acct too", "test", 10)], "id string, query string, split string, ord long")
    kept, report = overlap.quarantine(external, internal)
    assert [r.id for r in kept.collect()] == ["e2"]
    got = {r.external_id: (r.internal_id, r.method) for r in report.collect()}
    assert got["e1"] == ("i2", "exact") and got["e3"][0] == "i4"
    both = external.crossJoin(internal.withColumnsRenamed({"id": "j", "query": "q2"})).select("id", "j", overlap.near_duplicate(F.col("query"), F.col("q2")).alias("v")).where("v.duplicate")
    assert {(r.id, r.j) for r in both.collect()} == {("e1", "i2"), ("e1", "i3"), ("e3", "i4")}


def annotations(spark, rows):
    return spark.createDataFrame(rows, "audit_id string, predicted_behavior string, semantic_correctness string, format_acceptable string, notes string")


def test_agreement(spark):
    a = annotations(spark, [("1", "CALL", "YES", "YES", ""), ("2", "ANSWER", "NO", "YES", ""), ("3", "CALL", "YES", "YES", ""), ("4", "REFUSE", "YES", "YES", "")])
    b = annotations(spark, [("1", "CALL", "YES", "YES", ""), ("2", "CALL", "NO", "YES", ""), ("3", "CALL", "NO", "YES", ""), ("4", "REFUSE", "YES", "YES", "")])
    got = {r.field: r for r in agreement.annotator_agreement(a, b).collect()}
    assert got["predicted_behavior"].exact_agreement == 0.75
    assert got["format_acceptable"].cohen_kappa == 1.0
    pe = (3 * 2 + 1 * 2) / 16
    assert abs(got["semantic_correctness"].cohen_kappa - (0.75 - pe) / (1 - pe)) < 1e-12
    with pytest.raises(ValueError):
        agreement.annotator_agreement(a, b.where("audit_id != '1'"))


def test_evaluator_agreement(spark):
    a = annotations(spark, [("a1", "CALL", "YES", "YES", ""), ("a2", "UNCLEAR", "UNCERTAIN", "NO", "")])
    mapping = spark.createDataFrame([("a1", "t1"), ("a2", "t2")], "audit_id string, task_id string")
    found = spark.createDataFrame([("t1", "CALL", True, False), ("t2", None, False, False)], "task_id string, predicted_class string, correct boolean, protocol_correct boolean")
    row = agreement.evaluator_agreement(agreement.judged(a, mapping, found)).first()
    assert (row.behavior_agreement, row.semantic_agreement, row.protocol_agreement) == (1.0, 1.0, 0.5)
    assert [(d.audit_id, d.axes) for d in row.disagreements] == [("a1", "protocol")]


def test_annotation_problems(spark):
    rows = annotations(spark, [("1", "CALL", "YES", "YES", ""), ("1", "CALL", "MAYBE", "YES", "")])
    wanted = spark.createDataFrame([("1",), ("2",)], "audit_id string")
    assert {r.problem for r in agreement.annotation_problems(rows, wanted).collect()} == {"repeated", "only in right", "semantic_correctness"}


def test_malformed_runs(spark):
    make = lambda rows: spark.createDataFrame([(t, r, None, 0.0, None, 9, None, None) for t, r in rows], PREDICTION)
    good, bad = '{"name":"a","arguments":{}}', '<tool_call>{"name":"a"}</tool_call>'
    row = malformed.compared(make([("task-one", bad), ("task-two", good), ("task-three", bad)]), make([("task-one", good), ("task-two", bad), ("task-three", bad)])).first()
    assert (row.new_ids, row.resolved_ids, row.persistent_ids, row.base_categories) == (["task-two"], ["task-one"], ["task-three"], {"missing_arguments": 2})


def test_preferences(spark):
    tasks = generate.corpus(spark).where("split != 'test'").cache()
    prefs = training.preferences(tasks, "0" * 64).cache()
    counts = {r.negative_type: r.n for r in guards.counted(prefs, "negative_type").collect()}
    assert sum(counts.values()) == 480 and counts["malformed_tool_call"] == 128
    assert counts["wrong_decision_abstain"] + counts["unnecessary_call"] + counts["wrong_abstention_class"] + counts["wrong_tool"] + counts["wrong_arguments"] + counts["schema_copying"] == 352
    assert training.checked(prefs, tasks).where("size(violations) > 0").isEmpty()
    assert contracts.preferences(prefs).where("size(violations) > 0").isEmpty()
    some = training.dpo_examples(prefs.where("split = 'validation'"), tasks, "0" * 64, 24)
    rows = some.collect()
    assert len(rows) == 24 and [r.id for r in rows] == sorted(r.id for r in rows)
    assert len({(r.task_id.split("-")[0], r.task_id.split("-")[1]) for r in rows}) == 12
    with pytest.raises(ValueError):
        training.dpo_examples(prefs, tasks, "1" * 64)
    with pytest.raises(ValueError):
        training.dpo_examples(prefs.where("split = 'validation'"), tasks, "0" * 64, 5)


def test_tokenized_pairs(spark):
    rows = spark.createDataFrame([("x", [("user", "hi")], "yes", "no")], "id string, messages array<struct<role:string,content:string>>, chosen string, rejected string")
    tokenizer = lambda turns, more: [ord(c) for t in turns for c in t["content"]] + ([] if more else [0])
    row = training.tokenized(rows, tokenizer, 5).first()
    assert (row.chosen_offset, row.chosen, row.chosen_truncated, row.rejected_truncated) == (2, [104, 105, 121, 101, 115], True, False)
    with pytest.raises(Exception, match="nothing of the completion is left"):
        training.tokenized(rows, tokenizer, 2).collect()


def test_reference_cache(spark):
    examples = spark.createDataFrame([("a", "h1"), ("b", "h2")], "id string, example_hash string")
    cache = spark.createDataFrame([("a", "old"), ("c", "h"), ("c", "h")], "id string, example_hash string")
    assert {(r.id, r.problem) for r in training.reference_problems(examples, cache).collect()} == {("a", "stale"), ("b", "unmatched"), ("c", "unmatched"), ("c", "repeated")}


def test_samples_do_not_depend_on_partitions(spark):
    tasks = generate.corpus(spark).where("split = 'validation'").cache()
    one, two = ([r.id for r in sampling.balanced(tasks.repartition(n), ["domain", "label"], F.col("id"), 4).collect()] for n in (1, 7))
    assert one == two and len(one) == 60
    with pytest.raises(ValueError):
        sampling.balanced(tasks, ["domain", "label"], F.col("id"), 100)


def test_positions_and_cycles(spark):
    got = sampling.positions(spark.range(100).repartition(7), "id").collect()
    assert all(r.id == r.position for r in got)
    assert [r.item for r in sampling.cycled([3, 1, 2], 5, spark).orderBy("step").collect()] == [3, 1, 2, 3, 1]
    smoke = sampling.smoke_pairs(sampling.positions(generate.corpus(spark), "id", "ord"))
    assert smoke.count() == 8


def test_calibration_packet(spark):
    tasks = generate.corpus(spark).where("split = 'validation'").cache()
    said = tasks.select(F.col("id").alias("task_id"), F.lit("</script> ok").alias("raw_text"))
    packet = reports.calibration_packet(tasks, said).cache()
    rows = packet.collect()
    assert len(rows) == 60 and rows[0].audit_id == "audit-001" and rows[-1].audit_id == "audit-060"
    assert "</script> ok" not in reports.packet_page(packet)
    with pytest.raises(ValueError):
        reports.calibration_packet(tasks, said.limit(3))
    with pytest.raises(ValueError):
        reports.calibration_packet(generate.corpus(spark), said)


def test_comparison_rendering():
    spec = {"id": "x", "family": "1.5b", "method": "M", "split": "bfcl", "status": "baseline", "metrics": "m", "evaluations": "e"}
    row = reports.experiment_row(spec, {"decision_accuracy": 0.5, "abstain_accuracy": 0.25, "call_accuracy": 1, "task_count": 4}, 0)
    assert row["accuracy"] == 0.5 and row["abstention_accuracy"] == 0.25
    assert "| M | 1.5b | bfcl | baseline | 50.00% | 100.00% | 25.00% | — |" in reports.markdown([row])
    assert reports.csv_text([row]).splitlines()[1] == "x,1.5b,M,bfcl,baseline,4,0.5,,0.25,,1.0,,"
    assert 'width="250.0"' in reports.bars([row], "1.5b")
    with pytest.raises(ValueError):
        reports.check_config({"experiments": [spec | {"metrics": "a/Test/m"}]})
    with pytest.raises(ValueError):
        reports.check_config({"experiments": [spec], "paired_comparisons": [{"id": "c", "baseline": "x", "candidate": "y"}]})


def test_contract_violations(spark):
    preds = spark.createDataFrame([("ok", "x", None, 1.0, 1, 1, 1.0, None), ("bad", "x", None, -1.0, -1, 1, float("inf"), "Boom")], PREDICTION)
    got = {r.task_id: r.violations for r in contracts.predictions(preds).collect()}
    assert got == {"ok": [], "bad": ["latency_ms", "input_tokens", "peak_memory_gb", "inference_error"]}
    tasks = generate.finance_tasks(spark).limit(1).withColumn("label", F.lit("NOOP"))
    assert set(contracts.tasks(tasks).first().violations) >= {"kind", "label"}


def test_containment_both_ways(spark, monkeypatch):
    long = "alpha beta gamma delta epsilon zeta eta theta iota"
    docs = spark.createDataFrame([(1, f"x{long}y"), (2, "has kappa here"), (3, None), (4, long[:45])], "doc_id long, text string")
    items = spark.createDataFrame([(10, long), (11, "kappa"), (12, long), (13, "")], "item_id long, text string")
    want = {(1, 10), (1, 12), (2, 11)}
    assert {tuple(r) for r in overlap.contained(docs, items).collect()} == want
    monkeypatch.setattr(overlap, "AUTOMATON_CHARS", 20)
    assert {tuple(r) for r in overlap.contained(docs, items).collect()} == want
