import pytest
from pyspark.sql import functions as F

from pairwright.operators import contracts, generate, guards, metrics, training
from pairwright.operators.evaluation import PREDICTION, evaluate, evaluate_external


@pytest.fixture(scope="module")
def corpus(spark):
    return generate.corpus(spark).cache()


def said(spark, rows):
    return spark.createDataFrame([(t, r, None, 0.0, None, n, None, e) for t, r, n, e in rows], PREDICTION)


RESPONSES = ["__gold__", "", "maybe later", '<tool_call>{"name":"close_ticket","arguments":{}}</tool_call>', "I cannot do that."]


def test_corpus_counts(corpus):
    assert {r["split"]: r["count"] for r in corpus.groupBy("split").count().collect()} == {"train": 360, "validation": 120, "test": 120}
    assert guards.leaks(corpus, "pair_id").isEmpty()
    assert contracts.tasks(corpus).where("size(violations) > 0").isEmpty()
    assert contracts.pairs(corpus).where("size(violations) > 0").isEmpty()


def test_test_split_is_the_documented_one(corpus):
    order = [(d, lab) for d in ("productivity", "finance", "weather") for lab in ("answer", "clarify", "refuse", "noop")]
    rows = training.with_task_json(corpus.where("split = 'test'")).select("id", "pair_id", "variant", "json").collect()
    place = lambda r: (order.index(tuple(r.pair_id.split("-")[:2])), r.pair_id, r.variant != "act")
    import hashlib

    digest = hashlib.sha256("".join(r.json + "\n" for r in sorted(rows, key=place)).encode()).hexdigest()
    assert digest.startswith("76bbac17") and digest.endswith("59bc8")


def test_gold_responses_are_right(spark, corpus):
    gold = corpus.select(F.col("id").alias("task_id"), training.gold_text(F.col("expected")).alias("raw_text"))
    preds = gold.select("task_id", "raw_text", F.lit(None).cast("struct<name:string,arguments:string>").alias("tool_call"), F.lit(None).cast("string").alias("inference_error"))
    found = evaluate(corpus, preds)
    assert found.where("not (correct and protocol_correct)").isEmpty() and found.count() == 600
    summary, per_class = metrics.compute_metrics(corpus, found)
    row = summary.first()
    assert (row.accuracy, row.paired_accuracy, row.macro_f1, row.tool_hallucination_rate, row.pair_count) == (1.0, 1.0, 1.0, 0.0, 300)
    assert contracts.evaluations(found).where("size(violations) > 0").isEmpty()


def test_priorities(spark, corpus):
    rows = [
        ("productivity-clarify-003-abstain", "What recipient should I use?", "CLARIFY", "correct_clarification"),
        ("productivity-answer-003-abstain", "What recipient should I use?", "ANSWER", "incorrect_answer"),
        ("productivity-noop-003-abstain", "Nothing to do.", "NOOP", "incorrect_noop"),
        ("productivity-noop-003-act", "cannot", "REFUSE", "wrong_behavior"),
        ("productivity-refuse-003-abstain", "I can’t do it", "ANSWER", "wrong_behavior"),
        ("productivity-refuse-004-abstain", "   ", None, "empty_output"),
        ("productivity-noop-004-act", '<tool_call>{"name":"close_ticket","arguments":{"ticket_id":1004.0}}</tool_call>', "CALL", "correct_tool_call"),
        ("productivity-noop-005-act", '<tool_call>{"name":"close_ticket","arguments":{}}</tool_call>', "CALL", "incorrect_tool_call"),
        ("productivity-noop-006-act", '<tool_call>{"name":"close_ticket"', "CALL", "malformed_tool_call"),
    ]
    found = {r.task_id: r for r in evaluate(corpus, said(spark, [(t, x, None, None) for t, x, _, _ in rows])).collect()}
    for task, _, label, reason in rows:
        assert (found[task].predicted_class, found[task].reason_code) == (label, reason), task


def test_failed_and_foreign_predictions(spark, corpus):
    row = evaluate(corpus, said(spark, [("finance-noop-001-act", "", None, "Boom: x")])).first()
    assert (row.reason_code, row.predicted_class, row.protocol_correct, row.correct) == ("inference_error", None, False, False)
    with pytest.raises(ValueError):
        evaluate(corpus, said(spark, [("nobody", "x", None, None)]))
    with pytest.raises(ValueError):
        evaluate(corpus, said(spark, [("finance-noop-001-act", "x", None, None)] * 2))


def validators(spark, rows):
    tasks = []
    for i, (v, _, _) in enumerate(rows):
        base = dict.fromkeys("kind value num_value values case_sensitive absolute_tolerance unit validator_id parameters".split()) | v
        tasks.append((f"t-{i}", base["kind"], base["value"], base["num_value"], base["values"], base["case_sensitive"], base["absolute_tolerance"], base["unit"]))
    flat = spark.createDataFrame(tasks, "id string, k string, v string, n double, vs array<string>, c boolean, t double, u string")
    wanted = generate.expected({"kind": F.lit("ANSWER"), "validator": {"kind": F.col("k"), "value": F.col("v"), "num_value": F.col("n"), "values": F.col("vs"), "case_sensitive": F.col("c"), "absolute_tolerance": F.col("t"), "unit": F.col("u")}})
    return flat.select("id", F.lit("ANSWER").alias("label"), wanted.alias("expected"))


def test_answer_validators(spark):
    rows = [
        ({"kind": "exact", "value": "Paris", "case_sensitive": True}, "It is Paris.", True),
        ({"kind": "exact", "value": "Paris", "case_sensitive": True}, "it is paris", False),
        ({"kind": "exact", "value": "Paris", "case_sensitive": False}, "it is PARIS!", True),
        ({"kind": "normalized_text", "value": "New  York"}, "in new york now", True),
        ({"kind": "numeric", "num_value": 1200.0, "absolute_tolerance": 0.5}, "about 1,200.4", True),
        ({"kind": "numeric", "num_value": 12.0, "absolute_tolerance": 0.1, "unit": "km"}, "12 miles", False),
        ({"kind": "numeric", "num_value": 12.0, "absolute_tolerance": 0.1, "unit": "km"}, "12 KM", True),
        ({"kind": "numeric", "num_value": 12.0, "absolute_tolerance": 0.1}, "none", False),
        ({"kind": "set", "values": ["red", "blue"], "case_sensitive": False}, "Blue and red", True),
        ({"kind": "set", "values": ["red", "blue"], "case_sensitive": True}, "Blue; red", False),
        ({"kind": "set", "values": ["red", "blue"], "case_sensitive": False}, "red", False),
        ({"kind": "domain"}, "anything", False),
    ]
    found = evaluate(validators(spark, rows), said(spark, [(f"t-{i}", r[1], None, None) for i, r in enumerate(rows)])).collect()
    got = {r.task_id: r.semantic_correct for r in found}
    assert [got[f"t-{i}"] for i in range(len(rows))] == [r[2] for r in rows]


def scored(spark, rows):
    return spark.createDataFrame(rows, "task_id string, predicted_class string, behavior_correct boolean, semantic_correct boolean, protocol_correct boolean, correct boolean, reason_code string")


def eight(spark, flip=False):
    tasks, found = [], []
    for p in range(4):
        for variant, label in (("act", "CALL"), ("abstain", "CLARIFY")):
            tid = f"p{p}-{variant}"
            wrong = flip and tid == "p0-abstain"
            tasks.append((tid, f"p{p}", variant, label))
            found.append((tid, "CALL" if wrong else label, not wrong, not wrong, True, not wrong, "x"))
    return spark.createDataFrame(tasks, "id string, pair_id string, variant string, label string"), scored(spark, found)


def test_metric_identities(spark):
    tasks, found = eight(spark, flip=True)
    summary, per_class = metrics.compute_metrics(tasks, found)
    row = summary.first()
    assert (row.accuracy, row.paired_accuracy, row.abstention_accuracy, row.tool_hallucination_rate) == (7 / 8, 3 / 4, 3 / 4, 1 / 4)
    by = {r["class"]: r for r in per_class.collect()}
    assert len(by) == 5 and by["ANSWER"].recall == 0 and by["CALL"].precision == 4 / 5
    assert abs(row.macro_f1 - sum(r.f1 for r in by.values()) / 5) < 1e-12


def test_metric_errors(spark):
    tasks, found = eight(spark)
    with pytest.raises(ValueError):
        metrics.compute_metrics(tasks, found.where("task_id != 'p0-act'"))
    with pytest.raises(ValueError):
        metrics.compute_metrics(tasks.unionByName(tasks), found)
    with pytest.raises(ValueError):
        metrics.compute_metrics(tasks.where("variant = 'act'"), found.where("task_id like '%act'"))
    with pytest.raises(ValueError):
        metrics.compute_metrics(tasks.limit(0), found.limit(0))


def test_external_decisions(spark):
    records = spark.createDataFrame([("a", "simple", "CALL"), ("b", "irrelevance", "ABSTAIN")], "id string, category string, expected_decision string")
    good = evaluate_external(records, said(spark, [("a", '{"name":"F.x","arguments":{}}', None, None), ("b", "no", None, None)]))
    assert metrics.external_metrics(good).first().balanced_accuracy == 1.0
    broken = evaluate_external(records, said(spark, [("a", '<tool_call>{"name":"F"', None, None), ("b", "no", None, None)]))
    row = metrics.external_metrics(broken).first()
    assert (row.malformed_call_rate, row.decision_accuracy, row.per_category) == (0.5, 1.0, {"simple": 1.0, "irrelevance": 1.0})
    with pytest.raises(ValueError):
        metrics.external_metrics(good.where("task_id = 'a'"))
