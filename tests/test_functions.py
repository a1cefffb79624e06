import json
import random

import pytest
from pyspark.sql import functions as F

from pairwright.functions import calls, canonical, schemas, text, tools


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def results(spark, values, expression, kind="string"):
    return [r.x for r in column(spark, values, kind).select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_canonical_json_and_hash(spark):
    assert canonical.canonical({"b": "é", "a": 1}) == '{"a":1,"b":"é"}'
    assert canonical.digest({"b": "é", "a": 1}).startswith("09ad9fd2") and canonical.digest({"b": "é", "a": 1}).endswith("301cc6")
    got = results(spark, ['{"b": "é", "a": 1}', '{"x": 1.0, "y": 1e-7}', "broken", None, '{"a": NaN}'], canonical.canonical_json)
    assert got == ['{"a":1,"b":"é"}', '{"x":1.0,"y":1e-07}', None, None, None]
    assert results(spark, ["a"], canonical.sha256_of_string) == [canonical.digest("a")]
    assert canonical.finite_error({"a": [1, float("inf")]}) == "value.a[1] contains a non-finite number"


def test_normalised_text(spark):
    assert text.normalise("  PARIS,\n France! ") == "paris, france"
    assert results(spark, ["  PARIS,\n France! ", "ＡＢ　ß", None], text.normalize_text) == ["paris, france", "ab ss", None]


def test_query_forms(spark):
    assert results(spark, ["Hé llo-World 2!", "Straße", "ﬁne", ""], text.normalize_query) == ["h llo world 2", "strasse", "fine", ""]
    assert results(spark, [" A b\tC "], text.whitespace_query) == ["a b c"]
    assert results(spark, ["Planning Session  1"], text.event_slug) == ["planning-session-1"]
    assert results(spark, ["--Simple_12!x"], text.slug) == ["simple-12-x"]
    assert [sorted(g) for g in results(spark, ["", "a"], text.five_grams)] == [["    "], ["  a  "]]


#: A call with nested arguments and a letter beyond ASCII, in every form that is taken.
STEPS = '{"name":"plan_route","arguments":{"via":["Łódź",{"km":1.5}],"return":false}}'


@pytest.mark.parametrize(
    "form", ["CALL", "<tool_call> CALL </tool_call>", '{"tool_call":CALL,"note":null}', '{"tool_calls":[CALL]}', '{"function":CALL}', '{"tool_calls":[{"function":CALL}]}', "\n\tCALL  "]
)
def test_calls_accepted(form):
    assert calls.parse_call(form.replace("CALL", STEPS)) == ("plan_route", '{"return":false,"via":["Łódź",{"km":1.5}]}')


def test_arguments_may_be_json_text():
    assert calls.parse_call(json.dumps({"name": "n", "arguments": json.dumps({"b": 1, "a": [None]})})) == ("n", '{"a":[null],"b":1}')


@pytest.mark.parametrize("raw", ["", "text", "{broken", "[]", '{"name":"Bad Name","arguments":{}}', '{"name":"x","arguments":[]}', '{"name":"x","arguments":"{bad"}', '{"name":"x","arguments":{"a":1e999}}', '{"name":"x","arguments":{}} tail'])
def test_calls_rejected(raw):
    assert calls.parse_call(raw) is None


def test_external_calls():
    assert calls.external_call_ok('{"name":"calculate_NPV","arguments":{}}')
    assert calls.external_call_ok('<TOOL_CALL>{"name":"fMRI.analyze","arguments":"{\\"a\\":1}"}</TOOL_CALL>')
    for raw in ("", '{"name":" ","arguments":{}}', '{"name":"x","arguments":"[1]"}', '{"name":"x"}'):
        assert not calls.external_call_ok(raw)


def test_malformed_categories(spark):
    rows = [
        ('<tool_call>{"name":"a","arguments":{}}</tool_call>', 5, None),
        ("plain words", 5, None),
        ('<tool_call>{"name":"a","arguments":{', 256, "max_token_truncation"),
        ('Sure: <tool_call>{"name":"a","arguments":{}}</tool_call>', 9, "prose_or_wrapper"),
        ('<tool_call>{"name":"a","arguments":{"x":1}</tool_call>', 9, "truncated_json"),
        ('<tool_call>{"name":"a","arguments":{"x":true.0}}</tool_call>', 9, "invalid_literal"),
        ('<tool_call>{"name":"a","arguments":{"x"=1}}</tool_call>', 9, "invalid_separator"),
        ('<tool_call>{"name":"a","arguments":{"x","y"}}</tool_call>', 9, "set_literal"),
        ('<tool_call>{"name":"a","arguments":{}}}</tool_call>', 9, "other_json_syntax"),
        ('<tool_call>{"arguments":{"name":"a"}}</tool_call>', 9, "name_inside_arguments"),
        ('<tool_call>{"arguments":{}}</tool_call>', 9, "missing_name"),
        ('<tool_call>{"name":"a"}</tool_call>', 9, "missing_arguments"),
        ('<tool_call>{"name":"a","arguments":[]}</tool_call>', None, "invalid_structure"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, n long, want string")
    got = df.select("i", "want", calls.malformed_category(F.col("raw"), F.col("n")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_schema_subset():
    schema = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "s": {"type": "string", "pattern": "^a"}}, "required": ["n"], "additionalProperties": False}
    assert schemas.value_errors(schema, {"n": 1, "s": "ab"}) == []
    for bad in ({}, {"n": 0}, {"n": True}, {"n": 1.5}, {"n": 1, "s": "b"}, {"n": 1, "z": 1}, []):
        assert schemas.value_errors(schema, bad)
    assert schemas.standard_types({"type": "dict", "properties": {"type": {"type": "any", "x": 1}, "b": {"type": "tuple", "items": {"type": "float"}}}}) == {"type": "object", "properties": {"type": {"x": 1}, "b": {"type": "array", "items": {"type": "number"}}}}
    with pytest.raises(ValueError):
        schemas.standard_types({"type": "mystery"})


def test_tools_run(spark):
    assert tools.execute("productivity", "create_event", {"title": "A  B", "date": "2027-01-02"}, {})["event_id"] == "evt-2027-01-02-a-b"
    assert tools.execute("productivity", "close_ticket", {"ticket_id": 5}, {"tickets": {"5": "closed"}}) == {"ticket_id": 5, "status": "closed", "changed": False}
    with pytest.raises(ValueError):
        tools.execute("productivity", "close_ticket", {"ticket_id": 0}, {})
    with pytest.raises(ValueError):
        tools.execute("weather", "transfer", {}, {})


def test_families_and_strata(spark):
    row = spark.range(1).select(
        text.family_split(F.lit("finance-noop-3")).alias("s"), text.template_family(F.lit("finance"), F.lit("NOOP"), F.lit("finance-noop-013")).alias("f"),
        text.stratum_of(F.lit("finance-noop-013")).alias("d"), text.stratum_of(F.lit("protocol-001")).alias("n"), text.pair_of(F.lit("x-1-act")).alias("p"),
    ).first()
    assert (row.s, row.f, row.d.asDict(), row.n, row.p) == ("validation", "finance-noop-3", {"domain": "finance", "label": "NOOP"}, None, "x-1")


def test_json_equality(spark):
    df = spark.createDataFrame([('{"a":1,"b":[1,2]}', '{"b":[1,2],"a":1.0}'), ('{"a":[1,2]}', '{"a":[2,1]}'), (json.dumps({}), None)], "a string, b string")
    assert [r.x for r in df.select(calls.same_json("a", "b").alias("x")).collect()] == [True, False, False]


def test_normal_forms_by_the_jvm_are_those_of_python(spark):
    rng = random.Random(21)
    letters = "aAzZ09 .,!?;:'\"\t\n\r\x0b\x0c\x1c\x1f\x00\x7f-_"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    texts += ["".join(rng.choice(letters + "ßéÉİſﬁ\u2003\x85") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    found = {r.i: r.n for r in rows.select("i", text.normalize_text(F.col("t")).alias("n")).collect()}
    assert [t for i, t in enumerate(texts) if found[i] != text.normalise(t)] == [] and found[len(texts)] is None
