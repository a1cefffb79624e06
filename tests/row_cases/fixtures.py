"""Operators over generated and literal tables, independent of the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions.calls import CALL, malformed_category, parsed_call, same_json
from pairwright.functions.tools import run_tool
from pairwright.operators import contracts, generate, guards, metrics, training
from pairwright.operators.evaluation import evaluate
from pairwright.operators.overlap import near_duplicate
from pairwright.staging import Stage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(run):  # noqa: ANN001, ANN202
        QUERIES[run.__name__] = lambda spark, sf_dir: run(spark)
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def literal(rows: list[tuple], columns: tuple[str, ...]) -> str:
    """SQL of a table of literal rows."""
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(columns)})"


@query(literal([("tasks", 600, 0), ("pairs", 300, 0), ("tools", 300, 0), ("keys", 600, 0), ("spoilt tasks", 600, 25), ("spoilt pairs", 300, 25), ("spoilt tools", 300, 25), ("spoilt keys", 600, 1)], ("what", "rows_", "broken")))
def q_corpus_violations(spark: SparkSession) -> DataFrame:
    """The corpus against its contracts, executors and split keys; and again with its finance answers spoilt, which must show."""
    tasks = Stage(generate.corpus(spark), "corpus").df  # read by every check
    hit = F.col("pair_id").like("finance-answer-%") & (F.col("variant") == "act")
    arguments = F.col("expected").withField("arguments", F.lit('{"account_id":"acct-1"}'))
    spoilt = tasks.withColumns({"expected": F.when(hit, arguments).otherwise(F.col("expected")), "generator_version": F.when(hit, "next").otherwise(F.col("generator_version")), "query": F.when(hit, "How much is there?").otherwise(F.col("query"))})
    found = []
    for name, rows in (("", tasks), ("spoilt ", spoilt)):
        state = F.when(hit, '{"balances":{"acct-1":1}}').otherwise(F.col("environment")) if name else F.col("environment")
        ran = rows.where("variant = 'act'").withColumn("r", run_tool(F.col("domain"), F.col("expected.tool_name"), F.col("expected.arguments"), state))
        checks = {
            "tasks": contracts.tasks(rows).select((F.size("violations") > 0).alias("bad")), "pairs": contracts.pairs(rows).select((F.size("violations") > 0).alias("bad")),
            "tools": ran.select((~same_json(F.col("r.result"), F.col("expected.expected_result"))).alias("bad")),
        }
        found += [df.agg(F.lit(name + what).alias("what"), F.count("*").alias("rows_"), F.count_if("bad").alias("broken")) for what, df in checks.items()]
        leaks = guards.leaks(rows, F.lower("query")).agg(F.count("*").alias("broken"))
        found.append(leaks.select(F.lit(name + "keys").alias("what"), F.lit(600).cast("long").alias("rows_"), "broken"))
    return guards.union_all(*found).select("what", F.col("rows_").cast("int").alias("rows_"), F.col("broken").cast("int").alias("broken"))


GOLD = [("CALL", 300), ("ANSWER", 75), ("CLARIFY", 75), ("REFUSE", 75), ("NOOP", 75)]


@query(literal([(label, n, n) for label, n in GOLD], ("predicted_class", "n", "correct")))
def q_evaluate_gold(spark: SparkSession) -> DataFrame:
    """Gold responses of the corpus, scored."""
    tasks = generate.corpus(spark)
    said = tasks.select(F.col("id").alias("task_id"), training.gold_text(F.col("expected")).alias("raw_text"), F.lit(None).cast(CALL).alias("tool_call"), F.lit(None).cast("string").alias("inference_error"))
    return evaluate(tasks, said).groupBy("predicted_class").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


#: Each way in which a call may be written, and texts that are none.
BOOKING = '{"name":"book_table","arguments":{"guests":4,"at":{"hour":19,"place":"Zoë"}}}'
BOOKED = '{"at":{"hour":19,"place":"Zoë"},"guests":4}'
CALLS = [
    (1, f"  {BOOKING}\n", "book_table", BOOKED), (2, f"<tool_call>\n{BOOKING}\n</tool_call>", "book_table", BOOKED), (3, '{"tool_calls":[' + BOOKING + "]}", "book_table", BOOKED),
    (4, '{"function":' + BOOKING + "}", "book_table", BOOKED), (5, '{"tool_call":' + BOOKING + ',"id":1}', "book_table", BOOKED), (6, '{"tool_calls":[{"function":{"name":"list_days","arguments":"{\\"from\\":[1.5,null]}"}}]}', "list_days", '{"from":[1.5,null]}'),
    (7, "Book it, please.", None, None), (8, '{"name":"book_table"', None, None), (9, "[" + BOOKING + "]", None, None), (10, '{"name":"Book Table","arguments":{}}', None, None),
    (11, '{"name":"book_table","arguments":"[]"}', None, None), (12, BOOKING + " Done.", None, None), (13, '{"name":"book_table","arguments":{"guests":Infinity}}', None, None), (14, '{"tool_calls":[' + BOOKING + "," + BOOKING + "]}", None, None), (15, None, None, None),
]


@query(literal([(i, n, a) for i, _, n, a in CALLS], ("i", "name", "arguments")))
def q_parse_calls(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, r) for i, r, _, _ in CALLS], "i int, raw string")
    return rows.withColumn("c", parsed_call("raw")).select("i", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))


BROKEN = [
    (1, '<tool_call>{"name":"a","arguments":{}}</tool_call>', 5, None), (2, "words", 5, None), (3, '<tool_call>{"name":"a","arguments":{', 256, "max_token_truncation"),
    (4, 'Sure: <tool_call>{"name":"a","arguments":{}}</tool_call>', 9, "prose_or_wrapper"), (5, '<tool_call>{"name":"a","arguments":{"x":1}</tool_call>', 9, "truncated_json"),
    (6, '<tool_call>{"name":"a","arguments":{"x":true.0}}</tool_call>', 9, "invalid_literal"), (7, '<tool_call>{"name":"a","arguments":{"x"=1}}</tool_call>', 9, "invalid_separator"),
    (8, '<tool_call>{"name":"a","arguments":{"x","y"}}</tool_call>', 9, "set_literal"), (9, '<tool_call>{"name":"a","arguments":{}}}</tool_call>', 9, "other_json_syntax"),
    (10, '<tool_call>{"arguments":{"name":"a"}}</tool_call>', 9, "name_inside_arguments"), (11, '<tool_call>{"arguments":{}}</tool_call>', 9, "missing_name"), (12, '<tool_call>{"name":"a"}</tool_call>', 9, "missing_arguments"),
]


@query(literal([(i, c) for i, _, _, c in BROKEN], ("i", "category")))
def q_malformed(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, r, n) for i, r, n, _ in BROKEN], "i int, raw string, n long")
    return rows.select("i", malformed_category(F.col("raw"), F.col("n")).alias("category"))


@query("""
WITH t AS (SELECT p, v, CASE v WHEN 0 THEN 'CALL' ELSE 'CLARIFY' END AS label, CASE WHEN p = 0 THEN 'CALL' WHEN v = 0 THEN 'CALL' ELSE 'CLARIFY' END AS guess FROM range(4) a(p), range(2) b(v)),
pairs AS (SELECT p, bool_and(label = guess) AS ok FROM t GROUP BY 1)
SELECT avg((label = guess)::INT) AS accuracy, (SELECT avg(ok::INT) FROM pairs) AS paired_accuracy, avg((guess = 'CALL')::INT) FILTER (v = 1) AS tool_hallucination_rate FROM t""")
def q_metrics_fixture(spark: SparkSession) -> DataFrame:
    """Four pairs, one abstain task answered by a call."""
    rows = [(f"p{p}-{v}", f"p{p}", v, "CALL" if v == "act" else "CLARIFY", "CALL" if v == "act" or p == 0 else "CLARIFY") for p in range(4) for v in ("act", "abstain")]
    flat = spark.createDataFrame(rows, "task_id string, pair_id string, variant string, label string, predicted_class string")
    ok = F.col("label") == F.col("predicted_class")
    flags = flat.withColumns({c: ok for c in ("correct", "behavior_correct", "semantic_correct", "protocol_correct")})
    return metrics.summary(flags).select("accuracy", "paired_accuracy", "tool_hallucination_rate")


PAIRS = [(1, "Close ticket 7!", "close TICKET 7", True, "exact"), (2, "please close the ticket number seven now", "please close the ticket number seven now ok", True, "five_gram_jaccard"), (3, "alpha", "omega", False, None)]


@query(literal([(i, d, m) for i, _, _, d, m in PAIRS], ("i", "duplicate", "method")))
def q_near_duplicate(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, a, b) for i, a, b, _, _ in PAIRS], "i int, a string, b string").withColumn("v", near_duplicate(F.col("a"), F.col("b")))
    return rows.select("i", F.col("v.duplicate").alias("duplicate"), F.col("v.method").alias("method"))


def _none_call():  # noqa: ANN202
    return F.lit(None).cast(CALL)


MATRIX = [("CALL", 8, 8, 0), ("ANSWER", 8, 8, 0), ("CLARIFY", 8, 8, 0), ("REFUSE", 8, 16, 8), ("NOOP", 8, 16, 8)]


@query(literal([(label, 5 * n, good) for label, n, good, _ in MATRIX], ("label", "cases", "correct")))
def q_response_matrix(spark: SparkSession) -> DataFrame:
    """Five responses to each of forty tasks: the gold one, nothing, a broken call, a refusal, and "no action"."""
    tasks = generate.productivity_tasks(spark, per_class=10)
    place = F.row_number().over(Window.partitionBy("label").orderBy("pair_id"))
    chosen = Stage(tasks.withColumn("n", place).where("n <= 8").drop("n"), "responses").df  # read for each response
    said = [F.lit(""), F.lit('<tool_call>{"name":</tool_call>'), F.lit("I cannot continue because no available tool can help."), F.lit("This is already closed; no action needed.")]
    found = None
    for text in (training.gold_text(F.col("expected")), *said):
        preds = chosen.select(F.col("id").alias("task_id"), text.alias("raw_text"), _none_call().alias("tool_call"), F.lit(None).cast("string").alias("inference_error"))
        one = evaluate(chosen, preds)
        found = one if found is None else found.unionByName(one)
    rows = found.join(chosen.select(F.col("id").alias("task_id"), "label"), "task_id")
    return rows.groupBy("label").agg(F.count("*").alias("cases"), F.count_if("correct").alias("correct"))


JUDGED = [("a1", "CALL", "YES", "YES", "CALL", "YES", "NO"), ("a2", "ANSWER", "NO", "YES", "CALL", "NO", "YES"), ("a3", "CALL", "YES", "NO", "CALL", "NO", "NO"), ("a4", "REFUSE", "YES", "YES", "REFUSE", "YES", "YES")]


@query(
    "WITH t AS (" + literal(JUDGED, ("audit_id", "a1", "b1", "c1", "a2", "b2", "c2")) + "), p AS (SELECT 'predicted_behavior' AS field, a1 AS x, a2 AS y FROM t UNION ALL SELECT 'semantic_correctness', b1, b2 FROM t UNION ALL SELECT 'format_acceptable', c1, c2 FROM t), "
    "n AS (SELECT field, count(*) AS n, avg((x = y)::INT) AS po FROM p GROUP BY 1), m AS (SELECT field, sum(c * d) AS s FROM (SELECT field, x AS v, count(*) AS c FROM p GROUP BY 1, 2) JOIN (SELECT field, y AS v, count(*) AS d FROM p GROUP BY 1, 2) USING (field, v) GROUP BY 1) "
    "SELECT field, round(po, 9) AS exact_agreement, round((po - s / (n * n)) / (1 - s / (n * n)), 9) AS cohen_kappa FROM n JOIN m USING (field)"
)
def q_annotator_agreement(spark: SparkSession) -> DataFrame:
    from pairwright.operators.agreement import FIELDS, annotator_agreement

    make = lambda at: spark.createDataFrame([(r[0], *r[at : at + 3], "") for r in JUDGED], ", ".join(f"{f} string" for f in FIELDS))
    found = annotator_agreement(make(1), make(4))
    return found.select("field", F.round("exact_agreement", 9).alias("exact_agreement"), F.round("cohen_kappa", 9).alias("cohen_kappa"))


@query(literal([("finance-clarify-003-act", "i2", "exact"), ("weather-refuse-003-act", "i1", "exact"), ("weather-refuse-003-abstain", "i1", "exact"), ("e1", "i5", "five_gram_jaccard"), ("e2", "i4", "sequence_match")], ("external_id", "internal_id", "method")))
def q_quarantine(spark: SparkSession) -> DataFrame:
    """Generated queries and two edited ones against internal ones: the first overlap by file order, by any of the three ways."""
    from pairwright.operators.overlap import overlap

    tasks = generate.corpus(spark).where("id in ('finance-clarify-003-act', 'weather-refuse-003-act', 'weather-refuse-003-abstain', 'weather-noop-003-act')").select("id", "query")
    edited = [("e1", "please close the ticket number seven right now ok"), ("e2", "ab cd ef gh ij kl mn op qr st uv wx yz 01 23 45 67 89")]
    tasks = tasks.unionByName(spark.createDataFrame(edited, "id string, query string"))
    spread = ("i4", "ab cd efz gh ij kl zmn op qr st uvz wx yz 01 z23 45 67 89z", "test", 4)
    internal = spark.createDataFrame([("i1", "what time is it in DENVER", "train", 1), ("i2", "Transfer 13 from acct 1003 to acct 2003", "validation", 2), ("i3", "What time is it in Denver?", "test", 3), spread, ("i5", "please close the ticket number seven right now", "test", 5)], "id string, query string, split string, ord long")
    return overlap(tasks, internal).select("external_id", "internal_id", "method")


@query("SELECT 3 AS base_n, 3 AS candidate_n, 't1,t4' AS resolved, 't2,t5' AS new_, 't3' AS persistent, 'missing_arguments:2,prose_or_wrapper:1' AS base_kinds, 'missing_arguments:2,missing_name:1' AS candidate_kinds")
def q_malformed_diff(spark: SparkSession) -> DataFrame:
    """Malformed calls of two runs: which are new, resolved and persistent, and of what kinds."""
    from pairwright.operators.malformed import compared

    good, bad, prose, nameless = '{"name":"a","arguments":{}}', '<tool_call>{"name":"a"}</tool_call>', 'Sure: <tool_call>{"name":"a","arguments":{}}</tool_call>', '<tool_call>{"arguments":{}}</tool_call>'
    make = lambda *rows: spark.createDataFrame([(f"t{i}", r, 9) for i, r in enumerate(rows, 1)], "task_id string, raw_text string, output_tokens long")
    found = compared(make(bad, good, bad, prose, good), make(good, bad, bad, good, nameless))
    ids = lambda kind: F.array_join(f"{kind}_ids", ",")
    kinds = lambda side: F.array_join(F.transform(F.map_entries(f"{side}_categories"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return found.select(F.col("base_malformed_count").cast("int").alias("base_n"), F.col("candidate_malformed_count").cast("int").alias("candidate_n"), ids("resolved").alias("resolved"), ids("new").alias("new_"), ids("persistent").alias("persistent"), kinds("base").alias("base_kinds"), kinds("candidate").alias("candidate_kinds"))


EXTERNAL = [("a", "simple", "CALL", '{"name":"F.x","arguments":{}}'), ("b", "simple", "CALL", '<tool_call>{"name":"F"'), ("c", "irrelevance", "ABSTAIN", "no"), ("d", "irrelevance", "ABSTAIN", '{"name":"g","arguments":{}}')]


@query("SELECT 0.75 AS decision_accuracy, 1.0 AS call_accuracy, 0.5 AS abstain_accuracy, 0.75 AS balanced_accuracy, 0.75 AS tool_call_rate, 0.25 AS malformed_call_rate")
def q_external_metrics(spark: SparkSession) -> DataFrame:
    from pairwright.operators.evaluation import PREDICTION, evaluate_external

    records = spark.createDataFrame([r[:3] for r in EXTERNAL], "id string, category string, expected_decision string")
    said = spark.createDataFrame([(r[0], r[3], None, 0.0, None, None, None, None) for r in EXTERNAL], PREDICTION)
    return metrics.external_metrics(evaluate_external(records, said)).select("decision_accuracy", "call_accuracy", "abstain_accuracy", "balanced_accuracy", "tool_call_rate", "malformed_call_rate")


@query("SELECT * FROM (VALUES (1, 1.0, 1), (2, 0.25, 2)) t(i, logp, tokens)")
def q_sequence_logp(spark: SparkSession) -> DataFrame:
    """Masked log-probabilities, as probabilities: of one certain token, and of two even ones."""
    from pairwright.operators.rewards import sequence_logp

    rows = spark.createDataFrame([(1, [[900.0, 0.0], [0.0, 0.0]], [0, 1], [1.0, 0.0]), (2, [[3.0, 3.0], [1.0, 1.0]], [0, 1], [1.0, 1.0])], "i int, l array<array<double>>, t array<int>, m array<double>")
    found = rows.select("i", sequence_logp(F.col("l"), F.col("t"), F.col("m")).alias("x"))
    return found.select("i", F.round(F.exp("x.logp"), 9).alias("logp"), F.col("x.tokens").alias("tokens"))
