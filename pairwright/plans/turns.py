"""Contracts, training rows, scoring and resumption over the conversations' turns as tasks; text and number functions over other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import schemas, text
from pairwright.functions.calls import same_json
from pairwright.functions.canonical import finite_error, tokenizer_identity
from pairwright.functions.udf import vectorized
from pairwright.operators import agreement, contracts, evaluation, guards, malformed, metrics, rewards, statistics, training
from pairwright.plans.scaled import FOLDED, QUERY_SQL, table
from pairwright.plans.tables import TURN_PARAMETERS, TURNS_SQL, norm_text_sql, turn_tasks
from pairwright.sources import files
from pairwright.staging import Stage, move_only_file, shared_dir
from pairwright.streaming import resume

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(run):  # noqa: ANN001, ANN202
        QUERIES[run.__name__] = run
        ORACLE_SQL[run.__name__] = sql
        return run

    return add


# ----------------------------------------------------------------------------- tasks in SQL

#: Every task with the parts that its side and class give it.
TASKS_SQL = TURNS_SQL + """,
t AS (SELECT *, label <> 'CALL' AND conv_id % 13 <> 0 AS changed, substr(CASE WHEN conv_id % 2 = 0 THEN text ELSE asked END, 1, 12) AS value, CASE WHEN conv_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM k),
q AS (SELECT *, asked || CASE WHEN changed AND label IN ('ANSWER', 'CLARIFY') THEN ' (again)' ELSE '' END AS query, '{"conv":' || conv_id || CASE WHEN changed AND label = 'NOOP' THEN ',"done":true' ELSE '' END || '}' AS environment,
  CASE label WHEN 'CALL' THEN '<tool_call>{"arguments":{"conv":' || conv_id || '},"name":"look_up"}</tool_call>' WHEN 'ANSWER' THEN value WHEN 'CLARIFY' THEN 'Could you provide the missing city?'
    WHEN 'REFUSE' THEN 'I cannot complete that request because the required capability ''look_up'' is not available in the visible tools.' ELSE 'already done' END AS gold, row_number() OVER (ORDER BY task_id) - 1 AS place FROM t)"""


@query(TASKS_SQL + " SELECT task_id AS id, CASE WHEN label = 'CALL' AND conv_id > 60 THEN 'arguments' ELSE '' END AS broken FROM q")
def q_turn_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task against the contract of tasks."""
    return contracts.tasks(turn_tasks(spark, sf_dir)[0]).select("id", F.array_join("violations", ",").alias("broken"))


@query(TASKS_SQL + """ SELECT pair_id, CASE WHEN NOT changed THEN '' WHEN label IN ('ANSWER', 'CLARIFY') THEN 'query' WHEN label = 'REFUSE' THEN 'tools' ELSE 'environment' END AS changes,
  CASE WHEN changed THEN '' ELSE 'changes' END AS broken FROM q WHERE variant = 'abstain'""")
def q_turn_pair_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of tasks: what differs between its sides, and whether that is what its class declares."""
    found = contracts.pairs(turn_tasks(spark, sf_dir)[0])
    return found.select("pair_id", F.array_join("changes", ",").alias("changes"), F.array_join("violations", ",").alias("broken"))


@query(TASKS_SQL + " SELECT task_id, CASE WHEN failed AND raw_ <> '' THEN 'inference_error' ELSE '' END AS broken FROM (SELECT task_id, failed, CASE k WHEN 5 THEN '  ' ELSE 'x' END AS raw_ FROM q)")
def q_turn_prediction_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response against the contract of predictions: a failed one must have no output."""
    return contracts.predictions(turn_tasks(spark, sf_dir)[1]).select("task_id", F.array_join("violations", ",").alias("broken"))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query(TASKS_SQL + f""" SELECT task_id AS id, sha256({quoted(training.POLICIES["native_full"])}) AS system_hash, sha256('Environment state: ' || environment || chr(10) || chr(10) || 'Request: ' || query) AS user_hash, gold,
  CASE WHEN changed AND label = 'REFUSE' THEN 'send' ELSE 'look_up,send' END AS tools FROM q WHERE split = 'train'""")
def q_turn_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of all tasks of one split: prompt, right response and tools."""
    rows = training.sft_examples(turn_tasks(spark, sf_dir)[0].where("split = 'train'"), "train")
    said = lambda at: F.col("messages")[at]["content"]
    return rows.select("id", F.sha2(said(0), 256).alias("system_hash"), F.sha2(said(1), 256).alias("user_hash"), said(2).alias("gold"), F.array_join(F.transform("tools", lambda t: t["name"]), ",").alias("tools"))


def list_sql(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(quoted, names)) + "]"


PREFERRED_SQL = TASKS_SQL + f""",
a AS (SELECT pair_id, gold AS act_call FROM q WHERE variant = 'act'),
w AS (SELECT q.*, a.act_call, CASE WHEN variant = 'act' THEN {list_sql(training.ACT_KINDS)}[place % {len(training.ACT_KINDS)} + 1] ELSE {list_sql(training.ABSTAIN_KINDS)}[place % {len(training.ABSTAIN_KINDS)} + 1] END AS negative_type FROM q JOIN a USING (pair_id)),
p AS (SELECT *, CASE negative_type WHEN 'malformed_tool_call' THEN replace(act_call, '}}</tool_call>', '</tool_call>') WHEN 'wrong_decision_abstain' THEN {quoted(training.WRONG_DECISION)}
  WHEN 'wrong_tool' THEN replace(gold, 'look_up', 'send') WHEN 'wrong_arguments' THEN '<tool_call>{{"arguments":{{}},"name":"look_up"}}</tool_call>' WHEN 'schema_copying' THEN '<tool_call>{{"arguments":' || {quoted(TURN_PARAMETERS)} || ',"name":"look_up"}}</tool_call>'
  WHEN 'unnecessary_call' THEN act_call ELSE CASE WHEN label = 'REFUSE' THEN {quoted(training.ALREADY_DONE)} ELSE {quoted(training.NO_TOOL)} END END AS rejected FROM w)"""


@query(PREFERRED_SQL + " SELECT 'pref-' || task_id AS id, split, label AS target_class, negative_type, gold AS chosen, rejected FROM p")
def q_turn_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A right and a wrong response for every task, the kinds of wrong ones going around."""
    found = training.preferences(turn_tasks(spark, sf_dir)[0], "0" * 64)
    return found.select("id", "split", "target_class", "negative_type", "chosen", "rejected")


@query(PREFERRED_SQL + """, y AS (SELECT *, len(regexp_extract_all(environment || ' ' || query, '[^\\s]+')) AS asked_words FROM p)
SELECT 'dpo-' || task_id AS id, split, negative_type, least(asked_words + len(regexp_extract_all(gold, '[^\\s]+')) + {system}, 600) AS chosen_tokens,
  least(asked_words + len(regexp_extract_all(rejected, '[^\\s]+')) + {system}, 600) AS rejected_tokens, asked_words + {system} AS prompt_tokens FROM y""".replace("{system}", str(len(training.POLICIES["native_full"].split()) + 3 + 1)))
def q_turn_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences joined with their tasks' prompts, and how many words of them a limit of 600 leaves."""
    tasks = turn_tasks(spark, sf_dir)[0]
    examples = Stage(training.dpo_examples(training.preferences(tasks, "0" * 64), tasks, "0" * 64), "turn-comparisons").df

    def words(turns: list, open_turn: bool) -> list[int]:
        numbers = [hash_of(w) for m in turns if m["role"] != "assistant" for w in m["content"].split()]
        answers = [hash_of(w) for m in turns if m["role"] == "assistant" for w in m["content"].split()]
        return [*numbers, 0, *answers]

    counts = training.tokenized(examples, words, 600)
    sizes = counts.select("id", F.size("chosen").alias("chosen_tokens"), F.size("rejected").alias("rejected_tokens"), F.col("chosen_offset").alias("prompt_tokens"))
    return examples.select("id", "split", "negative_type").join(sizes, "id")


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode()) & 0x7FFFFFFF


# ---------------------------------------------------------------------------- stored and resumed


@query(TASKS_SQL + " SELECT task_id AS id, label, split, query, CASE WHEN label = 'ANSWER' THEN value END AS value, CASE WHEN label = 'CALL' THEN '{\"conv\":' || conv_id || '}' END AS arguments FROM q WHERE split = 'train'")
def q_stored_turn_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks written as JSON lines and read by the typed scan; ids must be unique and the split the one asked for."""
    path = shared_dir(spark, "turn-tasks")
    training.with_task_json(turn_tasks(spark, sf_dir)[0].where("split = 'train'")).select("json").write.text(path)
    rows = Stage(files.read_tasks(spark, path), "typed-tasks").df
    guards.strict(rows, guards.duplicates(rows, "id"), "ids must be unique")
    guards.strict(rows, rows.where("split != 'train'").select("id"), "rows of another split")
    return rows.select("id", "label", "split", "query", F.col("expected.validator.value").alias("value"), F.col("expected.arguments").alias("arguments"))


@query("SELECT conv_id || '-' || turn AS task_id, 'said ' || length(text) AS raw_text, 1 AS times FROM conversations")
def q_streamed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as a stream that brings every one twice, in several micro-batches and two runs: each is answered once."""
    root = shared_dir(spark, "turn-stream")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.length("text").alias("n"))
    for _ in range(2):
        turns.repartition(2).write.mode("append").parquet(f"{root}/in")

    def backend():  # noqa: ANN202
        return lambda row: {"raw_text": f"said {row['n']}", "latency_ms": 0.0}

    for _ in range(2):
        source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        resume.stream(source, backend, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return resume.Journal(spark, f"{root}/out", evaluation.PREDICTION).read().groupBy("task_id", "raw_text").agg(F.count("*").cast("int").alias("times"))


@query("""WITH r AS (SELECT a.conv_id || '-' || a.turn AS id, length(u.text) AS asked, length(a.text) AS chosen FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user')
SELECT id, -(asked + chosen)::DOUBLE AS chosen_logp, -(asked + 2)::DOUBLE AS rejected_logp, chosen AS chosen_tokens, 2 AS rejected_tokens FROM r""")
def q_reference_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every reply and of a wrong one, cached in two goes and checked against their examples."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.col("asked").alias("content")))
    rows = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("id"), prompt.alias("messages"), F.col("text").alias("chosen"), F.lit("no").alias("rejected"), F.sha2("text", 256).alias("example_hash"), "conv_id")
    examples, path = Stage(rows, "reference-examples").df, shared_dir(spark, "reference-turns")

    def scorer():  # noqa: ANN202
        return lambda prompt, reply: (-float(len(prompt[0]["content"]) + len(reply)), len(reply))

    resume.reference_cache(examples.where("conv_id % 2 = 0").drop("conv_id"), scorer, path)
    cached = resume.reference_cache(examples.drop("conv_id"), scorer, path)
    guards.strict(cached, training.reference_problems(examples, cached), "the cache does not match its examples")
    return cached.drop("example_hash")


# ------------------------------------------------------------------------------------- scoring

EXTERNAL_SQL = TASKS_SQL + """,
x AS (SELECT task_id, CASE WHEN variant = 'act' THEN 'simple' ELSE 'irrelevance' END AS category, CASE WHEN variant = 'act' THEN 'CALL' ELSE 'ABSTAIN' END AS expected_decision,
  CASE WHEN failed THEN NULL WHEN k IN (1, 2) THEN 'CALL' ELSE 'ABSTAIN' END AS predicted_decision, NOT failed AND k NOT IN (2, 5) AS protocol_correct FROM q),
d AS (SELECT *, coalesce(predicted_decision = expected_decision, false) AS correct FROM x)"""


def external_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, predictions = turn_tasks(spark, sf_dir)
    act = F.col("variant") == "act"
    records = tasks.select("id", F.when(act, "simple").otherwise("irrelevance").alias("category"), F.when(act, "CALL").otherwise("ABSTAIN").alias("expected_decision"))
    return evaluation.evaluate_external(records, predictions)


@query(EXTERNAL_SQL + " SELECT task_id, category, expected_decision, predicted_decision, correct, protocol_correct, CASE WHEN predicted_decision IS NULL THEN 'inference_error' WHEN correct THEN 'correct_decision' ELSE 'incorrect_decision' END AS reason_code FROM d")
def q_turn_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response as a decision to call or not, against the record that asks for it."""
    return external_turns(spark, sf_dir)


@query(EXTERNAL_SQL + """ SELECT count(*) AS task_count, round(avg(correct::INT), 9) AS decision_accuracy, round(avg(correct::INT) FILTER (expected_decision = 'CALL'), 9) AS call_accuracy,
  round(avg(correct::INT) FILTER (expected_decision = 'ABSTAIN'), 9) AS abstain_accuracy, round(avg(coalesce(predicted_decision = 'CALL', false)::INT), 9) AS tool_call_rate,
  round(avg((coalesce(predicted_decision = 'CALL', false) AND NOT protocol_correct)::INT), 9) AS malformed_call_rate, round((avg(correct::INT) FILTER (expected_decision = 'CALL') + avg(correct::INT) FILTER (expected_decision = 'ABSTAIN')) / 2, 9) AS balanced_accuracy,
  round(avg(correct::INT) FILTER (category = 'simple'), 9) AS simple FROM d""")
def q_turn_decision_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.external_metrics(Stage(external_turns(spark, sf_dir), "decisions").df)
    rates = ("decision_accuracy", "call_accuracy", "abstain_accuracy", "tool_call_rate", "malformed_call_rate", "balanced_accuracy")
    return found.select("task_count", *(F.round(c, 9).alias(c) for c in rates), F.round(F.col("per_category")["simple"], 9).alias("simple"))


JUDGED_TURNS_SQL = TURNS_SQL + """,
j AS (SELECT 'a-' || task_id AS audit_id, task_id, coalesce(predicted_class, 'UNCLEAR') = CASE WHEN length(task_id) % 2 = 0 THEN label ELSE 'ANSWER' END AS behavior, correct = (length(task_id) % 3 = 0) AS semantic, protocol_correct AS protocol FROM e)"""


def judged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, predictions = turn_tasks(spark, sf_dir)
    scored = Stage(evaluation.evaluate(tasks, predictions).drop("parsed_tool_call"), "scored").df
    audit, size = F.concat(F.lit("a-"), "id").alias("audit_id"), F.length("id")
    said = F.when(size % 2 == 0, F.col("label")).otherwise("ANSWER")
    annotations = tasks.select(audit, said.alias("predicted_behavior"), F.when(size % 3 == 0, "YES").otherwise("NO").alias("semantic_correctness"), F.lit("YES").alias("format_acceptable"), F.lit("").alias("notes"))
    guards.strict(annotations, agreement.annotation_problems(annotations, tasks.select(audit)), "bad annotations")
    return agreement.judged(annotations, tasks.select(audit, F.col("id").alias("task_id")), scored)


@query(JUDGED_TURNS_SQL + " SELECT audit_id, task_id, behavior, semantic, protocol, concat_ws(',', CASE WHEN NOT behavior THEN 'behavior' END, CASE WHEN NOT semantic THEN 'semantic' END, CASE WHEN NOT protocol THEN 'protocol' END) AS axes FROM j")
def q_judged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored response beside an annotation of it, and the axes on which they disagree."""
    return judged_turns(spark, sf_dir)


@query(JUDGED_TURNS_SQL + " SELECT count(*) AS item_count, round(avg(behavior::INT), 9) AS behavior_agreement, round(avg(semantic::INT), 9) AS semantic_agreement, round(avg(protocol::INT), 9) AS protocol_agreement, count(*) FILTER (NOT (behavior AND semantic AND protocol)) AS disagreements FROM j")
def q_turn_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agreement.evaluator_agreement(Stage(judged_turns(spark, sf_dir), "judged").df)
    return found.select("item_count", *(F.round(f"{a}_agreement", 9).alias(f"{a}_agreement") for a in ("behavior", "semantic", "protocol")), F.size("disagreements").cast("long").alias("disagreements"))


@query(TURNS_SQL + """, m AS (SELECT task_id, k = 2 AS before, k = 2 AND turn % 4 <> 3 OR k = 1 AND turn % 4 = 3 AS after FROM k)
SELECT count(*) FILTER (before) AS base_malformed_count, count(*) FILTER (after) AS candidate_malformed_count, count(*) FILTER (after AND NOT before) AS new_count, count(*) FILTER (before AND NOT after) AS resolved_count,
  count(*) FILTER (before AND after) AS persistent_count, coalesce(sha256(string_agg(task_id, ',' ORDER BY task_id) FILTER (after AND NOT before)), sha256('')) AS new_hash FROM m""")
def q_turn_malformed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed calls of two runs: those that one mends, and those that it breaks."""
    predictions = turn_tasks(spark, sf_dir)[1]
    late = (F.split("task_id", "-")[1].cast("int") % 4) == 3
    called = F.startswith("raw_text", F.lit("<tool_call>"))
    cut, mended = F.substring_index("raw_text", "}}</tool_call>", 1), F.concat("raw_text", F.lit("}}"))
    tried = F.startswith("raw_text", F.lit('{"name"'))
    other = predictions.withColumn("raw_text", F.when(late & called, cut).when(late & tried, mended).otherwise(F.col("raw_text")))
    found = malformed.compared(predictions, other)
    return found.select("base_malformed_count", "candidate_malformed_count", "new_count", "resolved_count", "persistent_count", F.sha2(F.array_join("new_ids", ","), 256).alias("new_hash"))


@query(TURNS_SQL + " SELECT e.task_id, CASE WHEN k.turn % 4 = 3 THEN 'correct' ELSE '' END AS broken FROM e JOIN k USING (task_id)")
def q_turn_evaluation_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation against its contract, the outcome of every fourth turn's turned around."""
    scored = Stage(evaluation.evaluate(*turn_tasks(spark, sf_dir)).drop("parsed_tool_call"), "scored").df
    late = (F.split("task_id", "-")[1].cast("int") % 4) == 3
    wrong = scored.withColumns({"correct": F.when(late, ~F.col("correct")).otherwise(F.col("correct")), "predicted_class": F.coalesce("predicted_class", F.lit("NOOP"))})
    return contracts.evaluations(wrong).select("task_id", F.array_join("violations", ",").alias("broken"))


@query(TURNS_SQL + ", o AS (SELECT correct::INT AS a, (correct AND length(task_id) % 2 = 0)::INT AS b FROM e) SELECT 'fewer' AS comparison, count(*) AS task_count, round(avg(b) - avg(a), 9) AS difference FROM o")
def q_paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two evaluations of the same responses, read from their files by id and outcome alone, paired and bootstrapped."""
    scored = Stage(evaluation.evaluate(*turn_tasks(spark, sf_dir)).drop("parsed_tool_call"), "scored").df
    paths = [shared_dir(spark, name) for name in ("base-run", "other-run")]
    for path, right in zip(paths, (F.col("correct"), F.col("correct") & (F.length("task_id") % 2 == 0)), strict=True):
        scored.withColumn("correct", right).write.json(path)
    rows = statistics.compared(files.read_correct(spark, paths[0]), files.read_correct(spark, paths[1]), "fewer", 3)
    found = statistics.paired_bootstrap(rows, 200)
    inside = (F.col("ci95_low") <= F.col("difference")) & (F.col("difference") <= F.col("ci95_high"))
    return guards.require(found, inside, "the interval does not hold the difference").select("comparison", "task_count", F.round("difference", 9).alias("difference"))


@query(TASKS_SQL + """, z AS (SELECT pair_id, max(label) FILTER (variant = 'abstain') AS label, max(query) FILTER (variant = 'act') AS act, max(query) FILTER (variant = 'abstain') AS abstain,
  max(CASE WHEN NOT changed THEN '' WHEN label IN ('ANSWER', 'CLARIFY') THEN 'query' WHEN label = 'REFUSE' THEN 'tools' ELSE 'environment' END) FILTER (variant = 'abstain') AS changes FROM q GROUP BY 1)
SELECT pair_id, sha256(pair_id || ' [' || label || '] changes=' || changes || chr(10) || '  act: ' || act || chr(10) || '  abstain: ' || abstain) AS lines_hash FROM z""")
def q_turn_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit lines of every pair of tasks."""
    from pairwright.operators import reports

    return reports.pair_audit(turn_tasks(spark, sf_dir)[0]).select("pair_id", F.sha2("text", 256).alias("lines_hash"))


@query(TURNS_SQL + " SELECT 'a-' || task_id AS audit_id, label AS predicted_behavior, CASE WHEN length(asked) % 2 = 0 THEN 'YES' ELSE 'UNCERTAIN' END AS semantic_correctness, 'NO' AS format_acceptable, CASE WHEN turn % 4 = 3 THEN 'say \"' || substr(asked, 1, 30) || '\", or' ELSE '' END AS notes FROM k")
def q_turn_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation of every task, with notes that hold quotes, commas and line ends, written as CSV and read strictly."""
    path = shared_dir(spark, "turn-annotations")
    tasks = turn_tasks(spark, sf_dir)[0]
    asked = F.regexp_replace("query", r" \(again\)$", "")
    late = (F.split("id", "-")[1].cast("int") % 4) == 3
    notes = F.when(late, F.concat(F.lit('say "'), F.substring(asked, 1, 30), F.lit('", or'))).otherwise("")
    rows = tasks.select(F.concat(F.lit("a-"), "id").alias("audit_id"), F.col("label").alias("predicted_behavior"), F.when(F.length(asked) % 2 == 0, "YES").otherwise("UNCERTAIN").alias("semantic_correctness"), F.lit("NO").alias("format_acceptable"), notes.alias("notes"))
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return files.read_annotations(spark, path)


@query("""SELECT 'bfcl-turn-' || conv_id || '-' || turn AS id, 'irrelevance' AS category, 'ABSTAIN' AS expected_decision, text AS query, '{"properties":{"conv":{"type":"integer"}},"type":"object"}' AS parameters, 'Turn_' || conv_id || '.' || turn AS original FROM conversations WHERE role = 'user'""")
def q_external_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as a file of external records, read by the adapter that tells category, decision, slugs and types."""
    folder, turns = shared_dir(spark, "external-turns"), table(spark, sf_dir, "conversations").where("role = 'user'")
    question = F.array(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    shape = F.from_json(F.lit('{"type":"dict","properties":{"conv":{"type":"int"}}}'), "type string, properties struct<conv:struct<type:string>>")
    function = F.array(F.struct(F.lit("look").alias("name"), F.lit("Looks.").alias("description"), shape.alias("parameters")))
    rows = turns.select(F.to_json(F.struct(F.concat(F.lit("Turn_"), "conv_id", F.lit("."), "turn").alias("id"), question.alias("question"), function.alias("function"))).alias("value"))
    rows.coalesce(1).write.text(f"{folder}/parts")
    path = f"{folder}/BFCL_v3_irrelevance.json"
    move_only_file(spark, f"{folder}/parts", path)
    found = files.read_external(spark, path, "a" * 40, "Apache-2.0")
    return found.select("id", "category", "expected_decision", files.user_text(F.col("messages")).alias("query"), F.col("functions")[0]["parameters"].alias("parameters"), F.col("provenance.original_id").alias("original"))


@query("""WITH v AS (SELECT doc_id, lang, n_chars FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN n_chars % 2 = 1 OR n_chars IS NULL THEN 'chars' END, CASE WHEN lang <> 'en' THEN 'lang' END, CASE WHEN doc_id % 10 = 0 THEN 'source' END) AS differs FROM v""")
def q_row_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded versions of a run for every document, against those wanted: some differ, some are missing."""
    given = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("chars"), (F.col("n_chars") % 2).cast("string"), F.lit("source"), F.when(F.col("doc_id") % 10 != 0, "x")), lambda k, v: v.isNotNull())
    docs = table(spark, sf_dir, "documents").select("doc_id", given.alias("versions"))
    return docs.select("doc_id", F.array_join(guards.version_gaps(F.col("versions"), {"lang": "en", "chars": "0", "source": "x"}), ",").alias("differs"))


@query("""WITH r AS (SELECT l_suppkey, min(l_discount) * 20 AS initial_margin, avg(l_discount) * 20 AS final_margin, avg((l_quantity > 20)::INT) AS reward_accuracy, max(l_partkey) AS a, min(l_partkey) AS b FROM lineitem GROUP BY 1)
SELECT l_suppkey, final_margin > initial_margin AND final_margin > 0 AND reward_accuracy >= 0.6 AND a <> b AS promoted FROM r""")
def q_supplier_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's lines as a trained run: whether it would be promoted."""
    runs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        (F.min("l_discount") * 20).alias("initial_margin"), (F.avg("l_discount") * 20).alias("final_margin"), F.avg((F.col("l_quantity") > 20).cast("int")).alias("reward_accuracy"),
        F.max("l_partkey").cast("string").alias("initial_hash"), F.min("l_partkey").cast("string").alias("final_hash"),
    )
    return rewards.promotion(runs).select("l_suppkey", "promoted")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_discount = 0 THEN 'logps' END, CASE WHEN l_linenumber - 1 <= 0 THEN 'tokens' END, CASE WHEN l_quantity > 25 THEN 'example_hash' END) AS broken FROM lineitem""")
def q_line_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a cached pair of log-probabilities against their contract: infinite ones, none of tokens, bad hashes."""
    lines = table(spark, sf_dir, "lineitem")
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    logp = F.when(F.col("l_discount") == 0, float("-inf")).otherwise(-F.col("l_discount"))
    rows = lines.select(*keys, logp.alias("chosen_logp"), (-F.col("l_tax")).alias("rejected_logp"), (F.col("l_linenumber") - 1).alias("chosen_tokens"), F.lit(3).alias("rejected_tokens"), F.when(F.col("l_quantity") > 25, "short").otherwise(F.sha2(F.col("l_partkey").cast("string"), 256)).alias("example_hash"))
    return contracts.reference_logps(rows).select(*keys, F.array_join("violations", ",").alias("broken"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN lang NOT IN ('en', 'de') THEN 'choice' END, CASE WHEN doc_id % 4 = 0 THEN 'source_uri' END, CASE WHEN doc_id % 3 = 0 THEN 'license' END, CASE WHEN coalesce(text, '') = '' THEN 'messages' END) AS broken FROM documents""")
def q_external_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an external record against the contract of its provenance."""
    docs = table(spark, sf_dir, "documents")
    decision = F.when(F.col("lang") == "en", "CALL").when(F.col("lang") == "de", "ABSTAIN").otherwise("MAYBE")
    provenance = F.struct(
        F.when(F.col("doc_id") % 4 == 0, "ftp://x").otherwise("https://x").alias("source_uri"), F.lit("0" * 40).alias("revision"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"),
        F.when(F.col("doc_id") % 3 == 0, "none").otherwise("MIT").alias("license"), F.lit("external_eval").alias("usage"),
    )
    said = F.when(F.coalesce("text", F.lit("")) != "", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    rows = docs.select("doc_id", F.concat(F.lit("d-"), "doc_id").alias("id"), decision.alias("expected_decision"), F.lit("simple").alias("category"), provenance.alias("provenance"), said.alias("messages"))
    return contracts.external(rows).select("doc_id", F.array_join("violations", ",").alias("broken"))


# --------------------------------------------------------------------------- functions over tables

PROP_SCHEMA = '{"properties":{"k":{"maximum":50,"minimum":3,"type":"int"}},"required":["k"],"type":"dict"}'


@query("""WITH v AS (SELECT event_id, (props->>'k')::INT AS k FROM events)
SELECT event_id, CASE WHEN k < 3 THEN '$.k: ' || k || ' breaks minimum 3' WHEN k > 50 THEN '$.k: ' || k || ' breaks maximum 50' END AS problem, k = event_id % 100 AS same, true AS finite FROM v""")
def q_prop_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties against a schema whose type names are normalised first, and as values equal to others."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    shape = schemas.normalize_schema(F.lit(PROP_SCHEMA))
    other = F.concat(F.lit('{ "k":'), (F.col("event_id") % 100).cast("string"), F.lit(".0}"))

    @vectorized("boolean")
    def finite(values):  # noqa: ANN001, ANN202
        import json

        return values.map(lambda t: finite_error(json.loads(t)) is None)

    return events.withColumn("shape", shape).select("event_id", schemas.argument_problem("shape", "props").alias("problem"), same_json("props", other).alias("same"), finite("props").alias("finite"))


@query(rf"""SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS url_slug, sha256(replace(html, '</', '<\/')) AS script_hash,
  TRY_CAST(nullif(regexp_extract(replace(url, ',', ''), '[-+]?[0-9]+(?:\.[0-9]+)?'), '') AS DOUBLE) AS number, regexp_matches(url, '^[a-z0-9][a-z0-9._-]*$') AS is_slug FROM pages""")
def q_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and numbers of all pages' addresses, and their HTML made safe inside a script."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.slug(url).alias("url_slug"), F.sha2(text.script_safe(F.col("html")), 256).alias("script_hash"), text.first_number(url).alias("number"), text.slug_ok(url).alias("is_slug"))


@query(f"""SELECT conv_id, turn, sha256({norm_text_sql("text")}) AS normal_hash, sha256({QUERY_SQL.format("text")}) AS query_hash, sha256(replace(trim(regexp_replace({FOLDED.format("text")}, '\\s+', ' ', 'g')), ' ', '-')) AS event_hash,
  len(list_filter(regexp_split_to_array(text, '(?i)\\s*(?:,|;|\\b(?:and)\\b|\\n|•)\\s*'), lambda x: x <> '')) AS pieces, contains({norm_text_sql("text")}, 'the ') AS mentions FROM conversations""")
def q_turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of all turns, and the pieces that they would be as answers."""
    t, normal = F.col("text"), text.normalize_text(F.col("text"))
    rows = table(spark, sf_dir, "conversations").withColumn("normal", normal)
    return rows.select(
        "conv_id", "turn", F.sha2("normal", 256).alias("normal_hash"), F.sha2(text.normalize_query(t), 256).alias("query_hash"), F.sha2(text.event_slug(t), 256).alias("event_hash"),
        F.size(text.answer_pieces(t)).cast("long").alias("pieces"), text.mentions_slot(F.col("normal"), F.array(F.lit("the_"))).alias("mentions"),
    )


@query("""SELECT doc_id, sha256('{"chat_template":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"' || source || '"' END || ',"class":"' || lang || '","eos_token_id":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE doc_id::VARCHAR END || '}') AS identity FROM documents""")
def q_row_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of a tokenizer for every document: language as class, source as template, id as end id, with nulls."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.select("doc_id", tokenizer_identity(F.col("lang"), F.when(F.col("doc_id") % 3 != 0, F.col("source")), F.when(F.col("doc_id") % 2 != 0, F.col("doc_id"))).alias("identity"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, printf('%.2f%%', l_discount * 100) AS share, format('{:g}', l_extendedprice) AS general FROM lineitem")
def q_line_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's discount as a percentage and its price as C's %g gives it."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.percent(F.col("l_discount")).alias("share"), text.general_format("l_extendedprice").alias("general"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 10 AS a, l_discount * 10 AS b, l_tax * 10 AS c, l_returnflag = 'A' AS masked FROM lineitem),
s AS (SELECT *, ln(exp(a) + exp(b) + exp(c)) AS z FROM r)
SELECT l_orderkey, count(*) FILTER (NOT masked) AS tokens, round(coalesce(sum(CASE l_linenumber % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE c END - z) FILTER (NOT masked), 0), 6) AS logp FROM s GROUP BY 1 HAVING count(*) FILTER (NOT masked) > 0""")
def q_order_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked log-probability of every order: its lines are steps with three logits each."""
    lines = table(spark, sf_dir, "lineitem")
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array(F.col("l_quantity") / 10, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("l"), (F.col("l_linenumber") % 3).alias("t"), F.when(F.col("l_returnflag") == "A", 0.0).otherwise(1.0).alias("m"))
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("s")).where(F.exists("s", lambda x: x["m"] > 0))  # an order has few lines
    part = lambda name: F.transform("s", lambda x: x[name])
    found = orders.select("l_orderkey", rewards.sequence_logp(part("l"), part("t"), part("m")).alias("x"))
    return found.select("l_orderkey", F.col("x.tokens").cast("long").alias("tokens"), F.round("x.logp", 6).alias("logp"))
