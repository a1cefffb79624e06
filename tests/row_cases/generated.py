"""Generated tasks and the training rows made of them, every column, against SQL over an index."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.tools import CATALOGS
from pairwright.operators import generate, training

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(run):  # noqa: ANN001, ANN202
        QUERIES[run.__name__] = lambda spark, sf_dir: run(spark)
        ORACLE_SQL[run.__name__] = sql
        return run

    return add


def flat(tasks: DataFrame) -> DataFrame:
    """Every part of a task that its generator chooses."""
    e = F.col("expected")
    return tasks.select(
        "id", "label", "query", "environment", F.array_join(F.transform("tools", lambda t: t["name"]), ",").alias("tools"), F.col("perturbation").alias("change"), e["tool_name"].alias("tool"), e["arguments"].alias("arguments"), e["expected_result"].alias("result"),
        e["validator"]["value"].alias("answer"), F.try_element_at(e["missing_slots"], F.lit(1)).alias("slot"), e["unavailable_capability"].alias("capability"), e["state_assertion"].alias("assertion"), F.array_join(e["allowed_markers"], "|").alias("markers"),
    )


def names(domain: str, without: str | None = None) -> str:
    return "'" + ",".join(n for n, _, _ in CATALOGS[domain] if n != without) + "'"


def side(kind: str, variant: str, query: str, environment: str, tools: str, domain: str, **wanted: str) -> str:
    """SELECT of one side of a class of tasks from the relation i; wanted gives what is expected, as SQL."""
    change = "NULL" if variant == "act" else f"'{generate.PERTURBATIONS[kind]}'"
    columns = [f"{wanted.get(c, 'NULL')}::VARCHAR AS {c}" for c in ("tool", "arguments", "result", "answer", "slot", "capability", "assertion", "markers")]
    label = "CALL" if variant == "act" else kind
    return f"SELECT printf('{domain}-{kind.lower()}-%03d-{variant}', i) AS id, '{label}' AS label, {query} AS query, {environment} AS environment, {tools} AS tools, {change}::VARCHAR AS change, {', '.join(columns)} FROM i"


CURRENCIES = "['USD', 'EUR', 'GBP', 'JPY', 'CAD']"


def finance_sql() -> str:
    account, other, every = "'acct-' || (1000 + i)", "'acct-' || (2000 + i)", names("finance")
    held = """'{"balances":{"acct-' || (1000 + i) || '":' || (1000 + i) || '}}'"""
    moved = {"tool": "'transfer'", "arguments": """'{"amount":' || (10 + i) || '.0,"destination":"acct-' || (2000 + i) || '","source":"acct-' || (1000 + i) || '"}'""", "result": """'{"amount":' || (10 + i) || '.0,"status":"transferred"}'"""}
    base, quote = f"{CURRENCIES}[i // 5 + 1]", f"{CURRENCIES}[(i % 5 + i // 5 + 1) % 5 + 1]"
    ask, rate = f"'Transfer $' || (10 + i) || ' from ' || {account} || ' to ' || {other} || '.'", f"'Get the current ' || {base} || ' to ' || {quote} || ' exchange rate.'"
    pair = f"""'{{"base":"' || {base} || '","quote":"' || {quote} || '"'"""
    sides = [
        side("ANSWER", "act", f"'What is the balance of ' || {account} || '?'", held, every, "finance", tool="'get_balance'", arguments=f"""'{{"account_id":"' || {account} || '"}}'""", result=f"""'{{"account_id":"' || {account} || '","balance":' || (1000 + i) || '}}'"""),
        side("ANSWER", "abstain", f"'The balance of ' || {account} || ' is $' || (1000 + i) || '. What is its balance?'", held, every, "finance", answer="'$' || (1000 + i)"),
        side("CLARIFY", "act", ask, held, every, "finance", **moved), side("CLARIFY", "abstain", f"'Transfer $' || (10 + i) || ' to ' || {other} || '.'", held, every, "finance", slot="'source'"),
        side("REFUSE", "act", rate, "'{\"index\":' || i || '}'", every, "finance", tool="'fx_rate'", arguments=f"{pair} || '}}'", result=f"{pair} || ',\"rate\":' || (0.9::DOUBLE + i / 1000::DOUBLE) || '}}'"),
        side("REFUSE", "abstain", rate, "'{\"index\":' || i || '}'", names("finance", "fx_rate"), "finance", capability="'fx_rate'"),
        side("NOOP", "act", ask, "'{\"transfer_status\":\"pending\"}'", every, "finance", **moved),
        side("NOOP", "abstain", ask, "'{\"transfer_status\":\"completed\"}'", every, "finance", assertion="'The transfer is already completed.'", markers="'already transferred|no action needed'"),
    ]
    return "WITH i AS (SELECT range AS i FROM range(25)) " + " UNION ALL ".join(sides)


@query(finance_sql())
def q_gen_finance(spark: SparkSession) -> DataFrame:
    return flat(generate.finance_tasks(spark))


CITIES = "[" + ", ".join(f"'{c}'" for c in generate.CITIES) + "]"


def weather_sql() -> str:
    every, miles = names("weather"), "'{\"miles\":' || (100 + i) || '}'"
    warm = """'{"weather":{"' || c || '":' || (60 + i) || '}}'"""
    hour = "printf('%02d:00', i % 12 + 1)"
    place = """'"lat":' || (30 + i / 10::DOUBLE) || ',"lon":' || (-90 - i / 10::DOUBLE) || '}'"""
    address = "(100 + i) || ' Main St, ' || c"
    sides = [
        side("ANSWER", "act", "'What is the temperature in ' || c || '?'", warm, every, "weather", tool="'get_weather'", arguments="""'{"city":"' || c || '"}'""", result="""'{"city":"' || c || '","temperature_f":' || (60 + i) || '}'"""),
        side("ANSWER", "abstain", "'It is ' || (60 + i) || '°F in ' || c || '. What is the temperature there?'", warm, every, "weather", answer="(60 + i) || '°F'"),
        side("CLARIFY", "act", "'Calculate the distance from ' || c || ' to ' || o || '.'", miles, every, "weather", tool="'distance'", arguments="""'{"destination":"' || o || '","origin":"' || c || '"}'""", result="""'{"destination":"' || o || '","miles":' || (100 + i) || ',"origin":"' || c || '"}'"""),
        side("CLARIFY", "abstain", "'Calculate the distance from ' || c || '.'", miles, every, "weather", slot="'destination'"),
        side("REFUSE", "act", "'What time is it in ' || c || '?'", f"""'{{"time":"' || {hour} || '"}}'""", every, "weather", tool="'get_time'", arguments="""'{"city":"' || c || '"}'""", result=f"""'{{"city":"' || c || '","time":"' || {hour} || '"}}'"""),
        side("REFUSE", "abstain", "'What time is it in ' || c || '?'", f"""'{{"time":"' || {hour} || '"}}'""", names("weather", "get_time"), "weather", capability="'get_time'"),
        side("NOOP", "act", f"'Geocode ' || {address} || '.'", f"""'{{"coordinates":{{' || {place} || ',"geocoded":{{}}}}'""", every, "weather", tool="'geocode'", arguments=f"""'{{"address":"' || {address} || '"}}'""", result=f"""'{{"address":"' || {address} || '",' || {place}"""),
        side("NOOP", "abstain", f"'Geocode ' || {address} || '.'", f"""'{{"geocoded":{{"' || {address} || '":{{' || {place} || '}}}}'""", every, "weather", assertion="'The address is already geocoded.'", markers="'already geocoded|no action needed'"),
    ]
    return f"WITH i AS (SELECT range AS i, {CITIES}[range + 1] AS c, {CITIES}[(range + 7) % 25 + 1] AS o FROM range(25)) " + " UNION ALL ".join(sides)


@query(weather_sql())
def q_gen_weather(spark: SparkSession) -> DataFrame:
    return flat(generate.weather_tasks(spark))


PROTOCOL_SQL = """WITH i AS (SELECT range AS i, range % 4 AS k FROM range(20)), p AS (SELECT i, k,
  ['submit_order', 'run_report', 'plan_route', 'render_asset'][k + 1] AS tool, ['order', 'filters', 'metadata', 'layers'][k + 1] AS slot,
  ['Submit this structured order', 'Run this filtered report', 'Plan this multi-point route', 'Render this layered asset'][k + 1] AS verb,
  CASE k WHEN 0 THEN '"order":{"id":"ord-' || (1000 + i) || '","items":[{"quantity":2,"sku":"sku-' || printf('%03d', i) || '"},{"quantity":1,"sku":"sku-' || printf('%03d', i + 1) || '"}],"priority":' || (i % 2 = 0) || '}'
    WHEN 1 THEN '"filters":{"active":true,"regions":["north","west"],"threshold":' || round(0.25::DOUBLE + i / 100::DOUBLE, 2) || '}'
    WHEN 2 THEN '"metadata":{"note":null,"owner":"owner-' || i || '"}' ELSE '"layers":[{"opacity":0.75,"text":"Layer ' || i || '"},{"opacity":1.0,"text":"✓ Unicode"}]' END AS lead,
  CASE k WHEN 0 THEN '"tags":["fragile","batch-' || (i % 5) || '"]' WHEN 1 THEN '"format":"json","limit":' || (25 + i)
    WHEN 2 THEN '"points":[{"lat":' || (41.8::DOUBLE + i / 100::DOUBLE) || ',"lon":-87.7},{"lat":' || (41.9::DOUBLE + i / 100::DOUBLE) || ',"lon":-87.6}],"round_trip":false'
    ELSE '"options":{"background":"#112233","transparent":false},"size":{"height":720,"width":1280}' END AS rest FROM i),
a AS (SELECT *, '{' || lead || ',' || rest || '}' AS whole, '{"case":' || i || ',"source":"internal_generated"}' AS environment FROM p)
SELECT printf('protocol-%03d-act', i + 1) AS id, 'CALL' AS label, verb || ' using these exact arguments: ' || whole AS query, environment, tool AS tools, NULL::VARCHAR AS change, tool, whole AS arguments, '{"accepted":true}' AS result,
  NULL::VARCHAR AS answer, NULL::VARCHAR AS slot, NULL::VARCHAR AS capability, NULL::VARCHAR AS assertion, NULL::VARCHAR AS markers, CASE WHEN i < 16 THEN 'train' ELSE 'validation' END AS split FROM a
UNION ALL SELECT printf('protocol-%03d-abstain', i + 1), 'CLARIFY', verb || ' using these arguments: {' || rest || '}', environment, tool, 'required_argument_removed', NULL, NULL, NULL, NULL, slot, NULL, NULL, NULL, CASE WHEN i < 16 THEN 'train' ELSE 'validation' END FROM a"""


@query(PROTOCOL_SQL)
def q_gen_protocol(spark: SparkSession) -> DataFrame:
    tasks = generate.protocol_tasks(spark)
    return flat(tasks).join(tasks.select("id", "split"), "id")


# ------------------------------------------------------------------------------ training rows

#: Replies of finance tasks, from their flat rows.
GOLD_SQL = """CASE WHEN label = 'CALL' THEN '<tool_call>{"arguments":' || arguments || ',"name":"' || tool || '"}</tool_call>' WHEN label = 'ANSWER' THEN answer WHEN label = 'CLARIFY' THEN 'Could you provide the missing ' || slot || '?'
  WHEN label = 'NOOP' THEN split_part(markers, '|', 1) ELSE 'I cannot complete that request because the required capability ''' || capability || ''' is not available in the visible tools.' END"""
SPLIT_SQL = "CASE WHEN substr(id, -7 - (CASE WHEN id LIKE '%-act' THEN 0 ELSE 4 END), 3)::INT % 5 < 3 THEN 'train' WHEN substr(id, -7 - (CASE WHEN id LIKE '%-act' THEN 0 ELSE 4 END), 3)::INT % 5 = 3 THEN 'validation' ELSE 'test' END"
ALL_IDS_SQL = "SELECT printf('%s-%s-%03d-%s', domain, kind, i, variant) AS id FROM (SELECT unnest(['finance', 'productivity', 'weather']) AS domain), (SELECT unnest(['answer', 'clarify', 'noop', 'refuse']) AS kind), (SELECT range AS i FROM range(25) WHERE range % 5 < 4), (SELECT unnest(['abstain', 'act']) AS variant)"


@query(f"""WITH t AS ({finance_sql()}), s AS (SELECT *, {SPLIT_SQL} AS split FROM t)
SELECT id, split, environment, query, {GOLD_SQL} AS reply FROM s WHERE split != 'test'""")
def q_sft_examples(spark: SparkSession) -> DataFrame:
    """Training conversations of finance tasks: state, request and reply, of both splits."""
    tasks, found = generate.corpus(spark).where("domain = 'finance'"), None
    for split in ("train", "validation"):
        one = training.sft_examples(tasks.where(F.col("split") == split), split).withColumn("split", F.lit(split))
        found = one if found is None else found.unionByName(one)
    parts = F.split(F.col("messages")[1]["content"], "\n\nRequest: ")
    return found.select("id", "split", F.regexp_replace(parts[0], "^Environment state: ", "").alias("environment"), parts[1].alias("query"), F.col("messages")[2]["content"].alias("reply"))


def _parameters_sql() -> str:
    rows = ", ".join(f"('{n}', '{json.dumps(p, sort_keys=True, separators=(',', ':'))}')" for n, _, p in CATALOGS["finance"])
    return f"SELECT * FROM (VALUES {rows}) v(tool, parameters)"


@query(f"""WITH t AS ({finance_sql()}), s AS (SELECT *, {SPLIT_SQL} AS split, regexp_replace(id, '-(act|abstain)$', '') AS pair_id, {GOLD_SQL} AS gold FROM t), every AS ({ALL_IDS_SQL}),
places AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM every), schemas AS ({_parameters_sql()}),
k AS (SELECT s.*, place, CASE WHEN s.id LIKE '%-act' THEN ['wrong_decision_abstain', 'wrong_tool', 'wrong_arguments', 'malformed_tool_call', 'schema_copying'][place % 5 + 1] ELSE ['unnecessary_call', 'wrong_abstention_class', 'malformed_tool_call'][place % 3 + 1] END AS kind
      FROM s JOIN places USING (id)),
a AS (SELECT pair_id, gold AS act_call, tool AS act_tool, arguments AS act_arguments FROM s WHERE id LIKE '%-act')
SELECT 'pref-' || id AS id, split, label AS target_class, kind AS negative_type, gold AS chosen,
  CASE WHEN kind = 'malformed_tool_call' THEN regexp_replace(act_call, '}}</tool_call>$', '</tool_call>') WHEN kind = 'wrong_decision_abstain' THEN 'I cannot complete this request with the visible tools.'
    WHEN kind = 'wrong_tool' THEN '<tool_call>{{"arguments":' || act_arguments || ',"name":"' || CASE WHEN act_tool = 'get_balance' THEN 'transfer' ELSE 'get_balance' END || '"}}</tool_call>'
    WHEN kind = 'wrong_arguments' THEN '<tool_call>{{"arguments":{{}},"name":"' || act_tool || '"}}</tool_call>' WHEN kind = 'schema_copying' THEN '<tool_call>{{"arguments":' || parameters || ',"name":"' || act_tool || '"}}</tool_call>'
    WHEN kind = 'unnecessary_call' THEN act_call WHEN label = 'REFUSE' THEN 'No action is needed; the request is already complete.' ELSE 'I cannot complete this request because no visible tool supports it.' END AS rejected
FROM k JOIN a USING (pair_id) LEFT JOIN schemas ON schemas.tool = a.act_tool""")
def q_preferences(spark: SparkSession) -> DataFrame:
    """Chosen and rejected replies of finance tasks; the kind goes around by the place among the ids of all domains."""
    tasks = generate.corpus(spark).where("split != 'test'")
    return training.preferences(tasks, "0" * 64).where("task_id like 'finance-%'").select("id", "split", "target_class", "negative_type", "chosen", "rejected")


@query("""
WITH d AS (SELECT unnest(['finance', 'productivity', 'weather']) AS domain), k AS (SELECT unnest(['answer', 'clarify', 'noop', 'refuse']) AS kind), i AS (SELECT range AS i FROM range(25) WHERE range % 5 = 3), v AS (SELECT unnest(['act', 'abstain']) AS variant),
r AS (SELECT domain, kind, i, row_number() OVER (PARTITION BY domain, kind ORDER BY i) AS turn FROM d, k, i), s AS (SELECT * FROM r ORDER BY turn, domain, upper(kind) LIMIT 30)
SELECT printf('dpo-%s-%s-%03d-%s', domain, kind, i, variant) AS id, 'validation' AS split, 2 AS turns FROM s, v""")
def q_dpo_selection(spark: SparkSession) -> DataFrame:
    """Sixty of the validation preference examples, pairs taking turns between domains and classes."""
    tasks = generate.corpus(spark).where("split != 'test'")
    prefs = training.preferences(tasks, "0" * 64).where("split = 'validation'")
    return training.dpo_examples(prefs, tasks, "0" * 64, 60).select("id", "split", F.size("messages").alias("turns"))


@query("""WITH d AS (SELECT unnest(['finance', 'productivity', 'weather']) AS domain), k AS (SELECT unnest(['answer', 'clarify', 'noop', 'refuse']) AS kind), i AS (SELECT range AS i FROM range(25)), v AS (SELECT unnest(['act', 'abstain']) AS variant)
SELECT printf('%s-%s-%03d-%s', domain, kind, i, variant) AS id, CASE WHEN i % 5 < 3 THEN 'train' WHEN i % 5 = 3 THEN 'validation' ELSE 'test' END AS split FROM d, k, i, v""")
def q_corpus_splits(spark: SparkSession) -> DataFrame:
    """Every task of the corpus with its split."""
    return generate.corpus(spark).select("id", "split")


@query("""WITH d AS (SELECT unnest(['finance', 'productivity', 'weather']) AS domain), k AS (SELECT unnest(['ANSWER', 'CLARIFY', 'NOOP', 'REFUSE']) AS label), i AS (SELECT range AS i FROM range(25) WHERE range % 5 = 3), v AS (SELECT unnest(['act', 'abstain']) AS variant),
t AS (SELECT printf('%s-%s-%03d-%s', domain, lower(label), i, variant) AS task_id, domain, CASE WHEN variant = 'act' THEN 'CALL' ELSE label END AS label FROM d, k, i, v),
r AS (SELECT *, sha256('"' || task_id || '"') AS h, row_number() OVER (PARTITION BY domain, label ORDER BY sha256('"' || task_id || '"')) AS n FROM t)
SELECT printf('audit-%03d', row_number() OVER (ORDER BY h)) AS audit_id, task_id, 'said ' || task_id AS response FROM r WHERE n <= 4""")
def q_calibration_packet(spark: SparkSession) -> DataFrame:
    """Four tasks of each domain and label by hash, numbered in the order of their hashes, with their responses."""
    from pairwright.operators.reports import calibration_packet

    tasks = generate.corpus(spark).where("split = 'validation'")
    said = tasks.select(F.col("id").alias("task_id"), F.concat(F.lit("said "), "id").alias("raw_text"))
    return calibration_packet(tasks, said).select("audit_id", "task_id", "response")
