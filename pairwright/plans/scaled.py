"""Operators over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.numbers import softplus
from pairwright.functions.text import CALL_MARKS, looks_like_call, normalize_query, refuses, slug, whitespace_query
from pairwright.operators import agreement, guards, metrics, rewards, sampling, statistics
from pairwright.operators.overlap import contained, jaccard_groups, prepared, sequence_pairs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):  # noqa: ANN201
    def add(run):  # noqa: ANN001, ANN202
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


FOLDED = "replace(replace(lower({0}), 'ß', 'ss'), 'ſ', 's')"
QUERY_SQL = "array_to_string(regexp_extract_all(" + FOLDED + ", '[a-z0-9]+'), ' ')"


def norm_sql(column: str) -> str:
    return QUERY_SQL.format(column)


@query(f"SELECT sha256({norm_sql('text')}) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_exact_norm_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that agree in normalised query text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalize_query(F.col("text")), 256).alias("h"))
    return docs.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_exact_dup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("h"))
    return guards.duplicates(docs, "h")


GRAMS_SQL = "list_distinct(list_transform(range(1, greatest(2, length(p) - 3)), lambda i: substr(p, i, 5)))"


@query(f"""
WITH q AS (SELECT doc_id, '  ' || {norm_sql('text')} || '  ' AS p FROM documents),
g AS (SELECT doc_id, list_sort({GRAMS_SQL}) AS grams FROM q), s AS (SELECT grams, min(doc_id) AS doc_id, len(grams) AS n FROM g GROUP BY grams),
pairs AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, len(list_intersect(a.grams, b.grams)) AS c, a.n AS n1, b.n AS n2
          FROM s a JOIN s b ON a.doc_id < b.doc_id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n)
SELECT left_id, right_id, round(c / (n1 + n2 - c)::DOUBLE, 9) AS score FROM pairs WHERE c / (n1 + n2 - c)::DOUBLE >= 0.8
UNION ALL SELECT s.doc_id, g.doc_id, 1.0::DOUBLE FROM g JOIN s ON g.grams = s.grams AND g.doc_id != s.doc_id""")
def q_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with five-gram Jaccard of at least 0.8: prefixes of rarest grams, then whole sets; copies are listed with their first one."""
    rows = prepared(table(spark, sf_dir, "documents"), "doc_id", "text")
    return jaccard_groups(rows, 0.8).withColumn("score", F.round("score", 9))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's whole text."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
WITH k AS (SELECT doc_id % 5 AS split, trim(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ſ', 's'), '\\s+', ' ', 'g')) AS key FROM documents)
SELECT sha256(key) AS key_hash, count(DISTINCT split) AS splits FROM k GROUP BY key HAVING count(DISTINCT split) > 1""")
def q_query_split_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("split"), F.sha2(whitespace_query(F.col("text")), 256).alias("key_hash"))
    return guards.leaks(docs, "key_hash").select(F.col("key").alias("key_hash"), "splits")


@query("""
WITH p AS (SELECT quality AS a, toxic AS b FROM labels), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM p),
pe AS (SELECT sum(x.c * y.c) / (SELECT n * n::DOUBLE FROM n) AS pe FROM (SELECT a AS v, count(*) AS c FROM p GROUP BY 1) x JOIN (SELECT b AS v, count(*) AS c FROM p GROUP BY 1) y USING (v))
SELECT round(po, 9) AS exact_agreement, round((po - pe) / (1 - pe), 9) AS cohen_kappa FROM n, pe""")
def q_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agreement.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")
    return found.select(F.round("exact_agreement", 9).alias("exact_agreement"), F.round("cohen_kappa", 9).alias("cohen_kappa"))


@query("SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("label"), F.col("toxic").alias("predicted")).agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT unnest([0, 1]) AS class), t AS (SELECT class, count(*) FILTER (quality = class AND toxic = class) AS tp,
  count(*) FILTER (quality = class) AS support, count(*) FILTER (toxic = class) AS guessed FROM c, labels GROUP BY class),
p AS (SELECT CASE WHEN class = 1 THEN 'CALL' ELSE 'ANSWER' END AS class, support, CASE WHEN guessed = 0 THEN 0.0 ELSE tp / guessed END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r FROM t
  UNION ALL SELECT unnest(['CLARIFY', 'REFUSE', 'NOOP']), 0, 0.0, 0.0)
SELECT class, support, round(p, 9) AS prec, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM p""")
def q_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of a label that predicts another one, as two of the five classes; the others have no rows."""
    named = lambda c: F.when(F.col(c) == 1, "CALL").otherwise("ANSWER")
    rows = table(spark, sf_dir, "labels").select(named("quality").alias("label"), named("toxic").alias("predicted_class"))
    found = metrics.per_class(rows)
    return found.select("class", "support", F.round("precision", 9).alias("prec"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


@query("""
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('"' || doc_id || '"')) AS rn FROM documents)
SELECT doc_id, lang, source FROM r WHERE rn <= 1""")
def q_balanced_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each language and source by the hash of its id: a balanced sample."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.balanced(docs, ["lang", "source"], F.col("doc_id").cast("string"), 1)


@query("""
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, lang, source FROM r ORDER BY rn, lang, source LIMIT 100""")
def q_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hundred documents, taking turns between languages and sources."""
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 100)


@query("SELECT event_type, min(event_id) AS event_id, arg_min(user_id, event_id) AS user_id FROM events GROUP BY 1")
def q_first_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return sampling.first_of_each(rows, "event_type", "event_id").select("event_type", "event_id", "user_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events")
def q_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.positions(table(spark, sf_dir, "events").select("event_id"), "event_id")


@query("SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def q_positions_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all orders, with columns that travel along."""
    return sampling.positions(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")


@query("SELECT printf('row-%05d', row_number() OVER (ORDER BY c_custkey)) AS audit_id, c_custkey, c_name FROM customer")
def q_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "row-%05d")


MARKS_SQL = " OR ".join(f"contains(lower(text), '{m}')" for m in CALL_MARKS)
REFUSAL_SQL = r"\b(cannot|can''t|unable|no available tool|no tool|not equipped|unsupported|none of (?:the )?(?:provided|available) (?:functions|tools))\b"


@query(f"""
SELECT role, CASE WHEN {MARKS_SQL} THEN 'CALL' WHEN trim(text) = '' THEN 'EMPTY' WHEN regexp_matches(text, '{REFUSAL_SQL}', 'i') THEN 'REFUSE'
  WHEN contains(text, '?') THEN 'CLARIFY' ELSE 'ANSWER' END AS behavior, count(*) AS n FROM conversations GROUP BY 1, 2""")
def q_behavior_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by what they do, without a task's expectation."""
    text = F.col("text")
    kind = F.when(looks_like_call(text), "CALL").when(F.trim(text) == "", "EMPTY").when(refuses(text), "REFUSE").when(F.contains(text, F.lit("?")), "CLARIFY").otherwise("ANSWER")
    return table(spark, sf_dir, "conversations").groupBy("role", kind.alias("behavior")).agg(F.count("*").alias("n"))


@query("""
SELECT u.conv_id, u.turn, length(u.text) AS asked, length(a.text) AS answered FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def q_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    u = rows.where("role = 'user'").select("conv_id", "turn", F.length("text").alias("asked"))
    a = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("answered"))
    return u.join(a, ["conv_id", "turn"])


@query("""
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
b AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT max(event_type) FROM events))
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'resolved' WHEN a.user_id IS NULL THEN 'new' ELSE 'persistent' END AS outcome
FROM a FULL JOIN b ON a.user_id = b.user_id""")
def q_outcome_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type")
    ends = rows.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    tagged = rows.join(F.broadcast(ends))  # one row
    return guards.outcome_diff(tagged.where("event_type = lo"), tagged.where("event_type = hi"), "user_id")


@query("""
WITH p AS (SELECT o_orderkey // 2 AS pair, count(*) AS n, bool_and(o_orderstatus = 'F') AS ok FROM orders GROUP BY 1 HAVING count(*) = 2)
SELECT count(*) AS pairs, round(avg(ok::INT), 9) AS paired_accuracy FROM p""")
def q_paired_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 2).alias("pair")).agg(F.count("*").alias("n"), F.bool_and(F.col("o_orderstatus") == "F").alias("ok")).where("n = 2")
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("ok").cast("int")), 9).alias("paired_accuracy"))


@query(f"""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sample_std,
  round(avg(value) - {statistics.T_CRITICAL} * stddev_samp(value) / sqrt(count(value)), 6) AS ci95_low,
  round(avg(value) + {statistics.T_CRITICAL} * stddev_samp(value) / sqrt(count(value)), 6) AS ci95_high FROM events GROUP BY 1""")
def q_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.mean_interval(table(spark, sf_dir, "events"), "value", "event_type")
    return found.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sample_std", "ci95_low", "ci95_high")))


@query("""
WITH t AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, value AS v FROM events), n AS (SELECT count(*) AS n FROM t),
d AS (SELECT s AS sample, ('0x' || substr(sha256('q' || ':' || s || ':' || i), 1, 13))::BIGINT % (SELECT n FROM n) AS place FROM range(20) x(s), range((SELECT n FROM n)) y(i))
SELECT sample, round(avg(v), 6) AS mean FROM d JOIN t USING (place) GROUP BY 1""")
def q_bootstrap_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty bootstrap means over all events, with draws from hashes."""
    found = statistics.hashed_bootstrap(table(spark, sf_dir, "events"), "event_id", "value", 20, "q")
    return found.select("sample", F.round("mean", 6).alias("mean"))


@query("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key stands in the events' JSON."""
    return table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


LOSS_SQL = "greatest(-x, 0) + ln(1 + exp(-abs(x)))"


@query(f"""
WITH r AS (SELECT l_returnflag, -l_quantity AS pc, -l_extendedprice / 1000 AS pr, -l_quantity * (1 + l_discount) AS rc, -l_extendedprice / 1000 * (1 + l_tax) AS rr FROM lineitem),
s AS (SELECT l_returnflag, 0.1 * ((pc - pr) - (rc - rr)) AS x, 0.1 * (pc - rc) AS c, 0.1 * (pr - rr) AS r FROM r)
SELECT l_returnflag, round(avg({LOSS_SQL}), 6) AS loss, round(avg(c), 6) AS chosen_reward, round(avg(r), 6) AS rejected_reward, round(avg(c - r), 6) AS reward_margin,
  round(avg((c - r > 0)::INT), 6) AS reward_accuracy FROM s GROUP BY 1""")
def q_dpo_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = -F.col("l_quantity"), -F.col("l_extendedprice") / 1000
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", q.alias("policy_chosen"), p.alias("policy_rejected"), (q * (1 + F.col("l_discount"))).alias("reference_chosen"), (p * (1 + F.col("l_tax"))).alias("reference_rejected"))
    found = rewards.dpo_metrics(rows, 0.1, by="l_returnflag")
    return found.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("loss", "chosen_reward", "rejected_reward", "reward_margin", "reward_accuracy")))


@query("SELECT round(avg(l_extendedprice / 1000 / l_quantity), 6) AS chosen_sft_loss, round(0.5 + 0.25 * avg(l_extendedprice / 1000 / l_quantity), 6) AS loss FROM lineitem")
def q_anchored_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((-F.col("l_extendedprice") / 1000).alias("policy_chosen"), F.col("l_quantity").alias("chosen_tokens"))
    found = rewards.anchored_loss(rows, F.lit(0.5), 0.25)
    return found.select(F.round("chosen_sft_loss", 6).alias("chosen_sft_loss"), F.round("loss", 6).alias("loss"))


@query("SELECT o_orderkey, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 9) AS softplus FROM (SELECT o_orderkey, (o_totalprice - 150000) / 10000 AS x FROM orders)")
def q_softplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("o_totalprice") - 150000) / 10000
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(softplus(x), 9).alias("softplus"))


@query("""
SELECT c_custkey, list_filter([CASE WHEN NOT coalesce(regexp_matches(c_name, '^[A-Za-z]'), false) THEN 'name' END, CASE WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'balance' END,
  CASE WHEN NOT coalesce(c_nationkey BETWEEN 0 AND 24, false) THEN 'nation' END], lambda x: x IS NOT NULL) AS violations FROM customer""")
def q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the names of the constraints that they break."""
    checks = ((F.regexp_like("c_name", F.lit("^[A-Za-z]")), "name"), (F.col("c_acctbal") >= 0, "balance"), (F.col("c_nationkey").between(0, 24), "nation"))
    return table(spark, sf_dir, "customer").select("c_custkey", guards.violations(*checks).alias("violations"))


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier")
def q_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", slug(F.col("s_name")).alias("slug"))


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer)
SELECT k, 'left' AS side FROM o WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT k, 'right' AS side FROM c WHERE k NOT IN (SELECT k FROM o)""")
def q_id_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with no order, and orders of no customer."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return guards.id_gaps(orders, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT (event_id - 1) // 100 AS update_, round(avg(value), 6) AS value, count(*) AS n FROM (SELECT event_id + 1 AS event_id, value FROM events) GROUP BY 1")
def q_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("step"), "value")
    return sampling.accumulated(rows, "step", 100, "value").select(F.col("update").alias("update_"), F.round("value", 6).alias("value"), "n")


@query("SELECT conv_id, turn FROM conversations QUALIFY role <> first_value(role) OVER (PARTITION BY conv_id ORDER BY turn)")
def q_conflicting_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose role is not the conversation's first."""
    return sampling.conflicting_first(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn").select("conv_id", "turn")


@query()
def q_sequence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against the items without their first words by matching sequences (difflib, which SQL has not)."""
    items = table(spark, sf_dir, "benchmark")
    shaped = lambda text: items.select(F.col("item_id").alias("id"), normalize_query(text).alias("q")).withColumn("len", F.length("q"))
    return sequence_pairs(shaped(F.col("text")), shaped(F.regexp_replace("text", r"^(?:\S+\s+){2}", "")))
