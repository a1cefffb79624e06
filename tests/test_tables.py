"""Operators over whole tables: against plain Python, on small tables with hard cases, and the queries against their SQL."""

import difflib
import hashlib
import json
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwright.functions import canonical
from pairwright.operators import declared, evaluation, overlap, sampling, segments, setjoin, statistics
from pairwright.plans import tables, turns
from pairwright.sources import files
from pairwright.streaming import resume
from pairwright.streaming.journal import Journal

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------------------- overlap


def edited(rng, text, times):
    text = list(text)
    for _ in range(times):
        at, turn = rng.randrange(len(text) + 1), rng.random()
        if turn < 0.34 and at < len(text):
            text[at] = rng.choice("abcdef ")
        elif turn < 0.67:
            text.insert(at, rng.choice("abcdef "))
        elif at < len(text):
            del text[at]
    return "".join(text)


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.95])
def test_segments_find_what_all_pairs_hold(spark, threshold):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 7, 9, 12, 14, 18, 23, 27, 40, 60, 90, 150, 240) for _ in range(2)]
    left = [edited(rng, t, rng.randint(0, max(1, len(t) // 8))) for t in base for _ in range(2)] + ["", ""]
    right = base + [edited(rng, t, rng.randint(0, max(1, len(t) // 12))) for t in base]
    want = {}
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            score = difflib.SequenceMatcher(None, a, b).ratio() if 2 * min(len(a), len(b)) >= threshold * (len(a) + len(b)) else 0
            if score >= threshold:
                want[i, j] = score
    shaped = lambda texts: spark.createDataFrame([*enumerate(texts), (999, None)], "id long, q string")
    a, b = shaped(left), shaped(right)
    assert {(r.left_id, r.right_id): r.score for r in segments.matching(a, b, threshold).collect()} == want
    assert segments.candidates(a, b, threshold).count() < len(left) * len(right) / 6
    assert segments.matching(a.limit(0), b, threshold).collect() == []


def test_many_texts_of_common_pieces_leave_no_candidates_by_chance(monkeypatch):
    rng = random.Random(8)
    syllables = ["th", "er", "on", "an", "re", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "the ", "and ", "of ", " ", ". "]
    for few, lengths in ((1, (5, 30, 64, 90, 150, 250)), (8, (700,)), (8, (1700,))):
        monkeypatch.setattr(segments, "FEW", few)
        monkeypatch.setattr(segments, "ROWS", 7)
        monkeypatch.setattr(segments, "COLUMNS", 50)
        base = ["".join(rng.choice(syllables) for _ in range(n))[:n] for n in lengths for _ in range(20)]
        near = [edited(rng, t, rng.randint(0, len(t) // 9)) for t in base]
        x, y = (segments.Texts(pa.table({"id": range(len(t)), "n": pa.array([len(v) for v in t], pa.int32()), "map": pa.array([v.encode() for v in t], pa.binary())})) for t in (base, near))
        want = {(i, j) for i, a in enumerate(x.texts) for j, b in enumerate(y.texts) if 2 * min(len(a), len(b)) >= 0.9 * (len(a) + len(b)) and 2 * segments.common_subsequence(a, b) >= 0.9 * (len(a) + len(b)) - 1e-6}
        asked = []
        plain = segments.matched_in_order
        monkeypatch.setattr(segments, "matched_in_order", lambda *a, asked=asked, plain=plain: asked.append(1) or plain(*a))
        assert set(zip(*(p.tolist() for p in segments.near_places(x, y, 0.9)), strict=True)) == want and len(want) >= len(lengths) * 10
        monkeypatch.setattr(segments, "matched_in_order", plain)
        assert len(asked) <= 2 * len(want)  # the texts themselves are looked at for few others


def test_long_texts_meet_by_windows_and_not_by_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgkqjxz", k=rng.randint(1, 8))) for _ in range(60)]
    base = [" ".join(rng.choices(words, k=n))[: 5 * n] for n in (40, 41, 45, 60, 90, 200, 300) for _ in range(4)]
    base += ["".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=400)), "ab" * 150, "a" * 200, "a" * 199, "".join(map(chr, range(0x4E00, 0x4F00))), "the the the " * 30]
    left = [edited(rng, t, rng.randint(0, len(t) // 12)) for t in base for _ in range(2)] + [t[rng.randint(1, 40) :] for t in base] + [t[:90] + t[120:] for t in base]
    want = {}
    for i, a in enumerate(left):
        for j, b in enumerate(base):
            score = difflib.SequenceMatcher(None, a, b).ratio() if 2 * min(len(a), len(b)) >= 0.9 * (len(a) + len(b)) else 0
            if score >= 0.9:
                want[i, j] = score
    compared = []
    plain = segments.by_blocks
    monkeypatch.setattr(segments, "by_blocks", lambda a, b, *rest: compared.extend(r.n for r in b.select("n").collect()) or plain(a, b, *rest))
    monkeypatch.setattr(segments, "CHARS", 700)
    shaped = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, q string")
    found = {(r.left_id, r.right_id): r.score for r in segments.matching(shaped(left), shaped(base), 0.9).collect()}
    assert found == want and sum(len(base[j]) >= 200 for _, j in want) > 40
    assert sorted(compared) == [199, 256]  # a short one, and one of which every character is looked for


def test_windows_of_a_pair_are_as_many_as_its_blocks_need():
    rng = random.Random(12)
    for _ in range(300):
        places, length = sorted(rng.sample(range(12), rng.randint(1, 5))), 12
        for longest in (1, 2, 3, 5):
            best = {0: 0}  # by last end, what blocks cover
            for at in places:
                for end, found in sorted(best.items()):
                    for start in range(max(end, at - longest + 1), at + 1):
                        for stop in range(at + 1, min(length, start + longest) + 1):
                            best[stop] = max(best.get(stop, 0), found + stop - start)
            assert segments.covered(places, longest, length) == max(best.values())


def test_copies_are_not_paired_with_copies(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    left = spark.createDataFrame([(i, long) for i in range(40)] + [(40, "else"), (41, None), (42, "")], "id long, q string")
    right = spark.createDataFrame([(100 + i, long + "s") for i in range(30)] + [(200, None), (201, ""), (202, "")], "id long, q string")
    rows = segments.groups(left, right, 0.9).collect()
    assert {(r.left_id, r.right_id) for r in rows if r.side is None} == {(0, 100), (42, 201)}
    assert {(r.left_id, r.right_id) for r in rows if r.side == "left"} == {(0, i) for i in range(1, 40)}
    assert {(r.left_id, r.right_id) for r in rows if r.side == "right"} == {(100, i) for i in range(101, 130)} | {(201, 202)}
    assert segments.matching(left, right, 0.9).count() == 40 * 30 + 2


def test_common_subsequences():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        assert segments.common_subsequence(a, b) == row[-1]


def test_sets_are_joined_as_all_pairs_are(spark):
    rng, sets = random.Random(4), []
    for n in (1, 2, 3, 5, 10, 40, 200, 1500, 5000):
        for _ in range(2):
            base = [rng.randrange(n * 3) for _ in range(n)]
            sets += [{x if rng.random() > 0.08 else rng.randrange(n * 3) for x in base} for _ in range(4)]
    sets = [{int.from_bytes(hashlib.md5(b"%d" % x).digest()[:8], "little", signed=True) for x in s} for s in sets]
    rows = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)] + [(9999, []), (9998, None)], "id long, grams array<long>")
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= 0.8 * len(a | b)}
    assert {(r.left_id, r.right_id): r.score for r in setjoin.similar(rows, rows, 0.8, self_join=True).collect()} == want
    both = {(r.left_id, r.right_id): r.score for r in setjoin.similar(rows, rows, 0.8).collect()}
    assert {k: v for k, v in both.items() if k[0] < k[1]} == want and all(both[i, i] == 1 for i in range(len(sets)))


def test_bitmaps_bound_differences():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 40), (500, 520), (3000, 9000)):
        a, b = rng.integers(-(2**62), 2**62, n), rng.integers(-(2**62), 2**62, m)
        b[: n // 2] = a[: n // 2]
        bits = lambda x: max(64, 1 << int(2 * len(x) - 1).bit_length())
        apart = setjoin.differing_bits(setjoin.parity_bits(a, bits(a)).tobytes(), setjoin.parity_bits(b, bits(b)).tobytes())
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
        assert setjoin.differing_bits(*[setjoin.parity_bits(a, bits(a)).tobytes()] * 2) == 0


def test_queries_that_many_rows_share_are_compared_once(spark):
    external = spark.createDataFrame([(f"e{i}", "please close ticket number twelve now") for i in range(30)] + [("x", "other words"), ("n", None)], "id string, query string")
    internal = spark.createDataFrame([(f"i{i}", "Please close ticket number twelve, now!", "train", 7 + i) for i in range(30)] + [("j", "please close ticket number twelve nov", "test", 3)], "id string, query string, split string, ord long")
    found = {r.external_id: (r.internal_id, r.internal_split, r.method) for r in overlap.overlap(external, internal).collect()}
    assert found == {f"e{i}": ("j", "test", "five_gram_jaccard") for i in range(30)}


# ------------------------------------------------------------------------------- scans and sinks


def test_lines_are_numbered_over_splits(spark, tmp_path):
    rng, want = random.Random(2), []
    for n in range(3):
        lines = [rng.choice(['{"a":%d}' % k, "", "  ", '{"a":1,"b":"é "}', '{"a":2}\r']) for k in range(300 * n + 3)]
        (tmp_path / f"f{n}.jsonl").write_text("\n".join(lines) + ("\n" if n != 1 else ""), newline="")
        want += [(f"f{n}.jsonl", i, line) for i, line in enumerate(lines, 1) if line.strip()]
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key, value in zip(before, ("500", "1"), strict=True):
        spark.conf.set(key, value)
    try:
        assert files.raw_lines(spark, str(tmp_path)).select("path", "block").distinct().count() > 6
        found = files.numbered_lines(spark, str(tmp_path)).collect()
        assert sorted((r.path.rsplit("/", 1)[1], r.line, r.value) for r in found) == want
        total = (tmp_path / "f2.jsonl").read_text().count("\n")
        with (tmp_path / "f2.jsonl").open("a") as out:
            out.write("\n\n{bad\n[1]\n")
        with pytest.raises(ValueError, match=rf"f2\.jsonl:{total + 3}:"):
            files.read_jsonl(spark, str(tmp_path), "a int")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_batches_count_once_they_are_committed(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "j"), "id string, n long")
    rows = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "id string, n long")
    assert journal.read().collect() == [] and journal.numbers() == []
    assert journal.append(rows("a", "b")) == 0
    journal.write(rows("lost"), 1)
    assert sorted(r.id for r in journal.read().collect()) == ["a", "b"]
    assert journal.append(rows("c"), 1) == 1 and journal.append(rows("again"), 1) == 1
    assert sorted(r.id for r in journal.read().collect()) == ["a", "b", "c"]
    assert journal.append(rows("d")) == 2 and journal.damaged() == []
    for part in (tmp_path / "j" / "batch=000000002").glob("*.parquet"):
        part.unlink()
    assert journal.damaged() == [2]


def test_a_stream_forgets_ids_after_their_lifetime_and_still_answers_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "check"))
    shape = "id string, at timestamp"
    for hour, ids in enumerate((["a", "b", "a"], ["b", "c"], ["a", "d", "c"])):
        times = spark.createDataFrame([(i, f"2024-01-01 {4 * hour:02d}:00:00") for i in ids], "id string, t string")
        times.select("id", F.to_timestamp("t").alias("at")).coalesce(1).write.mode("append").parquet(source)

    def backend():
        return lambda row: {"raw_text": row["id"], "latency_ms": 0.0}

    for _ in range(2):
        frame = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        resume.stream(frame, backend, out, checkpoint, at="at", lifetime="1 hour").awaitTermination()
    journal = Journal(spark, out, evaluation.PREDICTION)
    assert sorted(r.task_id for r in journal.read().collect()) == ["a", "b", "c", "d"]
    assert journal.damaged() == [] and len(journal.numbers()) >= 3


# ------------------------------------------------------------------------------------- digests


def test_trees_are_as_deep_as_groups_need(spark):
    def plain(values, width):
        listed = lambda xs: hashlib.sha256(("[" + ",".join(xs) + "]").encode()).hexdigest()
        while True:
            nodes = [listed(values[i : i + width]) for i in range(0, len(values), width)]
            if len(nodes) == 1:
                return nodes[0]
            values = [json.dumps(n) for n in nodes]

    rows = [(g, i, f'"{g}{i}"') for g, n in (("a", 1), ("b", 3), ("c", 4), ("d", 10), ("e", 30), ("f", 82)) for i in range(n)] + [(None, i, str(i)) for i in range(5)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v string")
    want = {g: plain([v for _, _, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])], 3) for g in {r[0] for r in rows}}
    assert {r.g: r.d for r in canonical.tree_digest(df, ["g"], F.col("v"), [F.col("i")], "d", 3).collect()} == want
    assert canonical.tree_digest(df.limit(0), ["g"], F.col("v"), [F.col("i")], "d", 3).collect() == []


JSON = [
    '{"b":1,"a":{"z":[1,2,{"y":null,"x":true}]}}', '{"a":1,"a":2}', '{"a": 1.50}', "[3, 2, -7]", '"x"', "12", "-0", '{"Z":1,"a":2,"_":3,"10":1,"9":2}', "{bad", "", "null", "NaN", '{"é":1}',
    '{"a":"q\\n"}', '{"a":"x/y<>&\'"}', "1234567890123456789", "123456789012345678", "true", ' { "k" : 1 } ', "01", '{"a":+1}', '{"a":1,}', "[]", "{}", None, '{"aB":1,"a b":2,"a":3}', "1e5",
]


def test_canonical_hashes_by_the_jvm_are_those_of_python(spark):
    def plain(t):
        try:
            return None if t is None else canonical.digest(json.loads(t))
        except ValueError:
            return None

    df = spark.createDataFrame(list(enumerate(JSON)), "i int, t string")
    assert {r.i: r.h for r in canonical.canonical_hashes(df, "t", "h").collect()} == {i: plain(t) for i, t in enumerate(JSON)}
    assert df.where(canonical.plain_json(F.col("t"))).count() >= 12


# ----------------------------------------------------------------------- selection and sampling


@pytest.mark.parametrize("held", [100_000, 50, 3])
def test_order_statistics_are_those_of_sorted_lists(spark, monkeypatch, held):
    monkeypatch.setattr(statistics, "SELECT_ROWS", held)
    rng = random.Random(1)
    rows = [(g, None if rng.random() < 0.05 else float(rng.choice([1, 2, 3])) if g == "t" else rng.gauss(0, 1)) for g in "abt" for _ in range(500)] + [("one", 5.0), ("none", None)]
    asked, want = [0.0, 0.1, 0.5, 0.975, 1.0], {}
    for g in ("a", "b", "t", "one"):
        values = sorted(v for h, v in rows if h == g and v is not None)
        want |= {(g, q): values[math.floor(q * (len(values) - 1) + 1e-9)] for q in asked}
    found = statistics.order_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", asked).collect()
    assert {(r.g, r.quantile): r.value for r in found} == want


def test_draws_are_split_down_ranges(spark):
    values = np.random.default_rng(1).random(1000)
    for sample in range(5):
        counts = [statistics.draws_in_range(1000, k, sample, 7, 64) for k in range(16)]
        assert sum(counts) == 1000 and min(counts) > 10
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(5000, None)], "k long, v double")
    found = {r["sample"]: r["mean"] for r in statistics.multinomial_bootstrap(rows, "k", "v", 200, 7, width=64).collect()}
    for sample in (0, 77, 199):
        assert abs(found[sample] - sum(statistics.range_total(values[k * 64 : k * 64 + 64], 1000, k, sample, 7, 64) for k in range(16)) / 1000) < 1e-12
    means, error = np.array(list(found.values())), values.std() / math.sqrt(1000)
    assert len(means) == 200 and abs(means.mean() - values.mean()) < 4 * error / math.sqrt(200) and 0.8 < means.std() / error < 1.2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000, 4097])
def test_permutations_take_every_place_once(spark, n):
    found = [[r.p for r in spark.range(n).select(sampling.permuted(F.col("id"), n, key).alias("p")).collect()] for key in ("k", "other")]
    assert all(sorted(f) == list(range(n)) for f in found)
    assert n < 10 or (found[0] != found[1] and found[0] != list(range(n)))


def test_epochs_are_orders_of_their_own(spark):
    found = [r["item"] for r in sampling.cycled_turns(spark, 50, 150, "s").orderBy("step").collect()]
    epochs = [found[i : i + 50] for i in (0, 50, 100)]
    assert all(sorted(e) == list(range(50)) for e in epochs) and len({tuple(e) for e in epochs}) == 3


# ------------------------------------------------------------------------------------ contracts


def test_contracts_tell_what_is_broken(spark):
    rows = spark.createDataFrame([(1, "a", 10, 1.0), (1, "b", 10, None), (2, "a", 11, -1.0), (2, "a", None, 2.0), (3, None, 99, 3.0), (None, "c", None, 4.0), (None, "c", 98, 5.0)], "k long, name string, parent long, v double")
    parents = spark.createDataFrame([(10,), (11,), (11,), (None,), (7,)], "id long")
    rules = declared.Contract(
        rows={"v is positive": F.col("v") > 0, "name is given": F.col("name").isNotNull()},
        unique={"k stands once": ("k",), "k and name stand once": ("k", "name")},
        functional={"k has one name": (("k",), "name"), "k has one parent": (("k",), "parent")},
        foreign={"parent is there": (("parent",), parents, ("id",))},
    )
    found = {r.rule: r.violations for r in declared.report(rows, rules).collect()}
    # k 2 has a parent and none; two parents of no table are 98 and 99
    assert found == {"v is positive": 2, "name is given": 1, "k stands once": 3, "k and name stand once": 2, "k has one name": 1, "k has one parent": 2, "parent is there": 2}
    with pytest.raises(ValueError, match="k stands once 3"):
        declared.enforced(rows, rules)
    clean = declared.Contract(rows={"v is given": F.lit(True)})
    assert declared.enforced(rows, clean) is rows and declared.report(rows, declared.Contract()).collect() == []


def test_each_key_is_grouped_once(spark):
    rows = spark.createDataFrame([(1, 2)], "a long, b long")
    rules = declared.Contract(unique={"u": ("a",)}, functional={"f": (("a",), "b")}, rows={"r": F.col("b") > 0, "s": F.col("a") > 0})
    plan = declared.report(rows, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [k0") == 1


# -------------------------------------------------------------------------------------- queries


def plain(value):
    return round(value, 6) if isinstance(value, float) else tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


ORACLE_SQL, QUERIES = tables.ORACLE_SQL | turns.ORACLE_SQL, tables.QUERIES | turns.QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    with duckdb.connect() as sql:
        for table in "customer documents conversations events labels lineitem nation orders pages part supplier".split():
            sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        wanted = sql.execute(ORACLE_SQL[name])
        columns = [c[0] for c in wanted.description]
        wanted = rows_of(wanted.fetchall(), columns)
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in found.collect()], found.columns) == wanted


def test_bootstrap_of_all_lines_by_plain_code(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").collect()
    values = np.array([r[-1] for r in sorted(map(tuple, lines))])
    found = {r["sample"]: r["mean"] for r in tables.q_bootstrap_lines(spark, SF).collect()}
    assert len(found) == 100
    for sample in (0, 50, 99):
        assert abs(found[sample] - statistics.range_total(values, len(values), 0, sample, 7) / len(values)) < 1e-9


def test_sequences_of_tables_by_all_pairs(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    shaped = lambda of: dict(map(tuple, turns.select(F.concat_ws("-", "conv_id", "turn"), tables.text.normalize_query(of)).collect()))
    left, right = shaped(F.regexp_replace("text", r"^(?:\S+\s+){1}", "")), shaped(F.col("text"))
    want = {}
    for i, a in left.items():
        for j, b in right.items():
            if 2 * min(len(a), len(b)) >= 0.9 * (len(a) + len(b)) and (score := difflib.SequenceMatcher(None, a, b).ratio()) >= 0.9:
                want[i, j] = round(score, 9)
    assert {(r.left_id, r.right_id): r.score for r in tables.q_turn_sequences(spark, SF).collect()} == want and len(want) > 10


def test_sets_that_share_most_hashes_by_chance_send_no_row_a_hash(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LEAST_SETS", 7)
    monkeypatch.setattr(setjoin, "ROWS", 3)
    monkeypatch.setattr(setjoin, "COLUMNS", 5)
    rng = np.random.default_rng(8)
    every = rng.integers(-(2**62), 2**62, 500)
    sets = [np.sort(rng.choice(every, n, replace=False)) for n in rng.integers(100, 500, 90)]
    sets += [np.sort(rng.permutation(s)[: len(s) * 19 // 20]) for s in sets[::4]]
    rows = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)] + [(900, []), (901, None)], "id long, grams array<long>")
    maps = setjoin.wide_maps(rows.where("size(grams) > 0"))
    near = [(r.left_id, r.right_id) for r in setjoin.candidates(maps, None, 0.8).collect()]
    want = {(i, j) for i in range(len(sets)) for j in range(i) for c in [len(np.intersect1d(sets[i], sets[j]))] if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c)}
    assert len(near) == len(set(near)) and {(j, i) for i, j in near} >= want
    assert {(r.right_id, r.left_id) for r in setjoin.similar(rows, rows, 0.8, self_join=True).collect()} == want
