"""Places, hashes and overlaps that must hold at any size, against plain Python."""

import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from pairwright import staging
from pairwright.functions import canonical, text
from pairwright.operators import overlap, sampling
from pairwright.sources import files


def test_positions_with_a_payload_are_distinct(spark):
    rows = spark.range(0, 1_000_000, 1, 8).select(F.xxhash64("id").alias("k"), F.concat(F.lit("payload "), F.col("id")).alias("v"))
    placed = sampling.positions(rows, "k")
    found = placed.agg(F.count_distinct("position").alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi")).first()
    assert (found.n, found.lo, found.hi) == (1_000_000, 0, 999_999)
    ordered = placed.where("position < 50 or position between 700000 and 700050").orderBy("position").collect()
    assert [r.k for r in ordered] == sorted(r.k for r in ordered)
    assert sampling.positions(rows.limit(0), "k").count() == 0


def test_folding_is_casefold(spark):
    known = (c for c in map(chr, range(32, 0x2100)) if unicodedata.category(c) != "Cn")  # the JVM may know newer letters
    letters = [*known] + ["ΑΣ", "ας", "İ", "ﬄ", "ẞ", "Ꭰꭰ", "ſt"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(letters)], "i int, t string")
    got = {r.i: r.f for r in rows.select("i", text.fold(F.col("t")).alias("f")).collect()}
    assert [c for i, c in enumerate(letters) if got[i] != c.casefold()] == []


def test_content_hash_ignores_order(spark):
    lines = [f"line {i}" for i in range(300)] + ["twice", "twice"]
    make = lambda xs: spark.createDataFrame([(x,) for x in xs], "v string")
    once = canonical.content_hash(make(lines), "v")
    random.Random(1).shuffle(lines)
    assert canonical.content_hash(make(lines).repartition(5), "v") == once
    assert canonical.content_hash(make(lines[1:]), "v") != once


def test_sequences_are_found_as_by_brute_force(spark):
    rng = random.Random(3)
    words = [" ".join(rng.choice(["red", "green", "blue", "seven", "nine", "car"]) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    edited = [" ".join(w.split()[rng.randint(0, 1) :]) for w in words] + [""]
    shape = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, q string").withColumn("len", F.length("q"))
    got = {(r.left_id, r.right_id): r.score for r in overlap.sequence_pairs(shape(words), shape(edited)).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert got == {(i, j): ratio(a, b) for i, a in enumerate(words) for j, b in enumerate(edited) if ratio(a, b) >= 0.9}
    assert len(got) > 20


def test_items_are_found_either_way(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 160))) for _ in range(60)]
    items = [t[a : a + n] for t in texts[:30] for a, n in [(rng.randint(0, 40), rng.choice([3, 9, 39, 40, 60]))] if len(t[a : a + n]) > 2] + ["absent" * 9, "zz", ""]
    docs, wanted = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if x and x in t}
    find = lambda: [(r.doc_id, r.item_id) for r in overlap.contained(docs, wanted).collect()]
    assert sorted(find()) == sorted(want)
    monkeypatch.setattr(overlap, "AUTOMATON_CHARS", 10)
    assert sorted(find()) == sorted(want)


def test_groups_list_copies_once(spark):
    rows = [(i, t) for i, t in enumerate(["the quick brown fox jumps over the lazy dog again and again"] * 40 + ["the quick brown fox jumps over the lazy dog again and again ok"] * 3 + ["other words"])]
    found = overlap.jaccard_groups(overlap.prepared(spark.createDataFrame(rows, "i int, t string"), "i", "t")).collect()
    assert len(found) == 39 + 2 + 1
    assert {(r.left_id, r.right_id) for r in found if r.score < 1} == {(0, 40)}


def test_files_are_hashed_by_tasks_and_else_as_rows_or_streams(spark, tmp_path, monkeypatch):
    import hashlib

    for name, size in (("empty", 0), ("small", 10), ("large", 5000), ("größer", 3 << 20)):
        (tmp_path / name).write_bytes(b"x" * size)
    want = {n: hashlib.sha256(b"x" * s).hexdigest() for n, s in (("empty", 0), ("small", 10), ("large", 5000), ("größer", 3 << 20))}
    hashes = lambda: {r.path: r.sha256 for r in files.inventory(spark, str(tmp_path)).collect()}
    assert hashes() == want
    monkeypatch.setattr(files, "_opens", lambda path: False)
    assert hashes() == want
    monkeypatch.setattr(files, "WHOLE_BYTES", 100)
    assert hashes() == want


def test_files_are_dealt_by_size():
    rng = random.Random(3)
    listed = [(f"f{i}", rng.choice([10, 1000, 10**6, 10**8])) for i in range(200)]
    sizes, loads = dict(listed), [0] * 8
    found = files.dealt(listed, 8)
    assert sorted(p for _, p in found) == sorted(sizes)
    for part, path in found:
        loads[part] += sizes[path] + files.CHUNK_BYTES
    assert max(loads) - min(loads) <= 10**8 + files.CHUNK_BYTES


def test_hashes_of_given_tables(spark):
    import glob
    import hashlib

    from pairwright.plans import tables

    found = {r.path: r.sha256 for r in tables.q_table_files(spark, "/root/testdata/sf0.001").collect()}
    assert found == {p.rsplit("/", 1)[1]: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob("/root/testdata/sf0.001/*.parquet")}


def test_a_cluster_must_name_its_shared_folder(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "a"})  # noqa: N815

    with pytest.raises(RuntimeError):
        staging.shared_dir(Cluster, "x")
    assert staging.shared_dir(spark, "x") != staging.shared_dir(spark, "x")
