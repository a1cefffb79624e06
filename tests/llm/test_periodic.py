"""op11: runs of repeated words against a scan of all periods."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from pairwright.llm import periodic
from pairwright.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string"  # runs clashes with a column of the operator


def plain_runs(words):
    """Every stretch of words that are equal to those q further on, for each q; of one stretch the smallest q counts."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(6, 4 * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_texts_named_together_are_those_of_a_scan():
    rng = random.Random(5)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 50))]
            if words and rng.random() < 0.5:
                a, p = rng.randrange(len(words)), rng.randint(1, 9)
                words = words[:a] + [words[min(a + (i - a) % p, len(words) - 1)] for i in range(a, len(words))]
            texts.append(words)
        found = periodic.runs_of(texts)
        assert [[tuple(r) for r in rows.tolist()] for rows in found] == [plain_runs(words) for words in texts]
        assert [periodic.collapsed(w, r) for w, r in zip(texts, found, strict=True)] == [plain_collapsed(w, plain_runs(w)) for w in texts]


def test_least_lengths_and_smallest_periods():
    runs = lambda text: [tuple(r) for r in periodic.runs_of([text.split()])[0].tolist()]
    assert runs("a a a a a") == [] and runs("a a a a a a") == [(0, 6, 1)]
    assert runs("a b a b a b a") == [] and runs("a b a b a b a b x") == [(0, 8, 2)]
    assert runs("x " + "a b c " * 4 + "a b y") == [(1, 14, 3)]
    assert runs("a " * 40) == [(0, 40, 1)]  # and not 2, 3, ... too
    assert runs("a a a a a a b a a a a a a b " * 4) == plain_runs(("a a a a a a b a a a a a a b " * 4).split())


def test_a_very_long_text():
    words = [f"w{i % 3000}" for i in range(120_000)]
    assert [tuple(r) for r in periodic.runs_of([["x"] * 3, words])[1].tolist()] == [(0, 120_000, 3000)]


def test_defined_cases(spark):
    rows = [(5, "go go go go go go now", "x"), (3, None, "x"), (4, "", None), (2, "la  di\tla di la di\nla di", "x"), (2, "la  di\tla di la di\nla di", "y"), (None, "no no " * 9, "z")]
    found = {(r.doc_id, r.collapsed): (r.n_words, [tuple(x) for x in r.runs]) for r in periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(5, "go now"): (7, [(0, 6, 1)]), (3, ""): (0, []), (4, ""): (0, []), (2, "la di"): (8, [(0, 8, 2)]), (None, "no no"): (9, [(0, 9, 1)])}
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_plain_code(spark):
    found = {r.doc_id: r for r in periodic.op11_periodic_runs(spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(found) == len(docs)
    several = 0
    for doc_id, text in docs:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        kept = hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
        assert tuple(found[doc_id]) == (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest, kept)
        several += bool(runs)
    assert several > 10
