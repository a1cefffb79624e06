"""Operators that look at the whole corpus: op4, op5, op7, op8, op10, and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairwright.llm import graph, linededup, ngramjoin, packing, store, vectors
from pairwright.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, class string"  # class clashes with a name that operators use
BYTES = "byte_bpe_50k.json"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# ------------------------------------------------------------------------------ graphs


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)] + [(700, 700 + i) for i in range(1, 60)] + [(5, 5)]
    sets = Sets(900)
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: sets.find(x) for x in nodes}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --------------------------------------------------------------------------------- op4


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def slow_components(rows, k, percent):
    named = [(d, shingles(t, k)) for d, t in rows]
    sets, links = Sets(len(named)), Counter()
    for i, (_, a) in enumerate(named):
        for j in range(i):
            b = named[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                sets.join(i, j)
                links.update([i, j])
    least = {}
    for i, (d, _) in enumerate(named):
        r = sets.find(i)
        least[r] = min(x for x in (least.get(r), d) if x is not None) if (least.get(r), d) != (None, None) else None
    return sorted(((d, len(s), least[sets.find(i)], links[i]) for i, (d, s) in enumerate(named)), key=repr)


def texts_with_copies(seed=3, n=260):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    boiler = " ".join(word() for _ in range(25))
    made = []
    for i in range(n):
        if i % 3 and made:
            words = rng.choice(made).split()
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = " ".join(word() for _ in range(rng.randint(30, 120)))
            text = boiler + " " + text if i % 2 else text
        made.append(text)
    return made


@pytest.mark.parametrize(("k", "percent", "posting", "flagged"), [(3, 90, 64, 1 << 21), (3, 90, 2, 0), (5, 80, 2, 1 << 21), (5, 80, 6, 0)])
def test_join_is_the_brute_force_one(spark, monkeypatch, k, percent, posting, flagged):
    monkeypatch.setattr(ngramjoin, "POSTING", posting)
    monkeypatch.setattr(ngramjoin, "TILE", 7)
    monkeypatch.setattr(ngramjoin, "FLAGGED", flagged)
    rows = list(enumerate(texts_with_copies())) + [(900, None), (901, ""), (902, " \n "), (903, "One two"), (904, "one  TWO"), (905, "x"), (906, "far " * 60_000), (907, " ".join(map(str, range(30_000)))), (908, " ".join(map(str, range(30_500)))), (7, "again seven"), (None, "one two"), (None, "no id here at all")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngramjoin.components(docs(spark, rows), k, percent).collect()), key=repr)
    assert got == slow_components(rows, k, percent)


def test_join_edges(spark):
    assert ngramjoin.components(empty(spark)).count() == 0
    one = ngramjoin.one_of_each(docs(spark, [(2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (3, ""), (4, None), (None, "a b c d e f"), (None, "q r s t u")]))
    assert one.columns == ["doc_id", "text", "class"]
    assert sorted((r.doc_id, r.text) for r in one.where("doc_id is not null").collect() if r.text is not None) == [(1, "a b c d e f"), (3, "")]
    assert one.count() == 4 and one.where("doc_id is null").first().text == "q r s t u"


def test_filters_lose_no_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        base = np.unique(rng.integers(0, 2**63, rng.integers(5, 200), dtype=np.uint64))
        a, b = (np.unique(np.concatenate((base[rng.random(len(base)) > 0.03], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)))) for _ in range(2))
        if not len(a) or not len(b):
            continue
        apart = ngramjoin.bits_apart(ngramjoin.parity(a), ngramjoin.parity(b))
        assert apart <= len(np.setxor1d(a, b))
        if ngramjoin.linked(a, b, 80):
            assert ngramjoin.may_link(len(a), len(b), apart, 80)
            for order in range(3):
                level = lambda s: np.zeros(len(s), np.uint64)
                assert len(np.intersect1d(ngramjoin.prefix(a, level(a), order, 80), ngramjoin.prefix(b, level(b), order, 80)))


def test_matrix_products_count_what_rows_share(monkeypatch):
    monkeypatch.setattr(ngramjoin, "CELLS", 700)
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 90, n).astype(np.uint64)) for n in (0, 1, 5, 40, 40, 60, 200)] + [np.array([7], np.uint64)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(rows)] for i, a in enumerate(rows)]
    got = ngramjoin.in_common(rows)
    assert all(want[i][j] in (None, got[i, j]) for i in range(len(rows)) for j in range(len(rows)))
    assert ngramjoin.in_common([]).shape == (0, 0)


def test_shingles_are_told_apart():
    rows = ["a b c a b c", "A B\tC", "a b", "", "é É é É", "x\x1cy z w", "a b c d " * 3000]
    for k in (1, 3, 5):
        assert [len(s) for s in ngramjoin.shingle_sets(rows, k)] == [len(shingles(t, k)) for t in rows]
    assert ngramjoin.shingle_sets(["a b c"], 3)[0].tolist() == ngramjoin.shingle_sets(["zz", "A  b\nC"], 3)[1].tolist()


def test_prefixes_meet_in_rare_words_only(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = [f"often{rng.randrange(9)}" for _ in range(60)]
        for place in range(5, 60, 9):
            words[place] = f"once{i}x{place}"
        rows.append((i, " ".join(words)))
    rows.append((300, rows[0][1] + " end"))
    made = docs(spark, rows)
    level, words = ngramjoin.levels(made, 3)
    tokens = ngramjoin.described(made, 3, 90, level, words).select("doc_id", F.explode("prefix").alias("token"))
    met = tokens.groupBy("token").agg(F.collect_set("doc_id").alias("ids")).where("size(ids) > 1")
    assert {tuple(sorted(r.ids)) for r in met.collect()} == {(0, 300)}
    rated = ngramjoin.rated_sets(["a b", "", rows[0][1]], 3, words)
    assert [s.tolist() for s, _ in rated] == [s.tolist() for s in ngramjoin.shingle_sets(["a b", "", rows[0][1]], 3)]


# --------------------------------------------------------------------------------- op5


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(BYTES))


def test_store_round_trip(spark):
    rng = random.Random(4)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(99)) for _ in range(3000))
    rows = [(i, (passage if i % 3 == 0 else "") + f" tail {i} " * (i % 7)) for i in range(60)] + [(100, None), (101, ""), (102, passage * 4), (-5, "minus"), (None, "no id"), (7, "again")]
    kept = store.TokenStore.write(docs(spark, rows), tokenizer_path(BYTES))
    kept.verify()
    tokenizer = library()
    ids = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows]
    got = kept.read("binary", bytes).orderBy("start").collect()
    assert [r.doc_id for r in got][:2] == [None, -5] and [r.doc_id for r in got][2:] == sorted(d for d, _ in rows if d is not None and d >= 0)
    assert Counter((r.doc_id, bytes(r.out)) for r in got) == Counter((d, np.array(x, "<u4").tobytes()) for d, x in ids)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.out) // 4
        at += r.n_tokens
    chunks = kept._read("chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert chunks.agg(F.sum(F.length("data"))).first()[0] < 0.3 * sum(2 * len(x) for _, x in ids)  # the passage is stored once
    one = kept.read("long", zlib.crc32).where("doc_id = 101").first()
    assert (one.n_tokens, one.out) == (1, zlib.crc32(b"\0\0\0\0"))
    recipes = kept._read("recipes")
    worse = kept.path + "-worse"
    recipes.withColumn("leaf", F.sha2(F.lit("x"), 256).cast("binary")).write.parquet(worse + "/recipes")
    kept._read("manifest").write.parquet(worse + "/manifest")
    with pytest.raises(ValueError):
        store.TokenStore(spark, worse).verify()
    kept.drop()


def test_chunks_that_many_blocks_ask_for_are_sent_by_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    shared = " ".join(str(rng.random()) for _ in range(600))
    rows = [(i, f"{shared} {' '.join(str(rng.random()) for _ in range(200))}") for i in range(40)]
    kept = store.TokenStore.write(docs(spark, rows), tokenizer_path(BYTES))
    whole = lambda: sorted((r.doc_id, r.start, r.n_tokens, r.out) for r in kept.read("long", zlib.crc32).collect())
    plain = whole()
    monkeypatch.setattr(store, "HOT_REQUESTS", 1)
    seen = []
    sent = store.TokenStore._sent
    monkeypatch.setattr(store.TokenStore, "_sent", lambda self, asked: seen.append(sent(self, asked)) or seen[-1])
    assert whole() == plain and len(plain) == 40
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1
    kept.drop()


def test_store_of_nothing(spark):
    kept = store.TokenStore.write(empty(spark), tokenizer_path(BYTES))
    kept.verify()
    assert kept.read("long", zlib.crc32).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 30_000).astype("<u4")
    moved = np.concatenate((rng.integers(0, 50_000, 137).astype("<u4"), ids))

    def chunks(x):
        ends = store.cuts(len(x), store.marks(x))
        return [x[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]

    assert b"".join(chunks(ids)) == ids.tobytes()
    assert len(set(chunks(ids)) & set(chunks(moved))) > 0.6 * len(chunks(ids))
    assert store.cuts(0, store.marks(ids[:0])) == []
    assert store._wide(store._narrow(np.array([1, 70_000], "<u4"))) == np.array([1, 70_000], "<u4").tobytes()


def test_merkle_root_tells_order():
    leaves = [bytes([i]) * 32 for i in range(5)]
    assert store.merkle_root(leaves) != store.merkle_root(leaves[::-1]) and store.merkle_root(leaves[:1]) == leaves[0]


# --------------------------------------------------------------------------------- op7


@pytest.mark.parametrize("n", [0, 1, 12, 300, 20_000])
def test_histograms_are_packed_whole(n):
    rng = random.Random(n)
    counts = Counter(min(1024, max(1, int(rng.lognormvariate(5.8, 1)))) for _ in range(n))
    bins = packing.pack_histogram(dict(counts))
    held = Counter()
    for filling, times in bins:
        assert sum(filling) <= 1024
        for size in filling:
            held[size] += times
    assert held == counts
    used, floor = sum(t for _, t in bins), packing.lower_bound(counts, 1024)
    assert floor <= used <= floor + max(1, floor // 500)


def test_bin_completion_beats_best_fit():
    counts = {6: 1, 5: 1, 4: 2, 3: 1, 2: 1}
    assert sum(t for _, t in packing.pack_histogram(counts, 12)) == 2
    assert packing.completions(6, {4: 1, 3: 2}, [4, 3])[0] == (3, 3)


def fewest(pieces, capacity):
    """Sequences of an optimal packing, by trying every place for each piece in turn."""
    best = len(pieces)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(pieces):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= pieces[at]}.values():
            place(at + 1, [*rooms[:i], rooms[i] - pieces[at], *rooms[i + 1 :]])
        place(at + 1, [*rooms, capacity - pieces[at]])

    place(0, [])
    return best


def test_small_packings_are_optimal():
    rng = random.Random(11)
    for _ in range(120):
        capacity = rng.choice([12, 30, 100])
        pieces = sorted((rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(1, max(2, capacity // 2)) for _ in range(rng.randint(1, 11))), reverse=True)
        counts = dict(Counter(pieces))
        for bins in (packing.pack_histogram(counts, capacity), packing.completed(counts, capacity)):
            assert packing._histogram(bins) == Counter(pieces) and all(sum(f) <= capacity for f, _ in bins)
            assert packing._bins(bins) == fewest(pieces, capacity), (pieces, capacity)


@pytest.mark.parametrize("seed", range(4))
def test_bin_completion_alone_is_at_most_best_fit_decreasing(seed):
    rng = random.Random(seed)
    counts = dict(Counter(min(1024, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(1500)))
    alone = packing.completed(counts, 1024, packing.lower_bound(counts, 1024))
    assert packing._bins(alone) <= packing._bins(packing.best_fit_decreasing(counts, 1024))
    assert packing._histogram(alone) == Counter(counts)


def test_packing_places_every_piece(spark):
    rows = [(i, "word " * (i * 37 % 2600)) for i in range(150)] + [(500, None), (501, ""), (7, "again"), (None, "no id"), (8, "again"), (9, "again")]
    got = packing.pack(docs(spark, rows), tokenizer_path(BYTES)).collect()
    tokenizer = library()
    ids = Counter()
    for d, t in rows:
        x = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(x) % 1024 or 1024, len(x) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            ids[d, p, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ids
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) + 2
    assert packing.pack(empty(spark), tokenizer_path(BYTES)).count() == 0


def test_packing_passes_over_other_columns(spark):
    """Clashing names, null ids, equal lengths and repeated rows."""
    shape = "doc_id long, text string, length long, piece int, rank string, block string, sequence_id string, bound int"
    df = spark.createDataFrame([(d, t, 1, 2, "r", "b", "q", 3) for d, t in [(1, "same words"), (1, "same words"), (2, "same words"), (None, "same words"), (None, None), (3, "")]], shape)
    got = packing.pack(df, tokenizer_path(BYTES)).collect()
    assert len(got) == 6 and {r.sequences for r in got} == {1} == {r.bound for r in got} and len({r.offset for r in got}) == 6


def test_dominated_fillings_are_left_out():
    counts = {60: 1, 50: 1, 40: 1, 30: 2, 10: 1}
    found = packing.completions(100, counts, sorted(counts, reverse=True), enough=50)
    assert all(100 - sum(f) >= 0 for f in found) and (60, 40) in found
    for f in found[1:]:
        left, rest = 100 - sum(f), Counter(counts) - Counter(f)
        assert not any(a < b <= a + left for a in f for b in rest), f


# --------------------------------------------------------------------------------- op8


def slow_vectors(rows, cosine):
    good = [(i, np.array(v, float)) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good}
    sets, links = Sets(len(rows)), Counter()
    for i, _ in good:
        for j, _ in good:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                sets.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = sets.find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, links[i], least[sets.find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def test_vectors_are_linked_as_by_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 24))
    rows = []
    for i in range(300):
        v = centres[i % 8] + rng.standard_normal(24) * 0.16 if i % 3 else rng.standard_normal(24)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(1000 + i, rows[1][1]) for i in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [1.0, None]), (2005, [float("inf")] * 24), (2006, [1.0, 0.0]), (2007, [2.0, -0.0]), (3, rows[4][1]), (None, rows[2][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = vectors.near_duplicates(df, 0.9, block=64, tile=16).collect()
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr)
    want = slow_vectors([(d, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for d, v in rows], 0.9)
    assert found == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) or r.vec_id is None for r in got)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("vectors_", [1, 1023, 50_000, 400_000, 2_000_000, 10**9])
def test_passes_follow_the_number_of_vectors(vectors_):
    bits, passes = vectors.plan(vectors_, 0.9)
    agree = 1 - np.arccos(0.9) / np.pi
    assert 1 - (1 - agree**bits) ** passes >= 0.999
    assert vectors_ / 2**bits <= 2 * vectors.BLOCK
    assert vectors_ > 1023 or (bits, passes) == (0, 1)


@pytest.mark.parametrize("n", [2_000, 8_000])
def test_lone_pairs_are_met_at_any_size(spark, n):
    rng = np.random.default_rng(n)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    lone = unit(rng.standard_normal((n, 64)))
    heads = lone[:500]
    side = rng.standard_normal((500, 64))
    side = unit(side - (side * heads).sum(axis=1, keepdims=True) * heads)
    mates = 0.905 * heads + np.sqrt(1 - 0.905**2) * side
    every = np.concatenate([lone, mates]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<float>")
    linked = {r.vec_id for r in vectors.near_duplicates(df, 0.9, block=64).where("n_links > 0").select("vec_id").collect()}
    assert sum(n + i in linked for i in range(500)) >= 495  # recall 0.99 at least


def test_pairs_in_a_crowd_are_met(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(64))
    cone = unit(centre + 0.6 * unit(rng.standard_normal((800, 64))))  # under 0.9 with one another
    lone = unit(rng.standard_normal((1000, 64)))
    heads = np.concatenate([cone[:100], lone[:100]])
    side = rng.standard_normal((200, 64))
    side = unit(side - (side * heads).sum(axis=1, keepdims=True) * heads)
    mates = 0.92 * heads + np.sqrt(1 - 0.92**2) * side
    every = np.concatenate([cone, lone, mates]).astype(np.float32)
    near = unit(every.astype(float)) @ unit(every.astype(float)).T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, 0.9, block=32).collect()}
    assert got == dict(enumerate(near.sum(axis=1).tolist()))


# -------------------------------------------------------------------------------- op10


def slow_pieces(text):
    """Cut after every line end and after the blanks that follow a mark, a character at a time."""
    out, now = [], ""
    for i, c in enumerate(text):
        now += c
        after = text[i + 1] if i + 1 < len(text) else ""
        blanks = now.rstrip(" \t\r\v\f")
        ended = c in " \t\r\v\f" and blanks[-1:] in (".", "!", "?") and (not after or after not in " \t\r\v\f")
        if c == "\n" or ended or not after:
            out.append(now)
            now = ""
    return out


def slow_dedup(rows, min_words):
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    seen, out = set(), {}
    for i in order:
        text, start, flags, line_start = rows[i][1] or "", 0, [], True
        for piece in slow_pieces(text):
            words = re.findall(r"[^\x20\x09-\x0D]+", piece)
            key = " ".join(words).translate({c: c + 32 for c in range(65, 91)})
            flags.append((start, start + len(piece), len(words), bool(words) and key in seen, bool(words), line_start, piece))
            if words:
                seen.add(key)
            start += len(piece)
            line_start = piece.endswith("\n")
        spans, run, units = [], [], 0
        for f in [*flags, (0, 0, 1, False, True, True, "")]:
            if f[4] and f[3]:
                run.append(f)
            elif f[4]:
                if run and sum(x[2] for x in run) >= min_words:
                    stays = not run[0][5] and run[-1][6].endswith("\n")
                    spans.append((run[0][0], run[-1][1] - stays))
                    units += len(run)
                run = []
        kept = "".join(c for j, c in enumerate(text) if not any(a <= j < b for a, b in spans))
        out[rows[i][0]] = (rows[i][1] and kept, spans, units)
    return out


def test_line_dedup_is_the_brute_force_one(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 3)
    rng = random.Random(7)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    rows = []
    for i in range(150):
        parts = [rng.choice(pool) if rng.random() < 0.5 else f"unique {i} {j} " + " ".join(rng.choice("xyz") for _ in range(12)) for j in range(rng.randint(0, 8))]
        ends = [rng.choice(["\n", ". ", "!  ", "?\n", ".\t", "3.5 ", ". \n", "\n\n"]) for _ in parts]
        rows.append((i, "".join((x.upper() if rng.random() < 0.2 else x) + end for x, end in zip(parts, ends, strict=True))))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, ". ".join([pool[0], "é" + pool[1]] * 30))]
    want = slow_dedup(rows, 25)
    got = linededup.dedup(docs(spark, rows)).collect()
    assert {r.doc_id: (r.text, [(s.start, s.end) for s in r.removed], r.n_removed) for r in got} == want
    assert any(w[1] for w in want.values())


def test_line_dedup_edges(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(2, f"second\n{passage}\nend"), (1, f"first\n{passage}"), (3, "short line"), (4, "short line"), (1, f"first\n{passage}"), (None, f"nobody\n{passage}")]
    long = " ".join(f"long{i}" for i in range(40_000))
    rows += [(6, long), (7, f"In a line. {passage}. {long}")]
    rows += [(8, f"Another. {passage}.\nfinis")] * 20
    got = {(r.doc_id, r.text) for r in linededup.dedup(docs(spark, rows)).collect()}
    assert got == {
        (2, "second\nend"), (1, "first\n"), (3, "short line"), (4, "short line"), (None, f"nobody\n{passage}"), (6, long), (7, f"In a line. {passage}. "), (8, "Another. \nfinis"),
    }
    assert linededup.dedup(empty(spark)).count() == 0
    assert linededup.dedup(docs(spark, rows)).columns == ["doc_id", "text", "class", "removed", "n_removed"]


# ---------------------------------------------------------------------------- pipeline


def test_stages_over_a_small_corpus(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["the", "an", "er", "on", "ti", "re", "at"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    rows = [(i, "BUY!! NOW!! " * 60 if i % 5 == 0 else f"{prose(80)}\n{passage if i % 7 == 0 else prose(20)}\nmail a{i}@b.example.com") for i in range(200)]
    rows += [(200 + i, rows[i + 1][1]) for i in range(3)]
    table = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = table, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        seen[name] = {r.doc_id: r for r in now.collect()}
        assert now.columns == table.columns
    assert set(seen["quality"]) == {d for d, t in rows if not t.startswith("BUY")}
    assert set(seen["near_duplicates"]) == {d for d in seen["quality"] if d < 200}
    assert sum(passage in r.text for r in seen["repeated_passages"].values()) == 1
    assert all("[EMAIL]" in r.text and "@" not in r.text and r.n_chars == len(r.text) for r in seen["personal_data"].values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen["personal_data"])


def made_corpus(rng, n):
    """Prose, junk, copies exact and near, shared passages inside lines, and personal data."""
    word = lambda: "".join(rng.choice(["the", "an", "er", "on", "ti", "re", "at", "is"]) for _ in range(rng.randint(1, 3)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [". ".join(prose(rng.randint(12, 20)) for _ in range(5)) + "." for _ in range(4)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2:
            text = " ".join(rng.choice(["BUY", "NOW", "WIN"]) + rng.choice(["!!", "$$$"]) for _ in range(80))
        elif kind < 0.4 and rows:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 3])):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = f"{prose(rng.randint(40, 90))}. {rng.choice(passages) if rng.random() < 0.3 else prose(20)} {prose(10)}.\nmail a{i}@b.example.com or a at b dot org"
        rows.append((i, text))
    return rows


def test_stages_are_the_brute_force_ones(spark, tmp_path):
    from pairwright.llm import pii, quality

    rng = random.Random(21)
    rows = made_corpus(rng, 220)
    table = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int("BUY" not in t and "NOW" not in t), 0) for d, t in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frames, now = {}, table
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path)).cache()
        frames[name] = now
    texts = lambda name: sorted((r.doc_id, r.text) for r in frames[name].collect())
    scorer = quality._Scorer(quality.fit(table, quality.training_labels(spark, str(tmp_path))))
    want = [(d, t) for d, t in rows if scorer.scores([t])[0] >= 0.5]
    assert texts("quality") == want and 120 < len(want) < 220
    component = {d: c for d, _, c, _ in slow_components(want, 5, 80)}
    want = [(d, t) for d, t in want if component[d] == d]
    assert texts("near_duplicates") == want and len(want) < len(component)
    removed = slow_dedup(want, 25)
    assert any(spans for _, spans, _ in removed.values())
    want = [(d, removed[d][0]) for d, _ in want]
    assert texts("repeated_passages") == want
    want = [(d, pii.redacted(t)) for d, t in want]
    assert texts("personal_data") == want and sum("[EMAIL]" in t for _, t in want) > 0.9 * len(want)
    tokenizer, at = library(), {}
    lengths = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want}
    for r in frames["packing"].collect():
        assert r.start + r.length <= lengths[r.doc_id]
        at.setdefault(r.sequence_id, []).append((r.offset, r.length, r.doc_id))
    packed = Counter()
    for pieces in at.values():
        place = 0
        for offset, length, d in sorted(pieces):
            assert offset == place
            place += length
            packed[d] += length
        assert place <= 1024
    assert packed == lengths


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, ties, names that operators use, and an empty table."""
    rng = random.Random(23)
    good = [(i, t) for i, t in made_corpus(rng, 60)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, class string, digest binary, _row int, score double, h long, tag long"
    extra = ("c", b"d", 1, 0.5, 2, 3)
    rows = [(d, t, "en", "s", len(t), *extra) for d, t in good] + [(d, t, "en", "s", len(t), *extra) for d, t in good[:5]]
    rows += [(None, good[1][1], None, None, None, *[None] * 6), (None, None, None, None, None, *[None] * 6), (900, None, "en", "s", 0, *extra), (901, "", "en", "s", 0, *extra), (901, "", "en", "s", 0, *extra), (902, "word " * 60_000, "en", "s", 300_000, *extra)]
    labels = spark.createDataFrame([(d, int("BUY" not in t and "NOW" not in t), 0) for d, t in good] + [(None, 1, None), (5, None, None), (12_345, 0, 1)], "doc_id long, quality int, toxic int")
    for name, data in (("full", rows), ("empty", [])):
        root = tmp_path / name
        spark.createDataFrame(data, shape).write.parquet(str(root / "documents.parquet"))
        (labels if data else labels.limit(0)).write.parquet(str(root / "labels.parquet"))
        found = corpus_pipeline.run(spark, str(root)).collect()
        assert bool(found) == bool(data)
        places = [(r.sequence_id, r.offset) for r in found]
        assert len(set(places)) == len(places)
    now = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path / "full"))
        assert now.columns == [f.split()[0] for f in shape.split(", ")]
    kept = now.collect()
    assert sum(r.doc_id == 901 for r in kept) <= 1 and {r.doc_id for r in kept} >= {d for d, t in good[:1] if "BUY" not in t}
