"""Operators that look at one text at a time: op1, op2, op3, op6, op9."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm import licenses, pii, quality, trie_bpe, winnowing
from pairwright.llm.tokens import tokenizer_path, word_encoder

LONG = "the heon to, of nd he reou " * 6000
ROWS = [(5, "hello wide world, once more", "x"), (3, None, "x"), (4, "", None), (2, LONG, "x"), (1, "hello wide world, once more", "y"), (1, "hello wide world, once more", "y"), (None, "naïve café", "z")]
SCHEMA = "doc_id long, text string, start string"  # start clashes with names that operators use


def docs(spark, rows=ROWS, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------------------- op1

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    def digits(s):
        return "".join(c for c in s if c in "0123456789")

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in pii.CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))],
        "phone": [m.span() for m in pii.PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15],
    }


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for letters in ("a1.@-+ 0(%2)9@..5", "45391488034364670 -", "+1 (23)-4.", "ab@c.d-"):
        for _ in range(5000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
            assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail jo.doe [at] example [dot] com now", "email", "jo.doe [at] example [dot] com"),
        ("jo at example dot com", "email", "jo at example dot com"),
        ("jo arroba example punto com", "email", "jo arroba example punto com"),
        ("jo arobase example point fr", "email", "jo arobase example point fr"),
        ("jo&#x0040;example&#x002e;com", "email", "jo&#x0040;example&#x002e;com"),
        ("jo@exɑmpleıɡ.com", "email", "jo@exɑmpleıɡ.com"),
        ("192 punkt 168 punkt 0 punkt 1", "ip", "192 punkt 168 punkt 0 punkt 1"),
        ("call +1 555 123 four five 67 now", "phone", "+1 555 123 four five 67"),
        ("ｊｏ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("john​@example.com", "email", "john​@example.com"),
        ("john dot doe at example dot com", "email", "john dot doe at example dot com"),
        ("to john @ example.com now", "email", "john @ example.com"),
        ("john&#64;example.com", "email", "john&#64;example.com"),
        ("pay 4539.1488.0343.6467 now", "card", "4539.1488.0343.6467"),
        ("pay 4539 - 1488 - 0343 - 6467 now", "card", "4539 - 1488 - 0343 - 6467"),
        ("ten 10 (dot) 0 (dot) 0 (dot) 1 x", "ip", "10 (dot) 0 (dot) 0 (dot) 1"),
        ("at 192[.]168[.]1[.]1 it", "ip", "192[.]168[.]1[.]1"),
        ("plus one four one five five five five two six seven one", "phone", "plus one four one five five five five two six seven one"),
        ("4 five three nine one four eight eight zero three four three six four six seven", "card", "4 five three nine one four eight eight zero three four three six four six seven"),
        ("٤٥٣٩١٤٨٨٠٣٤٣٦٤٦٧", "card", "٤٥٣٩١٤٨٨٠٣٤٣٦٤٦٧"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, added = pii.all_spans(text)
    assert [text[a:b] for a, b in base[kind] + added[kind]] == [found]
    assert pii.redacted(text).count(f"[{kind.upper()}]") == 1


@pytest.mark.parametrize("text", ["He sat at home. A dot matrix.", "call me at five or six", "one two three", "a (at) b", "plus 5", "dot dot dot", "see 1234.5678.1234.5678 here", "reach me @ noon. Then go", "50%40", "meet at this point in time", "um acht Punkt eins"])
def test_clean_texts_have_no_spans(text):
    assert pii.all_spans(text) == ({k: [] for k in pii.KINDS}, {k: [] for k in pii.KINDS})
    assert pii.redacted(text) == text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail jo.doe at example.com now", "email", "jo.doe at example.com"),
        ("jo@example&#46;com", "email", "jo@example&#46;com"),
        ("jo@example&#x2e;com", "email", "jo@example&#x2e;com"),
        ("jo@example&period;com", "email", "jo@example&period;com"),
        ("jo@example . com", "email", "jo@example . com"),
        ("pay 45391488.03436467 now", "card", "45391488.03436467"),
        ("mail joe at example punkt de bitte", "email", "joe at example punkt de"),
        ("a@ejemplo punto com punto mx", "email", "a@ejemplo punto com punto mx"),
    ],
)
def test_disguises_without_another_one_are_tried(text, kind, found):
    base, added = pii.all_spans(text)
    assert [text[a:b] for a, b in base[kind] + added[kind]] == [found]


def test_every_text_that_is_rewritten_is_tried():
    rng = random.Random(5)
    parts = [" ", " ", "\n", "\t", ".", " . ", "@", "at", " at ", "DOT", " dot ", "punkt", " PUNKT ", " punto ", "@", " at", "point", "[", "]", "(", ")", "{", ">", "&#46;", "&#064;", "&#X2E;", "&period;", "&commat;", "%40"]
    parts += ["plus", "one", "SIX", "ſix", "fİve", "zéro", "fünf", "1234", "12", "7", "-", ",", "/", "·", "com", "a", "é", "ı", "\u200b", "\u212a", "\u0660"]
    rewritten = 0
    for _ in range(60_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        if pii.normalise(text).text != text:
            rewritten += 1
            assert pii.disguised(text), text
    assert rewritten > 5_000


def test_pii_edges(spark):
    rows = pii.digests(docs(spark, [*ROWS, (9, "a@b.co at 1.2.3.4 or +1 (017) 555-7713, card 4539 1488 0343 6467", None)])).collect()
    assert len(rows) == len(ROWS) + 1
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == nothing and r.spans == "" for r in rows if r.doc_id != 9)
    nine = next(r for r in rows if r.doc_id == 9)
    assert (nine.n_email, nine.n_ip, nine.n_card, nine.n_phone) == (1, 1, 1, 1)
    assert nine.base_sha256 == hashlib.sha256(nine.spans.encode()).hexdigest()
    assert pii.digests(empty(spark)).count() == 0
    kept = pii.redact(docs(spark)).collect()
    assert sorted(map(repr, kept)) == sorted(map(repr, docs(spark).collect()))
    assert pii.find(docs(spark, [(1, "a@b.co", None)])).first().spans[0].asDict() == {"kind": "email", "start": 0, "end": 6, "added": False}


# ------------------------------------------------------------------------------- op3


def slow_winnow(text, k, w):
    h = [int(x) for x in winnowing.gram_hashes(text, k)]
    w, chosen = min(w, len(h)), []
    for i in range(len(h) - w + 1 if h else 0):
        window = h[i : i + w]
        at = i + max(j for j, x in enumerate(window) if x == min(window))
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return [h[i] for i in chosen], chosen


def test_winnowing_matches_its_definition():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abcé𝒜") for _ in range(rng.randint(0, 120)))
        k, w = rng.randint(1, 9), rng.randint(1, 9)
        got, places = winnowing.winnow(text, k, w)
        assert (got.tolist(), places.tolist()) == slow_winnow(text, k, w)
        if len(text) >= k:
            assert len(winnowing.gram_hashes(text, k)) == len(text) - k + 1


def test_gram_hashes_tell_grams_apart():
    text = "".join(random.Random(2).choice("abc") for _ in range(400))
    for k in (1, 3, 7, 16):
        h = winnowing.gram_hashes(text, k)
        by = {}
        for i, x in enumerate(h):
            assert by.setdefault(text[i : i + k], x) == x
        assert len(set(by.values())) == len(by)


def test_shared_substrings_share_a_hash():
    rng = random.Random(4)
    for _ in range(50):
        shared = "".join(rng.choice("abcdefgh") for _ in range(winnowing.K + winnowing.WINDOW - 1))
        a, b = ("".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 200))) + shared + "x" * rng.randint(0, 100) for _ in range(2))
        assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())


def test_short_texts_are_like_their_own_edit():
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    for _ in range(200):
        text, other = words(30)[: rng.randint(40, 119)], words(30)
        edited = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
        kept = len(text) - len(text) // 3
        own, changed = (winnowing.winnow(x)[0] for x in (text, edited))
        assert kept < 23 or winnowing.likeness(own, changed) > 0
        quote = text[:23]
        assert set(winnowing.winnow(words(200) + quote + words(200))[0].tolist()) & set(own.tolist())


def slow_op3(rows):
    order = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        (own, at), (other, places), (after, _) = (winnowing.winnow(x) for x in (t, edited, nxt))
        assert all(winnowing.gram_hashes(t)[i] == h for h, i in zip(own, at, strict=True))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), winnowing.as_hex(own), winnowing.as_hex(other), winnowing.likeness(own, other), winnowing.likeness(own, after), at.tolist(), places.tolist()))
    return sorted(out, key=repr)


def test_op3_is_the_brute_force_one(spark):
    rng = random.Random(6)
    many = [(rng.randint(-50, 900), "".join(rng.choice("ab cd") for _ in range(rng.randint(0, 300))), "s") for _ in range(400)]
    for rows in (ROWS, many, ROWS[:1], [(None, "only", "x")]):
        got = sorted((tuple(r) for r in winnowing.compare_with_edits(docs(spark, rows)).collect()), key=repr)
        assert got == slow_op3(rows)
    assert winnowing.compare_with_edits(empty(spark)).count() == 0
    assert winnowing.fingerprints(docs(spark)).where("doc_id = 4").first().hashes == []


# ------------------------------------------------------------------------------- op6


def test_trie_encoder_is_the_library():
    encoder = trie_bpe.text_encoder(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(5)
    plain, wide = "aAbBéÉßſİıŉÅñ's 't12½³ \n\t.,!?<|>", "Σσςабвﬁ①  ́日本ǅ’ aé1"
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in (plain, wide) for _ in range(400)]
    texts += ["x<|endoftext|>Y <|startoftext|> it's", "", "<|", LONG, "unbelievable misunderstandings"]
    texts += ["".join(chr(rng.randint(1, 0x2FFF)) for _ in range(30)) for _ in range(200)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        want = encoder.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert encoder.decode(np.frombuffer(ids, "<u4")) == encoder.library.decode(want, skip_special_tokens=False)


def test_ids_decode_as_in_the_library():
    encoder = trie_bpe.text_encoder(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(8)
    for n in (0, 1, 2, 50, 3000):
        ids = [rng.randrange(49_408) for _ in range(n)]
        assert encoder.decode(np.array(ids, np.int64)) == encoder.library.decode(ids, skip_special_tokens=False)
    assert encoder.decode(np.array([5, 60_000, 49_407])) == encoder.library.decode([5, 60_000, 49_407], skip_special_tokens=False)


def test_small_memories_change_nothing(monkeypatch):
    for name, value in (("KEEP_BYTES", 700), ("KEEP_PAIRS", 2), ("NODES", 9), ("DEPTH", 3), ("LONG_WORD", 4)):
        monkeypatch.setattr(trie_bpe, name, value)
    encoder = trie_bpe.TextEncoder(tokenizer_path("word_bpe_49k.json"))
    for text in ("one two three four five six", "seven eight nine ten", "one two"):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_slices_share_one_trie():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    whole, sliced = trie_bpe.TextEncoder(tokenizer_path("word_bpe_49k.json")), trie_bpe.TextEncoder(tokenizer_path("word_bpe_49k.json"))
    ids = whole.encode([" ".join(words)])
    parts = [sliced.encode([" ".join(words[i : i + 100])])[0] for i in range(0, len(words), 100)]
    assert b"".join(parts) == ids[0]
    prefixes = {w[:n] for w in words for n in range(1, len(w))}
    assert whole.trie.walked == sliced.trie.walked == len(prefixes)  # each prefix once, in however many slices
    assert np.frombuffer(ids[0], "<u4").tolist() == whole.library.encode(" ".join(words), add_special_tokens=False).ids


def test_op6_edges(spark):
    path = tokenizer_path("word_bpe_49k.json")
    rows = trie_bpe.digest_documents(docs(spark), path).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(rows) == len(ROWS) and [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (3, 4)] == [(0, nothing, nothing)] * 2
    assert trie_bpe.digest_documents(empty(spark), path).count() == 0
    one = trie_bpe.decode_documents(trie_bpe.encode_documents(docs(spark, ROWS[:1]), path), path).first()
    assert one.decoded.startswith("hello</w>")
    odd = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [320, None, 99_999_999], "z")], "doc_id long, ids array<int>, class string")
    assert [r.decoded is None for r in trie_bpe.decode_documents(odd, path).orderBy("doc_id").collect()] == [True, False, False]


def test_word_encoder_is_the_library(monkeypatch):
    from pairwright.llm import tokens

    monkeypatch.setattr(tokens, "KEEP_WORDS", 50)
    encoder = tokens.WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(9)
    texts = ["".join(rng.choice("aAbBéÉßſİıÅñ's 't12½³ \n\t\r.,!?<|>¡¬ª×÷\x00\x85\xa0日​") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|> a", LONG, "", "  two  spaces  ", "a\n\n b", "don't you'll O'Neil", "tab\tand\rreturn"]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    assert word_encoder(tokenizer_path("byte_bpe_50k.json")).encode(texts) == want


def test_words_as_numbers_are_the_library(monkeypatch):
    from pairwright.llm import tokens

    monkeypatch.setattr(tokens, "KEEP_NUMBERS", 3_000)
    encoder = tokens.WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(19)
    every = "".join(chr(c) for c in [*range(33, 39), *range(40, 127), *range(0xA1, 0xAD), *range(0xAE, 0x180)])
    word = lambda: "".join(rng.choice(every if rng.random() < 0.3 else "abcdeéüß") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 23, 24, 25, 40])))
    pool = [word() for _ in range(1500)]
    texts = []
    for _ in range(900):
        words = [rng.choice(pool) if rng.random() < 0.8 else word() for _ in range(rng.randint(0, 40))]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", ", ", ".\n"]) for w in words).strip() + rng.choice(["", "", "", " ", "  x", "'s"]))
    texts += ["a", "é", "<|", "x <|endoftext|>", "one " * 40_000 + "two", ""]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [ids for i in range(0, len(texts), 37) for ids in encoder.encode(texts[i : i + 37])]
    assert got == want
    assert sum(tokens.is_plain(t) and tokens.is_tight(t) for t in texts if t) > 400
    monkeypatch.setattr(tokens, "_MIX", [np.uint64(0)] * 3)  # every word has one hash: told by the bytes, split by the pattern
    assert tokens.WordEncoder(tokenizer_path("byte_bpe_50k.json")).encode(texts) == want


# ------------------------------------------------------------------------------- op9


def labelled(spark, n=900):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice("the of to and in is that for it was with as his on be at by".split()) + rng.choice("aeiou") for _ in range(rng.randint(30, 90)))
    bad = lambda: " ".join(rng.choice("BUY NOW WIN CASH FREE CLICK DEAL".split()) + rng.choice(["!!", "$$$", "###"]) for _ in range(rng.randint(30, 90)))
    rows = [(i, good() if i % 4 else bad(), int(i % 4 != 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_learns_and_holds_out(spark):
    from zlib import crc32

    every = labelled(spark).cache()
    learnt = every.select("doc_id", "quality").where(~quality.held_out())
    assert {r.doc_id for r in learnt.collect()} == {i for i in range(900) if crc32(str(i).encode()) % 3 != 1}
    model = quality.fit(every, learnt)
    rows = quality.score(every, model).join(every, "doc_id").where(quality.held_out()).collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    kept = quality.reject(every, model)
    assert kept.schema == every.schema and kept.where("quality = 1").count() / every.where("quality = 1").count() > 0.95
    again = quality.fit(every.repartition(5), learnt)
    assert again == model
    edges = quality.score(docs(spark), model).collect()
    assert len(edges) == len(ROWS) and len({r.score for r in edges if r.doc_id in (3, 4)}) == 1
    assert quality.score(empty(spark), model).count() == 0


def slow_score(model, text):
    """The score from its description, a piece at a time."""
    import math

    import zstandard as zstd

    def size(data, dictionary):
        return len(zstd.ZstdCompressor(level=model.level, dict_data=zstd.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))

    data = (text or "").encode()
    n = max(1, round(len(data) / 1024))
    width = max(1, math.ceil(len(data) / n))
    pieces = [data[i : i + width] for i in range(0, len(data), width)] or [b""]
    gaps = [10 * (size(p, model.bad) - size(p, model.good)) / (len(p) + 16) for p in pieces]
    mean, short = sum(gaps) / len(gaps), 64 / (len(data) + 64)
    z = sum(w * x for w, x in zip(model.weights, (1, mean, min(gaps), short, mean * short), strict=True))
    return 1 / (1 + math.exp(-z))


def test_scores_are_the_brute_force_ones(spark):
    every = labelled(spark).cache()
    model = quality.fit(every, every.select("doc_id", "quality"))
    rows = [(r.doc_id, r.text, "s") for r in every.limit(60).collect()] + [(901, None, "s"), (902, "", "s"), (903, "the of " * 9_000 + "BUY!! " * 3_000, "s"), (904, "é" * 1_500, "s"), (5, "again", "t"), (None, "no id", "t")]
    got = sorted(round(r.score, 9) for r in quality.score(docs(spark, rows), model).collect())
    assert got == sorted(round(slow_score(model, t), 9) for _, t, _ in rows)
    exact = quality.CompressionModel(model.good, model.bad, (0.0,) * 5)  # every score is 0.5: ties stay
    assert quality.reject(docs(spark, rows), exact).count() == len(rows)


def test_repeated_labelled_rows_are_fetched_once(spark):
    every = labelled(spark, 300)
    labels = every.select("doc_id", "quality")
    twice = every.unionByName(every).unionByName(every)
    assert quality.fit(twice, labels.unionByName(labels)) == quality.fit(every, labels)


def test_quality_without_labels(spark):
    model = quality.fit(docs(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs(spark), model).collect()} == {0.5}


def test_tapes_tell_the_source_of_every_character():
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))
        tape, spans = pii.Tape(text), [(i, i + 1) for i in range(len(text))]
        for _ in range(rng.randint(1, 4)):
            edits, at, held = [], 0, tape.text
            while at < len(held):
                lo = rng.randint(at, len(held))
                hi = rng.randint(lo, min(len(held), lo + 4))
                if hi > lo:
                    edits.append((lo, hi, "".join(rng.choice("xyz") for _ in range(rng.choice([0, 1, 2, hi - lo])))))
                at = hi + 1
            new, want, at = [], "", 0
            for lo, hi, put in edits:
                new += spans[at:lo] + (spans[lo:hi] if len(put) == hi - lo else [(spans[lo][0], spans[hi - 1][1])] * len(put))
                want += held[at:lo] + put
                at = hi
            tape, spans = tape.rewrite(edits), new + spans[at:]
            assert tape.text == want + held[at:]
            assert [tape.source(i, i + 1) for i in range(len(tape.text))] == spans


def test_many_spans_and_long_texts_take_little():
    base, added = pii.all_spans("jo [at] example [dot] com " + " ".join(f"a{i}@b{i}.com" for i in range(50_000)))
    assert (len(base["email"]), added["email"]) == (50_000, [(0, 25)])
    text = "lorem ipsum dolor " * 200_000 + "jo [at] example [dot] com"
    tape = pii.normalise(text)
    assert len(tape.parts) < 10 and pii.all_spans(text)[1]["email"] == [(len(text) - 25, len(text))]


# ------------------------------------------------------------------------------- op2


@pytest.fixture(scope="module")
def license_model(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["the", "an", "er", "on", "ti", "re", "at"]) for _ in range(rng.randint(1, 3)))
    rows = [(i, "\n".join(" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(8)), "s") for i in range(60)]
    return licenses.fit(docs(spark, rows))


def test_licence_families(license_model):
    scanner = licenses.Scanner(license_model)
    wanted = {
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "BSD",
        "Licensed under the terms of the Acme corporate license agreement": "unknown",
    }
    for text, family in wanted.items():
        found = scanner.paragraphs("on the re at.\n" + text + "\n\nthe an")
        assert [(p[0], p[3], p[4]) for p in found] == [(family, 14, 14 + len(text))], text
    for text in ("", "the an er on", "permission to eat the cake on the table was given to them all", "a license plate on the car at the end"):
        assert not [p for p in scanner.paragraphs(text) if p[0] != "unknown"]
    wrapped = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the Software), to deal in the Software without restriction."
    found = scanner.paragraphs("the an.\n\n" + wrapped + "\nre at on\n")
    assert [(p[0], p[3], p[4]) for p in found] == [("MIT", 9, 9 + len(wrapped))]


def slow_scan(model, text):
    """The scan from its description: lines are joined up to a mark or a blank line, scores are summed n-gram by n-gram."""
    import math

    def judged(part):
        words = licenses.WORDS.findall(part.lower())
        seen = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        known = [model.index[g] for g in seen if g in model.index]
        if not any(" " not in g and g in model.index and model.weights[model.index[g], 0] < 0 for g in seen):
            return None
        z = [(model.bias[c] + sum(model.weights[i, c] for i in known)) / model.temperature for c in range(len(model.classes))]
        e = [math.exp(x - max(z)) for x in z]
        p = [x / sum(e) for x in e]
        if p[0] >= 0.5:
            return None
        best = max(range(2, len(p)), key=p.__getitem__)
        own = set(zip(words, words[1:], strict=False))
        alike = []
        for sentence in licenses.TEMPLATES[model.classes[best]]:
            t = licenses.WORDS.findall(sentence.lower())
            pairs = set(zip(t, t[1:], strict=False))
            alike.append(len(own & pairs) / min(len(pairs), max(len(own), 4)))
        good = max(alike) >= licenses.CONFIRM and p[best] >= model.least
        return (model.classes[best], p[best]) if good else ("unknown", p[1])

    groups, now, at = [], [], 0
    for line in text.split("\n"):
        if line.strip():
            now.append((at, at + len(line)))
        if now and (not line.strip() or line.strip()[-1] in ".!?:;"):
            groups.append(now)
            now = []
        at += len(line) + 1
    found = []
    for lines in [*groups, *([now] if now else [])]:
        a, b = lines[0][0], lines[-1][1]
        whole = judged(text[a:b])
        single = [(judged(text[x:y]), x, y) for x, y in lines] if len(lines) > 1 and (whole is None or whole[0] == "unknown") else []
        single = [s for s in single if s[0]]
        found += single or ([(whole, a, b)] if whole else [])
    return [(f, round(p, 9), a, b) for (f, p), a, b in found]


def test_licence_scan_is_the_brute_force_one(spark, license_model):
    rng = random.Random(3)
    lines = [s for f in licenses.TEMPLATES.values() for s in f] + list(licenses.OTHERS) + ["the an er on", "a plain line", "software use and copies", ""] * 6
    rows = []
    for i in range(150):
        words = " ".join(rng.choice(lines) + rng.choice([".", "", "\n", ".\n\n"]) for _ in range(rng.randint(0, 9))).split(" ")
        rows.append((i, " ".join(w + rng.choice(["", "", "", "\n"]) for w in words), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (7, "MIT license", "t"), (902, "\n".join(["the an er on re at"] * 3000 + ["Licensed under CC BY 4.0"]), "s")]
    got = licenses.scan(docs(spark, rows), license_model).collect()
    found = sorted((r.doc_id, [(p.family, round(p.probability, 9), p.start, p.end) for p in r.paragraphs]) for r in got)
    assert found == sorted((d, slow_scan(license_model, t or "")) for d, t, _ in rows)
    assert sum(len(x) for _, x in found) > 100


def test_licence_sample_takes_a_document_once(spark):
    rows = [(i % 50, f"text {i % 7}", "s") for i in range(400)] + [(None, "no id", "s"), (60, "x" * 30_000, "s"), (61, None, "s")]
    assert sorted(licenses.sample(docs(spark, rows))) == sorted([""] + [min(t for d, t, _ in rows if d == i) for i in range(50)])


def test_licence_edges(spark, license_model):
    rows = licenses.scan(docs(spark), license_model).collect()
    assert len(rows) == len(ROWS) and all(r.paragraphs == [] for r in rows)
    assert licenses.scan(empty(spark), license_model).count() == 0
    assert isinstance(licenses.fit(empty(spark)), licenses.LicenseModel)
    assert isinstance(licenses.scan(docs(spark), license_model).schema["paragraphs"].dataType, T.ArrayType)
    assert docs(spark).select(F.count("*")).first()[0] == len(ROWS)
