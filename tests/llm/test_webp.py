"""op12: lossless WebP against foreign files, round trips of every feature, and a decoder that reads bit by bit."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import webp
from pairwright.llm.common import table

SF = "/root/testdata/sf0.001"
#: A lossless picture of one transparent pixel that another encoder made (widely used to test browsers for WebP), and a lossy one's head.
FOREIGN = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
LOSSY = base64.b64decode("UklGRiIAAABXRUJQVlA4IBYAAAAwAQCdASoBAAEADsD+JaQAA3AAAAAA")


class PlainReader:
    """Reads pixels one bit and one symbol at a time, as the format's description tells, without transforms."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def bits(self, n):
        value = 0
        for i in range(n):
            value |= (self.data[self.at >> 3] >> (self.at & 7) & 1) << i
            self.at += 1
        return value

    @staticmethod
    def codes(lengths):
        used = [i for i, n in enumerate(lengths) if n]
        if len(used) == 1:
            return {"": used[0]}
        code, found, before = 0, {}, 0
        for n, symbol in sorted((lengths[i], i) for i in used):
            code <<= n - before
            found[format(code, f"0{n}b")] = symbol
            code, before = code + 1, n
        return found

    def symbol(self, code):
        seen = ""
        while seen not in code:
            seen += str(self.bits(1))
        return code[seen]

    def code(self, alphabet):
        lengths = [0] * max(alphabet, 256)
        if self.bits(1):
            two = self.bits(1)
            lengths[self.bits(8 if self.bits(1) else 1)] = 1
            if two:
                lengths[self.bits(8)] = 1
            return self.codes(lengths)
        of = [0] * 19
        for place in webp.LENGTH_ORDER[: 4 + self.bits(4)]:
            of[place] = self.bits(3)
        assert not self.bits(1)
        code, out, last = self.codes(of), [], 8
        while len(out) < alphabet:
            s = self.symbol(code)
            if s < 16:
                out.append(s)
                last = s or last
            else:
                out += [last] * (3 + self.bits(2)) if s == 16 else [0] * (3 + self.bits(3) if s == 17 else 11 + self.bits(7))
        return self.codes(out)

    def number(self, prefix):
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.bits(extra) + 1

    def pixels(self, w, h, main=True):
        cache_bits = self.bits(4) if self.bits(1) else 0
        cache, group_of, n_groups = {}, None, 1
        if main and self.bits(1):
            size = self.bits(3) + 2
            wide = -(-w >> size)
            tiles = self.pixels(wide, -(-h >> size), False)
            group_of = lambda i: tiles[(i // w >> size) * wide + (i % w >> size)] >> 8 & 0xFFFF
            n_groups = max(t >> 8 & 0xFFFF for t in tiles) + 1
        groups = [[self.code(a) for a in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(n_groups)]
        out = []
        while len(out) < w * h:
            codes = groups[group_of(len(out)) if group_of else 0]
            s = self.symbol(codes[0])
            if s < 256:
                r, b, a = (self.symbol(c) for c in codes[1:4])
                new = [a << 24 | r << 16 | s << 8 | b]
            elif s < 280:
                length, code = self.number(s - 256), self.number(self.symbol(codes[4]))
                distance = code - 120 if code > 120 else max(1, webp.NEAR[code - 1][0] + webp.NEAR[code - 1][1] * w)
                new = []
                for k in range(length):
                    new.append((out + new)[len(out) + k - distance])
            else:
                new = [cache.get(s - 280, 0)]
            for p in new:
                if cache_bits:
                    cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            out += new
        return out


def plain_pixels(data):
    """Of a file without transforms."""
    size = struct.unpack_from("<I", data, 16)[0]
    r = PlainReader(data[20 : 20 + size])
    assert r.bits(8) == 0x2F
    w, h = r.bits(14) + 1, r.bits(14) + 1
    assert (r.bits(4), r.bits(1)) in ((0, 0), (1, 0))
    return np.array(r.pixels(w, h), np.uint32).reshape(h, w)


def pictures():
    rng = np.random.default_rng(4)
    for h, w in ((1, 1), (1, 9), (7, 1), (5, 3), (16, 16), (21, 50)):
        y, x = np.mgrid[:h, :w]
        yield rng.integers(0, 2**32, (h, w), dtype=np.uint32)  # noise
        yield np.uint32(webp.BLACK) | rng.integers(0, 3, (h, w)).astype(np.uint32) * np.uint32(0x010203)  # few colours
        yield np.uint32(webp.BLACK) | ((x * 3 + y) % 256 << 16 | (x + y * 2) % 256 << 8 | (x + y) % 256).astype(np.uint32)  # slopes
        yield np.full((h, w), 0x80112233, np.uint32)
        yield np.uint32(webp.BLACK) | (x % 17 * 15).astype(np.uint32) << np.uint32(8)  # repeats


def test_files_of_another_encoder_and_broken_ones():
    found = webp.decode(FOREIGN)
    assert found.pixels.tolist() == [[0]] and found.transforms == ["palette"]
    extended = FOREIGN[:12] + b"VP8X" + struct.pack("<I", 9) + bytes(10) + FOREIGN[12:]
    assert webp.decode(extended).pixels.tolist() == [[0]]
    for bad in (b"", b"RIFF", LOSSY, FOREIGN[:20], FOREIGN[:25], FOREIGN[:20] + b"\x00" + FOREIGN[21:], b"RIFX" + FOREIGN[4:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    whole = webp.encode(next(pictures()))
    good = webp.encode(list(pictures())[-5])
    assert webp.decode(whole).pixels.shape == (1, 1)
    for cut in range(21, len(good) - 1, 97):
        with pytest.raises(ValueError):
            webp.decode(good[:cut])


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
def test_tokens_are_those_of_a_reader_of_single_bits(cache_bits):
    rng = np.random.default_rng(1)
    for argb in pictures():
        h, w = argb.shape
        groups = rng.integers(0, 3, (-(-h >> 2), -(-w >> 2)))
        for given in (None, (groups, 2)):
            data = webp.encode(argb, cache_bits=cache_bits, groups=given)
            assert (plain_pixels(data) == argb).all()
            assert (webp.decode(data).pixels == argb).all()


@pytest.mark.parametrize("bits", [2, 4])
def test_transforms_are_undone(bits):
    rng = np.random.default_rng(2)
    for argb in pictures():
        h, w = argb.shape
        shape = (-(-h >> bits), -(-w >> bits))
        modes = np.uint32(webp.BLACK) | rng.integers(0, 14, shape).astype(np.uint32) << np.uint32(8)
        factors = np.uint32(webp.BLACK) | rng.integers(0, 1 << 24, shape).astype(np.uint32)
        for given in ({"predictor": (modes, bits)}, {"cross": (factors, bits)}, {"green": True}, {"green": True, "predictor": (modes, bits), "cross": (factors, bits), "cache_bits": 3}):
            assert (webp.decode(webp.encode(argb, **given)).pixels == argb).all()
        if len(np.unique(argb)) <= 256:
            found = webp.decode(webp.encode(argb, palette=True, green=True))
            assert (found.pixels == argb).all() and found.transforms == ["subtract-green", "palette"]


def plain_prediction(out, residual, mode, x, y, w):
    """One pixel from the pixels before it, channel by channel."""
    part = lambda p: [p >> s & 255 for s in (24, 16, 8, 0)]
    if x == 0 and y == 0:
        guess = [255, 0, 0, 0]
    elif y == 0:
        guess = part(out[x - 1])
    elif x == 0:
        guess = part(out[(y - 1) * w])
    else:
        at = y * w + x
        left, top, right, corner = part(out[at - 1]), part(out[at - w]), part(out[at - w + 1]), part(out[at - w - 1])
        clip = lambda v: min(max(v, 0), 255)
        guess = []
        for i, (a, b, c, d) in enumerate(zip(left, top, right, corner, strict=True)):
            guess.append([
                (255, 0, 0, 0)[i], a, b, c, d, ((a + c) // 2 + b) // 2, (a + d) // 2, (a + b) // 2, (d + b) // 2, (b + c) // 2, ((a + d) // 2 + (b + c) // 2) // 2,
                None, clip(a + b - d), clip((a + b) // 2 + int(((a + b) // 2 - d) / 2)),
            ][mode])
        if mode == 11:
            to_left = sum(abs(b - d) for b, d in zip(top, corner, strict=True))
            guess = left if to_left < sum(abs(a - d) for a, d in zip(left, corner, strict=True)) else top
    value = 0
    for g, r in zip(guess, part(residual), strict=True):
        value = value << 8 | (g + r) % 256
    return value


def test_prediction_and_cross_colour_pixel_by_pixel():
    rng = np.random.default_rng(7)
    h, w = 9, 13
    residual = rng.integers(0, 1 << 32, (h, w), dtype=np.uint32)
    for mode in range(14):
        tiles = np.full((3, 4), webp.BLACK | mode << 8, np.uint32)
        out = []
        for i, r in enumerate(residual.ravel().tolist()):
            out.append(plain_prediction(out, r, mode, i % w, i // w, w))
        assert webp.undo_prediction(residual, tiles, 2).ravel().tolist() == out
    signed = lambda v: v - 256 if v > 127 else v
    tiles = np.full((3, 4), 0xFF85F37C, np.uint32)
    found = webp.undo_cross_colour(residual, tiles, 2).ravel().tolist()
    for p, q in zip(residual.ravel().tolist(), found, strict=True):
        g = signed(p >> 8 & 255)
        red = (p >> 16) + (signed(0x7C) * g >> 5) & 255
        blue = (p & 255) + (signed(0xF3) * g >> 5) + (signed(0x85) * signed(red) >> 5) & 255
        assert q == p & 0xFF00FF00 | red << 16 | blue


def test_codes_are_complete_and_short_enough():
    rng = np.random.default_rng(3)
    for n in (2, 3, 7, 40, 280):
        counts = rng.integers(0, 50, n) + (np.arange(n) == 0) + (np.arange(n) == 1)
        lengths = webp.code_lengths(counts)
        assert sum(2.0 ** -int(x) for x in lengths if x) == 1 and (lengths > 0).tolist() == (counts > 0).tolist()
    steep = np.array([1 << min(i, 50) for i in range(40)])
    assert webp.code_lengths(steep).max() <= webp.LONGEST_CODE
    assert sum(2.0 ** -int(x) for x in webp.LENGTH_LENGTHS) == 1


def test_payloads_of_all_sizes_come_back():
    rng = np.random.default_rng(9)
    for size in (0, 1, 575, 576, 577, 5000, webp.UNIT * webp.ROWS, webp.UNIT * webp.ROWS * 2 + 1):
        text = "".join(map(chr, rng.integers(32, 1000, size)))
        payload = webp.padded(text)
        assert len(payload) % 576 == 0 and len(payload) - len(text.encode()) <= 576
        assert b"".join(p.tobytes() for p in webp.samples(webp.pages_of(payload))) == payload
    assert webp.padded("") == b"\xff" * 576


def test_query_and_defined_cases(spark, tmp_path):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()]
    rows += [(-1, None, "x"), (-2, "", "x"), (-3, "", "y"), (None, "naïve café 😀", "z"), (-4, "a b\n" * 60_000, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, pages string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in webp.op12_webp_media(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for doc_id, text, _ in rows:
        body = (text or "").encode()
        payload = body + b"\xff" * ((-len(body)) % 576 or (0 if body else 576))
        r = found[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        pages = webp.pages_of(payload)
        assert r.media_sha256 == hashlib.sha256(b"".join(pages)).hexdigest() and r.media_bytes == sum(map(len, pages))
    assert found[-1][1:] == found[-2][1:] == found[-3][1:]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert webp.op12_webp_media(spark, f"{tmp_path}/none").collect() == []


def test_pixel_arrays_of_a_column_of_files(spark):
    argb = list(pictures())[-2]
    files = spark.createDataFrame([("a", bytearray(webp.encode(argb)), 1), ("b", None, 2), ("c", bytearray(FOREIGN), 3)], "id string, file binary, width int")
    found = {r.id: r for r in webp.decoded(files).collect()}
    assert (found["a"].width, found["a"].height, found["a"].transforms) == (50, 21, [])
    assert np.array(found["a"].pixels, np.int32).view(np.uint32).tolist() == argb.ravel().tolist()
    assert found["b"].pixels is None and found["c"].pixels == [0]
    assert webp.decoded(files.where(F.lit(False))).collect() == []


def test_pages_use_a_predictor_or_groups_where_these_help():
    rng = np.random.default_rng(3)
    slow = np.cumsum(rng.integers(-1, 2, webp.WIDTH * 60)).astype(np.uint8)
    halves = np.concatenate((rng.integers(40, 70, webp.WIDTH * 64), rng.integers(80, 120, webp.WIDTH * 64))).astype(np.uint8)
    text = " ".join(f"word{rng.integers(3000)}" for _ in range(3000)).encode()
    for payload, predicted, grouped in ((slow.tobytes(), True, False), (halves.tobytes(), False, True), (text + b"." * (-len(text) % webp.WIDTH), False, False)):
        pages = webp.pages_of(payload)
        assert b"".join(part.tobytes() for part in webp.samples(pages)) == payload
        grey = np.frombuffer(payload, np.uint8).reshape(-1, webp.WIDTH)
        plain = webp.encode(np.uint32(webp.BLACK) | grey.astype(np.uint32) * np.uint32(0x010101), green=True)
        assert ("predictor" in webp.decode(pages[0]).transforms) == predicted
        assert (len(pages[0]) < len(plain)) == (predicted or grouped)


def test_samples_of_a_page_are_counted_once(monkeypatch):
    calls, plain = [], np.bincount
    monkeypatch.setattr(webp.np, "bincount", lambda *a, **b: calls.append(1) or plain(*a, **b))
    page = webp.padded("".join(chr(97 + (i * i + i // 7) % 23) for i in range(5000)) + "some words that come again, " * 9)
    pages = webp.pages_of(page)
    assert len(calls) == 5  # of samples, of two kinds of differences, of the codes of green and distance
    assert b"".join(s.tobytes() for s in webp.samples(pages)) == page
