"""Lossless WebP pictures: decoded to pixel arrays, and written.

Decoding keeps to NumPy.  Every bit of a picture's data is looked at as if a token began there: one
table lookup tells the token's prefix code, and further ones its other channels, or its length and distance with
their extra bits, so that each bit knows the bit at which the next token would begin.  The tokens that there are
follow from the first one by going from bit to bit, several tokens a step.  Literals are then put
in place at once, back-references one by one, and only pictures that use the colour cache are walked pixel by
pixel.  Transforms are undone in reverse order: the predictor along the anti-diagonals whose pixels do not
depend on one another, cross-colour, subtracted green and palette (with bundled indices) as a whole.

Pixels are 32-bit ARGB numbers.  Files may hold further chunks (such as an extended header or metadata), which are skipped;
lossy and animated files, and those that break the format, raise ValueError.

Payloads (any bytes) are stored as grey pictures with one 8-bit sample a byte, WIDTH wide, in pages of at
most ROWS rows.  Their bytes are a function of the payload alone.

Defined cases of the DataFrame operators: null texts are empty ones; a payload has UNIT bytes at least; very
long texts are many pages; null pictures give null pixels; repeated rows give repeated results; rows without doc_id are
kept; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import Stage, doc_texts, slices, table

#: Payloads are padded with PAD to a multiple of UNIT, a row of a page.
UNIT, PAD, ROWS = 576, 255, 128
WIDTH = UNIT

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = 0xFF000000

# Fixed values of the format: the order in which lengths of the code for code lengths are stored, and the places
# (columns to the left, rows up) that the first 120 distance codes mean.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_NEAR = np.array(NEAR, np.int64)
#: Symbols of a green code are 256 values, then LENGTHS prefixes of lengths, then indices of the colour cache.
LENGTHS, DISTANCES, LONGEST_CODE = 24, 40, 15
CACHE_FACTOR = np.uint32(0x1E35A7BD)

_REVERSED: dict[int, np.ndarray] = {}


def _reversed_bits(width: int) -> np.ndarray:
    """All numbers of so many bits with their bits in reverse."""
    if width not in _REVERSED:
        numbers, found = np.arange(1 << width, dtype=np.uint32), np.zeros(1 << width, np.uint32)
        for bit in range(width):
            found |= ((numbers >> np.uint32(bit)) & np.uint32(1)) << np.uint32(width - 1 - bit)
        _REVERSED[width] = found
    return _REVERSED[width]


def _tiles(size: int, bits: int) -> int:
    return -(-size >> bits)


def _channels(argb: np.ndarray) -> tuple[np.ndarray, ...]:
    """Alpha, red, green, blue as signed numbers."""
    return tuple(((argb >> np.uint32(shift)) & np.uint32(255)).astype(np.int32) for shift in (24, 16, 8, 0))


def _argb(a: np.ndarray, r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Channels modulo 256 as pixels."""
    a, r, g, b = ((c & 255).astype(np.uint32) for c in (a, r, g, b))
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def _cache_place(argb: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (argb * CACHE_FACTOR) >> np.uint32(32 - bits)


# ---------------------------------------------------------------------------------- transforms


def _average(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x + y) >> 1


def predicted(modes: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Predictions (4 channels by pixels) by mode, from the pixels to the left, above, above to the right and above to the left."""
    out = np.zeros_like(left)
    for mode in np.unique(modes).tolist():
        at = modes == mode
        l, t, tr, tl = left[:, at], top[:, at], right[:, at], corner[:, at]  # noqa: E741
        if mode in (0, 14, 15):
            found = np.repeat(np.array([[255], [0], [0], [0]], l.dtype), l.shape[1], 1)
        elif mode in (1, 2, 3, 4):
            found = (l, t, tr, tl)[mode - 1]
        elif mode == 5:
            found = _average(_average(l, tr), t)
        elif mode in (6, 7, 8, 9):
            found = _average(*((l, tl), (l, t), (tl, t), (t, tr))[mode - 6])
        elif mode == 10:
            found = _average(_average(l, tl), _average(t, tr))
        elif mode == 11:
            found = np.where(np.abs(t - tl).sum(0) < np.abs(l - tl).sum(0), l, t)
        elif mode == 12:
            found = np.clip(l + t - tl, 0, 255)
        else:
            middle = _average(l, t)
            found = np.clip(middle + np.trunc((middle - tl) / 2).astype(l.dtype), 0, 255)
        out[:, at] = found
    return out


def _modes(tiles: np.ndarray, bits: int, w: int, h: int) -> np.ndarray:
    """Mode of each pixel: those of the first row and column are the same whatever the tiles say."""
    modes = np.repeat(np.repeat((tiles >> np.uint32(8)) & np.uint32(15), 1 << bits, 0), 1 << bits, 1)[:h, :w].astype(np.int64)
    modes[:, 0] = 2
    modes[0, :] = 1
    modes[0, 0] = 0
    return modes


def _neighbours(grid: np.ndarray, w: int, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Left, top, top right and top left of places in scan order; grid has w + 1 places before the first pixel."""
    at = at + w + 1
    return grid[:, at - 1], grid[:, at - w], grid[:, at - w + 1], grid[:, at - w - 1]


def undo_prediction(residual: np.ndarray, tiles: np.ndarray, bits: int) -> np.ndarray:
    h, w = residual.shape
    modes = _modes(tiles, bits, w, h).ravel()
    grid = np.zeros((4, w + 1 + w * h), np.int32)
    grid[:, w + 1 :] = np.stack(_channels(residual.ravel()))
    # a pixel needs the one to its left and, from the row above, one further to the right: x + 2 y tells when it can be done
    when = (np.arange(w)[None, :] + 2 * np.arange(h)[:, None]).ravel()
    order = np.argsort(when, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(when[order])) + 1):
        grid[:, at + w + 1] = (grid[:, at + w + 1] + predicted(modes[at], *_neighbours(grid, w, at))) & 255
    return _argb(*grid[:, w + 1 :]).reshape(h, w)


def predict(argb: np.ndarray, tiles: np.ndarray, bits: int) -> np.ndarray:
    """Differences between pixels and what is predicted for them."""
    h, w = argb.shape
    grid = np.zeros((4, w + 1 + w * h), np.int32)
    grid[:, w + 1 :] = np.stack(_channels(argb.ravel()))
    guess = predicted(_modes(tiles, bits, w, h).ravel(), *_neighbours(grid, w, np.arange(w * h)))
    return _argb(*(grid[:, w + 1 :] - guess)).reshape(h, w)


def _cross(tiles: np.ndarray, bits: int, w: int, h: int) -> list[np.ndarray]:
    """Signed factors red to blue, green to blue, green to red of each pixel."""
    factors = [c.astype(np.uint8).view(np.int8).astype(np.int32) for c in (x.astype(np.uint8) for x in _channels(tiles)[1:])]
    return [np.repeat(np.repeat(f, 1 << bits, 0), 1 << bits, 1)[:h, :w] for f in factors]


def _signed(channel: np.ndarray) -> np.ndarray:
    return ((channel & 255) ^ 128) - 128


def undo_cross_colour(residual: np.ndarray, tiles: np.ndarray, bits: int) -> np.ndarray:
    red_blue, green_blue, green_red = _cross(tiles, bits, residual.shape[1], residual.shape[0])
    a, r, g, b = _channels(residual)
    r = r + (green_red * _signed(g) >> 5)
    return _argb(a, r, g, b + (green_blue * _signed(g) >> 5) + (red_blue * _signed(r) >> 5))


def cross_colour(argb: np.ndarray, tiles: np.ndarray, bits: int) -> np.ndarray:
    red_blue, green_blue, green_red = _cross(tiles, bits, argb.shape[1], argb.shape[0])
    a, r, g, b = _channels(argb)
    return _argb(a, r - (green_red * _signed(g) >> 5), g, b - (green_blue * _signed(g) >> 5) - (red_blue * _signed(r) >> 5))


_RED_BLUE, _ALPHA_GREEN, _TWICE = np.uint32(0x00FF00FF), np.uint32(0xFF00FF00), np.uint32(0x00010001)


def undo_subtracted_green(residual: np.ndarray) -> np.ndarray:
    green = ((residual >> np.uint32(8)) & np.uint32(255)) * _TWICE  # beside red and blue
    return (residual & _ALPHA_GREEN) | ((residual & _RED_BLUE) + green & _RED_BLUE)


def subtract_green(argb: np.ndarray) -> np.ndarray:
    green = ((argb >> np.uint32(8)) & np.uint32(255)) * _TWICE
    return (argb & _ALPHA_GREEN) | ((argb | _ALPHA_GREEN) - green & _RED_BLUE)


def bundling(colours: int) -> int:
    """Pixels of a palette of so many colours lie 2 ** this many in one."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(indices: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bundle = bundling(len(palette))
    x = np.arange(width)
    shift = ((x & ((1 << bundle) - 1)) << (3 - bundle)).astype(np.uint32)
    found = ((indices[:, x >> bundle] >> np.uint32(8)) & np.uint32(255)) >> shift & np.uint32((1 << (8 >> bundle)) - 1)
    return np.append(palette, np.zeros(256 - len(palette), np.uint32))[found]


def apply_palette(argb: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Bundled indices into a palette (ascending)."""
    bundle = bundling(len(palette))
    h, w = argb.shape
    wide = _tiles(w, bundle)
    held = np.zeros((h, wide << bundle), np.uint32)
    held[:, :w] = np.searchsorted(palette, argb)
    shift = (np.arange(1 << bundle) << (3 - bundle)).astype(np.uint32)
    return np.uint32(BLACK) | (held.reshape(h, wide, -1) << shift).sum(2).astype(np.uint32) << np.uint32(8)


# ------------------------------------------------------------------------------------ decoding


class Bits:
    """Bits of a file from the lowest one of each byte on."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + 9], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the picture ends too early")
        return value & ((1 << n) - 1)


class Prefix:
    """Table by the next `width` bits: length of the code there in the upper 16 bits, symbol in the lower."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 1:  # a single symbol takes no bits
            self.width, self.table, self.only = 0, used.astype(np.int32), int(used[0])
            return
        self.only = None
        if not len(used):
            raise ValueError("a prefix code has no symbols")
        of = lengths[used]
        self.width = int(of.max())
        order = np.argsort(of, kind="stable")
        share = 1 << (self.width - of[order])
        if share.sum() != 1 << self.width:
            raise ValueError("a prefix code is not complete")
        rows = np.repeat((of[order] << 16 | used[order]).astype(np.int32), share)
        self.table = rows[_reversed_bits(self.width)]

    def at(self, windows: np.ndarray) -> np.ndarray:
        return self.table[windows & np.uint32((1 << self.width) - 1)]


@functools.lru_cache(256)
def _known_code(lengths: tuple[int, ...]) -> Prefix:
    return Prefix(np.array(lengths))


@functools.lru_cache(1024)
def _few_symbols(*symbols: int) -> Prefix:
    lengths = np.zeros(max(symbols) + 1, np.int64)
    lengths[list(symbols)] = 1
    return Prefix(lengths)


def _read_code(bits: Bits, alphabet: int) -> Prefix:
    if bits.read(1):  # one or two symbols
        two = bits.read(1)
        symbols = {bits.read(8 if bits.read(1) else 1)}
        if two:
            symbols.add(bits.read(8))
        if max(symbols) >= alphabet:
            raise ValueError("a symbol is not in its alphabet")
        return _few_symbols(*symbols)
    of_lengths, stored = [0] * 19, 4 + bits.read(4)
    together = bits.read(3 * stored)
    for i in range(stored):
        of_lengths[LENGTH_ORDER[i]] = together >> 3 * i & 7
    code = _known_code(tuple(of_lengths))
    mask, known = (1 << code.width) - 1, code.table.tolist()
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    first = bits.at >> 3
    rest = int.from_bytes(bits.data[first : first + 2 * alphabet + 4], "little") >> (bits.at & 7)  # a length takes 14 bits at most
    took, last = 0, 8
    out: list[int] = []
    while len(out) < alphabet and left:
        left -= 1
        entry = known[rest & mask]
        symbol, n = entry & 0xFFFF, entry >> 16
        if symbol < 16:
            out.append(symbol)
            last = symbol or last
        else:
            more, least = ((2, 3), (3, 3), (7, 11))[symbol - 16]
            out += [last if symbol == 16 else 0] * (least + (rest >> n & ((1 << more) - 1)))
            n += more
        rest >>= n
        took += n
    bits.at += took
    if len(out) > alphabet or bits.at > 8 * len(bits.data):
        raise ValueError("lengths of codes do not fit their alphabet")
    return Prefix(np.array(out))


def _extra(code: np.ndarray) -> np.ndarray:
    """How many extra bits follow a prefix of a length or distance."""
    return np.maximum((code - 2) >> 1, 0)


def _spelled(code: np.ndarray, extra: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The number that a prefix and its extra bits mean."""
    rest = (windows & ((np.uint32(1) << extra.astype(np.uint32)) - np.uint32(1))).astype(np.int64)
    return np.where(code < 4, code + 1, ((2 + (code & 1)) << extra) + rest + 1)


class Tokens:
    """What begins at every bit, read by one group of prefix codes (green, red, blue, alpha, distance)."""

    def __init__(self, windows: np.ndarray, codes: list[Prefix], width: int):
        self.windows, self.codes = windows, codes
        self.last = len(windows) - 1
        entry = codes[0].at(windows)
        self.symbols = entry & 0xFFFF
        self.after_green = np.arange(len(windows))
        self.after_green += entry >> 16
        np.minimum(self.after_green, self.last, out=self.after_green)
        self.next = self.after_green
        if any(c.width for c in codes[1:4]):
            ends = self.after_green
            for code in codes[1:4]:
                ends = np.minimum(ends + (code.at(windows[ends]) >> 16), self.last)
            self.next = np.where(self.symbols < 256, ends, self.after_green)
        self.spans = None
        copies = np.flatnonzero((self.symbols >= 256) & (self.symbols < 256 + LENGTHS))
        if len(copies):
            self.next = self.next.copy()
            at, code = self.after_green[copies], self.symbols[copies].astype(np.int64) - 256
            extra = _extra(code)
            self.spans = np.ones(len(windows), np.int32)
            self.spans[copies] = _spelled(code, extra, windows[at])
            at = np.minimum(at + extra, self.last)
            entry = codes[4].at(windows[at])
            code, at = (entry & 0xFFFF).astype(np.int64), np.minimum(at + (entry >> 16), self.last)
            extra = _extra(code)
            far = _spelled(code, extra, windows[at])
            near = np.maximum(_NEAR[:, 0] + _NEAR[:, 1] * width, 1)
            self.distances = np.zeros(len(windows), np.int32)
            self.distances[copies] = np.where(far > len(near), far - len(near), near[np.minimum(far, len(near)) - 1])
            self.next[copies] = np.minimum(at + extra, self.last)

    def colours(self, at: np.ndarray) -> np.ndarray:
        """Pixels of the literals that begin at these bits."""
        place, parts = self.after_green[at], [self.symbols[at]]
        if all(code.only is not None for code in self.codes[1:4]):
            r, b, a = (code.only for code in self.codes[1:4])
            return np.uint32(a << 24 | r << 16 | b) | parts[0].astype(np.uint32) << np.uint32(8)
        for code in self.codes[1:4]:
            entry = code.at(self.windows[place])
            parts.append(entry & 0xFFFF)
            place = np.minimum(place + (entry >> 16), self.last)
        return _argb(parts[3], parts[1], parts[0], parts[2])


#: Tokens that a step of a walk passes, as a power of two.
HOPS = 2


def _walked(tokens: Tokens, first: int, n: int) -> np.ndarray:
    """Bits at which the tokens of n pixels begin."""
    if tokens.next[first] == first:  # one token that takes no bits, again and again
        return np.full(n if tokens.spans is None else -(-n // int(tokens.spans[first])), first)
    hops = [tokens.next]
    for _ in range(HOPS):
        hops.append(hops[-1][hops[-1]])
    step, at, last, met = memoryview(hops[-1]), first, tokens.last, []
    while at < last:
        met.append(at)
        at = step[at]
    found = np.array(met, np.int64)[:, None]
    for hop in reversed(hops[:-1]):
        found = np.concatenate((found, hop[found]), 1)
    found = found[:, _reversed_bits(HOPS)].ravel()  # columns came by halving steps
    if tokens.spans is None:
        return found[:n]
    return found[: int(np.searchsorted(np.cumsum(tokens.spans[found]), n)) + 1]


def _walked_by_groups(groups: list[Tokens], of_pixel: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The same where a pixel's place tells its codes: bits and groups."""
    steps = [memoryview(t.next) for t in groups]
    spans = [None if t.spans is None else memoryview(t.spans) for t in groups]
    which, n, at, done, met, by = memoryview(of_pixel), len(of_pixel), first, 0, [], []
    while done < n and len(met) < n:
        g = which[done]
        met.append(at)
        by.append(g)
        done += 1 if spans[g] is None else spans[g][at]
        at = steps[g][at]
    return np.array(met, np.int32), np.array(by, np.int32)


def _copied(out: np.ndarray, start: int, length: int, distance: int) -> None:
    if distance > start:
        raise ValueError("a back-reference goes before the picture")
    if distance >= length:
        out[start : start + length] = out[start - distance : start - distance + length]
    else:
        out[start : start + length] = np.resize(out[start - distance : start], length)


def _with_cache(out: np.ndarray, plan: Iterator[tuple], bits: int) -> None:
    """Pixels one after the other, as what the cache holds depends on all before: plan has start, symbol, length, distance."""
    cache, factor, shift = [0] * (1 << bits), int(CACHE_FACTOR), 32 - bits
    for start, symbol, length, distance in plan:
        if symbol >= 256 + LENGTHS:
            out[start] = cache[symbol - 256 - LENGTHS]
        elif symbol >= 256:
            _copied(out, start, length, distance)
        for argb in out[start : start + length].tolist():
            cache[(argb * factor & 0xFFFFFFFF) >> shift] = argb


def _read_pixels(bits: Bits, w: int, h: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    n, of_pixel, count = w * h, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        tiles = _read_pixels(bits, _tiles(w, tile), _tiles(h, tile), False)
        group = ((tiles >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int32)
        of_pixel = np.ascontiguousarray(np.repeat(np.repeat(group, 1 << tile, 0), 1 << tile, 1)[:h, :w]).ravel()
        count = int(group.max()) + 1
    alphabets = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[_read_code(bits, a) for a in alphabets] for _ in range(count)]
    first = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8, offset=first)[: 8 * n + 8].astype(np.uint32)  # a token takes under 64 bits
    raw = np.append(raw, np.zeros(12, np.uint32))
    words = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    windows = (words[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
    known = [Tokens(windows, group, w) for group in codes]
    if of_pixel is None:
        at = _walked(known[0], bits.at & 7, n)
        by = None
    else:
        at, by = _walked_by_groups(known, of_pixel, bits.at & 7)

    def of(name: str, default: int) -> np.ndarray:
        if by is None:
            values = getattr(known[0], name, None)
            return np.full(len(at), default) if values is None else values[at]
        out = np.full(len(at), default, np.int64)
        for g, tokens in enumerate(known):
            values = getattr(tokens, name, None)
            if values is not None:
                out[by == g] = values[at[by == g]]
        return out

    symbols, spans = of("symbols", 0), of("spans", 1)
    starts = np.cumsum(spans) - spans
    total = int(starts[-1] + spans[-1]) if len(at) else 0
    if total < n or (len(at) and starts[-1] >= n):
        raise ValueError("the picture ends too early")
    out = np.zeros(max(total, n), np.uint32)
    literal = symbols < 256
    if by is None:
        out[starts[literal]] = known[0].colours(at[literal])
    else:
        for g, tokens in enumerate(known):
            mine = literal & (by == g)
            out[starts[mine]] = tokens.colours(at[mine])
    ends = int(of("next", 0)[-1]) if len(at) else 0
    if first * 8 + ends > 8 * len(bits.data):
        raise ValueError("the picture ends too early")
    if cache_bits:
        _with_cache(out, zip(starts.tolist(), symbols.tolist(), spans.tolist(), of("distances", 0).tolist(), strict=True), cache_bits)
    elif not literal.all():
        copies = ~literal
        for start, length, distance in zip(starts[copies].tolist(), spans[copies].tolist(), of("distances", 0)[copies].tolist(), strict=True):
            _copied(out, start, length, distance)
    bits.at = first * 8 + ends
    return out[:n].reshape(h, w)


def _lossless_chunk(data: bytes) -> bytes:
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return data[at + 8 : at + 8 + size]
        if kind in (b"VP8 ", b"ANMF"):
            raise ValueError("a lossy or animated picture")
        at += 8 + size + (size & 1)
    raise ValueError("the file holds no picture")


@dataclass
class Picture:
    """pixels: rows of ARGB; transforms: the names of those that were undone."""

    pixels: np.ndarray
    transforms: list[str] = field(default_factory=list)


def decode(data: bytes) -> Picture:
    bits = Bits(_lossless_chunk(data))
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless picture")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)  # whether alpha is used: a hint
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, names, w = [], [], width
    while bits.read(1):
        kind = bits.read(2)
        name = ("predictor", "cross-colour", "subtract-green", "palette")[kind]
        if name in names:
            raise ValueError("a transform stands twice")
        names.append(name)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            tiles = _read_pixels(bits, _tiles(w, size), _tiles(height, size), False)
            undo.append((undo_prediction if kind == PREDICTOR else undo_cross_colour, (tiles, size)))
        elif kind == SUBTRACT_GREEN:
            undo.append((undo_subtracted_green, ()))
        else:
            rows = _channels(_read_pixels(bits, bits.read(8) + 1, 1, False)[0])
            palette = _argb(*(np.cumsum(c) for c in rows))
            undo.append((undo_palette, (palette, w)))
            w = _tiles(w, bundling(len(palette)))
    pixels = _read_pixels(bits, w, height, True)
    for inverse, given in reversed(undo):
        pixels = inverse(pixels, *given)
    return Picture(pixels, names)


# ------------------------------------------------------------------------------------- writing

#: Fixed by choice: lengths of the code for code lengths, by symbol 0 to 18; it is complete and favours lengths of 4 to 8.
LENGTH_LENGTHS = np.array([4, 7, 6, 6, 3, 3, 3, 3, 3, 4, 5, 6, 6, 7, 7, 7, 5, 5, 4])
#: A back-reference is at least so many pixels long.
LEAST_MATCH, MOST_MATCH = 8, 4096
#: Tiles of predictors and of groups of codes, as a power of two; a page is tried with these if they leave this part of its bits at most.
TILE, GAIN = 5, 0.9


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a prefix code for symbols by how often they stand: Huffman's, none over LONGEST_CODE."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used]
    while True:
        order = np.argsort(weights, kind="stable")
        n, heavy = len(order), weights[order].tolist()
        parents, leaf, inner = [0] * (2 * n - 1), 0, n
        for made in range(n, 2 * n - 1):  # leaves and inner nodes both come by ascending weight
            total = 0
            for _ in range(2):
                if leaf < n and (inner == made or heavy[leaf] <= heavy[inner]):
                    child, leaf = leaf, leaf + 1
                else:
                    child, inner = inner, inner + 1
                parents[child] = made
                total += heavy[child]
            heavy.append(total)
        depths = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depths[node] = depths[parents[node]] + 1
        if max(depths) <= LONGEST_CODE:
            lengths[used[order]] = depths[:n]
            return lengths
        weights = (weights + 1) >> 1


def _codes(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol, its first bit lowest."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return codes
    order = used[np.argsort(lengths[used], kind="stable")]
    width = int(lengths[order[-1]])
    share = 1 << (width - lengths[order])
    codes[order] = _reversed_bits(width)[np.cumsum(share) - share]  # the first bits of a code lead, so the reversed one has zeros above
    return codes


_FIRST = np.zeros(1, np.int64)


class Writer:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> bytes:
        """The bits so far and those of an array, as bytes; ends the writer."""
        head = self.value.to_bytes((self.size >> 6) * 8 + 8, "little")
        starts = self.size + np.cumsum(sizes) - sizes
        out = np.zeros(((self.size + int(sizes.sum())) >> 6) + 2, np.uint64)
        out[: len(head) >> 3] = np.frombuffer(head, "<u8")
        if len(values):
            word, shift = starts >> 6, (starts & 63).astype(np.uint64)
            firsts = np.concatenate((_FIRST, np.flatnonzero(word[1:] != word[:-1]) + 1))
            out[word[firsts]] |= np.add.reduceat(values << shift, firsts)  # bits of a word do not meet: their sum is their union
            spill = np.flatnonzero((starts & 63) + sizes > 64)
            out[word[spill] + 1] |= values[spill] >> (np.uint64(64) - shift[spill])
        return out.tobytes()[: -(-(self.size + int(sizes.sum())) >> 3)]


_LENGTHS_STORED = sum(int(LENGTH_LENGTHS[place]) << 3 * i for i, place in enumerate(LENGTH_ORDER))
_LENGTH_CODES = list(zip(_codes(LENGTH_LENGTHS).tolist(), LENGTH_LENGTHS.tolist(), strict=True))


def _put_few(out: Writer, symbols: list[int]) -> None:
    """A code of one or two symbols under 256."""
    out.put(1 | len(symbols) - 1 << 1 | 1 << 2, 3)
    for symbol in symbols:
        out.put(symbol, 8)


def _put_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist() or [0]
    if len(used) <= 2 and used[-1] < 256:
        _put_few(out, used)
        return
    out.put(len(LENGTH_ORDER) - 4 << 1, 5)
    out.put(_LENGTHS_STORED, 3 * len(LENGTH_ORDER))
    out.put(0, 1)
    value, size = 0, 0
    lasts, known, first = np.flatnonzero(lengths[1:] != lengths[:-1]).tolist(), lengths.tolist(), 0  # of runs of one length
    for last in [*lasts, len(known) - 1]:
        length, n, first = known[last], last + 1 - first, last + 1
        code, width = _LENGTH_CODES[length]
        if length:
            value |= code << size
            size += width
            n -= 1
        while n >= 3:  # runs of zeros, or of what was last
            which, extra, least = (16, 2, 3) if length else (18, 7, 11) if n >= 11 else (17, 3, 3)
            took = min(n, least + (1 << extra) - 1)
            of_run, wide = _LENGTH_CODES[which]
            value |= (of_run | took - least << wide) << size
            size += wide + extra
            n -= took
        for _ in range(n):
            value |= code << size
            size += width
    out.put(value, size)


def _prefixes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and how many of them, of numbers from 1 on."""
    less = numbers - 1
    top = np.frexp(np.maximum(less, 1).astype(np.float64))[1] - 1  # place of the highest bit
    half = np.where(less > 1, (less >> np.maximum(top - 1, 0)) & 1, 0)
    prefix = np.where(less < 2, less, 2 * top + half)
    extra = _extra(prefix)
    return prefix, less & ((1 << extra) - 1), extra


def _matches(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, distance of back-references, the longest at each place that is reached, from the last place that agrees in LEAST_MATCH pixels."""
    n = len(pixels) - LEAST_MATCH + 1
    if n < 2:
        return []
    one_channel = not int(np.bitwise_or.reduce(pixels ^ pixels[0])) & ~0xFF00
    if one_channel:  # the samples of LEAST_MATCH pixels are the bytes of one number
        held = (pixels >> np.uint32(8)).astype(np.uint8)
        window = np.ndarray(n, np.uint64, held, strides=(1,)).copy()
        mixed = window * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    else:
        mixed = pixels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed, size = mixed ^ (mixed >> np.uint64(31)), 1
        while size < LEAST_MATCH:
            mixed = (mixed[:-size] * np.uint64(0xD6E8FEB86659FD93)) ^ (mixed[size:] + (mixed[size:] >> np.uint64(29)))
            size *= 2
    keys = mixed << np.uint64(24)
    keys |= np.arange(n, dtype=np.uint64)  # pictures have fewer than 2 ** 24 pixels here
    keys.sort()
    low = np.uint64((1 << 24) - 1)
    same = np.flatnonzero((keys[1:] ^ keys[:-1]) <= low) + 1
    at, before = (keys[same] & low).astype(np.int64), (keys[same - 1] & low).astype(np.int64)
    if one_channel:
        real = window[at] == window[before]
    else:
        window_of = np.arange(LEAST_MATCH)
        real = (pixels[at[:, None] + window_of] == pixels[before[:, None] + window_of]).all(1)
    distance = np.zeros(n + 1, np.int64)
    distance[at[real]] = (at - before)[real]
    # a match goes on as long as the next places have matches at the same distance
    turns = np.flatnonzero(distance[1:] != distance[:-1]) + 1
    firsts = np.concatenate((_FIRST, turns))  # runs of places with one distance, or none
    steps = distance[firsts]
    runs = np.flatnonzero(steps)
    found, cursor = [], 0
    for first, end, step in zip(firsts[runs].tolist(), turns[runs].tolist(), steps[runs].tolist(), strict=True):
        first = max(first, cursor)
        while first < end:
            length = min(end - first + LEAST_MATCH - 1, MOST_MATCH)
            found.append((first, length, step))
            first = cursor = first + length
    return found


@functools.lru_cache(16)
def _near_codes(width: int) -> np.ndarray:
    """Number of the near place at each distance, 0 where there is none."""
    near = np.zeros(8 * width + 9, np.int64)
    for number in range(len(NEAR), 0, -1):
        at = NEAR[number - 1][0] + NEAR[number - 1][1] * width
        if at >= 1:
            near[at] = number
    return near


def _distance_codes(distance: np.ndarray, width: int) -> np.ndarray:
    """Near places by their number, further ones by their distance."""
    near = _near_codes(width)
    short = near[np.minimum(distance, len(near) - 1)]
    return np.where((distance < len(near)) & (short > 0), short, distance + len(NEAR))


def _put_pixels(out: Writer, pixels: np.ndarray, cache_bits: int = 0, groups: tuple[np.ndarray, int] | None = None, main: bool = True) -> bytes | None:
    """Entropy-coded pixels; of the main picture all bytes written so far are returned.  groups: group of each tile, and the tile's bits."""
    h, w = pixels.shape
    flat = pixels.ravel()
    out.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        out.put(0 if groups is None else 1, 1)
    of_pixel = None
    if groups is not None:
        of_tile, tile = groups
        out.put(tile - 2, 3)
        _put_pixels(out, (np.uint32(BLACK) | of_tile.astype(np.uint32) << np.uint32(8)), main=False)
        of_pixel = np.repeat(np.repeat(of_tile, 1 << tile, 0), 1 << tile, 1)[:h, :w].ravel().astype(np.int64)
    start, length, distance = np.array(_matches(flat), np.int64).reshape(-1, 3).T
    inside = np.zeros(len(flat) + 1, np.int8)  # matches do not overlap: 1 from each one's second pixel on
    inside[start + 1] = 1
    inside[start + length] -= 1
    starts = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)  # where tokens begin
    is_copy = np.zeros(len(starts), bool)
    is_copy[np.searchsorted(starts, start)] = True
    first = flat[starts]
    green = ((first >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    literal = ~is_copy
    if cache_bits:
        place = _cache_place(flat, cache_bits)
        by_place = np.argsort(place, kind="stable")
        hit = np.zeros(len(flat), bool)  # whether the last pixel of this place has this colour
        hit[by_place[1:]] = (place[by_place[1:]] == place[by_place[:-1]]) & (flat[by_place[1:]] == flat[by_place[:-1]])
        held = literal & hit[starts]
        green[held] = 256 + LENGTHS + place[starts[held]]
        literal &= ~held
    both = (np.split(part, 2) for part in _prefixes(np.concatenate((length, _distance_codes(distance, w)))))
    (prefix, back), (rest, back_rest), (extra, back_extra) = both
    green[is_copy] = 256 + prefix
    values, sizes = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)

    def append(which: np.ndarray, value: np.ndarray, size: np.ndarray) -> None:
        values[which] |= value.astype(np.uint64) << sizes[which].astype(np.uint64)
        sizes[which] += size

    def coded(which: np.ndarray, symbols: np.ndarray, alphabet: int) -> None:
        of = code_lengths(np.bincount(symbols, minlength=alphabet))
        _put_code(out, of)
        if np.count_nonzero(of) > 1:
            append(which, _codes(of)[symbols], of[symbols])

    copies, plains, every = np.flatnonzero(is_copy), np.flatnonzero(literal), slice(None)
    group = None if of_pixel is None else of_pixel[starts]
    for k in range(1 if group is None else int(of_pixel.max()) + 1):
        mine, plain, of_copies = every, plains, every
        if group is not None:
            mine, plain, of_copies = np.flatnonzero(group == k), plains[group[plains] == k], group[copies] == k
        mine_copies = copies[of_copies]
        coded(mine, green[mine], 256 + LENGTHS + (1 << cache_bits if cache_bits else 0))
        append(mine_copies, rest[of_copies], extra[of_copies])
        pixels_here = first[plain]
        varies = int(np.bitwise_or.reduce(pixels_here ^ pixels_here[0])) if len(plain) else 0
        for shift in (16, 0, 24):
            if varies >> shift & 255:
                coded(plain, ((pixels_here >> np.uint32(shift)) & np.uint32(255)).astype(np.int64), 256)
            else:  # a code of one symbol, which takes no bits
                _put_few(out, [int(pixels_here[0]) >> shift & 255 if len(plain) else 0])
        coded(mine_copies, back[of_copies], DISTANCES)
        append(mine_copies, back_rest[of_copies], back_extra[of_copies])
    body = out.put_all(values, sizes)
    if main:
        return body
    out.size += int(sizes.sum())
    out.value = int.from_bytes(body, "little")
    return None


def _put_tiles(out: Writer, kind: int, tiles: np.ndarray, bits: int) -> None:
    out.put(1 | kind << 1, 3)
    out.put(bits - 2, 3)
    _put_pixels(out, tiles, main=False)


def encode(argb: np.ndarray, predictor: tuple | None = None, cross: tuple | None = None, green: bool = False, palette: bool = False, cache_bits: int = 0, groups: tuple | None = None) -> bytes:
    """A lossless file of rows of ARGB pixels.

    predictor, cross: the transform's tiles and their size in bits; groups: the same for groups of prefix codes.
    """
    h, w = argb.shape
    if max(h, w) > 1 << 14:
        raise ValueError("a picture is at most 16,384 pixels wide and high")
    out = Writer()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(int((argb >> np.uint32(24) != 255).any()), 1)
    out.put(0, 3)
    if green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        argb = subtract_green(argb)
    if palette:
        colours = np.unique(argb)
        if len(colours) > 256:
            raise ValueError("a palette has at most 256 colours")
        out.put(1 | PALETTE << 1, 3)
        out.put(len(colours) - 1, 8)
        steps = _argb(*(np.diff(c, prepend=0) for c in _channels(colours)))
        _put_pixels(out, steps[None, :], main=False)
        argb = apply_palette(argb, colours)
    for kind, given, transform in ((PREDICTOR, predictor, predict), (CROSS_COLOUR, cross, cross_colour)):
        if given is not None:
            _put_tiles(out, kind, *given)
            argb = transform(argb, *given)
    out.put(0, 1)
    body = _put_pixels(out, argb, cache_bits, groups)
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


# ---------------------------------------------------------------------------------- DataFrames


def padded(text: str) -> bytes:
    body = text.encode()
    return body + bytes([PAD]) * (-len(body) % UNIT or (0 if body else UNIT))


def _bits(samples: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Bits that a prefix code takes for samples (which stand so often), about."""
    counts = np.bincount(samples) if counts is None else counts
    counts = counts[counts > 1].astype(np.float64)
    return samples.size * math.log2(max(1, samples.size)) - float(counts @ np.log2(counts))


def _predictor(grey: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Modes by tile, from the left or from above, whichever leaves less, if what is left may be coded in fewer bits."""
    flat = grey.ravel()
    steps = (1, WIDTH) if len(grey) > 1 else (1,)
    most = GAIN * _bits(flat, counts) / len(flat)
    if all(_bits(flat[step:] - flat[:-step]) / (len(flat) - step) > most for step in steps):
        return None
    left, top = np.diff(grey, axis=1, prepend=grey[:, :1]), np.diff(grey, axis=0, prepend=grey[:1])
    size = [np.abs(d.view(np.int8).astype(np.int32)) for d in (left, top)]
    for axis in (0, 1):
        size = [np.add.reduceat(d, np.arange(0, grey.shape[axis], 1 << TILE), axis) for d in size]
    return np.uint32(BLACK) | np.where(size[0] <= size[1], np.uint32(1), np.uint32(2)) << np.uint32(8), TILE


def _groups(grey: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Prefix codes of their own for the upper and the lower half, if that may take fewer bits."""
    rows = _tiles(grey.shape[0], TILE)
    middle = rows // 2 << TILE
    if not middle or _bits(grey[:middle].ravel()) + _bits(grey[middle:].ravel()) > GAIN * _bits(grey.ravel()):
        return None
    return np.repeat((np.arange(rows) >= rows // 2).astype(np.int64)[:, None], _tiles(grey.shape[1], TILE), 1), TILE


def pages_of(payload: bytes) -> list[bytes]:
    """A payload of whole rows as grey pictures; those of few different bytes have a palette.

    Of the others each is written once more with a predictor or two groups of prefix codes where the entropy of its samples
    speaks for these, and the shortest file stays.  A grey pixel less its green is its green: colours have nothing to
    cross with, and a cached colour is a symbol beside the green one that means the same.
    """
    pages = []
    for at in range(0, len(payload), WIDTH * ROWS):
        grey = np.frombuffer(payload[at : at + WIDTH * ROWS], np.uint8).reshape(-1, WIDTH)
        argb = np.uint32(BLACK) | grey.astype(np.uint32) * np.uint32(0x010101)
        counts = np.bincount(grey.ravel())
        few = np.count_nonzero(counts) <= 16
        ways: list[dict] = [{"palette": few}]
        if not few and (modes := _predictor(grey, counts)) is not None:
            ways.append({"predictor": modes})
        if not few and (groups := _groups(grey)) is not None:
            ways.append({"groups": groups})
        pages.append(min((encode(argb, green=True, **way) for way in ways), key=len))
    return pages


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, pages (array of files) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            texts = part.column(1).to_pylist()
            made = [pages_of(padded(t)) for t in texts]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(made, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "pages"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, pages array<binary>")


def decoded(pictures: DataFrame, key: str = "id", file: str = "file") -> DataFrame:
    """key, width, height, transforms, pixels array<int> (ARGB by rows) of a column of files."""
    kind = dict(pictures.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            found = [None if f is None else decode(f) for f in part.column(1).to_pylist()]
            columns = [
                pa.array([p and p.pixels.shape[1] for p in found], pa.int32()),
                pa.array([p and p.pixels.shape[0] for p in found], pa.int32()),
                pa.array([p and p.transforms for p in found], pa.list_(pa.string())),
                pa.array([None if p is None else p.pixels.ravel().view(np.int32) for p in found], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, "width", "height", "transforms", "pixels"])

    return pictures.select(key, file).mapInArrow(run, f"{key} {kind}, width int, height int, transforms array<string>, pixels array<int>")


def samples(pages: list[bytes]) -> Iterator[np.ndarray]:
    """8-bit samples of grey pages, page by page."""
    for page in pages:
        yield (decode(page).pixels.ravel() & np.uint32(255)).astype(np.uint8)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """What stored pages hold: digests, and as feature the number of pages, of different samples and of equal neighbours, and the mean."""

    def row(doc_id: int | None, n_bytes: int, pages: list[bytes]) -> tuple:
        whole, tail, size, counts, equal = hashlib.sha256(), b"", 0, np.zeros(256, np.int64), 0
        for part in samples(pages):
            whole.update(part)
            tail, size = part[-32:].tobytes(), size + len(part)  # pages are rows of 576 bytes and more
            counts += np.bincount(part, minlength=256)
            equal += int((part[1:] == part[:-1]).sum())
        mean = int(counts @ np.arange(256)) * 1000 // size
        feature = f"{len(pages)}:{np.count_nonzero(counts)}:{equal}:{mean}"
        return doc_id, n_bytes, size, whole.hexdigest(), zlib.crc32(tail), sum(map(len, pages)), hashlib.sha256(b"".join(pages)).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FEATURES.split(", ")]
        types = [pa.string() if x.endswith("string") else pa.int64() for x in _FEATURES.split(", ")]
        for part in slices(batches, 64):
            rows = [row(*r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return media.mapInArrow(run, _FEATURES)


def op12_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = Stage(stored(table(spark, sf_dir, "documents")), "media", "none")  # pictures are compressed already
    return features(media.df)
