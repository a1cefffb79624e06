"""N-gram Jaccard join by prefixes under several global token orders.

A document is its set of word shingles.  If two sets' Jaccard similarity is at least t, then
under any order of all shingles they share one among the first n - ceil(t * n) + 1 of each.
Three orders are used.  All put shingles that many documents hold last (by counts of a sketch over
all documents, in powers of two), and differ in how they order the rest.  The first one puts shingles of
rare words first (by counts of a sketch of words), as the sketch of shingles tells little of rare ones once it
is full.  Sets that share a prefix token of the first order are candidates; of these only the ones stay whose
parity bitmaps differ in no more bits than the sets may, and then, as whole sets, those that also share prefix
tokens under the second and third order; the rest are verified.  Every filter is exact: no link is lost.

Equal sets are one class before candidates are sought.  A prefix token of more than POSTING
classes makes no pairs.  Classes that have such tokens are dealt into tiles (by a token that most
classes have, by size, by hash); two tiles that share tokens are compared once, whatever
number of them they share.  A task applies the three orders and verifies all pairs of two tiles by products of incidence matrices; it returns
how many documents each class links with, and links enough to join what is joined.

Defined cases: null and empty texts and texts without words have an empty set and link with
nothing; with fewer words than a shingle the whole sequence is one; repeated rows are one class;
rows without doc_id join classes but name no component (a component of such rows has the id
null); very long texts are sets like any other, in tiles of few classes; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import KEPT, Stage, arrow_rows, doc_texts, free_shuffles, slices, table
from pairwright.llm.graph import connected_components

#: The sketch has 16 counters a row of the table, between these powers of two (one byte each is broadcast).
LEAST_BITS, MOST_BITS = 16, 24
#: Counters of the sketch of words, as a power of two, and steps of a word's count for each doubling of it.
WORD_BITS, WORD_STEPS = 22, 2
#: Counters of one row of the sketch; classes of a token that is joined by pairs; classes and hashes of a tile, about.
SEGMENT, POSTING, TILE, TILE_HASHES = 1 << 16, 64, 256, 1 << 20
#: Classes whose documents are found again by a table of flags; more are found by a join.
FLAGGED = 1 << 21
#: Rows, each with up to two whole sets, that a worker is handed at once; cells of a matrix.
BATCH_ROWS, CELLS = 512, 1 << 22
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x2545F4914F6CDD1D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _free() -> bool:
    some = bool(_POWERS)
    _POWERS.clear()
    return some


KEPT["ngrams"] = _free


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        pair = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps))
        _POWERS[size] = tuple(pair)
    return _POWERS[size]


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * by
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts in order, and the number of the text that it is in.

    Prefix sums over the bytes give the polynomial hash of each word at once.
    """
    coded = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join([*coded, b""]), np.uint8)]
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _powers(len(data) + 1)
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * down[: len(data)])))
    h = (total[end] - total[start]) * up[end]
    h = _mix(h + (end - start).astype(np.uint64) * _M[2], _M[0])
    ends = np.cumsum([len(c) + 1 for c in coded])
    return h, np.searchsorted(ends, start, side="right")


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Distinct shingle hashes (uint64, ascending) of each text."""
    return [s for s, _ in _shingles(*word_hashes(texts), len(texts), k)]


def rated_sets(texts: list[str], k: int, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same, each with how frequent its shingles' words are together; words: steps of each counter of words."""
    h, owner = word_hashes(texts)
    steps = np.concatenate((np.zeros(1, np.uint64), np.cumsum(level_of(h, words))))
    rates = steps[k:] - steps[:-k] if len(h) >= k else steps[:0]
    out = []
    for s, at in _shingles(h, owner, len(texts), k, places=True):
        out.append((s, np.zeros(len(s), np.uint64) if at is None else rates[at]))
    return out


def _shingles(h: np.ndarray, owner: np.ndarray, n_texts: int, k: int, places: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Distinct shingle hashes of each text, and, if asked for, the number of the word at which each begins (none for texts of fewer words)."""
    counts = np.bincount(owner, minlength=n_texts) if len(h) else np.zeros(n_texts, int)
    first = np.concatenate(([0], np.cumsum(counts)))
    m = max(0, len(h) - k + 1)
    gram = np.zeros(m, np.uint64)
    for i in range(k):
        gram = _mix(gram, _M[1]) + h[i : i + m] * _M[i % 4]
    gram = _mix(gram, _M[3])
    for i, n in enumerate(counts):
        lo = first[i]
        if n >= k and places:
            found, at = np.unique(gram[lo : lo + n - k + 1], return_index=True)
            yield found, at + lo
        elif n >= k:
            yield np.unique(gram[lo : lo + n - k + 1]), None
        elif n:
            whole = np.full(1, n, np.uint64)
            for x in h[lo : lo + n].reshape(-1, 1) * _M[2]:
                whole = _mix(whole, _M[1]) + x
            yield _mix(whole, _M[0]), None
        else:
            yield gram[:0], None


# --------------------------------------------------------------------------------- sketch


def sketch_bits(rows: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, max(1, rows).bit_length() + 4))


_COUNTERS = "segment int, salt int, counts binary"


def merged_counters(rows: DataFrame, bits: int, more: int = 0) -> np.ndarray:
    """Sum of counter arrays given as rows (segment int, salt int, counts binary); more: counters beside the 2 ** bits.

    Its size is the sketch's, whatever the input; a task sums 32 rows a segment, then 32 of these.
    """
    sizes = min(SEGMENT, 1 << bits)

    def add(found: pa.Table) -> pa.Table:
        total = np.zeros(sizes, np.uint32)
        for packed in found.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(packed), np.uint32)
        return found.select(["segment", "salt"]).slice(0, 1).append_column("counts", pa.array([zlib.compress(total, 1)], pa.binary()))

    some = rows.withColumn("salt", F.expr("salt div 32").cast("int")).groupBy("segment", "salt").applyInArrow(add, _COUNTERS)
    some = some.withColumn("salt", F.expr("salt div 32").cast("int")).groupBy("segment", "salt").applyInArrow(add, _COUNTERS)
    full = np.zeros((1 << bits) + more, np.uint32)
    for r in some.groupBy("segment").applyInArrow(add, _COUNTERS).toLocalIterator():
        full[r.segment * sizes : (r.segment + 1) * sizes] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint32)
    return full


def _counter_rows(hashes: Iterator[np.ndarray], bits: int, beside: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A task's counters by segment; segments without a count are left out, and salt is the task's number.

    beside: further counters, which are filled while the hashes are read.
    """
    from pyspark import TaskContext

    counts, waiting, size = np.zeros(1 << bits, np.uint32), [], 0

    def settle() -> None:
        places, n = np.unique(np.concatenate(waiting), return_counts=True)
        counts[places] += n.astype(np.uint32)
        waiting.clear()

    for h in hashes:
        waiting.append((h >> np.uint64(64 - bits)).astype(np.uint32))
        size += len(h)
        if size > 1_000_000:
            settle()
            size = 0
    if waiting:
        settle()
    number, each = TaskContext.get().partitionId(), min(SEGMENT, 1 << bits)
    parts = counts.reshape(-1, each)
    for i, part in enumerate(parts if beside is None else itertools.chain(parts, beside.reshape(-1, each))):
        if part.any():
            columns = [pa.array([i], pa.int32()), pa.array([number], pa.int32()), pa.array([zlib.compress(part, 1)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "salt", "counts"])


def levels(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each counter of shingles how far above the mean it is, in powers of two: 0 for all but frequent shingles;
    for each counter of words the logarithm of its count."""
    bits = sketch_bits(docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << WORD_BITS, np.uint32)

        def sets() -> Iterator[np.ndarray]:
            for part in slices(batches, keep="ngrams"):
                h, owner = word_hashes(part.column(1).to_pylist())
                places, n = np.unique((h >> np.uint64(64 - WORD_BITS)).astype(np.uint32), return_counts=True)
                words[places] += n.astype(np.uint32)
                yield from (s for s, _ in _shingles(h, owner, part.num_rows, k))

        yield from _counter_rows(sets(), bits, words)

    found = merged_counters(doc_texts(docs).mapInArrow(run, _COUNTERS), bits, 1 << WORD_BITS)
    counts, words = found[: 1 << bits], found[1 << bits :]
    level = np.maximum(0, np.floor(np.log2((counts + 1.0) / (2 * counts.mean() + 8))) + 1)
    return level.astype(np.uint8), (WORD_STEPS * np.log2(words + 1.0)).astype(np.uint8)


def level_of(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[(hashes >> np.uint64(65 - len(table).bit_length())).astype(np.int64)].astype(np.uint64)


# --------------------------------------------------------------------------------- filters


def prefix(hashes: np.ndarray, level: np.ndarray, order: int, percent: int, rates: np.ndarray | None = None) -> np.ndarray:
    """The first n - ceil(t * n) + 1 shingles under an order: by level, by rate where rates are given, then by a hash."""
    n = len(hashes)
    size = n + 1 + (-percent * n // 100)
    if size >= n:
        return hashes
    key = (level << np.uint64(56)) | (_mix(hashes, _M[order]) >> np.uint64(8))
    if rates is not None:
        key = (level << np.uint64(56)) | (rates << np.uint64(40)) | (key & np.uint64((1 << 56) - 1)) >> np.uint64(16)
    return hashes[np.argpartition(key, size - 1)[:size]]


def parity(hashes: np.ndarray) -> bytes:
    """Bit h mod L counts the hashes there modulo 2; L is a power of two of at least twice their number."""
    size = min(1 << 15, max(64, 1 << (2 * len(hashes) - 1).bit_length()))
    bits = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two parity maps differ, the longer one folded: at most the sets' symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_link(na: int, nb: int, apart: int, percent: int) -> bool:
    """Whether a symmetric difference of at least `apart` allows percent / 100 of the union in common."""
    # common c = (na + nb - d) / 2, union = (na + nb + d) / 2
    return 100 * (na + nb - apart) >= percent * (na + nb + apart)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


# -------------------------------------------------------------------------------- the join

_DOCS = "doc_id long, tag long, n int, digest binary, prefix array<long>, bits binary"


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, by which rows of one doc_id are told apart."""
    return doc_texts(docs).withColumn("tag", F.xxhash64("text"))


def described(docs: DataFrame, k: int, percent: int, level: np.ndarray, words: np.ndarray) -> DataFrame:
    """Every document's set size, digest, prefix under the first order, and parity map."""
    shared = docs.sparkSession.sparkContext.broadcast((level, words))  # at most 2 ** MOST_BITS + 2 ** WORD_BITS bytes
    names = [x.split()[0] for x in _DOCS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, steps = shared.value
        for part in slices(batches, keep="ngrams"):
            rows: list[tuple] = []
            for doc_id, tag, (s, rates) in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), rated_sets(part.column(1).to_pylist(), k, steps), strict=True):
                if not len(s):
                    rows.append((doc_id, tag, 0, None, None, None))
                    continue
                first = prefix(s, level_of(s, table), 0, percent, rates)
                rows.append((doc_id, tag, len(s), hashlib.md5(s.tobytes(), usedforsecurity=False).digest(), first.view(np.int64), parity(s)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return tagged(docs).mapInArrow(run, _DOCS)


def _joined_sides(pairs: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the columns of both classes as x_ and y_ ones."""
    out = pairs
    for key, side in (("a", "x"), ("b", "y")):
        known = classes.select(F.col("class").alias(key), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        out = out.join(known, key)
    return out.select("a", "b", *(f"{side}_{c}" for side in "xy" for c in columns))


def filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the parity maps let through.

    Pairs that share a token of many classes are left to the tiles.
    """

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            rows = zip(*(c.to_pylist() for c in part.columns), strict=True)
            yield _pairs([(a, b) for a, b, na, p, nb, q in rows if may_link(na, nb, bits_apart(p, q), percent)])

    near = _joined_sides(pairs, classes, "n", "bits").mapInArrow(by_bits, "a long, b long")
    sides = _joined_sides(near, classes, "hot")
    return sides.where(~F.coalesce(F.arrays_overlap("x_hot", "y_hot"), F.lit(False))).select("a", "b")


def _pairs(kept: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])


def whole_sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """class, hashes (binary) of the classes needed (class).

    Only documents whose id may be a needed one are shingled again: by a table of flags that grows
    with the classes needed, or, where they are very many, by a join that brings texts and ids together.
    """
    ids = classes.join(needed, "class").select("class", "digest", "least_id", F.coalesce(F.xxhash64("least_id"), F.lit(0)).alias("h"))
    texts = doc_texts(docs).withColumn("h", F.coalesce(F.xxhash64("doc_id"), F.lit(0)))
    number = needed.count()
    flags = None
    if number <= FLAGGED:
        bits = sketch_bits(number)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _counter_rows((b.column(0).to_numpy().view(np.uint64) for b in batches), bits)

        flags = docs.sparkSession.sparkContext.broadcast(merged_counters(ids.select("h").mapInArrow(mark, _COUNTERS), bits) > 0)
    else:
        texts = texts.join(ids.select("h").distinct(), "h", "left_semi").select("doc_id", "text", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, keep="ngrams"):
            chosen = part.column(1)
            if flags is not None:
                h = part.column(2).to_numpy().view(np.uint64)
                chosen = chosen.filter(pa.array(level_of(h, flags.value) > 0))
            sets = shingle_sets(chosen.to_pylist(), k)
            rows = [(hashlib.md5(s.tobytes(), usedforsecurity=False).digest(), s.tobytes()) for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["digest", "hashes"])

    found = texts.mapInArrow(run, "digest binary, hashes binary")
    return found.join(ids.select("class", "digest"), "digest").groupBy("class").agg(F.first("hashes").alias("hashes"))


def share_prefixes(a: np.ndarray, b: np.ndarray, level: np.ndarray, percent: int) -> bool:
    """Whether two sets share prefix tokens under the second and third order."""
    of_a, of_b = level_of(a, level), level_of(b, level)
    return all(len(np.intersect1d(prefix(a, of_a, j, percent), prefix(b, of_b, j, percent), assume_unique=True)) > 0 for j in (1, 2))


def verified(pairs: DataFrame, sets: DataFrame, level: np.ndarray, percent: int) -> DataFrame:
    """a, b, and the documents that each of them is linked with by this pair."""
    shared = pairs.sparkSession.sparkContext.broadcast(level)
    x, y = (sets.select(F.col("class").alias(c), F.col("hashes").alias(h), F.col("weight").alias(f"w{h}")) for c, h in (("a", "x"), ("b", "y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sides = [(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)]
            keep = [share_prefixes(p, q, shared.value, percent) and linked(p, q, percent) for p, q in sides]
            yield part.select(["a", "b", "wx", "wy"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "wx", "wy", "x", "y").mapInArrow(run, "a long, b long, wx long, wy long")


def tiles(large: DataFrame, percent: int, tile: int, hashes: int) -> tuple[DataFrame, DataFrame]:
    """From tokens of many classes (token, class, n, m): each class's tokens and tile (class, hot,
    tile), and to which pairs of tiles it is sent (t1, t2, class).

    A tile's classes have a token in common, one of those with the most classes; of two tiles that
    share a token all classes are sent, unless their sizes are too far apart.
    """
    top = large.groupBy("class").agg(F.max(F.struct(F.floor(F.log2("m")), "token")).alias("top"), F.first("n").alias("n"), F.sort_array(F.collect_list("token")).alias("hot"))
    banded = top.select("class", "n", "hot", F.col("top.token").alias("home"), F.floor(F.log2("n")).cast("int").alias("band"))
    cells = banded.groupBy("home", "band").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / hashes)).cast("long").alias("parts"))
    number = F.xxhash64("home", "band", F.pmod(F.xxhash64("class"), F.col("parts")))
    of_class = Stage(banded.join(cells, ["home", "band"]).select("class", "n", "hot", number.alias("tile")), "ngram-tiles").df
    held = of_class.select("tile", "n", F.explode("hot").alias("token")).groupBy("token", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = held.alias("x"), held.alias("y")
    near = (100 * F.col("x.hi") >= percent * F.col("y.lo")) & (100 * F.col("y.hi") >= percent * F.col("x.lo"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.tile") <= F.col("y.tile")) & near).select(F.col("x.tile").alias("t1"), F.col("y.tile").alias("t2")).distinct()
    sides = met.withColumn("tile", F.explode(F.when(F.col("t1") == F.col("t2"), F.array("t1")).otherwise(F.array("t1", "t2"))))
    return of_class.select("class", "hot", "tile"), sides.join(of_class.select("class", "tile"), "tile").select("t1", "t2", "class")


def in_common(rows: list[np.ndarray]) -> np.ndarray:
    """How many values each two rows (distinct values each) share, by products of incidence matrices.

    Only values of two rows or more are columns; they are taken so many at a time that a matrix has at most CELLS cells.
    """
    n = len(rows)
    kind = np.float32 if max(map(len, rows), default=0) < 1 << 24 else np.float64  # counts are exact in it
    total = np.zeros((n, n), kind)
    values = np.concatenate([*rows, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    keep = (np.bincount(column, minlength=1) > 1)[column] if len(values) else new
    owner, column = owner[keep], np.cumsum(new[keep]) - 1
    width = max(64, CELLS // max(1, n))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (first, first + width))
        cells = np.zeros((n, min(width, int(column[-1]) + 1 - first)), kind)
        cells[owner[lo:hi], column[lo:hi] - first] = 1
        total += cells @ cells.T
    return total


def spanning(near: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what `near` joins."""
    edges, new = [], np.ones(len(ids), bool)
    for start in np.flatnonzero(near.any(axis=1)):
        if not new[start]:
            continue
        new[start], front = False, [start]
        while front:
            i = front.pop()
            for j in np.flatnonzero(near[i] & new):
                new[j] = False
                edges.append((int(ids[i]), int(ids[j])))
                front.append(j)
    return edges


def tile_links(sent: DataFrame, sets: DataFrame, level: np.ndarray, percent: int) -> DataFrame:
    """Of each pair of tiles: edges (a, b, links null) that join what is linked, and for every class
    a the documents that it links with there (a, b null, links)."""
    shared = sets.sparkSession.sparkContext.broadcast(level)

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        t1, t2 = (x.as_py() for x in key)
        tile, ids = rows.column("tile").to_numpy(), rows.column("class").to_numpy()
        weight, first = rows.column("weight").to_numpy(), tile == t1
        near = np.ones((len(ids), len(ids)), bool) if t1 == t2 else first[:, None] != first[None, :]
        np.fill_diagonal(near, False)
        own = [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()]
        size = np.array([len(s) for s in own], np.int64)
        near &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
        if near.any():
            near &= in_common([np.array(h, np.int64).view(np.uint64) for h in rows.column("hot").to_pylist()]) > 0
        for order in (1, 2):
            if near.any():
                near &= in_common([prefix(s, level_of(s, shared.value), order, percent) for s in own]) > 0
        if near.any():
            common = in_common(own).astype(np.int64)
            near &= 100 * common >= percent * (size[:, None] + size[None, :] - common)
        edges = spanning(near, ids)
        links = near @ weight
        some = np.flatnonzero(links)
        a = np.concatenate((np.array([e[0] for e in edges], np.int64), ids[some]))
        b = pa.array([*(e[1] for e in edges), *[None] * len(some)], pa.int64())
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "links": pa.array([*[None] * len(edges), *links[some].tolist()], pa.int64())})

    return sent.join(sets, "class").groupBy("t1", "t2").applyInArrow(compare, "a long, b long, links long")


def components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of docs: the least doc_id that links
    lead to, and how many other rows are linked with the row itself.

    percent: least Jaccard similarity of a link, in hundredths.  Further columns: tag, a hash of
    the text, and node, a number that the rows of a component share (null for an empty set).
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _components(docs, k, percent)


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    level, words = levels(docs, k)
    wide = Stage(described(docs, k, percent, level, words), "ngram-docs")
    parts = ["n", "prefix", "bits"]
    grouped = wide.df.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("weight"), F.first(F.struct(*parts)).alias("s"))
    classes = Stage(grouped.select(F.monotonically_increasing_id().alias("class"), "digest", "least_id", "weight", "s.*"), "ngram-classes")
    every = Stage(wide.df.select("doc_id", "tag", "n", "digest"), "ngram-ids").df
    wide.drop()  # prefixes and maps are with the classes now
    free_shuffles(spark)
    postings = classes.df.select("class", "n", F.explode("prefix").alias("token"))
    often = postings.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    meets = Stage(postings.join(often, "token"), "ngram-postings")
    free_shuffles(spark)
    of_class, sent = tiles(meets.df.where(F.col("m") > POSTING), percent, TILE, TILE_HASHES)
    small = meets.df.where(F.col("m") <= POSTING)
    x, y = small.alias("x"), small.alias("y")
    lesser = F.struct("x.n", "x.class") < F.struct("y.n", "y.class")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & lesser & (100 * F.col("x.n") >= percent * F.col("y.n")))
    pairs = pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    with_hot = classes.df.join(of_class.select("class", "hot"), "class", "left")
    kept = Stage(filtered(pairs, with_hot, percent), "ngram-pairs")
    sent = Stage(sent, "ngram-sent")
    meets.drop()
    free_shuffles(spark)
    needed = kept.df.select(F.col("a").alias("class")).unionByName(kept.df.select(F.col("b").alias("class"))).unionByName(sent.df.select("class")).distinct()
    needed = Stage(needed, "ngram-needed")
    whole = Stage(whole_sets(docs, classes.df, needed.df, k).join(classes.df.select("class", "weight"), "class"), "ngram-sets")
    free_shuffles(spark)
    met = Stage(verified(kept.df, whole.df, level, percent), "ngram-links")
    dealt = Stage(tile_links(sent.df, whole.df.join(of_class, "class"), level, percent), "ngram-tile-links")
    for stage in (kept, sent, needed, whole):
        stage.drop()
    free_shuffles(spark)
    links = connected_components(met.df.select("a", "b").unionByName(dealt.df.where("b is not null").select("a", "b")))
    counts = met.df.select(F.col("a").alias("class"), F.col("wy").alias("links")).unionByName(met.df.select(F.col("b").alias("class"), F.col("wx").alias("links")))
    counts = counts.unionByName(dealt.df.where("b is null").select(F.col("a").alias("class"), "links")).groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.df.select("class", "digest", "least_id", "weight").join(links.withColumnRenamed("node", "class"), "class", "left").join(counts, "class", "left")
    known = known.select("digest", "least_id", F.coalesce("component", "class").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    known = Stage(known, "ngram-components").df
    for stage in (met, dealt, classes):
        stage.drop()
    free_shuffles(spark)
    least = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = known.join(least, "component").select("digest", "component_id", F.col("component").alias("node"), "links")
    found = every.select("doc_id", "tag", "n", "digest").join(named, "digest", "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component_id.alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "tag", "node")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but for all documents of a component after its first (by doc_id, then by text hash).

    All columns stay.  Documents without words stay; of rows that agree in doc_id and text the one with the least
    hash of all its columns stays.
    """
    found = Stage(components(docs, k, percent).select("doc_id", "tag", "node"), "ngram-decisions").df
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")
    first = found.where("node is not null").groupBy("node").agg(F.min(place).alias("p")).select("p.doc_id", "p.tag")
    stay = first.unionByName(found.where("node is null").select("doc_id", "tag")).distinct().select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"))
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(F.col("doc_id").cast("long").alias("_k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_k2"), F.struct(*(F.col(f"`{c}`").alias(names[c]) for c in docs.columns)).alias("_row"))
    kept = rows.join(stay, F.col("_k1").eqNullSafe(F.col("_d")) & (F.col("_k2") == F.col("_t")), "left_semi")
    if not found.groupBy("doc_id", "tag").count().where("count > 1").isEmpty():
        kept = kept.groupBy("_k1", "_k2").agg(F.min_by("_row", F.struct(F.xxhash64(F.to_json("_row")), F.to_json("_row"))).alias("_row"))
    return kept.select(*(F.col(f"_row.{names[c]}").alias(c) for c in docs.columns))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      ELSE [array_to_string(w, ' ')] END) AS g FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS component_id, coalesce(l.n, 0) AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM both_ways GROUP BY a) l USING (doc_id)
"""
