"""Winnowing fingerprints.

Hashes of all k-grams of code points are taken; of every window of w consecutive hashes the
smallest is selected, the rightmost one among equal ones; selected hashes keep their
positions.  Two texts that share a substring of at least w + k - 1 code points share a
selected hash.

Defined cases: a text shorter than k is one gram; with fewer than w grams the whole text is one
window; null and empty texts have no hashes, and their likeness is 1 with each other and 0 with
any other text.  Equal texts have equal fingerprints.  Very long texts are walked like any others;
repeated rows are documents of their own; an empty table gives an empty one.  In op3, rows of one doc_id are ordered by
text, and rows without doc_id come after all others; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import doc_texts, slices, table

#: Texts that share K + WINDOW - 1 = 23 code points share a hash.
K, WINDOW = 16, 8
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW32 = np.uint64(0xFFFFFFFF)


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """32-bit polynomial hashes of all k-grams; a gram of 2m points is joined from two of m."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    k = min(k, len(points))
    if not k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        points = (points + np.uint64(1)) * _MIX
        # the bits of k, from the highest: h holds the hashes of all grams of `size` points
        h, size, power = points, 1, _BASE
        for bit in bin(k)[3:]:
            h = h[: len(h) - size] * power + h[size:]
            size, power = size * 2, power * power
            if bit == "1":
                h = h[: len(points) - size] * _BASE + points[size:]
                size, power = size + 1, power * _BASE
        h = (h ^ (h >> np.uint64(29))) * _MIX
    return h >> np.uint64(32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes (uint32) and their positions (code points), by position."""
    h = gram_hashes(text, k)
    if not len(h):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    # hash in the upper half, distance from the end in the lower: among equal hashes the rightmost is least
    best = (h << np.uint64(32)) | (_LOW32 - np.arange(len(h), dtype=np.uint64))
    window, size = min(window, len(h)), 1
    while size < window:
        step = min(size, window - size)
        best = np.minimum(best[:-step], best[step:])
        size += step
    best = best[np.concatenate(([True], best[1:] != best[:-1]))]
    return (best >> np.uint64(32)).astype(np.uint32), (_LOW32 - (best & _LOW32)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the sets of selected hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_hex(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes array<long>, positions array<long> of every text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [winnow(t, k, window) for t in part.column(1).to_pylist()]
            columns = [pa.array([x[i].astype(np.int64) for x in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "hashes", "positions"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def _block_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of the range that doc_id is in, by descending doc_id; rows without one are in the last."""

    @F.pandas_udf("int")
    def block(ids):  # noqa: ANN001
        found = len(bounds) - np.searchsorted(np.array(bounds, dtype=np.int64), ids.fillna(0).to_numpy(dtype=np.int64), side="right")
        found[ids.isna().to_numpy()] = len(bounds)
        return type(ids)(found.astype("int32"))

    return block(doc_id) if bounds else F.lit(0)


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every document in runs of descending doc_id, each run ended by the document after it.

    Columns block, role, doc_id, text; one shuffle of the texts.  Rows of a block are together
    and in order; role 1 marks the row that only serves as the next one of its block's last.
    The ends of the blocks are one id each, so that only they come to the driver.
    """
    spark = docs.sparkSession
    rows = doc_texts(docs)
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / blocks for i in range(1, blocks)]
    ids = rows.select("doc_id").where("doc_id is not null")
    cuts = ids.approxQuantile("doc_id", steps, 0.25 / blocks) if steps else []
    bounds = sorted({int(x) for x in cuts})
    placed = rows.withColumn("block", _block_of(F.col("doc_id"), bounds))
    heads = {r.block: r.head for r in placed.groupBy("block").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first block's head ends the last block
    joint = spark.createDataFrame([(int(heads[b]) if heads[b] is not None else None, int(before[b])) for b in order], "head long, before int")
    firsts = (
        rows.join(F.broadcast(joint), F.col("doc_id").eqNullSafe(F.col("head")))  # a row per block
        .groupBy("head", "before")
        .agg(F.min("text").alias("text"))
        .select(F.col("head").alias("doc_id"), "text", F.col("before").alias("block"), F.lit(1).alias("role"))
    )
    both = placed.withColumn("role", F.lit(0)).unionByName(firsts)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return both.repartition(n, "block").sortWithinPartitions("block", "role", F.col("doc_id").desc_nulls_last(), "text").select("block", "role", "doc_id", "text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>, edited_positions array<int>"


def compare_with_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; columns as op3 returns them.

    The positions (code points) of the selected hashes are those of `positions` and `edited_positions`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OUT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        last = None  # block, role, doc_id, text, hashes and their positions of the row before
        for part in slices(batches, 128):
            out: list[tuple] = []
            for block, role, doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                row = (block, role, doc_id, text, *winnow(text, k, window))
                if last is not None and last[0] == block:
                    out.append(_compared(last, row, k, window))
                last = row
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return with_next(docs).mapInArrow(run, _OUT)


def _compared(row: tuple, after: tuple, k: int, window: int) -> tuple:
    _, _, doc_id, text, own, at = row
    swap = len(text) // 3
    edited = text[: len(text) - swap] + after[3][:swap]
    other, places = winnow(edited, k, window)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return doc_id, len(text), digest, as_hex(own), as_hex(other), likeness(own, other), likeness(own, after[4]), at.astype(np.int32), places.astype(np.int32)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
