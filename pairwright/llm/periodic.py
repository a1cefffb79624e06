"""Runs of repeated words, by Karp, Miller and Rosenberg's naming of power-of-two blocks.

A run is a stretch of consecutive words with smallest period q, at least max(6, 4 q) words long,
that no neighbouring word extends keeping that period.  Blocks of 2**j words get names, equal
for equal blocks: a name of level j + 1 is that of a pair of names of level j.  How far two places
agree follows from the names, from the highest level down.  In a run of period q, words q
apart are equal over 3 q places at least, so one of the first q of these is a multiple of q from which 2 q words and
more agree: such grid places are tried for each q, and those whose names agree are extended both
ways.  No hashes of blocks, no suffix sorting.

Texts of a slice are named together, each ended by a name of its own, so that no run crosses texts.

Defined cases: words are runs of characters other than blank, tab and line ends (9 to 13); null, empty
and blank texts have no words and no runs; a stretch that has several periods is one run, of the
smallest; very long texts are named as a whole; repeated rows give repeated results; rows
without doc_id are kept as they are; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import doc_texts, slices, table

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_PERIODS = 6, 4

_OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def names_of(first: np.ndarray) -> list[np.ndarray]:
    """names[j][i] stands for the 2**j words from i on; the last level is one before all names differ."""
    levels, size = [first], 1
    counts = np.bincount(first)
    repeated = counts[first] > 1
    while len(levels[-1]) > size:
        now = levels[-1]
        again = np.flatnonzero(repeated[:-size] & repeated[size:])  # a block with a part that stands once stands once
        found, kinds, counts = np.unique(now[again].astype(np.int64) << 32 | now[again + size], return_inverse=True, return_counts=True)
        if not len(found) or counts.max() == 1:
            break
        names = np.arange(len(found), len(found) + len(now) - size, dtype=np.int32)
        names[again] = kinds
        repeated = np.zeros(len(names), bool)
        repeated[again] = counts[kinds] > 1
        levels.append(names)
        size *= 2
    return levels


def agree_after(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words are equal from i and from j > i on."""
    length = np.zeros(len(i), np.int64)
    for level in reversed(range(len(levels))):
        names = levels[level]
        fits = np.flatnonzero(j + length < len(names))
        same = fits[names[(i + length)[fits]] == names[(j + length)[fits]]]
        length[same] += 1 << level
    return length


def agree_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words are equal just before i and just before j > i, going back."""
    length = np.zeros(len(i), np.int64)
    for level in reversed(range(len(levels))):
        size = 1 << level
        fits = np.flatnonzero(i - length >= size)
        a, b = (i - length)[fits] - size, (j - length)[fits] - size
        same = fits[levels[level][a] == levels[level][b]]
        length[same] += size
    return length


def runs_in(first: np.ndarray, longest: int) -> np.ndarray:
    """start, length, period of all runs in a sequence of names, by start and then period; a text has at most `longest` words."""
    levels = names_of(first)
    places, periods = [], []
    for q in range(1, longest // LEAST_PERIODS + 1):
        level = q.bit_length()  # 2**level is over q and at most 2 q
        if level >= len(levels):
            break
        names = levels[level]
        grid = names[::q]
        hits = np.flatnonzero(grid[:-1] == grid[1:])
        if len(hits):
            hits = hits[np.append(True, np.diff(hits) != 1)]  # the first of neighbours, which are in one run
            places.append(hits * q)
            periods.append(np.full(len(hits), q))
    if not places:
        return np.empty((0, 3), np.int64)
    at, q = np.concatenate(places), np.concatenate(periods)
    start = at - agree_before(levels, at, at + q)
    length = at + q + agree_after(levels, at, at + q) - start
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    rows = np.stack((start, length, q), 1)[long]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch that has several periods is found with each of them; the least one counts
    rows = rows[np.append(True, (np.diff(rows[:, :2], axis=0) != 0).any(1))] if len(rows) else rows
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[list[str]]) -> list[np.ndarray]:
    """Runs of each list of words."""
    sizes = np.array([len(words) for words in texts], np.int64)
    if not sizes.sum():
        return [np.empty((0, 3), np.int64)] * len(texts)
    codes = pa.array([w for words in texts for w in words], pa.large_string()).dictionary_encode()
    ends = np.cumsum(sizes + 1) - 1  # places of the names that end texts
    first = np.empty(ends[-1] + 1, np.int32)
    first[ends] = len(codes.dictionary) + np.arange(len(texts))
    inside = np.ones(len(first), bool)
    inside[ends] = False
    first[inside] = codes.indices.to_numpy()
    rows = runs_in(first, int(sizes.max()))
    cuts = np.searchsorted(rows[:, 0], ends)
    rows[:, 0] -= np.repeat(np.append(0, ends[:-1] + 1), np.diff(np.append(0, cuts)))
    return np.split(rows, cuts[:-1])


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words joined by one blank, but for those that a run holds after its first period."""
    if not len(runs):
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return " ".join([w for w, inside in zip(words, np.cumsum(change), strict=False) if not inside])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period; word numbers from 0) and the text without what runs repeat; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for part in slices(batches):
            texts = [word.findall(t) for t in part.column(1).to_pylist()]
            found = runs_of(texts)
            columns = [
                pa.array([len(words) for words in texts], pa.int64()),
                pa.array([[tuple(r) for r in rows.tolist()] for rows in found], _RUNS),
                pa.array([collapsed(words, rows) for words, rows in zip(texts, found, strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_words", "runs", "collapsed"])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, _OUT)


def with_cycles(docs: DataFrame) -> DataFrame:
    """doc_id, text: of every tenth document by the checksum of its id, the words from some place on go around in a cycle."""
    rows = doc_texts(docs).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words, g = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.floor(F.col("h") / 10)

    def cycled(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # the words are a column of their own first, so that they are found once a text; only where they are needed
    held = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    return held.select("doc_id", F.when(F.size("w") > 0, cycled(F.col("w"))).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_cycles(table(spark, sf_dir, "documents")))
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] > b["length"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", "runs", best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
        F.floor(F.lit(1000) * F.col("b.length") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
