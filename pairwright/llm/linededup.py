"""Removal of passages that repeat, by hashing sentences within lines.

A text is cut into pieces: after every line end, and after the blanks that follow a full stop,
exclamation or question mark.  A piece with words is a unit.  A unit is normalised (words
joined by one space, A-Z in lower case) and hashed; digests are grouped over all documents, and
of each the occurrence that comes first by (doc_id, place) is kept.  Every other one is a
repeat, whether its first occurrence is in another document or in its own.  Repeats that follow
one another are one passage, and a passage of at least min_words words is removed; shorter
ones stay, so that a heading, a signature or a short sentence that two texts have by chance is
left alone.  What was removed is told by offsets (code points) in the original text: the
text is what it was but for these spans.  A span ends with its last piece, blanks and line end
included; but if it begins inside a line, that line's end stays.

Defined cases: null and empty texts have no units and stay as they are; pieces without words are no
units, do not end a passage, and go with one only inside it; very long texts are cut like any other;
rows that agree in doc_id and text are the same document and get the same result; rows without
doc_id rank before all others (and among rows of one doc_id the text's hash decides); an empty table
gives an empty one; other columns are handed on, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import Stage, slices, table

MIN_WORDS = 25
#: Marks after which a piece may end; only those that are a line end or have blanks after them count.
ENDS = re.compile(r"\n|[.!?][\x20\x09\x0B-\x0D]+")
#: A digest with at least a HOT-th part of all repeated units is joined by broadcast; there are at most HOT of them.
HOT = 20_000

_UNITS = "k1 long, k2 long, unit int, d1 long, d2 long"


def pieces(text: str) -> list[tuple[int, int, list[bytes]]]:
    """start, end (code points) and normalised words of every piece; the pieces together are the text."""
    found, at = [], 0
    for m in ENDS.finditer(text):
        found.append((at, m.end(), text[at : m.end()].encode().lower().split()))
        at = m.end()
    if at < len(text):
        found.append((at, len(text), text[at:].encode().lower().split()))
    return found


def digest(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest()


def units(docs: DataFrame) -> DataFrame:
    """Every unit of docs (k1, k2, text): its number in the text and its digest, as two numbers."""
    names = [x.split()[0] for x in _UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            digests, counts = [], []
            for text in part.column(2).to_pylist():
                own = [digest(words) for _, _, words in pieces(text) if words]
                digests.extend(own)
                counts.append(len(own))
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            n = np.array(counts, np.int64)
            number = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
            keys = [np.repeat(part.column(i).to_numpy(), n) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(number, pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=names)

    return docs.select("k1", "k2", "text").mapInArrow(run, _UNITS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with k1, k2: doc_id (the least long where null) and a hash of the text."""
    return docs.withColumns({"_text": F.coalesce("text", F.lit("")), "k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))}).withColumn("k2", F.xxhash64("_text"))


def repeats(found: DataFrame) -> tuple[DataFrame, Stage]:
    """Of staged units those that are not the first of their digest (k1, k2, unit), and the stage that they are read from."""
    place = F.struct("k1", "unit", "k2")
    groups = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    many = Stage(groups.where("n > 1"), "repeated-units")
    total = many.df.agg(F.sum("n")).first()[0] or 0
    edge = max(1_000, -(-total // HOT))
    hot, rest = many.df.where(F.col("n") >= edge).select("d1", "d2", "first"), many.df.where(F.col("n") < edge).select("d1", "d2", "first")
    known = F.broadcast(hot)  # at most HOT rows; no digest of the rest has more rows than a task's share
    of_hot = found.join(known, ["d1", "d2"])
    of_rest = found.join(F.broadcast(hot.select("d1", "d2")), ["d1", "d2"], "left_anti").join(rest, ["d1", "d2"])
    return of_hot.unionByName(of_rest).where(place != F.col("first")).select("k1", "k2", "unit"), many


def passages(text: str, repeated: list[int], min_words: int = MIN_WORDS) -> tuple[list[tuple[int, int]], int]:
    """Spans of text that its repeated units make up, and how many units are in them."""
    again, spans, removed = set(repeated), [], 0
    run: list[int] = []  # start, end, words, units, whether it begins a line
    number, line_start = 0, True

    def close() -> None:
        nonlocal removed
        if run and run[2] >= min_words:
            start, end = run[:2]
            spans.append((start, end - 1 if not run[4] and text[end - 1] == "\n" else end))
            removed += run[3]
        run.clear()

    for start, end, words in pieces(text):
        if words:
            if number not in again:
                close()
            elif run:
                run[1:4] = end, run[2] + len(words), run[3] + 1
            else:
                run[:] = start, end, len(words), 1, line_start
            number += 1
        line_start = text[end - 1] == "\n"
    close()
    return spans, removed


def without(text: str, removed: list[tuple[int, int]]) -> str:
    """text without its spans."""
    out, at = [], 0
    for start, end in removed:
        out.append(text[at:start])
        at = end
    out.append(text[at:])
    return "".join(out)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs, their text without repeated passages, with the columns
    removed array<struct<start,end>> and n_removed (units).  docs is read twice."""
    columns = docs.columns
    place = {c: f"_c{i}" for i, c in enumerate(columns)}  # further columns may have any names
    base = docs.select(F.col("doc_id"), F.col("text"), F.struct(*(F.col(f"`{c}`").alias(place[c]) for c in columns if c != "text")).alias("_row"))
    known = keyed(base)
    found = Stage(units(known.select("k1", "k2", F.col("_text").alias("text"))), "units")
    again, many = repeats(found.df)
    # of a document its own unit numbers, each once however often its row is repeated
    lists = Stage(again.groupBy("k1", "k2").agg(F.collect_set("unit").alias("again")), "repeats")
    found.drop()
    many.drop()
    joined = known.select("k1", "k2", "text", "_row").join(lists.df, ["k1", "k2"], "left").select("text", "_row", "again")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, cut, counts = part.column(0).to_pylist(), [], []
            for i, (text, own) in enumerate(zip(texts, part.column(2).to_pylist(), strict=True)):
                where, n = passages(text, own, min_words) if own else ([], 0)
                if where:
                    texts[i] = without(text, where)
                cut.append([{"start": a, "end": b} for a, b in where])
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part.column(1), pa.array(cut, spans), pa.array(counts, pa.int32())], names=["text", "_row", "removed", "n_removed"])

    row = joined.schema["_row"].dataType.simpleString()
    done = joined.mapInArrow(run, f"text string, _row {row}, removed array<struct<start:int,end:int>>, n_removed int")
    fields = [F.col("text") if c == "text" else F.col(f"_row.{place[c]}").alias(c) for c in columns]
    return done.select(*fields, "removed", "n_removed")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", "n_removed", spans.alias("removed"), F.length("text").cast("long").alias("kept_chars"), "text")


ORACLE_SQL = rf"""
WITH texts AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\n|[.!?][\x20\x09\x0B-\x0D]+)', '\1' || chr(57344), 'g'), chr(57344)) AS parts FROM documents),
pieces AS (SELECT doc_id, generate_subscripts(parts, 1) AS no, unnest(parts) AS piece FROM texts),
placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER earlier, 0) AS start, coalesce(right(lag(piece) OVER (PARTITION BY doc_id ORDER BY no), 1) = chr(10), true) AS line_start,
         regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM pieces WINDOW earlier AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
unit AS (
  SELECT doc_id, no, start, start + length(piece) AS stop, line_start, right(piece, 1) = chr(10) AS line_end, len(words) AS n, array_to_string(words, ' ') AS norm,
         row_number() OVER (PARTITION BY doc_id ORDER BY no) AS u FROM placed WHERE len(words) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, u) AS occ FROM unit),
run AS (SELECT *, u - row_number() OVER (PARTITION BY doc_id ORDER BY u) AS r FROM ranked WHERE occ > 1),
span AS (
  SELECT doc_id, min(no) AS lo, max(no) AS hi, min(start) AS start, max(stop) AS stop, count(*) AS units,
         NOT arg_min(line_start, no) AND arg_max(line_end, no) AS end_stays
  FROM run GROUP BY doc_id, r HAVING sum(n) >= {MIN_WORDS}),
spans AS (
  SELECT doc_id, string_agg(start || ':' || (stop - CASE WHEN end_stays THEN 1 ELSE 0 END), ',' ORDER BY start) AS removed, sum(units) AS n_removed
  FROM span GROUP BY doc_id),
kept AS (
  SELECT p.doc_id, string_agg(CASE WHEN s.doc_id IS NULL THEN p.piece WHEN s.end_stays AND p.no = s.hi THEN chr(10) ELSE '' END, '' ORDER BY p.no) AS text
  FROM pieces p LEFT JOIN span s ON p.doc_id = s.doc_id AND p.no BETWEEN s.lo AND s.hi GROUP BY p.doc_id)
SELECT d.doc_id, cast(coalesce(s.n_removed, 0) AS integer) AS n_removed, coalesce(s.removed, '') AS removed,
       cast(length(coalesce(k.text, '')) AS bigint) AS kept_chars,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
