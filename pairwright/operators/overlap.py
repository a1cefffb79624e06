"""Overlap between corpora: exact, by five-gram Jaccard, and by matching sequences."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.text import five_grams, normalize_query
from pairwright.functions.udf import vectorized
from pairwright.operators import segments, setjoin
from pairwright.operators.guards import union_all
from pairwright.staging import Stage

JACCARD, SEQUENCE = 0.80, 0.90
SHAPE = "struct<duplicate:boolean,method:string,score:double>"


@vectorized("double")
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """difflib's ratio; the sides are not symmetric (its heuristics look at the right one)."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)])


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def near_duplicate(left: Column, right: Column) -> Column:
    """Verdict on one pair of texts: exact, five_gram_jaccard, sequence_match, or the greater score of the two."""
    a, b = normalize_query(left), normalize_query(right)
    j, s = jaccard(five_grams(left), five_grams(right)), sequence_ratio(a, b)
    row = lambda yes, method, score: F.struct(F.lit(yes).alias("duplicate"), F.lit(method).cast("string").alias("method"), score.alias("score"))
    return F.when(a == b, row(True, "exact", F.lit(1.0))).when(j >= JACCARD, row(True, "five_gram_jaccard", j)).when(s >= SEQUENCE, row(True, "sequence_match", s)).otherwise(row(False, None, F.greatest(j, s)))


@vectorized("array<long>")
def gram_hashes(query: pd.Series) -> pd.Series:
    """Distinct 64-bit hashes of a normalised query's five-character pieces, two blanks at each side."""

    def one(text: str | None) -> np.ndarray | None:
        if text is None:
            return None
        padded = f"  {text}  "
        return np.unique(segments.piece_hashes(padded, min(5, len(padded))))

    return query.map(one)


def prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, q (normalised text), grams (64-bit hashes of its five-grams), h, n, len; staged, as every step reads it."""
    rows = df.select(F.col(key).alias("id"), normalize_query(F.col(text)).alias("q")).withColumn("grams", gram_hashes("q"))
    return Stage(rows.withColumns({"h": F.sha2("q", 256), "n": F.size("grams"), "len": F.length("q")}), "prepared").df


def exact_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("h", F.col("id").alias("left_id")).join(b.select("h", F.col("id").alias("right_id")), "h").select("left_id", "right_id", F.lit("exact").alias("method"), F.lit(1.0).alias("score"))


def jaccard_pairs(a: DataFrame, b: DataFrame, threshold: float = JACCARD, self_join: bool = False) -> DataFrame:
    """left_id, right_id, score of all pairs of prepared rows at the threshold or over it."""
    return setjoin.similar(a.select("id", "grams"), b.select("id", "grams"), threshold, self_join)


def jaccard_groups(rows: DataFrame, threshold: float = JACCARD) -> DataFrame:
    """left_id, right_id, score: pairs between the first ids of different gram sets, and every other id of a set with its first one.

    Rows of one set are not paired with one another, so that any number of copies is that many rows.
    """
    key = F.struct(F.xxhash64("grams"), F.xxhash64(F.reverse("grams")), F.size("grams"))  # grams are sorted: 128 bits of a set
    keyed = rows.where("grams is not null").select("id", key.alias("key"))
    first = keyed.groupBy("key").agg(F.min("id").alias("rep"))
    reps = Stage(keyed.join(first, "key").select("id", "rep"), "reps").df
    copies = reps.where("id != rep").select(F.col("rep").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("score"))
    own = rows.select("id", "grams")
    return setjoin.similar(own, own, threshold, self_join=True, only=reps.where("id = rep").select("id")).unionByName(copies)


def sequence_pairs(a: DataFrame, b: DataFrame, threshold: float = SEQUENCE) -> DataFrame:
    """left_id, right_id, score of pairs of rows (id, q) with a matching sequence ratio of at least the threshold."""
    return segments.matching(a.select("id", "q"), b.select("id", "q"), threshold)


def sequence_groups(a: DataFrame, b: DataFrame, threshold: float = SEQUENCE) -> DataFrame:
    """left_id, right_id, score, side: the same between the first rows of different texts, and each text's other rows, by side, after its first one."""
    return segments.groups(a.select("id", "q"), b.select("id", "q"), threshold)


def overlap(external: DataFrame, internal: DataFrame) -> DataFrame:
    """For each external row (id, query) that overlaps, its first internal match (id, query, split, ord).

    First is by ord (file order of train, validation, test); of one pair the first method counts.
    """
    # a verdict follows from the normalised queries: each is compared once, whatever number of rows have it
    spelled = external.select("id", normalize_query(F.col("query")).alias("q")).where("q is not null")
    first = internal.withColumn("q", normalize_query(F.col("query"))).where("q is not null").groupBy("q").agg(F.min(F.struct("ord", "id", "split")).alias("m"))
    own = first.select(F.col("m.id").alias("id"), "q", F.col("m.split").alias("split"), F.col("m.ord").alias("ord"))
    asked = Stage(spelled.groupBy("q").agg(F.min("id").alias("id")), "queries").df
    have = Stage(own, "queries").df
    a, b = prepared(asked, "id", "q"), prepared(have, "id", "q")
    steps = [exact_pairs(a, b).drop("method"), jaccard_pairs(a, b), sequence_pairs(a, b)]
    named = [step.withColumns({"rank": F.lit(i), "method": F.lit(name)}) for i, (step, name) in enumerate(zip(steps, ("exact", "five_gram_jaccard", "sequence_match"), strict=True))]
    order = have.select(F.col("id").alias("right_id"), "split", "ord")
    best = union_all(*named).join(order, "right_id").groupBy("left_id").agg(F.min(F.struct("ord", "rank", "right_id", "split", "method", "score")).alias("m"))
    found = asked.join(best, F.col("id") == F.col("left_id")).select("q", "m")
    rows = spelled.join(found, "q")
    return rows.select(F.col("id").alias("external_id"), F.col("m.right_id").alias("internal_id"), F.col("m.split").alias("internal_split"), F.col("m.method").alias("method"), F.col("m.score").alias("score"))


def quarantine(external: DataFrame, internal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, report of excluded ones)."""
    report = overlap(external, internal)
    return external.join(report.select(F.col("external_id").alias("id")), "id", "left_anti"), report


#: Items of this many characters together are searched for at once by an automaton in each worker; beyond it they are joined.
AUTOMATON_CHARS = 16_000_000
HEAD = 40


#: Automata that this worker has built, the last one only.
_BUILT: dict[int, tuple] = {}


def _automaton(shared) -> tuple:  # noqa: ANN001
    """The automaton of broadcast items and the keys of each text, built once a worker."""
    import ahocorasick

    if id(shared.value) not in _BUILT:
        owners: dict[str, list[int]] = {}
        for key, text in shared.value:
            owners.setdefault(text, []).append(key)
        machine = ahocorasick.Automaton()
        for text in owners:
            machine.add_word(text, text)
        machine.make_automaton()
        _BUILT.clear()
        _BUILT[id(shared.value)] = machine, owners, shared.value  # kept, so that its id stays its own
    return _BUILT[id(shared.value)][:2]


def _searched(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most AUTOMATON_CHARS characters

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        machine, owners = _automaton(shared)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {t for _, t in machine.iter(text)} if text else set()
                rows += [(doc, key) for t in found for key in owners[t]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["doc_id", "item_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long")


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates meet in the item's first HEAD characters, which may stand anywhere in a document."""
    heads = items.select("item_id", F.col("text").alias("item"), F.substring("text", 1, HEAD).alias("head"))
    pieces = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{HEAD}}}))"), F.lit(1)))).alias("head"))
    meets = pieces.join(heads.where(F.length("item") >= HEAD), "head").select("doc_id", "item_id", "item")
    return meets.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item"))).select("doc_id", "item_id")


def _short(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Items of under HEAD characters: every piece of a document as long as some item is joined with the items of that length."""
    lengths = sorted(r[0] for r in items.select(F.length("text")).distinct().collect())  # fewer than HEAD
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long")
    every = F.concat(*(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))) for n in lengths))
    return docs.select("doc_id", F.explode(every).alias("text")).join(items.select("item_id", "text"), "text").select("doc_id", "item_id")


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every document (doc_id, text) that holds an item's (item_id, text) whole text.

    One scan without a shuffle while the items are small enough to be in every worker; else they are joined,
    by their first HEAD characters, or, the shorter ones, by pieces of their own length.
    """
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    take = lambda df: [(r.item_id, r.text) for r in df.where(F.length("text") > 0).select("item_id", "text").collect()]
    if size <= AUTOMATON_CHARS:
        return _searched(docs, take(items))
    return _joined(docs, items).unionByName(_short(docs, items.where((F.length("text") > 0) & (F.length("text") < HEAD))))
