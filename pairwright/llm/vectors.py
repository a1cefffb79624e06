"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets a string of bits, the signs of random projections, and the vectors
are ordered by it.  The order is cut into blocks, and a vector is compared with those of its own
block and the next one, so that any two within BLOCK places of one another meet.  Passes follow
from the number of distinct vectors: strings that agree in their first `bits` signs stand together,
and as many passes are made as a pair of the sought cosine needs to agree in them in some pass
with probability RECALL at least.  Where more vectors than a window holds agree in them, that
run is compared as a whole, in tiles, so that a crowded place costs comparisons, not links.
Pairs verified by cosine
in double precision join their vectors; the passes' links are united, and components found.
Within each component all pairs are then compared in tiles, which gives every vector's links
exactly as far as the component reaches, whatever its size.

Equal vectors are one vector while candidates are sought, so that no number of copies crowds a
window; copies are linked by the same cosine.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link
with nothing; vectors of different lengths never link; rows of one vec_id are vectors of their own,
each with its links and component; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.common import Stage, free_shuffles, slices, table
from pairwright.llm.graph import connected_components

#: Probability that a pair of the sought cosine meets, signs of a string, rows of a block, rows of a tile, passes made at once.
RECALL, BITS, BLOCK, TILE, TOGETHER = 0.999, 60, 512, 512, 4
#: Vectors of a part when they are dealt or sorted, at most on average.
PART_ROWS = 50_000


def plan(vectors: int, cosine: float, block: int = BLOCK, recall: float = RECALL) -> tuple[int, int]:
    """Signs in which runs agree, and passes.  One sign agrees for a pair of that cosine with probability 1 - angle / pi.

    A run is `block` vectors on average.  Tables of under two blocks are one run of one pass, which compares all pairs.
    """
    agree = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    bits = min(BITS, int(math.log2(max(1, vectors / block))))
    met = agree**bits
    return bits, 1 if met >= recall else math.ceil(math.log1p(-recall) / math.log1p(-met))


def unit_rows(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows divided by their norms, in double precision; scaled first, so that no square overflows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def planes(seed: int, dim: int, bits: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits))


def _digest(embedding: Column) -> Column:
    """SHA-256 of a vector's components; null for one that links with nothing."""
    vec = embedding.cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
    whole = F.transform(vec, lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    return F.when(fine, F.sha2(F.array_join(whole.cast("array<string>"), ","), 256))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (array<double> or array<float>) and digest of rows that may link."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    vec = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")  # floats travel as they are
    return vectors.select("vec_id", vec.alias("vec"), _digest(F.col("embedding")).alias("digest")).where("digest is not null")


def projected(reps: DataFrame, passes: list[int], bits: int = BITS) -> DataFrame:
    """rep, dim, pass and the bit string (long) of these passes, for vectors of any lengths."""
    names = ["rep", "dim", "pass", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
        kept: dict[tuple, np.ndarray] = {}
        for part in slices(batches, 2048):
            rep, vecs = part.column(0).to_numpy(), part.column(1)
            dims = pc.list_value_length(vecs).to_numpy(zero_copy_only=False).astype(np.int32)
            out = np.zeros((len(passes), len(rep)), np.int64)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = unit_rows(vecs.take(pa.array(own)), dim)
                for i, p in enumerate(passes):
                    if (p, dim) not in kept:
                        kept[p, dim] = planes(p, dim, bits)
                    out[i, own] = ((x @ kept[p, dim]) > 0).astype(np.int64) @ shift
            for i, p in enumerate(passes):
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(dims), pa.array(np.full(len(rep), p, np.int32)), pa.array(out[i])], names=names)

    return reps.select("rep", "vec").mapInArrow(run, "rep long, dim int, pass int, h long")


def _spanning(near: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what `near` joins: each vector to the first one of its group that it is reached from."""
    edges, new = [], np.ones(len(ids), bool)
    for start in range(len(ids)):
        if not new[start]:
            continue
        new[start], front = False, [start]
        while front:
            i = front.pop()
            for j in np.flatnonzero(near[i] & new):
                new[j] = False
                edges.append((int(ids[i]), int(ids[j])))
                front.append(int(j))
    return edges


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their task and place in it."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], names=[*b.schema.names, "part", "row"])
        at += b.num_rows


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([e[0] for e in found], pa.int64()), "b": pa.array([e[1] for e in found], pa.int64())})


def window_edges(reps: DataFrame, places: DataFrame, cosine: float, block: int) -> DataFrame:
    """a, b: links that join all vectors found near each other in neighbouring blocks of their pass."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = places.groupBy("part").agg(F.count("*").alias("n"))
    firsts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # one row a partition
    blocks = places.join(F.broadcast(firsts), "part").select("rep", "pass", "dim", F.floor((F.col("row") + F.col("first")) / block).cast("long").alias("block"))
    # each vector goes to its own block's task and, to be met from the left, to the one before
    sent = blocks.select("rep", "pass", "dim", F.explode(F.array(F.struct(F.col("block").alias("at"), F.lit(True).alias("own")), F.struct((F.col("block") - 1).alias("at"), F.lit(False).alias("own")))).alias("x"))

    def compare(rows: pa.Table) -> pa.Table:
        found = []
        kind = rows.column("pass").to_numpy().astype(np.int64) << 32 | rows.column("dim").to_numpy()
        for one in np.unique(kind).tolist():  # a block may hold the end of one pass and the start of the next
            same = rows.filter(pa.array(kind == one))
            ids, own = same.column("rep").to_numpy(), same.column("own").to_numpy(zero_copy_only=False)
            if own.any():
                x = unit_rows(same.column("vec"), one & 0xFFFFFFFF)
                near = (x @ x.T >= cosine) & (own[:, None] | own[None, :])
                np.fill_diagonal(near, False)
                found += _spanning(near, ids)
        return _edges(found)

    sent = sent.select("rep", "pass", "dim", "x.at", "x.own").where("at >= 0")
    return sent.join(reps.select("rep", "vec"), "rep").groupBy("at").applyInArrow(compare, "a long, b long")


def run_edges(reps: DataFrame, places: DataFrame, bits: int, cosine: float, block: int, parts: int) -> DataFrame:
    """a, b: links that join all vectors near each other in runs that are longer than a window.

    A run's vectors are dealt into tiles of about a block; a task compares two tiles, so a run of any size is many tasks.
    """
    own = places.select("rep", "pass", "dim", F.shiftright("h", BITS - bits).alias("head"))
    run = ["pass", "dim", "head"]
    sizes = own.groupBy(*run).agg(F.count("*").alias("size")).where(F.col("size") > block).select(*run, F.ceil(F.col("size") / block).cast("int").alias("tiles"))
    dealt = own.join(sizes, run).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(*run, F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "rep")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        _, dim, _, t1, t2 = (k.as_py() for k in key)
        ids, x, first = rows.column("rep").to_numpy(), unit_rows(rows.column("vec"), dim), rows.column("tile").to_numpy() == t1
        near = x @ x.T >= cosine
        if t1 != t2:
            near &= first[:, None] != first[None, :]
        np.fill_diagonal(near, False)
        return _edges(_spanning(near, ids))

    # rows may lie dealt by run already, which would put all tiles of one into a single task
    tiled = [*run, "t1", "t2"]
    return sent.join(reps.select("rep", "vec"), "rep").repartition(parts, *tiled).groupBy(*tiled).applyInArrow(compare, "a long, b long")


def pass_edges(reps: DataFrame, passes: list[int], bits: int, cosine: float, block: int, parts: int) -> Stage:
    """a, b: the links that these passes find, staged.

    A vector's place in the order is counted by ranges of bit strings first, so no task sorts all.
    """
    order = ["pass", "dim", "h", "rep"]
    ordered = projected(reps, passes).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    places = Stage(ordered.mapInArrow(_numbered, "rep long, dim int, pass int, h long, part int, row long"), "places")
    edges = Stage(window_edges(reps, places.df, cosine, block).unionByName(run_edges(reps, places.df, bits, cosine, block, parts)).distinct(), "pass-edges")
    places.drop()
    free_shuffles(reps.sparkSession)
    return edges


def tile_links(members: DataFrame, cosine: float, tile: int, parts: int) -> DataFrame:
    """rep, n: for every vector the vectors of its component that it is linked with, by their weights.

    members: component, rep, weight, vec.  A component's vectors are dealt into tiles of about
    `tile`; a task compares two tiles, so a component of any size is many tasks.
    """
    size = members.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
    dealt = members.join(size, "component").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "component", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "rep", "weight", "vec"
    )

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        _, t1, t2 = (k.as_py() for k in key)
        dim = pc.list_value_length(rows.column("vec"))[0].as_py()  # links join vectors of one length only
        x, first = unit_rows(rows.column("vec"), dim), rows.column("tile").to_numpy() == t1
        near = x @ x.T >= cosine
        if t1 != t2:
            near &= first[:, None] != first[None, :]
        np.fill_diagonal(near, False)
        return pa.table({"rep": rows.column("rep"), "n": pa.array(near @ rows.column("weight").to_numpy(), pa.int64())})

    # rows may lie dealt by component already, which would put all tiles of one into a single task
    counts = sent.repartition(parts, "component", "t1", "t2").groupBy("component", "t1", "t2").applyInArrow(compare, "rep long, n long")
    return counts.groupBy("rep").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, passes: int | None = None, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).

    passes: None for as many as RECALL needs.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = usable(rows)
    groups = good.groupBy("digest").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    numbered = Stage(groups.withColumn("rep", F.monotonically_increasing_id()), "vector-groups").df
    reps = numbered.select("rep", "vec")
    size = numbered.count()
    bits, needed = plan(size, cosine, block)
    passes = passes or needed
    # more parts than the setting has once a part would hold more than PART_ROWS vectors
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_ROWS)
    found = [pass_edges(reps, list(range(p, min(passes, p + TOGETHER))), bits, cosine, block, parts) for p in range(0, passes, TOGETHER)]
    edges = found[0].df
    for more in found[1:]:
        edges = edges.unionByName(more.df)
    links = connected_components(edges)  # has its own copy of them
    for stage in found:
        stage.drop()
    members = numbered.join(links.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counts = tile_links(members.select("component", "rep", "weight", "vec"), cosine, tile, parts)
    known = members.select("rep", "component", "least_id", "weight", "digest").join(counts, "rep", "left")
    known = known.select("component", "least_id", "digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    least = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    final = known.join(least, "component").select("digest", "n_links", "component_id")
    keyed = rows.join(final, _digest(F.col("embedding")) == F.col("digest"), "left")
    return keyed.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
