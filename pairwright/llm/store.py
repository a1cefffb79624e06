"""Content-addressed store of token-id streams.

A rolling hash over the ids of a document cuts them into chunks, so that equal passages give
equal chunks wherever they stand.  A chunk is stored once, under the digest of its ids.
A document is a recipe: the digests of its chunks in order.  Files of a store:

    chunks/    digest binary(16), data binary     zstandard frames of little-endian uint16 or uint32 ids
    recipes/   block, row, doc_id, start, n_tokens long, leaf binary(32), recipe binary   ascending doc_id by block
    manifest/  level int, number, n_docs, n_tokens long, root binary(32)   level 0: blocks, 1: ranges of blocks, 2: the store

leaf is the SHA-256 of doc_id, n_tokens and recipe; a block's root is the Merkle root of its leaves
in order, a range's that of its blocks' roots, and the store's that of its ranges'.  Reading rebuilds
every document, and checks each chunk against its digest, each document against its leaf, and
blocks, ranges and store against their roots.

Defined cases: a null or empty text is the end id alone; a very long text is a block of its own;
repeated rows are documents of their own with shared chunks; rows without doc_id come before all
others; ties are ordered by leaf; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.common import Stage, doc_texts, drop_dir, free_shuffles, shared_dir, size_of, slices, table
from pairwright.llm.tokens import tokenizer_path, word_encoder

END_ID = 0
#: Ids under the rolling hash; the mean distance of cuts is 2 ** MASK_BITS; least and greatest ids of a chunk.
WINDOW, MASK_BITS, LEAST, MOST = 16, 10, 256, 4096
DIGEST = 16
#: A block of recipes ends with the document that brings it to so many documents or ids.
BLOCK_DOCS, BLOCK_TOKENS = 1_000, 1 << 20
#: Chunks that a task remembers as already handed on; bytes of a bucket of chunks, about.
REMEMBER, BUCKET_BYTES = 200_000, 64 << 20
#: Chunks that are sent by broadcast at most, and requests that such a chunk has at least.
HOT, HOT_REQUESTS = 1_000, 1_000

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
#: A number for each id (for its lower 16 bits).
_VALUES = np.random.default_rng(3).integers(0, 2**64, 1 << 16, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def rolling_hashes(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Polynomial hash of the `window` ids that end at each place (fewer at the start), modulo 2**64.

    From prefix sums: with values v and base b, sum v[i] * b**-i over a window, times b**end.
    """
    n = len(ids)
    size = max(4096, 1 << n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = _powers(_ODD, size), _powers(_INVERSE, size)
    up, down = _POWERS[size]
    with np.errstate(over="ignore"):
        total = np.cumsum(_VALUES[ids & 0xFFFF] * down[:n])
        total[window:] -= total[:-window].copy() if n > window else total[:0]
        return total * up[:n]


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end."""
    return np.flatnonzero(rolling_hashes(ids) >> np.uint64(64 - MASK_BITS) == 0) + 1


def cuts(n: int, places: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream of n ids with such places.

    A place under LEAST is never used, so that the hashes of streams that lie one after the
    other in an array may be taken at once: only those at a stream's first WINDOW ids differ.
    """
    ends, at = [], 0
    while n - at > LEAST:
        i = np.searchsorted(places, at + LEAST)
        at = min(int(places[i]) if i < len(places) else n, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as 16-bit numbers where all are small enough, else 32-bit ones; the first byte says which."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def _wide(data: bytes) -> bytes:
    """Little-endian 32-bit ids from what _narrow gave."""
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4").tobytes()


def _leaf(doc_id: int | None, n_tokens: int, recipe: bytes) -> bytes:
    head = b"\0" if doc_id is None else b"\1" + doc_id.to_bytes(8, "big", signed=True)
    return hashlib.sha256(head + n_tokens.to_bytes(8, "big") + recipe).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node goes up as it is, no leaves give the digest of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + ([leaves[-1]] if len(leaves) % 2 else [])
    return leaves[0]


def chunked(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Rows of two kinds: documents (doc_id, n_tokens, leaf, recipe) and chunks (digest, data).

    A chunk that a task has handed on lately is not handed on by it again.
    """
    schema = "is_doc boolean, doc_id long, n_tokens long, leaf binary, recipe binary, digest binary, data binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        encoder, compress, seen = word_encoder(path), zstd.ZstdCompressor(level=1).compress, set()
        for part in slices(batches, keep="tokens"):
            rows: list[tuple] = []
            streams = [data + end for data in encoder.encode(part.column(1).to_pylist())]
            joint = np.frombuffer(b"".join(streams), "<u4")
            places, first = marks(joint), 0
            for doc_id, data in zip(part.column(0).to_pylist(), streams, strict=True):
                ids = joint[first : first + len(data) // 4]
                lo, hi = np.searchsorted(places, (first, first + len(ids)), side="right")
                own, first = places[lo:hi] - first, first + len(ids)
                recipe, at = [], 0
                for to in cuts(len(ids), own):
                    body = _narrow(ids[at:to])
                    digest = hashlib.sha256(body).digest()[:DIGEST]
                    recipe.append(digest)
                    if digest not in seen:
                        if len(seen) >= REMEMBER:
                            seen.clear()
                        seen.add(digest)
                        rows.append((False, None, None, None, None, digest, compress(body)))
                    at = to
                listed = b"".join(recipe)
                rows.append((True, doc_id, len(ids), _leaf(doc_id, len(ids), listed), listed, None, None))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return doc_texts(docs).mapInArrow(run, schema)


_ROWS = "is_block boolean, block long, row long, doc_id long, inside long, n_tokens long, leaf binary, recipe binary"
_MANIFEST = "level int, number long, n_docs long, n_tokens long, root binary"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents (doc_id, n_tokens, leaf, recipe) with their block, place and the ids before them in the task.

    The task's number is the upper half of a block's.  After the documents there is a row for
    each block: how many documents (row) and ids it has, and its root (leaf).
    """
    from pyspark import TaskContext

    names = [x.split()[0] for x in _ROWS.split(", ")]
    types = [pa.bool_(), *[pa.int64()] * 5, pa.binary(), pa.binary()]
    block, row, inside = TaskContext.get().partitionId() << 32, 0, 0
    leaves: list[bytes] = []
    tokens, blocks = 0, []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    for b in batches:
        rows = []
        for doc_id, n, leaf, recipe in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if len(leaves) >= BLOCK_DOCS or tokens >= BLOCK_TOKENS:
                blocks.append((True, block, len(leaves), None, None, tokens, merkle_root(leaves), None))
                block, leaves, tokens = block + 1, [], 0
            rows.append((False, block, row, doc_id, inside, n, leaf, recipe))
            leaves.append(leaf)
            row, inside, tokens = row + 1, inside + n, tokens + n
        yield batch(rows)
    if leaves:
        blocks.append((True, block, len(leaves), None, None, tokens, merkle_root(leaves), None))
    yield batch(blocks)


def _range_of(blocks: pa.Table) -> pa.Table:
    """One row of level 1 from the rows of level 0 of a range."""
    blocks = blocks.sort_by("number")
    root = merkle_root(blocks.column("root").to_pylist())
    totals = [sum(blocks.column(c).to_pylist()) for c in ("n_docs", "n_tokens")]
    return pa.table({"level": pa.array([1], pa.int32()), "number": pa.array([blocks.column("number")[0].as_py() >> 32], pa.int64()), "n_docs": pa.array([totals[0]], pa.int64()), "n_tokens": pa.array([totals[1]], pa.int64()), "root": pa.array([root], pa.binary())})


class TokenStore:
    """A store at a path that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        #: Name under which this session's catalog knows the chunks and their buckets.
        self.table = "chunks_" + hashlib.md5(path.encode(), usedforsecurity=False).hexdigest()

    def _chunks(self) -> DataFrame:
        return self.spark.table(self.table) if self.spark.catalog.tableExists(self.table) else self._read("chunks")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> TokenStore:
        spark = docs.sparkSession
        store = cls(spark, path or shared_dir(spark, "token-store"))
        stage = Stage(chunked(docs, tokenizer, end_id), "chunked", "none")  # its data is compressed already
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size_of(spark, stage.path) // BUCKET_BYTES)
        unique = stage.df.where("not is_doc").groupBy("digest").agg(F.first("data").alias("data"))
        # in buckets by digest, so that readers need not shuffle chunks again; data is compressed already
        chunks = unique.write.format("parquet").bucketBy(parts, "digest").option("compression", "none").option("path", f"{store.path}/chunks")
        chunks.saveAsTable(store.table)
        rows = stage.df.where("is_doc").select("doc_id", "n_tokens", "leaf", "recipe")
        ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "leaf").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "leaf")
        named = Stage(ordered.mapInArrow(_numbered, _ROWS), "recipes", "none")
        stage.drop()
        free_shuffles(spark)
        blocks = named.df.where("is_block").select(F.lit(0).alias("level"), F.col("block").alias("number"), F.col("row").alias("n_docs"), "n_tokens", F.col("leaf").alias("root"))
        part = F.shiftright("number", 32)
        ranges = Stage(blocks.groupBy(part).applyInArrow(_range_of, _MANIFEST), "ranges")
        before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
        offsets = ranges.df.select("number", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))  # a row a range: as many as partitions
        placed = named.df.where("not is_block").withColumn("number", F.shiftright("block", 32)).join(F.broadcast(offsets), "number")
        final = placed.select("block", "row", "doc_id", (F.col("inside") + F.col("offset")).alias("start"), "n_tokens", "leaf", "recipe")
        final.write.option("compression", "none").parquet(f"{store.path}/recipes")
        every = blocks.unionByName(ranges.df)
        every.unionByName(spark.createDataFrame([store._whole(ranges.df)], _MANIFEST)).write.parquet(f"{store.path}/manifest")
        named.drop()
        ranges.drop()
        return store

    @staticmethod
    def _whole(ranges: DataFrame) -> tuple:
        """The row of level 2.  A range is a partition of the recipes when they were written: their roots are few."""
        found = ranges.orderBy("number").collect()
        return 2, -1, sum(r.n_docs for r in found), sum(r.n_tokens for r in found), merkle_root([bytes(r.root) for r in found])

    def _check_top(self) -> None:
        """Raises if the manifest's ranges or its store do not follow from its blocks."""
        kept = self._read("manifest")
        again = kept.where("level = 0").groupBy(F.shiftright("number", 32)).applyInArrow(_range_of, _MANIFEST)
        same = ["level", "number", "n_docs", "n_tokens", "root"]
        apart = again.select(same).exceptAll(kept.where("level = 1").select(same)).unionByName(kept.where("level = 1").select(same).exceptAll(again.select(same)))
        top = kept.where("level = 2").first()
        if not apart.isEmpty() or (top.n_docs, top.n_tokens, bytes(top.root)) != self._whole(kept.where("level = 1"))[2:]:
            raise ValueError(f"store {self.path} does not match its manifest")

    def verify(self) -> None:
        """Raises if what the recipes and the manifest say does not agree.  Chunks are checked where they are read."""

        def root(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("row")
            return rows.slice(0, 1).select(["block"]).append_column("n_docs", pa.array([len(rows)], pa.int64())).append_column("root", pa.array([merkle_root(rows.column("leaf").to_pylist())], pa.binary()))

        found = self._read("recipes").select("block", "row", "leaf").groupBy("block").applyInArrow(root, "block long, n_docs long, root binary")
        kept = self._read("manifest").where("level = 0").select(F.col("number").alias("block"), F.col("n_docs").alias("docs"), F.col("root").alias("kept"))
        if not found.join(kept, "block", "full_outer").where("not (root <=> kept and n_docs <=> docs)").isEmpty():
            raise ValueError(f"store {self.path} does not match its manifest")
        self._check_top()

    def _sent(self, asked: DataFrame) -> DataFrame:
        """block, digest, data of the chunks that blocks ask for.

        A chunk with a HOT-th part of all requests or more goes to the requests by broadcast: there are at most HOT such chunks, of at most
        MOST ids each.  The requests for the others meet them in the chunks' buckets.
        """
        edge = max(HOT_REQUESTS, -(-asked.count() // HOT))
        hot = asked.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= edge).select("digest")
        found = [(bytes(r.digest),) for r in hot.collect()]  # at most HOT digests
        if not found:
            return asked.join(self._chunks(), "digest").select("block", "digest", "data")
        named = F.broadcast(self.spark.createDataFrame(found, "digest binary"))
        chunks = self._chunks()
        few = asked.join(F.broadcast(chunks.join(named, "digest", "left_semi")), "digest").select("block", "digest", "data")
        return few.unionByName(asked.join(named, "digest", "left_anti").join(chunks, "digest").select("block", "digest", "data"))

    def read(self, what: str, per_document) -> DataFrame:  # noqa: ANN001
        """Rebuild every document from its recipe: doc_id, start, n_tokens, and per_document(ids) as `out what`.

        A block of documents asks for each of its chunks once, whatever number of its documents
        hold it; so a chunk that a third of all documents share is sent once a block.
        """
        self._check_top()
        recipes = self._read("recipes")

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # rows of a block lie together: few blocks are cut between batches
                pairs = {(b, r[i : i + DIGEST]) for b, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i in range(0, len(r), DIGEST)}
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], names=["block", "digest"])

        asked = Stage(recipes.select("block", "recipe").mapInArrow(wanted, "block long, digest binary"), "asked", "none")
        sent = self._sent(asked.df)
        # a block's root comes as a row before its documents
        roots = self._read("manifest").where("level = 0").select(F.col("number").alias("block"), F.lit(-1).cast("long").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("start"), F.col("n_docs").alias("n_tokens"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("recipe"))
        kind = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[what]

        def rebuild(rows: pa.Table, chunks: pa.Table) -> pa.Table:
            import zstandard as zstd

            expand = zstd.ZstdDecompressor().decompress
            have = {}
            for digest, data in zip(chunks.column("digest").to_pylist(), chunks.column("data").to_pylist(), strict=True):
                body = expand(data)
                if hashlib.sha256(body).digest()[:DIGEST] != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                have[digest] = body
            found = sorted(zip(*(rows.column(c).to_pylist() for c in ("row", "doc_id", "start", "n_tokens", "leaf", "recipe")), strict=True), key=lambda r: r[0])
            if found[0][0] != -1 or found[0][3] != len(found) - 1 or merkle_root([r[4] for r in found[1:]]) != found[0][4]:
                raise ValueError(f"block {rows.column('block')[0]} does not match the manifest")
            out = []
            for _, doc_id, _, n, leaf, recipe in found[1:]:
                ids = b"".join([_wide(have[recipe[i : i + DIGEST]]) for i in range(0, len(recipe), DIGEST)])
                if len(ids) != 4 * n or _leaf(doc_id, n, recipe) != leaf:
                    raise ValueError(f"document {doc_id} is damaged")
                out.append(per_document(ids))
            columns = [pa.array([r[i] for r in found[1:]], pa.int64()) for i in (1, 2, 3)]
            return pa.table([*columns, pa.array(out, kind)], names=["doc_id", "start", "n_tokens", "out"])

        rows = recipes.select("block", "row", "doc_id", "start", "n_tokens", "leaf", "recipe").unionByName(roots)
        return rows.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(rebuild, f"doc_id long, start long, n_tokens long, out {what}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        drop_dir(self.spark, self.path)


def op5_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = TokenStore.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    try:
        found = Stage(store.read("long", zlib.crc32), "token-digests").df
    finally:  # the catalog forgets the table of chunks, too
        store.drop()
    return found.select("doc_id", "start", "n_tokens", F.col("out").alias("ids_crc32"))
