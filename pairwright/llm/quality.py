"""Quality classifier by compression.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled
bad.  A text is cut into pieces of about PIECE bytes, so that a long one is not told by how it
repeats itself; each piece is compressed with each dictionary, and the difference of the two sizes
over the piece's size is taken.  The mean and the least of these normalised differences
become a probability by a logistic calibration, fitted on labelled texts which neither dictionary
has seen; it is weaker for short texts, which say little.

Defined cases: null and empty texts score as any text of no bytes does (the calibration's
intercept); repeated rows score alike; without labels of both classes every score is 0.5;
labels of documents that do not exist, null labels and further columns are ignored; very long
texts are scored whole; a score of exactly 0.5 counts as good; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import doc_texts, slices, table

#: Labelled texts of each class for its dictionary, and of both classes for the calibration.
DICT_ROWS, CALIBRATION_ROWS = 1_500, 3_000
#: A labelled text longer than this (code points) is not taken for fitting; texts to score have no limit.
FIT_CHARS = 20_000
DICT_BYTES, LEVEL = 112_640, 3
#: Bytes of a piece, about; bytes of text at which half of the calibration for short texts holds.
PIECE, SHORT = 1024, 64


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    level: int = LEVEL


class _Scorer:
    def __init__(self, model: CompressionModel):
        import zstandard as zstd

        def compressor(data: bytes):
            extra = {"dict_data": zstd.ZstdCompressionDict(data)} if data else {}
            return zstd.ZstdCompressor(level=model.level, write_content_size=False, write_checksum=False, write_dict_id=False, **extra).compress

        self.good, self.bad = compressor(model.good), compressor(model.bad)
        self.weights = np.array(model.weights)

    def differences(self, data: bytes) -> np.ndarray:
        """How much smaller each piece is with the good dictionary than with the bad one, per byte."""
        size = -(-len(data) // max(1, round(len(data) / PIECE))) or 1
        pieces = [data[i : i + size] for i in range(0, max(1, len(data)), size)]
        return np.array([(len(self.bad(p)) - len(self.good(p))) / (len(p) + 16) for p in pieces])

    def features(self, texts: list[str]) -> np.ndarray:
        """1, ten times the mean and the least difference, shortness, and the mean times shortness."""
        out = np.zeros((len(texts), 5))
        for i, text in enumerate(texts):
            data = text.encode()
            found = 10 * self.differences(data)
            short = SHORT / (len(data) + SHORT)
            out[i] = 1.0, found.mean(), found.min(), short, found.mean() * short
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.features(texts) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton steps for a ridge logistic regression; the intercept is not penalised."""
    scale = x.std(axis=0)
    scale[scale == 0] = 1
    x, w = x / scale, np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w / scale)


def fit(docs: DataFrame, labels: DataFrame, dict_rows: int = DICT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> CompressionModel:
    """A model from a bounded sample of labelled rows.

    The sample is the first rows by a hash of doc_id, at most 2 * dict_rows + calibration_rows of
    them; its texts (each of at most FIT_CHARS) come to the driver.  labels: doc_id, quality;
    the caller has removed rows that must not be learnt from.
    """
    import zstandard as zstd

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    natural = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).orderBy(*order).limit(calibration_rows).withColumn("part", F.lit("calibration"))
    rest = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    parts = [natural, *(rest.where(F.col("quality") == q).orderBy(*order).limit(dict_rows).withColumn("part", F.lit("dictionary")) for q in (0, 1))]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # at most 2 * dict_rows + calibration_rows narrow rows: broadcast whatever the corpus size
    found = doc_texts(docs).where(F.length("text") <= FIT_CHARS).join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id", "quality", "part").agg(F.min("text").alias("text"))  # one row of a doc_id
    rows = sorted({(r.doc_id, r.part, r.quality, r.text) for r in found.collect()})
    texts = {q: [r[3].encode() for r in rows if r[1] == "dictionary" and r[2] == q and r[3]] for q in (0, 1)}
    calibration = [r for r in rows if r[1] == "calibration"]
    if not texts[0] or not texts[1] or len({r[2] for r in calibration}) < 2:
        return CompressionModel(b"", b"", (0.0,) * 5)

    def dictionary(samples: list[bytes]) -> bytes:
        size = min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8))
        try:
            return zstd.train_dictionary(size, samples).as_bytes()
        except zstd.ZstdError:  # too few samples to train: their content itself is the dictionary
            return b"".join(samples)[-size:]

    model = CompressionModel(dictionary(texts[1]), dictionary(texts[0]), (0.0,) * 5)
    x = _Scorer(model).features([r[3] for r in calibration])
    return CompressionModel(model.good, model.bad, _logistic(x, np.array([r[2] for r in calibration], float)))


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """Every document's score: doc_id, score double.  No shuffle; a text is compressed where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for part in slices(batches):
            found = scorer.scores(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: CompressionModel, at_least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at least so much, with all their columns."""
    fields = docs.columns
    text = fields.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for part in slices(batches):
            keep = scorer.scores([t or "" for t in part.column(text).to_pylist()]) >= at_least
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, mod 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, training_labels(spark, sf_dir)))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
