"""From raw documents to packed training sequences, in five stages.

1. quality           documents that the compression classifier scores under 0.5 go
2. near_duplicates   one document of each group linked by five-word shingles (Jaccard 0.8) stays
3. repeated_passages passages that an earlier document holds go from the text
4. personal_data     personal data in the text is replaced by its kind
5. packing           what is left is tokenized and packed into sequences of 1024 ids

Each stage is given what the one before it kept, written as Parquet and read again.

Defined cases: null and empty texts are scored as texts of no bytes are, link with nothing, and are
packed as the end id alone; rows without doc_id go the same way; of rows that agree in doc_id and text
one stays; further columns of any names are carried up to the last stage; very long texts are
whole in every stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import linededup, ngramjoin, packing, pii, quality
from pairwright.llm.common import Stage
from pairwright.llm.tokens import tokenizer_path


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject(docs, quality.fit(docs, quality.training_labels(spark, sf_dir)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.one_of_each(docs, k=5, percent=80)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(linededup.dedup(docs).select(*(F.col(f"`{c}`") for c in docs.columns)))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", passage_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Compression and tokenization have no form in SQL; tests/llm/test_corpus_operators.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        made = Stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.drop()
        docs, before = made.df, made
    packed = STAGES[-1][1](spark, docs, sf_dir)
    before.drop()  # packing has staged its pieces and reads no texts again
    return packed
