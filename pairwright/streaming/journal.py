"""Appends that are there as a whole or not at all: batches of Parquet files, each with a manifest that is written last.

    <path>/batch=<number>/*.parquet     the rows of a batch
    <path>/_committed/<number>.json     its number, rows and content: only with it does the batch count

A job that ends between the two leaves files that no reader sees; whoever writes the batch again replaces them.  A
batch that has its manifest is not written again, so that a stream's micro-batch that is repeated adds nothing.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.staging import drop_dir, exists, names_in, read_text, write_text


class Journal:
    """A table of committed batches below a path; schema as DDL.

    Files that lie in the path itself (an output of plain appends) count as a batch before all others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _manifest(self, number: int) -> str:
        return f"{self.path}/_committed/{number:09d}.json"

    def _folder(self, number: int) -> str:
        return f"{self.path}/batch={number:09d}"

    def numbers(self) -> list[int]:
        """Committed batches in order."""
        found = (re.fullmatch(r"(\d+)\.json", name) for name in names_in(self.spark, f"{self.path}/_committed"))
        return sorted(int(m.group(1)) for m in found if m)

    def committed(self, number: int) -> bool:
        return exists(self.spark, self._manifest(number))

    def read(self) -> DataFrame:
        """Rows of all committed batches."""
        folders = [self._folder(n) for n in self.numbers()]
        plain = [f"{self.path}/{name}" for name in names_in(self.spark, self.path) if name.endswith(".parquet")]
        if not folders and not plain:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*plain, *folders)

    def write(self, rows: DataFrame, number: int) -> None:
        """The rows of a batch, without its manifest: they do not count yet."""
        drop_dir(self.spark, self._folder(number))
        rows.write.parquet(self._folder(number))

    def commit(self, number: int) -> None:
        batch = self.spark.read.schema(self.schema).parquet(self._folder(number))
        seen = batch.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*batch.columns).cast("decimal(38,0)")).alias("content")).first()
        write_text(self.spark, self._manifest(number), json.dumps({"batch": number, "rows": seen.rows, "content": str(seen.content)}))

    def append(self, rows: DataFrame, number: int | None = None) -> int:
        """Add a batch, unless the batch of that number is committed; without a number it is the next one."""
        if number is None:
            number = max(self.numbers(), default=-1) + 1
        if not self.committed(number):
            self.write(rows, number)
            self.commit(number)
        return number

    def damaged(self) -> list[int]:
        """Batches whose files do not hold what their manifests tell."""
        bad = []
        for number in self.numbers():
            told = json.loads(read_text(self.spark, self._manifest(number)))
            batch = self.spark.read.schema(self.schema).parquet(self._folder(number))
            seen = batch.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*batch.columns).cast("decimal(38,0)")).alias("content")).first()
            if (told["rows"], told["content"]) != (seen.rows, str(seen.content)):
                bad.append(number)
        return bad
