"""Tables that are written to a shared folder and read again, so that what follows sees the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application, the folder of this machine that stands for the shared one in local mode.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which the driver and all executors share.

    Where that setting is missing, a session that runs on this machine alone uses a folder of it;
    on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        if context.applicationId not in _LOCAL_DIRS:
            _LOCAL_DIRS[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='pairwright-')}"
        base = _LOCAL_DIRS[context.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _file_system(spark, path)
    return system.exists(at)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a staged table through Hadoop's file system, whichever store it is in."""
    at, system = _file_system(spark, path)
    system.delete(at, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a staged table's files."""
    at, system = _file_system(spark, path)
    return system.getContentSummary(at).getLength()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, such as a manifest, in whichever store the path is."""
    at, system = _file_system(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """One small file."""
    return spark.read.text(path, wholetext=True).first()[0]


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    at, system = _file_system(spark, path)
    return [status.getPath().getName() for status in system.listStatus(at)] if system.exists(at) else []


def move_only_file(spark: SparkSession, folder: str, path: str) -> None:
    """The one data file of a folder that Spark has written, under a name of its own."""
    (name,) = (n for n in names_in(spark, folder) if n.startswith("part-"))
    at, system = _file_system(spark, f"{folder}/{name}")
    if not system.rename(at, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"{path} cannot be written")


class Stage:
    """A DataFrame written to a shared folder and read again: its lineage ends at committed files."""

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = shared_dir(self.spark, name)
        schema = df.schema
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        drop_dir(self.spark, self.path)
