"""Scans and sinks of JSON lines, annotation files, trees of files and manifests."""

from __future__ import annotations

import hashlib
import heapq
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions.canonical import canonical
from pairwright.functions.schemas import normalize_schemas
from pairwright.functions.text import slug
from pairwright.functions.udf import vectorized
from pairwright.operators.guards import duplicates, strict
from pairwright.staging import Stage

# ------------------------------------------------------------------------------------- scans


def _problem(line: str) -> str | None:
    try:
        value = json.loads(line)
    except ValueError as error:
        return str(error)
    return None if isinstance(value, dict) else "the line is no JSON object"


@vectorized("string")
def line_problem(value: pd.Series) -> pd.Series:
    return value.map(lambda line: None if line is None else _problem(line))


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block, _id, value of every line, blank ones too.  Files are split by ranges of bytes, so that any size is many tasks."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"), "value")


def with_line_numbers(staged: DataFrame) -> DataFrame:
    """staged raw lines with their number in the file (from 1): the lines of a file's earlier ranges are counted before its own.

    Only a count for each range is brought together; there are as many as tasks that read the files.
    """
    ranges = staged.groupBy("path", "block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    line = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return staged.join(before, ["path", "block"]).withColumn("line", line).drop("_before", "_first", "block", "_id")


def something(value: Column) -> Column:
    return F.regexp_like(value, F.lit(r"(?U)[^\s\x1c-\x1f]"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1), value of every line with something on it."""
    return with_line_numbers(Stage(raw_lines(spark, path), "lines").df).where(something(F.col("value"))).select("path", "line", "value")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, checked: bool = True) -> DataFrame:
    """JSON lines by a schema, with ord, the line's number.

    checked: every line must be a strict JSON object, else ValueError "path:line: detail" for the first one
    that is none.  The files are read once: lines, what is wrong with them and their places are staged.  Without
    it Spark reads the files at full speed and fails on malformed lines.
    """
    if not checked:
        reader = spark.read.option("mode", "FAILFAST").option("allowSingleQuotes", "false")
        return (reader.schema(schema) if schema else reader).json(path)
    staged = Stage(raw_lines(spark, path).withColumn("problem", line_problem(F.when(something(F.col("value")), F.col("value")))), "jsonl").df
    if not staged.where("problem is not null").isEmpty():
        bad = with_line_numbers(staged.drop("value")).where("problem is not null").agg(F.min(F.struct("path", "line", "problem")).alias("b")).first().b
        raise ValueError(f"{bad.path}:{bad.line}: {bad.problem}")
    lines = with_line_numbers(staged.drop("problem")).where(something(F.col("value")))
    if schema is None:
        return lines.select(F.col("line").alias("ord"), "value")
    return lines.select("line", F.from_json("value", schema, {"mode": "FAILFAST", "allowSingleQuotes": "false"}).alias("r")).select(F.col("line").alias("ord"), "r.*")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Stored tasks with ord, the line; open parts become JSON text, a numeric validator's value a number."""
    from pairwright.operators.generate import TASK

    v = F.col("expected.validator")
    numeric = v["kind"] == "numeric"
    fixed = v.withField("num_value", F.when(numeric, v["value"].cast("double"))).withField("value", F.when(~numeric, v["value"]))
    rows = read_jsonl(spark, path, TASK)
    return rows.withColumn("expected", F.col("expected").withField("validator", F.when(v["kind"].isNotNull(), fixed)))


def read_unique(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Rows that are there at all, each key once."""
    rows = read_jsonl(spark, path, schema)
    if rows.isEmpty():
        raise ValueError(f"{path}: no rows")
    return strict(rows, duplicates(rows, key), f"{path}: ids must be unique")


def read_split(spark: SparkSession, path: str, schema: str, split: str) -> DataFrame:
    rows = read_jsonl(spark, path, schema)
    return strict(rows, rows.where(F.col("split") != split).select("id"), f"{path}: rows of another split").orderBy("id")


def read_document(spark: SparkSession, path: str) -> dict:
    """One JSON document that must be an object; small, so the driver holds it."""
    value = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    return value


def read_correct(spark: SparkSession, path: str) -> DataFrame:
    """Only task_id and correct of an evaluation file; both must be there, ids once."""
    rows = spark.read.schema("task_id string, correct boolean").json(path)
    strict(rows, rows.where("task_id is null or correct is null"), f"{path}: an evaluation lacks its id or outcome")
    return strict(rows, duplicates(rows, "task_id"), "a task is evaluated twice")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """An annotation file with exactly its five columns in order."""
    from pairwright.operators.agreement import FIELDS

    header = spark.read.text(path).first()[0].rstrip("\r").split(",")
    if tuple(header) != FIELDS:
        raise ValueError(f"an annotation file has the columns {FIELDS}")
    schema = ", ".join(f"{f} string" for f in FIELDS)
    return spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').schema(schema).csv(path).na.fill({"notes": ""})


def read_external(spark: SparkSession, path: str, revision: str, license_name: str) -> DataFrame:
    """External call-decision files: the file's name tells category and decision.

    Ids become slugs, Python type names in parameters JSON Schema's; each row has exactly one
    conversation; provenance tells source file, hash and revision.
    """
    schema = "id string, question array<array<struct<role:string,content:string>>>, function array<struct<name:string,description:string,parameters:string>>"
    raw = spark.read.schema(schema).json(path).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    kind = F.when(F.col("file") == "BFCL_v3_simple.json", F.struct(F.lit("simple").alias("category"), F.lit("CALL").alias("decision"))).when(F.col("file") == "BFCL_v3_irrelevance.json", F.struct(F.lit("irrelevance").alias("category"), F.lit("ABSTAIN").alias("decision")))
    rows = raw.withColumn("kind", kind)
    strict(rows, rows.where("kind is null").select("file"), "the name of a file tells no category")
    strict(rows, rows.where("size(question) != 1 or id is null or function is null").select("id"), "a record has not one conversation")
    hashes = file_hashes(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256")
    schemas = normalize_schemas(F.transform("function", lambda f: f["parameters"]))
    named = F.zip_with("function", schemas, lambda f, s: f.withField("parameters", s))
    out = rows.select("id", "question", "kind", "file", named.alias("functions")).join(hashes, "file")
    provenance = F.struct(
        F.lit(revision).alias("revision"), F.lit(license_name).alias("license"), F.lit("external_eval").alias("usage"), F.col("id").alias("original_id"),
        F.col("file").alias("source_file"), F.col("sha256").alias("source_sha256"), F.array(F.lit("python-types-to-json-schema")).alias("transformations"),
    )
    named = out.select(F.concat(F.lit("bfcl-"), slug(F.col("id"))).alias("new_id"), "*")
    strict(named, duplicates(named, "new_id"), "two records have one id")
    return named.select(F.col("new_id").alias("id"), F.col("kind.category").alias("category"), F.col("kind.decision").alias("expected_decision"), F.element_at("question", 1).alias("messages"), "functions", provenance.alias("provenance")).orderBy("id")


def user_text(messages: Column) -> Column:
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"]), "\n")


#: Where tasks cannot open a store themselves, files up to this size are a row each; larger ones are read as streams.
WHOLE_BYTES = 1 << 28
#: Bytes of a file that a task holds at once while it hashes it.
CHUNK_BYTES = 1 << 20


def listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and length of every file below a path, in whichever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, rows = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        status = found.next()
        rows.append((status.getPath().toString(), status.getLen()))
    return rows


def stream_sha256(spark: SparkSession, path: str) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def _open(path: str):  # noqa: ANN202
    """A file as a stream of bytes, in any store that pyarrow knows."""
    from urllib.parse import quote

    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))  # the listing gives plain names
    return system.open_input_stream(place)


def _opens(path: str) -> bool:
    try:
        _open(path).close()
    except (OSError, ValueError, NotImplementedError):  # a store that only Spark can read
        return False
    return True


def dealt(files: list[tuple[str, int]], parts: int) -> list[tuple[int, str]]:
    """(part, path): the largest files first, each to the part that has least so far."""
    loads, out = [(0, part) for part in range(parts)], []
    for path, length in sorted(files, key=lambda f: (-f[1], f[0])):
        load, part = heapq.heappop(loads)
        heapq.heappush(loads, (load + length + CHUNK_BYTES, part))  # opening a file is work, too
        out.append((part, path))
    return out


def streamed_hashes(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """path, sha256 of files, which tasks read piece by piece; files are dealt over tasks by their size."""
    parts = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            paths, found = batch.column(1).to_pylist(), []
            for path in paths:
                digest = hashlib.sha256()
                with _open(path) as stream:
                    while piece := stream.read(CHUNK_BYTES):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.string())], names=["path", "sha256"])

    rows = spark.createDataFrame(dealt(files, parts), "part int, path string")
    return rows.repartitionByRange(parts, "part").mapInArrow(run, "path string, sha256 string")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of every file below a path, but for those in .cache folders.

    The driver only lists them.  Tasks stream them (see streamed_hashes); in a store that tasks cannot open themselves Spark's scan gives
    the files as rows, but for empty ones and those over WHOLE_BYTES, which are read as streams one after the other.
    """
    listed = [f for f in listing(spark, path) if "/.cache/" not in f[0]]
    if listed and _opens(listed[0][0]):
        return streamed_hashes(spark, listed)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where((F.col("length") > 0) & (F.col("length") <= WHOLE_BYTES))
    small = files.where(~F.contains("path", F.lit("/.cache/"))).select("path", F.sha2("content", 256).alias("sha256"))
    apart = [(name, stream_sha256(spark, name)) for name, length in listed if not length or length > WHOLE_BYTES]
    return small.unionByName(spark.createDataFrame(apart, "path string, sha256 string")) if apart else small


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files by path relative to a root, with their hashes."""
    rows = file_hashes(spark, root)
    return rows.withColumn("path", F.substring_index("path", f"{root.rstrip('/')}/", -1)).orderBy("path")


def paired_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(complete pairs, problems) of tasks/<scenario>/<candidate>/{act,abstain} trees with environments/<name>."""
    files = inventory(spark, root).withColumn("p", F.split("path", "/"))
    sides = files.where("p[0] = 'tasks' and size(p) >= 5 and p[3] in ('act', 'abstain')").select(F.concat_ws("/", F.col("p")[1], F.col("p")[2]).alias("pair"), F.col("p")[3].alias("side"), F.element_at("p", -1).alias("name"), F.col("p")[4].alias("top"))
    environments = files.where("p[0] = 'environments' and size(p) >= 3").select(F.col("p")[1].alias("environment")).distinct()
    by = sides.groupBy("pair").agg(F.count_distinct("side").alias("sides"), F.count_distinct(F.when(F.col("name") == "task.yaml", F.col("side"))).alias("tasks"))
    states = sides.where("top = 'initial_states' and name like '%.json'").select("pair", F.regexp_replace("name", r"\.json$", "").alias("environment"))
    lost = states.join(environments, "environment", "left_anti").select("pair", F.concat(F.lit("unknown environment "), "environment").alias("problem"))
    bad = by.where("sides != 2").select("pair", F.lit("incomplete pair").alias("problem")).unionByName(by.where("sides = 2 and tasks != 2").select("pair", F.lit("missing task.yaml").alias("problem")))
    return by.where("sides = 2").select("pair").orderBy("pair"), bad.unionByName(lost)


def hash_mismatches(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Rows of wanted (path, sha256) that the files below root do not have."""
    have = inventory(spark, root).select("path", F.col("sha256").alias("found"))
    return wanted.join(have, "path", "left").where("not sha256 <=> found")


def forbidden(path: Column) -> Column:
    """Absolute paths and those with a component `test`."""
    return F.startswith(path, F.lit("/")) | F.exists(F.split(F.lower(path), "/"), lambda p: p == "test")


def load_yaml(spark: SparkSession, path: str, fields: dict[str, type]) -> dict:
    """A configuration that must be a mapping of exactly these fields and types."""
    import yaml

    value = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(value, dict):
        raise ValueError("a configuration is a mapping")
    unknown, missing = set(value) - set(fields), set(fields) - set(value)
    if unknown or missing:
        raise ValueError(f"config: unknown {sorted(unknown)}, missing {sorted(missing)}")
    wrong = [k for k, t in fields.items() if not isinstance(value[k], t) or (t is int and isinstance(value[k], bool))]
    if wrong:
        raise ValueError(f"config: wrong type of {wrong}")
    return value


# ------------------------------------------------------------------------------------- sinks


def write_jsonl(df: DataFrame, path: str, order: str) -> None:
    """Canonical JSON lines of all columns but order; ranges of order are files, by name in that order."""
    from pyspark.sql.types import StringType, StructField, StructType

    columns = [c for c in df.columns if c != order]

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([canonical(r) for r in batch.to_pylist()], pa.string())], names=["value"])

    ordered = df.repartitionByRange(order).sortWithinPartitions(order).select(*columns)
    ordered.mapInArrow(run, StructType([StructField("value", StringType())])).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("lineSep", "\n").csv(path)


def manifest(**fields: object) -> str:
    """Canonical one-line manifest."""
    return canonical(fields) + "\n"
