"""Resumable prediction: what has a result is not computed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.evaluation import PREDICTION
from pairwright.operators.guards import duplicates, missing_from, strict
from pairwright.staging import exists, read_text, write_text
from pairwright.streaming.journal import Journal

#: A backend is made once a partition and gives for a row's dict the fields of a prediction but task_id.
Backend = Callable[[], Callable[[dict], dict]]
COLUMNS = [c.split()[0] for c in PREDICTION.replace("struct<name:string,arguments:string>", "struct").split(", ")]


def predicted(tasks: DataFrame, backend: Backend) -> DataFrame:
    """A prediction for every task (id ...); an exception becomes a row with inference_error."""

    def run(frames):  # noqa: ANN001, ANN202
        import pandas as pd

        predict = None
        for frame in frames:
            if predict is None and len(frame):  # nothing is made for a partition without rows
                predict = backend()
            rows = []
            for row in frame.to_dict("records"):
                blank = dict.fromkeys(COLUMNS) | {"task_id": row["id"], "raw_text": "", "latency_ms": 0.0}
                try:
                    rows.append(blank | predict(row))
                except Exception as error:  # noqa: BLE001  the failure is the result
                    rows.append(blank | {"inference_error": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(rows, columns=COLUMNS)

    return tasks.mapInPandas(run, PREDICTION)


def resume(tasks: DataFrame, backend: Backend, path: str, limit: int | None = None) -> DataFrame:
    """Predictions of the selected tasks (id, ord), from the journal at path where they are there, else computed and appended.

    The limit takes the first tasks by ord before anything is left out.  ValueError for repeated or
    foreign ids in path.  Failures count as done.
    """
    journal = Journal(tasks.sparkSession, path, PREDICTION)
    chosen = tasks.orderBy("ord").limit(limit) if limit is not None else tasks
    done = journal.read()
    strict(done, duplicates(done, "task_id"), "the output holds an id twice")
    strict(done, missing_from(done, chosen.select(F.col("id").alias("task_id")), "task_id"), "the output holds ids that are not asked for")
    rest = chosen.join(done.select(F.col("task_id").alias("id")), "id", "left_anti")
    journal.append(predicted(rest, backend))
    return chosen.select(F.col("id").alias("task_id"), "ord").join(journal.read(), "task_id").orderBy("ord").drop("ord")


def resume_prompts(prompts: DataFrame, backend: Backend, path: str, limit: int | None = None) -> DataFrame:
    """The same for generic prompts (id, messages), by ascending id; a backend sees id and messages only."""
    return resume(prompts.select("id", "messages", F.col("id").alias("ord")), backend, path, limit)


def stream(tasks: DataFrame, backend: Backend, path: str, checkpoint: str, at: str | None = None, lifetime: str = "1 hour"):  # noqa: ANN201
    """The same over a stream of tasks, each id once.

    A micro-batch is a batch of the journal with its number: one that is repeated after a failure adds nothing.  Ids
    that an earlier batch has are looked up in the journal's id column.  With `at`, the time of a task, ids that come again within
    the lifetime are left out by Spark's state, which forgets them after it, so that it stays bounded; without it, a batch's own repeats go.
    """
    spark = tasks.sparkSession
    journal = Journal(spark, path, PREDICTION)
    def append(batch: DataFrame, number: int) -> None:
        if journal.committed(first + number):
            return
        done = journal.read().select(F.col("task_id").alias("id"))
        journal.append(predicted(batch.dropDuplicates(["id"]).join(done, "id", "left_anti"), backend), first + number)

    first = _first_batch(spark, checkpoint, max(journal.numbers(), default=-1) + 1)
    once = tasks if at is None else tasks.withWatermark(at, lifetime).dropDuplicatesWithinWatermark(["id"])
    return once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _first_batch(spark: SparkSession, checkpoint: str, base: int) -> int:
    """The journal's number of a stream's first micro-batch, kept beside its checkpoint."""
    kept = f"{checkpoint.rstrip('/')}-first.json"
    if not exists(spark, kept):
        write_text(spark, kept, str(base))
    return int(read_text(spark, kept))


CACHED = "id string, example_hash string, chosen_logp double, rejected_logp double, chosen_tokens long, rejected_tokens long"


def reference_cache(examples: DataFrame, scorer: Callable[[], Callable[[list, str], tuple[float, int]]], path: str) -> DataFrame:
    """Log-probabilities of both responses to every example (id, messages, chosen, rejected, example_hash), from path or computed and appended.

    A scorer is made once a partition and gives log-probability and tokens of a response to messages.
    """

    def run(frames):  # noqa: ANN001, ANN202
        import pandas as pd

        score = None
        for frame in frames:
            if score is None and len(frame):
                score = scorer()
            rows = []
            for row in frame.itertuples():
                turns = [dict(m) for m in row.messages]
                (chosen, n), (rejected, m) = score(turns, row.chosen), score(turns, row.rejected)
                rows.append((row.id, row.example_hash, chosen, rejected, n, m))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CACHED.split(", ")])

    journal = Journal(examples.sparkSession, path, CACHED)
    done = journal.read()
    strict(done, duplicates(done, "id"), "an example is cached twice")
    rest = examples.join(done.select("id"), "id", "left_anti")
    journal.append(rest.select("id", "messages", "chosen", "rejected", "example_hash").mapInPandas(run, CACHED))
    return journal.read()
