"""What work was done: verdicts that were looked up, and how far the parts of an ingest are. Both are tables that are only
added to, so runs side by side do not undo each other."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# States in their order; the last three end a part.
STATES = ("pending", "running", "complete", "failed", "killed")
ENDS = ("complete", "failed", "killed")
_STATUS = "run_id string, artifact string, state string, indexed long, skipped long, failed long, at timestamp"


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def lookup(spark: SparkSession, path: str, questions: DataFrame, ask: Callable[[DataFrame], DataFrame], by: tuple[str, ...] = ("kind", "value")) -> DataFrame:
    """The verdicts for these questions: those of the table at path, and those of the rest, which `ask` turns into verdicts
    (the columns `by` and any others) and which are added to the table. So work that was cut short goes on where it was."""
    asked, known = questions.select(*by).distinct(), _table(spark, path)
    left = asked if known is None else asked.join(known.select(*by), list(by), "left_anti")
    ask(left).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(asked, list(by), "left_semi")


class Wait(Exception):
    """A service asks to be asked again later, in so many seconds."""

    def __init__(self, seconds: float):
        super().__init__(seconds)
        self.seconds = seconds


def paced(say: Callable[[dict], dict | None], schema: str, spacing: float = 0.1, retries: int = 5, broken: int = 10) -> Callable[[DataFrame], DataFrame]:
    """An `ask` for lookup that puts questions to a remote service one by one, in one task, spacing seconds apart (0.01 at
    least). say turns a question into a verdict, by the columns of schema, or None if there is none. Where it raises Wait the
    question is put again after that time, up to `retries` times; after `broken` questions in a row that failed nothing more
    is asked. Questions without an answer are left for the next run."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names, failed = [x.strip().split()[0] for x in schema.split(",")], 0
        for batch in batches:
            rows = []
            for question in batch.to_dict("records"):
                if failed >= broken:
                    break
                answer = None
                for _ in range(retries + 1):
                    time.sleep(max(0.01, spacing))
                    try:
                        answer, failed = say(question), 0
                    except Wait as e:
                        time.sleep(min(120.0, max(0.5, e.seconds + 0.5)))
                        continue
                    except Exception:
                        failed += 1
                    break
                else:
                    failed += 1
                if answer is not None:
                    rows.append([(question | answer).get(n) for n in names])
            yield pd.DataFrame(rows, columns=names)

    return lambda questions: questions.coalesce(1).mapInPandas(run, schema)


def note(spark: SparkSession, path: str, run_id: str, artifact: str, state: str, indexed: int = 0, skipped: int = 0, failed: int = 0) -> None:
    """Adds what is known of a part of a run."""
    if state not in STATES:
        raise ValueError(f"no state {state!r}")
    now = datetime.datetime.now(datetime.timezone.utc)
    spark.createDataFrame([(run_id, artifact, state, indexed, skipped, failed, now)], _STATUS).coalesce(1).write.mode("append").parquet(path)


def latest_states(notes: DataFrame) -> DataFrame:
    """One row for each part of a run: the first note that ended it, else the last one."""
    end = F.col("state").isin(*ENDS)
    at = F.unix_micros("at")
    best = F.max_by(F.struct(*notes.columns), F.struct(end, F.when(end, -at).otherwise(at)))
    return notes.groupBy("run_id", "artifact").agg(best.alias("row_")).select("row_.*")


def status(spark: SparkSession, path: str) -> DataFrame:
    notes = _table(spark, path)
    return spark.createDataFrame([], _STATUS) if notes is None else latest_states(notes)
