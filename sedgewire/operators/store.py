"""The evidence table: Parquet partitioned by case, artifact and host, one row per (index, id), the latest wins."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sedgewire.functions.ids import quoted, sanitize

PARTITIONS = ("case_id", "artifact", "host_part")


#: Touched partitions up to which their names are broadcast, to prune the old table; above it the join shuffles.
BROADCAST_PARTITIONS = 100_000


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, nulls first. Rows of a key meet as partial maxima, so that one with a third
    of all rows is no burden."""
    row = F.max_by(F.struct(*map(quoted, df.columns)), F.struct(*map(quoted, order)))
    return df.groupBy(*map(quoted, keys)).agg(row.alias("row_")).select("row_.*")


@contextmanager
def _beside(spark: SparkSession, path: str):
    """A new folder beside a table, on the same store; it goes when the work is done."""
    made = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    try:
        yield made
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(made)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def upsert(spark: SparkSession, path: str, new: DataFrame, seq: str = "ingest_seq") -> None:
    """Adds rows (with the partition columns, index_name, _id and a sequence), replacing rows of the same identity.
    Only partitions that the new rows touch are read and written; the old ones are pruned to them. New and merged rows
    are written beside the table first, so that a lost executor never reads files that are being replaced. The writer
    splits large partitions among tasks and merges small ones."""
    from pyspark.errors import AnalysisException

    for c in PARTITIONS:
        new = new.withColumn(c, sanitize(F.col(c)))
    with _beside(spark, path) as beside:
        new.write.parquet(f"{beside}/new")
        new = spark.read.schema(new.schema).parquet(f"{beside}/new")
        try:
            old = spark.read.option("mergeSchema", "true").parquet(path)
            touched = new.select(*PARTITIONS).distinct()
            few = touched.limit(BROADCAST_PARTITIONS + 1).count() <= BROADCAST_PARTITIONS
            both = old.join(F.broadcast(touched) if few else touched, list(PARTITIONS), "left_semi").unionByName(new, allowMissingColumns=True)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            both = new
        out = latest(both, ["index_name", "_id"], [seq])
        out.write.parquet(f"{beside}/merged")
        out = spark.read.schema(out.schema).parquet(f"{beside}/merged")
        out.hint("rebalance", *PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def ingest(spark: SparkSession, path: str, parsed: DataFrame, good: Column, seq: str = "ingest_seq") -> dict[str, int]:
    """Upserts the rows where `good` holds and counts, in the same pass, what was indexed, skipped (no identity) and failed."""
    known = F.col("_id").isNotNull()
    seen = Observation()
    good = F.coalesce(good, F.lit(False))
    watched = parsed.observe(seen, F.count_if(known & good).alias("indexed"), F.count_if(~known).alias("skipped"), F.count_if(known & ~good).alias("failed"))
    upsert(spark, path, watched.where(known & good), seq)
    return seen.get


def read_case(spark: SparkSession, path: str, pattern: str = "case-*") -> DataFrame:
    """Rows whose index matches a comma list of names and wildcards; each must begin with case-."""
    parts = [p.strip() for p in pattern.split(",") if p.strip()]
    if not parts or any(not p.startswith("case-") for p in parts):
        raise ValueError("an index pattern begins with case-")
    df = spark.read.option("mergeSchema", "true").parquet(path)
    index = F.concat_ws("-", F.lit("case"), *map(F.col, PARTITIONS))
    good = F.lit(False)
    for p in parts:
        good = good | index.rlike("^" + ".*".join(map(re.escape, p.split("*"))) + "$")
    return df.where(good)
