"""A landing directory as a stream: new files are parsed and upserted batch by batch, exactly once by identity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sedgewire.operators.store import upsert


def watch(spark: SparkSession, landing: str, table: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Lines of new files under `landing`, through parse, into the evidence table; a batch run again changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        upsert(batch.sparkSession, table, parse(batch).withColumn("ingest_seq", F.lit(epoch)))

    lines = spark.readStream.text(landing).withColumnRenamed("value", "line")
    out = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
