"""The label log as a stream: exact repeats dropped, late rows within the watermark kept, counts per window, latest state per item.

An extension: the batch operators need no stream. Each batch replaces a table in the shared folder, so that a
restart goes on from the checkpoint and a repeated batch changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir


def read_history(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The log's files as they arrive; the schema is that of the files there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path}*")  # a pattern may be a single file, too


def window_counts(events: DataFrame, late: str = "60 days", width: str = "30 days") -> DataFrame:
    """(start, userid, n) per event-time window; rows without a time are in none, exact repeats count once."""
    seen = events.filter("ingest_ts IS NOT NULL").withWatermark("ingest_ts", late).dropDuplicates(events.columns)
    return seen.groupBy(F.window("ingest_ts", width).alias("w"), "userid").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "userid", "n")


def run_to_table(df: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is there now, run through the stream to a table in the shared folder."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/table")
