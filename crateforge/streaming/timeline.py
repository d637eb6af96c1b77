"""Timelines: daily and windowed counts of dated events, the same expressions for batch and stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateforge.sources.staging import shared_dir


def stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame) -> DataFrame:
    """(day, n): events per day."""
    return events.groupBy(F.window("ts", "1 day").getField("start").cast("date").alias("day")).agg(F.count("*").alias("n"))


def hopping(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    w = F.window("ts", size, step)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): runs of a user's events with no pause longer than the gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def stream_daily(spark: SparkSession, path: str, schema, late: str = "1 day") -> DataFrame:
    """(day, n) of what is in ``path``, counted as a stream to its end; events later than the watermark are left out.

    Each batch writes the days that it changes into a folder of its own in the shared folder, beside the stream's
    checkpoint, so that a batch that is run again replaces its rows; of each day the last batch holds.
    """
    root = f"{shared_dir(spark).rstrip('/')}/timeline-{uuid.uuid4().hex}"
    spark.createDataFrame([], "day date, n long").write.parquet(f"{root}/rows/batch=-1")
    counted = daily(stamped(spark.readStream.schema(schema).parquet(path)).withWatermark("ts", late))
    write = lambda rows, k: rows.write.mode("overwrite").parquet(f"{root}/rows/batch={k}")
    query = counted.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    rows = spark.read.schema("day date, n long, batch long").option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    return rows.groupBy("day").agg(F.max_by("n", "batch").alias("n"))
