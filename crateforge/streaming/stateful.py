"""Streams with state: sessions that late events still change, sliding counts, and ids for keys as they come.

A stream lives in a folder of its own: its checkpoint, and its rows, a folder for each batch, so that a batch that is run
again replaces its rows. Running it again on the same folder goes on where it stopped. State is kept by Spark (RocksDB
beside the checkpoint, so in the shared folder); what is read back are the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crateforge.sources.staging import shared_dir
from crateforge.streaming.timeline import hopping, stamped

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


def new_root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run(spark: SparkSession, rows: DataFrame, root: str, schema: str, files_at_once: int | None = None) -> DataFrame:
    """Runs a stream's update rows to the end of its input; all rows of all batches so far, with ``batch``."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/rows/batch=-1")
    write: Callable = lambda found, k: found.write.mode("overwrite").parquet(f"{root}/rows/batch={k}")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        query = rows.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)
    return spark.read.schema(f"{schema}, batch long").option("basePath", f"{root}/rows").parquet(f"{root}/rows")


class Sessions(StatefulProcessor):
    """Of each user the sessions that an event could still change; those whose end the watermark has passed are done."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [tuple(map(int, s)) for s in self.open.get()]
        for part in rows:
            found += [(at, at, 1) for at in part["at"].astype("int64").tolist()]
        merged: list[list[int]] = []
        for first, last, n in sorted(found):
            if merged and first - merged[-1][1] < self.gap:
                merged[-1][1] = max(merged[-1][1], last)
                merged[-1][2] += n
            else:
                merged.append([first, last, n])
        passed = int(timerValues.getCurrentWatermarkInMs()) * 1000
        done = [s for s in merged if s[1] + self.gap <= passed]
        still = [s for s in merged if s[1] + self.gap > passed]
        if still:
            self.open.put([tuple(s) for s in still])
        else:
            self.open.clear()
        both = [(*s, True) for s in done] + [(*s, False) for s in still]
        yield pd.DataFrame({"user_id": [key[0]] * len(both), "first": [s[0] for s in both], "last": [s[1] for s in both], "n": [s[2] for s in both], "done": [s[3] for s in both]})

    def close(self) -> None:
        pass


SESSION_ROWS = "user_id long, first long, last long, n long, done boolean"


def stream_sessions(spark: SparkSession, path: str, schema, gap_seconds: int, late: str = "1 day", root: str | None = None, files_at_once: int | None = None) -> DataFrame:
    """(user_id, start, end, n): a user's runs of events with pauses under the gap, as ``timeline.sessions`` gives them in batch.

    Events may come in any order within ``late``; one that joins two sessions merges them. Every batch writes a user's
    sessions anew, and of a user the last batch's hold, beside those that were done before. Events without a user or a time
    are left out.
    """
    reader = spark.readStream.schema(schema)
    events = stamped((reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)).where("user_id is not null and ts is not null")
    timed = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("at"))
    found = timed.groupBy("user_id").transformWithStateInPandas(Sessions(gap_seconds * MICROS), outputStructType=SESSION_ROWS, outputMode="update", timeMode="eventTime")
    rows = run(spark, found, root or new_root(spark, "sessions"), SESSION_ROWS)
    last = rows.groupBy("user_id").agg(F.max("batch").alias("last_batch"))
    held = rows.join(last, "user_id").where(F.col("done") | (F.col("batch") == F.col("last_batch")))
    return held.select("user_id", F.timestamp_micros("first").alias("start"), F.timestamp_micros(F.col("last") + F.lit(gap_seconds * MICROS)).alias("end"), "n")


def stream_hopping(spark: SparkSession, path: str, schema, size: str = "2 days", step: str = "1 day", late: str = "1 day", root: str | None = None, files_at_once: int | None = None) -> DataFrame:
    """(start, event_type, n): counts in sliding windows, as ``timeline.hopping`` gives them in batch; of a window the last batch holds."""
    reader = spark.readStream.schema(schema)
    events = stamped((reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path))
    rows = run(spark, hopping(events.withWatermark("ts", late), size, step), root or new_root(spark, "hopping"), "start timestamp, event_type string, n long")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


class Ids(StatefulProcessor):
    """Of each bucket of keys the ids given so far, and how many."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known, self.given = handle.getMapState("known", "key string", "id long"), handle.getValueState("given", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bucket, given = int(key[0]), int(self.given.get()[0]) if self.given.exists() else 0
        new: list[tuple[str, int]] = []
        fresh = sorted({k for part in rows for k in part["key"].tolist()})
        for k in fresh:
            if not self.known.containsKey((k,)):
                new.append((k, given * self.buckets + bucket + 1))
                self.known.updateValue((k,), (new[-1][1],))
                given += 1
        if new:
            self.given.update((given,))
        yield pd.DataFrame({"key": pd.Series([k for k, _ in new], dtype=object), "id": pd.Series([i for _, i in new], dtype="int64")})

    def close(self) -> None:
        pass


def stream_ids(spark: SparkSession, path: str, schema, key: str, buckets: int = 64, root: str | None = None, files_at_once: int | None = None) -> DataFrame:
    """(key, id): an id from 1 on for every distinct non-null key, given when it first comes and never changed.

    Keys are dealt into ``buckets`` by hash, each with its own counter, and ids interleave, so that no task sees all keys;
    ids are unique but not without gaps. New keys of one batch are numbered in their own order, so that a batch that is run
    again gives the same ids.
    """
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path).select(F.col(key).cast("string").alias("key")).where("key is not null")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).groupBy("bucket")
    found = dealt.transformWithStateInPandas(Ids(buckets), outputStructType="key string, id long", outputMode="update", timeMode="none")
    return run(spark, found, root or new_root(spark, "ids"), "key string, id long").select("key", "id")
