"""Shared helpers of the training-data operators: reading, folds, whole rows beside what is found; staging is the library's."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crateforge.sources.staging import discard, stage, tidy  # noqa: F401  the operators stage through this module

SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Fewer rows in an Arrow batch, for what is run inside; the session's own setting is put back."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before) if before is not None else spark.conf.unset(BATCH)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the corpus, by a path only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; a null id counts as remainder 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def sampled(ids: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the distinct doc_ids of ``ids``, or all if they are fewer: those whose hash is small enough; no row is ranked."""
    n = ids.count()
    return ids if n <= most else ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(most / n * (1 << 31)))


def wanted(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns never reach an operator, whatever they are called."""
    return df.select(*[F.col(n) for n in names])


def column_of(docs: DataFrame, name: str) -> str:
    """The column that Spark finds under ``name``, by its own spelling."""
    return next((c for c in docs.columns if c == name), None) or next(c for c in docs.columns if c.lower() == name)


def over_rows(docs: DataFrame, run, combine, schema=None) -> DataFrame:
    """Whole rows of ``docs``, whatever their columns are called, as ``combine`` leaves them beside what ``run`` finds for them.

    ``run`` is a mapInArrow function over (doc_id, text) that yields one batch, in order, for each batch that it gets;
    ``combine`` makes rows of ``schema``, by default that of ``docs``, of such a batch and the rows it belongs to. A row
    crosses to Python once and back once, in slices of SLICE_ROWS rows or about SLICE_BYTES of text.
    """
    from collections import deque

    import pyarrow as pa

    of_id, of_text = docs.columns.index(column_of(docs, "doc_id")), docs.columns.index(column_of(docs, "text"))

    def slices(batch):
        start, held = 0, 0
        for i, text in enumerate(batch.column(of_text).cast(pa.binary())):
            size = len(text.as_buffer()) if text.is_valid else 0
            if i > start and (held + size > SLICE_BYTES or i - start == SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)

    def outer(batches):
        waiting: deque = deque()

        def feed():
            for batch in batches:
                for part in slices(batch):
                    waiting.append(part)
                    yield pa.RecordBatch.from_arrays([part.column(of_id).cast(pa.int64()), part.column(of_text).cast(pa.string())], names=["doc_id", "text"])

        for found in run(feed()):
            yield combine(waiting.popleft(), found)

    return docs.mapInArrow(outer, schema or docs.schema)
