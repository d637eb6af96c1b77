"""Joins by an inverted index whose long lists are dealt into blocks, so that no task holds one whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meet(index: DataFrame, probe: DataFrame, keys: list[str], condition: Column, block: int = 4096) -> DataFrame:
    """Rows of ``index`` and ``probe`` with equal ``keys`` that fulfil ``condition``, which is tested inside the join.

    A key's list in the index is dealt into blocks of about ``block`` rows by a hash of the whole row, and the probing
    rows of such a key visit every block. Column names besides the keys must differ.
    """
    long = index.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_blocks")).where("_blocks > 1")
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = index.join(long, keys, "left").withColumn("_block", F.pmod(F.xxhash64(*index.columns), blocks).cast("int")).drop("_blocks")
    asked = probe.join(long, keys, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    return asked.join(dealt, [*keys, "_block"]).where(condition).drop("_block")
