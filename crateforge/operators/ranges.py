"""Consecutive numbers in an order, without a window that holds all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateforge.sources.staging import stage

_WITHIN = 33  # bits of monotonically_increasing_id that count within a partition


def numbered(rows: DataFrame, order: list[str | Column], name: str = "n") -> DataFrame:
    """``rows`` with a long ``name``, 0 for the first in ``order``, which must be total.

    Rows are sorted by ranges and staged, so that their places are fixed; only the partitions' sizes, one row each, meet
    in one task, and each place is its partition's start plus the place within it.
    """
    placed, _ = stage(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", _WITHIN))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << _WITHIN) - 1))
    return placed.join(F.broadcast(starts), "_part").select(*[F.col(c) for c in rows.columns], place.cast("long").alias(name))
