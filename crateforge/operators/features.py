"""Feature preparation: scaling, dropping of bad rows, joins by position, first-row dedup, slices by row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1 by its own extremes, found in one pass; a constant column becomes null."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")) for c in columns}
    return df.join(F.broadcast(ends)).withColumns(scaled).select(*df.columns)


def drop_where_zero(df: DataFrame, value: Column) -> DataFrame:
    """Rows whose value is exactly zero go; null and NaN stay."""
    return df.where(~value.eqNullSafe(F.lit(0)))


def zip_join(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Join by explicit row number; rows without a partner go."""
    return left.join(right, row_id)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def slice_closed(df: DataFrame, row_id: str, first: int, last: int) -> DataFrame:
    """Label slice, both ends included."""
    return df.where(F.col(row_id).between(first, last))


def slice_half_open(df: DataFrame, row_id: str, first: int, end: int) -> DataFrame:
    return df.where((F.col(row_id) >= first) & (F.col(row_id) < end))


def row_at(df: DataFrame, row_id: str, number: int) -> DataFrame:
    """The row of a 1-based number; numbers under 1 are refused instead of wrapping around."""
    if number < 1:
        raise ValueError("row numbers start at 1")
    return df.where(F.col(row_id) == number)


def head(df: DataFrame, row_id: str, n: int) -> DataFrame:
    return df.where(F.col(row_id) <= n)


def union_all(*frames: DataFrame) -> DataFrame:
    """Columns aligned by name; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
