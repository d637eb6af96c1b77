"""Idempotent loading: keys become ids in order of first appearance; a second run adds nothing.

Ids number the distinct new keys only, by first places, range by range, so that no task holds all keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateforge.operators.ranges import numbered


def number_new(rows: DataFrame, keys: list[str], order: list[str], id_name: str, existing: DataFrame | None = None, extra: list[str] | None = None) -> DataFrame:
    """(id, keys, extra) of the keys that ``existing`` lacks, numbered on from its largest id; extra columns are those of the first row."""
    extra = extra or []
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *extra)).alias("_first"))
    if existing is not None:
        first = first.join(existing.select(*[F.col(k).alias(f"_{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
        offset = existing.agg(F.coalesce(F.max(id_name), F.lit(0)).alias("_offset"))
    else:
        offset = None
    placed = numbered(first, [*[F.col("_first").getField(o) for o in order], *[F.col(k) for k in keys]], "_n")
    if offset is not None:
        placed = placed.join(F.broadcast(offset))
    start = F.col("_offset") if offset is not None else F.lit(0)
    return placed.select((F.col("_n") + 1 + start).cast("long").alias(id_name), *keys, *[F.col("_first").getField(e).alias(e) for e in extra])


def get_or_insert(rows: DataFrame, keys: list[str], order: list[str], id_name: str, existing: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The dimension after the load: what there was, and the new keys."""
    return existing.unionByName(number_new(rows, keys, order, id_name, existing, extra).select(*existing.columns))


def insert_unseen(rows: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is new; of several with one key, the first."""
    from crateforge.operators.features import first_of

    return first_of(rows.join(existing.select(*keys), keys, "left_anti"), keys, order)


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Foreign keys that point nowhere."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
