"""Ordered descriptor lists -> vectors in vocabulary order, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def position_weight(pos: Column, top: int = 63, scale: float = 42.0) -> Column:
    return F.greatest((F.lit(top) - pos) / F.lit(scale), F.lit(0.0))


def positions(lists: DataFrame, key: str = "album_id", column: str = "descriptors") -> DataFrame:
    """(key, name, pos): the last place of each name in its list, from 0."""
    return lists.select(key, F.posexplode(column).alias("pos", "name")).groupBy(key, "name").agg(F.max("pos").alias("pos"))


def encode(lists: DataFrame, vocabulary: DataFrame, key: str = "album_id", column: str = "descriptors") -> DataFrame:
    """(key, mood, descriptor_count): weights in vocabulary order, zero where absent; names outside the vocabulary count but have no place."""
    size = vocabulary.count()
    placed = positions(lists, key, column).join(vocabulary, "name").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("descriptor_id", position_weight(F.col("pos")).alias("w")))).alias("at"))
    mood = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(size).cast("long")), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0.0)))
    counted = lists.select(key, F.coalesce(F.greatest(F.size(column), F.lit(0)), F.lit(0)).alias("descriptor_count"))
    return counted.join(placed, key, "left").select(key, mood.alias("mood") if size else F.array().cast("array<double>").alias("mood"), "descriptor_count")


def histogram(lists: DataFrame, column: str = "descriptors") -> DataFrame:
    return lists.select(F.explode(column).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def add_histogram(old: DataFrame, new: DataFrame) -> DataFrame:
    """A running histogram: unseen names start at their first count."""
    return old.unionByName(new).groupBy("name").agg(F.sum("n").alias("n"))


def without(vector: str, drop: list[int]) -> Column:
    """The vector without the places in ``drop`` (from 0)."""
    gone = F.array(*[F.lit(i) for i in drop]) if drop else F.array().cast("array<int>")
    return F.filter(vector, lambda _, i: ~F.array_contains(gone, i))


def weights_of(vectors: DataFrame, key: str = "album_id") -> DataFrame:
    """(key, descriptor_id, weighting) for every weight above zero."""
    return vectors.select(key, F.posexplode("mood").alias("at", "weighting")).where("weighting > 0 and not isnan(weighting)").select(key, (F.col("at") + 1).cast("long").alias("descriptor_id"), "weighting")
