"""Descriptors of albums: by name, then by the address that the name makes, then not found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateforge.functions.text import HOST, slugify, split_list


def name_key(artist: Column, title: Column) -> Column:
    return F.concat(artist, F.lit(" - "), title)


def address(artist: Column, title: Column) -> Column:
    """Where a release's page lies, by the slugs of its names."""
    return F.concat(F.lit(f"{HOST}/release/album/"), slugify(artist), F.lit("/"), slugify(title), F.lit("/"))


def _first(pages: DataFrame, key: str, as_key: str, as_value: str) -> DataFrame:
    """One page of each key: of several the one whose descriptors come first in order, those without any last."""
    return pages.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(as_key)).agg(F.min("descriptors").alias(as_value), F.lit(True).alias(f"{as_value}_there"))


def descriptors(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """(artist, title, descriptors, found_by) of every asked (artist, title), repeats kept.

    ``pages`` (name, url, descriptors) are found by their name "artist - title"; only where there is none of it, by the address
    of the slugs. A page without descriptors is found, with an empty list; found_by is "name", "address" or null.
    """
    rows = asked.select("artist", "title", name_key(F.col("artist"), F.col("title")).alias("_name"), address(F.col("artist"), F.col("title")).alias("_url"))
    by_name = rows.join(_first(pages, "name", "_name", "of_name"), "_name", "left")
    both = by_name.join(_first(pages, "url", "_url", "of_url"), "_url", "left")
    named, placed = F.col("of_name_there").isNotNull(), F.col("of_url_there").isNotNull()
    text = F.when(named, F.col("of_name")).when(placed, F.col("of_url"))
    listed = F.when(named | placed, F.coalesce(split_list(text), F.array().cast("array<string>")))
    return both.select("artist", "title", listed.alias("descriptors"), F.when(named, "name").when(placed, "address").alias("found_by"))


def not_found(found: DataFrame) -> DataFrame:
    """The asked names, as they were asked, of which there is no page."""
    return found.where(F.col("found_by").isNull()).select("artist", "title")
