"""Pairs of strings within a few edits, by the pigeonhole principle.

A string of more than ``edits`` characters is cut into edits + 1 segments. A string as long or longer within that many
edits holds one of them unchanged, and at a place that the difference in length and the segment's number bound (Li, Deng
and Feng's partition-based join). So segments are an inverted index (length, number, content), the longer string looks up
its substrings at the possible places, and only pairs that meet there are compared, inside the join.

For one edit the halves of short strings are common, so that most pairs that share one are far apart. There a string is
listed under itself and each of its deletions instead: two strings within one edit share one of these, and those that do are
at most two edits apart.

Strings of ``edits`` characters or fewer cannot be cut: two of them are always within the edits; one of them and a longer
string must share a character, as the longer one needs more than ``edits`` edits otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateforge.operators.blocks import meet
from crateforge.sources.staging import stage


def _segment(number: Column, length: Column, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of a segment (numbered from 0): the last ones are one longer where the cut is uneven."""
    parts = edits + 1
    small = F.floor(length / F.lit(parts)).cast("int")
    late = F.pmod(length, F.lit(parts))
    before = F.greatest(number - (F.lit(parts) - late), F.lit(0))
    return (number * small + before + 1).cast("int"), (small + F.when(number >= F.lit(parts) - late, 1).otherwise(0)).cast("int")


def segments(strings: DataFrame, edits: int) -> DataFrame:
    """The index (other, length, number, part) of the distinct ``strings`` (name) that can be cut."""
    rows = strings.select(F.col("name").alias("other"), F.length("name").alias("length")).where(F.col("length") > edits)
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(edits))))
    start, size = _segment(F.col("number"), F.col("length"), edits)
    return rows.select("other", "length", "number", F.substring(F.col("other"), start, size).alias("part"))


def probes(strings: DataFrame, edits: int) -> DataFrame:
    """(name, length, number, part): the substrings of each name that a segment of a string no longer can equal."""
    rows = strings.select("name", F.length("name").alias("own")).where(F.col("own") > edits)
    rows = rows.withColumn("length", F.explode(F.sequence(F.greatest(F.lit(edits + 1), F.col("own") - edits), F.col("own"))))
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(edits))))
    start, size = _segment(F.col("number"), F.col("length"), edits)
    apart, rest = F.col("own") - F.col("length"), F.lit(edits) - F.col("number")
    low = F.greatest(start - F.col("number"), start + apart - rest, F.lit(1))
    high = F.least(start + F.col("number"), start + apart + rest, F.col("own") - size + 1)
    rows = rows.withColumn("size", size).withColumn("at", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    return rows.select("name", "length", "number", F.substring(F.col("name"), F.col("at"), F.col("size")).alias("part")).distinct()


def _ahead() -> Column:
    """Each pair meets from one side only: from its longer string, of equals from the later one."""
    return (F.length("name") > F.length("other")) | ((F.length("name") == F.length("other")) & (F.col("name") > F.col("other")))


def candidates(strings: DataFrame, edits: int) -> DataFrame:
    """The distinct pairs (name, other) that share a segment; ``edit_join`` compares no others of those that can be cut."""
    names = strings.select("name").where("name is not null").distinct()
    return meet(segments(names, edits), probes(names, edits), ["length", "number", "part"], _ahead()).select("name", "other").distinct()


def deletions(strings: DataFrame) -> DataFrame:
    """(name, part): each string, and what it is without one of its characters."""
    cut = lambda at: F.concat(F.substring(F.col("name"), F.lit(1), at - 1), F.substring(F.col("name"), at + 1, F.length("name")))
    parts = F.transform(F.sequence(F.lit(0), F.length("name")), lambda at: F.when(at == 0, F.col("name")).otherwise(cut(at)))
    return strings.select("name", F.explode(F.array_distinct(parts)).alias("part"))


def edit_join(strings: DataFrame, edits: int, block: int = 4096) -> DataFrame:
    """(first, second, distance) of all pairs first < second of distinct non-null ``strings`` (name) within ``edits`` edits.

    Empty strings are strings; no edits give no pairs of distinct strings; an empty table gives no rows.
    """
    if edits < 1:
        return strings.sparkSession.createDataFrame([], "first string, second string, distance long")
    names = strings.select("name").where("name is not null").distinct()
    near = F.levenshtein("name", "other", edits) >= 0
    if edits == 1:
        listed, _ = stage(deletions(names))
        pairs = meet(listed.withColumnRenamed("name", "other"), listed, ["part"], (F.col("name") < F.col("other")) & near, block)
        return pairs.select(F.col("name").alias("first"), F.col("other").alias("second")).distinct().withColumn("distance", F.lit(1).cast("long"))
    cut = meet(segments(names, edits), probes(names, edits), ["length", "number", "part"], _ahead() & near, block).select("name", "other")

    def letters(rows: DataFrame, column: str) -> DataFrame:
        at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))))
        return rows.withColumn("at", at).select(F.col("name").alias(column), F.substring(F.col("name"), F.col("at"), F.lit(1)).alias("letter")).distinct()

    small, more = names.where(F.length("name") <= edits), names.where((F.length("name") > edits) & (F.length("name") <= 2 * edits))
    mixed = meet(letters(small, "other"), letters(more, "name"), ["letter"], near, block).select("name", "other")
    every = small.select("name", F.lit(1).alias("all"))
    tiny = meet(every.withColumnRenamed("name", "other"), every, ["all"], F.col("name") > F.col("other"), block).select("name", "other")
    pairs = cut.unionByName(mixed).unionByName(tiny).distinct()
    first, second = F.least("name", "other"), F.greatest("name", "other")
    return pairs.select(first.alias("first"), second.alias("second"), F.levenshtein("name", "other").cast("long").alias("distance"))
