"""Fuzzy matching by edit distance (in the JVM) and by the standard library's ratio (Arrow batches, for pairs that can reach it)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateforge.operators.blocks import meet


def distance_share(a: Column, b: Column) -> Column:
    """Edit distance over the longer length, case ignored: 0 equal, 1 nothing in common; null if either is null."""
    return F.try_divide(F.levenshtein(F.lower(a), F.lower(b)), F.greatest(F.length(a), F.length(b)))


def search(corpus: DataFrame, text: str, columns: list[str], key: str, threshold: float = 0.3, first: int = 5, skip: int = 0) -> DataFrame:
    """Rows in which some column is within the threshold, best first, a page of them; no search for blank text."""
    if not text.strip():
        return corpus.limit(0).withColumn("share", F.lit(None).cast("double"))
    share = F.least(*[distance_share(F.col(c), F.lit(text)) for c in columns]) if len(columns) > 1 else distance_share(F.col(columns[0]), F.lit(text))
    found = corpus.withColumn("share", share).where(F.col("share") <= threshold)
    return found.orderBy("share", key).offset(skip).limit(first)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sequence ratio of strings that are already in lower case, 0 to 1; null with null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)], dtype="float64")


def marked(text: Column) -> Column:
    """The characters of a text, each with how often it has stood there so far: equal characters meet as often as both texts have them."""
    letter = lambda i: F.substring(text, i, F.lit(1))
    count = lambda i: F.length(F.substring(text, F.lit(1), i)) - F.length(F.replace(F.substring(text, F.lit(1), i), letter(i), F.lit("")))
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(letter(i), count(i).cast("string")))


def _prefixes(rows: DataFrame, rarity: DataFrame, key: str, cutoff: float) -> DataFrame:
    """(key, marks, mark): the rarest marks of each text, as many as a text that reaches the cutoff cannot all lack.

    A ratio of ``cutoff`` needs 2 M >= cutoff (a + b) equal characters M, and M <= b, hence M >= cutoff a / (2 - cutoff).
    """
    spread = rows.select(key, F.explode("marks").alias("mark")).join(rarity, "mark")
    ordered = spread.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "mark"))).alias("by_n"))
    least = F.ceil(F.size("by_n") * F.lit(cutoff / (2 - cutoff)) - F.lit(1e-9)).cast("int")
    first = F.slice(F.col("by_n").getField("mark"), F.lit(1), F.greatest(F.size("by_n") - least + 1, F.lit(1)))
    return ordered.select(key, F.explode(first).alias("mark")).join(rows, key)


def _pairs(words: DataFrame, possibilities: DataFrame, word: str, name: str, cutoff: float) -> DataFrame:
    """Distinct pairs (word, name) that share a rare mark and whose characters alone could reach the cutoff; all in the JVM."""
    lowered = lambda rows, c, low, marks: rows.select(c).where(F.col(c).isNotNull()).distinct().withColumn(low, F.lower(c)).withColumn(marks, marked(F.col(low)))
    left, right = lowered(words, word, "_w", "marks"), lowered(possibilities, name, "_n", "marks")
    seen = left.select(F.explode("marks").alias("mark")).unionByName(right.select(F.explode("marks").alias("mark")))
    rarity = seen.groupBy("mark").agg(F.count("*").alias("n"))
    asked = _prefixes(left, rarity, word, cutoff).withColumnRenamed("marks", "_word_marks")
    index = _prefixes(right, rarity, name, cutoff).withColumnRenamed("marks", "_name_marks")
    a, b = F.size("_word_marks"), F.size("_name_marks")
    bound = F.lit(2.0) * F.size(F.array_intersect("_word_marks", "_name_marks")) / (a + b)
    met = meet(index, asked, ["mark"], (F.lit(2.0) * F.least(a, b) / (a + b) >= cutoff) & (bound >= cutoff))
    return met.select(word, name, "_w", "_n").distinct()


def close_matches(words: DataFrame, possibilities: DataFrame, word: str = "word", name: str = "name", n: int = 3, cutoff: float = 0.6) -> DataFrame:
    """The ``n`` closest names of each word with at least the cutoff, by the sequence ratio in lower case.

    The ratio counts equal characters, so that the number of characters two texts share bounds it from above. Pairs are
    found by their rarest characters and held against that bound in the join; the ratio itself, in Python, is asked for
    the survivors only. The cutoff must be above 0 (difflib asks for at least that) and at most 1; null words and names
    have no matches; two empty texts are equal, which the ratio says is 1.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff lies above 0 and is at most 1")
    blank = words.select(word).distinct().where(F.length(word) == 0).join(possibilities.select(name).distinct().where(F.length(name) == 0))
    pairs = _pairs(words, possibilities, word, name, cutoff)
    scored = pairs.withColumn("ratio", ratio(F.col("_w"), F.col("_n"))).where(F.col("ratio") >= cutoff).select(word, name, "ratio")
    scored = scored.unionByName(blank.select(word, name, F.lit(1.0).alias("ratio")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(word).orderBy(F.desc("ratio"), name))).where(F.col("rank") <= n)
