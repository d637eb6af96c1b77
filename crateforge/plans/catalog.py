"""The star of tables (artist, album, features, descriptor, album_descriptor, recommendation) over the driver's tables.

Averages are exact: sums of integer hundredths over counts, so that any two engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crateforge.operators import knn
from crateforge.operators.ranges import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def mean(c: str) -> Column:
    """Over the tracks that have the feature; null if none has."""
    return F.try_divide(F.sum(cents(c)), F.count(c) * F.lit(100.0))


def artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artist_id"), F.col("c_name").alias("name"))


def album(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("album_id"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_custkey").alias("artist_id"), F.nullif("o_orderstatus", F.lit("P")).alias("uri"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per album with tracks: means of its tracks' features, whatever their number."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("album_id")).agg(
        mean("l_quantity").alias("instrumentalness"), mean("l_discount").alias("speechiness"), (F.sum(cents("l_extendedprice")) / F.lit(100.0)).alias("duration_ms"),
        mean("l_tax").alias("loudness"), mean("l_extendedprice").alias("tempo"), F.avg("l_linenumber").alias("key"),
        F.try_divide(F.count_if(F.col("l_returnflag") == "N"), F.count("l_returnflag")).alias("mode"),
    )


def descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary: names with ids in name order, numbered by ranges."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return numbered(names, ["name"], "n").select((F.col("n") + 1).alias("descriptor_id"), "name")


def descriptor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(album_id, name, pos): each album's descriptors, without repeats, by position from 0."""
    names = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    first = names.groupBy(F.col("l_orderkey").alias("album_id"), F.col("p_name").alias("name")).agg(F.min("l_linenumber").alias("line"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("album_id").orderBy("line", "name")) - 1).drop("line")


def weight(pos: Column) -> Column:
    """Salience of list position ``pos``: 1.5 for the first, never under zero."""
    return F.greatest((F.lit(63) - pos) / F.lit(42.0), F.lit(0.0))


def album_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = descriptor_list(spark, sf_dir).join(descriptor(spark, sf_dir), "name")
    return listed.select("album_id", "descriptor_id", weight(F.col("pos")).alias("weighting"))


def recommendation(spark: SparkSession, sf_dir: str, album_id: int | None = None) -> DataFrame:
    """Edges of every album, or of the one that is asked for: only its vector is then held against the others."""
    vectors = table(spark, sf_dir, "embeddings")
    found = knn.knn_block(vectors, k=5, queries=None if album_id is None else vectors.where(F.col("vec_id") == album_id))
    return found.select(F.col("query_id").alias("album_id"), F.col("neighbour_id").alias("recommended_id"), "rank", F.round("distance", 4).alias("score"))


#: The same in DuckDB's SQL, to be put into parentheses.
SQL = {
    "artist": "select c_custkey artist_id, c_name as name from customer",
    "album": "select o_orderkey album_id, 'Order#' || o_orderkey title, o_custkey artist_id, nullif(o_orderstatus, 'P') uri from orders",
    "features": """select l_orderkey album_id, sum(cast(round(l_quantity * 100) as bigint)) / (count(l_quantity) * 100.0) instrumentalness,
        sum(cast(round(l_discount * 100) as bigint)) / (count(l_discount) * 100.0) speechiness, sum(cast(round(l_extendedprice * 100) as bigint)) / 100.0 duration_ms,
        sum(cast(round(l_tax * 100) as bigint)) / (count(l_tax) * 100.0) loudness, sum(cast(round(l_extendedprice * 100) as bigint)) / (count(l_extendedprice) * 100.0) tempo,
        avg(l_linenumber) as key, cast(count(*) filter (l_returnflag = 'N') as double) / nullif(count(l_returnflag), 0) as mode from lineitem group by l_orderkey""",
    "descriptor": "select cast(row_number() over (order by p_name) as bigint) descriptor_id, p_name as name from (select distinct p_name from part)",
    "descriptor_list": """select album_id, name, row_number() over (partition by album_id order by line, name) - 1 pos from
        (select l_orderkey album_id, p_name as name, min(l_linenumber) line from lineitem join part on l_partkey = p_partkey group by all)""",
    "knn": """select query_id, neighbour_id, rank, distance from (select a.vec_id query_id, b.vec_id neighbour_id, list_distance(a.e, b.e) distance,
        row_number() over (partition by a.vec_id order by list_distance(a.e, b.e), b.vec_id) as rank
        from (select vec_id, cast(embedding as double[]) e from embeddings) a join (select vec_id, cast(embedding as double[]) e from embeddings) b on a.vec_id <> b.vec_id) where rank <= 5""",
}
SQL["album_descriptor"] = f"select album_id, descriptor_id, greatest((63 - pos) / 42.0, 0.0) weighting from ({SQL['descriptor_list']}) join ({SQL['descriptor']}) using (name)"
SQL["recommendation"] = f"select query_id album_id, neighbour_id recommended_id, cast(rank as int) as rank, round(distance, 4) score from ({SQL['knn']})"


def sql(text: str) -> str:
    """``text`` with each @name replaced by the parenthesised definition of that table."""
    for name in sorted(SQL, key=len, reverse=True):
        text = text.replace(f"@{name}", f"({SQL[name]})")
    return text
