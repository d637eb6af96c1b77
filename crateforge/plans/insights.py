"""The insight queries q01 to q16 and the four variants of the web endpoints, over the catalog's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateforge.plans import catalog as c
from crateforge.plans.registry import query

#: Parameters that the queries bind.
ARTIST, ALBUM = "Customer#000000007", 7


@query("select album_id, title from @album join @features using (album_id) where instrumentalness > (select avg(instrumentalness) from @features) and speechiness < (select avg(speechiness) from @features)")
def q01(spark: SparkSession, d: str) -> DataFrame:
    f = c.features(spark, d)
    means = f.agg(F.avg("instrumentalness").alias("i"), F.avg("speechiness").alias("s"))
    picked = f.join(F.broadcast(means), (F.col("instrumentalness") > F.col("i")) & (F.col("speechiness") < F.col("s")))
    return c.album(spark, d).join(picked, "album_id").select("album_id", "title")


@query("select album_id, title from @album join @features using (album_id) order by duration_ms desc, album_id limit 3")
def q02(spark: SparkSession, d: str) -> DataFrame:
    return c.album(spark, d).join(c.features(spark, d), "album_id").orderBy(F.desc_nulls_last("duration_ms"), "album_id").limit(3).select("album_id", "title")


@query("select name, count(*) number_of_albums from @artist join @album using (artist_id) where album_id < 500 group by name order by 2 desc, name limit 1")
def q03(spark: SparkSession, d: str) -> DataFrame:
    albums = c.album(spark, d).where("album_id < 500").groupBy("artist_id").count()
    return c.artist(spark, d).join(albums, "artist_id").groupBy("name").agg(F.sum("count").alias("number_of_albums")).orderBy(F.desc("number_of_albums"), "name").limit(1)


@query("select distinct name from @artist join @album using (artist_id) join @features using (album_id) group by name having min(instrumentalness) > 5 and min(mode) > 0")
def q04(spark: SparkSession, d: str) -> DataFrame:
    """By name: artists of one name are one."""
    rows = c.album(spark, d).join(c.features(spark, d), "album_id").groupBy("artist_id").agg(F.min("instrumentalness").alias("i"), F.min("mode").alias("m"))
    return c.artist(spark, d).join(rows, "artist_id").groupBy("name").agg(F.min("i").alias("i"), F.min("m").alias("m")).where("i > 5 and m > 0").select("name")


def _recommended(spark: SparkSession, d: str, album_id: int = ALBUM) -> DataFrame:
    """One album's neighbours by title; the album is a bound parameter of the query."""
    edges = c.recommendation(spark, d, album_id)
    return spark.sql("select recommended_id, title, score from {edges} join {album} a on a.album_id = recommended_id where {edges}.album_id = :album_id", args={"album_id": album_id}, edges=edges, album=c.album(spark, d))


@query(f"select recommended_id, title, score from @recommendation r join (select album_id recommended_id, title from @album) using (recommended_id) where r.album_id = {ALBUM} order by score desc, recommended_id")
def q05(spark: SparkSession, d: str) -> DataFrame:
    """The score is a distance, so this order is farthest first."""
    return _recommended(spark, d).orderBy(F.desc("score"), "recommended_id").select("recommended_id", "title", "score")


@query(f"select recommended_id, title, score from @recommendation r join (select album_id recommended_id, title from @album) using (recommended_id) where r.album_id = {ALBUM} order by score, recommended_id limit 3")
def q05_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _recommended(spark, d).orderBy("score", "recommended_id").limit(3).select("recommended_id", "title", "score")


#: Tracks a partition when albums are counted: what a task holds of them (an approximate count has some 400 bytes each) must not grow with the table.
TRACKS = 1 << 20


def _by_descriptors(spark: SparkSession, d: str, count, k: int) -> DataFrame:
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-c.table(spark, d, "lineitem").count() // TRACKS))
    counted = c.album_descriptor(spark, d).repartition(width, "album_id").groupBy("album_id").agg(count.alias("descriptor_count"))
    return c.album(spark, d).join(counted, "album_id").orderBy(F.desc("descriptor_count"), "album_id").limit(k).select("album_id", "title", "descriptor_count")


@query("select album_id, title, count(distinct descriptor_id) descriptor_count from @album join @album_descriptor using (album_id) group by album_id, title order by 3 desc, 1 limit 10")
def q06(spark: SparkSession, d: str) -> DataFrame:
    return _by_descriptors(spark, d, F.count_distinct("descriptor_id"), 10)


def q06_approx(spark: SparkSession, d: str) -> DataFrame:
    """Extension: approximate distinct counts."""
    return _by_descriptors(spark, d, F.approx_count_distinct("descriptor_id"), 10)


query(None)(q06_approx)


@query(f"select album_id, title from @artist join @album using (artist_id) where name = '{ARTIST}'")
def q07(spark: SparkSession, d: str) -> DataFrame:
    c.artist(spark, d).createOrReplaceTempView("q07_artist")
    c.album(spark, d).createOrReplaceTempView("q07_album")
    return spark.sql("select album_id, title from q07_artist join q07_album using (artist_id) where name = :artist", args={"artist": ARTIST})


@query(f"select round(avg(loudness), 6) avg_loudness, round(avg(tempo), 6) avg_tempo from @features join @album using (album_id) join @artist using (artist_id) where name = '{ARTIST}'")
def q08(spark: SparkSession, d: str) -> DataFrame:
    mine = c.album(spark, d).join(c.artist(spark, d).where(F.col("name") == ARTIST), "artist_id")
    return c.features(spark, d).join(mine, "album_id").agg(F.round(F.avg("loudness"), 6).alias("avg_loudness"), F.round(F.avg("tempo"), 6).alias("avg_tempo"))


@query("select album_id, title from @album where uri is null")
def q09(spark: SparkSession, d: str) -> DataFrame:
    return c.album(spark, d).where(F.col("uri").isNull()).select("album_id", "title")


@query("select name, count(*) album_count from @artist join @album using (artist_id) group by name")
def q10(spark: SparkSession, d: str) -> DataFrame:
    albums = c.album(spark, d).groupBy("artist_id").count()
    return c.artist(spark, d).join(albums, "artist_id").groupBy("name").agg(F.sum("count").alias("album_count"))


@query("select album_id, title, count(descriptor_id) descriptor_count from @album join @album_descriptor using (album_id) group by album_id, title order by 3 desc, 1 limit 5")
def q11(spark: SparkSession, d: str) -> DataFrame:
    return _by_descriptors(spark, d, F.count("descriptor_id"), 5)


@query("select album_id, title from @album join @features using (album_id) where mode = 1.0 and key = 1.5")
def q12(spark: SparkSession, d: str) -> DataFrame:
    return c.album(spark, d).join(c.features(spark, d).where("mode = 1.0D and key = 1.5D"), "album_id").select("album_id", "title")


@query("select album_id, title from @album join @features using (album_id) where abs(mode - 0.57575756) < 1e-1 and abs(key - 3) < 1e-6")
def q12_near(spark: SparkSession, d: str) -> DataFrame:
    """Equality within a tolerance, which averaged features need."""
    return c.album(spark, d).join(c.features(spark, d).where("abs(mode - 0.57575756D) < 1e-1 and abs(key - 3) < 1e-6"), "album_id").select("album_id", "title")


@query("select name from @artist join @album using (artist_id) group by name having count(*) = 1")
def q13(spark: SparkSession, d: str) -> DataFrame:
    """By name: artists of one name with an album each have two."""
    return q10(spark, d).where("album_count = 1").select("name")


@query("select name, count(album_id) usage_count from @descriptor join @album_descriptor using (descriptor_id) group by name order by 2 desc, 1 limit 10")
def q14(spark: SparkSession, d: str) -> DataFrame:
    used = c.album_descriptor(spark, d).groupBy("descriptor_id").agg(F.count("album_id").alias("usage_count"))
    return c.descriptor(spark, d).join(used, "descriptor_id").orderBy(F.desc("usage_count"), "name").limit(10).select("name", "usage_count")


@query("select album_id, title from @album join @features using (album_id) where loudness > (select avg(loudness) from @features) and tempo < (select avg(tempo) from @features)")
def q15(spark: SparkSession, d: str) -> DataFrame:
    """Above the average in one feature and below it in another: one pass for both averages, joined as a single row."""
    f = c.features(spark, d)
    means = f.agg(F.avg("loudness").alias("l"), F.avg("tempo").alias("t"))
    return c.album(spark, d).join(f.join(F.broadcast(means), (F.col("loudness") > F.col("l")) & (F.col("tempo") < F.col("t"))), "album_id").select("album_id", "title")


def _edges_by(spark: SparkSession, d: str, side: str) -> DataFrame:
    edges = c.recommendation(spark, d).groupBy(F.col(side).alias("album_id")).count()
    albums = c.album(spark, d).join(edges, "album_id").groupBy("artist_id").agg(F.sum("count").alias("n"))
    return c.artist(spark, d).join(albums, "artist_id").groupBy("name").agg(F.sum("n").alias("recommendation_count")).orderBy(F.desc("recommendation_count"), "name")


@query("select name, count(*) recommendation_count from @artist join @album using (artist_id) join @recommendation r using (album_id) group by name order by 2 desc, 1")
def q16(spark: SparkSession, d: str) -> DataFrame:
    """Edges that leave an artist's albums, as written; most first."""
    return _edges_by(spark, d, "album_id")


@query("select name, count(*) recommendation_count from @artist join @album b using (artist_id) join @recommendation r on r.recommended_id = b.album_id group by name order by 2 desc, 1")
def q16_recommended(spark: SparkSession, d: str) -> DataFrame:
    """Edges that reach an artist's albums, as meant; most first."""
    return _edges_by(spark, d, "recommended_id")


@query("""select album_id, title, artist_id, uri, f.instrumentalness, f.speechiness from @album join @features f using (album_id)
          where f.instrumentalness > coalesce((select avg(instrumentalness) from @features), 0) and f.speechiness > coalesce((select avg(speechiness) from @features), 0)""")
def api_instr(spark: SparkSession, d: str) -> DataFrame:
    f = c.features(spark, d)
    means = f.agg(F.coalesce(F.avg("instrumentalness"), F.lit(0.0)).alias("i"), F.coalesce(F.avg("speechiness"), F.lit(0.0)).alias("s"))
    picked = f.join(F.broadcast(means), (F.col("instrumentalness") > F.col("i")) & (F.col("speechiness") > F.col("s")))
    return c.album(spark, d).join(picked, "album_id").select("album_id", "title", "artist_id", "uri", "instrumentalness", "speechiness")


@query("select album_id, title, a.name artist, duration_ms from @album left join @artist a using (artist_id) left join @features using (album_id) order by duration_ms desc nulls first, album_id limit 3")
def api_longest(spark: SparkSession, d: str) -> DataFrame:
    """Left joins and nulls first: albums without features lead."""
    rows = c.album(spark, d).join(c.features(spark, d), "album_id", "left").orderBy(F.desc_nulls_first("duration_ms"), "album_id").limit(3)
    return rows.join(c.artist(spark, d), "artist_id", "left").select("album_id", "title", F.col("name").alias("artist"), "duration_ms")


@query("select name, count(b.album_id) filter (b.album_id > 500) albums_over_500 from @artist a left join @album b using (artist_id) group by artist_id, name order by count(b.album_id) desc, name limit 1")
def api_top_artist(spark: SparkSession, d: str) -> DataFrame:
    """Ordered by all albums, shown with those above 500."""
    n = c.album(spark, d).groupBy("artist_id").agg(F.count("*").alias("n"), F.count_if(F.col("album_id") > 500).alias("m"))
    return c.artist(spark, d).join(n, "artist_id", "left").orderBy(F.desc(F.coalesce("n", F.lit(0))), "name").limit(1).select("name", F.coalesce("m", F.lit(0)).alias("albums_over_500"))


@query("select artist_id, name from @artist a where not exists (select 1 from @album b left join @features f using (album_id) where b.artist_id = a.artist_id and (f.album_id is null or not (f.instrumentalness > 0 and f.mode > 0)))")
def api_every(spark: SparkSession, d: str) -> DataFrame:
    """Artists none of whose albums violates; an artist without albums is one."""
    rows = c.album(spark, d).join(c.features(spark, d).where("instrumentalness > 0 and mode > 0"), "album_id", "left_anti")
    return c.artist(spark, d).join(rows.select("artist_id"), "artist_id", "left_anti").select("artist_id", "name")
