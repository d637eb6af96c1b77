"""Queries of the file sources and sinks, the scraper's text helpers, and whole recommendation rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateforge.functions import html, text
from crateforge.operators import loader
from crateforge.plans import catalog as c
from crateforge.plans.catalog import table
from crateforge.plans.registry import query
from crateforge.sources import io
from crateforge.sources.staging import shared_dir


def _new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


# -- files -------------------------------------------------------------------------------------------------------

PARTS = "p_partkey long, p_name string, p_retailprice double"


@query("select p_partkey, p_name, p_retailprice from part")
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    """Written with semicolons, read with the separator that the first line shows."""
    path = _new_path(spark, "csv")
    io.write_csv(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), path, ";")
    return io.read_csv(spark, path, PARTS)


@query("select p_partkey, p_name, p_retailprice from part")
def src_csv_index(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated, with eight decimals and an index column that is dropped when it is read."""
    path = _new_path(spark, "tsv")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("_c0"), "p_partkey", "p_name", "p_retailprice")
    io.write_csv(rows, path, "\t", digits=8)
    return io.read_csv(spark, path, PARTS, "\t", index_column=True)


@query("select c_custkey, c_name, c_nationkey % 3 as shard from customer")
def src_glob(spark: SparkSession, d: str) -> DataFrame:
    """Three folders of files, read as one by a pattern."""
    path = _new_path(spark, "glob")
    rows = table(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_nationkey") % 3).cast("long").alias("shard"))
    for k in range(3):
        io.write_csv(rows.where(F.col("shard") == k), f"{path}/shard{k}")
    return io.read_glob(spark, f"{path}/shard*", "c_custkey long, c_name string, shard long").drop("file")


@query("select c_custkey, c_name, c_acctbal from customer")
def src_json(spark: SparkSession, d: str) -> DataFrame:
    path = _new_path(spark, "json")
    io.write_json(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return io.read_json(spark, path, "c_custkey long, c_name string, c_acctbal double", lines=True)


@query("select c_custkey, case when c_custkey % 4 = 0 then 'first' else 'second' end as run from customer")
def resume(spark: SparkSession, d: str) -> DataFrame:
    """A batch that was left after a quarter of the keys and taken up again: no key is worked on twice."""
    path, todo = _new_path(spark, "resume"), table(spark, d, "customer").select("c_custkey")
    io.append_unfinished(todo.where("c_custkey % 4 = 0"), path, "c_custkey", lambda left: left.withColumn("run", F.lit("first")))
    io.append_unfinished(todo, path, "c_custkey", lambda left: left.withColumn("run", F.lit("second")))
    return spark.read.parquet(path)


# -- text --------------------------------------------------------------------------------------------------------


@query("select c_custkey, c_name as title, c_mktsegment as artist from customer")
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    heading = F.concat("c_name", F.lit("\n \nBy "), "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", text.title_and_artist(heading).alias("h")).select("c_custkey", "h.title", "h.artist")


@query("select p_partkey, 'disco_type_' || lower(p_type) as type, 'disco_year_' || p_size as year from part")
def disco_classes(spark: SparkSession, d: str) -> DataFrame:
    classes = F.array(F.lit("item"), F.concat(F.lit("disco_type_"), F.lower("p_type")), F.concat(F.lit("disco_year_"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", *[F.get(text.of_class(classes, f"disco_{k}_"), 0).alias(k) for k in ("type", "year")])


@query("select n_regionkey, string_agg(n_name, ', ' order by n_name) as names from nation group by n_regionkey")
def joined_names(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return listed.select("n_regionkey", text.joined(F.col("names")).alias("names"))


@query("""select p_partkey, p_name || ' ' || p_brand as plain, p_brand || ' - ' || p_name as dashed, p_name || ' ' || left(p_brand, 5) as short,
    'https://rateyourmusic.com/search?searchterm=' || replace(p_name, ' ', '+') as url from part""")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    keys = text.search_keys(F.col("p_brand"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", *[F.get(keys, i).alias(n) for i, n in enumerate(("plain", "dashed", "short"))], text.search_url(F.col("p_name")).alias("url"))


@query("select p_partkey, replace(p_name, ' ', '_') as name from part")
def export_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.export_name(F.concat(F.lit(f"{text.HOST}/artist/"), "p_name", F.lit("/"))).alias("name"))


@query("select o_orderkey, 'Exports/' || cast(epoch(o_orderdate) as bigint) || '_export_album_Order#' || o_orderkey as path, 'Exports/' || cast(epoch(o_orderdate) as bigint) || '_export_chart' as chart from orders")
def export_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths with the time of the export, with and without a name."""
    at, name = F.col("o_orderdate").cast("timestamp"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", text.export_path("album", at, name).alias("path"), text.export_path("chart", at).alias("chart"))


@query("select c_custkey, '#00' || c_nationkey as colour, c_name || ', ' || c_mktsegment as line, cast(1000 + c_nationkey as varchar) as overall from customer")
def scraped_fields(spark: SparkSession, d: str) -> DataFrame:
    """A style's colour, a text of several lines as one, and the rank among all."""
    nation = F.col("c_nationkey")
    style = F.concat(F.lit("color: #00"), nation.cast("string"), F.lit("; width: 1px"))
    ranks = F.concat(F.lit("#3 for 1997, #"), F.format_number(1000 + nation, 0), F.lit(" overall"))
    return table(spark, d, "customer").select(
        "c_custkey", text.colour(style).alias("colour"), text.collapse(F.concat(F.lit(" "), "c_name", F.lit(" \n "), "c_mktsegment", F.lit("\t"))).alias("line"), text.rank_among(ranks, "overall").alias("overall")
    )


@query("select c_custkey, c_mktsegment as genre, c_name as artist, 2 as n_pairs, c_name as last from customer")
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    """Two records of one album as one, the second's values winning; two lists side by side, as long as the shorter."""
    both = text.merged(F.create_map(F.lit("artist"), F.lit("?"), F.lit("genre"), F.col("c_mktsegment")), F.create_map(F.lit("artist"), F.col("c_name")))
    pairs = text.zipped(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array(F.col("c_mktsegment"), F.col("c_name")))
    rows = table(spark, d, "customer").select("c_custkey", both.alias("m"), pairs.alias("pairs"))
    return rows.select("c_custkey", F.col("m")["genre"].alias("genre"), F.col("m")["artist"].alias("artist"), F.size("pairs").alias("n_pairs"), F.get("pairs", 1)["b"].alias("last"))


# -- recommendations ---------------------------------------------------------------------------------------------


@query("select r.album_id, r.rank, r.recommended_id, a.title, t.name as artist, a.uri, r.score from @recommendation r join @album a on a.album_id = r.recommended_id left join @artist t on t.artist_id = a.artist_id")
def recs_named(spark: SparkSession, d: str) -> DataFrame:
    """Every neighbour with its album's title, artist and address."""
    edges, albums = c.recommendation(spark, d), c.album(spark, d).withColumnRenamed("album_id", "recommended_id")
    named = edges.join(albums, "recommended_id").join(c.artist(spark, d), "artist_id", "left")
    return named.select("album_id", "rank", "recommended_id", "title", F.col("name").alias("artist"), "uri", "score")


SLOTS = "select album_id row_id, 0 slot, album_id from @album where album_id in (select vec_id from embeddings) union all select album_id, rank, recommended_id from @recommendation"


def _slots(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    """(row_id, slot, album_id): each row's own album, then its neighbours by rank; of the first ``most`` rows if asked."""
    own = c.album(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("album_id")), "album_id", "left_semi").select(F.col("album_id").alias("row_id"), F.lit(0).alias("slot"), "album_id")
    slots = own.unionByName(c.recommendation(spark, d).select(F.col("album_id").alias("row_id"), F.col("rank").alias("slot"), F.col("recommended_id").alias("album_id")))
    return slots if most is None else slots.join(own.select("row_id").orderBy("row_id").limit(most), "row_id", "left_semi")


FIRST_SEEN = "select row_number() over (order by min(row_id * 6 + slot)) artist_key, artist_id from ({slots}) join @album using (album_id) group by artist_id"


def _artist_keys(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    seen = _slots(spark, d, most).join(c.album(spark, d).select("album_id", "artist_id"), "album_id")
    return loader.number_new(seen, ["artist_id"], ["row_id", "slot"], "artist_key")


@query(FIRST_SEEN.format(slots=SLOTS))
def process_rows(spark: SparkSession, d: str) -> DataFrame:
    """Artists numbered as a load meets them: row by row, the row's own album first, then its neighbours."""
    return _artist_keys(spark, d)


@query(FIRST_SEEN.format(slots=f"select * from ({SLOTS}) where row_id in (select vec_id from embeddings join @album on vec_id = album_id order by vec_id limit 11)"))
def process_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same for a load that is told to end after 11 rows; the limit is the feature."""
    return _artist_keys(spark, d, 11)


@query("select max(n) most from (select count(*) n from @descriptor_list group by album_id)")
def most_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return c.descriptor_list(spark, d).groupBy("album_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))


# -- pages and answers -------------------------------------------------------------------------------------------

BESIDE = "regexp_extract(html, '</nav>(?:<!--[^>]*-->)?<div class=\"ad\">([^<]*)</div>', 1)"


@query(f"select page_id, len({BESIDE}) > 0 as found, md5(regexp_replace({BESIDE}, '\\s', '', 'g')) as digest from pages where html is not null")
def page_siblings(spark: SparkSession, d: str) -> DataFrame:
    """What stands beside each page's first list of links; its white space is left out of the digest."""
    beside = F.coalesce(F.get(html.labelled(F.col("html"), "nav", "div"), 0).getField("value"), F.lit(""))
    found = table(spark, d, "pages").where("html is not null").select("page_id", beside.alias("value"))
    return found.select("page_id", (F.length("value") > 0).alias("found"), F.md5(F.replace("value", F.lit(" "), F.lit("")).cast("binary")).alias("digest"))


@query("select name, status, n from (values ('regions', 200, (select count(*) from region)), ('nothing', 404, null)) t(name, status, n)")
def api_answers(spark: SparkSession, d: str) -> DataFrame:
    """A known query's answer and an unknown one's."""
    known = {"regions": lambda: table(spark, d, "region").select("r_regionkey", "r_name")}
    answers = [io.answer(spark, known, n, ["r_regionkey"]).withColumn("name", F.lit(n)) for n in ("regions", "nothing")]
    rows = F.from_json("body", "results array<struct<r_regionkey:long>>").getField("results")
    return answers[0].unionByName(answers[1]).select("name", "status", F.when(rows.isNotNull(), F.size(rows).cast("long")).alias("n"))


@query("select (row_number() over (order by o_orderkey) - 1) // 1000 page, o_orderkey, o_orderstatus from orders")
def api_pages(spark: SparkSession, d: str) -> DataFrame:
    """A result too large for one answer, as JSON documents of 1,000 rows, read back."""
    body = io.json_pages(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    rows = F.from_json("body", "results array<struct<o_orderkey:long,o_orderstatus:string>>").getField("results")
    return body.select("page", F.inline(rows))
