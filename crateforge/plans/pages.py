"""Queries of the page records: pages are written out of the tables, as a site would show them, and read back whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crateforge.functions import pages
from crateforge.functions.text import HOST
from crateforge.operators import lookup
from crateforge.plans import catalog as c
from crateforge.plans.catalog import table
from crateforge.plans.registry import query

#: Rows on a chart page.
PAGE_ROWS = 40
#: Pieces of pages a partition: what a task writes out, and a worker reads, must not grow with the tables.
PIECES = 1 << 16


def tag(name: str, css: str, *inside: Column | str) -> Column:
    """An element with its class and content."""
    return F.concat(F.lit(f'<{name} class="{css}">'), *[x if isinstance(x, Column) else F.lit(x) for x in inside], F.lit(f"</{name}>"))


def _dealt(rows: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """``rows``, about as many as ``of`` has, dealt by their key into partitions of about PIECES, one for each core at least."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-of.count() // PIECES)), key)


def _all(rows: DataFrame, key: str, order: str, html: Column, of: DataFrame) -> DataFrame:
    """(key, html): the pieces of each key in order, one after the other; ``of`` is the table that has them."""
    pieces = _dealt(rows.select(key, F.struct(F.col(order).alias("at"), html.alias("html")).alias("piece")), key, of)
    listed = pieces.groupBy(key).agg(F.array_sort(F.collect_list("piece")).alias("parts"))
    return listed.select(key, F.array_join(F.col("parts").getField("html"), "\n").alias("html"))


def chart_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, html): chart pages of PAGE_ROWS albums each, an album's place being its id; every seventh lacks its counts, every eleventh its genres."""
    rows = c.album(spark, d).join(c.artist(spark, d), "artist_id").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("album_id"), "o_orderdate", "o_totalprice", "o_orderpriority"), "album_id")
    counts = F.concat(tag("span", "topcharts_avg_rating_stat", "3.", (F.col("album_id") % 90 + 10).cast("string")), tag("span", "topcharts_ratings_stat", F.format_number("o_totalprice", 0)), tag("span", "topcharts_reviews_stat", F.format_number(F.col("album_id") * 3, 0)))
    genres = tag("div", "topcharts_item_genres_container", tag("a", "genre", F.col("o_orderpriority")), ", ", tag("a", "genre", "R&amp;B"))
    box = tag(
        "div", "topcharts_itembox chart_item_release",
        tag("div", "topcharts_position", F.col("album_id").cast("string"), tag("span", "dot", ".")), tag("div", "topcharts_item_artist", F.col("name")), tag("div", "topcharts_item_title", F.col("title")),
        tag("div", "topcharts_item_releasedate", " (", F.date_format("o_orderdate", "d MMMM yyyy"), ") "),
        F.when(F.col("album_id") % 11 == 0, F.lit("")).otherwise(genres), F.when(F.col("album_id") % 7 == 0, F.lit("<br>")).otherwise(counts),
    )
    return _all(rows.withColumn("page_id", F.floor(F.col("album_id") / PAGE_ROWS)), "page_id", "album_id", box, table(spark, d, "orders"))


@query("""select cast(o_orderkey as varchar) as rank, c_name artist, 'Order#' || o_orderkey album, strftime(o_orderdate, '%-d %B %Y') date,
    case when o_orderkey % 11 = 0 then 'NA' else o_orderpriority || ', R&B' end genres, case when o_orderkey % 7 = 0 then 'NA' else '3.' || (o_orderkey % 90 + 10) end rym_rating,
    case when o_orderkey % 7 = 0 then 'NA' else cast(cast(round_even(o_totalprice, 0) as bigint) as varchar) end ratings, case when o_orderkey % 7 = 0 then 'NA' else cast(o_orderkey * 3 as varchar) end reviews
    from orders join customer on o_custkey = c_custkey""")
def chart_records(spark: SparkSession, d: str) -> DataFrame:
    """All eight fields of every chart row, "NA" where a row lacks one."""
    return pages.records(chart_pages(spark, d), "chart").drop("page_id", "place")


def album_pages(spark: SparkSession, d: str) -> DataFrame:
    """(album_id, html): an album's page with its table, its tracks and its colours."""
    line = lambda name, value: F.concat(F.lit("<tr><th>"), F.lit(name), F.lit("</th><td>"), value, F.lit("</td></tr>"))
    tracks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("album_id"), "l_linenumber", "l_partkey")
    named = tracks.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").withColumn("at", F.struct("l_linenumber", "p_name"))
    listed = _all(named, "album_id", "at", F.concat(F.lit("<li>"), tag("span", "tracklist_title", tag("span", "rendered_text", " ", F.col("p_name"), " ")), F.lit("</li>")), table(spark, d, "lineitem")).withColumnRenamed("html", "tracks")
    rows = c.album(spark, d).join(c.artist(spark, d), "artist_id").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("album_id"), "o_orderdate", "o_orderpriority"), "album_id")
    rows = _dealt(rows, "album_id", tracks).join(listed, "album_id")
    html = F.concat(
        tag("div", "album_title", F.col("title"), "\n\nBy ", F.col("name")), F.lit('<table class="album_info">'), line("Type", F.lit("Album")), line("Released", F.date_format("o_orderdate", "d MMMM yyyy")),
        line("Genres", F.concat("o_orderpriority", F.lit("\n"), F.coalesce("uri", F.lit("none")))), line("Share", F.lit("x")), F.lit('</table><ul id="tracks">'), F.col("tracks"),
        F.lit('<li class="total">Total</li></ul><table class="color_bar"><tr><td style="background:#00'), F.lpad((F.col("album_id") % 1000).cast("string"), 4, "0"), F.lit(';width:1px"></td></tr></table>'),
    )
    return rows.select("album_id", html.alias("html"))


@query("""select o_orderkey album_id, 'Order#' || o_orderkey as name, c_name artist, strftime(o_orderdate, '%-d %B %Y') released, o_orderpriority || chr(10) || coalesce(nullif(o_orderstatus, 'P'), 'none') genres, 3 fields,
    string_agg(p_name, '|' order by l_linenumber, p_name) tracks, '#00' || right('0000' || (o_orderkey % 1000), 4) colours
    from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by all""")
def album_records(spark: SparkSession, d: str) -> DataFrame:
    """Name, artist, the table without its link for sharing, tracks and colours of every album's page."""
    found = pages.records(album_pages(spark, d), "album", "album_id")
    info = lambda k: F.try_element_at("info", F.lit(k))
    return found.select("album_id", "name", "artist", info("Released").alias("released"), info("Genres").alias("genres"), F.size("info").alias("fields"), F.array_join("track_listing", "|").alias("tracks"), F.array_join("colorscheme", "|").alias("colours"))


def artist_pages(spark: SparkSession, d: str) -> DataFrame:
    """(artist_id, html): an artist's page: headers with what stands beside, followers, and the discography in two sections."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("artist_id"), "c_name", "c_mktsegment", "c_nationkey")
    releases = table(spark, d, "orders").select(F.col("o_custkey").alias("artist_id"), "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    release = tag(
        "div", "disco_release",
        F.concat(F.lit('<a class="album" href="/release/'), F.col("o_orderkey").cast("string"), F.lit('/"> Order#'), F.col("o_orderkey").cast("string"), F.lit("</a>")),
        F.concat(F.lit('<span class="disco_year_ym" title=" '), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit('">'), F.date_format("o_orderdate", "yyyy"), F.lit("</span>")),
        tag("div", "disco_avg_rating", "3.5"), tag("div", "disco_ratings", F.format_number(F.col("o_orderkey") * 7, 0)), tag("div", "disco_reviews", F.format_number("o_totalprice", 0)),
    )
    part = lambda status, name: _all(releases.where(status), "artist_id", "o_orderkey", release, releases).withColumnRenamed("html", name)
    rows = _dealt(customers, "artist_id", releases).join(part("o_orderstatus = 'F'", "f"), "artist_id", "left").join(part("o_orderstatus <> 'F'", "o"), "artist_id", "left")
    section = lambda title, kind, held: F.concat(F.lit(f'<div class="disco_header_top"><h3> {title} </h3></div>\n<div id="disco_type_{kind}">'), F.coalesce(held, F.lit("")), F.lit("</div>"))
    header = lambda name, value: F.concat(tag("div", "info_hdr", name), F.lit("<div>"), value, F.lit("</div>"))
    html = F.concat(
        tag("h1", "artist_name_hdr", " ", F.col("c_name")),
        tag("div", "artist_info", header("Formed", F.concat(F.lit("January 1998, "), "c_mktsegment")), header("Genres", F.col("c_mktsegment")), header("Followers", F.lit("follow"))),
        tag("span", "label_num_followers", F.format_number(F.col("c_nationkey") * 1001, 0), " followers"),
        F.lit('<div id="discography">'), section("Album", "s", F.col("f")), section("EP", "e", F.col("o")), F.lit("</div>"),
    )
    return rows.select("artist_id", html.alias("html"))


@query("select c_custkey artist_id, c_name as name, 'January 1998, ' || c_mktsegment formed, c_mktsegment genres, cast(c_nationkey * 1001 as varchar) followers, 3 fields from customer")
def artist_records(spark: SparkSession, d: str) -> DataFrame:
    """Every artist's headers with what stands beside them; the last has the number of followers."""
    found = pages.records(artist_pages(spark, d), "artist", "artist_id")
    info = lambda k: F.try_element_at("info", F.lit(k))
    return found.select("artist_id", "name", info("Formed").alias("formed"), info("Genres").alias("genres"), info("Followers").alias("followers"), F.size("info").alias("fields"))


DISCO = f"""select c_custkey artist_id, c_name artist, case when o_orderstatus = 'F' then 'Album' else 'EP' end category, 'Order#' || o_orderkey as name, '{HOST}/release/' || o_orderkey || '/' url,
    strftime(o_orderdate, '%-d %B %Y') date, strftime(o_orderdate, '%Y') as year, '3.5' average_rating, cast(o_orderkey * 7 as varchar) ratings, cast(cast(round_even(o_totalprice, 0) as bigint) as varchar) reviews,
    o_orderkey k from orders join customer on o_custkey = c_custkey where o_orderstatus is not null"""


@query(f"select * exclude (k) from ({DISCO})")
def disco_records(spark: SparkSession, d: str) -> DataFrame:
    """Every release of every section of an artist's page."""
    return pages.records(artist_pages(spark, d), "discography", "artist_id").drop("place")


@query(f"select artist_id, name, cast(k % 50 + 1 as varchar) rank_year, cast(1000 + k as varchar) rank_overall, 'rock, folk' genres from ({DISCO}) where k % 3 = 0 union all select artist_id, name, null, null, null from ({DISCO}) where k % 3 <> 0")
def disco_details(spark: SparkSession, d: str) -> DataFrame:
    """The same releases with what their own pages add; two of three have none."""
    k = F.col("o_orderkey")
    shown = F.concat(F.lit("#"), (k % 50 + 1).cast("string"), F.lit(" for "), F.date_format("o_orderdate", "yyyy"), F.lit(", #"), F.format_number(1000 + k, 0), F.lit(" overall"))
    html = F.concat(F.lit('<table class="album_info"><tr><th>Ranked</th><td>'), shown, F.lit("</td></tr><tr><th>Genres</th><td>rock\n folk</td></tr></table>"))
    own = table(spark, d, "orders").where(k % 3 == 0).select(F.concat(F.lit(f"{HOST}/release/"), k.cast("string"), F.lit("/")).alias("url"), html.alias("html"))
    found = pages.with_details(pages.records(artist_pages(spark, d), "discography", "artist_id"), _dealt(own, "url", table(spark, d, "orders")))
    return found.select("artist_id", "name", "rank_year", "rank_overall", F.try_element_at("info", F.lit("Genres")).alias("genres"))


@query("select user_id as album_id, strftime(ts, '%-d %b %Y') date, 'user' || value as user from (select user_id, ts, cast(event_id as varchar) value from events)")
def timeline_records(spark: SparkSession, d: str) -> DataFrame:
    """Dates and users of the catalog lines of every album's page."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("album_id"), "event_id", "ts")
    line = tag("div", "catalog_line", tag("div", "catalog_date", " ", F.date_format("ts", "d MMM yyyy"), " "), tag("span", "catalog_user", "user", F.col("event_id").cast("string")))
    shown = _all(rows, "album_id", "event_id", line, rows).select("album_id", F.concat(F.lit('<div class="catalog_list" id="catalog_list">'), "html", F.lit("</div>")).alias("html"))
    return pages.records(shown, "timeline", "album_id").drop("place")


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every album is asked for; of three, one has a page of its name, one a page that only its address finds, one none."""
    albums = c.album(spark, d).join(c.artist(spark, d), "artist_id").select("album_id", F.concat("title", F.lit(" (Live) & é")).alias("title"), F.col("name").alias("artist"))
    listed = _all(c.descriptor_list(spark, d), "album_id", "pos", F.concat(F.lit(" "), F.col("name"), F.lit(" ,")), table(spark, d, "lineitem")).withColumnRenamed("html", "descriptors")
    named, placed = F.col("album_id") % 3 == 0, F.col("album_id") % 3 == 1
    key = F.when(named, lookup.name_key(F.col("artist"), F.col("title")))
    own = F.when(placed, F.concat(F.lit(f"{HOST}/release/album/"), F.lower(F.replace("artist", F.lit(" "), F.lit("-"))), F.lit("/order#"), F.col("album_id").cast("string"), F.lit("-live-and-e/")))
    pages_of = albums.where(named | placed).join(listed, "album_id", "left").select(key.alias("name"), own.alias("url"), "descriptors")
    return lookup.descriptors(albums.select("artist", "title"), pages_of)


ASKED = "select c_name artist, 'Order#' || o_orderkey || ' (Live) & é' title, o_orderkey k from orders join customer on o_custkey = c_custkey"


@query(f"""select artist, title, case k % 3 when 0 then 'name' when 1 then 'address' end found_by, case when k % 3 < 2 then coalesce(names, '') end descriptors
    from ({ASKED}) left join (select album_id k, string_agg(name, '|' order by pos) names from @descriptor_list group by 1) using (k)""")
def descriptor_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors by name, then by address."""
    return _lookup(spark, d).select("artist", "title", "found_by", F.array_join("descriptors", "|").alias("descriptors"))


@query(f"select artist, title from ({ASKED}) where k % 3 = 2")
def descriptor_not_found(spark: SparkSession, d: str) -> DataFrame:
    """The names as asked, of which there is neither."""
    return lookup.not_found(_lookup(spark, d))
