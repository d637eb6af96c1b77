"""Records of hand-written pages."""

import random

from pyspark.sql import functions as F

from crateforge.functions import pages
from crateforge.operators import lookup
from crateforge.plans import pages as plans

CHART = """
<div class="topcharts_itembox chart_item_release">
  <div class="topcharts_position">1<span>.</span></div><div class="topcharts_item_artist">Radiohead</div>
  <div class="topcharts_item_title">OK Computer</div><div class="topcharts_item_releasedate"> (16 June 1997) </div>
  <div class="topcharts_item_genres_container"><a class="genre comma_separated">Alternative Rock</a><a class="genre">Art Rock</a><a class="other">x</a></div>
  <span class="topcharts_avg_rating_stat">4.23</span><span class="topcharts_ratings_stat">71,203</span><span class="topcharts_reviews_stat">1,501</span>
</div>
<div class="topcharts_itembox"><div class="topcharts_position">2.</div><script>var x = "<div class='topcharts_itembox'>";</script>
  <div class="topcharts_item_title">Untitled &amp; Unread</div><span class="topcharts_avg_rating_stat">4.00</span></div>
"""
ALBUM = """<div class="album_title">Get to Heaven

By Everything Everything</div><table class="album_info">
<tr><th>Type</th><td> Album </td></tr><tr><th>Released</th><td>22 June 2015</td></tr><tr><th>Language</th><td>English</td></tr>
<tr><th>Genres</th><td>Art Pop, Progressive Pop, Indie Rock
Indietronica, Alternative Dance, New Wave</td></tr><tr><th>Share</th><td>x</td></tr><tr><td>no header</td></tr></table>
<ul id="tracks"><li><span class="tracklist_title"><span class="rendered_text">To the Blade</span> 4:24</span></li>
<li><span class="tracklist_title"><span class="rendered_text"> Distant Past </span></span></li><li>Total length</li></ul>
<table class="color_bar"><tr><td style="background:#f47b50;width:9%"></td><td style="background: #8da3c8"></td><td></td></tr></table>"""
ARTIST = """<h1 class="artist_name_hdr"> Pinback </h1><div class="artist_info"><div class="info_hdr">Formed</div><div>January 1998, San Diego, CA, United States</div>
<div class="info_hdr">Share</div><div>links</div><div class="info_hdr">Genres</div><div>Indie Rock, Indie Pop</div>
<div class="info_hdr">Followers</div><div><button>Follow</button></div></div><span class="label_num_followers">1,234 followers</span>
<div id="discography"><div class="disco_header_top"><h3>Album</h3></div>
<div id="disco_type_s"><div class="disco_release"><a class="album" href="/release/album/pinback/one/">One &#38; Two</a><span class="disco_year_ymd" title=" 12 October 1999 ">1999</span>
<div class="disco_avg_rating">3.61</div><div class="disco_ratings">2,345</div><div class="disco_reviews">45</div></div><div class="disco_release"><a class="album">No address</a></div></div>
<div class="disco_header_top"><h3>EP</h3></div><p>between</p><div id="disco_type_e"></div></div>"""
TIMELINE = """<div class="catalog_list" id="catalog_list"><div class="catalog_line"><div class="catalog_date"> 3 Mar 2021 </div><span class="catalog_user">anna</span></div>
<div class="catalog_line"><div class="catalog_date">13 Aug 2004</div></div></div><div class="catalog_line">outside</div>"""


def _records(spark, kind, *html):
    rows = spark.createDataFrame(list(enumerate(html)), "page_id int, html string")
    return [r.asDict(True) for r in pages.records(rows, kind).orderBy("page_id", "place").collect()]


def test_chart_rows(spark):
    first, second = _records(spark, "chart", CHART)
    assert first == {"page_id": 0, "place": 1, "rank": "1", "artist": "Radiohead", "album": "OK Computer", "date": "16 June 1997", "genres": "Alternative Rock, Art Rock", "rym_rating": "4.23", "ratings": "71203", "reviews": "1501"}
    assert second == {"page_id": 0, "place": 2, "rank": "2", "artist": "NA", "album": "Untitled & Unread", "date": "NA", "genres": "NA", "rym_rating": "NA", "ratings": "NA", "reviews": "NA"}


def test_album(spark):
    assert _records(spark, "album", ALBUM) == [{
        "page_id": 0, "place": 1, "name": "Get to Heaven", "artist": "Everything Everything",
        "info": {"Type": "Album", "Released": "22 June 2015", "Language": "English", "Genres": "Art Pop, Progressive Pop, Indie Rock\nIndietronica, Alternative Dance, New Wave"},
        "track_listing": ["To the Blade", "Distant Past"], "colorscheme": ["#f47b50", "#8da3c8"],
    }]
    bare = _records(spark, "album", '<div class="album_title">Alone</div>')
    assert bare == [{"page_id": 0, "place": 1, "name": "Alone", "artist": None, "info": {}, "track_listing": [], "colorscheme": []}]


def test_artist(spark):
    assert _records(spark, "artist", ARTIST) == [{"page_id": 0, "place": 1, "name": "Pinback", "info": {"Formed": "January 1998, San Diego, CA, United States", "Genres": "Indie Rock, Indie Pop", "Followers": "1234"}}]
    assert _records(spark, "artist", '<h1 class="artist_name_hdr">A</h1>') == [{"page_id": 0, "place": 1, "name": "A", "info": {}}]


def test_timeline(spark):
    assert [(r["date"], r["user"]) for r in _records(spark, "timeline", TIMELINE)] == [("3 Mar 2021", "anna"), ("13 Aug 2004", None)]


def test_discography_and_its_pages(spark):
    first, second = _records(spark, "discography", ARTIST)
    assert first == {
        "page_id": 0, "place": 1, "artist": "Pinback", "category": "Album", "name": "One & Two", "url": "https://rateyourmusic.com/release/album/pinback/one/", "date": "12 October 1999", "year": "1999",
        "average_rating": "3.61", "ratings": "2345", "reviews": "45",
    }
    assert second == {**dict.fromkeys(first), "page_id": 0, "place": 2, "artist": "Pinback", "category": "Album", "name": "No address"}
    own = '<table class="album_info"><tr><th>Ranked</th><td>#3 for 1999, #1,204 overall</td></tr><tr><th>Genres</th><td>Indie\n Pop</td></tr></table>'
    disco = pages.records(spark.createDataFrame([(0, ARTIST)], "page_id int, html string"), "discography")
    more = spark.createDataFrame([(first["url"], own), (first["url"], own), (None, own)], "url string, html string")
    found = {r.name: r for r in pages.with_details(disco, more).collect()}
    assert (found["One & Two"].rank_year, found["One & Two"].rank_overall, found["One & Two"].info["Genres"]) == ("3", "1204", "Indie, Pop")
    assert (found["No address"].rank_year, found["No address"].rank_overall, found["No address"].info) == (None, None, None)


def test_broken_and_empty_pages(spark):
    deep = "<p>" * 5000 + '<div class="topcharts_itembox"><div class="topcharts_position">7.'
    for kind in pages.KINDS:
        assert _records(spark, kind, None, "", "<<<>&#x;</div></p>", "plain") == []
    assert [r["rank"] for r in _records(spark, "chart", deep)] == ["7"]


def test_many_pages_keep_their_order(spark):
    rows = spark.range(200).select(F.col("id").alias("page_id"), F.lit(CHART).alias("html")).repartition(7)
    found = pages.records(rows, "chart")
    assert found.count() == 400 and found.where("(place = 1) <> (artist = 'Radiohead')").count() == 0


def test_lookup_by_name_then_by_address(spark):
    asked = spark.createDataFrame([("Sigur Rós", "( )"), ("Beyoncé", "4 / Live & More"), ("Low", "Ones"), ("Low", "Ones"), (None, "x"), ("Nobody", "Knows")], "artist string, title string")
    have = spark.createDataFrame(
        [
            ("Sigur Rós - ( )", "https://rateyourmusic.com/release/album/x/y/", " cold , atmospheric,, "), ("Other", "https://rateyourmusic.com/release/album/beyonce/4-live-and-more/", "warm"),
            ("Low - Ones", "https://rateyourmusic.com/release/album/low/ones/", None), (None, "https://rateyourmusic.com/release/album/low/ones/", "slow"), (None, None, "lost"),
        ],
        "name string, url string, descriptors string",
    )
    found = lookup.descriptors(asked, have)
    rows = sorted((tuple(r) for r in found.collect()), key=str)
    assert rows == sorted(
        [("Sigur Rós", "( )", ["cold", "atmospheric"], "name"), ("Beyoncé", "4 / Live & More", ["warm"], "address"), ("Low", "Ones", [], "name"), ("Low", "Ones", [], "name"), (None, "x", None, None), ("Nobody", "Knows", None, None)], key=str
    )
    assert sorted((tuple(r) for r in lookup.not_found(found).collect()), key=str) == [("Nobody", "Knows"), (None, "x")]


def test_album_titles_cut_within_a_reference(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    titles = ["a &amp;&amp;&amp", "b &lt;x&gt; &quot;c&quot; &#39;d&#39; &am", "&", "e & f &amp;lt;", "&amp", "g &#3"]
    rows = [(i, f"<html><head><title>{t}</title></head><body><ul><li>1</li><li>2</li></ul></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = set(con.execute(oracle_sql()["album_infos"]).fetchall())
    assert {tuple(r) for r in queries()["album_infos"](spark, str(tmp_path)).collect()} == want


def _shape(node):
    return node.tag, node.attrs, node.classes, [c if isinstance(c, str) else _shape(c) for c in node.children]


def test_plain_markup_is_read_as_by_the_tolerant_reader():
    plain = '<div class="a b"> </div> <br> <td style="x:1;y:2"> text R&amp;B &lt 0>1 <a href="/x?y=1" class="album"> </a> <x1> </h1> </span> é'.split(" ")
    odd = "<br/> <p < > </ <!-- <script> </script> <SPAN> </SPAN> <i class='q'> <title> </title> <textarea> <b> </b > &#39; <1> <img src=\"&amp;\"> <?pi?>".split(" ")
    rnd, seen = random.Random(3), 0
    for k in range(4000):
        page = "".join(rnd.choice(plain + odd * (k % 2)) for _ in range(rnd.randrange(10)))
        reader = pages._Tree()
        reader.feed(page)
        reader.close()
        assert _shape(pages.tree(page)) == _shape(reader.root), page
        seen += bool(pages.PLAIN.fullmatch(page))
    assert seen > 1400


def test_pages_are_dealt_to_every_core(spark):
    """Before, small stages were put together again, and one task read all artists' pages."""
    for made in (plans.artist_pages, plans.album_pages, plans.chart_pages):
        assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert [r["rank"] for r in _records(spark, "chart", *[CHART] * 5000)] == ["1", "2"] * 5000  # more records than leave at once
