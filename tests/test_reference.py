"""Differential tests against DuckDB, and rules that hold for any data."""

import datetime
import decimal
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crateforge.functions import fuzzy, html, text
from crateforge.operators import encode, features, knn, loader
from crateforge.operators.ranges import numbered
from crateforge.plans import catalog, graphs, insights, pages, pipelines, records  # noqa: F401
from crateforge.plans.registry import ORACLE_SQL, QUERIES
from crateforge.sources import io
from crateforge.streaming import timeline

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return float(f"{float(value):.9g}")
    return str(value)[:10] if isinstance(value, (datetime.date, datetime.datetime)) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name in ORACLE_SQL:
        want = duck.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
        assert sorted(duck.sql(ORACLE_SQL[name]).columns) == columns
        assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)
    else:
        assert got


#: Queries whose rows have an order: those that the reference sorts, and pages of a search.
SORTED = ["q02", "q03", "q05", "q05_nearest", "q06", "q11", "q14", "q16", "q16_recommended", "api_longest", "api_top_artist", "fuzzy_search", "fuzzy_next_page", "fuzzy_search_both"]


@pytest.mark.parametrize("name", SORTED)
def test_order(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    got = [tuple(map(plain, r)) for r in df.select(*want.columns).collect()]
    assert got == [tuple(map(plain, r)) for r in want.fetchall()] and got


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_knn_rules(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.standard_normal(20).round(2).tolist()) for i in range(40)] + [(40, [1.0] * 20), (41, [1.0] * 20), (42, None)]
    df = vectors(spark, rows)
    block = {tuple(r) for r in knn.knn_block(df, 3, slider=0.5).collect()}
    tiled = {tuple(r) for r in knn.knn_block(df, 3, slider=0.5, limit=0, block=7).collect()}
    assert block == tiled and len(block) == 3 * 42
    assert all(q != n for q, n, _, _ in block)
    assert {(q, n, r) for q, n, r, d in block if d == 0} == {(40, 41, 1), (41, 40, 1)}
    by = {(q, n): d for q, n, _, d in block}
    x = dict(rows)
    s = 0.125
    for (q, n), d in list(by.items())[:30]:
        a, b = np.array(x[q], np.float32).astype(float), np.array(x[n], np.float32).astype(float)
        assert abs(d - math.sqrt(((a - b)[:13] ** 2).sum() + ((a - b)[13:] ** 2).sum() / s**2)) < 1e-9
        assert (n, q) not in by or abs(by[n, q] - d) < 1e-12
    assert knn.knn_block(df.limit(0)).count() == 0 and knn.slider_weight(0) == 1e-5 and knn.slider_weight(-1) == 1e-5
    one = [tuple(r) for r in knn.recommend(df, 5, 3, slider=0.5).collect()]
    assert set(one) == {r for r in block if r[0] == 5}
    with pytest.raises(ValueError):
        knn.recommend(df, -1)


def test_lsh_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    exact = {(r.query_id, r.neighbour_id) for r in knn.knn_block(df, 5, audio=10**6).collect()}
    near = {(r.query_id, r.neighbour_id) for r in knn.knn_lsh(df, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_features(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, None, 5.0), (3, 10.0, 5.0), (4, float("nan"), 5.0)], "id int, a double, c double")
    got = {r.id: r for r in features.minmax(df.where("id < 4"), ["a", "c"]).collect()}
    assert got[3].a == 1.0 and got[1].a == 0.0 and got[2].a is None and got[1].c is None
    assert {r.id for r in features.drop_where_zero(df, F.col("a")).collect()} == {2, 3, 4}
    assert features.slice_closed(df, "id", 2, 3).count() == 2 and features.slice_half_open(df, "id", 2, 3).count() == 1
    assert features.head(df, "id", 2).count() == 2
    with pytest.raises(ValueError):
        features.row_at(df, "id", 0)
    ties = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, o int")
    assert {tuple(r) for r in features.first_of(ties, ["k"], ["o"]).collect()} == {("a", 1), ("b", 3)}


def test_encoding(spark):
    words = [f"w{i}" for i in range(70)]
    lists = spark.createDataFrame([(1, ["b", "a", "b", "zz"]), (2, []), (3, None), (4, words)], "album_id long, descriptors array<string>")
    vocabulary = spark.createDataFrame([(i + 1, n) for i, n in enumerate(["a", "b", *words])], "descriptor_id long, name string")
    got = {r.album_id: r for r in encode.encode(lists, vocabulary).collect()}
    assert got[1].mood[:2] == [62 / 42, 61 / 42] and got[1].descriptor_count == 4
    assert got[2].descriptor_count == got[3].descriptor_count == 0 and set(got[2].mood) == {0.0}
    assert got[4].mood[2] == 1.5 and got[4].mood[2 + 41] == 22 / 42 and got[4].mood[2 + 63:] == [0.0] * 7
    assert encode.weights_of(encode.encode(lists, vocabulary)).count() == 2 + 63


def test_loader_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None)], "o int, name string")
    first = loader.number_new(rows, ["name"], ["o"], "id")
    assert {(r.id, r.name) for r in first.collect()} == {(1, "x"), (2, "y"), (3, None)}
    assert loader.number_new(rows, ["name"], ["o"], "id", first).count() == 0
    more = rows.unionByName(spark.createDataFrame([(5, "z")], "o int, name string"))
    assert {(r.id, r.name) for r in loader.get_or_insert(more, ["name"], ["o"], "id", first).collect()} == {(1, "x"), (2, "y"), (3, None), (4, "z")}
    assert loader.repeated(rows, ["name"]).count() == 1
    parent = spark.createDataFrame([("x",)], "key string")
    assert {r.name for r in loader.orphans(rows, parent, "name", "key").collect()} == {"y"}


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return df.select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.slugify(F.col("t")), t="Sigur Rós & Café: (Live) [2] /x 100%") == "sigur-rós-and-cafe-live-2x-100"
    url = lambda *a: one(spark, text.chart_url(*[F.lit(x).cast("string") for x in a]))
    assert url(None, None, None, None, 1) == "https://rateyourmusic.com/charts/top/album/1/"
    assert url("release", "2010s", "rock", "france", 1) == "https://rateyourmusic.com/charts/top/release/2010s/g:rock/loc:france/1/"
    assert one(spark, text.artist_and_album(F.col("t")), t="Jay-Z - The Blueprint - 2").asDict() == {"artist": "Jay-Z", "album": "The Blueprint - 2"}
    assert [one(spark, text.number(F.col("t")), t=t) for t in ("1,234", "NA", "", "12 followers")] == [1234.0, None, None, 12.0]
    dates = [str(one(spark, text.any_date(F.col("t")), t=t)) for t in ("1993", "22 June 2015", "13 Aug 2004", "x")]
    assert dates == ["1993-01-01", "2015-06-22", "2004-08-13", "None"]
    assert one(spark, text.rank_among(F.col("t"), "overall"), t="#3 for 1997, #1,234 overall") == "1234"
    assert one(spark, text.rank_among(F.col("t"), "overall"), t="none") is None
    assert one(spark, text.collapse(F.col("t")), t=" a \n b  c ") == "a, b c"
    assert one(spark, text.colour(F.col("t")), t="background: #f47b50; x:y") == "#f47b50"
    assert one(spark, text.split_list(F.col("t")), t=" a ,, b\n,") == ["a", "b"]
    assert one(spark, text.decimals(F.lit(0.1))) == "0.10000000"
    maps = spark.sql("select map('a', 1, 'b', 2) a, map('b', 3) b, array(1, 2, 3) c, array('x', 'y') d")
    assert maps.select(text.merged(F.col("a"), F.col("b")).alias("x")).first().x == {"a": 1, "b": 3}
    assert len(maps.select(text.zipped(F.col("c"), F.col("d")).alias("x")).first().x) == 2


def test_fuzzy(spark):
    names = spark.createDataFrame([("Radiohead",), ("Radio Dept",), ("Portishead",), (None,)], "name string")
    words = spark.createDataFrame([("RADIOHEED",), ("zzz",)], "word string")
    got = [(r.word, r.name) for r in fuzzy.close_matches(words, names).orderBy("rank").collect()]
    assert got[0] == ("RADIOHEED", "Radiohead") and all(w != "zzz" for w, _ in got)
    assert fuzzy.search(names, "  ", ["name"], "name").count() == 0
    assert [r.name for r in fuzzy.search(names, "radiohead", ["name"], "name").collect()] == ["Radiohead"]


def test_html(spark):
    page = "<div class='row a'>One <b>&amp; two<li>x<script>bad</script></div><div class=row>Three<p id=k>q</div><br><p>open"
    assert [t for _, t in html.select(page, "div", "row")] == ["One & twox", "Threeq"]
    assert [t for _, t in html.select(page, "div", "row", without_script=True)] == ["Threeq"]
    assert [t for _, t in html.select(page, "p", element_id="k")] == ["q"] and html.select(page, "h1") == [] and html.select(None, "p") == []
    pages = spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id long, html string")
    got = {r.page_id: r["info"] for r in html.records(pages, {"first": ("div", "row"), "none": ("h9", None)}).collect()}
    assert got == {1: {"first": "One & twox"}, 2: {}, 3: {}}
    assert html.listing(pages, "div", "row", max_page=1).count() == 1
    info = "<div class=h>Born</div> , <p>1970</p><div class=h>Genres<p>inside</p></div><div class=x>no</div><p>Rock &amp; <b>Pop</b></p><section><div class=h>Last</div></section><p>far"
    assert html.siblings(info, "div", "p", "h") == [("Born", "1970"), ("Genresinside", "Rock & Pop"), ("Last", None)]
    assert html.siblings("<p>1<p>2", "p", "p", "h") == [] and html.siblings(None, "div", "p") == []
    assert html.siblings("<div>a</div><div>b</div>", "div", "div") == [("a", "b"), ("b", None)]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, 'q"x\nline', None), (3, "ü", float("nan"))], "id int, name string, v double")
    for sep in (",", "\t"):
        path = str(tmp_path / f"out{ord(sep)}")
        io.write_csv(df, path, sep, digits=8)
        back = {r.id: r for r in io.read_csv(spark, path, "id int, name string, v double", sep).collect()}
        assert [back[i].name for i in (1, 2, 3)] == ["a,b", 'q"x\nline', "ü"] and back[1].v == 0.5 and back[3].v is None
    assert io.sniff(spark, str(tmp_path / "out9")) == "\t"
    assert io.read_glob(spark, str(tmp_path / "out44" / "*.csv"), "id int, name string, v double").where("file like '%.csv'").count() == 3
    io.write_json(df.where("id < 3"), str(tmp_path / "j"))
    assert io.read_json(spark, str(tmp_path / "j"), "id int, name string, v double").count() == 2
    (tmp_path / "list.txt").write_text("# no\n\n one \ntwo\n")
    assert [r.value for r in io.read_lines(spark, str(tmp_path / "list.txt")).collect()] == ["one", "two"]
    assert [r.value for r in io.from_list(spark, "a, ,b ").collect()] == ["a", "b"]
    (tmp_path / "indexed.csv").write_text(",id,v\n0,7,1.5\n1,8,\n")
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "indexed.csv"), "id int, v double", ",", index_column=True).collect()] == [(7, 1.5), (8, None)]
    io.write_table(df, str(tmp_path / "t"), partition_by=["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_resume(spark, tmp_path):
    todo, path = spark.range(10).withColumnRenamed("id", "k"), str(tmp_path / "r")
    work = lambda rows: rows.withColumn("x", F.col("k") * 2)
    assert io.append_unfinished(todo.where("k < 4"), path, "k", work) == 4
    assert io.append_unfinished(todo, path, "k", work) == 6 and io.append_unfinished(todo, path, "k", work) == 0
    assert spark.read.parquet(path).count() == 10


def test_timelines(spark):
    events = spark.sql("select timestamp'2024-01-01 23:50:00' ts, 1L user_id, 'a' event_type union all select timestamp'2024-01-02 00:10:00', 1L, 'a' union all select timestamp'2024-01-02 12:00:00', 1L, 'b'")
    assert {(str(r.day), r.n) for r in timeline.daily(events).collect()} == {("2024-01-01", 1), ("2024-01-02", 2)}
    assert sorted(r.n for r in timeline.sessions(events).collect()) == [1, 2]
    assert sum(r.n for r in timeline.hopping(events).collect()) == 6


def test_stated_vectors_ask_and_every_page_is_read(spark):
    every, some = (QUERIES[n](spark, SF).collect() for n in ("slider_knn_every", "slider_knn"))
    ids = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert {r.query_id for r in every} == ids and set(some) < set(every) and {r.query_id for r in some} == {i for i in ids if i % 20 == 0}
    assert max(r.page_id for r in QUERIES["chart_rows"](spark, SF).collect()) > 20


def star(spark, path):
    """A small star: two artists of one name with an album each, and tracks with nulls."""
    spark.createDataFrame([(1, "same"), (2, "same"), (3, "one"), (4, "none")], "c_custkey long, c_name string").write.parquet(f"{path}/customer.parquet")
    orders = [(10, 1, "O"), (20, 2, "P"), (30, 3, "F")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{path}/orders.parquet")
    tracks = [(10, 1, 4.0, 0.1, 8.0, 0.2, "N"), (10, 2, None, 0.3, 6.0, None, None), (20, 1, 9.0, 0.1, 2.0, 0.1, "N"), (30, None, None, None, None, None, None)]
    spark.createDataFrame(tracks, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double, l_tax double, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_null_tracks_and_artists_of_one_name(spark, tmp_path):
    d = star(spark, tmp_path)
    got = {r.album_id: r for r in catalog.features(spark, d).collect()}
    assert got[10].instrumentalness == 4.0 and got[10].speechiness == 0.2 and got[10].loudness == 0.2 and got[10].key == 1.5 and got[10].mode == 1.0
    assert got[30].instrumentalness is None and got[30].key is None and got[30].mode is None
    assert [r.name for r in QUERIES["q13"](spark, d).collect()] == ["one"]
    assert [tuple(r) for r in QUERIES["q10"](spark, d).orderBy("name").collect()] == [("one", 1), ("same", 2)]
    assert QUERIES["q04"](spark, d).count() == 0  # one album of the name has 4, which is not above 5
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    for name in ("q04", "q10", "q13", "track_means"):
        df = QUERIES[name](spark, d)
        want = con.sql(f"select {', '.join(sorted(df.columns))} from ({ORACLE_SQL[name]})").fetchall()
        assert sorted((tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr), name


def test_numbers_by_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"))
    got = numbered(rows, ["k"], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.k)] == list(range(5000)) and numbered(rows.limit(0), ["k"]).count() == 0


def test_vectors_that_cannot_be_compared_are_left_out(spark):
    df = vectors(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, [1.0, None]), (5, None), (None, [1.0, 1.0])])
    for limit in (1 << 20, 0):
        assert {(r.query_id, r.neighbour_id) for r in knn.knn_block(df, 3, limit=limit).collect()} == {(1, 2), (2, 1)}


def test_scraper_helpers(spark):
    row = spark.sql("select 'T\\n\\nBy A B' heading, array('x', 'disco_type_s') classes, 'https://h/chart/top/1990s rock/' url").select(
        text.title_and_artist(F.col("heading")).alias("h"), text.of_class(F.col("classes"), "disco_").alias("c"), text.export_name(F.col("url")).alias("e"),
        text.search_url(F.lit("a b")).alias("s"), text.search_keys(F.lit("Radiohead"), F.lit("Kid A")).alias("k"), text.joined(F.col("classes")).alias("j"),
    ).first()
    assert (row.h.title, row.h.artist, row.c, row.e) == ("T", "A B", ["disco_type_s"], "1990s_rock")
    assert row.s.endswith("searchterm=a+b") and row.k == ["Kid A Radiohead", "Radiohead - Kid A", "Kid A Radio"] and row.j == "x, disco_type_s"
    none = spark.sql("select cast(null as string) t, 'one line' u").select(text.title_and_artist(F.col("u")).alias("h"), text.export_name(F.col("t")).alias("e"), text.search_url(F.col("t")).alias("s")).first()
    assert (none.h.title, none.h.artist, none.e, none.s) == ("one line", None, None, None)


def test_json_lines_and_arrays(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"id": 1}\n{"id": 2}\n{"id": 3}\n')
    (tmp_path / "array.json").write_text('[{"id": 1},\n {"id": 2}]')
    assert io.read_json(spark, str(tmp_path / "lines.json"), "id int", lines=True).count() == 3
    assert io.read_json(spark, str(tmp_path / "array.json"), "id int").count() == 2


def test_stream_of_nothing_and_of_two_files(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 10:00:00' ts, 1L user_id union all select timestamp'2024-01-01 11:00:00', 2L union all select timestamp'2024-01-02 01:00:00', 1L")
    for k in (1, 2):
        events.write.parquet(str(tmp_path / f"e{k}"))
    events.limit(0).write.parquet(str(tmp_path / "none"))
    assert {(str(r.day), r.n) for r in timeline.stream_daily(spark, str(tmp_path / "e*"), events.schema).collect()} == {("2024-01-01", 4), ("2024-01-02", 2)}
    assert timeline.stream_daily(spark, str(tmp_path / "none"), events.schema).count() == 0


def test_answers_that_are_too_large_are_refused(spark):
    rows = spark.range(30).withColumnRenamed("id", "n")
    assert json.loads(io.json_response(rows, ["n"], 30).first().body)["results"] == [{"n": i} for i in range(30)]
    with pytest.raises(Exception, match="ask for pages"):
        io.json_response(rows, ["n"], 29).collect()
    pages = {r.page: [x["n"] for x in json.loads(r.body)["results"]] for r in io.json_pages(rows.repartition(4), ["n"], 12).collect()}
    assert pages == {0: list(range(12)), 1: list(range(12, 24)), 2: list(range(24, 30))}
    assert io.json_pages(rows.limit(0), ["n"]).collect() == []


def test_pretty_json_keeps_characters(spark, tmp_path):
    rows = spark.createDataFrame([(2, "Sigur Rós"), (1, "日本")], "n int, name string")
    io.write_pretty_json(rows, str(tmp_path / "out"), ["n"])
    (part,) = (tmp_path / "out").glob("part-*")
    raw = part.read_text(encoding="utf-8")
    assert json.loads(raw) == [{"n": 1, "name": "日本"}, {"n": 2, "name": "Sigur Rós"}]
    assert "Sigur Rós" in raw and len(raw.splitlines()) > 4
    assert sorted(map(tuple, io.read_json(spark, str(tmp_path / "out"), "n int, name string").collect())) == [(1, "日本"), (2, "Sigur Rós")]


def test_tasks_that_count_an_albums_descriptors_stay_bounded(spark, monkeypatch):
    from crateforge.plans import insights

    monkeypatch.setattr(insights, "TRACKS", 100)
    tracks = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    plan = insights.q06_approx(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert f", {-(-tracks // 100)}), REPARTITION_BY_NUM" in plan
