"""The relational store: idempotent loads, references, clearing in order, new numbers."""

import os

import pytest

from crateforge.operators import loader
from crateforge.operators.store import MUSIC, Store, Table, summary


def _rows(spark, name, *rows):
    return spark.createDataFrame(list(rows), MUSIC[name].schema)


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", MUSIC)


def test_loads_add_what_is_new(spark, store):
    artists = _rows(spark, "artist", (1, "Low"), (2, "Ride"), (2, "Ride"))
    assert store.read("artist").collect() == []
    assert store.insert("artist", artists) == 2
    assert store.insert("artist", artists) == 0
    assert store.insert("artist", _rows(spark, "artist", (2, "other"), (3, "Can"))) == 1
    assert sorted(map(tuple, store.read("artist").collect())) == [(1, "Low"), (2, "Ride"), (3, "Can")]


def test_rows_that_point_nowhere_are_refused(spark, store):
    store.insert("artist", _rows(spark, "artist", (1, "Low")))
    with pytest.raises(ValueError, match="artist_id 7"):
        store.insert("album", _rows(spark, "album", (10, "Ones", 1, None), (11, "Twos", 7, None)))
    assert store.read("album").collect() == []  # none of them
    assert store.insert("album", _rows(spark, "album", (10, "Ones", 1, None), (12, "Nobody's", None, None))) == 2


def test_clearing_goes_from_children_to_parents(spark, store):
    store.insert("artist", _rows(spark, "artist", (1, "Low")))
    store.insert("album", _rows(spark, "album", (10, "Ones", 1, None)))
    with pytest.raises(ValueError, match="album points to artist"):
        store.clear("artist")
    assert store.replace({"artist": _rows(spark, "artist", (5, "New")), "album": _rows(spark, "album", (1, "First", 5, None))}) == {"artist": 1, "album": 1}
    assert [tuple(r) for r in summary(store).orderBy("name").collect()] == [("album", 1, 1), ("album_descriptor", 0, 0), ("artist", 1, 1), ("descriptor", 0, 0)]
    store.clear()
    assert store.read("artist").collect() == []


def test_numbers_start_anew_after_clearing(spark, store):
    names = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "name string, row long")
    new = lambda rows: loader.number_new(rows, ["name"], ["row"], "artist_id", store.read("artist")).select("artist_id", "name")
    store.insert("artist", new(names.where("row < 3")))
    store.insert("artist", new(names))
    assert sorted(map(tuple, store.read("artist").collect())) == [(1, "b"), (2, "a"), (3, "c")]
    store.clear()
    store.insert("artist", new(names.where("row > 1")))
    assert sorted(map(tuple, store.read("artist").collect())) == [(1, "a"), (2, "c")]


def test_a_load_that_did_not_end_does_not_count(spark, store, tmp_path):
    store.insert("artist", _rows(spark, "artist", (1, "Low")))
    os.makedirs(tmp_path / "store/artist/load=1")
    (tmp_path / "store/artist/load=1/part-0.parquet").write_bytes(b"broken")
    assert store.read("artist").count() == 1
    assert store.insert("artist", _rows(spark, "artist", (2, "Ride"))) == 1  # takes its place
    assert store.read("artist").count() == 2


def test_tables_are_listed_after_what_they_point_to(spark, tmp_path):
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), {"child": Table("id long, up long", ("id",), {"up": ("parent", "id")}), "parent": Table("id long", ("id",))})


def test_new_rows_are_worked_out_once(spark, tmp_path):
    """Whatever a table points to: the references and the load read the same rows."""
    from pyspark.sql import functions as F

    from crateforge.operators.store import Store, Table

    two = Store(spark, f"file://{tmp_path}/once", {"a": Table("k long", ("k",)), "b": Table("k long, x long, y long", ("k",), {"x": ("a", "k"), "y": ("a", "k")})})
    two.insert("a", spark.range(10).select(F.col("id").alias("k")))
    seen = spark.sparkContext.accumulator(0)

    def counted(k):
        seen.add(1)
        return k

    rows = spark.range(10).select(F.udf(counted, "long").asNondeterministic()("id").alias("k"), F.col("id").alias("x"), F.col("id").alias("y"))
    assert two.insert("b", rows) == 10 and seen.value == 10
