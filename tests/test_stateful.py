"""Streams with state: files out of order and a restart give what a batch gives."""

import random

import pytest

from crateforge.streaming import stateful, timeline

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def _events(spark, seed: int, n: int, hours: int):
    rnd = random.Random(seed)
    rows = [(i, f"2024-03-{1 + (h := rnd.randrange(hours)) // 24:02d} {h % 24:02d}:{rnd.randrange(60):02d}:{rnd.randrange(60):02d}.{rnd.randrange(10**6):06d}", rnd.choice([1, 1, 1, 2, 3]), rnd.choice("ab")) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type")


def _sessions(df):
    return sorted((r.user_id, r.start, r.n) for r in df.collect())


@pytest.mark.parametrize("late", ["30 days", "6 days"])
def test_sessions_out_of_order_and_restarted(spark, tmp_path, late):
    events = _events(spark, 1, 300, 24 * 9).cache()
    parts = events.randomSplit([1.0] * 5, 3)
    if late == "6 days":  # in rough order, so that the watermark moves and closes sessions, but never past what is to come
        parts = [events.where(f"day(ts) % 9 between {2 * k} and {2 * k + 1}") for k in range(5)]
        parts = [events.where(f"day(ts) in ({3 * k + 1}, {3 * k + 2}, {3 * k + 3})") for k in range(3)]
    path, root = str(tmp_path / "in"), f"file://{tmp_path}/stream"
    for k, part in enumerate(parts[:-1]):
        part.coalesce(1).write.mode("append").parquet(path)
    stateful.stream_sessions(spark, path, SCHEMA, 3600, late, root, files_at_once=1)
    parts[-1].coalesce(1).write.mode("append").parquet(path)
    found = stateful.stream_sessions(spark, path, SCHEMA, 3600, late, root, files_at_once=1)  # goes on from its checkpoint
    whole = spark.read.schema(SCHEMA).parquet(path)
    assert whole.count() == 300
    assert _sessions(found) == _sessions(timeline.sessions(whole, "1 hour"))
    again = stateful.stream_sessions(spark, path, SCHEMA, 3600, late, root)  # nothing new
    assert _sessions(again) == _sessions(found)


def test_events_beyond_the_watermark_are_left_out(spark, tmp_path):
    path, root = str(tmp_path / "in"), f"file://{tmp_path}/stream"
    make = lambda *times: spark.createDataFrame([(1, t, 7, "a") for t in times], "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type").coalesce(1)
    for k, part in enumerate((make("2024-03-10 10:00:00"), make("2024-03-12 10:00:00"), make("2024-03-10 10:30:00", "2024-03-12 10:30:00"))):
        part.write.mode("append").parquet(path)
        found = stateful.stream_sessions(spark, path, SCHEMA, 3600, "1 hour", root)
    assert [(str(s), n) for _, s, n in _sessions(found)] == [("2024-03-10 10:00:00", 1), ("2024-03-12 10:00:00", 2)]


def test_sliding_windows_as_a_stream(spark, tmp_path):
    events = _events(spark, 2, 200, 24 * 6)
    path, root = str(tmp_path / "in"), f"file://{tmp_path}/stream"
    for part in events.randomSplit([1.0] * 4, 5):
        part.coalesce(1).write.mode("append").parquet(path)
        found = stateful.stream_hopping(spark, path, SCHEMA, late="30 days", root=root)
    batch = timeline.hopping(spark.read.schema(SCHEMA).parquet(path))
    rows = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert rows(found) == rows(batch)


def test_ids_stay_and_are_unique(spark, tmp_path):
    path, root = str(tmp_path / "in"), f"file://{tmp_path}/stream"
    given = {}
    for k in range(3):
        spark.createDataFrame([(f"key{i}",) for i in range(20 * k, 20 * k + 60)] + [("é",), (None,), ("",)], "name string").coalesce(2).write.mode("append").parquet(path)
        now = {r.key: r.id for r in stateful.stream_ids(spark, path, "name string", "name", 4, root, files_at_once=1).collect()}
        assert given.items() <= now.items()
        given = now
    assert set(given) == {f"key{i}" for i in range(100)} | {"é", ""}
    assert len(set(given.values())) == len(given) and min(given.values()) >= 1


def test_a_stream_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    assert stateful.stream_sessions(spark, str(tmp_path / "none"), SCHEMA, 60).count() == 0
    assert stateful.stream_ids(spark, str(tmp_path / "none"), SCHEMA, "event_type").count() == 0
