"""Staged tables: what an operator leaves in the shared folder is what its result reads."""

import os

import pytest

from crateforge.plans import catalog, graphs, insights, pages, pipelines, records  # noqa: F401
from crateforge.plans.registry import QUERIES
from crateforge.sources import staging
from crateforge.sources.staging import discard, stage, tidy

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(staging, "shared_dir", lambda _: f"file://{tmp_path}")
    return str(tmp_path)


def left_over(shared, result) -> set[str]:
    """Staged tables that the result does not read."""
    read = result.inputFiles()
    return {name for name in os.listdir(shared) if name.startswith("crateforge-") and not any(name in file for file in read)}


def test_an_operators_tables_go_with_it(spark, shared):
    @tidy
    def inner(rows):
        one, _ = stage(rows)
        two, _ = stage(one.selectExpr("id * 2 as id"))
        return two.where("id > 2")

    @tidy
    def outer(rows):
        found = inner(rows)
        kept, path = stage(found)
        assert len(os.listdir(shared)) == 2
        return kept, path

    result, path = outer(spark.range(5))
    assert os.listdir(shared) == [path.rsplit("/", 1)[-1]]
    assert sorted(r.id for r in result.collect()) == [4, 6, 8]
    discard(spark, path)
    assert os.listdir(shared) == []


def test_nothing_is_left_of_one_that_fails(spark, shared):
    @tidy
    def fails(rows):
        stage(rows)
        raise KeyError("on purpose")

    with pytest.raises(KeyError):
        fails(spark.range(3))
    assert os.listdir(shared) == []


@pytest.mark.parametrize("name", ["knn_pivot", "graph_components", "graph_clustering", "graph_betweenness", "graph_eccentricity", "music_map", "music_clusters"])
def test_queries_leave_what_they_read(spark, shared, name):
    result = QUERIES[name](spark, SF)
    rows = result.count()
    assert left_over(shared, result) == set() and rows


def test_the_folder_where_none_is_named():
    """A local session without the setting has one temporary folder; a cluster's is refused."""

    class Session:
        def __init__(self, master, named=None):
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: named or default)})
            self.sparkContext = type("Context", (), {"master": master, "applicationId": f"test {master}"})

    here = staging.shared_dir(Session("local[2]"))
    assert os.path.isdir(here) and staging.shared_dir(Session("local[2]")) == here
    assert staging.shared_dir(Session("spark://host", "file:///shared")) == "file:///shared"
    with pytest.raises(RuntimeError):
        staging.shared_dir(Session("spark://host"))
