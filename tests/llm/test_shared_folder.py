"""Operators and the pipeline leave in the shared folder what their results read, and the session as it was."""

import os

import pytest

import corpus_pipeline
from crateforge.llm.queries import QUERIES
from crateforge.sources import staging

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(staging, "shared_dir", lambda _: f"file://{tmp_path}")
    return str(tmp_path)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_nothing_is_left_but_what_the_result_reads(spark, shared, name):
    settings = lambda: {r.key: r.value for r in spark.sql("set").collect() if r.key.startswith("spark.sql.")}
    before = settings()
    result = {**QUERIES, "pipeline": corpus_pipeline.run}[name](spark, SF)
    rows = result.count()
    read = result.inputFiles()
    assert rows and [x for x in os.listdir(shared) if not any(x in file for file in read)] == []
    assert settings() == before
