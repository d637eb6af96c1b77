"""The map of vectors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateforge.operators import musicmap


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)


def _plain(x, k):
    y = x - x.mean(axis=0)
    axes = np.linalg.eigh(y.T @ y)[1][:, ::-1].T[:k]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return y @ axes.T


@pytest.mark.parametrize("k", [2, 3])
def test_coordinates_equal_numpy(spark, k):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 12)) * np.linspace(5, 1, 12) + 1000  # far from the origin, where sums of squares lose digits
    odd = spark.createDataFrame([(None, [1.0] * 12), (900, None), (901, [1.0]), (902, [None] * 12)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.point for r in musicmap.project(_frame(spark, x).unionByName(odd), k).collect()}
    want = _plain(x, k)
    assert sorted(found) == list(range(400)) and max(np.abs(np.array(found[i]) - want[i]).max() for i in range(400)) < 1e-6


def test_clusters_are_those_that_lie_apart(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((4, 6)) * 50
    of = rng.integers(0, 4, 200)
    rows = musicmap.clusters(musicmap.project(_frame(spark, centres[of] + rng.standard_normal((200, 6)))), 4).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster, set()).add(int(of[r.vec_id]))
    assert sorted(groups) == [0, 1, 2, 3] and all(len(g) == 1 for g in groups.values())
    by_centre = sorted({(tuple(r.centre), r.cluster) for r in rows})
    assert [c for _, c in by_centre] == [0, 1, 2, 3]


def test_small_maps(spark):
    assert musicmap.project(_frame(spark, np.zeros((0, 3)))).collect() == []
    assert musicmap.clusters(musicmap.project(_frame(spark, np.zeros((0, 3))))).collect() == []
    one = musicmap.project(_frame(spark, np.array([[1.0, 2.0, 3.0]]))).first()
    assert one.point == pytest.approx([0.0, 0.0])


def test_cells(spark):
    points = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.1, 0.1]), (2, [10.0, 5.0]), (3, [10.0, 10.0])], "vec_id long, point array<double>")
    assert [tuple(r) for r in musicmap.busiest(points, 10).orderBy("rank").collect()] == [(0, 0, 2, 1), (9, 5, 1, 2), (9, 9, 1, 3)]
    same = points.select("vec_id", F.array(F.lit(1.0), F.lit(1.0)).alias("point"))
    assert [tuple(r) for r in musicmap.busiest(same).collect()] == [(0, 0, 4, 1)]
