"""A map of vectors: two principal components from distributed sums, and clusters on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crateforge.operators.knn import _matrix, usable
from crateforge.sources.staging import stage, tidy

#: Widest vectors: the sums of products, width^2 numbers, are all that the driver gets.
MOST = 4096


def _sums(batches):
    """A task's count, sum and sum of products, about the first vector that it sees, which keeps digits."""
    n, total, products, about = 0, None, None, None
    for batch in batches:
        _, x = _matrix(batch, "vec_id", "v")
        if not len(x):
            continue
        if about is None:
            about, total, products = x[0].copy(), np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
        y = x - about
        n, total, products = n + len(y), total + y.sum(axis=0), products + y.T @ y
    if n:
        mean = total / n
        scatter = products - n * np.outer(mean, mean)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(about + mean).tobytes()], pa.binary()), pa.array([scatter.tobytes()], pa.binary())], names=["n", "mean", "scatter"])


def _joined(table: pa.Table) -> pa.Table:
    """The parts of some tasks as one: scatters add, and so does what their means lie apart."""
    n = np.array(table.column("n").to_pylist(), float)
    means = np.stack([np.frombuffer(m) for m in table.column("mean").to_pylist()])
    scatter = np.sum([np.frombuffer(s).reshape(means.shape[1], -1) for s in table.column("scatter").to_pylist()], axis=0)
    mean = n @ means / n.sum()
    apart = means - mean
    scatter = scatter + (apart * n[:, None]).T @ apart
    return pa.table([pa.array([int(n.sum())], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([scatter.tobytes()], pa.binary())], names=["n", "mean", "scatter"])


def axes(vectors: DataFrame, dimensions: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the directions of greatest variance as rows, greatest first; the largest entry of each is positive."""
    sums = vectors.mapInArrow(_sums, "n long, mean binary, scatter binary")
    few = sums.groupBy(F.pmod(F.spark_partition_id(), F.lit(32)).alias("part")).applyInArrow(_joined, "n long, mean binary, scatter binary")
    whole = _joined(few.toArrow())  # 32 rows at most
    mean, scatter = np.frombuffer(whole.column("mean")[0].as_py()), np.frombuffer(whole.column("scatter")[0].as_py())
    _, directions = np.linalg.eigh(scatter.reshape(len(mean), -1))
    found = directions[:, ::-1].T[:dimensions]
    signs = np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])
    return mean, found * signs[:, None]


@tidy
def project(vectors: DataFrame, dimensions: int = 2) -> DataFrame:
    """(vec_id, point): coordinates along the axes of greatest variance, of all vectors of the greatest length.

    Vectors that cannot be compared are left out, as in k-NN; of vectors narrower than ``dimensions`` all axes are given; one
    vector lies at the origin; an empty table gives no rows.
    """
    base = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    width = base.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    if width > MOST:
        raise ValueError(f"vectors of more than {MOST} components")
    base = base.where(F.size("v") == width)
    if not width:
        return base.select("vec_id", F.col("v").alias("point")).limit(0)
    mean, found = axes(base, dimensions)

    def run(batches):
        for batch in batches:
            _, x = _matrix(batch, "vec_id", "v")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list((x - mean) @ found.T), pa.list_(pa.float64()))], names=["vec_id", "point"])

    return base.mapInArrow(run, "vec_id long, point array<double>")


@tidy
def clusters(points: DataFrame, k: int = 8, seed: int = 5) -> DataFrame:
    """(vec_id, point, cluster, centre): k-means over the points; clusters are numbered from 0 by their centres' coordinates."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows, _ = stage(points)
    if rows.isEmpty():
        return rows.select("vec_id", "point", F.lit(0).alias("cluster"), F.col("point").alias("centre"))
    data = rows.withColumn("features", array_to_vector("point"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="found").fit(data)
    centres = sorted((c.tolist(), i) for i, c in enumerate(model.clusterCenters()))
    named = rows.sparkSession.createDataFrame([(i, number, c) for number, (c, i) in enumerate(centres)], "found int, cluster int, centre array<double>")
    return model.transform(data).join(F.broadcast(named), "found").select("vec_id", "point", "cluster", "centre")


def busiest(points: DataFrame, cells: int = 10) -> DataFrame:
    """(column, row, n, rank): how many points lie in each cell of a grid over the map, most first."""
    x, y = F.col("point").getItem(0), F.col("point").getItem(1)
    ends = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    at = lambda v, a, b: F.least(F.coalesce(F.floor(F.try_divide((v - F.col(a)) * cells, F.col(b) - F.col(a))), F.lit(0)), F.lit(cells - 1)).cast("int")
    counted = points.join(F.broadcast(ends)).groupBy(at(x, "x0", "x1").alias("column"), at(y, "y0", "y1").alias("row")).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "column", "row")))
