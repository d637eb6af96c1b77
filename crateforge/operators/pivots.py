"""Exact nearest neighbours by pivots: Voronoi cells cut into rings, and the triangle inequality says which rings to visit.

1. A bounded sample of vectors are the pivots (their matrix is all that is broadcast). Every vector belongs to the cell of
   its nearest pivot, and lies there by its distance to it. Cells are cut into rings of at most ``ring`` vectors: numbers
   come from range partitioning, so a cell that holds a third of all vectors is many rings and no task holds it.
2. Every query is compared with its own ring, which bounds how far its k-th neighbour can be.
3. A ring of cell j holds nothing nearer than the bound t of query q if |q, p_j| - t is above the ring's outer radius, or
   |q, p_j| + t under its inner one, or (|q, p_j|^2 - |q, p_i|^2) / 2 |p_i, p_j| above t, p_i being the query's own pivot.
   Queries go only to rings that none of these rules out, and return what lies within the bound.
4. The k best of a query's own ring and of all rings visited are its neighbours, ties to the smaller id.

A ring and ``visitors`` queries at most meet in a task; more queries of one ring are dealt. Bounds are widened by a share of
1e-9, so that rounding never rules a neighbour out. Distances are computed as in ``knn``, digit by digit the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crateforge.operators.knn import SCHEMA, Base, _matrix, _nearest, found_table, sides, usable, weighted
from crateforge.operators.ranges import numbered
from crateforge.sources.staging import stage, tidy

#: Pivots at most, whatever the number of vectors.
MOST_PIVOTS = 512
SLACK = 1e-9


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(pivots)))
    for j in range(x.shape[1]):
        out += np.square(x[:, j, None] - pivots[None, :, j])
    return np.sqrt(out)


def _assigned(pivots):
    """(vec_id, v) -> (vec_id, v, cell, d): the nearest pivot and its distance."""

    def run(batches):
        for batch in batches:
            ids, x = _matrix(batch, "vec_id", "v")
            if len(ids):
                d = _distances(x, pivots.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "d"])

    return run


def _own_ring(k: int):
    """A ring -> its vectors' neighbours within it; a vector with fewer than k has no bound."""

    def run(table: pa.Table) -> pa.Table:
        ids, x = _matrix(table, "vec_id", "v")
        return found_table(_nearest(ids, x, Base(ids, x), k))

    return run


def _reached(pivots):
    """(query_id, v, cell, ring, bound) -> (query_id, to, far) for every cell that the bound does not rule out, far being the distance to its pivot."""

    def run(batches):
        between = _distances(pivots.value, pivots.value)
        for batch in batches:
            ids, x = _matrix(batch, "query_id", "v")
            if not len(ids):
                continue
            d, cell, bound = _distances(x, pivots.value), batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
            own = d[np.arange(len(d)), cell][:, None]
            with np.errstate(invalid="ignore", divide="ignore"):
                plane = (d * d - own * own) / (2 * between[cell])
            at, to = np.nonzero(~(plane > (bound * (1 + SLACK))[:, None] + SLACK * (1 + d)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(to.astype(np.int32)), pa.array(d[at, to])], names=["query_id", "to", "far"])

    return run


def _visits(k: int):
    """Visiting queries (query_id, v, bound) and a ring's vectors -> neighbours within the bound."""

    def run(asked: pa.Table, ring: pa.Table) -> pa.Table:
        if not asked.num_rows or not ring.num_rows:
            return found_table([np.zeros(0)] * 3)
        return found_table(_nearest(*_matrix(asked, "query_id", "v"), Base(*_matrix(ring, "vec_id", "v")), k, asked.column("bound").to_numpy() * (1 + SLACK)))

    return run


class PivotIndex:
    """Vectors (vec_id, embedding) of the greatest length, in rings, staged in the shared folder."""

    def __init__(self, vectors: DataFrame, slider: float = 1.0, audio: int = 13, pivots: int | None = None, ring: int | None = None):
        spark = vectors.sparkSession
        base = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), weighted("embedding", slider, audio).alias("v"))
        self.width = base.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
        base = base.where(F.size("v") == self.width)
        self.rows, self.spark = base.count(), spark
        self.ring = ring = ring or -(-max(self.rows, 1) // sides(self.rows, 4096))  # visits are copies, so the number of rings must not grow
        if not self.rows:
            return
        most = min(MOST_PIVOTS, pivots or max(1, self.rows // ring))  # cells of a ring or two: more cells are more visits
        chosen = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()  # bounded: MOST_PIVOTS vectors
        self.pivots = spark.sparkContext.broadcast(np.unique(_matrix(chosen, "vec_id", "v")[1], axis=0))
        placed = base.mapInArrow(_assigned(self.pivots), "vec_id long, v array<double>, cell int, d double")
        rows = numbered(placed, ["cell", "d", "vec_id"], "place")
        first = rows.groupBy("cell").agg(F.min("place").alias("first"))
        rows = rows.join(first, "cell").withColumn("ring", F.floor((F.col("place") - F.col("first")) / F.lit(ring)).cast("int"))
        self.members, _ = stage(rows.select("vec_id", "v", "cell", "ring", "d"))
        self.rings, _ = stage(self.members.groupBy("cell", "ring").agg(F.min("d").alias("inner"), F.max("d").alias("outer"), F.count("*").alias("size")))

    def visits(self, bounds: DataFrame) -> DataFrame:
        """(query_id, cell, ring, bound) of every ring besides its own that a query (query_id, v, cell, ring, bound) must visit."""
        reached = bounds.mapInArrow(_reached(self.pivots), "query_id long, to int, far double")
        asked = reached.join(bounds.select("query_id", F.col("cell").alias("own_cell"), F.col("ring").alias("own_ring"), "bound"), "query_id")
        slack = F.col("bound") * (1 + SLACK) + SLACK * (1 + F.col("far"))
        near = (F.col("far") - slack <= F.col("outer")) & (F.col("far") + slack >= F.col("inner"))
        other = (F.col("to") != F.col("own_cell")) | (F.col("ring") != F.col("own_ring"))
        return asked.join(self.rings.select(F.col("cell").alias("to"), "ring", "inner", "outer"), "to").where(near & other).select("query_id", F.col("to").alias("cell"), "ring", "bound")

    def neighbours(self, k: int = 5, queries: DataFrame | None = None, visitors: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, neighbour_id, rank, distance) of all vectors, or of those whose vec_id is in ``queries``; and the staged visits."""
        visitors = visitors or self.ring
        groups = self.members.groupBy("cell", "ring")
        own, _ = stage(groups.applyInArrow(_own_ring(k), "query_id long, neighbour_id long, distance double"))
        asked = self.members if queries is None else self.members.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
        reach = own.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("bound")).where(F.col("n") >= k).drop("n")
        bounds, _ = stage(asked.withColumnRenamed("vec_id", "query_id").join(reach, "query_id", "left").select("query_id", "v", "cell", "ring", F.coalesce("bound", F.lit(float("inf"))).alias("bound")))
        visits, _ = stage(self.visits(bounds))
        parts = visits.groupBy("cell", "ring").agg(F.ceil(F.count("*") / F.lit(visitors)).cast("int").alias("parts"))
        left = visits.join(parts, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int")).join(bounds.select("query_id", "v"), "query_id")
        right = self.members.join(parts, ["cell", "ring"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["cell", "ring", "part"]
        met = left.select(*keys, "query_id", "v", "bound").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "v").groupBy(*keys)).applyInArrow(_visits(k), "query_id long, neighbour_id long, distance double")
        mine = own.join(asked.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi") if queries is not None else own
        order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
        best = mine.unionByName(met).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return best.select("query_id", "neighbour_id", "rank", "distance"), visits


@tidy
def knn_pivot(vectors: DataFrame, k: int = 5, slider: float = 1.0, audio: int = 13, queries: DataFrame | None = None, pivots: int | None = None, ring: int | None = None, visitors: int | None = None) -> DataFrame:
    """All k nearest of every query, as ``knn_block`` gives them, without a broadcast of the base and without all pairs.

    Vectors that cannot be compared (null ids, null vectors or components, shorter than the longest) neither ask nor are
    found; a vec_id must not repeat; fewer than k others are all neighbours; an empty table gives no rows.
    """
    index = PivotIndex(vectors, slider, audio, pivots, ring)
    if not index.rows:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    return index.neighbours(k, queries, visitors)[0]
