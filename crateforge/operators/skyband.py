"""One table of neighbour candidates for every slider.

The slider changes the weight of one of two squared distances: d^2 = audio^2 + mood^2 / s^2. Whatever the weight, a
candidate for which k others are at least as near by both distances (ties: of smaller id) is none of the k nearest. What is
left, the k-skyband of the two distances, is found once and kept; each slider is then a top-k over it, and no vector is
read again. The skyband of a union is the skyband of the parts' skybands, so the base is taken piece by piece.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crateforge.operators.knn import BROADCAST_LIMIT, WIDEST, Base, _direct, _matrix, slider_weight, usable

SCHEMA = "query_id long, neighbour_id long, audio2 double, mood2 double"
#: Corners of a skyband that are held against all others.
STEPS = 8
#: Queries that are searched for together, vectors of a base that they meet at once, and at first, before there are any corners; candidates a query that wait for a merge.
TILE, CHUNK, LEAST, WAITING = 512, 512, 128, 64
NAMES = ["query_id", "neighbour_id", "audio2", "mood2"]


def band(ids: np.ndarray, audio2: np.ndarray, mood2: np.ndarray, k: int) -> np.ndarray:
    """Places of the candidates that fewer than k others dominate, in order of the first distance, the second and the id."""
    some = None
    if len(ids) > 64 * k:  # the k nearest at one weight dominate all that is farther by both distances than each of them
        first = np.argpartition(audio2 / max(audio2.mean(), 1e-300) + mood2 / max(mood2.mean(), 1e-300), k - 1)[:k]
        some = np.flatnonzero((audio2 <= audio2[first].max()) | (mood2 <= mood2[first].max()))
        ids, audio2, mood2 = ids[some], audio2[some], mood2[some]
    order = np.lexsort((ids, mood2, audio2))
    mood = mood2[order]
    if len(order) > 4 * k:  # the k first bound the second distance of all behind them
        order = order[np.concatenate((np.arange(k), k + np.flatnonzero(mood[k:] < mood[:k].max())))]
        mood = mood2[order]
    kept, least = [], []  # least: the k smallest second distances so far, the largest of them first
    for at, m in zip(order.tolist(), mood.tolist()):
        if len(least) < k:
            heapq.heappush(least, -m)
            kept.append(at)
        elif m < -least[0]:
            heapq.heapreplace(least, -m)
            kept.append(at)
    return np.array(kept, np.int64) if some is None else some[np.array(kept, np.int64)]


def _direct_bands(ids: np.ndarray, x: np.ndarray, base_ids: np.ndarray, base: np.ndarray, k: int, audio: int, tile: int = 64) -> pa.RecordBatch:
    """Every query's skyband within a block, self left out by id; every pair is measured."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for start in range(0, len(ids), tile):
        q = x[start : start + tile]
        two = np.zeros((2, len(q), len(base)))
        for j in range(x.shape[1]):
            two[int(j >= audio)] += np.square(q[:, j, None] - base[None, :, j])
        for row, query in enumerate(ids[start : start + tile].tolist()):
            other = np.flatnonzero(base_ids != query)
            near = other[band(base_ids[other], two[0, row, other], two[1, row, other], k)]
            for part, values in zip(parts, (np.full(len(near), query), base_ids[near], two[0, row, near], two[1, row, near])):
                part.append(values)
    return _batch([np.concatenate(p) if p else np.zeros(0) for p in parts])


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.float64()) for i, c in enumerate(columns)], names=NAMES)


def _many(row: np.ndarray, ids: np.ndarray, audio2: np.ndarray, mood2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``band`` of many queries (row) at once: the places kept, in order of the query and as ``band`` has them, and at each the k-th smallest second distance so far."""
    order = np.lexsort((ids, mood2, audio2, row))
    _, first, count = np.unique(row[order], return_index=True, return_counts=True)
    by_count = np.argsort(-count, kind="stable")
    first, count, mood = first[by_count], count[by_count], mood2[order]
    least, keep, bound = np.full((len(first), k), np.inf), np.zeros(len(order), bool), np.full(len(order), np.inf)
    for t in range(int(count[0]) if len(count) else 0):  # the t-th candidate of every query that has so many
        n = int(np.searchsorted(-count, -t, side="left"))
        at = first[:n] + t
        if t < k:
            least[:n, t], keep[at] = mood[at], True
            if t == k - 1:
                bound[at] = least[:n].max(axis=1)
            continue
        place = least[:n].argmax(axis=1)
        better = np.flatnonzero(mood[at] < least[np.arange(n), place])
        at = at[better]
        least[better, place[better]], keep[at] = mood[at], True
        bound[at] = least[better].max(axis=1)
    return order[keep], bound[keep]


class _Search:
    """Some queries, and what base after base leaves of their candidates.

    A pair is measured only if products of single precision do not show that k found so far dominate it: a pair farther than
    the middle one of STEPS corners, which most are, is out by that alone. What is left is measured, and merged whenever the
    base seen has doubled, or when many wait.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, audio: int):
        self.ids, self.x, self.k, self.parts = ids, x, k, (slice(0, audio), slice(audio, None))
        self.finite, self.seen, self.merged = bool(np.isfinite(x).all()), 0, 0
        self.found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]  # row, neighbour and both squares
        self.new: list[list[np.ndarray]] = []
        self.corners = np.full((2, len(ids), STEPS), np.inf)

    def meet(self, base_ids: np.ndarray, base_x: np.ndarray, base: Base | None, chunk: int = CHUNK) -> None:
        """``base`` is of the same vectors, None if one of them is not finite; then all pairs are measured."""
        fast = self.finite and base is not None
        at = 0
        if fast:
            (side_a, own_a), (side_m, own_m) = base.asked(self.x)
        while at < len(base_ids):
            end = min(len(base_ids), at + min(chunk, max(LEAST, 2 * self.merged - self.seen)))
            if fast and self.merged:
                if not at or self.seen == self.merged:
                    far_a, far_m = (np.stack([base.most(c[:, step], own) for step in range(STEPS)], axis=1) for c, own in zip(self.corners, (own_a, own_m)))
                with np.errstate(all="ignore"):
                    low_a, low_m = side_a @ base.side[0][at:end].T, side_m @ base.side[1][at:end].T
                middle = STEPS // 2
                place = np.flatnonzero(~((low_a > far_a[:, middle, None]) & (low_m > far_m[:, middle, None])))
                row, a, m = place // (end - at), low_a.ravel()[place], low_m.ravel()[place]
                near = np.ones(len(place), bool)
                for step in range(STEPS):
                    near &= ~((a > far_a[row, step]) & (m > far_m[row, step]))
                row, other = row[near], place[near] % (end - at) + at
            else:
                row, other = np.repeat(np.arange(len(self.ids)), end - at), np.tile(np.arange(at, end), len(self.ids))
            self._take(row, other, base_ids, base_x)
            self.seen += end - at
            at = end
            if self.seen >= 2 * self.merged or sum(len(c[0]) for c in self.new) > WAITING * len(self.ids):
                self._merge()

    def _take(self, row: np.ndarray, other: np.ndarray, base_ids: np.ndarray, base_x: np.ndarray, piece: int = 1 << 14) -> None:
        keep = base_ids[other] != self.ids[row]
        row, other = row[keep], other[keep]
        for p in range(0, len(row), piece):
            i, j = row[p : p + piece], other[p : p + piece]
            self.new.append([i, base_ids[j], *(_direct(self.x[i, of], base_x[j, of]) for of in self.parts)])

    def _merge(self) -> None:
        rows, ids, audio2, mood2 = (np.concatenate(c) for c in zip(self.found, *self.new))
        self.merged, self.new = self.seen, []
        if not (np.isnan(audio2).any() or np.isnan(mood2).any()):
            at, bound = _many(rows, ids, audio2, mood2, self.k)
        else:
            order = np.argsort(rows, kind="stable")
            cut = np.searchsorted(rows[order], np.arange(len(self.ids) + 1))
            own = [order[low:high] for low, high in zip(cut, cut[1:])]
            at = np.concatenate([o[band(ids[o], audio2[o], mood2[o], self.k)] for o in own]).astype(np.int64) if len(own) else np.zeros(0, np.int64)
            bound = np.full(len(at), np.inf)
        self.found = [c[at] for c in (rows, ids, audio2, mood2)]
        first = np.searchsorted(self.found[0], np.arange(len(self.ids) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        ends = first[full, None] + np.linspace(np.full(len(full), self.k), np.diff(first)[full], STEPS, axis=1).astype(int) - 1
        self.corners = np.full((2, len(self.ids), STEPS), np.inf)
        self.corners[0, full], self.corners[1, full] = self.found[2][ends], bound[ends]

    def result(self) -> pa.RecordBatch:
        self._merge()
        return _batch([self.ids[self.found[0]], *self.found[1:]])


def _bands(ids: np.ndarray, x: np.ndarray, base: Base, k: int, audio: int, chunk: int = CHUNK) -> pa.RecordBatch:
    """The same as ``_direct_bands`` over a base that is finite; few pairs are measured."""
    parts = [_batch([np.zeros(0)] * 4)]
    for start in range(0, len(ids), TILE):
        search = _Search(ids[start : start + TILE], x[start : start + TILE], k, audio)
        search.meet(base.ids, base.x, base, chunk)
        parts.append(search.result())
    return pa.concat_batches(parts)


def _base(ids: np.ndarray, x: np.ndarray, audio: int) -> Base | None:
    return Base(ids, x, (slice(0, audio), slice(audio, None))) if np.isfinite(x).all() else None


def _stream(k: int, audio: int, piece: int):
    """Rows (cell, side, vec_id, e) in order of cell and side -> skybands: a cell's rows of side 0 ask, those of side 1 pass by them, ``piece`` at a time."""

    def run(batches):
        searches, waiting, of = [], [], None

        def met() -> None:
            if waiting:
                ids, x = (np.concatenate(c) for c in zip(*waiting))
                waiting.clear()
                base = _base(ids, x, audio)
                for search in searches:
                    search.meet(ids, x, base)

        for batch in batches:
            side = batch.column("cell").to_numpy() * 2 + batch.column("side").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(side)) + 1).tolist(), len(side)]
            for low, high in zip(ends, ends[1:]):
                if low == high:
                    continue
                cell, passes = divmod(int(side[low]), 2)
                if cell != of:
                    met()
                    yield from (search.result() for search in searches)
                    searches, of = [], cell
                ids, x = _matrix(batch.slice(low, high - low), "vec_id", "e")
                if passes:
                    waiting.append((ids, x))
                    if sum(len(w[0]) for w in waiting) >= piece:
                        met()
                else:
                    searches.extend(_Search(ids[t : t + TILE], x[t : t + TILE], k, audio) for t in range(0, len(ids), TILE))
        met()
        yield from (search.result() for search in searches)

    return run


def skyband(vectors: DataFrame, k: int = 5, audio: int = 13, queries: DataFrame | None = None, block: int = 1 << 14, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(query_id, neighbour_id, audio2, mood2): every query's candidates for any slider.

    The base is broadcast if its measured size is within ``limit``; beyond it queries are dealt to as many tasks as there are
    cores, of WIDEST queries at most, and the base passes by each of them in pieces of ``block`` vectors or more, so that only
    the queries and what is left of their candidates are held. Vectors that cannot be compared are left out, as in
    ``knn_block``; an empty table gives no rows.
    """
    base = usable(vectors).select("vec_id", F.col("embedding").alias("e"))
    width = base.agg(F.coalesce(F.max(F.size("e")), F.lit(0))).first()[0]
    base = base.where(F.size("e") == width)
    asked = base if queries is None else base.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    rows, cores = base.count(), base.sparkSession.sparkContext.defaultParallelism
    if not rows:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    if rows * width * 8 <= limit:
        sent = base.sparkSession.sparkContext.broadcast(_matrix(base.toArrow(), "vec_id", "e"))

        def run(batches):
            of = _base(*sent.value, audio)
            for batch in batches:
                asking = _matrix(batch, "vec_id", "e")
                yield _bands(*asking, of, k, audio) if of else _direct_bands(*asking, *sent.value, k, audio)

        return asked.repartition(max(2, cores), "vec_id").mapInArrow(run, SCHEMA)
    cells = max(2, cores, -(-asked.count() // WIDEST))
    left = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int").alias("cell"), F.lit(0).alias("side"), "vec_id", "e")
    right = base.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("side"), "vec_id", "e")
    return left.unionByName(right).repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "side").mapInArrow(_stream(k, audio, max(1, block)), SCHEMA)


def at_slider(candidates: DataFrame, slider: float, k: int = 5) -> DataFrame:
    """(query_id, neighbour_id, rank, distance): the k nearest at a slider, from the candidates alone; k at most that of the table."""
    s = slider_weight(slider)
    rows = candidates.withColumn("distance", F.sqrt(F.col("audio2") + F.col("mood2") / F.lit(s * s)))
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "neighbour_id", "rank", "distance")
