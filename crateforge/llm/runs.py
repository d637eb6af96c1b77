"""Periodic runs of words: a harmonic grid of longest common extensions.

A run of period p and at least four periods covers four multiples of p in a row. So for each p the words at jp, (j+1)p,
(j+2)p and (j+3)p are compared first: where they differ, the extension is zero and the grid point is done. The other
points ask how far jp and (j+1)p agree forwards and backwards: a suffix array of the document's words and one of the
reversed words (prefix doubling), the lengths that neighbours in them share, and range minima over these answer in
constant time. Forward plus backward plus p is the whole stretch of that period. Of the periods that one stretch has, the
smallest is its own. Every document is answered whole, with arrays that grow with it alone; nothing is shuffled.

Defined results: null text has no words; a null doc_id counts as no planted repetition and keeps its words; texts of white
space alone have no words; rows that repeat are answered row by row; ties are broken by start, then period; an empty table
gives no rows; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many periods and this many words.
PERIODS, LEAST = 4, 6
#: Words up to which a worker keeps the grid; longer documents walk it period by period.
KEPT_GRID = 1 << 15

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Extensions:
    """Longest common extensions of two places, forwards."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        levels = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        step = 1
        while levels[-1].max(initial=0) < n - 1:  # until no two suffixes are equal
            now = levels[-1]
            behind = np.full(n, -1, np.int64)
            behind[: n - step] = now[step:]
            levels.append(np.unique(now * (n + 1) + behind + 1, return_inverse=True)[1].astype(np.int64))
            step *= 2
        self.n, self.rank = n, levels[-1]
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        shared, a, b = np.zeros(n, np.int64), order[:-1].copy(), order[1:].copy()
        for k in range(len(levels) - 2, -1, -1):
            same = np.flatnonzero((a < n) & (b < n))
            same = same[levels[k][a[same]] == levels[k][b[same]]]
            shared[same + 1] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        self.minima, width = [shared.astype(np.int32)], 1  # over 2^k places from each
        while 2 * width <= n:
            self.minima.append(np.minimum(self.minima[-1][:-width], self.minima[-1][width:]))
            width *= 2
        self.log = np.frexp(np.arange(n + 1))[1] - 1  # of a positive number, rounded down

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on agree; places differ and lie within the words."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level, out = self.log[high - low], np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        return out


_grid: list[np.ndarray] = [np.zeros(0, np.int32)] * 3


def _kept_grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of all grid points whose fourth multiple lies within ``n`` words, of a grid kept in order of it."""
    if len(_grid[0]) == 0 or _grid[2][-1] < n - 1:
        size = min(KEPT_GRID, max(1024, 1 << (n - 1).bit_length()))
        counts = [(p, len(range(0, size - (PERIODS - 1) * p, p))) for p in range(1, size // PERIODS + 1)]
        period = np.repeat(np.array([p for p, _ in counts], np.int32), [c for _, c in counts])
        place = np.concatenate([np.arange(c, dtype=np.int32) * p for p, c in counts])
        last = place + (PERIODS - 1) * period
        order = np.argsort(last, kind="stable")
        _grid[:] = place[order], period[order], last[order]
    most = np.searchsorted(_grid[2], n)
    return _grid[0][:most], _grid[1][:most]


def _points(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid points (place, period) at which this and the next three multiples hold the same word."""
    n = len(words)
    if n <= KEPT_GRID:
        place, period = _kept_grid(n)
        for k in range(PERIODS - 1):
            same = np.flatnonzero(words[place + k * period] == words[place + (k + 1) * period])
            place, period = place[same], period[same]
        return place.astype(np.int64), period.astype(np.int64)
    places, periods = [], []
    for p in range(1, n // PERIODS + 1):
        same = words[:-p:p] == words[p::p]
        found = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p
        if len(found):
            places.append(found)
            periods.append(np.full(len(found), p))
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.zeros(0, np.int64),) * 2


def runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbered words, by start, then period."""
    n = len(words)
    if n < least:
        return []
    i, p = _points(words)
    if not len(i):
        return []
    forward, backward = Extensions(words), Extensions(words[::-1])
    ahead, back = forward(i, i + p), np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    back[inner] = backward(n - i[inner], n - i[inner] - p[inner])
    start, length = i - back, back + ahead + p
    long = length >= np.maximum(least, PERIODS * p)
    start, length, p = start[long], length[long], p[long]
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    own = np.ones(len(start), bool)
    own[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])  # a stretch's smallest period is its own
    return sorted(zip(start[own].tolist(), length[own].tolist(), p[own].tolist()), key=lambda r: (r[0], r[2]))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the id asks for, if it does."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length over period; ties: smallest start, then period."""
    top = None
    for run in found:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(found, np.int64).T
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def _answer(doc_id: int | None, text: bytes) -> tuple:
    words = planted(text.split(), doc_id)  # of bytes: at ASCII white space
    number: dict[bytes, int] = {}
    found = runs(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
    top = best(found)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    own = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc_id, len(found), *own, digest(lines.encode()), digest(b" ".join(collapsed(words, found)))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_runs, the run of greatest exponent, digests of all runs and of the text without repetitions."""

    def run(batches):
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rows = [_answer(i, t.as_py() or b"") for i, t in zip(batch.column("doc_id").to_pylist(), texts)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
