"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1 outside the held-out fold; unlabelled text is every document outside that
fold, whatever it is. A linear model z of the features minimises the non-negative unbiased risk with squared loss: prior *
R+(positives) plus the part of the unlabelled risk as negatives that positives do not explain, held at zero or above. With
this loss the risk depends on the rows only through their number, mean and outer products, which tasks sum up in one pass,
so that all unlabelled text counts, exactly, and what is exchanged has the size of the features squared.

The class prior is estimated from unlabelled scores: a first model scores all unlabelled text into a histogram, and the
prior is the least quotient of the shares of unlabelled rows and of trusted positives that it was not fitted to above a
score. Features describe writing, not topic: how often a class of byte follows another, and how much words and lines repeat.

The bounded sample of labelled rows: about ``max_rows`` positives, chosen by hash of their id. Labels of other value are
never read as negatives; a document is trusted only if all its labels are 1.

Defined results: null and empty texts have zero features and get the score of such a text; very long texts are read whole;
without trusted positives every score is a half; an empty table gives no rows; repeated rows get equal scores; extra
columns, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateforge.llm.common import fold, sampled, tidy, wanted

# Classes of bytes; every byte not named is in the last class.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "#$%&*+=~^@", "()[]{}<>", "'\"`-_/\\"]
N_CLASSES = len(CLASSES) + 2  # one for bytes of other characters, one for the rest
CLASS_OF = np.full(256, N_CLASSES - 1, np.int64)
for _k, _c in enumerate(CLASSES):
    CLASS_OF[list(_c.encode())] = _k
CLASS_OF[128:] = N_CLASSES - 2
EXTRA = 12
WIDTH = N_CLASSES * N_CLASSES + N_CLASSES + EXTRA


def _repeats(text: bytes) -> list[float]:
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    if not n:
        return [0.0] * EXTRA
    kinds = len(set(words))
    filled = [line for line in lines if line.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    longest = max(map(len, words))
    return [
        np.log1p(n) / 10, kinds / n, np.log1p(kinds) / np.log1p(n), same / n, np.log1p(same) / 5, 1 - len(set(filled)) / max(1, len(filled)),
        np.log1p(len(filled) - len(set(filled))) / 5, len(filled) / n, len(text) / n / 10, min(1.0, longest / 50), float(n < 5), np.log1p(len(filled)) / 5,
    ]


def features(texts: list[bytes]) -> np.ndarray:
    """Row per text: shares of byte classes and of pairs of them (square roots), and repetition."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    data = CLASS_OF[np.frombuffer(b"".join(texts), np.uint8)]
    doc = np.repeat(np.arange(n), sizes)
    single = np.bincount(doc * N_CLASSES + data, minlength=n * N_CLASSES).reshape(n, -1)
    inside = doc[1:] == doc[:-1]
    pair = np.bincount((doc[1:] * N_CLASSES**2 + data[:-1] * N_CLASSES + data[1:])[inside], minlength=n * N_CLASSES**2).reshape(n, -1)
    by = np.maximum(sizes, 1)[:, None]
    return np.hstack([np.sqrt(pair / by), np.sqrt(single / by), np.array([_repeats(t) for t in texts]).reshape(n, EXTRA)]).astype(np.float32)


def _parts(texts: list[bytes], limit: int = 2 << 20):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _chunked(texts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros((0, WIDTH), np.float32), *(features(part) for part in _parts(texts))])


class Moments:
    """Number, mean and mean outer product of feature rows (a leading 1 included): all that the risk needs of them."""

    def __init__(self, n: float, total: np.ndarray):
        self.n = n
        self.outer = total / max(n, 1)
        self.mean = self.outer[0]

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        x = with_one(x)
        return cls(len(x), x.T @ x)

    def as_negative(self, w: np.ndarray) -> float:
        """Mean of (1 + z)^2 / 4, the squared loss of calling the rows negative."""
        return float(1 + 2 * self.mean @ w + w @ self.outer @ w) / 4

    def as_positive(self, w: np.ndarray) -> float:
        return float(1 - 2 * self.mean @ w + w @ self.outer @ w) / 4


def with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x.astype(np.float64)])


def risk(w: np.ndarray, positive: Moments, unlabelled: Moments, prior: float) -> tuple[float, float]:
    """The positives' part, and the part of the unlabelled rows as negatives that positives do not explain."""
    return prior * positive.as_positive(w), unlabelled.as_negative(w) - prior * positive.as_negative(w)


def descend(positive: Moments, unlabelled: Moments, prior: float, ridge: float = 1e-4, rounds: int = 200, rate: float = 0.2) -> np.ndarray:
    """Weights of least non-negative risk found: scaled gradient steps; while the second part is under zero, only the way back."""
    width = len(positive.mean)
    scale = np.linalg.inv(unlabelled.outer / 2 + ridge * np.eye(width))
    w = scale @ (prior * positive.mean - unlabelled.mean / 2)  # least of the unbiased risk, where the second part may be negative
    best, least = w, np.inf
    for _ in range(rounds):
        plus, minus = risk(w, positive, unlabelled, prior)
        total = plus + max(0.0, minus) + ridge / 2 * float(w @ w)
        if total < least:
            best, least = w, total
        back = (unlabelled.mean + unlabelled.outer @ w) / 2 - prior * (positive.mean + positive.outer @ w) / 2
        g = prior * (positive.outer @ w - positive.mean) / 2 + back + ridge * w if minus >= 0 else -back
        w = w - rate * scale @ g
    return best


#: z is twice the probability less one; this steepness gives score 0.3 where that probability is 0.3.
STEEP = np.log(7 / 3) / 0.4


def scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-STEEP * np.clip(with_one(x) @ w, -12, 12)))


BINS = 2000


def share_above(places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Share of rows in each bin of the score or a higher one."""
    full = np.bincount(places, counts, BINS)
    return np.cumsum(full[::-1])[::-1] / max(1, full.sum())


def estimate_prior(positive: np.ndarray, n_positive: int, unlabelled: np.ndarray, n_unlabelled: int) -> float:
    """Share of positives among the unlabelled rows, from the shares of both above each score: the least quotient of them, with room for chance."""
    room = sum(np.sqrt(np.log(40) / 2 / max(n, 1)) for n in (n_positive, n_unlabelled))
    enough = positive > 0.05
    bound = np.where(enough, (unlabelled + 1.01 * room) / np.where(enough, positive, 1), np.inf)
    k = int(np.argmin(bound))
    return float(np.clip(unlabelled[k] / max(positive[k], 1e-9), 0.01, 0.99))


def _features(batches):
    for batch in batches:
        x = _chunked([t.as_py() or b"" for t in batch.column("text").cast(pa.binary())])
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])


def _matrix(df: DataFrame) -> np.ndarray:
    """Features of a bounded sample, in an order that does not depend on which task ended first."""
    rows = sorted(df.select("text").mapInArrow(_features, "x binary").toArrow().column("x").to_pylist())
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), WIDTH)


def _moments(batches):
    """A task's number of rows and sum of outer products."""
    n, total = 0, np.zeros((WIDTH + 1, WIDTH + 1))
    for batch in batches:
        for part in _parts([t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]):
            x = with_one(features(part))
            n, total = n + len(x), total + x.T @ x
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])


def _added(batches):
    """The sum of tasks' sums."""
    n, total = 0, np.zeros((WIDTH + 1, WIDTH + 1))
    for batch in batches:
        for k, x in zip(batch.column("n").to_pylist(), batch.column("total").to_pylist()):
            n, total = n + k, total + np.frombuffer(x).reshape(WIDTH + 1, WIDTH + 1)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])


def moments(docs: DataFrame, meet: int = 16) -> Moments:
    """Of all rows of ``docs`` (text): tasks' sums meet in ``meet`` tasks, and those at the driver."""
    rows = docs.select("text").mapInArrow(_moments, "n long, total binary").repartition(meet).mapInArrow(_added, "n long, total binary").collect()
    return Moments(sum(r.n for r in rows), np.sum([np.frombuffer(r.total).reshape(WIDTH + 1, WIDTH + 1) for r in rows], axis=0) if rows else np.zeros((WIDTH + 1, WIDTH + 1)))


def _histogram(sent):
    def run(batches):
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            counts += np.bincount(_bins(scores(_chunked([t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]), sent.value)), minlength=BINS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bin", "n"])

    return run


def _bins(score: np.ndarray) -> np.ndarray:
    return np.minimum((score * BINS).astype(np.int64), BINS - 1)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, max_rows: int = 8_000) -> tuple[np.ndarray, float]:
    """Weights and estimated prior. Half of the trusted positives teach, the other half and all unlabelled rows tell the prior."""
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where((fold("doc_id", modulus) != 0) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    trusted = sampled(marks.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id"), max_rows)
    rows = docs.where("text is not null").join(F.broadcast(trusted), "doc_id")
    positive = _matrix(rows)
    if len(positive) < 2:
        return np.zeros(WIDTH + 1), 0.5
    unlabelled = moments(docs.where("not held_out"))
    taught, kept = Moments.of(positive[::2]), positive[1::2]
    first = descend(taught, unlabelled, 0.5)
    counted = docs.where("not held_out").select("text").mapInArrow(_histogram(spark.sparkContext.broadcast(first)), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    above = share_above(counted.column("bin").to_numpy(), counted.column("n").to_numpy())
    prior = estimate_prior(share_above(_bins(scores(kept, first)), np.ones(len(kept))), len(kept), above, int(unlabelled.n))
    return descend(Moments.of(positive), unlabelled, prior), prior


def _score(sent, threshold: float):
    def run(batches):
        for batch in batches:
            score = scores(_chunked([t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


@tidy
def quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, threshold: float = 0.3, max_rows: int = 8_000) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    docs = wanted(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold("doc_id", modulus) == 0).alias("held_out"))
    w, _ = fit(docs, labels, modulus, max_rows)
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(w), threshold), "doc_id long, held_out boolean, score double, predicted int")
