"""Toxicity by weak supervision.

Many voters look at each text: fixed word lists by family, phrase patterns by family, and induced lexicons. Those hold words and word beginnings of 3 to 8 letters that stand in toxic training rows more often than
chance allows, each with its log likelihood ratio; a hash deals each kind into GROUPS lexicons, so that no two share a term.
A voter says toxic, not toxic, or abstains.

A generative label model estimates, without labels, each voter's accuracy and which voters hang together: within a class,
votes follow a tree of dependences, in which each voter's vote depends on the class and on the voter it shares most with
(conditional mutual information); expectation maximisation fits both. Its posteriors are the labels that a linear
classifier over voter strengths is trained on.

The bounded sample of labelled rows: about ``max_rows``, chosen by hash of their id, teach the lexicons and both models.
Near copies would make the words of one text look frequent: of the sampled texts whose word pairs have the same least hash,
under two hashes in turn, one teaches. All documents are scored, over their whole texts. Where labels disagree, of one doc_id or of equal texts, toxic wins.

Defined results: null and empty texts have no hits and get the score of such a text; very long texts are read whole; a
null label teaches nothing; without labelled texts the fixed word lists and phrases alone decide; an empty table gives no
rows; repeated rows get equal scores; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateforge.llm.common import fold, over_rows, sampled, stage, tidy, wanted

WORD = re.compile(r"[^\W\d_]+")
# The starting word lists and phrases by family.
LISTS = {
    "insults": "idiot idiots moron morons stupid dumb loser losers clown clowns imbecile cretin fool fools jerk creep freak retard dimwit halfwit numbskull",
    "contempt": "trash garbage scum pathetic worthless disgusting pig pigs vermin filth filthy degenerate",
    "profanity": "bastard bitch asshole crap damn hell shit fuck fucking wanker twat slut whore",
}
PHRASES = {
    "threats": r"go to hell|drop dead|kill yourself",
    "dismissal": r"shut up|nobody likes you|get lost",
    "hatred": r"i hate you|hate you all",
    "address": r"you (?:are|'re) (?:a |an |such a |so )?(?:idiot|moron|stupid|loser|trash|scum|clown|pathetic|worthless|disgusting)",
}
#: Every phrase has one of these words or one of the lists.
STEMS = frozenset("shut hell dead kill hate nobody lost".split())
LENGTHS = (3, 4, 5, 6, 7, 8)
GROUPS = 8
#: Evidence (a sum of log likelihood ratios) from which an induced lexicon votes toxic; with less it abstains.
ENOUGH = 4.0
VOTERS = [*LISTS, *PHRASES, *(f"words{k}" for k in range(GROUPS)), *(f"starts{k}" for k in range(GROUPS))]
FIXED = len(LISTS) + len(PHRASES)
PATTERNS = [re.compile(p, re.I) for p in PHRASES.values()]


def terms(text: str) -> set[str]:
    """Distinct words and their beginnings, each led by its kind."""
    words = set(WORD.findall(text.lower()))
    return {"w" + w for w in words} | {f"{k}{w[:k]}" for w in words if len(w) >= 3 for k in LENGTHS if len(w) >= k}


class Lexicons:
    def __init__(self, found: dict[str, float]):
        self.lists: dict[str, int] = {w: i for i, words in enumerate(LISTS.values()) for w in words.split()}
        self.found = {t: (FIXED + (t[0] != "w") * GROUPS + zlib.crc32(t.encode()) % GROUPS, w) for t, w in found.items()}
        self.known: dict[str, tuple] = {}

    def _of(self, word: str) -> tuple:
        """(voter, strength) of every term that the word is or begins with."""
        got = tuple(x for t in ("w" + word, *(f"{k}{word[:k]}" for k in LENGTHS if len(word) >= k)) if (x := self.found.get(t)))
        if word in self.lists:
            got += ((self.lists[word], 1.0),)
        if len(self.known) > 200_000:  # words seen so far, to be looked up once
            self.known.clear()
        self.known[word] = got
        return got

    def hits(self, text: str) -> list[float]:
        """Strength of each voter, and the number of words."""
        words = WORD.findall(text.lower())
        strength, known, fixed = [0.0] * len(VOTERS), self.known, False
        distinct = set(words)
        for w in distinct:
            for voter, x in known[w] if w in known else self._of(w):
                strength[voter] += x
        if any(strength[: len(LISTS)]) or not STEMS.isdisjoint(distinct):
            for i, pattern in enumerate(PATTERNS):
                strength[len(LISTS) + i] = float(len(pattern.findall(text)))
        return [*strength, float(len(words))]


def _count_terms(most: int = 300_000):
    def run(batches):
        toxic, clean = Counter(), Counter()

        def flush():
            names = list(toxic.keys() | clean.keys())
            for k in range(0, len(names), 50_000):
                part = names[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())], names=["term", "toxic", "clean"])
            toxic.clear()
            clean.clear()

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                (toxic if label else clean).update(terms(text.as_py() or ""))
                if len(toxic) + len(clean) > most:
                    yield from flush()
        yield from flush()

    return run


def induce(sample: DataFrame, n_toxic: int, n_clean: int, max_terms: int = 20_000) -> dict[str, float]:
    """Terms of toxic rows that chance does not explain, with their log likelihood ratios.

    Kept are terms at least four times as frequent among toxic rows whose rows, were they drawn at the classes' shares,
    would look so toxic less than once over all candidate terms (those in three rows or more).
    """
    if not n_toxic or not n_clean:
        return {}
    counted, _ = stage(sample.mapInArrow(_count_terms(), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean >= 3"))
    base = n_toxic / (n_toxic + n_clean)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    part = lambda n, p, q: F.when(F.col(n) > 0, F.col(n) * F.log(p / q)).otherwise(0.0)
    surprise = part("toxic", share, F.lit(base)) + part("clean", 1 - share, F.lit(1 - base))
    ratio = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    least = math.log(max(2, counted.count()))
    rows = counted.select("term", ratio.alias("ratio"), surprise.alias("surprise")).where((F.col("ratio") >= math.log(4)) & (F.col("surprise") >= least)).orderBy(F.desc("surprise"), "term").limit(max_terms).collect()
    return {r.term: r.ratio for r in rows}


def votes(hits: np.ndarray) -> np.ndarray:
    """1 for a hit or enough evidence. Without: word lists say -1; induced lexicons say -1 without any evidence and else abstain; patterns abstain."""
    h = hits[:, : len(VOTERS)]
    v = np.where(h >= np.array([1.0] * FIXED + [ENOUGH] * (len(VOTERS) - FIXED)), 1, np.where(h > 0, 0, -1))
    v[:, len(LISTS) : FIXED] = np.maximum(v[:, len(LISTS) : FIXED], 0)
    return v


class LabelModel:
    """Two classes; within each, votes form a tree: parent[j] is the voter that j depends on besides the class, -1 for none."""

    def fit(self, v: np.ndarray, rounds: int = 80, weight: float = 4.0, least: float = 0.01) -> LabelModel:
        n, m = v.shape
        one_hot = (v[:, :, None] == np.array([-1, 0, 1])).reshape(n, 3 * m).astype(np.float64)
        post = np.clip((v > 0).sum(axis=1) / 2.0, 0.02, 0.98)
        for k in range(rounds):
            self.prior = float(np.clip(post.mean(), 1e-4, 1 - 1e-4))
            joint = [((one_hot * p[:, None]).T @ one_hot).reshape(m, 3, m, 3) for p in (1 - post, post)]
            self.share = [(np.einsum("jaja->ja", j) + 1) / (p.sum() + 3) for j, p in zip(joint, (1 - post, post))]
            if not k:
                self.parent = [-1] * m  # first the classes, by voters as if independent; then what hangs together within them
            elif k >= 10 and k % 5 == 0:
                self.parent, self.information = self._tree(joint, n, least)
            self.table = [self._tables(j, s, weight) for j, s in zip(joint, self.share)]
            post = self.posterior(v)
        self.accuracy = self.prior * self.share[1][:, 2] + (1 - self.prior) * self.share[0][:, 0]
        return self

    @staticmethod
    def _tree(joint: list[np.ndarray], n: int, least: float) -> tuple[list[int], np.ndarray]:
        """Parents in the tree of greatest conditional mutual information; links under ``least`` are none."""
        m = len(joint[0])
        shared = np.zeros((m, m))
        for j in joint:
            p = j / n
            alone = np.einsum("jaja->ja", p)
            whole = max(alone[0].sum(), 1e-12)
            with np.errstate(divide="ignore", invalid="ignore"):
                shared += np.nansum(np.where(p > 0, p * np.log(p * whole / (alone[:, :, None, None] * alone[None, None])), 0), axis=(1, 3))
        parent, reach = [-1] * m, [(-1.0, -1)] * m
        left, now = set(range(1, m)), 0
        while left:
            for j in left:
                if shared[now, j] > reach[j][0]:
                    reach[j] = (shared[now, j], now)
            now = max(left, key=lambda j: (reach[j][0], -j))
            left.discard(now)
            parent[now] = reach[now][1] if reach[now][0] >= least else -1
        return parent, shared

    def _tables(self, joint: np.ndarray, share: np.ndarray, weight: float) -> list[np.ndarray]:
        """Probability of each voter's vote (columns) after its parent's (rows), drawn to its own share."""
        found = []
        for j, p in enumerate(self.parent):
            counts = joint[p, :, j, :] if p >= 0 else np.zeros((3, 3))
            found.append((counts + weight * share[j]) / (counts.sum(axis=1, keepdims=True) + weight))
        return found

    def posterior(self, v: np.ndarray) -> np.ndarray:
        z = np.full(len(v), math.log(self.prior / (1 - self.prior)))
        for j, p in enumerate(self.parent):
            above = v[:, p] + 1 if p >= 0 else 0
            z += np.log(self.table[1][j] / self.table[0][j])[above, v[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(hits: np.ndarray) -> np.ndarray:
    """Of each voter: whether it votes toxic, how strongly, and how densely; and of the induced ones together."""
    h = hits[:, : len(VOTERS)].astype(np.float64)
    words = np.maximum(hits[:, -1:], 1)
    both = np.stack([h[:, FIXED : FIXED + GROUPS].sum(axis=1), h[:, FIXED + GROUPS :].sum(axis=1)], axis=1)
    return np.hstack([votes(hits) > 0, np.log1p(h), np.minimum(1, 10 * h / words), np.log1p(both), np.minimum(1, 10 * both / words), np.ones((len(h), 1))])


def unlearned() -> np.ndarray:
    """Weights without a sample: a hit of a fixed list or phrase is toxic."""
    w = np.zeros(features(np.zeros((1, len(VOTERS) + 1))).shape[1])
    w[:FIXED], w[-1] = 4.0, -2.0
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _hits(sent):
    def run(batches):
        lexicons = sent.value
        for batch in batches:
            rows = [lexicons.hits(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["hits"])

    return run


def _score(sent):
    def run(batches):
        lexicons, w = sent.value
        for batch in batches:
            hits = np.array([lexicons.hits(t.as_py() or "") for t in batch.column("text")]).reshape(-1, len(VOTERS) + 1)
            score = 1 / (1 + np.exp(-np.clip(features(hits) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(hits[:, :-1].tolist(), pa.list_(pa.float64()))], names=["doc_id", "held_out", "score", "predicted", "hits"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, max_rows: int) -> DataFrame:
    """text and label of about ``max_rows`` labelled doc_ids outside the held-out fold, equal texts once; where labels disagree the greatest holds."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias(column)).where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != 0))
    marks = sampled(marks.groupBy("doc_id").agg(F.max(column).alias(column)), max_rows)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(marks), "doc_id")
    return stage(found.groupBy("text").agg(F.max(column).alias(column)))[0]


def _families(batches):
    """Rows (text, toxic, a, b): the least hash of the text's word pairs under either seed."""
    for batch in batches:
        keys: tuple[list, list] = ([], [])
        for text in batch.column("text").to_pylist():
            words = text.lower().split()
            pairs = {f"{x} {y}".encode() for x, y in zip(words, words[1:])} or {" ".join(words).encode()}
            for seed, out in zip((1, 2), keys):
                out.append(min(xxhash.xxh64_intdigest(p, seed) for p in pairs) >> 1)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("text", "toxic")), *(pa.array(k, pa.int64()) for k in keys)], names=["text", "toxic", "a", "b"])


def one_of_each_family(sample: DataFrame) -> DataFrame:
    """(text, toxic) of one text of each family of near copies."""
    rows = sample.select("text", "toxic").mapInArrow(_families, "text string, toxic int, a long, b long")
    for key in ("a", "b"):
        rows = rows.groupBy(key).agg(F.max("toxic").alias("toxic"), F.min(F.struct("text", *[c for c in ("a", "b") if c != key])).alias("one")).select("one.*", "toxic", key)
    return stage(rows.select("text", "toxic"))[0]


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, max_rows: int = 20_000) -> tuple[Lexicons, np.ndarray, LabelModel | None]:
    spark = docs.sparkSession
    sample = one_of_each_family(labelled_sample(docs, labels, "toxic", modulus, max_rows))
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    lexicons = Lexicons(induce(sample, counts.get(1, 0), counts.get(0, 0)))
    if not counts:
        return lexicons, unlearned(), None
    rows = sample.select("text").mapInArrow(_hits(spark.sparkContext.broadcast(lexicons)), "hits array<double>").collect()
    hits = np.array(sorted(r.hits for r in rows))
    v = votes(hits)
    model = LabelModel().fit(v)
    return lexicons, logistic(features(hits), model.posterior(v)), model


@tidy
def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, max_rows: int = 20_000) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, hits (of each voter, in VOTERS' order)."""
    docs = wanted(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold("doc_id", modulus) == 0).alias("held_out"))
    lexicons, w, _ = fit(docs, labels, modulus, max_rows)
    sent = docs.sparkSession.sparkContext.broadcast((lexicons, w))
    return docs.mapInArrow(_score(sent), "doc_id long, held_out boolean, score double, predicted int, hits array<double>")


@tidy
def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not predict to be toxic."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold("doc_id", 5) == 0).alias("held_out"))
    lexicons, w, _ = fit(plain, labels)
    score = _score(docs.sparkSession.sparkContext.broadcast((lexicons, w)))

    def run(batches):
        return score(b.append_column("held_out", pa.array([False] * b.num_rows)) for b in batches)

    return over_rows(docs, run, lambda rows, found: rows.filter(pc.equal(found.column("predicted"), 0)))
