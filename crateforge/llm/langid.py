"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text's bytes are cut into windows that are run side by side. Forward and backward states meet in a head that labels
every byte position; a document's probabilities are the mean of its positions'. Training is backpropagation through time.

The bounded sample of labelled rows: every window of every labelled training text is a candidate, whatever the length of
its text or its place in it, and is drawn with the same chance, so that about ``per_language`` windows of each language
reach the driver. How many candidates there are is counted over all texts; nothing is ranked.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was
learned; very long texts are scored whole; an empty table gives no rows; repeated rows give repeated results; a null
doc_id counts as remainder 0; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateforge.llm.common import fold, tidy, wanted

WORDY = re.compile(r"[^\W\d_]")
SPACE = 32


def has_letter(text: str) -> bool:
    """Whether any character is a letter; numbers such as fractions and numerals, which are word characters too, are none."""
    return any(m[0].isalpha() for m in WORDY.finditer(text))


class Network:
    """Weights of both directions stacked on the first axis: tables of each byte's input to reset, update and candidate, and the recurrent matrices."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        small = lambda *s, by=0.3: (draw.standard_normal(s) * by).astype(np.float32)
        self.w = {"tab": small(3, 2, 256, hidden), "rec": small(3, 2, hidden, hidden), "head": small(2 * hidden, len(labels)), "bias": np.zeros(len(labels), np.float32)}

    def states(self, data: np.ndarray, keep: bool = False):
        """data (steps, n) -> states (steps, n, 2 * hidden): forward of what is read so far, backward of what is to come."""
        steps, n = data.shape
        h = self.hidden
        out = np.empty((steps, n, 2 * h), np.float32)
        kept = [[], []]
        for d in (0, 1):
            tab, rec = self.w["tab"][:, d], self.w["rec"][:, d]
            state = np.zeros((n, h), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x = data[t]
                gate = [tab[k].take(x, axis=0) for k in range(3)]
                for k in (0, 1):  # reset, update: logistic, as tanh of half
                    gate[k] += state @ rec[k]
                    np.tanh(gate[k], out=gate[k])
                    gate[k] += 1
                    gate[k] *= 0.5
                mixed = gate[0] * state
                gate[2] += mixed @ rec[2]
                np.tanh(gate[2], out=gate[2])
                if keep:
                    kept[d].append((t, state, *gate, mixed))
                state = gate[2] + gate[1] * (state - gate[2])
                out[t, :, d * h : (d + 1) * h] = state
        return out, kept

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        z = states @ self.w["head"] + self.w["bias"]
        z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=-1, keepdims=True)
        return z

    def gradients(self, data: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions."""
        steps, n = data.shape
        h = self.hidden
        states, kept = self.states(data, keep=True)
        dz = self.probabilities(states)
        dz[:, np.arange(n), y] -= 1
        dz /= steps * n
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["head"] = states.reshape(-1, 2 * h).T @ dz.reshape(-1, dz.shape[2])
        grad["bias"] = dz.sum(axis=(0, 1))
        back = dz @ self.w["head"].T
        for d in (0, 1):
            rec, flow = self.w["rec"][:, d], np.zeros((n, h), np.float32)
            for t, state, r, u, c, mixed in reversed(kept[d]):
                flow = flow + back[t, :, d * h : (d + 1) * h]
                du = flow * (state - c) * u * (1 - u) * 2  # the gates' inputs are halves of the logistic's
                dc = flow * (1 - u) * (1 - c * c)
                dm = dc @ rec[2].T
                dr = dm * state * r * (1 - r) * 2
                for k, g, left in ((0, dr, state), (1, du, state), (2, dc, mixed)):
                    grad["rec"][k, d] += left.T @ g
                    np.add.at(grad["tab"][k, d], data[t], g)
                flow = flow * u + dm * r + dr @ rec[0].T + du @ rec[1].T
        return grad

    def fit(self, data: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 2, least: int = 250) -> Network:
        """Adam; every language weighs the same, as its windows are drawn equally often."""
        draw = np.random.default_rng(seed)
        first, second, t = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2)), None, 0
        first, second = first
        groups = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        total = max(least, epochs * len(y) // batch)
        for t in range(1, total + 1):
            pick = np.concatenate([draw.choice(g, max(1, batch // len(groups))) for g in groups if len(g)])
            grad = self.gradients(data[:, pick], y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            pace = rate * (1 - 0.9 * t / total)
            for k, g in grad.items():
                g = g / max(1.0, norm)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= pace * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def score(self, texts: list[bytes], steps: int = 64, side: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities (documents, labels), and how many positions each label got."""
        sizes = np.array([len(t) for t in texts], np.int64)
        wide = -(-sizes // steps)
        raw = np.frombuffer(b"".join(t.ljust(int(w) * steps, b" ") for t, w in zip(texts, wide)), np.uint8).reshape(-1, steps)
        doc = np.repeat(np.arange(len(texts)), wide)
        within = np.arange(len(raw)) - np.repeat(np.cumsum(wide) - wide, wide)
        length = np.minimum(steps, sizes[doc] - within * steps)
        total = np.zeros((len(texts), len(self.labels)))
        votes = np.zeros((len(texts), len(self.labels)), np.int64)
        for k in range(0, len(raw), side):
            data = np.ascontiguousarray(raw[k : k + side].T)
            p = self.probabilities(self.states(data)[0])
            real = np.arange(steps)[:, None] < length[None, k : k + side]
            best = p.argmax(axis=2)
            for j in range(len(self.labels)):
                total[:, j] += np.bincount(doc[k : k + side], np.where(real, p[:, :, j], 0).sum(axis=0), len(texts))
                votes[:, j] += np.bincount(doc[k : k + side], (real & (best == j)).sum(axis=0), len(texts)).astype(np.int64)
        return total / np.maximum(sizes, 1)[:, None], votes


def _draw_windows(steps: int, chance: dict[str, float], seed: int):
    """Rows (lang, window): of each text's windows those that chance draws; the draw depends on the document alone."""

    def run(batches):
        for batch in batches:
            langs, windows = [], []
            for doc, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                raw = text.as_py()
                draw = np.random.default_rng((seed, abs(doc or 0), len(raw)))
                for k in np.flatnonzero(draw.random(-(-len(raw) // steps)) < chance[lang]).tolist():
                    langs.append(lang)
                    windows.append(raw[k * steps : (k + 1) * steps].ljust(steps, b" "))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])

    return run


def train(docs: DataFrame, per_language: int = 2400, steps: int = 64, hidden: int = 8, epochs: int = 4) -> Network | None:
    """Network of the languages of ``docs`` (doc_id, text, lang), from about ``per_language`` windows of each."""
    known = docs.where("lang is not null and text rlike '\\\\p{L}'").select("doc_id", "lang", "text")
    count = known.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / F.lit(steps))).alias("n")).collect()
    chance = {r.lang: per_language / r.n for r in count}
    drawn = known.mapInArrow(_draw_windows(steps, chance, 3), "lang string, window binary").toArrow()
    langs = np.array(drawn.column("lang").to_pylist(), object)
    if not len(langs):
        return None
    labels = sorted(set(langs))
    data = np.frombuffer(b"".join(drawn.column("window").to_pylist()), np.uint8).reshape(len(langs), steps)
    y = np.array([labels.index(x) for x in langs])
    by = np.lexsort((*data.T[:8], y))  # the same order whichever task ended first
    return Network(labels, hidden).fit(np.ascontiguousarray(data[by].T), y[by], epochs)


def _predict(sent):
    def run(batches):
        net = sent.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            known = [i for i, t in enumerate(texts) if net is not None and t and has_letter(t)]
            pred, score, shares = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            part, size = [], 0
            for i in [*known, None]:
                if part and (i is None or size >= 1 << 22):
                    p, votes = net.score([texts[j].encode() for j in part])
                    for j, q, v in zip(part, p, votes):
                        pred[j], score[j], shares[j] = net.labels[int(q.argmax())], float(min(1.0, q.max())), v.tolist()
                    part, size = [], 0
                if i is not None:
                    part.append(i)
                    size += len(texts[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred), pa.array(score), pa.array(shares, pa.list_(pa.int64()))], names=["doc_id", "held_out", "lang_pred", "score", "positions"])

    return run


@tidy
def identify(docs: DataFrame, modulus: int = 4, out: int = 2, per_language: int = 2400) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, positions (how many bytes each learned language got, by name)."""
    docs = wanted(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (fold("doc_id", modulus) == out).alias("held_out"))
    sent = docs.sparkSession.sparkContext.broadcast(train(docs.where("not held_out"), per_language))
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(sent), "doc_id long, held_out boolean, lang_pred string, score double, positions array<long>")
