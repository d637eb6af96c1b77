"""Secret scans by grammar inference.

Labelled credentials are of two sources: made ones of public formats, and values that the corpus's own texts assign to a
password, secret, token or key, grouped by shape, so that a format which no list has is learned where it stands labelled and
found where it does not. The credentials of each format form a prefix tree; states that have equal rests to come and whose frequencies a
Hoeffding bound cannot tell apart are merged (red-blue order) into a probabilistic automaton per format. Every candidate
token of a text is then scored by its log likelihood per symbol under the best automaton against that under ordinary
tokens, whose symbol pairs are counted over all texts, base spans left out.

Base kinds (always kept): assign, access, hex. Added by the method: ``format`` spans, candidates whose score is at
least ``threshold`` and that overlap no base span.

Defined results: null and empty texts have no spans; very long texts, also of one token, are scanned whole; an empty table
gives no rows; offsets are code points; repeated rows give repeated results; extra columns, whatever their names, are
left out.
"""

from __future__ import annotations

import heapq
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateforge.llm import spans
from crateforge.llm.common import column_of, over_rows, stage, tidy, wanted

KINDS = ["assign", "access", "hex"]
# The patterns of the base kinds.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = "[A-Za-z0-9+/_.=-]{%d,}"
ALNUM = string.ascii_letters + string.digits
# Public credential formats as (name, parts); a part is a literal, or an alphabet and a length or a range of them.
FORMATS = [
    ("access_key", ["AKIA", (string.ascii_uppercase + string.digits, 16)]),
    ("code_host", ["ghp_", (ALNUM, 36)]),
    ("chat_bot", ["xoxb-", (string.digits, 11), "-", (string.digits, 12), "-", (ALNUM, 24)]),
    ("payments", ["sk_live_", (ALNUM, 24)]),
    ("maps_key", ["AIza", (ALNUM + "_-", 35)]),
    ("web_token", ["eyJ", (ALNUM + "_-", range(17, 60)), ".eyJ", (ALNUM + "_-", range(30, 200)), ".", (ALNUM + "_-", 43)]),
    ("hex_digest", [("0123456789abcdef", 40)]),
    ("random_key", [(ALNUM + "+/", 40)]),
]
#: The kind of each letter and digit; every other symbol is a kind of its own.
KIND = {c: kind for kind in (string.ascii_lowercase, string.ascii_uppercase, string.digits) for c in kind}
#: Ordinary tokens for the rival model: long words and identifiers built from these syllables and joiners.
SYLLABLES = "the tion er ing and ent ion ation for ed es re der die ung sch ver que de la con mente os as un est le".split()


def labelled(per_format: int = 150, seed: int = 7) -> list[tuple[str, str]]:
    """Labelled credentials of the public formats: (format, value)."""
    draw = random.Random(seed)
    size = lambda n: n if isinstance(n, int) else draw.choice(n)
    return [(name, "".join(p if isinstance(p, str) else "".join(draw.choices(p[0], k=size(p[1]))) for p in parts)) for name, parts in FORMATS for _ in range(per_format)]


def ordinary(n: int = 500, seed: int = 11) -> list[str]:
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices(SYLLABLES, k=draw.randint(1, 4)))
    return [draw.choice(("_", "-", ".", "/", "")).join(word() for _ in range(draw.randint(2, 5))) for _ in range(n)]


class Automaton:
    """Probabilistic automaton by merging the states of a prefix tree: out[q][c] = next, count[q][c], ends[q].

    States are merged if they may be followed by the same: a bound on frequencies cannot tell their next symbols apart, and
    their rests agree, that is, as many are to come of each mark that every labelled value has equally often, and the ranges
    of how many symbols are to come meet (of the two states themselves). A format of one length thus becomes a chain, in which each place knows its
    alphabet and no other length can end; where lengths vary, places between the same marks become loops.
    """

    def __init__(self, words: list[str], alpha: float = 0.05):
        self.out: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.rest: list[dict] = [{}]
        self.ends, self.alpha = [0], alpha
        every = set("".join(words)) - KIND.keys()
        marks = sorted(c for c in every if len({w.count(c) for w in words}) == 1)
        self.kind = KIND | dict.fromkeys(every - set(marks), "".join(sorted(every - set(marks))))
        for word in words:
            q = 0
            for i, c in enumerate(word):
                self._widen(q, tuple(word.count(m, i) for m in marks), len(word) - i, len(word) - i)
                if c not in self.out[q]:
                    self.out[q][c] = len(self.out)
                    self.out.append({})
                    self.count.append(Counter())
                    self.rest.append({})
                    self.ends.append(0)
                self.count[q][c] += 1
                q = self.out[q][c]
            self._widen(q, (0,) * len(marks), 0, 0)
            self.ends[q] += 1
        red = self._merge_all()
        place = {q: i for i, q in enumerate(red)}
        self.out = [{c: place[x] for c, x in self.out[q].items()} for q in red]
        self.count, self.ends = [self.count[q] for q in red], [self.ends[q] for q in red]
        self.rest = []
        self.steps = [self._steps(q) for q in range(len(self.out))]
        self.end_log = [math.log(n / (n + k.total())) if n else -math.inf for n, k in zip(self.ends, self.count)]

    def _widen(self, q: int, marks: tuple, least: int, most: int) -> None:
        a, b = self.rest[q].get(marks, (least, most))
        self.rest[q][marks] = min(a, least), max(b, most)

    def _rests_meet(self, a: int, b: int) -> bool:
        x, y = self.rest[a], self.rest[b]
        return any(x[m][0] <= y[m][1] and y[m][0] <= x[m][1] for m in x.keys() & y.keys())

    def _total(self, q: int) -> int:
        return self.ends[q] + self.count[q].total()

    def _alike(self, a: int, b: int) -> bool:
        """Whether a and b, and the states that follow both, may be one."""
        if not self._rests_meet(a, b):
            return False
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self.rest[a].keys().isdisjoint(self.rest[b]):
                return False
            n, m = self._total(a), self._total(b)
            bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (n**-0.5 + m**-0.5)
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a][c] / n - self.count[b][c] / m) > bound:
                    return False
            todo += [(self.out[a][c], self.out[b][c]) for c in self.out[a].keys() & self.out[b].keys() if self.out[a][c] != self.out[b][c]]
        return True

    def _fold(self, a: int, b: int) -> list[int]:
        """Adds the tree under b to a; the states that changed."""
        todo, changed = [(a, b)], []
        while todo:
            a, b = todo.pop()
            changed.append(a)
            self.ends[a] += self.ends[b]
            self.count[a] += self.count[b]
            for marks, (least, most) in self.rest[b].items():
                self._widen(a, marks, least, most)
            for c, q in self.out[b].items():
                if c in self.out[a]:
                    todo.append((self.out[a][c], q))
                else:
                    self.out[a][c] = q
        return changed

    def _merge_all(self) -> list[int]:
        """The states that stay: in the order in which they are reached, each child of one is merged into one that stays, or stays itself."""
        red, place, todo = [0], {0: 0}, [0]
        while todo:
            at = heapq.heappop(todo)
            parent = red[at]
            c = next((c for c in sorted(self.out[parent]) if self.out[parent][c] not in place), None)
            if c is None:
                continue
            q = self.out[parent][c]
            target = next((r for r in reversed(red) if self._alike(r, q)), None)
            if target is None:
                place[q] = len(red)
                red.append(q)
                changed = [q]
            else:
                self.out[parent][c] = target
                changed = self._fold(target, q)
            for i in {at, *(place[x] for x in changed if x in place)}:
                heapq.heappush(todo, i)
        return red

    def _steps(self, q: int) -> dict[str, tuple[float, int]]:
        """Symbol -> log probability and next state. Half of the mass goes by symbol, half by kind of symbol, so that symbols unseen here of a kind seen here can follow."""
        n, own = self._total(q), self.count[q]
        kinds: Counter = Counter()
        for c, k in own.items():
            kinds[self.kind.get(c, c)] += k
        found = {}
        for kind, k in kinds.items():
            symbols = kind if len(kind) > 1 else (kind,)
            nexts = Counter()
            for c in symbols:
                if c in own:
                    nexts[self.out[q][c]] += own[c]
            usual = nexts.most_common(1)[0][0]
            for c in symbols:
                found[c] = (math.log(0.5 * own[c] / n + 0.5 * k / n / len(symbols)), self.out[q].get(c, usual))
        return found

    def ways(self, run: str, start: int):
        """(end, log likelihood) of every token from ``start`` that the automaton accepts and no letter or digit goes on from."""
        q, total = 0, 0.0
        for i in range(start, len(run)):
            step = self.steps[q].get(run[i])
            if step is None:
                return
            total, q = total + step[0], step[1]
            if self.ends[q] and (i + 1 == len(run) or run[i + 1] not in KIND):
                yield i + 1, total + self.end_log[q]


SYMBOLS = ALNUM + "+/_.=-"
#: Number of each byte that a token may have, from 1; 0 for all others, which stand between tokens.
CODE = np.zeros(256, np.int64)
CODE[list(SYMBOLS.encode())] = np.arange(1, len(SYMBOLS) + 1)
WIDE = len(SYMBOLS) + 1


def pair_counts(texts: list[str]) -> np.ndarray:
    """How often one symbol of the texts' tokens follows another; 0 is before the first and after the last."""
    code = CODE[np.frombuffer(("\n" + "\n".join(texts) + "\n").encode(), np.uint8)]
    return np.bincount(code[:-1] * WIDE + code[1:], minlength=WIDE * WIDE)


#: What a value begins with if it names its kind: up to the last "_" or "-" of its first eight symbols.
PREFIX = re.compile(r"[A-Za-z0-9_-]{1,7}[_-]")
#: Bounds of the credentials that the corpus teaches: length of a value, distinct values of a shape, shapes, and values of a shape.
SHORTEST, ENOUGH, SHAPES, TAUGHT = 16, 30, 16, 150


def shape_of(value: str) -> str:
    """Values of one shape are taken for one format: those of one prefix, or without one of one length."""
    found = PREFIX.match(value)
    return found[0] if found else f"#{len(value)}"


def _seen(batches):
    """Rows (pair, n, shape, value): a task's symbol pairs outside the base spans, and the distinct values that its texts assign."""
    counts, values = np.zeros(WIDE * WIDE, np.int64), set()
    names, kinds = ["pair", "n", "shape", "value"], [pa.int32(), pa.int64(), pa.string(), pa.string()]

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.nulls(len(columns[-1]), k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        texts = []
        for text in batch.column("text").to_pylist():
            if text:
                found = base_spans(text)
                texts.append(spans.redact(text, [s[1:3] for s in found], "\n") if found else text)
                values.update(v for kind, a, b in found if kind == "assign" and len(v := ASSIGN.match(text, a, b)[1].rstrip(".=-")) >= SHORTEST)
        counts += pair_counts(texts)
        if len(values) > 10_000:
            listed = sorted(values)
            values.clear()
            yield rows(None, None, [shape_of(v) for v in listed], listed)
    listed, at = sorted(values), np.flatnonzero(counts)
    yield rows(None, None, [shape_of(v) for v in listed], listed)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at]), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.string())], names=names)


def taught(values: DataFrame) -> list[tuple[str, str]]:
    """Credentials (shape, value) of the commonest shapes that enough distinct ``values`` (shape, value) have.

    A bounded sample: SHAPES shapes, and of each about TAUGHT values, drawn by hash; no shape's values are ranked or meet.
    """
    shapes = values.groupBy("shape").agg(F.count("*").alias("n")).where(F.col("n") >= ENOUGH).orderBy(F.desc("n"), "shape").limit(SHAPES)
    drawn = F.pmod(F.xxhash64("value"), F.lit(1 << 31)) < F.lit(float(TAUGHT << 31)) / F.col("n")
    return sorted((r.shape, r.value) for r in values.join(F.broadcast(shapes), "shape").where(drawn).select("shape", "value").collect())


class Rival:
    """Ordinary tokens by symbol pairs: those of the corpus outside the base spans, and a few made ones so that none is needed."""

    def __init__(self, counts: np.ndarray):
        n = (counts + pair_counts(ordinary())).reshape(WIDE, WIDE).astype(float)
        n[0, 0] = 0
        one = n.sum(axis=0) / n.sum()
        mixed = 0.8 * n / np.maximum(n.sum(axis=1, keepdims=True), 1) + 0.15 * one + 0.05 / WIDE
        self.log = np.log(mixed)

    def sums(self, run: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of beginning with each symbol, of all pairs up to each place, and of ending with each symbol."""
        code = CODE[np.frombuffer(run.encode(), np.uint8)]
        return self.log[0, code], np.concatenate(([0.0], np.cumsum(self.log[code[:-1], code[1:]]))), self.log[code, 0]


class Model:
    """An automaton for each format of the labelled credentials, and the rival."""

    def __init__(self, credentials: list[tuple[str, str]], counts: np.ndarray | None = None):
        names = sorted({k for k, _ in credentials})
        self.automata = {k: Automaton([w for x, w in credentials if x == k]) for k in names}
        self.rival = Rival(np.zeros(WIDE * WIDE, np.int64) if counts is None else counts)
        self.least = min([16, *(len(w) for _, w in credentials)])
        self.candidate = re.compile(CANDIDATE % self.least)

    def score(self, word: str) -> float:
        """Log likelihood per symbol of the likeliest format over the rival's; no format accepts most words."""
        first, pairs, last = self.rival.sums(word)
        best = max((total for a in self.automata.values() for end, total in a.ways(word, 0) if end == len(word)), default=-math.inf)
        return float(best - first[0] - pairs[-1] - last[-1]) / max(1, len(word))

    def tokens(self, run: str, threshold: float) -> list[tuple[int, int, float]]:
        """The likeliest token from each place of ``run`` that no letter or digit comes before, from the left, none within another."""
        found, free = [], 0
        first, pairs, last = self.rival.sums(run)
        for start in range(len(run)):
            if start < free or (start and run[start - 1] in KIND):
                continue
            ways = [((total - first[start] - (pairs[end - 1] - pairs[start]) - last[end - 1]) / (end - start), end) for a in self.automata.values() for end, total in a.ways(run, start)]
            score, end = max(ways, default=(-math.inf, 0))
            if score >= threshold:
                found.append((start, end, float(score)))
                free = end
        return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By start, then kind as listed."""
    found, low = [], None
    if ("=" in text or ":" in text) and any(n in (low := text.lower()) for n in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def find(text: str, model: Model, threshold: float) -> tuple[list[tuple], list[tuple]]:
    """Base spans and all spans, each (kind, start, end, score, base), by start, then kind; a base span's score is that of its likeliest token."""
    scored = lambda a, b: max((s for m in model.candidate.finditer(text, a, b) for _, _, s in model.tokens(m[0], -math.inf)), default=0.0)
    base = [(k, a, b, scored(a, b), True) for k, a, b in base_spans(text)]
    taken, more = spans.Taken(base), []
    for m in model.candidate.finditer(text):
        more += [("format", m.start() + a, m.start() + b, s, False) for a, b, s in model.tokens(m[0], threshold) if taken.free(m.start() + a, m.start() + b)]
    order = [*KINDS, "format"]
    return base, sorted(base + more, key=lambda s: (s[1], order.index(s[0])))


@tidy
def fit(docs: DataFrame, credentials: list[tuple[str, str]] | None = None) -> Model:
    """Automata from the labelled credentials, a bounded list (format, value), and the rival from all of ``docs`` (text).

    By default the credentials are 150 made ones of each public format, and those that the corpus itself labels: values that
    its texts assign to a password, secret, token or key, by shape.
    """
    rows, _ = stage(docs.select("text").mapInArrow(_seen, "pair int, n long, shape string, value string"))
    pairs = rows.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(WIDE * WIDE, np.int64)
    counts[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    if credentials is None:
        values, _ = stage(rows.where("value is not null").select("shape", "value").distinct())
        credentials = labelled() + [(f"corpus {shape}", value) for shape, value in taught(values)]
    return Model(credentials, counts)


def secrets(docs: DataFrame, credentials: list[tuple[str, str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_assign, n_access, n_hex, base_sha256, spans (line), found (structs with scores)."""
    docs = wanted(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, credentials))
    return docs.mapInArrow(spans.scan(lambda: lambda text: find(text, sent.value, threshold), KINDS), spans.schema(KINDS))


def redacted(docs: DataFrame, mark: str = "[secret]", threshold: float = 0.8) -> DataFrame:
    """All rows of ``docs`` with all their columns; every secret of a text is the mark, and n_chars, if there, follows."""
    of_text, of_chars = column_of(docs, "text"), next((c for c in docs.columns if c.lower() == "n_chars"), None)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs.select(F.col("text").cast("string").alias("text"))))

    def changed(rows: pa.RecordBatch, found: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if not f else spans.redact(t, [(s["start"], s["end"]) for s in f], mark) for t, f in zip(rows.column(of_text).cast(pa.string()).to_pylist(), found.column("found").to_pylist())]
        new = {of_text: pa.array(texts, pa.string()), of_chars: pa.array([len(t or "") for t in texts], pa.int64())}
        return pa.RecordBatch.from_arrays([new.get(c, rows.column(c)) for c in rows.schema.names], names=rows.schema.names)

    kinds = {of_text: T.StringType(), of_chars: T.LongType()}
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in docs.schema])
    return over_rows(docs, spans.scan(lambda: lambda text: find(text, sent.value, threshold), KINDS), changed, schema)
