"""LM scoring by prediction by partial matching, with a unigram base beside it.

The model is a trie of byte contexts up to ``order`` bytes, counted over all training texts. A symbol's code length comes
from the longest known context (escape method C) and, after each escape, from the next shorter one without the symbols
that the longer one has already ruled out (exclusion). A symbol seen in a context was also seen in each shorter one, so the
ruled-out set depends on the longer context alone; every context stores what remains of its suffix.

No node of the trie is ever dropped: it grows with the corpus, and it is never in one place. Documents are taken in blocks.
A block asks for the log probability of each distinct gram (context and symbol) that it holds and for the count of each
distinct word, and says how often its training texts have them. Questions are dealt into buckets, grams by the NEAR bytes
next to the symbol, words by a hash; all contexts of NEAR bytes and more of a gram, and all grams in them, meet in
one bucket, which therefore builds its part of the trie alone and answers every block. Shorter contexts, at most
256^NEAR grams whatever the corpus, are broadcast. The answers return to their block, whose texts are then scored.
A question is a compressed array of one block for one bucket, so that a very frequent gram or word is one entry of each
block and no more.

Contexts of NEAR bytes are not equally frequent, and a very frequent one would make its bucket as large as the corpus lets
it. Buckets whose questions have more entries than ``bucket_entries`` are looked at: contexts that alone have as many are
dealt by one byte more, their children likewise if need be, until whole contexts of ``order`` bytes are left. A child's
bucket is given what it cannot know, the counts of the symbols after its parents, at most 256 each.

Defined results: null and empty texts are one end token and the end symbol; very long texts are scored whole; a null doc_id
counts as training; repeated rows count and are scored each; an empty training set gives V = N = 0 and a uniform model; an
empty table gives no rows; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateforge.llm.common import discard, fold, stage, tidy, wanted

PAD, END = 0xFE, 0xFF  # bytes that UTF-8 never has
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END_WORD = b""  # every word has a byte
NEAR = 3


def _joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, each after ``order`` pads and before its end; and where the symbols of each begin."""
    pad = bytes([PAD]) * order
    raw = b"".join(x for t in texts for x in (pad, t, b"\xff")).translate(LOWER)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return np.frombuffer(raw, np.uint8), np.cumsum(sizes + order) - sizes


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """For each position from ``order`` on, its symbol in the lowest byte and the bytes before it above."""
    key = np.zeros(len(data) - order, np.uint64)
    for k in range(order + 1):
        key |= data[order - k : len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return key


def _symbols(data: np.ndarray) -> np.ndarray:
    return data != PAD


def _chunks(texts: list[bytes], limit: int = 1 << 20):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def _counted(texts: list[bytes], held: list[bool], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts and how often those that are not held out have each."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for out in (False, True):
        for part in _chunks([t for t, h in zip(texts, held) if h == out]):
            data, _ = _joined(part, order)
            k, n = np.unique(_grams(data, order)[_symbols(data)[order:]], return_counts=True)
            keys.append(k)
            counts.append(np.zeros(len(k), np.int64) if out else n)
    return _summed(np.concatenate(keys), np.concatenate(counts))


class Table:
    """Hash table of unsigned 64-bit keys, looked up in arrays."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 1.5).bit_length())
        self.keys, self.index = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):
            free = self.index[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            put = first[free[first]]
            self.index[at[put]], self.keys[at[put]] = todo[put], keys[todo[put]]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where there is none."""
        at = self._slot(keys)
        out = self.index[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.index[at]
            keep = (out[wrong] >= 0) & (self.keys[at] != keys[wrong])
            wrong, at = wrong[keep], at[keep]
        return out


def orders(grams: np.ndarray, counts: np.ndarray, wanted_orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams of each order, sorted, with their counts, from those of the highest."""
    return [_summed(grams & np.uint64((1 << (8 * (j + 1))) - 1), counts) for j in wanted_orders]


class Model:
    """A trie from the grams of each order with their counts, or the part of one whose higher orders hold whole contexts only."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        grams, counts = zip(*tables)
        self.order = len(grams) - 1
        self.grams = [Table(g) for g in grams]
        logs = lambda x: np.log10(np.maximum(x, 1e-300)).astype(np.float32)
        self.log_count = [logs(c.astype(np.float64)) for c in counts]
        self.contexts, self.own, self.down = [], [], []
        total, kinds, start = [], [], []
        for g, c in zip(grams, counts):
            ctx = g >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(g) else np.zeros(0, np.int64)
            start.append(first)
            total.append(np.add.reduceat(c, first).astype(np.float64) if len(first) else np.zeros(0))
            kinds.append(np.diff(np.concatenate((first, [len(g)]))).astype(np.float64))
            self.contexts.append(Table(ctx[first]))
        for j, g in enumerate(grams):
            # of this order's own context: denominator and escape
            whole = logs(total[j] + kinds[j])
            self.own.append((whole, logs(kinds[j]) - whole))
            if not j:
                self.down.append(None)
                continue
            # of the next shorter context, without the symbols of this one
            at = self.grams[j - 1].find(g & np.uint64((1 << (8 * j)) - 1))
            gone = np.add.reduceat(counts[j - 1][at], start[j]).astype(np.float64) if len(start[j]) else np.zeros(0)
            ctx = self.contexts[j - 1].find((g[start[j]] >> np.uint64(8)) & np.uint64((1 << (8 * (j - 1))) - 1))
            rest, some = np.maximum(total[j - 1][ctx] - gone, 0), kinds[j - 1][ctx] - kinds[j]
            empty = some <= 0  # nothing is left there: the escape is certain
            self.down.append((np.where(empty, 0, logs(rest + some)), np.where(empty, 0, logs(some) - logs(rest + some))))
        top = self.order
        owner = self.contexts[top].find(grams[top] >> np.uint64(8))
        self.direct = self.log_count[top] - self.own[top][0][owner] if len(grams[top]) else np.zeros(0, np.float32)
        self.last = -math.log10(max(1, 256 - len(grams[0])))

    def logs(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each position's symbol after its context."""
        out = np.zeros(len(key), np.float32)
        at = self.grams[self.order].find(key)
        hit = at >= 0
        out[hit] = self.direct[at[hit]]
        todo = np.flatnonzero(~hit)
        key = key[todo]
        above = np.full(len(todo), -1, np.int32)  # the context one longer, if the trie has it
        for j in range(self.order, -1, -1):
            if not len(todo):
                return out
            cut = key & np.uint64((1 << (8 * (j + 1))) - 1)
            at = self.grams[j].find(cut)
            own = self.contexts[j].find(cut >> np.uint64(8))
            has = above >= 0
            if j < self.order and len(self.down[j + 1][0]):
                den, esc = (np.where(has, t[above], 0) for t in self.down[j + 1])
            else:
                den = esc = np.zeros(len(todo), np.float32)
            if len(self.own[j][0]):
                den, esc = (np.where(has, x, np.where(own >= 0, t[own], 0)) for x, t in zip((den, esc), self.own[j]))
            hit = at >= 0
            out[todo] += np.where(hit, self.log_count[j][at] - den if len(self.log_count[j]) else 0, esc)
            todo, key, above = todo[~hit], key[~hit], own[~hit]
        out[todo] += self.last
        return out


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of 8, 4 or 1 bytes an entry, as compressed byte planes, of which most are zero."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], "<i8").tobytes()
    return head + pa.compress(b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays), codec="zstd", asbytes=True)


def _arrays(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    shape = np.frombuffer(blob, "<i8", 2 * n, 8).reshape(n, 2).tolist()
    raw, at, out = pa.decompress(blob[8 * (2 * n + 1) :], decompressed_size=sum(a * b for a, b in shape), codec="zstd", asbytes=True), 0, []
    for width, size in shape:
        out.append(np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size).T.copy().view(f"<u{width}").ravel())
        at += width * size
    return out


def _near(keys: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` bytes next to the symbol."""
    return (keys >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)


class Routes:
    """To which bucket the question about a gram goes; ``hot`` has, by depth, the contexts that are dealt by one byte more."""

    def __init__(self, order: int, buckets: int, hot: dict[int, np.ndarray] | None = None):
        self.order, self.least, self.buckets, self.hot = order, min(NEAR, order), buckets, hot or {}

    def depth(self, keys: np.ndarray) -> np.ndarray:
        """How many bytes next to the symbol decide."""
        depth, at = np.full(len(keys), self.least), np.arange(len(keys))
        for d in range(self.least, self.order):
            at = at[np.isin(_near(keys[at], d), self.hot.get(d, np.zeros(0, np.uint64)))]
            depth[at] = d + 1
        return depth

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Buckets from 0 on, and beyond 2^61 the parts of hot contexts."""
        mixed = lambda near, d: (near + np.uint64(d)) * Table.MULTIPLIER
        bucket = (mixed(_near(keys, self.least), 1) >> np.uint64(33)).astype(np.int64) % self.buckets
        if self.hot:
            depth = self.depth(keys)
            for d in range(self.least + 1, self.order + 1):
                at = np.flatnonzero(depth == d)
                bucket[at] = (mixed(_near(keys[at], d), d) >> np.uint64(3)).astype(np.int64) | (1 << 61)
        return bucket


def _word_bucket(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def _dealt(bucket: np.ndarray):
    """The places of each bucket that has any, in their order."""
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[by[a]]), by[a:b]


def _words(texts: list[bytes], held: list[bool]) -> Counter:
    """How often the texts that are not held out have each word of any; the end is a word."""
    found: Counter = Counter()
    for text, out in zip(texts, held):
        words = text.translate(LOWER).split()
        words.append(END_WORD)
        if out:
            found.update(dict.fromkeys(words, 0))
        else:
            found.update(words)
    return found


BLOCKS = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("bucket", pa.int64()), ("blob", pa.binary()), ("entries", pa.int64())])
BLOCKS_SQL = "block long, kind string, bucket long, blob binary, entries long"


def _gram_question(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return _blob(np.diff(keys, prepend=np.uint64(0)), counts.astype("<u4"))


def _ask(order: int, buckets: int, block_bytes: int):
    """Rows of each block: its texts, and its questions about grams and words to each bucket."""

    def block(number, docs, held, texts):
        ids = np.array([d or 0 for d in docs], "<i8")
        flags = [np.array(x, np.uint8) for x in ([d is None for d in docs], held)]
        rows = [("text", -1, _blob(ids, *flags, np.array([len(t) for t in texts], "<u8"), np.frombuffer(b"".join(texts), np.uint8)), 0)]
        keys, n = _counted(texts, held, order)
        for k, at in _dealt(Routes(order, buckets)(keys)):
            rows.append(("gram", k, _gram_question(keys[at], n[at]), len(at)))
        found = _words(texts, held)
        words, n = list(found), np.fromiter(found.values(), np.int64, len(found))
        for k, at in _dealt(_word_bucket(words, buckets)):
            rows.append(("word", k, _blob(np.frombuffer(b"\n".join([words[i] for i in at.tolist()]), np.uint8), n[at].astype("<u4")), len(at)))
        kinds, at, blobs, entries = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number)), pa.array(kinds), pa.array(at, pa.int64()), pa.array(blobs, pa.binary()), pa.array(entries, pa.int64())], schema=BLOCKS)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 28
        docs, held, texts, size = [], [], [], 0
        for batch in batches:
            for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").cast(pa.binary())):
                docs.append(doc)
                held.append(out)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield block(number, docs, held, texts)
                    number += 1
                    docs, held, texts, size = [], [], [], 0
        if docs:
            yield block(number, docs, held, texts)

    return run


def _question(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = _arrays(blob)
    return np.cumsum(steps, dtype=np.uint64), n


def _short(order: int):
    """Rows (gram, n) of the longest contexts that every bucket is given."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                keys, n = _question(blob.as_py())
                ((k, c),) = orders(keys[n > 0], n[n > 0], range(min(NEAR, order) - 1, min(NEAR, order)))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["gram", "n"])

    return run


def _sizes(routes: Routes, depth: int):
    """Questions -> rows (near, n): how many entries each context of ``depth`` bytes has, of those that are dealt by as many."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                keys, _ = _question(blob.as_py())
                near, n = np.unique(_near(keys[routes.depth(keys) == depth], depth), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int64)), pa.array(n)], names=["near", "n"])

    return run


def _parent(near: np.ndarray, depth: int) -> np.ndarray:
    """A number for each context of each depth."""
    return near.astype(np.int64) | (depth << 56)


def _split(routes: Routes):
    """Questions to large buckets -> the same by the buckets of ``routes``, each with the numbers of its contexts' parents."""

    def run(batches):
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                keys, n = _question(blob.as_py())
                depth, rows = routes.depth(keys), []
                for k, at in _dealt(routes(keys)):
                    parents = {int(p) for d in range(routes.least, int(depth[at].max())) for p in _parent(np.unique(_near(keys[at][depth[at] > d], d)), d)}
                    rows.append((k, _gram_question(keys[at], n[at]), len(at), sorted(parents)))
                if rows:
                    k, blobs, entries, parents = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * len(rows), pa.int64()), pa.array(["gram"] * len(rows)), pa.array(k, pa.int64()), pa.array(blobs, pa.binary()), pa.array(entries, pa.int64()), pa.array(parents, pa.list_(pa.int64()))],
                        names=[*BLOCKS.names, "parents"],
                    )

    return run


def _after_parents(routes: Routes):
    """Questions to large buckets -> rows (parent, gram, n): the counts of the symbols after each hot context."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                keys, n = _question(blob.as_py())
                depth = routes.depth(keys)
                for d in range(routes.least, routes.order):
                    at = (depth > d) & (n > 0)
                    ((grams, c),) = orders(keys[at], n[at], range(d, d + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(_parent(_near(grams, d), d)), pa.array(grams.astype(np.int64)), pa.array(c)], names=["parent", "gram", "n"])

    return run


def _listed(table: pa.Table) -> pa.Table:
    """A parent's symbols, at most 256, as one blob."""
    table = table.sort_by("gram")
    depth = np.array([table.column("parent")[0].as_py() >> 56], np.uint8)
    blob = _blob(table.column("gram").to_numpy().astype("<u8"), table.column("n").to_numpy().astype("<u8"), depth)
    return pa.table([table.column("parent")[:1], pa.array([blob], pa.binary())], names=["parent", "blob"])


def dealt_anew(asked: DataFrame, order: int, buckets: int, bucket_entries: int) -> tuple[DataFrame, Routes]:
    """The questions of ``asked``, those of hot contexts in buckets of their own; and their routes.

    Hot contexts are few: each has more than ``bucket_entries`` of all entries.
    """
    spark, routes = asked.sparkSession, Routes(order, buckets)
    questions = asked.where("kind <> 'text'")
    full = questions.where("kind = 'gram'").groupBy("bucket").agg(F.sum("entries").alias("n")).where(F.col("n") > bucket_entries).select("bucket")
    full, _ = stage(full)
    if full.isEmpty():
        return questions, routes
    large, _ = stage(questions.where("kind = 'gram'").join(full, "bucket", "left_semi").select(*BLOCKS.names))
    for depth in range(routes.least, order):
        sizes = large.select("blob").mapInArrow(_sizes(routes, depth), "near long, n long").groupBy("near").agg(F.sum("n").alias("n"))
        found = sizes.where(F.col("n") > bucket_entries).select("near").toArrow().column("near").to_numpy()
        if not len(found):
            break
        routes = Routes(order, buckets, routes.hot | {depth: np.sort(found.astype(np.uint64))})
    if not routes.hot:
        return questions, routes
    split, _ = stage(large.mapInArrow(_split(routes), BLOCKS_SQL + ", parents array<long>"))
    after = large.select("blob").mapInArrow(_after_parents(routes), "parent long, gram long, n long").groupBy("parent", "gram").agg(F.sum("n").alias("n")).groupBy("parent").applyInArrow(_listed, "parent long, blob binary")
    above = split.select("bucket", F.explode("parents").alias("parent")).distinct().join(after, "parent")
    above = above.select(F.lit(-1).cast("long").alias("block"), F.lit("above").alias("kind"), "bucket", "blob", F.lit(256).cast("long").alias("entries"))
    rest = questions.where("kind = 'word'").unionByName(questions.where("kind = 'gram'").join(full, "bucket", "left_anti").select(*BLOCKS.names))
    return rest.unionByName(split.drop("parents")).unionByName(above), routes


ANSWERS_SQL = BLOCKS_SQL + ", n long, v long"


def _answer(sent, order: int):
    """One bucket: every block's questions -> the answers, in each question's order. A bucket of words adds its N and V."""

    def tables(keys: np.ndarray, c: np.ndarray, above: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Grams of the orders that are not short: a context is whole here if it has as many bytes as decide, else it comes from above."""
        depth, given = sent.value[1].depth(keys), [_arrays(b) for b in above]
        found = []
        for j in range(min(NEAR, order), order + 1):
            here = depth <= j
            of = [(g, n.astype(np.int64)) for g, n, d in given if d[0] == j]
            found.append(_summed(np.concatenate((keys[here] & np.uint64((1 << (8 * (j + 1))) - 1), *(g for g, _ in of))), np.concatenate((c[here], *(n for _, n in of)))))
        return found

    def grams(blobs: list[bytes], above: list[bytes]) -> tuple[list[bytes], int, int]:
        asked = [_question(b) for b in blobs]
        keys, at = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
        c = np.bincount(at, np.concatenate([n for _, n in asked]), len(keys)).astype(np.int64)
        known = c > 0
        value = Model([*sent.value[0], *tables(keys[known], c[known], above)]).logs(keys)
        cuts = np.cumsum([len(k) for k, _ in asked])[:-1]
        return [_blob(value[x].astype("<f4").view("<u4")) for x in np.split(at, cuts)], 0, 0

    def words(blobs: list[bytes]) -> tuple[list[bytes], int, int]:
        asked = [_arrays(b) for b in blobs]
        every = [a.tobytes().split(b"\n") for a, _ in asked]
        code = pa.array([w for part in every for w in part], pa.binary()).dictionary_encode()
        at = code.indices.to_numpy()
        c = np.bincount(at, np.concatenate([n for _, n in asked]), len(code.dictionary)).astype(np.int64)
        return [_blob(c[x].astype("<u8")) for x in np.split(at, np.cumsum([len(p) for p in every])[:-1])], int(c.sum()), int((c > 0).sum())

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        above = [b for b, k in zip(blobs, kinds) if k == "above"]
        table = table.filter(pc.not_equal(table.column("kind"), "above"))
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())], names=[*BLOCKS.names, "n", "v"])
        blobs = table.column("blob").to_pylist()
        blobs, n, v = words(blobs) if kinds[0] == "word" else grams(blobs, above)
        first = lambda x: pa.array([x] + [0] * (len(blobs) - 1), pa.int64())
        return pa.table([table.column("block"), table.column("kind"), table.column("bucket"), pa.array(blobs, pa.binary()), table.column("entries"), first(n), first(v)], names=[*BLOCKS.names, "n", "v"])

    return run


SUMS_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double"


def _sums(order: int, buckets: int, routes):
    """One block: its texts and the answers to its questions -> sums per document."""

    def values(keys: np.ndarray, bucket: np.ndarray, answers: dict[int, np.ndarray], kind) -> np.ndarray:
        out = np.zeros(len(keys), kind)
        for k, at in _dealt(bucket):
            out[at] = answers[k].view(kind)
        return out

    def run(table: pa.Table) -> pa.Table:
        answers: dict[str, dict] = {"gram": {}, "word": {}}
        for kind, bucket, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "blob"))):
            if kind == "text":
                ids, missing, held, sizes, raw = _arrays(blob)
            else:
                answers[kind][bucket] = _arrays(blob)[0]
        ends, raw = np.cumsum(sizes).astype(np.int64), raw.tobytes()
        texts = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        keys, _ = _counted(texts, held.tolist(), order)
        value, of, score = values(keys, routes.value[1](keys), answers["gram"], np.float32), Table(keys), []
        for part in _chunks(texts):
            data, starts = _joined(part, order)
            real = _symbols(data)[order:]
            logs = np.zeros(len(real))
            logs[real] = value[of.find(_grams(data, order)[real])]
            score.append(np.add.reduceat(logs, starts - order))
        words = list(_words(texts, held.tolist()))
        c = values(words, _word_bucket(words, buckets), answers["word"], np.int64)
        log_of, known_of = dict(zip(words, np.log10(c + 1.0).tolist())), frozenset(w for w, k in zip(words, c.tolist()) if k)
        n_tokens, n_known, log_sum = [], [], []
        for t in texts:
            own = t.translate(LOWER).split()
            own.append(END_WORD)
            n_tokens.append(len(own))
            n_known.append(sum(map(known_of.__contains__, own)))
            log_sum.append(math.fsum(map(log_of.__getitem__, own)))
        doc = pa.array(ids.view(np.int64), mask=missing.astype(bool))
        return pa.table([doc, pa.array(held.astype(bool)), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(log_sum, pa.float64()), pa.array(np.concatenate(score))], names=["doc_id", "held_out", "n_tokens", "n_known", "log_sum", "score"])

    return run


@tidy
def score(docs: DataFrame, order: int = 5, modulus: int = 7, out: int = 2, block_bytes: int = 12 << 20, bucket_bytes: int = 32 << 20, bucket_entries: int = 8_000_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``block_bytes`` of text make a block, there is a bucket for every ``bucket_bytes``, and a context of more entries than
    ``bucket_entries`` has buckets of its own: none of them changes a result.
    """
    spark = docs.sparkSession
    docs = wanted(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold("doc_id", modulus) == out).alias("held_out"))
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    cores = spark.sparkContext.defaultParallelism
    buckets = max(cores, -(-size // bucket_bytes))
    asked, asked_path = stage(docs.mapInArrow(_ask(order, buckets, block_bytes), BLOCKS_SQL))
    short = asked.where("kind = 'gram'").select("blob").mapInArrow(_short(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    low = orders(short.column("gram").to_numpy().view(np.uint64), short.column("n").to_numpy(), range(min(NEAR, order)))
    questions, routes = dealt_anew(asked, order, buckets, bucket_entries)
    questions = questions.withColumn("about", F.col("kind") == "word").repartition(2 * buckets, "about", "bucket")
    sent = spark.sparkContext.broadcast((low, routes))
    answers, answers_path = stage(questions.groupBy("about", "bucket").applyInArrow(_answer(sent, order), ANSWERS_SQL))
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    both = asked.where("kind = 'text'").unionByName(answers.drop("n", "v"))
    sums, _ = stage(both.repartition(max(cores, -(-size // block_bytes)), "block").groupBy("block").applyInArrow(_sums(order, buckets, sent), SUMS_SQL))
    discard(spark, asked_path)
    discard(spark, answers_path)
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score",
    )
