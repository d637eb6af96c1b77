"""Best-fit packing with bound-certified repacking.

Documents become token ids, are cut into pieces of at most ``capacity``, and the pieces are dealt evenly into partitions,
one for each core at least. Each partition is packed by best-fit decreasing; dual-feasible functions bound its bin count
from below. Partitions above their bound give all their pieces, certified ones their least filled bin, to an exchange, which
is dealt anew, into fewer partitions, and packed again by best-fit decreasing; the new packing is taken if it has fewer bins.
The bound of all pieces together, from the counts of their lengths, certifies the whole: exchanges end when it is met; until
then each takes eight times as many of the least filled bins as the one before. The result says how many sequences there are and how many are proven necessary.

Tokens: white space separates what the tokenizer's patterns can match, so a text's ids are the ids of its
white-space-separated words in order; words are looked up in a bounded cache and only new ones are encoded.

Defined results: null and empty texts are one piece, the end id alone; very long texts are cut into as many pieces as
they need; repeated rows are packed once each; a null doc_id keeps its pieces; an empty table gives no rows; extra
columns, whatever their names, are left out.
"""

from __future__ import annotations

import os
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateforge.llm.common import discard, small_batches, stage, tidy, wanted

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


class Codes(dict):
    """Words numbered as they come; ``new`` has those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


SPACE, ALNUM, MARK = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\r\x0b\x0c", string.ascii_letters.encode() + string.digits.encode(), b".,!?|"))
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of all texts, for each word in a row which of them it is, and how many words each text has.

    A mark that closes a word of ASCII letters or digits is a token group of its own and becomes a word. The tokenizer
    folds case itself, so folding ASCII here changes nothing; only its special tokens, which have "<|", mind it. Words that
    differ in the white space behind them count as distinct here.
    """
    raw = b"\n".join(texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    if b"<|" not in raw:
        data = LOWER[data]
    marks = np.flatnonzero(MARK[data[1:-1]] & ALNUM[data[:-2]] & SPACE[data[2:]]) + 1
    data = np.insert(data, marks, 32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    starts += np.searchsorted(marks, starts)
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    at = np.flatnonzero(begins)
    offsets = np.append(at, len(data)).astype(np.int32)
    rows = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]).dictionary_encode()
    return [w.rstrip() for w in rows.dictionary.to_pylist()], rows.indices.to_numpy(), np.add.reduceat(begins, starts, dtype=np.int64)


class Encoder:
    """Ids of texts through a cache of words, of which those used once are dropped when it holds ``most``."""

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        last = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.closes = np.zeros(max(last, default=0) + 1, bool)
        self.closes[last] = True
        self._empty()

    def _empty(self) -> None:
        self.code = Codes()
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size, self.uses = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _shrink(self) -> None:
        """Keeps the words used more than once, up to half of what fits; ids move together."""
        words = np.array(list(self.code), object)
        often = np.flatnonzero(self.uses[: len(words)] > 1)
        often = np.sort(often[np.argsort(-self.uses[often], kind="stable")[: self.most // 2]])
        start, size, uses, pool = self.start[often], self.size[often], self.uses[often], self.pool
        self._empty()
        for w in words[often]:
            self.code[w]
        self.code.new.clear()
        n, ends = len(often), np.cumsum(size)
        self.start, self.size, self.uses = (self._room(x, n) for x in (self.start, self.size, self.uses))
        self.used = int(ends[-1]) if n else 0
        self.pool = self._room(self.pool, self.used)
        self.pool[: self.used] = pool[np.repeat(start - (ends - size), size) + np.arange(self.used)]
        self.start[:n], self.size[:n], self.uses[:n] = ends - size, size, uses

    def _room(self, array: np.ndarray, need: int) -> np.ndarray:
        return array if need <= len(array) else np.concatenate((array, np.zeros(max(need - len(array), len(array)), array.dtype)))

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has. Words of letters are encoded as one text and told apart by the ids that close a word."""
        if all(w.isalpha() for w in map(bytes.decode, words)):
            ids = np.array(self._ids([b" ".join(words).decode()])[0], np.uint32)
            ends = np.flatnonzero((ids < len(self.closes)) & self.closes[np.minimum(ids, len(self.closes) - 1)]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        each = self._ids([w.decode() for w in words])
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for x in each for i in x), np.uint32, int(sizes.sum())), sizes

    def _learn(self) -> None:
        letters = [w for w in self.code.new if w.decode().isalpha()]
        others = [w for w in self.code.new if not w.decode().isalpha()]
        self.start, self.size, self.uses = (self._room(x, len(self.code)) for x in (self.start, self.size, self.uses))
        for group in (letters, others):
            for k in range(0, len(group), 2000):
                part = group[k : k + 2000]
                ids, sizes = self._encoded(part)
                at = np.fromiter(map(self.code.__getitem__, part), np.int64, len(part))
                self.pool = self._room(self.pool, self.used + len(ids))
                self.pool[self.used : self.used + len(ids)] = ids
                self.start[at] = self.used + np.cumsum(sizes) - sizes
                self.size[at] = sizes
                self.used += len(ids)
        self.code.new.clear()

    def __call__(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """Ids of each text, the end id last."""
        if len(self.code) > self.most:
            self._shrink()
        words, which, counts = words_of(texts)
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        if self.code.new:
            self._learn()
        np.add.at(self.uses, codes, np.bincount(which, minlength=len(words)))
        at = codes[which]
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        flat = self.pool[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        end = np.array([end_id], np.uint32)
        return [np.concatenate((flat[a:b], end)) for a, b in zip(bounds[:-1], bounds[1:])]


#: One for each vocabulary, kept for the tasks that a Python worker runs one after the other.
ENCODERS: dict[str, Encoder] = {}


def _pieces(path: str, end_id: int, capacity: int, keep_ids: bool, chunk: int = 4 << 20):
    def run(batches):
        if path not in ENCODERS:
            ENCODERS[path] = Encoder(path)
        encode = ENCODERS[path]

        def emit(docs, texts):
            rows: list[tuple] = []
            for doc, ids in zip(docs, encode(texts, end_id)):
                ids = ids.astype("<u4")
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    raw = part.tobytes()
                    rows.append((doc, k // capacity, k, len(part), zlib.crc32(raw), raw if keep_ids else None))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

        for batch in batches:
            docs, texts, size = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                docs.append(doc)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= chunk:
                    yield emit(docs, texts)
                    docs, texts, size = [], [], 0
            if docs:
                yield emit(docs, texts)

    return run


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, ids); ids only if asked for."""
    docs = wanted(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pieces(path, end_id, capacity, keep_ids), PIECES_SQL)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the fill of each bin, by best-fit decreasing (ties in the given order)."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = room - size
        if left:
            if not open_at[left]:
                mask |= 1 << left
            open_at[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, depth: int = 24) -> int:
    """Most bins that any of two families of dual-feasible functions proves necessary.

    u_k rounds a size to multiples of 1/k unless (k+1) times it is whole; U_e drops sizes under e, rounds those over 1-e up to 1.
    """
    return bound_of(*np.unique(lengths, return_counts=True), capacity, depth)


def bound_of(sizes: np.ndarray, counts: np.ndarray, capacity: int, depth: int = 24) -> int:
    """The same for distinct sizes, ascending, and how many pieces have each."""
    if not len(sizes):
        return 0
    best = -(-int(sizes @ counts) // capacity)
    for k in range(1, depth + 1):
        whole = (k + 1) * sizes % capacity == 0
        best = max(best, -(-int(np.where(whole, k * sizes, (k + 1) * sizes // capacity * capacity) @ counts) // (k * capacity)))
    low = np.unique(sizes[2 * sizes <= capacity])
    for e in np.unique(low[np.linspace(0, len(low) - 1, min(len(low), 64)).astype(int)]) if len(low) else []:
        kept = np.where(sizes > capacity - e, capacity, np.where(sizes >= e, sizes, 0))
        best = max(best, -(-int(kept @ counts) // capacity))
    return best


PACKED_SQL = PIECES_SQL + ", sequence_id long, offset long, gap long, place int"


def _pack(capacity: int, base: int):
    """One partition: all its rows, packed; gap = bins over the proven bound; place = of the row's bin among all, the least filled first."""

    def run(batches):
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches), PIECES)
        if not table.num_rows:
            return
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        first = (base << 56) + (TaskContext.get().partitionId() << 28)
        table = table.append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))
        place = np.empty(len(fill), np.int32)
        place[np.argsort(fill, kind="stable")] = np.arange(len(fill))
        table = table.append_column("gap", pa.array(np.full(len(bins), gap))).append_column("place", pa.array(place[bins]))
        yield from table.to_batches(max_chunksize=10_000)

    return run


def _packed(rows: DataFrame, parts: int, capacity: int, base: int) -> tuple[DataFrame, str]:
    """Dealt round-robin, so that neither a document nor repeated rows make a partition large."""
    return stage(rows.repartition(max(1, parts)).mapInArrow(_pack(capacity, base), PACKED_SQL))


def _bins(df: DataFrame) -> int:
    return df.where("offset = 0").count()


@tidy
def pack(cut: DataFrame, capacity: int = 4096, part_rows: int = 200_000, rounds: int = 4, least_rows: int = 500) -> DataFrame:
    """The pieces with sequence_id and offset, and on every row n_sequences and n_bound, the sequences proven necessary.

    Every partition holds at most about ``part_rows`` pieces, however large the input, and about ``least_rows`` at least, where
    there are not enough pieces for all cores.
    """
    columns = [f.name for f in PIECES]
    with small_batches(cut.sparkSession):  # texts wait in Spark's buffers while the tokenizer works
        cut, _ = stage(cut)
    count, cores = cut.count(), cut.sparkSession.sparkContext.defaultParallelism
    lengths = sorted((r["length"], r["count"]) for r in cut.groupBy("length").count().collect())  # capacity rows at most
    bound = bound_of(np.array([n for n, _ in lengths], np.int64), np.array([k for _, k in lengths], np.int64), capacity)
    parts = max(-(-count // part_rows), min(cores, count // least_rows))
    done, _ = _packed(cut, parts, capacity, 0)
    used = _bins(done)
    for k in range(1, rounds + 1):
        if used <= bound:
            break
        given = (F.col("gap") > 0) | (F.col("place") < 8 ** (k - 1))
        pool = done.where(given)
        if pool.select(F.shiftright("sequence_id", 28).alias("part")).distinct().limit(2).count() < 2:
            break
        before = _bins(pool)
        again, path = _packed(pool.select(*columns), -(-pool.count() // part_rows), capacity, k)
        gained = before - _bins(again)
        if gained > 0:
            done, used = done.where(~given).unionByName(again), used - gained
        else:
            discard(cut.sparkSession, path)
    return done.drop("gap", "place").withColumns({"n_sequences": F.lit(used).cast("long"), "n_bound": F.lit(bound).cast("long")})
