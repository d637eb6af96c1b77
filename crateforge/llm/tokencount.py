"""Token counts by rank-synchronous array merging, for byte-pair vocabularies of the sentencepiece kind.

A batch of texts becomes one byte buffer in which every text begins with the space that the vocabulary puts before it.
Stretches of spaces with what follows them are pre-tokens: no piece goes on from another character to a space, which is
checked when the vocabulary is read. Distinct pre-tokens are cut once more between any two characters that stand beside
each other in no piece, as no merge can join those. What is left is held as ragged arrays: one flat array of symbols and
the start of each sequence. A round finds each sequence's pair of best rank, the leftmost of equals, and merges it in all
sequences at once; sequences without a pair leave. The symbols that survive are counted, a character that is no piece as
its UTF-8 bytes. Sequences of more than LONG symbols, rare, take the same merges from a queue instead of rounds.

Defined results: null and empty texts have no bytes and no tokens; texts of white space alone, of any length and of any
characters are counted whole; rows that repeat and null doc_ids are answered row by row; an empty table gives no rows;
extra columns, whatever their names, are left out. A vocabulary of another kind (another normalisation, unused or
user-defined pieces, no byte fallback) is refused with ValueError.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 256
#: Bytes of text whose pre-tokens are held at once (one text may be longer).
SLICE = 2 << 20
SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Symbols are numbered: characters of pieces from 1 (0: any other character), then the longer pieces."""

    symbol_of: np.ndarray  # by code point, 0 where unknown
    known: np.ndarray  # by symbol: it is a piece
    joins: np.ndarray  # by two characters: they stand beside each other in a piece
    keys: np.ndarray  # left * size + right of every pair that makes a piece, ascending
    made: np.ndarray  # the symbol it makes
    rank: np.ndarray  # and its rank, the best 0
    size: int


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Reads a model file; once in each Python worker."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec, trained, kinds = model.normalizer_spec, model.trainer_spec, model.SentencePiece.Type
    plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
    if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or not plain or any(p.type in (kinds.UNUSED, kinds.USER_DEFINED) for p in model.pieces):
        raise ValueError(f"{path} is not a byte-pair vocabulary with byte fallback and plain spaces")
    pieces = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
    chars = sorted({c for p in pieces for c in p} | {SPACE})
    symbol = {c: i for i, c in enumerate(chars, 1)}
    joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    for p in pieces:
        if any(a != SPACE and b == SPACE for a, b in zip(p, p[1:])):
            raise ValueError(f"{path}: a piece goes on from a character to a space")
        for a, b in zip(p, p[1:]):
            joins[symbol[a], symbol[b]] = True
    symbol |= {p: i for i, p in enumerate((p for p in pieces if len(p) > 1), len(chars) + 1)}
    size = len(symbol) + 1
    known = np.zeros(size, bool)
    known[[symbol[p] for p in pieces]] = True
    order = {score: i for i, score in enumerate(sorted(set(pieces.values()), reverse=True))}
    pairs = sorted((symbol[p[:k]] * size + symbol[p[k:]], symbol[p], order[score]) for p, score in pieces.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
    symbol_of = np.zeros(0x110000, np.int32)
    symbol_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    symbol_of[ord(" ")] = symbol[SPACE]
    keys, made, rank = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
    return Vocabulary(symbol_of, known, joins, keys, made, rank, size)


def _looked_up(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair (len(v.keys) if it makes no piece) and the symbol it makes."""
    if not len(v.keys):
        return np.full(len(left), 0), np.zeros(len(left), np.int64)
    key = left.astype(np.int64) * v.size + right
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    hit = v.keys[at] == key
    return np.where(hit, v.rank[at], len(v.keys)), v.made[at]


def _queued(v: Vocabulary, symbols: list[int]) -> list[int]:
    """The same merges for one long sequence: best rank first, leftmost of equals."""
    none, after, before = len(v.keys), [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]
    ranks, made = _looked_up(v, np.array(symbols[:-1]), np.array(symbols[1:]))
    queue = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(ranks.tolist(), made.tolist())) if r < none]
    heapq.heapify(queue)
    pairs: dict[tuple[int, int], tuple[int, int]] = {}

    def push(i: int, j: int) -> None:
        pair = symbols[i], symbols[j]
        if pair not in pairs:
            r, m = _looked_up(v, np.array([pair[0]]), np.array([pair[1]]))
            pairs[pair] = int(r[0]), int(m[0])
        if pairs[pair][0] < none:
            heapq.heappush(queue, (pairs[pair][0], i, *pair, pairs[pair][1]))

    while queue:
        _, i, a, b, m = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue
        symbols[i], symbols[j], after[i] = m, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
            push(i, after[i])
        if before[i] >= 0:
            push(before[i], i)
    return [s for s in symbols if s >= 0]


def _merged(v: Vocabulary, symbols: np.ndarray, starts: np.ndarray, most: int = LONG) -> np.ndarray:
    """How many symbols survive in each sequence; all of them stand for known or mergeable characters."""
    left, lengths = np.zeros(len(starts), np.int64), np.diff(np.append(starts, len(symbols)))
    for i in np.flatnonzero(lengths > most).tolist():
        left[i] = len(_queued(v, symbols[starts[i] : starts[i] + lengths[i]].tolist()))
    own = np.repeat(np.arange(len(starts)), lengths)
    keep = (lengths <= most)[own]
    symbols, own, none = symbols[keep], own[keep], len(v.keys)
    if not len(symbols):
        return left
    rank, made = np.full(len(symbols), none), np.zeros(len(symbols), np.int64)

    def look(at: np.ndarray) -> None:
        """Sets the rank of the pair that begins at each of ``at``."""
        rank[at] = none
        at = at[(at + 1 < len(own))]
        at = at[own[at] == own[at + 1]]
        rank[at], made[at] = _looked_up(v, symbols[at], symbols[at + 1])

    look(np.arange(len(symbols)))
    while len(symbols):
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        best, size = np.minimum.reduceat(rank, first), np.diff(np.append(first, len(own)))
        over = best == none
        left[own[first[over]]] = size[over]
        if over.any():
            stay = np.repeat(~over, size)
            symbols, own, rank, made = symbols[stay], own[stay], rank[stay], made[stay]
            if not len(symbols):
                break
            size, best = size[~over], best[~over]
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
        hit = np.flatnonzero(rank == np.repeat(best, size))
        hit = hit[np.concatenate(([True], own[hit[1:]] != own[hit[:-1]]))]  # the leftmost of each sequence
        symbols[hit] = made[hit]
        stay = np.ones(len(symbols), bool)
        stay[hit + 1] = False
        hit = np.cumsum(stay)[hit] - 1
        symbols, own, rank, made = symbols[stay], own[stay], rank[stay], made[stay]
        before = hit[hit > 0] - 1
        look(np.concatenate((before[own[before] == own[before + 1]], hit)))
    return left


def count_pieces(v: Vocabulary, words: list[str], most: int = LONG) -> np.ndarray:
    """Tokens of each pre-token (spaces stand as they are)."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    total = np.zeros(len(words), np.int64)
    if not len(code):
        return total
    symbols, word = v.symbol_of[code], np.repeat(np.arange(len(words)), lengths)
    joined = np.concatenate(([False], v.joins[symbols[:-1], symbols[1:]]))
    joined[starts[lengths > 0]] = False
    alone = ~joined & ~np.append(joined[1:], False)
    bytes_of = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    np.add.at(total, word[alone], np.where(v.known[symbols[alone]], 1, bytes_of[alone]))
    rest = ~alone
    if rest.any():
        # a character that merges with nothing beside it but is no piece survives as its bytes; no vocabulary at hand has one within a joined stretch
        own, first = word[rest], np.flatnonzero(~joined[rest])
        loose = rest & ~v.known[symbols]
        if loose.any():
            return np.array([_plain(v, w) for w in words], np.int64)
        np.add.at(total, own[first], _merged(v, symbols[rest].astype(np.int64), first, most))
    return total


def _plain(v: Vocabulary, word: str) -> int:
    """One pre-token whose characters are not all pieces."""
    symbols = v.symbol_of[[ord(c) for c in word]].tolist()
    named = {s: c for s, c in zip(symbols, word)}
    out, at = 0, 0
    while at < len(symbols):
        if not symbols[at]:
            out, at = out + len(word[at].encode()), at + 1
            continue
        end = at
        while end < len(symbols) and symbols[end]:
            end += 1
        for s in _queued(v, symbols[at:end]):
            out += 1 if v.known[s] else len(named[s].encode())
        at = end
    return out


def _counts(v: Vocabulary, texts: list[bytes]) -> np.ndarray:
    """Tokens of each text, all pre-tokens of all texts at once. The sign that stands for a space in pieces is a space."""
    texts = [t.replace(SPACE.encode(), b" ") for t in texts]
    filled = [i for i, t in enumerate(texts) if t]
    out = np.zeros(len(texts), np.int64)
    if not filled:
        return out
    raw = b"".join([part for i in filled for part in (b" ", texts[i])])
    data = np.frombuffer(raw, np.uint8)
    lengths = np.array([len(texts[i]) + 1 for i in filled])
    row = np.cumsum(lengths) - lengths
    space = data == 0x20
    cut = space & ~np.concatenate(([False], space[:-1]))
    cut[row] = True
    starts = np.flatnonzero(cut)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
    tokens = count_pieces(v, [w.decode() for w in words.dictionary.to_pylist()])
    out[filled] = np.add.reduceat(tokens[words.indices.to_numpy()], np.searchsorted(starts, row))
    return out


def _slices(sizes: list[int], most: int = SLICE):
    """(from, to) of consecutive rows that hold at most ``most`` bytes together, one row at least."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if sizes:
        yield start, len(sizes)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            sizes = [x or 0 for x in pc.binary_length(column).to_pylist()]
            n = [_counts(v, [t or b"" for t in column.slice(a, b - a).to_pylist()]) for a, b in _slices(sizes)]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
