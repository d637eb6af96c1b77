"""SimHash near-duplicates with an inverted index on byte positions and count filtering.

A fingerprint of 64 bits has 8 positional bytes. Two that differ in at most 3 bits share at least 5 of them, so they
share one of the four-byte blocks in BLOCKS, a family of which every 5 positions contain one. The index lists each
distinct fingerprint under its blocks; within a list the shared positional bytes of a pair are tallied, pairs that
reach the guaranteed 5 are kept, and the bits of those are counted. Lists are read as sorted streams; what leaves a list
is a star per group of linked fingerprints, never its pairs. Lists of more than ``list_limit`` fingerprints are not
compared pair by pair but met at all fingerprints one bit away (exact, see ``_balls``).

Defined results: a text without words (null, empty) has fingerprint zero and links like any other; very long texts are
read whole; repeated rows link with each other; a null doc_id keeps its row, with the component of its fingerprint; an
empty table gives no rows; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateforge.llm.common import stage, tidy, wanted
from crateforge.operators.components import components

MAX_BITS, LEAST_BYTES = 3, 5


def _blocks() -> list[tuple[int, ...]]:
    """Sets of 4 of the 8 positions, chosen greedily, such that every 5 positions contain one."""
    chosen: list[tuple[int, ...]] = []
    left = {frozenset(c) for c in combinations(range(8), LEAST_BYTES)}
    while left:
        best = max(combinations(range(8), 4), key=lambda b: sum(left_c.issuperset(b) for left_c in left))
        chosen.append(best)
        left = {c for c in left if not c.issuperset(best)}
    return chosen


BLOCKS = _blocks()
MASKS = np.array([sum(0xFF << (8 * p) for p in block) for block in BLOCKS], np.uint64)


def fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of the lower-cased words' shingles by their XXH64 (seed 42), repeats counted."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[:-1].tolist())]
    stops = (ends - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    values = [hashed(line[a:b], 42) for a, b in zip(starts, stops[size - 1 :])] if len(words) >= size else [hashed(line, 42)]
    sums = np.zeros(64, np.int64)
    for k in range(0, len(values), 65536):
        part = np.array(values[k : k + 65536], ">u8").view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(values)).view(">u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            values = [fingerprint(t.as_py() or b"", size) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return wanted(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _keys(batches):
    """Rows (block, key, fp): the fingerprint under each of its blocks."""
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        key = (fp[:, None] & MASKS[None, :]).view(np.int64).ravel()
        block = np.tile(np.arange(len(BLOCKS), dtype=np.int32), len(fp))
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(key), pa.array(np.repeat(fp.view(np.int64), len(BLOCKS)))], names=["block", "key", "fp"])


def _same_bytes(x: np.ndarray) -> np.ndarray:
    """Positions at which the bytes of a XOR are zero."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _stars(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs -> (member, least member of its group) by repeated minima; only members that are not their own least."""
    root = np.arange(len(fp))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return moved, root[moved]


def _within(list_limit: int, pending: int = 1 << 20):
    """Sorted rows (block, key, fp) -> edges (u, v); rows of longer lists come out with v null, for the exact other way."""

    def run(batches):
        rest: tuple[np.ndarray, ...] | None = None

        def emit(block, key, fp):
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(key) != 0)) + 1
            starts = np.concatenate(([0], change))
            sizes = np.diff(np.concatenate((starts, [len(fp)])))
            of = np.repeat(np.arange(len(starts)), sizes)
            long = sizes > list_limit
            left, right = [], []
            u = fp.view(np.uint64)
            here = np.flatnonzero(~long[of] & (sizes[of] > 1))
            step = 1
            while len(here):
                here = here[here + step < len(fp)]
                here = here[of[here] == of[here + step]]
                x = u[here] ^ u[here + step]
                ok = _same_bytes(x) >= LEAST_BYTES
                ok[ok] = np.bitwise_count(x[ok]) <= MAX_BITS
                left.append(here[ok])
                right.append(here[ok] + step)
                step += 1
                if sum(map(len, left)) > pending:  # linked pairs become stars before they are many
                    member, root = _stars(fp, np.concatenate(left), np.concatenate(right))
                    left, right = [member], [root]
            a, b = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
            member, root = _stars(fp, a, b) if len(a) else (a, b)
            hot = np.flatnonzero(long[of])
            u_out = np.concatenate((fp[member], fp[hot]))
            v_out = pa.array(np.concatenate((fp[root], fp[hot])), mask=np.concatenate((np.zeros(len(member), bool), np.ones(len(hot), bool))))
            blocks = np.concatenate((block[member], block[hot])).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(u_out), v_out, pa.array(blocks)], names=["u", "v", "block"])

        for batch in batches:
            block, key, fp = (batch.column(n).to_numpy() for n in ("block", "key", "fp"))
            if rest is not None:
                block, key, fp = (np.concatenate(p) for p in zip(rest, (block, key, fp)))
            if not len(fp):
                continue
            last = np.flatnonzero((block != block[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if not cut and len(fp) > 4 * list_limit:  # one endless list: hand its rows on, keep enough to know that it is long
                keep = list_limit + 1
                yield emit(block[:-keep], key[:-keep], fp[:-keep])
                cut = len(fp) - keep
            elif cut:
                yield emit(block[:cut], key[:cut], fp[:cut])
            rest = block[cut:], key[cut:], fp[cut:]
        if rest is not None and len(rest[0]):
            yield emit(*rest)

    return run


def _balls(hot: DataFrame) -> DataFrame:
    """Edges among fingerprints of long lists, exact without comparing pairs.

    Two fingerprints at most 3 bits apart have a midpoint at most 1 bit from one and at most 2 from the other. Each is
    listed at the midpoints within 2 bits; all within 1 bit of a midpoint are within 2 of each other and link to the least
    of them, and all within 2 bits of it are within 3 of that least one and link to it too.
    """

    def run(batches):
        one = np.concatenate(([0], 1 << np.arange(64, dtype=np.uint64))).astype(np.uint64)
        pairs = np.array([(1 << a) | (1 << b) for a, b in combinations(range(64), 2)], np.uint64)
        flips, near = np.concatenate((one, pairs)), np.concatenate((np.ones(len(one), bool), np.zeros(len(pairs), bool)))
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(fp), 256):
                part = fp[k : k + 256]
                mid = (part[:, None] ^ flips[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(part.view(np.int64), len(flips))), pa.array(np.tile(near, len(part)))], names=["mid", "fp", "near"])

    rows = hot.mapInArrow(run, "mid long, fp long, near boolean")
    least = rows.where("near").groupBy("mid").agg(F.min("fp").alias("v"))
    return rows.join(least, "mid").select(F.col("fp").alias("u"), "v").where("u <> v").distinct()


def links(distinct: DataFrame, list_limit: int = 8192) -> DataFrame:
    """Edges (u, v) whose components are those of all links among the distinct fingerprints (fp)."""
    rows = distinct.mapInArrow(_keys, "block int, key long, fp long")
    found, _ = stage(rows.repartition("block", "key").sortWithinPartitions("block", "key", "fp").mapInArrow(_within(list_limit), "u long, v long, block int"))
    edges = found.where("v is not null").select("u", "v")
    hot = found.where("v is null").select(F.col("u").alias("fp")).distinct()
    if not hot.isEmpty():
        edges = edges.unionByName(_balls(hot))
    return edges.distinct()


@tidy
def simhash(docs: DataFrame, size: int = 3, list_limit: int = 8192) -> DataFrame:
    """Per row: doc_id, fp (long), fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    each, _ = stage(fingerprints(docs, size))
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), list_limit))
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    fps = of.join(ids, "root").select("fp", "component_id")
    return each.join(fps, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
