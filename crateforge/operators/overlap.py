"""Pairs of sets that share at least so many items: bits over a small vocabulary, a prefix filter over rare items beyond it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateforge.operators.blocks import meet
from crateforge.operators.knn import sides
from crateforge.operators.ranges import numbered
from crateforge.sources.staging import stage, tidy

#: Items up to which sets are compared as bits: in so few, most sets share the rarest items of most others.
MOST_BITS = 1024


def _bits(width: int):
    """Rows (node, codes) -> (node, bits)."""

    def run(batches):
        for batch in batches:
            codes = batch.column("codes")
            held = np.zeros((batch.num_rows, width * 64), np.uint8)
            held[np.repeat(np.arange(batch.num_rows), np.diff(codes.offsets.to_numpy())), codes.flatten().to_numpy()] = 1
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in np.packbits(held, axis=1)], pa.binary())], names=["node", "bits"])

    return run


def _cross(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, most: int):
    """(pair, place of x, place of y) of every key of a row x with every key of a row y, ``most`` at a time at most."""
    ends = np.cumsum(n_x[x] * n_y[y])
    for low in range(0, int(ends[-1]) if len(ends) else 0, most):
        at = np.arange(low, min(low + most, int(ends[-1])))
        pair = np.searchsorted(ends, at, side="right")
        of = n_y[y[pair]]
        at -= ends[pair] - n_x[x[pair]] * of
        yield pair, at // of, at % of


def _pairs(least: int, width: int, tile: int = 1 << 17, most: int = 1 << 18):
    """Rows (cell, side, node, bits, keys) in order of cell and side -> (p, q, shared) of keys; a cell's rows of side 1 are held against those of side 0 as they come.

    A cell whose number is even has one block on both sides, so that a pair of rows counts once and a row's keys are pairs too.
    """

    def words(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, width)

    def met(left: pa.RecordBatch, right: pa.RecordBatch, same: bool):
        x, y, a, b = left.column("node").to_numpy(), right.column("node").to_numpy(), words(left), words(right)
        keys, starts = zip(*[(c.flatten(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (left.column("keys"), right.column("keys"))])
        n_x, n_y = (np.diff(s).astype(np.int64) for s in starts)
        step = max(1, tile // len(y))
        for k in range(0, len(x), step):
            shared = np.bitwise_count(a[k : k + step, None, 0] & b[None, :, 0]).astype(np.uint8 if width < 4 else np.uint16, copy=False)
            for w in range(1, width):
                shared += np.bitwise_count(a[k : k + step, None, w] & b[None, :, w])
            i, j = np.nonzero(shared >= least)
            if same:
                keep = (x[i + k] < y[j]) | ((x[i + k] == y[j]) & (n_y[j] > 1))
                i, j = i[keep], j[keep]
            n = shared[i, j].astype(np.int64)
            i += k
            for pair, at_x, at_y in _cross(i, j, n_x, n_y, most):
                if same:
                    keep = (x[i[pair]] != y[j[pair]]) | (at_x < at_y)
                    pair, at_x, at_y = pair[keep], at_x[keep], at_y[keep]
                p, q = (of.take(pa.array(start[row[pair]] + at)) for of, start, row, at in zip(keys, starts, (i, j), (at_x, at_y)))
                yield pa.RecordBatch.from_arrays([p, q, pa.array(n[pair])], names=["p", "q", "shared"])

    def run(batches):
        held, of = [], None
        for batch in batches:
            side = batch.column("cell").to_numpy() * 2 + batch.column("side").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(side)) + 1).tolist(), len(side)]
            for low, high in zip(ends, ends[1:]):
                if low == high:
                    continue
                cell, right = divmod(int(side[low]), 2)
                if cell != of:
                    held, of = [], cell
                piece = batch.slice(low, high - low)
                if right:
                    for left in held:
                        yield from met(left, piece, cell % 2 == 0)
                else:
                    held.append(piece)

    return run


def _by_bits(nodes: DataFrame, vocabulary: DataFrame, items: int, least: int, block: int) -> DataFrame:
    """(p, q, shared) of keys: blocks of nodes meet pairwise, each pair of blocks once."""
    width = -(-items // 64)
    codes = numbered(vocabulary, ["item"], "code")
    coded = nodes.select("node", F.explode("items").alias("item")).join(F.broadcast(codes), "item").groupBy("node").agg(F.collect_list("code").alias("codes"))
    bits = coded.mapInArrow(_bits(width), "node long, bits binary")
    held, _ = stage(bits.join(nodes.select("node", "keys").hint("merge"), "node"))
    n = sides(held.count(), block)
    own, other = F.pmod(F.xxhash64("node"), F.lit(n)), F.col("other")
    cell = lambda q, b: (q * n + b) * 2 + F.when(q == b, 0).otherwise(1)
    left = held.withColumn("other", F.explode(F.sequence(own, F.lit(n - 1).cast("long")))).select(cell(own, other).alias("cell"), F.lit(0).alias("side"), "node", "bits", "keys")
    right = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), own))).select(cell(other, own).alias("cell"), F.lit(1).alias("side"), "node", "bits", "keys")
    key = nodes.schema["keys"].dataType.elementType.simpleString()
    dealt = left.unionByName(right).repartition(max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * (n + 1) // 2), "cell")
    return dealt.sortWithinPartitions("cell", "side").mapInArrow(_pairs(least, width), f"p {key}, q {key}, shared long")


def _by_prefix(nodes: DataFrame, least: int, block: int) -> DataFrame:
    """(p, q, shared) of keys whose nodes meet in the s - least + 1 rarest items of each, s being its size."""
    each = nodes.select("node", F.explode("items").alias("item"))
    rarity = each.groupBy("item").agg(F.count("*").alias("n"))
    sets = each.hint("merge").join(rarity, "item").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("by_n")).select("node", F.col("by_n").getField("item").alias("items"))
    prefix = sets.select("node", "items", F.explode(F.slice("items", F.lit(1), F.size("items") - F.lit(least - 1))).alias("item"))
    left, right = prefix.select("item", F.col("node").alias("x"), F.col("items").alias("x_items")), prefix.select("item", F.col("node").alias("y"), F.col("items").alias("y_items"))
    shared = F.size(F.array_intersect("x_items", "y_items"))
    pairs = meet(right, left, ["item"], (F.col("x") < F.col("y")) & (shared >= least), block).select("x", "y", shared.cast("long").alias("shared")).distinct()
    of = lambda node, keys: nodes.select(F.col("node").alias(node), F.col("keys").alias(keys)).hint("merge")
    across = pairs.join(of("x", "ps"), "x").join(of("y", "qs"), "y").select(F.explode("ps").alias("p"), "qs", "shared").select("p", F.explode("qs").alias("q"), "shared")
    several = nodes.where(F.size("keys") > 1).select(F.explode("keys").alias("p"), "keys", F.size("items").cast("long").alias("shared"))
    return across.unionByName(several.select("p", F.explode("keys").alias("q"), "shared").where("p < q"))


#: Rows at most that keys with equal sets are dealt to, so that none holds all of many copies.
DEALT = 16


@tidy
def overlap_join(members: DataFrame, least: int, key: str = "key", item: str = "item", block: int = 4096, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b, shared) of all pairs a < b of keys whose sets of items share at least ``least`` (1 or more).

    ``members`` has a row (key, item) for each item of a key; repeats count once, nulls not at all. Keys with equal sets are
    one node, or DEALT of them at most, and only nodes are compared: as bits, if there are ``most_bits`` items at most, else
    by a prefix filter over rare items, whose long lists are dealt into blocks. A node carries its keys to where it is
    compared. Joins with nodes are hinted: a file of sets is a tenth of what they take in the driver, were they broadcast.
    Smaller sets than ``least`` are left out.
    """
    if least < 1:
        raise ValueError("sets that share nothing are not joined")
    rows = members.select(F.col(key).alias("key"), F.col(item).alias("item")).where("key is not null and item is not null").distinct()
    sets = rows.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items")).where(F.size("items") >= least)
    dealt = sets.groupBy("items", F.pmod(F.xxhash64("key"), F.lit(DEALT)).alias("dealt")).agg(F.collect_list("key").alias("keys"))
    nodes, _ = stage(dealt.select("items", "keys", F.monotonically_increasing_id().alias("node")))
    vocabulary, _ = stage(nodes.select(F.explode("items").alias("item")).distinct())
    items = vocabulary.count()
    pairs = _by_bits(nodes, vocabulary, items, least, block) if 0 < items <= most_bits else _by_prefix(nodes, least, block)
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared")
