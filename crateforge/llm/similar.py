"""Near-duplicates: SimHash links and texts that share positional bytes are candidates, verified by their word shingles.

Texts are fingerprinted and linked by the SimHash operator (64 bits, 3 bits' distance, ``simhash.links``). That finds few of
the pairs whose five-word shingles have a Jaccard similarity of 0.8 (figures in the README), so that the same index on byte
positions with count filtering is asked once more, over 60 positional bytes, each the hash of the
shingle that is least under one of 60 permutations: two texts share a positional byte with the probability of their
similarity. The index lists each distinct text under 15 keys of 4 positions; within a list shared positional bytes are
tallied, pairs that reach the minimum go on, and the shingle sets of those are compared exactly.

Every list is compared whole: one of more than ``list_block`` texts is dealt into blocks that meet pairwise. What leaves a
list is a star per group of candidates, never its pairs; within the groups that these stars unite, all texts are compared
again, block by block, and every candidate pair that is not yet united by verified ones is verified. What is kept is
decided by groups, one document of each; copies of one text are one node.

Defined results: texts with fewer words than a shingle are one shingle, texts without words, null ones too, are copies of
each other; very long texts are compared whole; of a group the smallest doc_id stays, ties by the text's digest, a null
doc_id only if there is no other; of rows repeated whole one stays; an empty table gives no rows; rows keep all their
columns, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateforge.llm.common import stage, tidy
from crateforge.llm.simhash import MAX_BITS, _stars, fingerprint, links
from crateforge.operators.components import components

POSITIONS, PER_KEY, LEAST = 60, 4, 38
KEYS = POSITIONS // PER_KEY
_draw = np.random.default_rng(17)
MULTIPLY = _draw.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _draw.integers(0, 2**63, POSITIONS, dtype=np.uint64)
MIX = _draw.integers(1, 2**63, PER_KEY, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted."""
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-1].tolist()], (ends - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(line[a:b]) for a, b in zip(starts, stops[size - 1 :])], np.uint64))


def positional(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation."""
    least = np.full(POSITIONS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 1024):
        h = hashes[k : k + 1024, None]
        x = h * MULTIPLY + ADD
        np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0), out=least)
    return least


def _signed(size: int):
    """Rows (digest, text) -> (digest, keys, bytes, fp): each text's keys, positional bytes and SimHash, copies in a batch once."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                digests = part.column("digest").to_pylist()
                first = list({d: i for i, d in reversed(list(enumerate(digests)))}.values())
                texts = part.column("text").cast(pa.binary())
                least = np.stack([positional(shingles(texts[i].as_py() or b"", size)) for i in first])
                fps = np.array([fingerprint(texts[i].as_py() or b"") for i in first], np.uint64).view(np.int64)
                keys = (least.reshape(-1, KEYS, PER_KEY) * MIX).sum(axis=2, dtype=np.uint64).view(np.int64)
                raw = [r.tobytes() for r in (least >> np.uint64(20)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in first]), pa.array(list(keys), pa.list_(pa.int64())), pa.array(raw, pa.binary()), pa.array(fps)], names=["digest", "keys", "bytes", "fp"])

    return run


def _shingled(size: int):
    """Rows (digest, text) -> (digest, shingles): the sorted shingle hashes."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [shingles(t.as_py() or b"", size).tobytes() for t in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(sets, pa.binary())], names=["digest", "shingles"])

    return run


def _grouped(names: list[str], found):
    """mapInArrow function over sorted rows: edges (u, v) that ``found`` sees in whole groups of equal ``names``."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key = np.stack([table.column(c).to_numpy() for c in names], axis=1)
            starts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if len(starts):
                yield from found(table.slice(0, starts[-1]), np.concatenate(([0], starts)))
                table = table.slice(starts[-1])
            rest = table
        if rest is not None and rest.num_rows:
            yield from found(rest, np.array([0, rest.num_rows]))

    return run


def _edges(u: np.ndarray, v: np.ndarray):
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _raw(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(-1, POSITIONS)


def _tally(table: pa.Table, cuts: np.ndarray):
    """Stars of the texts of each list that share LEAST bytes; in a list of two blocks, only across them."""
    node, block, apart = (table.column(c).to_numpy() for c in ("node", "block", "apart"))
    first = np.repeat(cuts[:-1], np.diff(cuts))
    here, step, left, right = np.flatnonzero(np.arange(len(node)) > first), 1, [], []
    raw = _raw(table) if len(here) else None
    while len(here):
        ok = (raw[here] == raw[here - step]).sum(axis=1) >= LEAST
        ok &= ~apart[here] | (block[here] != block[here - step])
        left.append(here[ok])
        right.append(here[ok] - step)
        step += 1
        here = here[here - step >= first[here]]
    if left:
        member, root = _stars(node, np.concatenate(left), np.concatenate(right))
        yield from _edges(node[member], node[root])


def _verify(similarity: float):
    """Stars of the texts of each group of candidates whose shingle sets reach the similarity, exactly."""

    def one(table: pa.Table):
        node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        apart, raw, fp = table.column("a")[0] != table.column("b")[0], _raw(table), table.column("fp").to_numpy().view(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        sizes, root = np.array([len(x) for x in sets]), np.arange(len(node))
        for i in range(len(node) - 1):
            more = i + 1
            may = (root[more:] != root[i]) & (np.minimum(sizes[more:], sizes[i]) >= similarity * np.maximum(sizes[more:], sizes[i]) - 1e-9)
            if apart:
                may &= block[more:] != block[i]
            at = np.flatnonzero(may) + more
            close = (raw[at] == raw[i]).sum(axis=1) >= LEAST
            close |= np.bitwise_count(fp[at] ^ fp[i]) <= MAX_BITS
            for j in at[close]:
                if root[j] != root[i]:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9:
                        root[root == root[j]] = root[i]
        moved = np.flatnonzero(root != np.arange(len(node)))
        return node[moved], node[root[moved]]

    def found(table: pa.Table, cuts: np.ndarray):
        for i, j in zip(cuts, cuts[1:]):
            if j - i > 1:
                yield from _edges(*one(table.slice(i, j - i)))

    return found


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows once for each pair (a, b) of the ``blocks`` of their group that holds their own."""
    own = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other", "blocks")


def simhash_links(signed: DataFrame) -> DataFrame:
    """Edges (u, v) of nodes whose components are those of all SimHash links among the rows (node, fp)."""
    first = signed.groupBy("fp").agg(F.min("node").alias("first"))
    same = signed.join(first, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in ("u", "v")]
    near = links(first.select("fp")).join(ends[0], "u").join(ends[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    return same.unionByName(near)


@tidy
def groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, list_block: int = 1024, block: int = 256) -> DataFrame:
    """(digest, root) of every distinct text of ``docs`` (text): texts of a group have one root.

    Texts themselves are shuffled once, and staged never: keys and positional bytes come straight from the rows, and
    shingle sets are made for the texts that have a candidate only.
    """
    rows = docs.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    signed = rows.mapInArrow(_signed(size), "digest string, keys array<long>, bytes binary, fp long").groupBy("digest").agg(*[F.first(c).alias(c) for c in ("keys", "bytes", "fp")])
    signed, _ = stage(signed.withColumn("node", F.monotonically_increasing_id()))
    keyed = signed.select("node", "bytes", F.posexplode("keys").alias("band", "key"))
    long, _ = stage(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > list_block))
    listed = keyed.join(long, ["band", "key"], "left")
    order = ["band", "key", "a", "b"]
    lists = _dealt(listed, F.ceil(F.coalesce("n", F.lit(1)) / F.lit(list_block)).cast("int")).select(*order, "node", "block", (F.col("a") != F.col("b")).alias("apart"), "bytes")
    stars = lists.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(_grouped(order, _tally), "u long, v long")
    near, _ = stage(components(stars.unionByName(simhash_links(signed))))
    counts = near.groupBy("root").agg(F.count("*").alias("n"))
    members, _ = stage(near.join(counts, "root").join(signed.select("node", "digest", "bytes", "fp"), "node"))
    texts = rows.groupBy("digest").agg(F.first("text").alias("text")).join(members.select("digest"), "digest", "left_semi")
    members = members.join(texts.mapInArrow(_shingled(size), "digest string, shingles binary"), "digest")
    order = ["root", "a", "b"]
    met = _dealt(members, F.ceil(F.col("n") / F.lit(block)).cast("int")).select(*order, "node", "block", "bytes", "fp", "shingles")
    roots = components(met.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(_grouped(order, _verify(similarity)), "u long, v long"))
    return signed.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))


@tidy
def dedup(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with their columns."""
    columns = docs.columns
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = groups(packed.select("text"), size, similarity)
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    ids = packed.select(digest.alias("digest"), "id").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    stay = ids.join(found, "digest").groupBy("root").agg(F.min_by(F.struct("digest", "id", "n"), F.struct(F.col("id").isNull(), "id", "digest")).alias("best")).select(F.col("best.digest").alias("digest"), F.col("best.id").alias("best_id"), F.col("best.n").alias("n"))
    stay, _ = stage(stay)
    rows = packed.withColumn("digest", digest).join(stay, "digest").where(F.col("id").eqNullSafe(F.col("best_id")))
    once = rows.where("n = 1").select("row")
    copies = rows.where("n > 1").dropDuplicates(["digest"]).select("row")
    return once.unionByName(copies).select(*[F.col("row").getField(c).alias(c) for c in columns])
