"""Embedding near-duplicates by sorted projection passes.

Each pass orders the vectors of a label lexicographically by the concatenated bits of random hashes (on which side of
random planes through the label's mean a vector lies) and compares every vector with the ``window`` before it. A pass is
one range shuffle that carries the vectors (as floats, if they came as floats); windows run on over the borders of the
ranges, as each range hands its first and last ``window`` rows on to its neighbours. Pairs that reach the threshold are
united across passes, as stars and never as pairs.

How many passes there are is no setting. Probes are planted in the sort: copies of vectors drawn by hash, about PROBES a
label, turned until their cosine to the original is the threshold itself, half of them in a random direction, half towards
another vector of the label. They link with nothing; a probe is found when some window holds it and its original, so the
share found is the share that the passes so far would find of lone pairs at the threshold, whatever the label's size and
density. Passes go on, ``passes`` at a time, for the labels in which more than ``missed`` of the probes were not found yet.

Then an exact count follows within each united group, as its links need not all have met in a window. A group of more than
``block`` vectors is cut into rings by the angle to its centre: if twice the largest angle lies under the threshold's, all
link and nothing is compared; rings whose angles differ by more than the threshold's never meet; the others are compared
ring by ring.

Equal vectors of a label are one node with a multiplicity; they link with each other.

Defined results: a vector that is null, zero, or has null or non-finite components, or a null label, links with nothing;
very large and very small components are scaled first and do not overflow; vectors of different length never link;
repeated rows (also of one vec_id) link as other vectors; a null vec_id is never a component_id unless its whole component
has none; an empty table gives no rows; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateforge.llm.common import stage, tidy, wanted
from crateforge.llm.simhash import _stars
from crateforge.operators.components import components
from crateforge.operators.ranges import numbered

BITS = 62
#: Probes of a large label; of a small one, every fourth vector has one.
PROBES = 256
#: What a pass hands on: a star, a found probe, the first and the last rows of a range.
STAR, FOUND, FIRST, LAST = range(4)
MET = "kind int, u long, v long, place int, pass long, label long, size int, source long, vec binary"


def _vectors(kind):
    """Rows (vec_id, label, vec): the components as bytes of ``kind``, null if the vector can link with nothing."""

    def run(batches):
        for batch in batches:
            out = []
            for label, vector in zip(batch.column("label").to_pylist(), batch.column("embedding")):
                value = None
                if label is not None and vector.is_valid and not vector.values.null_count and len(vector.values):
                    x = vector.values.to_numpy(zero_copy_only=False).astype(kind)
                    value = x.tobytes() if np.isfinite(x).all() and x.any() else None
                out.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])

    return run


def _units(vecs: list[bytes], kind) -> np.ndarray:
    """Unit vectors in double; a power of two, which changes no digit, is taken out first, so that no square overflows."""
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _partial_sums(kind):
    """Rows (label, size, total, n): a task's sum of the unit vectors of each label and length."""

    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            label, size, vecs = batch.column("label").to_numpy(), batch.column("size").to_numpy(), batch.column("vec").to_pylist()
            order = np.lexsort((size, label))
            for a, b in _runs(np.stack((label[order], size[order]), axis=1)) if len(order) else []:
                own = sums.setdefault((int(label[order[a]]), int(size[order[a]])), [0.0, 0])
                own[0] = own[0] + _units([vecs[i] for i in order[a:b]], kind).sum(axis=0)
                own[1] += b - a
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k][0].tobytes() for k in keys], pa.binary()), pa.array([sums[k][1] for k in keys], pa.int64())],
            names=["label", "size", "total", "n"],
        )

    return run


def _mean(table: pa.Table) -> pa.Table:
    n = sum(table.column("n").to_pylist())
    total = np.sum([np.frombuffer(x, np.float64) for x in table.column("total").to_pylist()], axis=0) / n
    return pa.table([table.column("label")[:1], table.column("size")[:1], pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["label", "size", "n", "mean"])


def turned(x: np.ndarray, towards: np.ndarray, cosine: float) -> np.ndarray:
    """Unit vectors at the cosine to the unit vectors ``x``, in the plane of ``x`` and ``towards``."""
    across = towards - (towards * x).sum(axis=1, keepdims=True) * x
    across /= np.maximum(np.sqrt((across * across).sum(axis=1, keepdims=True)), 1e-300)
    return cosine * x + np.sqrt(1 - cosine * cosine) * across


def _planted(kind, threshold: float):
    """Rows (node, label, size, vec, mean, probe) -> the same with source, null, and a probe for each row that is to have one."""

    def run(batches):
        for batch in batches:
            probe = np.flatnonzero(batch.column("probe").to_numpy(zero_copy_only=False).astype(bool))
            rows = batch.drop_columns("probe")
            yield rows.append_column("source", pa.nulls(len(rows), pa.int64()))
            if not len(probe):
                continue
            vecs, node, own = rows.column("vec").to_pylist(), rows.column("node").to_numpy(), [rows.column(c).to_numpy() for c in ("label", "size")]
            near = {}
            for i in range(len(vecs)):  # another vector of the label in this batch
                near.setdefault((own[0][i], own[1][i]), []).append(i)
            made = []
            for i in probe.tolist():
                x = _units([vecs[i]], kind)
                draw = np.random.default_rng(abs(int(node[i])))
                peers = near[own[0][i], own[1][i]]
                other = peers[int(draw.integers(len(peers)))]
                towards = _units([vecs[other]], kind) if int(node[i]) % 2 and other != i else draw.standard_normal(x.shape)
                made.append(turned(x, towards, threshold).astype(kind).tobytes())
            at = pa.array(probe)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - node[probe]), *(rows.column(c).take(at) for c in ("label", "size")), pa.array(made, pa.binary()), rows.column("mean").take(at), pa.array(node[probe])], names=["node", "label", "size", "vec", "mean", "source"])

    return run


def _keys(kind, batch_number: int, passes: int):
    """Rows (pass, label, size, key, node, source, vec): each row once a pass, under the bits of BITS planes, the first highest."""

    def planes(width: int) -> np.ndarray:
        return np.random.default_rng((batch_number, width)).standard_normal((width, passes * BITS))

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                size = batch.column("size").to_numpy()
                keys = np.zeros((len(size), passes), np.int64)
                vecs, means = batch.column("vec").to_pylist(), batch.column("mean").to_pylist()
                for width in np.unique(size).tolist():
                    at = np.flatnonzero(size == width)
                    of = known.setdefault(width, planes(width // np.dtype(kind).itemsize))
                    apart = _units([vecs[i] for i in at], kind) - np.frombuffer(b"".join([means[i] for i in at]), np.float64).reshape(len(at), -1)
                    keys[at] = (apart @ of >= 0).reshape(len(at), passes, BITS) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                same = [batch.column(c) for c in ("label", "size")], [batch.column(c) for c in ("node", "source", "vec")]
                for k in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), batch_number * passes + k)), *same[0], pa.array(keys[:, k].copy()), *same[1]], names=["pass", "label", "size", "key", "node", "source", "vec"])

    return run


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal rows begin and end."""
    cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
    return list(zip(cuts, cuts[1:]))


def _met(table: pa.Table, kind, threshold: float, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted rows -> stars (u, v) of the pairs at most ``window`` places apart that reach the threshold, and the sources of the probes found."""
    turn, label, size, node = (table.column(c).to_numpy() for c in ("pass", "label", "size", "node"))
    source, vecs = table.column("source").fill_null(-1).to_numpy(), table.column("vec").to_pylist()
    real, left, right, found = node >= 0, [], [], []
    for a, b in _runs(np.stack((turn, label, size), axis=1)):
        x, own, n = _units(vecs[a:b], kind), real[a:b], b - a
        for start in range(0, n, window):
            stop, end = min(start + window, n), min(start + 2 * window, n)
            i, j = np.nonzero(x[start:stop] @ x[start:end].T >= threshold)
            ok = (j > i) & (j - i <= window) & own[start + i] & own[start + j]
            left.append(a + start + i[ok])
            right.append(a + start + j[ok])
            if sum(map(len, left)) > 1 << 20:  # of dense groups only stars are held
                left, right = ([s] for s in _stars(node, np.concatenate(left), np.concatenate(right)))
        probes = a + np.flatnonzero(~own)
        if len(probes):
            of, order = source[probes], np.argsort(node[a:b])
            place = np.minimum(np.searchsorted(node[a:b], of, sorter=order), n - 1)
            place = a + order[place]
            found.append(of[(node[place] == of) & (np.abs(place - probes) <= window)])
    none = np.zeros(0, np.int64)
    left, right = (np.concatenate(s) if s else none for s in (left, right))
    member, root = _stars(node, left, right) if len(left) else (none, none)
    return node[member], node[root], np.concatenate(found) if found else none


def _rows(kind_of: int, u: np.ndarray, v: np.ndarray | None = None, rows: pa.Table | None = None, place: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of MET."""
    n, null = len(u), lambda t: pa.nulls(len(u), t)
    of = [null(pa.int32()), null(pa.int64()), null(pa.int64()), null(pa.int32()), null(pa.int64()), null(pa.binary())]
    if rows is not None:
        of = [pa.array(place.astype(np.int32)), *(rows.column(c).combine_chunks() for c in ("pass", "label", "size", "source", "vec"))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind_of, np.int32)), pa.array(u), null(pa.int64()) if v is None else pa.array(v), *of], names=[c.split()[0] for c in MET.split(", ")])


def _windows(kind, threshold: float, window: int):
    """A range of sorted rows -> rows MET: its stars and found probes, and the rows that its neighbours' windows need."""

    def run(batches):
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table, at = pa.Table.from_batches(parts).combine_chunks(), TaskContext.get().partitionId()
        u, v, found = _met(table, kind, threshold, window)
        yield _rows(STAR, u, v)
        yield _rows(FOUND, found)
        n = table.num_rows
        for kind_of, border, a, b in ((FIRST, at - 1, 0, min(window, n)), (LAST, at, max(0, n - window), n)):
            part = table.slice(a, b - a)
            yield _rows(kind_of, part.column("node").to_numpy(), np.full(b - a, border), part, np.arange(b - a))

    return run


def _borders(kind, threshold: float, window: int):
    """The last rows of a range and the first of the next -> rows MET."""

    def found(table: pa.Table):
        table = table.rename_columns({"u": "node"}).combine_chunks()
        u, v, probes = _met(table, kind, threshold, window)
        yield _rows(STAR, u, v)
        yield _rows(FOUND, probes)

    return _whole(["v"], found)


def _whole(names: list[str], found):
    """mapInArrow function over sorted rows: what ``found`` yields for each whole group of equal ``names``."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            *done, last = _runs(np.stack([table.column(c).to_numpy() for c in names], axis=1))
            for a, b in done:
                yield from found(table.slice(a, b - a))
            rest = table.slice(last[0])
        if rest is not None and rest.num_rows:
            yield from found(rest)

    return run


def _counted(kind, threshold: float):
    """One meeting (root, a, b) of blocks of a group -> rows (node, n): each node's links in it, copies counted."""

    def found(table: pa.Table):
        node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        x = _units(table.column("vec").to_pylist(), kind)
        linked = x @ x.T >= threshold
        linked &= ~np.eye(len(x), dtype=bool) if table.column("a")[0] == table.column("b")[0] else block[:, None] != block[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array((linked @ copies).astype(np.int64))], names=["node", "n"])

    return _whole(["root", "a", "b"], found)


def _angles(kind):
    """Rows (node, root, mean, vec) -> (node, angle): to the centre of the group."""

    def run(batches):
        for batch in batches:
            vecs, means = batch.column("vec").to_pylist(), batch.column("mean").to_pylist()
            width, angle = np.array([len(v) for v in vecs]), np.zeros(len(vecs))
            for w in np.unique(width).tolist():  # a batch may hold groups of several lengths
                at = np.flatnonzero(width == w)
                centre = np.frombuffer(b"".join([means[i] for i in at]), np.float64).reshape(len(at), -1)
                cosine = (_units([vecs[i] for i in at], kind) * centre).sum(axis=1) / np.maximum(np.sqrt((centre * centre).sum(axis=1)), 1e-300)
                angle[at] = np.arccos(np.clip(cosine, -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(angle)], names=["node", "angle"])

    return run


def _means(rows: DataFrame, kind, label: str) -> DataFrame:
    """(label, size, n, mean) of rows (label, size, vec) under the column ``label``."""
    sums = rows.select(F.col(label).alias("label"), "size", "vec").mapInArrow(_partial_sums(kind), "label long, size int, total binary, n long")
    return sums.groupBy("label", "size").applyInArrow(_mean, "label long, size int, n long, mean binary").withColumnRenamed("label", label)


def united(nodes: DataFrame, kind, threshold: float, window: int, passes: int, missed: float, deal: int) -> DataFrame:
    """(node, root) of the nodes that passes unite with others."""
    sized = nodes.select("node", "label", F.octet_length("vec").cast("int").alias("size"), "vec")
    groups, _ = stage(_means(sized, kind, "label").where("n > 1"))
    share = F.least(F.lit(0.25), F.lit(float(PROBES)) / F.col("n"))
    drawn = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 31)) < share * F.lit(float(1 << 31))
    rows = sized.join(groups, ["label", "size"]).select("node", "label", "size", "vec", "mean", drawn.alias("probe"))
    rows, _ = stage(rows.mapInArrow(_planted(kind, threshold), "node long, label long, size int, vec binary, mean binary, source long"))
    probes, _ = stage(rows.where("source is not null").select("label", "size", "source"))
    left, _ = stage(groups.select("label", "size"))
    stars, k, missing = None, 0, probes
    while not left.isEmpty():
        now = rows.join(left, ["label", "size"])
        parts = max(1, -(-now.count() * passes // max(deal, 4 * window)))
        keyed = now.select(*rows.columns).mapInArrow(_keys(kind, k, passes), "pass long, label long, size int, key long, node long, source long, vec binary")
        order = ["pass", "label", "size", "key", "node"]
        met, _ = stage(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_windows(kind, threshold, window), MET))
        borders = met.where(F.col("kind").isin(FIRST, LAST)).repartition("v").sortWithinPartitions("v", F.desc("kind"), "place").mapInArrow(_borders(kind, threshold, window), MET)
        found, _ = stage(met.where(F.col("kind").isin(STAR, FOUND)).unionByName(borders).select("kind", "u", "v").distinct())
        linked = found.where(F.col("kind") == STAR).select("u", "v")
        stars = linked if stars is None else stars.unionByName(linked)
        missing, _ = stage(missing.join(found.where(F.col("kind") == FOUND).select(F.col("u").alias("source")), "source", "left_anti"))
        lost = missing.groupBy("label", "size").agg(F.count("*").alias("lost"))
        planted = probes.groupBy("label", "size").agg(F.count("*").alias("planted"))
        left, _ = stage(lost.join(planted, ["label", "size"]).where(F.col("lost") > F.lit(missed) * F.col("planted")).select("label", "size"))
        k += 1
    return components(stars) if stars is not None else nodes.sparkSession.createDataFrame([], "node long, root long")


def _links(members: DataFrame, kind, threshold: float, block: int) -> DataFrame:
    """(node, n): the links of each node within its group of ``members`` (root, node, copies, vec), copies counted."""
    sized = members.select("root", "node", "copies", F.octet_length("vec").cast("int").alias("size"), "vec")
    counts = sized.groupBy("root").agg(F.count("*").alias("members"), F.sum("copies").alias("rows"))
    small = sized.join(counts.where(F.col("members") <= block), "root").select("root", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("block"), "node", "copies", "vec")
    large, _ = stage(sized.join(counts.where(F.col("members") > block), "root"))
    order, counted = ["root", "a", "b"], _counted(kind, threshold)
    meet = lambda rows: rows.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(counted, "node long, n long")
    found = meet(small)
    if not large.isEmpty():
        means = _means(large, kind, "root").select("root", "mean")
        angles = large.join(means, "root").select("node", "mean", "vec").mapInArrow(_angles(kind), "node long, angle double")
        placed, _ = stage(large.join(angles, "node"))
        reach = float(np.arccos(threshold)) + 1e-6
        spread = placed.groupBy("root").agg(F.max("angle").alias("widest"))
        tight = spread.where(F.col("widest") * 2 < reach - 1e-5).select("root")
        all_linked = placed.join(tight, "root").select("node", (F.col("rows") - F.col("copies")).alias("n"))
        rings = numbered(placed.join(tight, "root", "left_anti"), ["root", "angle", "node"], "place")
        first = rings.groupBy("root").agg(F.min("place").alias("first"))
        rings, _ = stage(rings.join(first, "root").withColumn("block", F.floor((F.col("place") - F.col("first")) / F.lit(block)).cast("int")))
        edges = rings.groupBy("root", "block").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
        other = edges.select("root", F.col("block").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
        near = edges.join(other, "root").where((F.col("low") - F.col("other_high") <= reach) & (F.col("other_low") - F.col("high") <= reach)).select("root", "block", "other")
        dealt = rings.join(near, ["root", "block"]).select("root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "copies", "vec")
        found = found.unionByName(meet(dealt)).unionByName(all_linked)
    return found.groupBy("node").agg(F.sum("n").alias("n"))


@tidy
def near_duplicates(vectors: DataFrame, threshold: float = 0.98, window: int = 256, passes: int = 8, missed: float = 0.005, block: int = 1024, deal: int = 8192) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. ``deal`` rows are one range of a pass."""
    columns = wanted(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    of = columns.schema["embedding"].dataType
    kind = np.float32 if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.FloatType) else np.float64
    rows, _ = stage(columns.mapInArrow(_vectors(kind), "vec_id long, label long, vec binary"))
    nodes, _ = stage(rows.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    roots = united(nodes, kind, threshold, window, passes, missed, deal)
    members, _ = stage(roots.join(nodes, "node").select("root", "node", "least", "copies", "vec"))
    links = _links(members, kind, threshold, block)
    groups = members.groupBy("root").agg(F.min("least").alias("component"))
    known = nodes.join(links, "node", "left").join(roots, "node", "left").join(groups, "root", "left").select("label", "vec", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "least").alias("component"))
    return rows.join(known, ["label", "vec"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
