"""Graph measures over edge tables (u, v): levels, triangles, centralities. Rounds are staged, so lineage stays short.

Edges are undirected unless a function says otherwise; ``undirected`` makes both directions of a table, without repeats and
self-links. Null ends are left out. An empty edge table gives an empty result everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateforge.operators.ranges import numbered
from crateforge.sources.staging import discard, stage, tidy


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    rows = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    return rows.union(rows.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree)."""
    return undirected(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    """(degree, nodes)."""
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("nodes"))


def density(edges: DataFrame) -> DataFrame:
    """(nodes, edges, density) of the nodes that have an edge; density is null for fewer than two."""
    both = undirected(edges)
    counted = both.agg(F.count_distinct("u").alias("nodes"), (F.count("*") / 2).cast("long").alias("edges"))
    return counted.withColumn("density", F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)))


def _levels(both: DataFrame, sources: DataFrame, most: int | None) -> list[DataFrame]:
    """The staged levels (source, node, paths) of breadth-first search from every source at once; paths are shortest ones.

    The neighbours of a level lie in the level before, in itself or in the next, so that only the last two are asked.
    """
    nodes = both.select(F.col("u").alias("node")).distinct()
    first, _ = stage(sources.select("node").distinct().join(nodes, "node").select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))
    levels = [first]
    while most is None or len(levels) <= most:
        reached = levels[-1].join(both, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        for known in levels[-2:]:
            reached = reached.join(known.select("source", "node"), ["source", "node"], "left_anti")
        level, path = stage(reached)
        if level.isEmpty():
            discard(both.sparkSession, path)
            break
        levels.append(level)
    return levels


#: Words of a row of ``_reach``; a word holds 64 sources as bits.
WORDS = 8


def _reach(both: DataFrame, asked: DataFrame, most: int | None) -> list[DataFrame]:
    """The staged levels (node, part, w0, ...) of breadth-first search from ``asked`` (n, source): bit n of part and word says that source n is here first.

    A level's neighbours lie in the level before, in itself or in the next, so the bits of the last two are taken out.
    """
    names, known = [f"w{i}" for i in range(WORDS)], [f"k{i}" for i in range(WORDS)]
    none = [F.lit(0).cast("long").alias(k) for k in known]
    place = F.col("n") % (64 * WORDS)
    word = lambda i: F.when(F.floor(place / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).otherwise(F.lit(0).cast("long"))
    nodes = both.select(F.col("u").alias("node")).distinct()
    levels = [stage(asked.join(nodes, asked.source == nodes.node).select("node", F.floor(F.col("n") / (64 * WORDS)).alias("part"), *[word(i).alias(w) for i, w in enumerate(names)]))[0]]
    while most is None or len(levels) <= most:
        rows = levels[-1].join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node"), "part", *names, *none)
        for before in levels[-2:]:
            rows = rows.union(before.select("node", "part", *[F.lit(0).cast("long").alias(w) for w in names], *[F.col(w).alias(k) for w, k in zip(names, known)]))
        met = rows.groupBy("node", "part").agg(*[F.bit_or(c).alias(c) for c in names + known])
        new = met.select("node", "part", *[F.col(w).bitwiseAND(F.bitwise_not(k)).alias(w) for w, k in zip(names, known)])
        level, path = stage(new.where(reduce(lambda x, y: x | y, [F.col(w) != 0 for w in names])))
        if level.isEmpty():
            discard(both.sparkSession, path)
            break
        levels.append(level)
    return levels


#: Bytes of an edge list up to which every task of a search gets it whole; beyond it levels are rows.
EDGE_LIMIT = 64 << 20
#: Bytes of the bits that a task of ``_spread`` holds, edges that it follows at once, and nodes whose bits it unpacks at once.
HELD, SPREAD, UNPACKED = 160 << 20, 1 << 16, 255


def _sent(both: DataFrame, every: DataFrame):
    """Numbers of the nodes (node, n), how many there are, and for every task the neighbours' numbers, those of node n from ``start[n]`` on."""
    names, _ = stage(numbered(every, ["node"]))
    n = names.count()
    of = lambda c: names.select(F.col("node").alias(c), F.col("n").cast("int").alias(f"{c}_n"))
    arcs = both.join(of("u"), "u").join(of("v"), "v").select("u_n", "v_n").toArrow()
    u, v = arcs["u_n"].to_numpy(), arcs["v_n"].to_numpy()
    start = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(u, minlength=n), out=start[1:])
    return names, n, both.sparkSession.sparkContext.broadcast((start, v[np.argsort(u, kind="stable")]))


def _spread(sources: np.ndarray, start: np.ndarray, to: np.ndarray, most: int | None):
    """The levels of breadth-first search from the numbers ``sources``, one row of words for each node: bit i of them says that source i is here first."""
    n, width = len(start) - 1, -(-len(sources) // 64)
    level, at = np.zeros((n, width), np.uint64), np.arange(len(sources))
    np.bitwise_or.at(level, (sources, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    known, pieces = level.copy(), [0]
    while pieces[-1] < n:
        pieces.append(max(pieces[-1] + 1, int(np.searchsorted(start, start[pieces[-1]] + SPREAD, side="right")) - 1))
    depth = 0
    while level.any():
        yield level
        depth += 1
        if most is not None and depth > most:
            return
        new = np.empty_like(level)
        for low, high in zip(pieces, pieces[1:]):
            new[low:high] = np.bitwise_or.reduceat(level[to[start[low] : start[high]]], start[low:high] - start[low], axis=0)
        new &= ~known
        known |= new
        level = new


def _unpacked(level: np.ndarray):
    """(nodes, a row of a byte for each source): the nodes of a level that any source reaches there, UNPACKED at a time."""
    rows = np.flatnonzero(level.any(axis=1))
    for k in range(0, len(rows), UNPACKED):
        yield rows[k : k + UNPACKED], np.unpackbits(level[rows[k : k + UNPACKED]].view(np.uint8), axis=1, bitorder="little")


def _pairs_found(sources: np.ndarray, start: np.ndarray, to: np.ndarray, most: int | None):
    """(node, distance, sources) as columns, a piece of a level at a time; the sources of a node are a list."""
    for depth, level in enumerate(_spread(sources, start, to, most)):
        for rows, bits in _unpacked(level):
            held = bits.sum(axis=1, dtype=np.int32)
            at = np.flatnonzero(bits.view(bool)) - np.repeat(np.arange(len(rows)) * bits.shape[1], held)  # ten times as fast as pairs of indices
            yield rows, np.full(len(rows), depth, np.int32), (np.concatenate((np.zeros(1, np.int32), np.cumsum(held, dtype=np.int32))), sources[at])


def _ends_found(sources: np.ndarray, start: np.ndarray, to: np.ndarray):
    """(source, eccentricity, reached, total) as columns: what is counted of the pairs, without any pair."""
    far, reached, total = np.zeros(len(sources), np.int32), np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
    for depth, level in enumerate(_spread(sources, start, to, None)):
        here = np.zeros(len(sources), np.int64)
        for _, bits in _unpacked(level):
            here += bits.sum(axis=0, dtype=np.uint8)[: len(sources)]  # at most 255 rows
        far[here > 0] = depth
        reached += here
        total += depth * here
    yield sources, far, reached, total


def _searched(both: DataFrame, every: DataFrame, asked: DataFrame, search: Callable, columns: dict[str, str]) -> DataFrame:
    """What ``search`` yields for the sources (node), the edges in every task and the sources spread over tasks; columns of type "name" are nodes, of "names" lists of them."""
    names, n, sent = _sent(both, every)
    spark, kind = both.sparkSession, every.schema["node"].dataType.simpleString()
    numbers = names.toArrow()
    called = spark.sparkContext.broadcast(numbers["node"].combine_chunks().take(pa.array(np.argsort(numbers["n"].to_numpy()))))
    rows = asked.join(names, "node").select("n")
    width = 64 * max(1, min(8, HELD // (32 * max(n, 1))))
    count, cores = rows.count(), spark.sparkContext.defaultParallelism
    tasks = max(1, min(-(-count // 64), -(-count // width // cores) * cores))  # every core has as many

    def column(values, kind: str) -> pa.Array:
        if kind == "names":
            return pa.ListArray.from_arrays(pa.array(values[0]), column(values[1], "name"))
        return called.value.take(pa.array(values)) if kind == "name" else pa.array(values)

    def found(sources: np.ndarray):
        for values in search(sources, *sent.value):
            yield pa.RecordBatch.from_arrays([column(v, t) for v, t in zip(values, columns.values())], names=list(columns))

    def run(batches):
        held = []
        for batch in batches:
            numbers = batch.column("n").to_numpy()
            for k in range(0, len(numbers), width):
                held.append(numbers[k : k + width])
                if sum(map(len, held)) >= width:
                    every = np.concatenate(held)
                    yield from found(every[:width])
                    held = [every[width:]]
        if held and sum(map(len, held)):
            yield from found(np.concatenate(held))

    return rows.repartition(tasks).mapInArrow(run, ", ".join(f"{c} {({'name': kind, 'names': f'array<{kind}>'}).get(t, t)}" for c, t in columns.items()))


@tidy
def distances(edges: DataFrame, sources: DataFrame, most: int | None = None, limit: int = EDGE_LIMIT) -> DataFrame:
    """(source, node, distance): edges on the shortest way from each of ``sources`` (node) to every node it reaches.

    Sources without an edge are left out; ``most`` ends the search after so many edges. The search keeps sets of sources as
    bits; pairs of source and node are rows in the result only. Edges of up to ``limit`` bytes go to every task, which searches
    from some sources at a time and stages nothing; beyond it levels are rows.
    """
    both, _ = stage(undirected(edges))
    asked, _ = stage(numbered(sources.select(F.col("node").alias("source")).where("source is not null").distinct(), ["source"]))
    if 0 < both.count() * 8 <= limit:
        every, _ = stage(both.select(F.col("u").alias("node")).distinct())
        search = lambda found, start, to: _pairs_found(found, start, to, most)
        found = _searched(both, every, asked.select(F.col("source").alias("node")), search, {"node": "name", "distance": "int", "sources": "names"})
        return found.select(F.explode("sources").alias("source"), "node", "distance")
    return _by_levels(both, asked, most)


def _by_levels(both: DataFrame, asked: DataFrame, most: int | None) -> DataFrame:
    """``distances`` from ``asked`` (n, source), read from the staged levels."""
    rows = [level.withColumn("distance", F.lit(k)) for k, level in enumerate(_reach(both, asked, most))]
    words = reduce(DataFrame.unionByName, rows).select("node", "part", "distance", F.posexplode(F.array(*[f"w{i}" for i in range(WORDS)])).alias("word", "bits")).where("bits <> 0")
    bits = words.withColumn("bit", F.explode(F.array(*[F.lit(i) for i in range(64)]))).where(F.expr("shiftrightunsigned(bits, bit) & 1 = 1"))
    return bits.withColumn("n", (F.col("part") * WORDS + F.col("word")) * 64 + F.col("bit")).join(asked, "n").select("source", "node", "distance")


def _ends_by_levels(both: DataFrame, asked: DataFrame) -> tuple[DataFrame, str]:
    """(node, eccentricity, reached, total) of some sources (n, source), staged; their levels are given up."""

    @tidy
    def ends() -> tuple:
        found = _by_levels(both, asked, None).groupBy(F.col("source").alias("node"))
        return stage(found.agg(F.max("distance").alias("eccentricity"), F.count("*").alias("reached"), F.sum("distance").alias("total")))

    return ends()


@tidy
def eccentricities(edges: DataFrame, sources: DataFrame, limit: int = EDGE_LIMIT, block: int = 64 * WORDS) -> DataFrame:
    """(node, eccentricity, reached, closeness) of each source, within its component.

    Closeness is (reached - 1) / (sum of distances), times the share of all other nodes that are reached. Edges of up to
    ``limit`` bytes go to every task, where a level's bits are counted and no pair of source and node is a row; beyond it
    ``block`` sources are searched from at a time, and their levels are given up.
    """
    both, _ = stage(undirected(edges))
    every, _ = stage(both.select(F.col("u").alias("node")).distinct())
    n = every.agg(F.count("*").alias("all"))
    asked = sources.select("node").where("node is not null").distinct()
    if 0 < both.count() * 8 <= limit:
        found = _searched(both, every, asked, _ends_found, {"node": "name", "eccentricity": "int", "reached": "long", "total": "long"})
    else:
        asked, _ = stage(numbered(asked.join(every, "node", "left_semi").withColumnRenamed("node", "source"), ["source"]))
        parts = [_ends_by_levels(both, asked.where(F.floor(F.col("n") / block) == k).withColumn("n", F.col("n") % block))[0] for k in range(max(1, -(-asked.count() // block)))]
        found = reduce(DataFrame.unionByName, parts)
    found, _ = stage(found)  # few rows, which a reader may ask for more than once
    others = F.col("reached") - 1
    return found.join(F.broadcast(n)).select("node", "eccentricity", "reached", (F.try_divide(others, F.col("total")) * F.try_divide(others, F.col("all") - 1)).alias("closeness"))


def extent(eccentric: DataFrame) -> DataFrame:
    """(radius, diameter, centre, periphery) of eccentricities: the least and the greatest, and how many nodes have them."""
    ends = eccentric.agg(F.min("eccentricity").alias("radius"), F.max("eccentricity").alias("diameter"))
    return eccentric.join(F.broadcast(ends)).groupBy("radius", "diameter").agg(F.count_if(F.col("eccentricity") == F.col("radius")).alias("centre"), F.count_if(F.col("eccentricity") == F.col("diameter")).alias("periphery"))


@tidy
def ego(edges: DataFrame, centre: int, radius: int = 1) -> DataFrame:
    """The edges u < v among the nodes at most ``radius`` edges from the centre."""
    spark = edges.sparkSession
    near = distances(edges, spark.range(centre, centre + 1).withColumnRenamed("id", "node"), radius).select("node")
    both = undirected(edges).where("u < v")
    return both.join(near.withColumnRenamed("node", "u"), "u", "left_semi").join(near.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v")


@tidy
def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering): the share of a node's pairs of neighbours that are linked, 0 below two neighbours.

    Every edge points to its end of higher degree, so that a node's wedges are pairs of its outgoing edges only: a hub has
    few, and there are at most (edges)^1.5 in all. A wedge is closed by a join with the edges.
    """
    both, _ = stage(undirected(edges))
    degree, _ = stage(both.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree")))
    of = lambda c: degree.select(F.col("node").alias(c), F.col("degree").alias(f"{c}_degree"))
    ahead = both.join(of("u"), "u").join(of("v"), "v").where("u_degree < v_degree or (u_degree = v_degree and u < v)")
    out, _ = stage(ahead.select("u", "v", "v_degree"))
    other = out.select("u", F.col("v").alias("w"), F.col("v_degree").alias("w_degree"))
    wedges = out.join(other, "u").where("v_degree < w_degree or (v_degree = w_degree and v < w)").select("u", "v", "w")
    closed = wedges.join(out.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"], "left_semi")
    corners = closed.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    n, pairs = F.coalesce("triangles", F.lit(0)), F.col("degree") * (F.col("degree") - 1)
    return degree.join(corners, "node", "left").select("node", "degree", n.alias("triangles"), F.coalesce(F.try_divide(2.0 * n, pairs), F.lit(0.0)).alias("clustering"))


def _rounds(now: DataFrame, arcs: DataFrame, rounds: int, given: Column, weigh: Callable[[Column, Column], Column]) -> tuple[DataFrame, str]:
    """``rounds`` rounds of an iteration in one job: (node, value, was), staged; ``was`` is the value a round earlier.

    A value goes along the arcs (u, v, own, ...) as ``given`` of it, and ``weigh`` makes the next value of a node's sum and of
    what was. An arc with ``own`` leads from each node to itself, so that no node is lost and a round reads the one before
    only once.
    """
    for _ in range(rounds):
        sent = now.select(F.col("node").alias("u"), "value", "was").join(arcs, "u")
        met = sent.groupBy(F.col("v").alias("node")).agg(F.sum(given).alias("got"), F.max(F.when(F.col("own"), F.col("value"))).alias("value"), F.max(F.when(F.col("own"), F.col("was"))).alias("was"))
        now = met.select("node", weigh(F.col("got"), F.col("was")).alias("new"), F.col("value").alias("was")).withColumnRenamed("new", "value")
    return stage(now)


@tidy
def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, most: int = 500, every: int = 8) -> DataFrame:
    """(node, rank) of the directed edges (u, v); repeated edges count once, self-links count.

    Power iteration from equal ranks; nodes without outgoing edges give theirs to all, which is the same as giving them to
    none and scaling the ranks to the sum 1 at the end. ``every`` rounds are one job, whose last round's change of ranks is
    summed; under ``tolerance`` it ends.
    """
    spark = edges.sparkSession
    out, _ = stage(edges.select("u", "v").where("u is not null and v is not null").distinct())
    nodes = out.select(F.col("u").alias("node")).union(out.select("v")).distinct()
    now, path = stage(nodes)
    n = now.count()
    if not n:
        return out.select(F.col("u").alias("node"), F.lit(0.0).alias("rank")).limit(0)
    links = out.groupBy("u").agg(F.count("*").alias("links"))
    own = now.select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(True).alias("own"), F.lit(None).cast("long").alias("links"))
    arcs, _ = stage(out.join(links, "u").select("u", "v", F.lit(False).alias("own"), "links").union(own))
    now = now.select("node", F.lit(1.0 / n).alias("value"), F.lit(0.0).alias("was"))
    given = F.when(F.col("own"), F.lit(0.0)).otherwise(F.col("value") / F.col("links"))
    for _ in range(0, most, every):
        now, new_path = _rounds(now, arcs, every, given, lambda got, _: F.lit((1 - damping) / n) + F.lit(damping) * got)
        discard(spark, path)
        path = new_path
        change, total = now.agg(F.sum(F.abs(F.col("value") - F.col("was"))), F.sum("value")).first()
        if change < tolerance * total:
            whole = now.agg(F.sum("value").alias("whole"))
            return now.join(F.broadcast(whole)).select("node", (F.col("value") / F.col("whole")).alias("rank"))
    raise RuntimeError("pagerank did not settle")


@tidy
def eigenvector(edges: DataFrame, tolerance: float = 1e-10, most: int = 2000, every: int = 8) -> DataFrame:
    """(node, centrality): the leading eigenvector of the undirected graph, of length 1 and without negative entries.

    Power iteration on M, the adjacency plus the identity, which does not swing on bipartite graphs. Its rounds are
    Chebyshev's, x'' = (2 / edge) M x' - x: what lies within ``edge`` of zero does not grow. ``edge`` starts low and rises to
    the second eigenvalue, as the pace of the change shows it, and stays under the first. ``every`` rounds are one job, after
    which lengths are taken out and the last round is compared with the one before; it ends when the squares of the
    differences sum to less than ``tolerance`` squared.
    """
    spark = edges.sparkSession
    both, _ = stage(undirected(edges))
    now, path = stage(both.select(F.col("u").alias("node")).distinct())
    arcs, _ = stage(both.select("u", "v", F.lit(False).alias("own")).union(now.select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(True).alias("own"))))
    now = now.select("node", F.lit(1.0).alias("value"), F.lit(0.0).alias("was"))
    edge, before = 0.0, None
    for _ in range(0, most, every):
        weigh = (lambda got, was, e=edge: 2.0 / e * got - was) if edge else (lambda got, was: got)
        now, new_path = _rounds(now, arcs, every, F.col("value"), weigh)
        discard(spark, path)
        path = new_path
        length, length_was = now.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))), F.sqrt(F.sum(F.col("was") * F.col("was")))).first()
        if length is None:
            return now.select("node", F.col("value").alias("centrality"))
        found = now.select("node", F.abs(F.col("value") / length).alias("centrality"))
        change = now.agg(F.sqrt(F.sum((F.col("value") / length - F.col("was") / length_was) ** 2))).first()[0]
        if change < tolerance:
            return found
        now = now.select("node", (F.col("value") / length).alias("value"), (F.col("was") / length).alias("was"))
        grows = length / length_was  # of the first eigenvalue; of the second it is less by the pace of the change
        eigenvalue = lambda pace: edge * (pace + 1 / pace) / 2 if edge else pace
        first, second = eigenvalue(grows), None
        if before is None:
            second = first / 2 if not edge else None
        elif change < before and (change / before) ** (1 / every) * grows > 1:
            second = min(eigenvalue((change / before) ** (1 / every) * grows), (edge + first) / 2)
        if second is not None and second > edge * 1.001:
            edge, before = second, None
            now = now.withColumn("was", F.lit(0.0))
        else:
            before = change
    raise RuntimeError("eigenvector centrality did not settle")


def _dependencies(both: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, score): sums over the sources of the share of their shortest ways that pass a node; levels forwards, then backwards."""
    levels = _levels(both, sources, None)
    behind, scores = None, []
    for level in reversed(levels[1:]):
        if behind is None:
            own, _ = stage(level.withColumn("share", F.lit(0.0)))
        else:
            given = behind.select("source", F.col("node").alias("u"), ((1.0 + F.col("share")) / F.col("paths")).alias("each"))
            got = given.join(both, "u").select("source", F.col("v").alias("node"), "each")
            summed = level.select("source", "node").join(got, ["source", "node"]).groupBy("source", "node").agg(F.sum("each").alias("each"))
            own, _ = stage(level.join(summed, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("each", F.lit(0.0))).alias("share")))
        scores.append(own.groupBy("node").agg(F.sum("share").alias("score")))
        behind = own
    empty = both.select(F.col("u").alias("node"), F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.unionByName, scores, empty)


#: Cells of source and node that a task holds at once, and edges that it follows at once.
CELLS, FOLLOWED = 1 << 22, 1 << 20


def _follow(front: np.ndarray, start: np.ndarray, to: np.ndarray, n: int):
    """Pieces (places in ``front``, cells that their edges lead to) of the cells ``front``; a cell is n times a source's number plus a node."""
    node = front % n
    ends = np.cumsum(start[node + 1] - start[node])
    low = 0
    while low < len(front):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + FOLLOWED, side="right")))
        count = np.diff(ends[low:high], prepend=before)
        place = np.repeat(np.arange(low, high), count)
        edge = np.arange(before, ends[high - 1]) - np.repeat(ends[low:high] - count - start[node[low:high]], count)
        yield place, front[place] - node[place] + to[edge]
        low = high


def _shares(sources: np.ndarray, start: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each node the sum over the sources of the share of their shortest ways that pass it; nodes are numbers, ``to`` the neighbours from ``start`` on."""
    n = len(start) - 1
    paths, depth = np.zeros(len(sources) * n), np.full(len(sources) * n, -1, np.int32)
    front = np.arange(len(sources)) * n + sources
    paths[front], levels = 1.0, []
    while len(front):
        depth[front] = len(levels)
        levels.append(front)
        for place, cell in _follow(front, start, to, n):
            new = depth[cell] < 0
            np.add.at(paths, cell[new], paths[front[place[new]]])
        front = np.flatnonzero((depth < 0) & (paths > 0))
    share = np.zeros(len(paths))
    for k in range(len(levels) - 1, 0, -1):
        front = levels[k]
        each = (1.0 + share[front]) / paths[front]
        for place, cell in _follow(front, start, to, n):
            before = depth[cell] == k - 1
            np.add.at(share, cell[before], each[place[before]])
        share[levels[k - 1]] *= paths[levels[k - 1]]
    share[levels[0]] = 0.0
    return share.reshape(len(sources), n).sum(axis=0)


def _by_sources(both: DataFrame, every: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, score) as ``_dependencies`` has it, the edges in every task and the sources spread over tasks, some at a time."""
    spark = both.sparkSession
    names, n, sent = _sent(both, every)
    width = max(1, CELLS // max(n, 1))

    def run(batches):
        score, held = np.zeros(n), []
        for batch in batches:
            numbers = batch.column("n").to_numpy()
            for k in range(0, len(numbers), width):
                held.append(numbers[k : k + width])
                if sum(map(len, held)) >= width:
                    score += _shares(np.concatenate(held), *sent.value)
                    held = []
        if held:
            score += _shares(np.concatenate(held), *sent.value)
        at = np.flatnonzero(score)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)]), pa.array(score[at[k : k + (1 << 16)]])], names=["n", "score"])

    rows = asked.join(names, "node").select("n")
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, -(-rows.count() // min(width, 16))))
    found = rows.repartition(tasks).mapInArrow(run, "n long, score double").groupBy("n").agg(F.sum("score").alias("score"))
    return names.join(found, "n", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


@tidy
def betweenness(edges: DataFrame, sources: DataFrame | None = None, block: int = 256, limit: int = EDGE_LIMIT) -> DataFrame:
    """(node, betweenness): shortest ways between other nodes that pass a node, each pair once, ways of equal length shared.

    With ``sources`` (node) only ways that start there count, each end twice as much as a pair has two. All nodes with an
    edge are in the result. Edges of up to ``limit`` bytes go to every task, and a task holds CELLS cells of its sources at
    once; beyond it sources are taken in blocks of about ``block``, whose levels are rows and given up when the block is done.
    """
    spark = edges.sparkSession
    both, _ = stage(undirected(edges))
    every, _ = stage(both.select(F.col("u").alias("node")).distinct())
    asked, _ = stage(every if sources is None else every.join(sources.select("node").distinct(), "node", "left_semi"))
    if 0 < both.count() * 8 <= limit:
        return stage(_by_sources(both, every, asked))[0].select("node", (F.col("score") / 2).alias("betweenness"))
    blocks = -(-asked.count() // block)
    total, path = stage(every.withColumn("score", F.lit(0.0)))
    for k in range(blocks):
        total, new_path = _block(both, asked.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k), total)
        discard(spark, path)
        path = new_path
    return total.select("node", (F.col("score") / 2).alias("betweenness"))


def _block(both: DataFrame, sources: DataFrame, total: DataFrame) -> tuple[DataFrame, str]:
    @tidy
    def added() -> tuple:
        return stage(total.unionByName(_dependencies(both, sources)).groupBy("node").agg(F.sum("score").alias("score")))

    return added()


def top_neighbours(edges: DataFrame, k: int = 3) -> DataFrame:
    """(node, neighbour, rank): each node's k neighbours of highest degree, ties to the smaller id."""
    both = undirected(edges)
    ranked = both.join(degrees(edges).withColumnRenamed("node", "v"), "v").withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("degree"), "v")))
    return ranked.where(F.col("rank") <= k).select(F.col("u").alias("node"), F.col("v").alias("neighbour"), "rank")
