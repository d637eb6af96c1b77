"""Graph measures against plain versions."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateforge.operators import graph, overlap
from crateforge.operators.components import components
from crateforge.operators.overlap import overlap_join


def _random(seed: int, n: int, m: int) -> list[tuple[int, int]]:
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
    return pairs + pairs[:5] + [(b, a) for a, b in pairs[5:9]] + [(3, 3)] + [(n + i, n + i + 1) for i in range(6)]  # repeats, a self-link, a path apart


def _table(spark, pairs):
    return spark.createDataFrame(pairs + [(None, 1), (2, None)], "u long, v long").repartition(5)


def _around(pairs) -> dict[int, set[int]]:
    near: dict[int, set[int]] = {}
    for u, v in pairs:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    return near


def _levels(near, source):
    seen, queue = {source: 0}, deque([source])
    while queue:
        u = queue.popleft()
        for v in near[u]:
            if v not in seen:
                seen[v] = seen[u] + 1
                queue.append(v)
    return seen


PAIRS = _random(1, 60, 90)
NEAR = _around(PAIRS)


def test_components(spark):
    found = {r.node: r.root for r in components(_table(spark, PAIRS)).collect()}
    assert found == {u: min(_levels(NEAR, u)) for u in NEAR}
    assert components(_table(spark, PAIRS).limit(0)).collect() == []


def test_a_long_path_is_one_component(spark):
    found = components(spark.range(0, 3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).repartition(4))
    assert found.agg(F.max("root"), F.count("*")).first()[:] == (0, 3001)


def test_distances_and_extent(spark):
    edges = _table(spark, PAIRS)
    sources = spark.createDataFrame([(u,) for u in (0, 1, 7, 61, 61, 5000)], "node long")
    want = {(s, v, d) for s in (0, 1, 7, 61) if s in NEAR for v, d in _levels(NEAR, s).items()}
    assert {tuple(r) for r in graph.distances(edges, sources).collect()} == want
    assert {tuple(r) for r in graph.distances(edges, sources, 2).collect()} == {w for w in want if w[2] <= 2}
    every = spark.createDataFrame([(u,) for u in NEAR], "node long")
    got = {r.node: (r.eccentricity, r.reached, round(r.closeness, 9)) for r in graph.eccentricities(edges, every).collect()}
    plain = {u: _levels(NEAR, u) for u in NEAR}
    assert got == {u: (max(p.values()), len(p), round((len(p) - 1) / sum(p.values()) * (len(p) - 1) / (len(NEAR) - 1), 9)) for u, p in plain.items()}
    ends = [max(p.values()) for p in plain.values()]
    assert tuple(graph.extent(graph.eccentricities(edges, every)).first()) == (min(ends), max(ends), ends.count(min(ends)), ends.count(max(ends)))


def test_degrees_and_density(spark):
    edges = _table(spark, PAIRS)
    assert {tuple(r) for r in graph.degrees(edges).collect()} == {(u, len(n)) for u, n in NEAR.items()}
    sizes = [len(n) for n in NEAR.values()]
    assert {tuple(r) for r in graph.degree_histogram(edges).collect()} == {(k, sizes.count(k)) for k in set(sizes)}
    n, m = len(NEAR), sum(sizes) // 2
    assert tuple(graph.density(edges).first()) == (n, m, pytest.approx(2 * m / (n * (n - 1))))
    top = {(r.node, r["rank"]): r.neighbour for r in graph.top_neighbours(edges, 2).collect()}
    assert top == {(u, k): v for u, near in NEAR.items() for k, v in enumerate(sorted(near, key=lambda x: (-len(NEAR[x]), x))[:2], 1)}


def test_ego(spark):
    near = {u for u, d in _levels(NEAR, 7).items() if d <= 2}
    assert {tuple(r) for r in graph.ego(_table(spark, PAIRS), 7, 2).collect()} == {(u, v) for u in near for v in NEAR[u] if v in near and u < v}


def test_clustering(spark):
    got = {r.node: (r.degree, r.triangles, round(r.clustering, 9)) for r in graph.clustering(_table(spark, _random(2, 30, 120))).collect()}
    near = _around(_random(2, 30, 120))
    links = {u: sum(1 for a in n for b in n if a < b and b in near[a]) for u, n in near.items()}
    assert got == {u: (len(n), links[u], round(2 * links[u] / (len(n) * (len(n) - 1)), 9) if len(n) > 1 else 0.0) for u, n in near.items()}
    assert sum(links.values()) > 50


def test_a_hub_has_few_wedges(spark):
    """One hub of 10,000 edges and a ring around it: 10,000 triangles, and no pair of the hub's neighbours is tried."""
    n = 10_000
    ring = [(i, i % n + 1) for i in range(1, n + 1)]
    edges = spark.createDataFrame([(0, i) for i in range(1, n + 1)] + ring, "u long, v long")
    found = graph.clustering(edges)
    assert tuple(found.where("node = 0").first())[:3] == (0, n, n)
    assert found.where("node > 0").agg(F.min("triangles"), F.max("triangles")).first()[:] == (2, 2)
    both = graph.undirected(edges)
    degree = graph.degrees(edges)
    ahead = both.join(degree.withColumnRenamed("node", "u"), "u").join(degree.select(F.col("node").alias("v"), F.col("degree").alias("other")), "v").where("degree < other or (degree = other and u < v)")
    assert ahead.groupBy("u").count().agg(F.max("count")).first()[0] <= 3


def _plain_pagerank(pairs, damping=0.85):
    pairs = set(pairs)
    nodes = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for u, v in pairs:
        m[at[v], at[u]] = 1
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.maximum(out, 1), 1 / len(nodes))
    x = np.full(len(nodes), 1 / len(nodes))
    for _ in range(400):
        x = (1 - damping) / len(nodes) + damping * m @ x
    return dict(zip(nodes, x))


def test_pagerank(spark):
    got = {r.node: r["rank"] for r in graph.pagerank(_table(spark, PAIRS)).collect()}
    want = _plain_pagerank(PAIRS)
    assert got.keys() == want.keys() and max(abs(got[u] - want[u]) for u in want) < 1e-9
    assert sum(got.values()) == pytest.approx(1.0)
    assert graph.pagerank(_table(spark, PAIRS).limit(0)).collect() == []


def test_eigenvector(spark):
    pairs = [p for p in _random(4, 25, 70) if max(p) < 25]
    near = _around(pairs)
    nodes = sorted(near)
    m = np.array([[float(v in near[u]) for v in nodes] for u in nodes])
    lead = np.abs(np.linalg.eigh(m)[1][:, -1])
    got = {r.node: r.centrality for r in graph.eigenvector(_table(spark, pairs)).collect()}
    assert max(abs(got[u] - x) for u, x in zip(nodes, lead)) < 1e-8


def _plain_betweenness(near, sources):
    score = dict.fromkeys(near, 0.0)
    for s in sources:
        level, paths = _levels(near, s), dict.fromkeys(near, 0.0)
        paths[s] = 1.0
        order = sorted(level, key=level.get)
        for u in order:
            for v in near[u]:
                if level[v] == level[u] + 1:
                    paths[v] += paths[u]
        share = dict.fromkeys(near, 0.0)
        for w in reversed(order):
            for u in near[w]:
                if level[u] == level[w] - 1:
                    share[u] += paths[u] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    return {u: x / 2 for u, x in score.items()}


@pytest.mark.parametrize("block", [16, 1000])
def test_betweenness(spark, block):
    got = {r.node: r.betweenness for r in graph.betweenness(_table(spark, PAIRS), block=block).collect()}
    want = _plain_betweenness(NEAR, NEAR)
    assert got.keys() == want.keys() and max(abs(got[u] - want[u]) for u in want) < 1e-9
    some = spark.createDataFrame([(0,), (7,), (9,)], "node long")
    got = {r.node: r.betweenness for r in graph.betweenness(_table(spark, PAIRS), some, block).collect()}
    want = _plain_betweenness(NEAR, [u for u in (0, 7, 9) if u in NEAR])
    assert max(abs(got[u] - want[u]) for u in want) < 1e-9


def test_betweenness_has_no_row_for_each_source_and_node(spark, monkeypatch):
    """What is staged grows with nodes and edges, not with sources times nodes; beyond the limit rows give the same."""
    sizes, stage = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df: sizes.append(df.count()) or stage(df))
    some = spark.createDataFrame([(u,) for u in NEAR], "node long")
    got = {r.node: r.betweenness for r in graph.betweenness(_table(spark, PAIRS), some).collect()}
    assert max(sizes) <= sum(map(len, NEAR.values()))
    monkeypatch.setattr(graph, "stage", stage)
    rows = {r.node: r.betweenness for r in graph.betweenness(_table(spark, PAIRS), some, limit=0).collect()}
    want = _plain_betweenness(NEAR, NEAR)
    assert got.keys() == rows.keys() == want.keys() and all(max(abs(x[u] - want[u]) for u in want) < 1e-9 for x in (got, rows))
    assert graph.betweenness(_table(spark, PAIRS).limit(0)).collect() == []


def test_shares_follow_edges_in_pieces(monkeypatch):
    nodes = sorted(NEAR)
    at = {u: i for i, u in enumerate(nodes)}
    start, to = np.cumsum([0] + [len(NEAR[u]) for u in nodes]), np.array([at[v] for u in nodes for v in NEAR[u]])
    want = _plain_betweenness(NEAR, NEAR)
    for most in (1, 7, 1 << 20):
        monkeypatch.setattr(graph, "FOLLOWED", most)
        got = graph._shares(np.arange(len(nodes)), start, to) / 2
        assert max(abs(got[at[u]] - want[u]) for u in nodes) < 1e-9


@pytest.mark.parametrize(("least", "block"), [(1, 4096), (2, 5), (4, 4096)])
def test_overlap_join_equals_all_pairs(spark, least, block):
    rnd = random.Random(5)
    sets = {k: {rnd.choice([0, 0, 1, rnd.randrange(40)]) for _ in range(rnd.randrange(9))} for k in range(120)}
    rows = [(k, i) for k, s in sets.items() for i in s] + [(1, 0), (None, 0), (2, None)]
    sets[1] = sets[1] | {0}
    found = {tuple(r) for r in overlap_join(spark.createDataFrame(rows, "key long, item long"), least, block=block).collect()}
    assert found == {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
    with pytest.raises(ValueError):
        overlap_join(spark.createDataFrame(rows, "key long, item long"), 0)


@pytest.mark.parametrize("most_bits,block", [(1024, 4096), (1024, 9), (1, 4096), (1, 5)])
def test_overlap_join_of_copies_and_common_items(spark, most_bits, block):
    rnd = random.Random(12)
    sets = [set(rnd.sample(range(70), rnd.randrange(30, 50))) for _ in range(40)]
    sets += [sets[0]] * 12 + [sets[1]] * 5  # copies are one class, and all their pairs come out
    rows = [(k, i * 7) for k, s in enumerate(sets) for i in s]
    want = {(a, b, len(sets[a] & sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 25}
    found = [tuple(r) for r in overlap_join(spark.createDataFrame(rows, "key long, item long"), 25, block=block, most_bits=most_bits).collect()]
    assert set(found) == want and len(found) == len(want) > 76


def _staged(monkeypatch) -> list[int]:
    """Rows of every table that a measure stages from now on."""
    rows, stage = [], graph.stage

    def counting(df):
        staged = stage(df)
        rows.append(staged[0].count())
        return staged

    monkeypatch.setattr(graph, "stage", counting)
    return rows


def test_power_iterations_stage_a_table_for_eight_rounds(spark, monkeypatch):
    rows = _staged(monkeypatch)
    graph.pagerank(_table(spark, PAIRS))
    assert len(rows) <= 3 + 25  # about 140 rounds


def test_eigenvector_of_two_like_parts_settles_in_few_rounds(spark, monkeypatch):
    """Rings with chords, one of them denser by an edge, hang together by one edge: plain power iteration takes over 1,000 rounds."""
    part = [(i, (i + k) % 40) for i in range(40) for k in (1, 2, 5)]
    pairs = part + [(100 + u, 100 + v) for u, v in part] + [(0, 20), (0, 100)]
    nodes = sorted({x for p in pairs for x in p})
    near = _around(pairs)
    m = np.array([[float(b in near[a]) for b in nodes] for a in nodes])
    want = np.abs(np.linalg.eigh(m)[1][:, -1])
    rows = _staged(monkeypatch)
    got = {r.node: r.centrality for r in graph.eigenvector(_table(spark, pairs), tolerance=1e-7).collect()}
    assert [got[x] for x in nodes] == pytest.approx(want, abs=1e-5)
    assert len(rows) <= 2 + 32


def test_searches_stage_no_row_for_each_source_and_node(spark, monkeypatch):
    """600 sources, so that bits lie in two parts and all words; a path is reached from all of them."""
    pairs = [(i, i + 1) for i in range(0, 40)] + [(0, i) for i in range(100, 700)]
    near = _around(pairs)
    sources = spark.createDataFrame([(i,) for i in range(100, 700)], "node long")
    rows = _staged(monkeypatch)
    found = graph.distances(_table(spark, pairs), sources, 12)
    assert max(rows) <= 2 * len(near) and max(rows) < 600 * 600
    got = found.groupBy("node", "distance").agg(F.count("*").alias("n")).collect()
    want: dict[tuple[int, int], int] = {}
    for s in range(100, 700):
        for v, k in _levels(near, s).items():
            if k <= 12:
                want[v, k] = want.get((v, k), 0) + 1
    assert {(r.node, r["distance"]): r.n for r in got} == want


def _broadcast(df) -> list[str]:
    """The columns of each file that a broadcast reads first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [part.split("FileScan parquet [", 1)[1].split("]", 1)[0] for part in plan.split("BroadcastExchange")[1:] if "FileScan parquet [" in part]


@pytest.mark.parametrize("most_bits", [1024, 1])
def test_overlap_join_sends_no_sets_to_the_driver(spark, most_bits, monkeypatch):
    """Where sets are bits, neither on the way nor in the result is a table of them or of their keys broadcast; keys may be strings."""
    rnd, plans, stage = random.Random(3), [], overlap.stage

    def seen(df):
        plans.append(df)
        return stage(df)

    monkeypatch.setattr(overlap, "stage", seen)
    sets = {f"k{k}": set(rnd.sample(range(50), rnd.randrange(20, 30))) for k in range(60)}
    sets |= {f"c{k}": sets["k0"] for k in range(50)}  # more copies than rows that they are dealt to
    rows = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "key string, item long")
    found = overlap_join(rows, 15, block=16, most_bits=most_bits)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 15}
    sent = [columns for plan in [*plans, found] for columns in _broadcast(plan)]
    assert most_bits == 1 or not [columns for columns in sent if "keys" in columns or "node" in columns], sent


@pytest.mark.parametrize("limit", [graph.EDGE_LIMIT, 0])
def test_searches_from_sets_of_sources(spark, limit, monkeypatch):
    """Over 64 sources, two parts, nodes without ways between them; small pieces of edges and of unpacked nodes."""
    if limit:
        monkeypatch.setattr(graph, "SPREAD", 3)
    pairs = [(i, i + 1) for i in range(6)] + [(i % 7, i) for i in range(100, 180)] + [(100, 300), (900, 901)]
    near = _around(pairs)
    asked = [*range(100, 180), 900, 12345]
    sources = spark.createDataFrame([(i,) for i in asked], "node long")
    want = {(s, v, k) for s in asked if s in near for v, k in _levels(near, s).items()}
    edges = _table(spark, pairs)
    got = [tuple(r) for r in graph.distances(edges, sources, limit=limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if limit:
        assert {tuple(r) for r in graph.distances(edges, sources, 2).collect()} == {w for w in want if w[2] <= 2}
    ends = {s: [k for a, _, k in want if a == s] for s in asked if s in near}
    found = graph.eccentricities(edges, sources, limit=limit, block=50)
    got = {r.node: (r.eccentricity, r.reached, round(r.closeness, 9)) for r in found.collect()}
    assert got == {s: (max(d), len(d), round((len(d) - 1) ** 2 / sum(d) / (len(near) - 1), 9)) for s, d in ends.items()}
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "bigint", "double"]
    assert graph.distances(edges.limit(0), sources, limit=limit).collect() == graph.eccentricities(edges.limit(0), sources, limit=limit).collect() == []


def test_ends_of_sources_need_no_row_of_a_level(spark, monkeypatch):
    """What is staged for eccentricities are edges, nodes and a row for each source; and they are read twice without a second search."""
    pairs = [(i, i + 1) for i in range(40)] + [(0, i) for i in range(100, 300)]
    rows = _staged(monkeypatch)
    ends = graph.eccentricities(_table(spark, pairs), spark.createDataFrame([(i,) for i in range(100, 300)], "node long"))
    assert len(rows) <= 6 and sum(rows) <= 2 * len(pairs) + 3 * len(_around(pairs)) + 3 * 200
    plan = graph.extent(ends)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
