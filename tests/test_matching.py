"""Fuzzy joins, nearest neighbours by pivots and candidates for every slider, against plain versions."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateforge.functions import fuzzy
from crateforge.operators import editjoin, knn, pivots, skyband
from crateforge.plans import pipelines


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _strings(rnd: random.Random, n: int, longest: int) -> list[str]:
    out = ["".join(rnd.choice("abcé日") for _ in range(rnd.randrange(longest))) for _ in range(n)]
    for s in rnd.sample(out, n // 3):  # near copies: a few edits at any place
        t = list(s)
        for _ in range(rnd.randrange(1, 4)):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randrange(2)] = rnd.choice(["", "x", "b"])
        out.append("".join(t))
    return out


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_edit_join_equals_all_pairs(spark, edits):
    names = _strings(random.Random(edits), 150, 22) + ["", "a", None, "shared prefix 1", "shared prefix 2", "shared prefix 12345"]
    rows = spark.createDataFrame([(n, 1) for n in names + names[:20]], "name string, other int")
    distinct = sorted({n for n in names if n is not None})
    want = {(a, b, _edits(a, b)) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if _edits(a, b) <= edits}
    assert {tuple(r) for r in editjoin.edit_join(rows.select("name"), edits).collect()} == want
    assert len(want) > 20
    assert {tuple(r) for r in editjoin.edit_join(rows.select("name"), edits, block=7).collect()} == want  # long lists in blocks


def test_edit_join_compares_candidates_only(spark):
    rnd = random.Random(1)
    names = list({"".join(rnd.choice("abcdefghijklmnop") for _ in range(18)) for _ in range(600)})
    names += [n[:9] + "zz" + n[9:] for n in names[:40]]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    met = editjoin.candidates(rows, 2).count()
    assert 40 <= met < len(names) ** 2 / 2 / 100
    assert editjoin.edit_join(rows, 2).where("distance <= 2").count() == 40
    assert editjoin.edit_join(rows.limit(0), 2).collect() == editjoin.edit_join(rows, 0).collect() == []


def test_one_edit_compares_few_pairs_of_common_halves(spark):
    """Words made of few halves: by halves all pairs of a half meet, by deletions only what is two edits apart at most."""
    rnd = random.Random(2)
    halves = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(60)]
    names = sorted({a + b for a in halves for b in halves[:30]} | {"abcdabcd", "abcdabc", "abcdabcx", "xabcdabcd"})
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    listed = editjoin.deletions(rows)
    met = listed.join(listed.withColumnRenamed("name", "other"), "part").where("name < other").select("name", "other").distinct()
    assert met.where(F.levenshtein("name", "other") > 2).isEmpty() and met.count() * 20 < editjoin.candidates(rows, 1).count()
    want = {(a, b) for a in ("abcdabcd", "abcdabc", "abcdabcx", "xabcdabcd") for b in names if a != b and _edits(a, b) == 1}
    got = {(r["first"], r["second"]) for r in editjoin.edit_join(rows, 1).collect()}
    assert {p for p in got if {"abcdabcd", "abcdabc", "abcdabcx", "xabcdabcd"} & {*p}} == {(min(p), max(p)) for p in want}


def _plain_matches(words, names, n, cutoff):
    out = {}
    for w in {w for w in words if w is not None}:
        scored = [(-difflib.SequenceMatcher(None, x.lower(), w.lower()).ratio(), x) for x in {x for x in names if x is not None}]
        out[w] = [(x, -r) for r, x in sorted(scored) if -r >= cutoff][:n]
    return {w: m for w, m in out.items() if m}


@pytest.mark.parametrize("cutoff", [0.3, 0.6, 0.85, 1.0])
def test_close_matches_equal_all_pairs(spark, cutoff):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdef ghÉ") for _ in range(rnd.randrange(1, 14))) for _ in range(60)] + ["", None, "Radiohead", "𝔘nicode"]
    names = ["".join(rnd.choice("abcdef ghé") for _ in range(rnd.randrange(1, 14))) for _ in range(80)] + ["", None, "RADIOHEAD", "radio head", "𝔘nicode", *words[:20]]
    w, n = spark.createDataFrame([(x,) for x in words], "word string"), spark.createDataFrame([(x,) for x in names], "name string")
    found = {}
    for r in fuzzy.close_matches(w, n, n=4, cutoff=cutoff).orderBy("word", "rank").collect():
        found.setdefault(r.word, []).append((r.name, r.ratio))
    assert found == _plain_matches(words, names, 4, cutoff)


def test_close_matches_ask_for_few_ratios(spark):
    rnd = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = list({"".join(rnd.choice(letters) for _ in range(12)) for _ in range(300)})
    w, n = spark.createDataFrame([(x,) for x in names[:150]], "word string"), spark.createDataFrame([(x,) for x in names], "name string")
    survivors = fuzzy._pairs(w, n, "word", "name", 0.6).count()
    assert 150 <= survivors < 150 * len(names) / 4


def test_ratio_cutoffs_are_checked(spark):
    rows = spark.createDataFrame([("a", "b")], "word string, name string")
    with pytest.raises(ValueError):
        fuzzy.close_matches(rows, rows, cutoff=0.0)


def _vectors(spark, n: int, width: int = 20, hot: float = 0.4, seed: int = 3):
    """Clusters, one of which holds ``hot`` of all rows; a few vectors are equal."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, width)) * 4
    which = np.where(rng.random(n) < hot, 0, rng.integers(0, 8, n))
    x = np.round(centres[which] + rng.standard_normal((n, width)) * 0.6, 3)
    x[n // 2 : n // 2 + 12] = x[0]
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, distance int").repartition(6)


@pytest.mark.parametrize("ring,visitors", [(1024, 4096), (40, 25), (3, 1000)])
def test_pivots_equal_blocks(spark, ring, visitors):
    odd = spark.createDataFrame([(None, [1.0] * 20, 1), (5001, None, 1), (5002, [1.0, None], 1), (5003, [1.0], 1)], "vec_id long, embedding array<double>, distance int")
    v = _vectors(spark, 500).unionByName(odd)
    for slider in (1.0, 0.5):
        want = {tuple(r) for r in knn.knn_block(v, 5, slider=slider).collect()}
        assert {tuple(r) for r in pivots.knn_pivot(v, 5, slider=slider, ring=ring, visitors=visitors).collect()} == want


def test_pivots_compare_fewer_pairs(spark):
    v = _vectors(spark, 2000)
    index = pivots.PivotIndex(v, ring=64)
    found, visits = index.neighbours(5)
    sizes = index.rings.collect()
    assert max(r["size"] for r in sizes) <= 64 and sum(r["size"] for r in sizes) == 2000
    compared = sum(r["size"] ** 2 for r in sizes) + visits.join(index.rings, ["cell", "ring"]).agg(F.sum("size")).first()[0]
    assert compared < 2000**2 / 2
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in knn.knn_block(v, 5).collect()}


def test_pivots_for_some_queries_and_small_tables(spark):
    v = _vectors(spark, 300)
    some = v.where("vec_id % 20 = 0")
    want = {tuple(r) for r in knn.knn_block(v, 5, queries=some).collect()}
    assert {tuple(r) for r in pivots.knn_pivot(v, 5, queries=some, ring=16).collect()} == want
    few = v.where("vec_id < 4")
    assert {tuple(r) for r in pivots.knn_pivot(few, 5).collect()} == {tuple(r) for r in knn.knn_block(few, 5).collect()}
    assert pivots.knn_pivot(v.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_every_slider_from_one_table(spark, limit):
    v = _vectors(spark, 250, width=24)
    kept = skyband.skyband(v, 5, audio=10, limit=limit, block=60).cache()
    assert kept.count() < 250 * 249 / 3
    for slider in (0.0, 0.3, 0.5, 0.9, 1.0, 2.0, 7.5):
        got = {(r.query_id, r["rank"]): (r.neighbour_id, round(r.distance, 6)) for r in skyband.at_slider(kept, slider).collect()}
        for r in knn.knn_block(v, 5, slider=slider, audio=10).collect():
            near, far = got[r.query_id, r["rank"]]
            assert far == pytest.approx(r.distance, rel=1e-9, abs=1e-6)
            assert near == r.neighbour_id or slider == 0.0, (slider, r)  # at slider 0 a mood distance of 0 leaves rounding alone
        assert len(got) == 250 * 5


def test_skyband_by_its_definition():
    rng = np.random.default_rng(2)
    for k in (1, 3):
        for trial in range(60):
            n = int(rng.integers(1, 60)) if trial else 500
            a, m, ids = rng.integers(0, 8, n) / 2, rng.integers(0, 8, n) / 2, rng.permutation(n)
            less = lambda i, j: a[i] <= a[j] and m[i] <= m[j] and ((a[i], m[i]) != (a[j], m[j]) or ids[i] < ids[j])
            want = {j for j in range(n) if sum(less(i, j) for i in range(n) if i != j) < k}
            assert set(skyband.band(ids, a, m, k).tolist()) == want


def test_skyband_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert skyband.skyband(empty).collect() == []
    one = spark.createDataFrame([(1, [1.0] * 20)], empty.schema)
    assert skyband.skyband(one).collect() == [] and skyband.skyband(one, limit=0).collect() == []


def _plain_nearest(ids, x, k):
    out = set()
    for i, q in zip(ids, x):
        with np.errstate(all="ignore"):
            d = np.sqrt(np.add.accumulate(np.square(q - x), axis=1)[:, -1])
        d[ids == i] = np.inf
        out |= {(i, ids[j], d[j]) for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])}
    return out


@pytest.mark.parametrize("size,shift", [(1.0, 0.0), (1e-3, 100.0), (0.0, 5.0), (1e150, 0.0)])
def test_nearest_are_exact_and_few_pairs_are_measured(monkeypatch, size, shift):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((900, 16)) * size + shift
    x[7], x[8, 2], x[20:40] = np.nan, np.inf, x[20]  # no distance at all; copies, whose ties go to the smaller id
    ids, measured, direct = rng.permutation(900).astype(np.int64), [], knn._direct
    monkeypatch.setattr(knn, "_direct", lambda a, b: measured.append(len(a)) or direct(a, b))
    found = knn._nearest(ids, x, knn.Base(ids, x), 5, chunk=128)
    assert set(zip(*(f.tolist() for f in found))) == _plain_nearest(ids, x, 5)
    if size == 1.0:
        assert sum(measured) < 900 * 900 / 10


def test_blocks_do_not_grow_in_number_with_the_table():
    assert knn.sides(500, 256) == 2 and knn.sides(0, 256) == 1
    assert knn.sides(10**5, 256) == knn.sides(10**6, 256) == knn.SIDES
    assert 10**7 / knn.sides(10**7, 256) <= knn.WIDEST


@pytest.mark.parametrize("steps", [3, 0])
def test_bounds_leave_the_skyband_whole_and_few_pairs_measured(steps, monkeypatch):
    """With ``steps`` the components are whole numbers, so that many distances tie."""
    rng = np.random.default_rng(1)
    ids, x = rng.permutation(3000), rng.integers(0, steps, (3000, 20)).astype(float) if steps else rng.normal(size=(3000, 20))
    measured, direct = [], skyband._direct
    monkeypatch.setattr(skyband, "_direct", lambda a, b: measured.append(len(a)) or direct(a, b))
    base = knn.Base(ids, x, (slice(0, 8), slice(8, None)))
    got = skyband._bands(ids[:200], x[:200], base, 5, 8, chunk=1000)
    want = skyband._direct_bands(ids[:200], x[:200], ids, x, 5, 8)
    rows = lambda found: sorted(zip(*found.to_pydict().values()))
    assert rows(got) == rows(want)
    assert sum(measured) < (2 * 200 * 3000 if steps else 200 * 3000 // 2)


@pytest.mark.parametrize("odd", [False, True])
def test_a_base_that_passes_by_leaves_each_query_its_skyband_alone(spark, odd, monkeypatch):
    """Beyond the limit, too, a query's rows are its skyband, not those of each block of the base; with a vector that is not finite all pairs are measured."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 12))
    if odd:
        x[7, 3] = np.inf
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    with np.errstate(all="ignore"):
        want = skyband._direct_bands(np.arange(400), x, np.arange(400), x, 3, 5).to_pydict()
    found = skyband.skyband(v, 3, audio=5, limit=0, block=50)
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r) for r in found.collect()) == key(zip(*want.values()))
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()


def test_candidates_that_wait_are_bounded(monkeypatch):
    rng = np.random.default_rng(7)
    ids, x, waiting, merge = np.arange(3000), rng.normal(size=(3000, 10)), [], skyband._Search._merge
    monkeypatch.setattr(skyband._Search, "_merge", lambda self: (waiting.append(sum(len(c[0]) for c in self.new)), merge(self))[1])
    for base in (skyband._base(ids, x, 4), None):
        search = skyband._Search(ids[:40], x[:40], 3, 4)
        search.meet(ids, x, base, 100)
        got, want = search.result().to_pydict(), skyband._direct_bands(ids[:40], x[:40], ids, x, 3, 4).to_pydict()
        assert sorted(zip(*got.values())) == sorted(zip(*want.values()))
    assert max(waiting) <= 40 * (skyband.WAITING + skyband.LEAST + 100)


def test_word_variants_take_words_of_any_length(spark, tmp_path):
    """Short words are words: one of seven letters and one of eight are a pair, and so are two of two."""
    texts = ["Spellin spelling, colour color", "a an on; straße strasse", None, "ünder under 12345678"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = sorted({"spellin", "spelling", "colour", "color", "a", "an", "on", "straße", "strasse", "ünder", "under"})
    want = {(a, b, 1) for i, a in enumerate(words) for b in words[i + 1 :] if _edits(a, b) == 1}
    assert {tuple(r) for r in pipelines.word_variants(spark, str(tmp_path)).collect()} == want >= {("spellin", "spelling", 1), ("an", "on", 1), ("a", "an", 1)}
