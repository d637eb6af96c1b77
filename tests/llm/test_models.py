"""PPM, packing, embeddings, language, toxicity, quality and the pipeline: brute force, round trips, held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crateforge.llm import embeddings, langid, packing, ppm, quality, secrets, similar, toxicity
from crateforge.llm.common import read
from crateforge.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"
ODD = [(900001, None, "en"), (900002, "", None), (900003, " \n ", "en"), (900004, "Ü \U0001f600 1,2 don't <|endoftext|>", None), (900005, "ab " * 40_000, "fr"), (900005, "ab " * 40_000, "fr"), (None, "a b c d", "en")]


def rows(spark, where=SF):
    docs = read(spark, where, "documents").select("doc_id", "text", "lang")
    return docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string")).withColumns({c: F.lit(c) for c in ("row", "word", "block", "score", "node", "digest", "label", "id")})


def crc(doc, m):
    return zlib.crc32(str(doc).encode()) % m if doc is not None else 0


# -- PPM ---------------------------------------------------------------------------------------------------------


def plain_ppm(train, text, order):
    """Escape C with exclusion over dictionaries, no pruning."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    pad = bytes([ppm.PAD]) * order
    for t in train:
        s = pad + t + bytes([ppm.END])
        for i in range(order, len(s)):
            for j in range(order + 1):
                counts[j][s[i - j : i]][s[i]] += 1
    s, total = pad + text + bytes([ppm.END]), 0.0
    for i in range(order, len(s)):
        gone = set()
        for j in range(order, -1, -1):
            seen = {k: n for k, n in counts[j].get(s[i - j : i], {}).items() if k not in gone}
            if not seen:
                continue
            n = sum(seen.values())
            if s[i] in seen:
                total += math.log10(seen[s[i]] / (n + len(seen)))
                break
            total += math.log10(len(seen) / (n + len(seen)))
            gone |= set(seen)
        else:
            total -= math.log10(max(1, 256 - len(counts[0][b""])))
    return total


@pytest.mark.parametrize("order", [1, 3, 5])
def test_ppm_equals_plain_version(spark, order):
    """Blocks and buckets of few bytes, training and held-out rows, against one trie of dictionaries."""
    draw = np.random.default_rng(order)
    texts = ["abracadabra abra", "the cat sat on the mat", "the bat", "", None, "Ünï the", "zzz the q", "ünz", *("".join(draw.choice(list("abc é"), 30)) for _ in range(40))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    raw = [(t or "").encode().translate(ppm.LOWER) for t in texts]
    train = [t for i, t in enumerate(raw) if crc(i, 7) != 2]
    got = {r.doc_id: r.score for r in ppm.score(df, order=order, block_bytes=200, bucket_bytes=100).collect()}
    assert 0 < len(train) < len(raw) and np.allclose([got[i] for i in range(len(raw))], [plain_ppm(train, t, order) for t in raw], atol=1e-4)


def test_ppm_probabilities_sum_to_one():
    raw = [b"abracadabra abra", b"the cat sat on the mat", b"the bat", b""]
    model = ppm.Model(ppm.orders(*ppm._counted(raw, [False] * len(raw), 3), range(4)))
    for ctx in (b"abr", b"xyz", b"the"):
        key = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)], np.uint64)
        assert abs((10 ** model.logs(key).astype(float)).sum() - 1) < 1e-4


def test_ppm_base_and_gain(spark):
    docs = rows(spark)
    got = ppm.score(docs).collect()
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(data)
    tokens = [[*(t or "").encode().translate(ppm.LOWER).split(), None] for _, t in data]
    seen = Counter(w for (d, _), t in zip(data, tokens) if crc(d, 7) != 2 for w in t)
    n, v = sum(seen.values()), len(seen)
    want = sorted((d or -1, crc(d, 7) == 2, len(t), sum(seen[w] > 0 for w in t), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in t), 4)) for (d, _), t in zip(data, tokens))
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert ppm.score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("entries", [30, 100])
def test_hot_contexts_are_dealt_by_more_bytes(spark, entries):
    """One context dominates; at either bound, and at two depths, scores stay what they are, and no bucket but one of whole contexts is larger."""
    draw = np.random.default_rng(5)
    words = ["the end", "then", "thence", "other", "\x00\x00\x00\x00 nul", "日本", "entend", "content"]
    texts = [" ".join(draw.choice(words, 40)) + " the " + "".join(map(chr, draw.integers(97, 123, 60))) for _ in range(120)] + [None, "", "the " * 500]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    want = {r.doc_id: tuple(r) for r in ppm.score(docs, block_bytes=2000).collect()}
    got = {r.doc_id: tuple(r) for r in ppm.score(docs, block_bytes=2000, bucket_entries=entries).collect()}
    assert got.keys() == want.keys() and all(got[i][:-1] == want[i][:-1] and abs(got[i][-1] - want[i][-1]) < 1e-4 for i in want)
    plain = docs.withColumn("held_out", F.lit(False))
    asked = plain.select("doc_id", "text", "held_out").mapInArrow(ppm._ask(5, 4, 2000), ppm.BLOCKS_SQL).cache()
    before = asked.where("kind = 'gram'").groupBy("bucket").agg(F.sum("entries").alias("n")).agg(F.max("n")).first()[0]
    questions, routes = ppm.dealt_anew(asked, 5, 4, entries)
    assert 3 in routes.hot and (entries == 100 or 4 in routes.hot)
    after = questions.where("kind = 'gram'").groupBy("bucket").agg(F.sum("entries").alias("n"), F.count("*").alias("blocks"))
    whole = after.where("bucket >= (1L << 61)")
    assert whole.agg(F.max(F.col("n") / F.col("blocks"))).first()[0] <= 256
    assert questions.where("kind = 'gram'").agg(F.sum("entries")).first() == asked.where("kind = 'gram'").agg(F.sum("entries")).first()
    assert after.agg(F.max("n")).first()[0] < before


def test_ppm_gains_on_the_base(spark):
    held = ppm.score(read(spark, LARGE, "documents")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


# -- packing -----------------------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = rows(spark)
    cut = packing.pieces(docs, tokenizer_path(), keep_ids=True)
    packed = packing.pack(cut, part_rows=60, least_rows=1).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    whole = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in texts}
    assert sum(r.length for r in packed) == sum(len(whole[d]) for d, _ in texts)
    bins = defaultdict(list)
    for r in packed:
        ids = whole[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and r.length == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    least = packing.lower_bound(np.array([r.length for r in packed]), 4096)
    assert least <= len(bins) <= least + 1
    assert {(r.n_sequences, r.n_bound) for r in packed} == {(len(bins), least)}
    assert packing.pack(packing.pieces(docs.limit(0), tokenizer_path())).count() == 0


def test_exchanges_close_the_gap(spark):
    """Dealt into many partitions, the exchange between them comes to the bound of all pieces; without it sequences are wasted."""
    cut = packing.pieces(read(spark, MID, "documents"), tokenizer_path())
    counts = {rounds: packing.pack(cut, part_rows=150, rounds=rounds).agg(F.max("n_sequences"), F.max("n_bound"), F.count_distinct("sequence_id")).first() for rounds in (0, 4)}
    assert counts[0][0] >= counts[4][0] + 2
    assert counts[4][0] <= counts[4][1] + 1 and all(c[0] == c[2] for c in counts.values())


def test_bounds_certify():
    draw = np.random.default_rng(1)
    for _ in range(50):
        sizes = draw.integers(1, 101, draw.integers(1, 60))
        bins, offsets, fill = packing.best_fit(sizes, 100)
        assert fill.max() <= 100 and packing.lower_bound(sizes, 100) <= len(fill)
        assert np.array_equal(np.bincount(bins, sizes), fill)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3


# -- embeddings --------------------------------------------------------------------------------------------------


def plain_links(data):
    n = len(data)
    linked = np.zeros((n, n), bool)
    for i, (_, a, la) in enumerate(data):
        for j, (_, b, lb) in enumerate(data):
            if i != j and la is not None and la == lb and a and b and len(a) == len(b) and None not in a and None not in b:
                x, y = np.array(a, float), np.array(b, float)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any():
                    linked[i, j] = x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98
    least = np.array([d[0] for d in data])
    while True:
        new = np.array([min([least[i], *least[linked[i]]]) for i in range(n)])
        if (new == least).all():
            return {(d[0], int(linked[i].sum()), int(least[i])) for i, d in enumerate(data)}
        least = new


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "deal": 40, "window": 8}])
def test_embeddings(spark, sizes):
    vectors = read(spark, SF, "embeddings")
    odd = [(9001, None, 1), (9002, [0.0] * 64, 1), (9003, [1.0, None], 2), (9004, [float("nan")] * 64, 3), (9005, [1.0] * 64, None), (9006, [2.0] * 64, 4), (9007, [1.0] * 64, 4), (9008, [1.0] * 3, 4), (9009, [1.0] * 64, 4)]
    base = spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int")
    tight = spark.createDataFrame([(9100 + i, (np.ones(64) + np.random.default_rng(i).normal(0, 0.08, 64)).tolist(), 7) for i in range(30)], "vec_id long, embedding array<float>, label int")
    every = vectors.unionByName(base).unionByName(tight).withColumn("node", F.lit(1)).withColumn("root", F.lit("x"))
    got = embeddings.near_duplicates(every, **sizes).collect()
    want = plain_links([(r.vec_id, r.embedding, r.label) for r in every.collect()])
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_duplicates(every.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "spread", "far"), [(3000, 0.33, 0.17), (20000, 0.33, 0.18), (20000, 1.0, 0.195)])
def test_recall_of_embedding_links(spark, n, spread, far):
    """Lone pairs just above the threshold in one hot label, whose vectors are dense (mutual cosine about 0.9) or not."""
    draw = np.random.default_rng(9)
    x = np.array([spread < 1, *[0.0] * 63]) + draw.normal(0, spread / 8, (n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate((x, x[:200] + draw.normal(0, far / 8, (200, 64))))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for k in range(0, len(x), 1000) for i, j in zip(*np.nonzero(unit[k : k + 1000] @ unit.T >= 0.98)) for i in [i + k] if i < j}
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    same = sum(got[i].component_id == got[j].component_id for i, j in want)
    assert len(want) >= 80 and same >= 0.95 * len(want) and 0.95 * 2 * len(want) <= sum(r.n_links for r in got.values()) <= 2 * len(want)


@pytest.mark.parametrize(("n", "pairs", "seeds"), [(50_000, 1, (1, 2)), (50_000, 3, (4, 5)), (50_000, 200, (6,)), (120_000, 3, (7,))])
def test_lone_pairs_of_a_dense_label_are_found(spark, tmp_path, n, pairs, seeds):
    """Pairs at cosine 0.981 in one label of vectors whose mutual cosine is about 0.9: few of them must not be lost more than many."""
    found = 0
    for seed in seeds:
        draw = np.random.default_rng(seed)
        x = np.zeros((n, 64), np.float32)
        x[:, 0] = 1
        x += draw.normal(0, 0.33 / 8, x.shape).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x = np.concatenate((x, embeddings.turned(x[:pairs].astype(float), draw.standard_normal((pairs, 64)), 0.981).astype(np.float32)))
        path = str(tmp_path / f"v{seed}.parquet")
        table = pa.table([pa.array(np.arange(len(x))), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32())), pa.array(np.ones(len(x), np.int32))], names=["vec_id", "embedding", "label"])
        pq.write_table(table, path, row_group_size=10_000)
        got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(spark.read.parquet(path)).where("n_links > 0").collect()}
        found += sum(got.get(i, -1) == got.get(n + i, -2) for i in range(pairs))
    assert found >= 0.95 * pairs * len(seeds)


def test_embeddings_of_any_scale_and_rings_of_large_groups(spark):
    """Components whose squares overflow or underflow link like others; large groups are counted in rings, tight ones without comparisons."""
    draw = np.random.default_rng(4)
    base = draw.standard_normal((1, 8))
    chain = [(float(np.cos(a)), float(np.sin(a))) for a in np.arange(0, 3, 0.01)]  # one group, of which only near angles link
    rows = [(i, (v * 10.0 ** (200 if i % 2 else -200)).tolist(), 1) for i, v in enumerate(base + draw.normal(0, 0.05, (20, 8)))]
    rows += [(100 + i, list(c), 2) for i, c in enumerate(chain)] + [(1000 + i, (base[0] + draw.normal(0, 0.01, 8)).tolist(), 3) for i in range(90)]
    rows += [(None, [1.0, 0.0, 0.0], 4), (2000, [1.0, 0.0, 0.0], 4), (2001, [1.0, 1e-3, 0.0], 4)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).collect()

    def unit(v):
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    for label in (1, 2, 3, 4):
        own = [(i, unit(v)) for i, v, k in rows if k == label]
        links = (np.array([u for _, u in own]) @ np.array([u for _, u in own]).T >= 0.98).sum(axis=1) - 1
        ids = {i for i, _ in own}
        assert sorted((str(r.vec_id), r.n_links) for r in got if r.vec_id in ids) == sorted((str(i), int(k)) for (i, _), k in zip(own, links))
    assert {r.component_id for r in got if r.vec_id in (None, 2000, 2001)} == {2000}


# -- classifiers -------------------------------------------------------------------------------------------------


def test_gradients_of_the_recurrent_network():
    net = langid.Network(["a", "b"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data, y = np.array([[97, 98], [99, 97], [98, 98]], np.uint8), np.array([0, 1])
    loss = lambda: -np.log(net.probabilities(net.states(data)[0].astype(np.float64))[:, [0, 1], y]).mean()
    grad = net.gradients(data, y)
    for name, at in (("rec", (0, 0, 1, 2)), ("rec", (1, 1, 0, 0)), ("rec", (2, 0, 2, 1)), ("tab", (0, 0, 98, 1)), ("tab", (1, 1, 98, 0)), ("tab", (2, 1, 97, 2)), ("head", (1, 1))):
        old, step = net.w[name][at], 1e-2
        net.w[name][at] = old + step
        up = loss()
        net.w[name][at] = old - step
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-4, (name, at)


def test_forward_pass_equals_plain_version():
    """Gate by gate, position by position; logistic gates of twice the stored input."""
    net, text = langid.Network(["a", "b", "c"], hidden=3, seed=4), b"Sch\xc3\xb6n, oui"
    logistic = lambda z: 1 / (1 + math.exp(-z))
    states = []
    for d, order in ((0, range(len(text))), (1, range(len(text) - 1, -1, -1))):
        h, seen = [0.0] * 3, {}
        for t in order:
            pre = lambda k, v: [float(net.w["tab"][k, d, text[t], i]) + sum(v[j] * float(net.w["rec"][k, d, j, i]) for j in range(3)) for i in range(3)]
            reset, update = ([logistic(2 * z) for z in pre(k, h)] for k in (0, 1))
            fresh = [math.tanh(z) for z in pre(2, [r * x for r, x in zip(reset, h)])]
            h = [u * x + (1 - u) * c for u, x, c in zip(update, h, fresh)]
            seen[t] = h
        states.append(seen)
    shares = []
    for t in range(len(text)):
        z = [sum(x * float(net.w["head"][i, k]) for i, x in enumerate(states[0][t] + states[1][t])) + float(net.w["bias"][k]) for k in range(3)]
        shares.append([math.exp(x) / sum(map(math.exp, z)) for x in z])
    p, votes = net.score([text, b""], steps=len(text))
    assert np.allclose(p[0], np.mean(shares, axis=0), atol=1e-5) and votes[0].sum() == len(text) and not p[1].any()


def test_texts_without_a_letter():
    assert not any(map(langid.has_letter, ("", "12 _ ½ ² Ⅷ ① ٣", "\U0001f600"))) and all(map(langid.has_letter, ("½a", "ª", "日", "²é")))


def test_language(spark):
    docs = rows(spark, MID)
    got = langid.identify(docs).collect()
    langs = {r.doc_id: r.lang for r in read(spark, MID, "documents").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out and r.doc_id in langs]
    assert len(got) == docs.count() and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.lang_pred for r in got if r.doc_id in (900001, 900002, 900003)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string")).limit(3)).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def auc(pairs):
    yes, no = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + (a == b) / 2 for a in yes for b in no])


@pytest.mark.parametrize(("module", "column", "cut"), [(toxicity.toxicity, "toxic", 0.5), (quality.quality, "quality", 0.3)])
def test_classifiers(spark, module, column, cut):
    docs, labels = rows(spark, LARGE), read(spark, LARGE, "labels")
    odd = spark.createDataFrame([(900001, 1, 1), (900005, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = module(docs, labels.unionByName(odd).withColumn("text", F.lit("x"))).collect()
    truth = {r.doc_id: r[column] for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == docs.count() and auc(held) >= 0.9, auc(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
    assert module(docs, labels.limit(0)).count() == docs.count() and module(docs.limit(0), labels).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    """Planted voters: accuracies known, two that copy each other; no labels are given."""
    draw = np.random.default_rng(7)
    y = draw.random(6000) < 0.25
    accuracy = [0.95, 0.9, 0.85, 0.9, 0.8]
    v = np.stack([np.where(draw.random(len(y)) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in accuracy], axis=1)
    v = np.hstack([v, np.where(draw.random((len(y), 1)) < 0.95, v[:, 4:5], -v[:, 4:5])])  # the sixth follows the fifth
    model = toxicity.LabelModel().fit(v)
    assert np.abs(model.accuracy[:5] - accuracy).max() < 0.1 and abs(model.prior - 0.25) < 0.1
    assert model.parent[5] == 4 or model.parent[4] == 5
    assert ((model.posterior(v) >= 0.5) == y).mean() > 0.92


def test_posterior_equals_plain_tree():
    draw = np.random.default_rng(2)
    v = draw.integers(-1, 2, (200, 4))
    model = toxicity.LabelModel().fit(v, rounds=7)
    for row, got in zip(v[:20], model.posterior(v[:20])):
        odds = [1 - model.prior, model.prior]
        for c in (0, 1):
            for j, p in enumerate(model.parent):
                odds[c] *= model.table[c][j][row[p] + 1 if p >= 0 else 0][row[j] + 1]
        assert abs(odds[1] / sum(odds) - got) < 1e-9


def test_families_and_conflicting_labels(spark):
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, "quite another text"), (6, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 0), (4, 0), (6, None)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "toxic", 10**6, 100)
    assert {(r.text, r.toxic) for r in sample.collect()} == {(text, 1), (text + " more", 0), ("quite another text", 0)}
    assert sorted(r.toxic for r in toxicity.one_of_each_family(sample).collect()) == [0, 1]


def test_positive_unlabelled_risk():
    """Moments give the plain risk; steps go down, and back while the second part is under zero."""
    draw = np.random.default_rng(4)
    p, u = draw.normal(1, 1, (40, 3)), np.concatenate([draw.normal(1, 1, (60, 3)), draw.normal(-1, 1, (60, 3))])
    w = draw.normal(0, 0.3, 4)
    z = lambda x: 1 * w[0] + x @ w[1:]
    got = quality.risk(w, quality.Moments.of(p), quality.Moments.of(u), 0.4)
    want = 0.4 * ((1 - z(p)) ** 2 / 4).mean(), ((1 + z(u)) ** 2 / 4).mean() - 0.4 * ((1 + z(p)) ** 2 / 4).mean()
    assert np.allclose(got, want)
    for prior in (0.5, 0.95):  # the second prior is far too high: the second part falls under zero without the way back
        a, b = quality.Moments.of(p), quality.Moments.of(u)
        unbiased = np.linalg.solve(b.outer / 2 + 1e-4 * np.eye(4), prior * a.mean - b.mean / 2)
        found = quality.descend(a, b, prior)
        total = lambda x: quality.risk(x, a, b, prior)[0] + max(0, quality.risk(x, a, b, prior)[1])
        near = [total(found + s * e) for s in (-0.02, 0.02) for e in np.eye(4)]
        assert total(found) <= total(unbiased) + 1e-9 and total(found) <= min(near) + 2e-3
    assert quality.risk(unbiased, a, b, 0.95)[1] < 0


def test_estimated_prior():
    draw = np.random.default_rng(6)
    for share in (0.2, 0.6):
        n = 20_000
        mixed = np.where(draw.random(n) < share, draw.normal(1, 1, n), draw.normal(-1.5, 1, n))
        bins = lambda x: quality._bins(1 / (1 + np.exp(-x)))
        got = quality.estimate_prior(quality.share_above(bins(draw.normal(1, 1, 5000)), np.ones(5000)), 5000, quality.share_above(bins(mixed), np.ones(n)), n)
        assert abs(got - share) < 0.07, (share, got)


# -- similarity and pipeline -------------------------------------------------------------------------------------


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similarity_dedup(spark):
    docs = rows(spark, MID)
    data = docs.collect()
    sets = {r.text or "": set(similar.shingles((r.text or "").encode(), 5).tolist()) for r in data}
    texts = list(sets)
    index = defaultdict(set)
    for i, t in enumerate(texts):
        for s in sets[t]:
            index[s].add(i)
    pairs = {(min(i, j), max(i, j)) for i, t in enumerate(texts) for s in list(sets[t]) for j in (index[s] if len(index[s]) < 200 else ()) if i != j}
    root = list(range(len(texts)))
    for _ in range(20):
        for i, j in pairs:
            if jaccard(sets[texts[i]], sets[texts[j]]) >= 0.8:
                root[i] = root[j] = min(root[i], root[j])
    group = {t: root[i] for i, t in enumerate(texts)}
    kept = similar.dedup(docs).collect()
    assert len(kept) == len(set(root)) and {group[r.text or ""] for r in kept} == set(root)
    assert kept[0].asDict().keys() == set(docs.columns) and similar.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [{}, {"list_block": 50, "block": 16}])
def test_similarity_finds_lone_pairs_among_texts_of_one_template(spark, blocks):
    draw = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in draw.integers(0, 10**9, n)]
    template, texts = words(150), []
    for k in range(300):
        own = words(25)
        texts.append(" ".join(template + own))
        if k % 10 == 0:
            texts.append(" ".join(template + own[:-18] + words(18)))
    sets = [set(similar.shingles(t.encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                root = [root[i] if r == root[j] else r for r in root] if root[i] != root[j] else root
    want = {frozenset(t for t, r in zip(texts, root) if r == k) for k in set(root)}
    assert len(want) == 300 and 0.7 < jaccard(sets[1], sets[-1]) < 0.8
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found, of = defaultdict(set), {__import__("hashlib").md5(t.encode()).hexdigest(): t for t in texts}
    for r in similar.groups(docs, **blocks).collect():
        found[r.root].add(of[r.digest])
    assert {frozenset(g) for g in found.values()} == want


def test_pipeline(spark):
    import corpus_pipeline as cp

    got = cp.run(spark, SF).collect()
    docs = read(spark, SF, "documents")
    hidden = (900006, "my password=hunter2hunter and AKIA" + "Q7" * 8, None)
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in [*ODD, hidden]], docs.schema).withColumn("row", F.lit(1)).withColumn("found", F.lit("x"))
    seen = docs.withColumn("row", F.lit(2)).withColumn("found", F.lit("y")).unionByName(odd)
    for name, step in cp.STAGES[:-1]:
        out = step(spark, seen, SF)
        assert out.columns == seen.columns and 0 < out.count() <= seen.count(), name
        assert step(spark, seen.limit(0), SF).count() == 0
        if name == "secret_scan":
            texts = [r.text for r in out.collect()]
            assert not any(secrets.base_spans(t or "") for t in texts) and any(cp.SECRET_MARK in (t or "") for t in texts)
            assert len(texts) == seen.count() and sum(t is None for t in texts) == 1
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}
