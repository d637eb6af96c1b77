"""op11, op12 and op13 against the library, DuckDB's SQL and plain versions."""

import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from crateforge.llm import divergence, runs, tokencount
from crateforge.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "日", "本", "🎉", "▁", "x" * 50, "ab" * 150, "==", "<s>", "</s>", "\x00", "　", "Ⅳ", "23", " " * 300, "\n" * 40, "ing", "\r\n", "ÿ", "߿", "ࠀ", "�", "\U0010ffff"]


def _odd(rnd: random.Random, n: int) -> list[str]:
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) for _ in range(n)]


def _library(texts):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    return [len(x) for x in pieces.encode(texts, num_threads=1)]


def test_tokens_equal_the_librarys():
    rnd = random.Random(3)
    texts = _odd(rnd, 800) + ["".join(chr(rnd.choice([rnd.randrange(1, 127), rnd.randrange(0x80, 0x2000), rnd.randrange(0x3000, 0xD7FF), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(500)]
    texts += ["", " ", "a" * 5000, " " * 3000, "".join(rnd.choice("abcdefgh") for _ in range(20000))]
    v = tokencount.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    assert tokencount._counts(v, [t.encode() for t in texts]).tolist() == _library(texts)


def test_long_sequences_merge_as_short_ones():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdehinrst") for _ in range(rnd.randrange(2, 200))) for _ in range(300)]
    v = tokencount.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    assert tokencount.count_pieces(v, words, 1).tolist() == tokencount.count_pieces(v, words, 10**6).tolist()


def test_token_count_rows(spark):
    rows = [(1, None, "x"), (None, "null id", "x"), (2, "", "x"), (3, "same row", "x"), (3, "same row", "x"), (4, "word " * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    model = tokenizer_path("piece_bpe_32k.model")
    found = tokencount.token_counts(docs, model)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 4096) for (i, t, _), n in zip(rows, _library([t or "" for _, t, _ in rows]))]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert tokencount.token_counts(docs.limit(0), model).collect() == []


def test_token_counts_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: tuple(r) for r in QUERIES["op11_token_counts"](spark, SF).collect()}
    assert found == {d.doc_id: (d.doc_id, len(d.text.encode()), n, n > 4096) for d, n in zip(docs, _library([d.text for d in docs]))}


def test_vocabularies_of_another_kind_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(Path(tokenizer_path("piece_bpe_32k.model")).read_bytes())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        tokencount.vocabulary(str(tmp_path / "other.model"))


def _sql_of_divergence(docs: list[tuple], least: int) -> list[tuple]:
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    if docs:
        con.executemany("insert into documents values (?, ?, ?, ?)", docs)
    out = con.execute(ORACLE_SQL["op12_divergence"].replace(">= 30", f">= {least}"))
    names = [c[0] for c in out.description]
    return sorted(tuple(dict(zip(names, r))[n] for n in ("lang", "source", "part", "item", "value", "rank")) for r in out.fetchall())


@pytest.mark.parametrize("shard_bytes,shard_rows", [(1 << 25, 200_000), (2000, 20), (500, 1)])
def test_divergence_equals_sql(spark, shard_bytes, shard_rows):
    rnd = random.Random(5)
    words = ["Alpha", "beta", "ÉTÉ", "été", "gamma", "x1y2", "日本", "Ωmega", "don't", "tail", *[f"w{chr(97 + i)}" for i in range(26)]]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = []
    for i in range(300):
        lang, source = rnd.choice(["en", "en", "en", "de", "", None]), rnd.choice(["s0", "s0", "s0", "s1", "s2", "é", None, ""])
        docs.append((i // 2, rnd.choice([None, "", " \n9"]) if rnd.random() < 0.1 else " ".join(rnd.choices(words, weights, k=rnd.randrange(30))), lang, source))
    docs += [(900 + i, None, "fr", f"f{i}") for i in range(3)]  # a language without terms: pairs of value 0
    docs += [(950, "zero\x00byte zero", "en", "s9")]
    rows = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, lang string, source string, term string").repartition(5)
    found = divergence.divergence(rows, 8, shard_bytes=shard_bytes, shard_rows=shard_rows)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(map(tuple, found.collect()))
    assert got == _sql_of_divergence(docs, 8)
    assert [r for r in got if r[0] == "fr"] == [("fr", f"f{i}", "pair", f"f{j}", 0, k) for i in range(3) for k, j in enumerate([j for j in range(3) if j != i], 1)]


def test_divergence_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b", "en", "x"), (2, "a b b b", "en", "y"), (3, "rare", "en", "y")], "doc_id long, text string, lang string, source string")
    found = {tuple(r)[:4]: (r.value, r.rank) for r in divergence.divergence(docs, 2).collect()}
    share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 10)  # noqa: E731  two kept terms
    apart = abs(share(2, 3) - share(1, 4)) + abs(share(1, 3) - share(3, 4))
    assert found == {
        ("en", "x", "pair", "y"): (apart, 1),
        ("en", "y", "pair", "x"): (apart, 1),
        ("en", "x", "term", "a"): (share(2, 3) - share(3, 7), 1),
        ("en", "y", "term", "b"): (share(3, 4) - share(4, 7), 1),
    }


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.divergence(empty).collect() == []
    one = spark.createDataFrame([(1, "word", None, None)], empty.schema)
    assert divergence.divergence(one).collect() == []


def _plain_runs(w):
    """Every stretch that keeps a period, with its smallest one."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(all(w[x] == w[x + s] for x in range(i, j + q - s)) for s in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _words(rnd: random.Random) -> list[int]:
    w = [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randrange(60))]
    if rnd.random() < 0.7 and w:
        unit, at = [rnd.randrange(4) for _ in range(rnd.randrange(1, 9))], rnd.randrange(len(w))
        w = w[:at] + (unit * 12)[: rnd.randrange(100)] + w[at:]
    return w


@pytest.mark.parametrize("kept", [runs.KEPT_GRID, 0])
def test_runs_equal_a_plain_search(kept, monkeypatch):
    monkeypatch.setattr(runs, "KEPT_GRID", kept)
    rnd = random.Random(6)
    found = 0
    for _ in range(1500):
        w = _words(rnd)
        want = _plain_runs(w)
        assert runs.runs(np.array(w, np.int32)) == want, w
        found += len(want)
    assert found > 800


def test_extensions_equal_a_plain_walk():
    rnd = random.Random(7)
    for _ in range(100):
        w = np.array([rnd.randrange(3) for _ in range(rnd.randrange(2, 60))])
        i, j = (np.array(x) for x in zip(*[(a, b) for a in range(len(w)) for b in range(len(w)) if a != b]))
        plain = [next((k for k in range(len(w)) if max(a, b) + k >= len(w) or w[a + k] != w[b + k]), 0) for a, b in zip(i, j)]
        assert runs.Extensions(w)(i, j).tolist() == plain


def _plain_answer(doc_id, text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = _plain_runs(words)
    gone = {x for s, length, p in found for x in range(s + p, s + length)}
    top = min(found, key=lambda r: (-np.float64(r[1]) / r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *own, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_rows(spark):
    rnd = random.Random(8)
    rows = [(None, "a " * 20), (1, None), (2, ""), (3, " \n\t"), (4, "na na na na " * 9), (5, "x " * 12 + "y z " * 12), (5, "x " * 12 + "y z " * 12), (6, "w " * 30000)]
    rows += [(i, " ".join(f"w{x}" for x in _words(rnd))) for i in range(100, 400)]
    found = runs.periodic_runs(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    small = [r for r in rows if len(r[1] or "") < 10**4]
    got = sorted(map(tuple, found.collect()), key=str)
    assert [r for r in got if r[0] != 6] == sorted((_plain_answer(*r) for r in small), key=str)
    assert [r[:6] for r in got if r[0] == 6] == [(6, 1, 0, 30000, 1, 30_000_000)]
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_over_the_table(spark):
    docs = [d for d in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(d.text) < 8000]
    found = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    for d in docs:
        assert found[d.doc_id] == _plain_answer(d.doc_id, d.text)
