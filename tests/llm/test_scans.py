"""Decontamination, PII, secrets and SimHash against plain versions."""

import hashlib
import re
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from crateforge.llm import decontaminate, pii, secrets, simhash, spans

SF = "/root/testdata/sf0.001"
ODD = [(900001, None), (900002, ""), (900003, "  \n "), (900004, "Ünïcode ſecret=abcdefgh K AKIA123 password: 'hunter22!' \U0001f600 a@b.c"), (900005, ("x" * 50 + " ") * 6_000), (900005, ("x" * 50 + " ") * 6_000), (None, "a b c d")]


def rows(spark, more=True):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")) if more else docs


def with_extras(df):
    return df.withColumns({"words": F.lit(1), "found": F.lit("x"), "fp": F.lit(2), "spans": F.lit(None).cast("string"), "n_email": F.lit(3), "key": F.lit(0), "u": F.lit(0)})


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str]], n: int = 10) -> dict[int, tuple]:
    """Plain version for tests: every window of every item against every position of every document."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    out = {}
    for doc, text in docs:
        words = word.findall(lower(text or ""))
        hit, ids = set(), set()
        for item, item_text in items:
            own = word.findall(lower(item_text))
            size = min(n, len(own))
            wins = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1):
                if wins and tuple(words[i : i + size]) in wins:
                    hit.update(range(i, i + size))
                    ids.add(str(item))
        out[doc] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_against_brute_force(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    short = spark.createDataFrame([(70001, "Ünïcode, SECRET"), (70002, "!!"), (70003, None), (70004, "")], "item_id long, text string")
    items = items.unionByName(short)
    docs = with_extras(rows(spark))
    want = brute_force([tuple(r) for r in rows(spark).collect()], [(r[0], r[1] or "") for r in items.select("item_id", "text").collect()])
    got = decontaminate.digest(decontaminate.decontaminate(docs, items)).collect()
    assert len(got) == docs.count() and any(r.contaminated for r in got)
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got)
    many = decontaminate.digest(decontaminate.decontaminate(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), items, shard_chars=1500)).collect()
    assert sorted(map(tuple, many)) == sorted({tuple(r) for r in got if r.doc_id is not None})
    assert decontaminate.decontaminate(docs.limit(0), items.limit(0)).count() == 0


def test_decontamination_by_shards_keeps_null_and_repeated_ids(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = [(None, items.first().text), (None, "clean"), (900005, items.first().text), (900005, "clean as well"), (900005, "x " + items.first().text)]
    docs = rows(spark).unionByName(spark.createDataFrame(hit, "doc_id long, text string"))
    plain = lambda r: (r.doc_id or -1, r.n_words, r.n_hit, r.item_ids, r.spans)
    one, many = (sorted(map(plain, decontaminate.decontaminate(docs, items, shard_chars=n).collect())) for n in (1 << 25, 1500))
    assert one == many and sum(r[0] == -1 and r[2] > 0 for r in many) == 1


def test_decontamination_spans_are_code_points(spark):
    docs = spark.createDataFrame([(1, "Ä.. One two, THREE four five six seven eight nine ten eleven é")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "one two three four five six seven eight nine ten")], "item_id long, text string")
    (row,) = decontaminate.decontaminate(docs, items).collect()
    text = docs.first().text
    assert [text[s.start : s.end] for s in row.spans] == ["One two, THREE four five six seven eight nine ten"] and row.n_hit == 10


def plain_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii(spark):
    texts = {r.doc_id: r.text or "" for r in rows(spark).collect()}
    got = pii.pii(with_extras(rows(spark))).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        base = plain_pii(texts[r.doc_id])
        assert r.base_sha256 == spans.digest(base) and r.n_ip == sum(s[0] == "ip" for s in base)
        assert set(spans.line(base).split(",")) <= set(r.spans.split(","))
    for text in ("a@b@c.d x@y.z@q.w", "1.2.3.4.5.6.7.8 999.1.1.1 00000001.2.3.4", "..a@b.c.d-e", "4111 1111-1111 1111 0", "+1 (2)3 45678", "@a.b c@d"):
        assert pii.base_spans(text) == plain_pii(text), text
    assert ("iban", 8, 30) in [s[:3] for s in pii.find("account DE89370400440532013000 yes")[1]]
    assert not [s for s in pii.find("account DE89370400440532013001 yes")[1] if s[0] == "iban"]
    assert [s[0] for s in pii.find("ssn social security 123-45-6789")[1]] == ["id_number"] and not pii.find("part 123-45-6789")[1]
    assert pii.pii(rows(spark).limit(0)).count() == 0


def test_pii_time_grows_with_length_only():
    for text in ("7" * 1_000_000, "1.2.3" * 100_000, "+1(" * 200_000, "a@" * 300_000, "a@b.co 1.2.3.4 DE89370400440532013000 " * 2_000):
        began = time.process_time()
        pii.find(text)
        assert time.process_time() - began < 10


def test_pii_leftmost_addresses_and_context():
    plain, draw = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), np.random.default_rng(3)
    for _ in range(3_000):
        text = "".join(draw.choice(list("12.. 0a"), draw.integers(0, 40)))
        assert [m.span() for m in plain.finditer(text)] == [m.span() for m in pii.IP.finditer(text)]
    kinds = lambda text: [s[0] for s in pii.find(text)[1]]
    assert kinds("routing 021000021") == ["bank_code"] and kinds("part 021000021") == [] and kinds("routing 021000022") == []
    assert kinds("amex 378282246310005") == ["short_card"] and kinds("item 378282246310005") == [] and kinds("amex 378282246310006") == []


def test_added_spans_do_not_overlap():
    """Of overlapping added spans the likelier stays; against a plain choice, and on digits in which kinds collide."""
    import random

    rnd = random.Random(2)
    for _ in range(300):
        found = [(rnd.choice("abc"), a := rnd.randrange(40), a + rnd.randrange(1, 12), rnd.randrange(5) / 5, False) for _ in range(rnd.randrange(12))]
        plain = []
        for s in sorted(found, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
            if all(s[2] <= p[1] or s[1] >= p[2] for p in plain):
                plain.append(s)
        assert sorted(pii.apart(found)) == sorted(plain)
    for _ in range(200):
        text = "".join(rnd.choice(["iban ", "DE89370400440532013000", "021000021", "4222222222222", "123-45-6789", " ", "routing ", "card ", "-", "1", "0"]) for _ in range(rnd.randrange(25)))
        base, every = pii.find(text)
        assert every[: len(base)] == base
        added = sorted(s[1:3] for s in every if not s[4])
        assert all(b <= c for (_, b), (c, _) in zip(added, added[1:]))
        assert all(spans.Taken(base).free(*s) for s in added)


def test_taken_spans():
    draw = np.random.default_rng(5)
    for _ in range(300):
        made = [("x", a, a + n) for a, n in draw.integers(1, 20, (draw.integers(0, 8), 2)).tolist()]
        taken = spans.Taken(made)
        for a, n in draw.integers(1, 25, (20, 2)).tolist():
            assert taken.free(a, a + n) == all(a + n <= s[1] or a >= s[2] for s in made)


def test_neighbouring_ibans():
    text = "DE89370400440532013000 GB82WEST12345698765432 DE89 3704 0044 0532 0130 00, XX12 DE89370400440532013000"
    found = [text[s[1] : s[2]] for s in pii.find(text)[1] if s[0] == "iban"]
    assert found == ["DE89370400440532013000", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"]


def plain_secrets(text):
    letters = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    letters = re.sub(r"(?<![\\\[?x])\b(password\|passwd\|secret\|token\|api_\?key)", lambda m: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in m[0]), letters)
    out = [("assign", *m.span()) for m in re.finditer(letters, text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets(spark):
    texts = {r.doc_id: r.text or "" for r in rows(spark).collect()}
    got = secrets.secrets(with_extras(rows(spark))).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        base = plain_secrets(texts[r.doc_id])
        assert r.base_sha256 == spans.digest(base), r.doc_id
        assert (set(spans.line(base).split(",")) - {""}) <= set(r.spans.split(","))
    assert secrets.secrets(rows(spark).limit(0)).count() == 0


ORDINARY = """getUserProfileById2Handler 550e8400-e29b-41d4-a716-446655440000 package-name-1.2.3-beta.4 src/main/java/com/example/app/Main2.java
    thisIsAVeryLongCamelCaseIdentifierName40 internationalization/localization/v2.10 2024-01-15T10:30:00.000Z mail8.example.com 4465758382889437
    https://example.com/a/b/c/d?page=2 MAX_RETRY_COUNT_PER_REQUEST_V2=10 numpy-1.26.4-cp312-cp312-manylinux_2_17_x86_64.whl eyJ.eyJ.abc sk_live_short
    SPDX-License-Identifier org.apache.spark.sql.execution.WholeStageCodegenExec""".split()


def test_automata_tell_formats_apart():
    model = secrets.Model(secrets.labelled())
    for name in {k for k, _ in secrets.FORMATS}:
        fresh = [w for k, w in secrets.labelled(60, seed=123) if k == name]
        assert sum(model.score(w) >= 0.8 for w in fresh) >= 0.95 * len(fresh), name
        cut = [w[:-1] for w in fresh if name != "web_token"] + [w + "x" for w in fresh]
        assert not any(end == len(w) for w in cut for end, _ in model.automata[name].ways(w, 0)), name  # another length is another format
    assert sum(bool(model.tokens(w, 0.8)) for w in secrets.ordinary(300, seed=5)) <= 3
    assert not [w for w in ORDINARY if secrets.find(w, model, 0.8)[1]]
    places = {k: len(a.out) for k, a in model.automata.items()}
    assert places["hex_digest"] == 41 and places["access_key"] == 21 and places["web_token"] < 120


def test_keys_inside_longer_runs_and_time():
    model = secrets.Model(secrets.labelled())
    keys = {k: w for k, w in secrets.labelled(1, seed=9)}
    for name in ("code_host", "payments", "maps_key", "web_token", "random_key"):
        for text in (f"KEY={keys[name]}.", f"a/b/{keys[name]}", f"x={keys[name]}=y"):
            assert keys[name] in [text[s[1] : s[2]] for s in secrets.find(text, model, 0.8)[1]] or name == "random_key", text
    for text in ("a." * 100_000, "A" * 500_000, "eyJa." * 50_000, "eyJ" + "a" * 500_000, ("b" * 24 + " ") * 20_000):
        began = time.process_time()
        secrets.find(text, model, 0.8)
        assert time.process_time() - began < 10


def test_rival_is_learned_from_the_texts(spark):
    texts = ["plain words stay here", None, "", "password=hunter2hunter2 more", "Ü é token: abcdefgh x"]
    model = secrets.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    cut = [spans.redact(t, [s[1:3] for s in secrets.base_spans(t)], "\n") for t in texts if t]
    want = secrets.Rival(secrets.pair_counts(cut))
    assert np.allclose(model.rival.log, want.log) and not any("hunter" in t for t in cut)


def test_secrets_without_digits_and_with_trailing_marks():
    model = secrets.Model(secrets.labelled())
    letters = "qWzRtYbNmKpLxCvGhJdFsAeUiOQwZrTyBnMkPlXc"
    keys = ["sk_live_" + letters[:24], "ghp_" + letters[:36], letters, "AIza" + "b7Q" * 11 + "x-", "AIza" + "b7Q" * 11 + "--"]
    for key in keys:
        for after in ("", ".", " and", "."):
            text = f"see {key}{after}"
            assert [text[s[1] : s[2]] for s in secrets.find(text, model, 0.8)[1]] == [key], text
    for plain in ("internationalization", "beberschlichkeitge", "4465758382889437", "-" * 40, "=" * 20_000):
        assert not secrets.find(plain, model, 0.8)[1]


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    """doc list (id, fp) -> id -> least reachable id."""
    ids = sorted(fps)
    arr = np.array([fps[i] for i in ids], np.uint64)
    least = np.arange(len(ids))
    near = [np.flatnonzero(np.bitwise_count(arr ^ x) <= 3) for x in arr]
    while True:
        new = np.array([least[n].min() for n in near])
        if (new == least).all():
            return {i: ids[k] for i, k in zip(ids, least)}
        least = new


def test_simhash_against_brute_force(spark):
    docs = with_extras(rows(spark)).where("doc_id is not null").dropDuplicates(["doc_id"])
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = plain_components(fps)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}
    assert simhash.simhash(rows(spark)).count() == rows(spark).count() and simhash.simhash(rows(spark).limit(0)).count() == 0


def test_links_short_and_long_lists(spark):
    from crateforge.operators.components import components

    draw = np.random.default_rng(3)
    seeds = draw.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(map(int, seeds))
    for s in seeds[:20]:
        for _ in range(15):
            fps.add(int(s ^ sum((np.uint64(1) << np.uint64(b) for b in draw.choice(64, draw.integers(1, 7), replace=False)), np.uint64(0))))
    signed = {f - 2**64 if f >= 2**63 else f: f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = plain_components(signed)
    for limit in (8192, 2):
        roots = {r.node: r.root for r in components(simhash.links(df, limit)).collect()}
        assert {s: roots.get(s, s) for s in signed} == want
    assert all(any(set(b) <= set(c) for b in simhash.BLOCKS) for c in __import__("itertools").combinations(range(8), 5))


def test_a_format_that_only_the_corpus_labels_is_found(spark):
    """Values of a ninth format are assigned in some texts and stand alone in others; FORMATS has none like it."""
    import random

    draw = random.Random(3)
    new = lambda: "zq9_" + "".join(draw.choices("ABCDEFGHJKMNPQRSTVWXYZ23456789", k=28))
    corpus = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(600).collect()]
    alone = [new() for _ in range(40)]
    texts = [f"{corpus[i][:300]} token = {new()} and more" for i in range(120)] + [f"{corpus[200 + i][:300]} see {k}, please" for i, k in enumerate(alone)] + corpus[300:]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, value string")
    found, made = ({r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.found if s.kind == "format"} for r in secrets.secrets(docs, given).collect()} for given in (None, secrets.labelled()))
    assert sum(alone[i - 120] in found[i] for i in range(120, 160)) >= 39
    assert all(found[i] == made[i] for i in range(160, len(texts)))  # other texts gain no spans
    assert not any(alone[i - 120] in made[i] for i in range(120, 160))  # without the corpus's own values the format is unknown


def test_words_that_are_assigned_teach_no_words(spark):
    """Passwords made of ordinary words are base spans, but ordinary words elsewhere stay clean."""
    words = "correct horse battery staple mountain river window garden yellow orange purple silver".split()
    texts = [f"password: {a}{b}{c} for door {i}" for i, (a, b, c) in enumerate((a, b, c) for a in words for b in words for c in words[:3])]
    texts += [f"the {a}{b}{c} stands alone" for a in words for b in words for c in words[3:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.secrets(docs).collect()
    alone = [r for r in found if r.doc_id >= 432]
    assert sum(len(r.found) > 0 for r in alone) <= len(alone) / 50


def test_near_duplicates_go_through_simhash_links(spark, monkeypatch):
    """Without one shared positional byte, SimHash links alone unite a pair whose shingles are similar enough, and no other."""
    from crateforge.llm import similar

    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(similar, "LEAST", similar.POSITIONS + 1)  # the other candidates never reach it
    assert {r.doc_id for r in similar.dedup(rows).collect()} == {0, 2}
