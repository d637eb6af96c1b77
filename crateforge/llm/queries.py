"""The registered queries: each operator with its production parameters over its whole table, and SQL where it says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateforge.llm import decontaminate, divergence, embeddings, langid, packing, pii, ppm, quality, runs, secrets, simhash, tokencount, toxicity
from crateforge.llm.common import read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary lies on this machine; it is the same on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read(spark, sf_dir, "documents"))


def _with_scores(found: DataFrame) -> DataFrame:
    """The scores of all spans, in the order of the line ``spans``, in place of the structs."""
    return found.withColumn("scores", F.transform("found", lambda s: F.round(s["score"], 6))).drop("found")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_scores(pii.pii(read(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), tokenizer_path())).drop("ids")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents")).drop("positions")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("hits")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_scores(secrets.secrets(read(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_ppm, op3_pii, op4_packing, op5_language, op6_toxicity, op7_secrets, op8_simhash, op9_embeddings, op10_decontamination,
        op11_token_counts, op12_divergence, op13_periodic_runs,
    )
}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The learned, tokenizing and hashing operators have none: tests hold them against plain versions or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op9_embeddings": """
with recursive e as (select vec_id, label, cast(embedding as double[]) v from embeddings where label is not null),
l as (select a.vec_id a, b.vec_id b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id
      where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.98),
r as (select vec_id a, vec_id b from embeddings union select r.a, l.b from r join l on l.a = r.b)
select c.vec_id, coalesce(n.n, 0) n_links, c.component_id, c.vec_id = c.component_id kept
from (select a vec_id, min(b) component_id from r group by a) c left join (select a vec_id, count(*) n from l group by a) n using (vec_id)""",
    "op10_decontamination": f"""
with d as (select doc_id, {WORDS} w from documents),
b as (select item_id, w, least(10, len(w)) l from (select item_id, {WORDS} w from benchmark) where len(w) > 0),
p as (select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') s from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) i from b)),
x as (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i from d, (select distinct l from p) where len(w) >= l),
h as (select doc_id, i, x.l, item_id from x join p on p.l = x.l and p.s = array_to_string(w[i:i + x.l - 1], ' ')),
n as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(range(i, i + l)) pos from h) group by 1),
g as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, cast(item_id as varchar) item from h) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (doc_id) left join g using (doc_id)""",
    "op12_divergence": r"""
with d as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w, row_number() over () rid from documents),
t as (select rid, lang, source, unnest(w) term from d),
k as (select lang, term from (select distinct rid, lang, term from t) group by all having count(*) >= 30),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) n from t join k using (lang, term) group by all),
x as (select g.lang, g.source, k.term, coalesce(c.n, 0) n from g join k using (lang) left join c using (lang, source, term)),
s as (select *, sum(n) over (partition by lang, source) tot, count(*) over (partition by lang, source) v from x),
l as (select lang, term, sum(n) n, sum(sum(n)) over (partition by lang) tot, count(*) over (partition by lang) v from x group by lang, term),
p as (select lang, source, term, n, cast(1 + (1000000000 * (n + 5)::hugeint) // (tot + 5 * v) as bigint) p from s),
q as (select lang, term, cast(1 + (1000000000 * (n + 5)::hugeint) // (tot + 5 * v) as bigint) q from l),
f as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(f, 0) as bigint) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
      union all select lang, source, 'term', term, p - q from p join q using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value, cast(rank as int) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r) where part = 'pair' or rank <= 50""",
}
