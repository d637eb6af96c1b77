"""Source divergence: how far the sources of a language differ in their words, by DuckDB over shards.

1. Each batch of documents is counted by DuckDB: (lang, source, term, n, df).
2. The counts are dealt into shards by a hash of lang and term; in each shard DuckDB sums them and keeps the terms that
   enough documents of the language hold. What is kept is staged.
3. Spark sums the kept counts of each source and language. They are dealt into shards again, each with the totals of all
   groups (one small row a group); DuckDB gives the shares, the partial sums of each pair of sources over the shard's
   terms, and the ``top`` terms of each group.
4. Spark adds the partial sums and ranks.

The sum over all kept terms of |p - q| is V |z - y|, with z and y the shares of a term that does not occur, and what the
occurring terms change in it: a term of one source alone changes |p - y| - |z - y|, which depends on its count only, so
terms of equal share are one row before they meet the other sources; a term of both changes
|p - q| - |p - y| - |z - q| + |z - y|. No term that a source lacks is ever written out.

All sums are exact integers. The number of shards follows the bytes of text and the number of kept counts; a term is one
row a source, so no shard holds a hot one. The report itself has a row for each ordered pair of sources of a language.

Defined results: null text, lang and source read as ''; groups without terms take part with counts of zero; a language
without kept terms has pairs of value 0 and no terms; ties of value go by the item's UTF-8 bytes; rows that repeat count
as often as they stand; an empty table gives no rows; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crateforge.llm.common import stage, tidy

TERM = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
#: Bytes of text that DuckDB counts at once, bytes of text for a shard of counts, and kept counts for a shard of sums.
SLICE, SHARD_BYTES, SHARD_ROWS = 4 << 20, 16 << 20, 200_000
SCALE, PRIOR = 1_000_000_000, 5

COUNTED = "lang string, source string, term string, n long, df long"
KEPT = "lang string, source string, term string, n long, of_lang long"
PARTS = "part string, lang string, source string, item string, value long"


def _duck():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})


def _asked(con, sql: str, **tables: pa.Table) -> list[pa.RecordBatch]:
    for name, rows in tables.items():
        con.register(name, rows)
    out = con.sql(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out


def _counted(batches):
    """Rows (text, lang, source) -> rows COUNTED, a term once for each group of a batch."""
    con = _duck()
    for batch in batches:
        sizes, start, held, slices = [x or 0 for x in pc.binary_length(batch.column("text").cast(pa.binary())).to_pylist()], 0, 0, []
        for i, size in enumerate(sizes):
            if i > start and held + size > SLICE:
                slices.append((start, i))
                start, held = i, 0
            held += size
        slices.append((start, len(sizes)))
        found = []
        for a, b in slices:
            rows = pa.Table.from_batches([batch.slice(a, b - a)]).append_column("row", pa.array(range(b - a), pa.int64()))
            found.append(_asked(con, f"""
                select lang, source, term, cast(sum(n) as bigint) n, count(*) df
                from (select row, lang, source, term, count(*) n from (select row, lang, source, unnest({TERM}) term from docs) group by all) group by all""", docs=rows))  # fmt: skip
        both = pa.concat_tables(found)
        if len(found) > 1:
            both = _asked(con, "select lang, source, term, cast(sum(n) as bigint) n, cast(sum(df) as bigint) df from parts group by all", parts=both)
        yield from _typed(both, COUNTED)


def _typed(table: pa.Table, schema: str) -> list[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64()}
    names = [tuple(c.split()) for c in schema.split(", ")]
    return table.select([n for n, _ in names]).cast(pa.schema([(n, kinds[k]) for n, k in names])).to_batches()


def _kept(least: int):
    """All counts of some terms of some languages -> those of the terms that ``least`` documents of the language hold."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            yield from _typed(_asked(_duck(), f"""
                with summed as (select lang, source, term, cast(sum(n) as bigint) n, sum(df) df from parts group by all)
                select lang, source, term, n, cast(of_lang as bigint) of_lang
                from (select *, sum(n) over own of_lang, sum(df) over own held from summed window own as (partition by lang, term)) where held >= {least}""",
                parts=pa.Table.from_batches(parts)), KEPT)

    return run


def _share(count: str, total: str, kept: str) -> str:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR V)), in integers that cannot overflow."""
    return f"cast(1 + (cast({SCALE} as hugeint) * ({count} + {PRIOR})) // (cast({total} as hugeint) + {PRIOR} * cast({kept} as hugeint)) as bigint)"


def _parts(top: int):
    """A shard's kept counts and the totals of all groups -> partial sums of pairs and the group's best terms."""
    sql = f"""
    with g as (select lang, source, v, total, total_lang, {_share("0", "total", "v")} z from totals where v > 0),
    r as (select r.*, g.z, {_share("n", "total", "v")} p, {_share("of_lang", "total_lang", "v")} q from kept r join g using (lang, source)),
    alone as (select lang, source, p, z, count(*) c from r group by all),
    pairs as (
      select a.lang, least(a.source, g.source) source, greatest(a.source, g.source) item, sum(a.c * (abs(a.p - g.z) - abs(a.z - g.z))) f
      from alone a join g on a.lang = g.lang and a.source <> g.source group by all
      union all
      select a.lang, a.source, b.source, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z))
      from r a join r b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all)
    select 'pair' part, lang, source, item, cast(sum(f) as bigint) as value from pairs group by all
    union all
    select 'term', lang, source, term, p - q from (select * from r where p > q qualify row_number() over (partition by lang, source order by p - q desc, term) <= {top})"""

    schema = pa.schema([(n, pa.int64() if n == "value" else pa.string()) for n in ("part", "lang", "source", "item", "value")])

    def run(kept: pa.Table, totals: pa.Table) -> pa.Table:
        if not kept.num_rows or not totals.num_rows:  # a side without rows has no columns either
            return schema.empty_table()
        return pa.Table.from_batches(_typed(_asked(_duck(), sql, kept=kept.drop_columns("shard"), totals=totals.drop_columns("shard")), PARTS), schema)

    return run


@tidy
def divergence(docs: DataFrame, least: int = 30, top: int = 50, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): every other source of the language, and the terms that mark a source."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups, _ = stage(rows.groupBy("lang", "source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")))
    size = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    dealt = rows.mapInArrow(_counted, COUNTED).repartition(-(-size // shard_bytes) or 1, "lang", "term")
    kept, _ = stage(dealt.mapInArrow(_kept(least), KEPT))

    terms = kept.groupBy("lang", "term").agg(F.first("of_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total_lang"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = groups.join(own, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "total_lang")])
    totals, _ = stage(totals)

    shards = -(-kept.count() // shard_rows) or 1
    left = kept.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    right = totals.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts, _ = stage(left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(_parts(top), PARTS))

    z = F.lit(1) + F.expr(f"cast({SCALE * PRIOR} as decimal(38, 0)) div (cast(total as decimal(38, 0)) + {PRIOR} * v)")
    zero = totals.select("lang", "source", "v", F.when(F.col("v") > 0, z).otherwise(F.lit(0)).cast("long").alias("z"))
    other = zero.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    changed = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("f"))
    both = changed.unionByName(changed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "f"))
    pairs = zero.join(other, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    found = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("v") * F.abs(F.col("z") - F.col("y")) + F.coalesce("f", F.lit(0))).cast("long").alias("value"))
    found = found.unionByName(parts.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
