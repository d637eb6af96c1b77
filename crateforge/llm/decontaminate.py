"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Every item becomes its windows of ``n`` consecutive words (a shorter item is one window); the windows, delimited by
spaces, are the automaton's patterns. Each document is normalised the same way and scanned once; matches are mapped to
word positions and from there to code points of the original text.

Defined results: a null text has no words; an item without words has no window; very long texts are scanned whole;
repeated rows, also of one doc_id with other texts, and null doc_ids get their own results; a null item_id is left out of
the item list but its windows still mark words; an empty table gives no rows, an empty benchmark no hits; extra columns,
whatever their names, are left out.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateforge.llm.common import over_rows, stage, tidy, wanted

#: ASCII letters in lower case and digits stay, all other ASCII separates words, bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def patterns_of(items: list[tuple[str | None, bytes]], n: int) -> dict[bytes, list[str | None]]:
    """Window -> ids of the items that have it."""
    found: dict[bytes, list[str | None]] = {}
    for item, text in items:
        for window in windows_of(words_of(text), n):
            found.setdefault(window, []).append(item)
    return found


def automaton(patterns: dict[bytes, list[str | None]]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for window, ids in patterns.items():
        built.add_word(f" {window.decode()} ", (window.count(b" ") + 1, ids))
    built.make_automaton()
    return built


def _scan(patterns, n: int):
    def run(batches):
        found = automaton(patterns.value)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_hit", "item_ids", "spans")}
            texts = batch.column("text").cast(pa.binary())
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                raw = text.as_py() or b""
                words = words_of(raw)
                hit = np.zeros(len(words) + 1, np.int32)
                ids: set[str] = set()
                if words and len(found):
                    line = f" {b' '.join(words).decode()} "
                    places = None
                    for end, (size, items) in found.iter(line):
                        if places is None:
                            places = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
                        last = int(np.searchsorted(places, end))  # words up to and with the matched one
                        hit[last - size] += 1
                        hit[last] -= 1
                        ids.update(x for x in items if x is not None)
                marked = np.cumsum(hit[:-1]) > 0
                rows["doc_id"].append(doc)
                rows["n_words"].append(len(words))
                rows["n_hit"].append(int(marked.sum()))
                rows["item_ids"].append(sorted(ids))
                rows["spans"].append(_spans(raw, marked) if marked.any() else [])
            yield pa.RecordBatch.from_pydict(
                rows,
                schema=pa.schema(
                    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                ),
            )

    return run


def _spans(raw: bytes, marked: np.ndarray) -> list[dict[str, int]]:
    """Runs of marked words as code points of the original text."""
    places = [m.span() for m in WORD.finditer(raw.decode())]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]


@tidy
def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, shard_chars: int = 1 << 25) -> DataFrame:
    """Per document: n_words, n_hit, item_ids (sorted as strings), spans (code points of hit runs).

    The items are measured first. Up to ``shard_chars`` characters they form one automaton; beyond it they are dealt by
    hash into as many automata as needed; every row passes each in turn and carries its marked runs along, which are
    merged within the row. A shard's patterns are collected and broadcast when its scan starts and given up when it has
    ended, so nothing that grows with the benchmark is ever broadcast whole.
    """
    docs = wanted(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    scans = _scans(items, n, shard_chars)
    if len(scans) == 1:
        return docs.mapInArrow(scans[0](), SCHEMA)
    found = docs.withColumns({"item_ids": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start:long,end:long>>")})

    def merged(rows: pa.RecordBatch, again: pa.RecordBatch) -> pa.RecordBatch:
        both = [pa.array([[*(a or []), *(b or [])] for a, b in zip(rows.column(c).to_pylist(), again.column(c).to_pylist())], rows.column(c).type) for c in ("item_ids", "spans")]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), *both], schema=rows.schema)

    for make in scans:
        scan = make()
        found, _ = stage(over_rows(found, scan, merged))  # one automaton at a time in a worker
        scan.patterns.unpersist()
    return _merged(found)


def _scans(items: DataFrame, n: int, shard_chars: int) -> list:
    """For each automaton what makes its mapInArrow function: its patterns are collected and broadcast only then."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(size) // shard_chars))
    parts = [items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k) for k in range(shards)]

    def make(part: DataFrame):
        patterns = part.sparkSession.sparkContext.broadcast(patterns_of([(r[0], r[1].encode()) for r in part.collect()], n))
        scan = _scan(patterns, n)
        scan.patterns = patterns
        return scan

    return [partial(make, part) for part in parts]


@tidy
def clean(docs: DataFrame, items: DataFrame, n: int = 10, shard_chars: int = 1 << 25) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item's window hits; of several automata each sees what the ones before it left."""

    def untouched(rows: pa.RecordBatch, found: pa.RecordBatch) -> pa.RecordBatch:
        return rows.filter(pc.equal(found.column("n_hit"), 0))

    *before, last = _scans(items, n, shard_chars)
    for make in before:
        scan = make()
        docs, _ = stage(over_rows(docs, scan, untouched))
        scan.patterns.unpersist()
    return over_rows(docs, last(), untouched)


def _merged(found: DataFrame) -> DataFrame:
    """Union, row by row, of the runs and items that several automata marked."""

    def count(batches):
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_hit", "item_ids", "spans")}
            for row in batch.to_pylist():
                places = [m.span() for m in WORD.finditer(row["text"] or "")]
                marked = np.zeros(len(places), bool)
                starts = np.array([p[0] for p in places], np.int64)
                for s in row["spans"] or []:
                    marked[np.searchsorted(starts, s["start"]) : np.searchsorted(starts, s["end"])] = True
                rows["doc_id"].append(row["doc_id"])
                rows["n_words"].append(len(places))
                rows["n_hit"].append(int(marked.sum()))
                rows["item_ids"].append(row["item_ids"] or [])
                rows["spans"].append(_spans((row["text"] or "").encode(), marked) if marked.any() else [])
            yield pa.RecordBatch.from_pydict(
                rows,
                schema=pa.schema(
                    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                ),
            )

    return found.withColumn("item_ids", F.array_sort(F.array_distinct("item_ids"))).mapInArrow(count, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op10 from the operator's own."""
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
