"""Span arithmetic that the PII and secret operators share."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa

SPAN = "struct<kind:string,start:long,end:long,score:double,base:boolean>"
ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])


def line(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(line(spans).encode()).hexdigest()


class Taken:
    """The union of spans (kind, start, end, ...): one sort, then each question takes a binary search."""

    def __init__(self, spans: list[tuple]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(s[1:3] for s in spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        """Whether [start, end) overlaps no span."""
        k = bisect_right(self.ends, start)
        return k == len(self.starts) or self.starts[k] >= end


def scan(finder, kinds: list[str]):
    """mapInArrow function: doc_id, text -> doc_id, count per base kind, base digest, all spans as a line and as structs."""

    def run(batches):
        find = finder()
        for batch in batches:
            rows: dict[str, list] = {"doc_id": batch.column("doc_id").to_pylist(), **{f"n_{k}": [] for k in kinds}, "base_sha256": [], "spans": [], "found": []}
            for text in batch.column("text"):
                base, every = find(text.as_py() or "")
                for k in kinds:
                    rows[f"n_{k}"].append(sum(s[0] == k for s in base))
                rows["base_sha256"].append(digest(base))
                rows["spans"].append(line(every))
                rows["found"].append([dict(zip(("kind", "start", "end", "score", "base"), s)) for s in every])
            yield pa.RecordBatch.from_pydict(
                rows,
                schema=pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in kinds], ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(ARROW_SPAN))]),
            )

    return run


def schema(kinds: list[str]) -> str:
    return f"doc_id long, {', '.join(f'n_{k} long' for k in kinds)}, base_sha256 string, spans string, found array<{SPAN}>"


def redact(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with the union of the spans replaced, each run by one mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
