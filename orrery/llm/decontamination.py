"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words; a pattern is a window of 10 consecutive words of a benchmark item, or the whole of a shorter item. Patterns
of one length form a searcher: a shift table over blocks of two words says how far the search may jump, a zero shift leads to
the patterns that end in that block, a prefix of two words selects among them, and a direct comparison confirms. Words that no
pattern holds share symbol 0 and allow the longest jump.

Patterns are taken in blocks of items of about ``BLOCK_BYTES`` of text (sizes are summed before anything is collected, larger items
are cut into overlapping parts), one pass over the documents after another, so what a worker holds is bounded; more benchmark text
means more passes, and nothing is left out.

Results in the odd cases: null or wordless text has no words and no hits; null, wordless or repeated items add no pattern or
the same ones; a null item_id is named by the empty string; an empty benchmark marks nothing; repeated rows are each judged;
other columns pass through, whatever their names. Texts are searched whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from orrery.llm.columns import free_names
from orrery.storage import discard, stored

WINDOW = 10
BLOCK_BYTES = 4_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = T.StructType.fromJson(
    {"type": "struct", "fields": [{"name": "n_words", "type": "long", "nullable": False, "metadata": {}}, {"name": "n_hit", "type": "long", "nullable": False, "metadata": {}}, {"name": "starts", "type": {"type": "array", "elementType": "long", "containsNull": False}, "nullable": False, "metadata": {}}, {"name": "ends", "type": {"type": "array", "elementType": "long", "containsNull": False}, "nullable": False, "metadata": {}}, {"name": "items", "type": {"type": "array", "elementType": "string", "containsNull": False}, "nullable": False, "metadata": {}}]}
)


def words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Searcher:
    """Patterns of one length m: tuples of symbols, each with the items it comes from."""

    def __init__(self, m: int, patterns: dict[tuple, set]):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict = {}
        self.ends: dict = {}
        for p, items in patterns.items():
            for q in range(self.block, m + 1):
                b = p[q - self.block : q]
                self.shift[b] = min(self.shift.get(b, self.far), m - q)
            self.ends.setdefault(p[-self.block :], {}).setdefault(p[: self.block], []).append((p, items))

    def search(self, ids: list[int], spans: list, items: set) -> None:
        m, b, far, shift, ends, n = self.m, self.block, self.far, self.shift.get, self.ends, len(ids)
        at = m - 1
        while at < n:
            tail = tuple(ids[at - b + 1 : at + 1])
            jump = shift(tail, far)
            if jump:
                at += jump
                continue
            start = at - m + 1
            for p, named in ends.get(tail, {}).get(tuple(ids[start : start + b]), ()):
                if p == tuple(ids[start : at + 1]):
                    spans.append((start, at + 1))
                    items |= named
            at += 1


class Matcher:
    """All searchers over one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        by: dict[int, dict[tuple, set]] = {}
        for name, text in items:
            w = words(text)
            s = [self.ids.setdefault(x, len(self.ids) + 1) for x in w]
            m = min(window, len(s))
            for i in range(len(s) - m + 1 if m else 0):
                by.setdefault(m, {}).setdefault(tuple(s[i : i + m]), set()).add(name)
        self.searchers = [Searcher(m, p) for m, p in sorted(by.items())]

    def find(self, text: str | None) -> tuple[int, int, list, list, list]:
        w = words(text)
        get = self.ids.get
        ids = [get(x, 0) for x in w]
        spans: list = []
        items: set = set()
        if any(ids):
            for s in self.searchers:
                s.search(ids, spans, items)
        runs = merged(spans)
        return len(w), sum(e - s for s, e in runs), [s for s, _ in runs], [e for _, e in runs], sorted(items)


def merged(spans: list) -> list:
    runs: list = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


def _pieces(block_bytes: int, window: int):
    """Items of over ``block_bytes`` cut into parts that share ``window`` - 1 words, so that no window is lost and no part is larger than a pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list = []
            for name, t in zip(b["name"], b["t"]):
                if not isinstance(t, str) or len(t) * 4 <= block_bytes:
                    out.append((name, t))
                    continue
                w, part, size = [x.decode("utf-8", "surrogatepass") for x in words(t)], [], 0
                for x in w:
                    part.append(x)
                    size += 4 * len(x) + 1
                    if size > block_bytes // 2 and len(part) >= window:
                        out.append((name, " ".join(part)))
                        part = part[len(part) - window + 1 :]
                        size = sum(4 * len(y) + 1 for y in part)
                if len(part) >= window or len(w) < window:
                    out.append((name, " ".join(part)))
            yield pd.DataFrame(out, columns=["name", "t"])

    return run


def _finder(kept, window: int):
    """A pass: hits of one block of items joined with those found before. One matcher is built in a task."""
    built: list = []

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if not built:
            built.append(Matcher(kept.value, window))
        for texts, before in batches:
            out = []
            for t, old in zip(texts, before):
                got = built[0].find(t)
                if old is not None and len(old):
                    runs = merged([(o["s"], o["e"]) for o in old if o["item"] is None] + list(zip(got[2], got[3])))
                    got = (got[0], sum(e - s for s, e in runs), [s for s, _ in runs], [e for _, e in runs], sorted({o["item"] for o in old if o["item"] is not None} | set(got[4])))
                out.append(got)
            yield pd.DataFrame(out, columns=FOUND.names)

    return find


_BEFORE = "array<struct<s:long,e:long,item:string>>"


def with_hits(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, out: str = "found") -> DataFrame:
    """Every row with ``out``: n_words, n_hit, merged hit spans (word positions) and the items found. A column of that name is an error."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {out}; name another")
    spark = docs.sparkSession
    b = bench.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"), F.col(item_text).alias("t"))
    size = F.octet_length(F.coalesce(F.col("t"), F.lit(""))).cast("long")
    total = b.agg(F.sum(size)).first()[0] or 0
    blocks = 1
    if total > block_bytes:  # blocks by hash of the item; twice as many as the mean asks for, so that a block's size is bounded
        blocks = 2 * -(-total // block_bytes)
        b = stored(b.mapInPandas(_pieces(block_bytes, window), "name string, t string").withColumn("k", F.pmod(F.xxhash64("name", "t"), F.lit(blocks))), "benchmark")
    marked, before = docs, F.lit(None).cast(_BEFORE)
    for k in range(blocks):
        part = b.filter(F.col("k") == k) if blocks > 1 else b
        kept = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.select("name", "t").toLocalIterator()])
        new = marked.withColumn(out, _finder(kept, window)(F.col(text), before))
        if blocks == 1:
            return new
        # Passes run one after another: each stores its rows, then lets its items go.
        done = stored(new, "hits")
        kept.unpersist()
        if k:
            discard(marked)
        marked = done
        spans = F.transform(F.arrays_zip(F.col(f"{out}.starts").alias("s"), F.col(f"{out}.ends").alias("e")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(None).cast("string").alias("item")))
        named = F.transform(F.col(f"{out}.items"), lambda x: F.struct(F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), x.alias("item")))
        before = F.concat(spans, named)
    return marked


def decontaminate(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows without a hit, with their own columns."""
    (out,) = free_names(docs, "found")
    marked = with_hits(docs, bench, out=out, **options)
    return marked.filter(F.col(f"{out}.n_hit") == 0).drop(out)
