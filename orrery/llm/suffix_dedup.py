"""Exact substring dedup over bytes with externally induced suffix sorting.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller id.

1. Documents are packed in blocks. Every window of LENGTH bytes has a seed, the least hash of its ``GRAM``-byte strings (leftmost on ties), so
   equal windows have equal seeds. Blocks learn which of their seeds two ids hold, and who holds them first (``blocks.shared_seeds``);
   windows of other seeds are repeated nowhere.
2. Windows are grouped by their seed's first holder and the ``REACH`` bytes of it where the seed is, so equal windows are of one group, and
   neighbouring windows of a copied passage are mostly of one group too. Each run of windows of a group is cut out of its text (a piece).
   Equal pieces of a block are sent once, with their smallest id; occurrences keep (piece, place).
3. Pieces are dealt by group to shards of about ``SHARD_BYTES``, whose suffix tuples are far more than the sort's ``MEMORY``. External
   induced sorting gives a shard's suffixes in order with the common prefixes of neighbours; windows that agree over LENGTH bytes,
   as these values say, are a class, and each window gets its class's smallest id.
4. Windows whose class has a smaller id than the document's are removed from the occurrences' documents, overlaps joined.

Results in the odd cases: null text is empty; texts under LENGTH bytes lose nothing; rows that share an id never remove
each other's bytes, and each is judged by its own text; a null id is smaller than none and removes nothing, nor does it lose anything; an empty
table gives no rows; other columns are not read. Texts are cut nowhere: windows of a long text are hashed in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from orrery.llm.blocks import Block, each_block, packed, shared_seeds, unpack, with_blocks
from orrery.llm.induced_sorting import MEMORY, suffixes
from orrery.storage import discard, shared_dir, stored

LENGTH, GRAM = 50, 24
REACH = 2048
SHARD_BYTES = 4 << 20
PIECE = 1 << 16  # bytes hashed at once
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 4096), base, np.uint64)
        p[0] = 1
        p = _powers[base] = np.multiply.accumulate(p)
    return p[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def seed_runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows that have one seed: its hash and place, and the first window; a run may be cut where a piece of the text ends."""
    n = len(data) - length + 1
    hs, at, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, max(n, 0), PIECE):
        m = min(PIECE, n - a)
        b = np.frombuffer(data, np.uint8, m + length - 1, a)
        s = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * _power(_BASE, len(b)), out=s[1:])
        h = _mix((s[gram:] - s[:-gram]) * _power(_INVERSE, len(b) - gram + 1))
        # high bits of the hash, then the place: one minimum gives the leftmost least
        key = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
        width, least = 1, key
        spread = length - gram + 1
        while width * 2 <= spread:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < spread:
            least = np.minimum(least[: len(least) - (spread - width)], least[spread - width :])
        head = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        place = (least[head] & np.uint64((1 << 20) - 1)).astype(np.int64)
        hs.append(h[place].view(np.int64))
        at.append(place + a)
        first.append(head + a)
    return np.concatenate(hs), np.concatenate(at), np.concatenate(first)


def block_seeds(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one seed: hash (48 bits), document, seed's place in it, first window's place in the block, number of windows."""
    h, at, first = seed_runs(block.text)
    end = np.append(first[1:], max(0, len(block.text) - LENGTH + 1))[: len(first)]
    stop = np.where(block.known, block.starts + block.sizes - LENGTH + 1, 0)  # of a document's windows

    def within(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(first, block.starts[doc]), np.minimum(end, stop[doc])

    # A run is shorter than the windows between two documents' own, so it has windows of one document at most: that of its first or its last.
    one, two = (np.searchsorted(block.starts, x, "right") - 1 for x in (first, end - 1))
    (s1, e1), (s2, e2) = within(one), within(two)
    mine = e1 > s1
    doc, s, e = np.where(mine, one, two), np.where(mine, s1, s2), np.where(mine, e1, e2)
    ok = e > s
    doc, s = doc[ok], s[ok]
    # least hashes are all small; an odd factor spreads them over the range again, one to one
    h = (h[ok].view(np.uint64) >> np.uint64(16)) * np.uint64(_BASE) & np.uint64((1 << 48) - 1)
    return h, doc, at[ok] - block.starts[doc], s, e[ok] - s


def _groups(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number of 40 bits for the first holder and the part of it; different ones may share it, which only makes a group larger."""
    return _mix(ids.view(np.uint64) * np.uint64(_BASE) + place // np.uint64(REACH) + np.uint64(1)) >> np.uint64(24)


PIECES = "grp long, a long, b long, block long, doc int, id long, s long, n int, piece binary"


def pieces(blocks: DataFrame, shared: DataFrame, tasks: int) -> DataFrame:
    """Occurrences (piece null), and each piece that a block holds, with its smallest id. (a, b): 128 bits of the piece's hash."""
    columns = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in each_block(batches):
            known, group = unpack(rows)
            h, doc, _, first, size = block_seeds(block)
            if not len(known) or not len(h):
                continue
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            ok = known[at] == h
            doc, first, size, grp = doc[ok], first[ok], size[ok], group[at[ok]].astype(np.int64)
            if not len(doc):
                continue
            new = np.append(True, (grp[1:] != grp[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + size[:-1]))
            head = np.flatnonzero(new)
            total = np.add.reduceat(size, head)
            out, seen = [], {}
            for g, d, f, n in zip(grp[head].tolist(), doc[head].tolist(), first[head].tolist(), total.tolist()):
                x = block.text[f : f + n + LENGTH - 1]
                i = int(block.ids[d])
                got = seen.get((g, x))
                if got is None:
                    digest = xxhash.xxh3_128_digest(x)
                    got = seen[g, x] = [int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), i, n]
                got[2] = min(got[2], i)
                out.append((g, got[0], got[1], block.key, d, i, f - int(block.starts[d]), n, None))
            out += [(g, v[0], v[1], 0, 0, v[2], 0, v[3], x) for (g, x), v in seen.items()]
            for a in range(0, len(out), 20_000):
                yield pd.DataFrame(out[a : a + 20_000], columns=columns)

    return with_blocks(blocks, shared, tasks).mapInPandas(run, PIECES)


def least_ids(parts: list[bytes], ids: np.ndarray, memory: int = MEMORY, spill: str | None = None, stats: dict | None = None) -> list[np.ndarray]:
    """For each piece, of each of its windows the smallest id of a piece that holds an equal window."""
    size = np.array([len(p) for p in parts], np.int64)
    # byte 255 occurs in no UTF-8, so with all bytes one up it is 0 and parts the pieces
    x = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)
    start = np.cumsum(size + 1) - size - 1
    windows = size - LENGTH + 1
    mark = np.zeros(len(x) + 1, np.int32)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + windows, -1)
    window = np.cumsum(mark[:-1]) > 0
    number = np.empty(len(x), np.int32)  # of the class of each suffix
    classes = 0
    for pos, common in suffixes(x, 256, LENGTH, memory=memory, spill=spill, stats=stats):
        new = common < LENGTH
        if not classes:
            new[0] = True
        got = np.cumsum(new) + classes - 1
        number[pos] = got
        classes = int(got[-1]) + 1
    at = np.flatnonzero(window)
    owner = np.repeat(np.asarray(ids, np.int64), windows)
    least = np.full(classes, np.iinfo(np.int64).max)
    np.minimum.at(least, number[at], owner)
    return np.split(least[number[at]], np.cumsum(windows)[:-1])


def sorted_shards(pieces_: DataFrame, shards: int, spill: str) -> DataFrame:
    """Distinct pieces (grp, a, b) to the smallest id of each of their windows: ids and the windows from which on they hold.

    A task's pieces are one shard; rows of an equal piece from several blocks are compared byte by byte, and count once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for b in batches:
            for g, x, y, i, piece in zip(b["grp"].tolist(), b["a"].tolist(), b["b"].tolist(), b["id"].tolist(), b["piece"]):
                got = held.setdefault((g, x, y), [i, bytes(piece)])
                if got[1] != piece:
                    raise ValueError("two texts with one hash of 128 bits")
                got[0] = min(got[0], i)
        if not held:
            return
        keys, values = list(held), list(held.values())
        del held
        stats: dict = {}
        least = least_ids([v[1] for v in values], np.array([v[0] for v in values], np.int64), spill=spill, stats=stats)
        out = []
        for (g, x, y), row in zip(keys, least):
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            out.append((g, x, y, head.astype(np.int32), row[head], stats["spilled"]))
        for a in range(0, len(out), 10_000):
            yield pd.DataFrame(out[a : a + 10_000], columns=["grp", "a", "b", "from_", "least", "spilled"])

    dealt = pieces_.select("grp", "a", "b", "id", "piece").repartition(shards, "grp")
    return dealt.mapInPandas(run, "grp long, a long, b long, from_ array<int>, least array<long>, spilled long")


def repeated_spans(blocks: DataFrame) -> DataFrame:
    """Blocks to ``block, n, data``: of each block the removed spans as (document, first byte, last byte + 1), joined."""
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (16 << 20)))
    shared = shared_seeds(blocks, lambda b: block_seeds(b)[:3], _groups)
    found = stored(pieces(blocks, shared, tasks), "pieces")
    discard(shared)
    distinct = found.filter("piece is not null")
    size = distinct.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    least = stored(sorted_shards(distinct, max(1, -(-size // SHARD_BYTES)), shared_dir(spark, "queues")), "least")

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for block, doc, i, s, n, at, low in zip(b["block"].tolist(), b["doc"].tolist(), b["id"].tolist(), b["s"].tolist(), b["n"].tolist(), b["from_"], b["least"]):
                end = np.append(at[1:], n)
                for a, e in zip(at[low < i].tolist(), end[low < i].tolist()):
                    out.append((block, doc, s + a, s + e + LENGTH - 1))
            yield pd.DataFrame(out, columns=["block", "doc", "s", "e"])

    hits = found.filter("piece is null").drop("piece").join(least, ["grp", "a", "b"]).mapInPandas(spans, "block long, doc int, s long, e long")
    out = stored(hits.groupBy("block").agg(F.collect_list(F.struct("doc", "s", "e")).alias("spans")), "spans")  # a block's spans: no more than its bytes
    discard(found, least)
    return out


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of removed runs (bytes), and ``kept`` if asked for."""
    blocks = packed(docs, key, text)
    spans = repeated_spans(blocks)
    joined = blocks.join(spans, "block", "left")
    columns = [*(c.split()[0] for c in RESULT.split(", ")), "kept"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                block, of = Block(r), {}
                for x in sorted((x["doc"], x["s"], x["e"]) for x in r.spans) if r.spans is not None else ():
                    runs = of.setdefault(x[0], [])
                    if runs and x[1] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[2])
                    else:
                        runs.append([x[1], x[2]])
                out = []
                for d, (i, ok, start, size) in enumerate(zip(block.ids.tolist(), block.known.tolist(), block.starts.tolist(), block.sizes.tolist())):
                    data, kept, at = block.text[start : start + size], [], 0
                    runs = of.get(d, [])
                    for s, e in runs:
                        kept.append(data[at:s])
                        at = e
                    left = b"".join([*kept, data[at:]])
                    out.append((i if ok else None, size, size - len(left), len(runs), hashlib.sha256(left).hexdigest(), [s for s, _ in runs], [e for _, e in runs], left))
                d = pd.DataFrame(out, columns=columns)
                d["id"] = pd.array(d["id"].tolist(), "Int64")
                yield d if with_text else d.drop(columns="kept")

    return joined.mapInPandas(run, RESULT + ", kept binary" * with_text).withColumnRenamed("id", key)
