"""Documents packed in blocks, and an exchange that tells every block which of its seeds other blocks hold too.

A block is a row with the ids, sizes and compressed UTF-8 text of whole documents, about ``BLOCK_BYTES`` of text (a longer document is a block
of its own). Seeds (hashes with a place) travel packed by (block, part of the hash range), a few bytes each, in place of a row each. A block
names a seed once, with its first holder, so a frequent seed sends a row's worth a block, not a document.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from orrery.storage import stored

BLOCK_BYTES = 4 << 20
PART_BYTES = 8 << 20  # of text whose seeds are one part's on average
BLOCKS = "block long, n_bytes long, ids binary, known binary, sizes binary, texts binary"


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives freed memory back to the system at its end: workers outlive their task, and what idle ones keep is an executor's."""

    @functools.wraps(run)
    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library's
            if trim:
                trim(0)

    return out


def utf8(t: str | None) -> bytes:
    return t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""


class Block:
    """A block's documents in memory."""

    def __init__(self, row):
        self.key = int(row.block)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.known = np.frombuffer(row.known, bool)  # false: the id is null
        self.sizes = np.frombuffer(row.sizes, np.int64)
        self.text = zstandard.ZstdDecompressor().decompress(row.texts) if len(row.texts) else b""
        self.starts = np.cumsum(self.sizes) - self.sizes


def packed(docs: DataFrame, key: str, text: str, most: int = BLOCK_BYTES) -> DataFrame:
    """Rows of blocks, stored. All rows of ``docs`` are in them, whatever their ids and texts."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        known: list = []
        texts: list[bytes] = []
        size = 0

        def row() -> pd.DataFrame:
            data = b"".join(texts)
            sizes = np.array([len(x) for x in texts], np.int64)
            out = (uuid.uuid4().int >> 65, len(data), np.array(ids, np.int64).tobytes(), np.array(known, bool).tobytes(), sizes.tobytes(), zstandard.ZstdCompressor(level=3).compress(data))
            return pd.DataFrame([out], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            col = b["id"].astype("Int64")
            for i, missing, t in zip(col.fillna(0).tolist(), col.isna().tolist(), b["text"].tolist()):
                x = utf8(t)
                if texts and size + len(x) > most:
                    yield row()
                    ids, known, texts, size = [], [], [], 0
                ids.append(i)
                known.append(not missing)
                texts.append(x)
                size += len(x)
        if texts:
            yield row()

    return stored(rows.mapInPandas(run, BLOCKS), "blocks")


def _planes(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte place by byte place, so that equal high bytes compress."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


HASH_BYTES, KEY_BYTES = 6, 5
_SEEDS = "block long, part int, n long, data binary"
_WIDTHS = (HASH_BYTES, 8, 4, 1)


def shared_seeds(blocks: DataFrame, seeds: Callable[[Block], tuple], group: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``block, n, data``: of each block the seeds that two ids hold, with the group of their first holder; ``unpack`` reads them.

    ``seeds``: a block to (hash of 48 bits, document number, place) of its documents with an id. ``group``: first holder's id and place to a number.
    A part's seeds are sorted in one task; there are as many parts as the text has ``PART_BYTES``, whatever its size.
    """
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(8, -(-total // PART_BYTES))
    shift = HASH_BYTES * 8

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for r in b.itertuples():
                block = Block(r)
                h, doc, at = seeds(block)
                ids = block.ids[doc]
                if not len(h):
                    continue
                order = np.argsort(h)
                h, ids, at = h[order], ids[order], at[order].astype(np.uint64)
                new = np.append(True, h[1:] != h[:-1])
                head = np.flatnonzero(new)
                least = np.minimum.reduceat(ids, head)
                many = np.maximum.reduceat(ids, head) != least
                at = np.minimum.reduceat(np.where(ids == least[np.cumsum(new) - 1], at, np.uint64(1 << 40)), head)
                h, ids = h[head], least
                part = (h * np.uint64(parts) >> np.uint64(shift)).astype(np.int64) if parts < 1 << 15 else (h // np.uint64(-(-(1 << shift) // parts))).astype(np.int64)
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                out = []
                for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(h)]):
                    data = _planes(h[s:e], 6) + _planes(ids[s:e].view(np.uint64), 8) + _planes(at[s:e], 4) + many[s:e].tobytes()
                    out.append((block.key, int(part[s]), e - s, zip_.compress(data)))
                yield pd.DataFrame(out, columns=["block", "part", "n", "data"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zip_ = zstandard.ZstdCompressor(level=1)
        held: list = []

        def answer() -> pd.DataFrame:
            unzip = zstandard.ZstdDecompressor()
            cols: list = []
            for n, data in ((r[2], r[3]) for r in held):
                raw = unzip.decompress(data)
                cols.append((_unplanes(raw, n, 6), _unplanes(raw[6 * n :], n, 8).view(np.int64), _unplanes(raw[14 * n :], n, 4), np.frombuffer(raw, bool, n, 18 * n)))
            h, ids, at, many = (np.concatenate(c) for c in zip(*cols))
            owner = np.repeat(np.arange(len(held)), [r[2] for r in held])
            order = np.argsort(h, kind="stable")
            h, ids, at, many, owner = h[order], ids[order], at[order], many[order], owner[order]
            new = np.append(True, h[1:] != h[:-1])
            head = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            least = np.minimum.reduceat(ids, head)
            shared = (np.maximum.reduceat(many, head) | (np.maximum.reduceat(ids, head) != least))[run]
            place = np.minimum.reduceat(np.where(ids == least[run], at, np.uint64(1 << 40)), head)
            key = group(least, place)[run]
            h, key, owner = h[shared], key[shared], owner[shared]
            order = np.argsort(owner, kind="stable")
            h, key, owner = h[order], key[order], owner[order]
            cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(h) else np.zeros(0, np.int64)
            out = []
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(h)]):
                out.append((held[owner[s]][0], e - s, zip_.compress(_planes(h[s:e], HASH_BYTES) + _planes(key[s:e], KEY_BYTES))))
            return pd.DataFrame(out, columns=["block", "n", "data"])

        for b in batches:  # rows come in order of their part
            for r in b.itertuples(index=False):
                if held and held[-1][1] != r.part:
                    yield answer()
                    held = []
                held.append((r.block, r.part, int(r.n), r.data))
        if held:
            yield answer()

    sent = blocks.mapInPandas(send, _SEEDS)
    met = sent.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(meet, "block long, n long, data binary")
    return stored(met, "shared")


def with_blocks(blocks: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Rows of a block (``block, n, data``) followed by the block itself, in one task each."""
    names = [c.split() for c in BLOCKS.split(", ")]
    a = blocks.withColumns({"n": F.lit(None).cast("long"), "data": F.lit(None).cast("binary")})
    b = rows.select("block", *[F.lit(None).cast(t).alias(c) for c, t in names[1:]], "n", "data")
    both = a.select(*[c for c, _ in names], "n", "data").unionByName(b)
    return both.repartition(n, "block").sortWithinPartitions("block", F.col("n").isNull())


def each_block(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Block, list]]:
    """A block and its rows (n, data), from what ``with_blocks`` deals."""
    rows: list = []
    for b in batches:
        for r in b.itertuples():
            if r.texts is None:
                rows.append((int(r.n), r.data))
            else:
                yield Block(r), rows
                rows = []


def unpack(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and their groups."""
    unzip = zstandard.ZstdDecompressor()
    hs, ks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for n, data in rows:
        raw = unzip.decompress(data)
        hs.append(_unplanes(raw, n, HASH_BYTES))
        ks.append(_unplanes(raw[HASH_BYTES * n :], n, KEY_BYTES))
    h, k = np.concatenate(hs), np.concatenate(ks)
    order = np.argsort(h, kind="stable")
    return h[order], k[order]
