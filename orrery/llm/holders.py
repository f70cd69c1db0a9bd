"""Which earlier documents hold a seed too: packed seeds between blocks of documents that lie in order of their ids.

A block names each of its seeds once, with the first and the last of its documents that hold it. A part of the hash range sees all blocks' entries in
order of their ids and answers each: the seed's first holder of all, its last one before the block, and how many hold it. With that the block knows, for every
occurrence, the first document with the seed and the last before its own. A frequent seed sends an entry a block, never one an occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from orrery.llm.blocks import Block, _planes, _unplanes, lean, packed
from orrery.storage import stored

HASH_BYTES, PLACE_BYTES = 7, 4
BLOCK_BYTES = 2 << 20  # of text in a block
PART_BYTES = 4 << 20  # of text whose seeds are one part's on average
Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # hash, first holder and its place, last holder and its place, number of holders


def ordered_blocks(docs: DataFrame) -> DataFrame:
    """``id, text`` (ids differ) as stored blocks, each of a range of ids that no other block reaches into."""
    return packed(docs.repartitionByRange("id").sortWithinPartitions("id"), "id", "text", BLOCK_BYTES)


def in_order(h: np.ndarray) -> np.ndarray:
    """Stable order of hashes: an unstable sort, then rows of equal ones by their place."""
    order = np.argsort(h)
    s = h[order]
    same = np.append(False, s[1:] == s[:-1])[: len(s)]
    tied = np.flatnonzero(same | np.append(same[1:], False)[: len(s)])
    part = order[tied]
    order[tied] = part[np.lexsort((part, s[tied]))]
    return order


def _starts(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of (h, id): the first row of each row's seed, and of its seed and document."""
    at = np.arange(len(h))
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    own = new | np.append(True, ids[1:] != ids[:-1])[: len(h)]
    return np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(own, at, 0))


def entries(h: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> Entries:
    """A block's entries from its occurrences in order of (h, id, place)."""
    first, own = _starts(h, ids)
    head = np.flatnonzero(first == np.arange(len(h)))
    last = own[np.append(head[1:], len(h)) - 1] if len(h) else head
    return h[head], ids[head], pos[head], ids[last], pos[last], np.add.reduceat((own == np.arange(len(h))).astype(np.int64), head) if len(h) else head


def answers(held: list[Entries]) -> tuple[np.ndarray, np.ndarray, Entries]:
    """Entries of blocks in order of their ids: owner (number of the block) and, for each whose seed another block holds too, the seed's first holder, the last before it
    (for the first entry its own) and the number of holders."""
    h, f, fp, l, lp, n = (np.concatenate(c) for c in zip(*held))
    owner = np.repeat(np.arange(len(held)), [len(e[0]) for e in held])
    order = in_order(h)
    hs = h[order]
    at, again = np.arange(len(hs)), np.append(False, hs[1:] == hs[:-1])[: len(hs)]
    shared = again | np.append(again[1:], False)[: len(hs)]
    head = order[np.maximum.accumulate(np.where(again, 0, at))][shared]
    before = order[np.where(again, at - 1, at)][shared]
    total = np.add.reduceat(n[order], np.flatnonzero(~again))[np.cumsum(~again) - 1][shared] if len(hs) else n
    mine = order[shared]
    return owner[mine], mine, (hs[shared], f[head], fp[head], l[before], lp[before], total)


def pack(e: Entries) -> bytes:
    """Entries as bytes; a last holder that is the first one is a flag."""
    h, f, fp, l, lp, n = e
    two = (l != f) | (lp != fp)
    return _planes(h, HASH_BYTES) + _planes(f.view(np.uint64), 8) + _planes(fp, PLACE_BYTES) + _planes(n, PLACE_BYTES) + two.tobytes() + _planes(l[two].view(np.uint64), 8) + _planes(lp[two], PLACE_BYTES)


def unpacked(raw: bytes, n: int) -> Entries:
    at = n * HASH_BYTES
    h, f, fp = _unplanes(raw, n, HASH_BYTES), _unplanes(raw[at:], n, 8).view(np.int64), _unplanes(raw[at + 8 * n :], n, PLACE_BYTES).view(np.int64)
    at += (8 + PLACE_BYTES) * n
    many = _unplanes(raw[at:], n, PLACE_BYTES).view(np.int64)
    at += PLACE_BYTES * n
    two = np.frombuffer(raw, bool, n, at)
    m, l, lp = int(two.sum()), f.copy(), fp.copy()
    l[two] = _unplanes(raw[at + n :], m, 8).view(np.int64)
    lp[two] = _unplanes(raw[at + n + 8 * m :], m, PLACE_BYTES).view(np.int64)
    return h, f, fp, l, lp, many


_SENT = "block long, least long, part int, n long, data binary"


def told(blocks: DataFrame, occurrences: Callable[[Block], tuple]) -> DataFrame:
    """``block, n, data``: what each block is answered; ``occurrences``: a block to (hash of ``HASH_BYTES``, id, place) in order.

    An answer has the least hash of its part and, in place of hashes, their steps among the block's own of that part, which the block knows (``read``).
    A part's entries meet in one task; there are as many parts as the text has ``PART_BYTES``, whatever its size.
    """
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(8, -(-total // PART_BYTES))
    wide = np.uint64(-(-(1 << 8 * HASH_BYTES) // parts))

    @lean
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for r in b.itertuples():
                block = Block(r)
                e = entries(*occurrences(block))
                if not len(e[0]):
                    continue
                part = (e[0] // wide).astype(np.int64)
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                out = [(block.key, int(block.ids[0]), int(part[s]), t - s, zip_.compress(pack(tuple(x[s:t] for x in e)))) for s, t in zip(cut.tolist(), [*cut[1:].tolist(), len(part)])]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _SENT.split(", ")])

    @lean
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        held: list = []

        def answer() -> pd.DataFrame:
            owner, mine, found = answers([unpacked(unzip.decompress(r.data), int(r.n)) for r in held])
            order = np.argsort(owner, kind="stable")
            owner, mine, found = owner[order], mine[order], tuple(x[order] for x in found[1:])
            low = (int(held[0].part) * int(wide)).to_bytes(8, "little")
            cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
            begin = np.cumsum([0, *(int(r.n) for r in held)])
            steps = lambda s, t: np.diff(mine[s:t], prepend=begin[owner[s]]).astype(np.uint64)
            out = [(held[owner[s]].block, t - s, low + zip_.compress(pack((steps(s, t), *(x[s:t] for x in found))))) for s, t in zip(cut.tolist(), [*cut[1:].tolist(), len(owner)])]
            return pd.DataFrame(out, columns=["block", "n", "data"])

        for b in batches:  # rows come in order of their part, and in it of their ids
            for r in b.itertuples(index=False):
                if held and held[-1].part != r.part:
                    yield answer()
                    held = []
                held.append(r)
        if held:
            yield answer()

    sent = blocks.mapInPandas(send, _SENT)
    met = sent.repartition(parts, "part").sortWithinPartitions("part", "least").mapInPandas(meet, "block long, n long, data binary")
    return stored(met, "told")


def read(rows: list, h: np.ndarray) -> Entries:
    """A block's answers in order of their hashes; ``h``: of all its occurrences, in order."""
    unzip = zstandard.ZstdDecompressor()
    own = h[np.append(True, h[1:] != h[:-1])[: len(h)]]

    def entries_of(n: int, data: bytes) -> Entries:
        steps, *rest = unpacked(unzip.decompress(data[8:]), n)
        return own[np.searchsorted(own, np.frombuffer(data, np.uint64, 1)) + np.cumsum(steps.view(np.int64))], *rest

    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(5)))
    got = [np.concatenate(c) for c in zip(none, *(entries_of(int(n), data) for n, data in rows))]
    order = np.argsort(got[0], kind="stable")
    return tuple(x[order] for x in got)


def earlier(h: np.ndarray, ids: np.ndarray, pos: np.ndarray, known: Entries) -> tuple[np.ndarray, Entries]:
    """Of a block's occurrences in order: the rows whose seed an earlier document holds, and for those the hash, the first such document, the last, and their places."""
    if not len(h):
        return np.zeros(0, np.int64), (h, ids, pos, ids, pos)
    head, own = _starts(h, ids)
    inside = own > head  # an earlier document of this block holds the seed
    before = own[np.maximum(own - 1, 0)]
    first, fp, last, lp = ids[head], pos[head], ids[before], pos[before]
    is_told = np.zeros(len(h), bool)
    if len(known[0]):
        k = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
        is_told = known[0][k] == h
        first, fp = np.where(is_told, known[1][k], first), np.where(is_told, known[2][k], fp)
        last, lp = np.where(inside, last, known[3][k]), np.where(inside, lp, known[4][k])
    rows = np.flatnonzero(inside | is_told & (first != ids))
    return rows, (h[rows], first[rows], fp[rows], last[rows], lp[rows])


def held_by(h: np.ndarray, ids: np.ndarray, known: Entries) -> np.ndarray:
    """How many documents hold the seed of each of a block's occurrences in order."""
    if not len(h):
        return np.zeros(0, np.int64)
    head, own = _starts(h, ids)
    at = np.arange(len(h))
    out = np.add.reduceat((own == at).astype(np.int64), np.flatnonzero(head == at))[np.cumsum(head == at) - 1]
    if len(known[0]):
        k = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
        out = np.where(known[0][k] == h, known[5][k], out)
    return out
