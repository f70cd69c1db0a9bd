"""Fuzzy repeated passages by collinear chaining.

1. Seeds: winnowed k-mers of words (the least hash of every ``SPREAD`` neighbouring k-mers), so two texts that share
   ``K + SPREAD - 1`` words in a row (as a passage of ``MIN_WORDS`` at ``IDENTITY`` always has) share a seed wherever the run stands; likewise long seeds of ``LONG`` words, one at least
   in every ``MIN_WORDS`` words.
2. Each occurrence of a short seed matches the first document that has the seed, if that is an earlier one; never all pairs of a
   frequent seed. This holder may share little else. So what no part of ``MIN_WORDS`` covers after steps 3 and 4 goes through them
   again, with other matches: of short seeds the last earlier document that has the seed, of long seeds the first and the last.
   Holders of a long seed share ``LONG`` words, so every exact run of ``MIN_WORDS`` meets documents that hold most of it.
   At last every other two holders of a short seed are compared (``all_holders``), but for places that the passages found put in one class already. Where the chains of such a pair
   give no part of ``MIN_WORDS``, all seeds of the words fetched for them are chained, those that too many documents hold among them.
3. The matches of a (document, anchor document) pair are chained in order: each takes the best predecessor below it in both texts,
   less a gap cost for the words skipped in either, found in a Fenwick tree of prefix maxima over anchor positions.
4. The words of both sides of each chain are fetched, and the stretches between its seeds are aligned; ends grow while words agree.
   Then they grow over single differing words. Chains of ``IDENTITY`` or more stay; others are cut at their worst links, and their parts are judged alike.
5. A document's passages are the runs that its chains cover together, so a passage whose seeds are first met in different
   documents is whole; runs of ``MIN_WORDS`` or more are reported, by document (``passages``) or with a row for every
   chain in them, so for each pair of documents (``pairs``).

Results in the odd cases: null or empty text has no words and no passages; rows that repeat an id are one document that holds all their different texts, in order (places are in their join);
null ids are never anchors and get no passages; an empty table gives no rows; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from orrery.llm import all_holders
from orrery.llm.blocks import Block, _planes, _unplanes, each_block, lean, utf8, with_blocks
from orrery.llm.holders import HASH_BYTES, Entries, earlier, held_by, in_order, ordered_blocks, read, told
from orrery.storage import discard, stored

K, SPREAD = 4, 1  # 40 words with 8 of them changed have 4 unchanged ones in a row
MIN_WORDS, IDENTITY = 40, 0.8
LONG, LONG_SPREAD = 24, 17
GAP_COST = 0.05  # of a word, for each word skipped on either side
LEAST_CHAIN = 5.0
LEAST_SEEDS = MIN_WORDS - K + 1 - K * round(MIN_WORDS * (1 - IDENTITY))  # that a passage of MIN_WORDS at IDENTITY shares: each changed word spoils K
MARGIN, WIDER = MIN_WORDS, 16
_SKIPS = sorted(((x, y) for x in range(5) for y in range(5) if x or y), key=lambda s: (max(s), s[0] != s[1]))
LONG_WORD = 64  # bytes; longer words are hashed one by one
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """32-bit hashes of the words, case of A-Z apart."""
    return hashed(utf8(text))[0]


def hashed(data: bytes, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and where they begin; no word goes over ``starts`` of documents."""
    low = np.frombuffer(data.lower(), np.uint8)
    if not len(low):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _IN_WORD[low]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    if starts is not None:
        at = starts[starts < len(low)]
        begin[at] = inside[at]
    end = inside
    end[:-1] &= ~inside[1:] | begin[1:]
    s = np.flatnonzero(begin)
    n = np.flatnonzero(end) + 1 - s
    h, live = np.full(len(s), len(_IN_WORD), np.uint64), np.arange(len(s))
    for i in range(LONG_WORD):
        live = live[n[live] > i] if i else live
        if not len(live):
            break
        h[live] = (h[live] ^ low[s[live] + i]) * np.uint64(_BASE)
    for j in np.flatnonzero(n > LONG_WORD).tolist():
        h[j] ^= np.uint64(zlib.crc32(low[s[j] : s[j] + n[j]]))
    return _mix(h) >> np.uint64(32), s


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; those of ordinary texts are kept."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 12), base, np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if len(p) <= 1 << 20:
            _powers[base] = p
    return p[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def seeds_of(words: np.ndarray, k: int = K, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the winnowed k-mers."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((words + np.uint64(1)) * _power(_BASE, len(words)), out=s[1:])
    h = _mix((s[k:] - s[:-k]) * _power(_INVERSE, n))
    m = min(spread, n)
    if m == 1:
        return h.view(np.int64), np.arange(n)
    if n < 1 << 24:  # high bits of the hash, then the place: one minimum gives the leftmost least
        width, least = 1, h >> np.uint64(24) << np.uint64(24) | np.arange(n, dtype=np.uint64)
        while width * 2 <= m:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < m:
            least = np.minimum(least[: n - m + 1], least[m - width :])
        pos = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:
        windows = np.lib.stride_tricks.sliding_window_view(h >> np.uint64(24), m)
        pos = windows.argmin(1) + np.arange(len(windows))
    pos = pos[np.append(True, pos[1:] != pos[:-1])]
    return h[pos].view(np.int64), pos


class Fenwick:
    """Prefix maxima of (score, index) over ranks."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def below(self, i: int) -> tuple[float, int]:
        """Over ranks 0 .. i-1."""
        out = (float("-inf"), -1)
        while i:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(pos: np.ndarray, apos: np.ndarray, k: int = K, gap: float = GAP_COST, least: float = LEAST_CHAIN) -> list[list[int]]:
    """Best disjoint chains as lists of match indices; ``pos`` ascends. A match scores the k words it adds; overlap with its
    predecessor is taken off with the gap cost."""
    n = len(pos)
    rising = n < 2 or bool((np.diff(pos) > 0).all() and (np.diff(apos) > 0).all())
    if rising and n:
        dp, dq = np.diff(pos), np.diff(apos)
        sums = np.append(0.0, np.cumsum(np.minimum(k, np.minimum(dp, dq)) - gap * (dp + dq)))
        if (sums[1:] > 0).all():  # every match is best taken after the one before: one chain up to the greatest score
            end = int(sums.argmax())
            return [list(range(end + 1))] if k + sums[end] >= least else []
    rank = [] if rising else np.unique(apos, return_inverse=True)[1].tolist()
    tree, score, prev = Fenwick(0 if rising else max(rank) + 1), [0.0] * n, [-1] * n
    pos, apos = pos.tolist(), apos.tolist()
    wait: list[int] = []  # matches at the current position are not each other's predecessors
    for j in range(n):
        if rising:  # score + gap * (pos + apos) grows with every match, so the maximum below a match is the one before
            got, i = (score[j - 1] + gap * (pos[j - 1] + apos[j - 1]), j - 1) if j else (float("-inf"), -1)
        else:
            if wait and pos[wait[0]] != pos[j]:
                for i in wait:
                    tree.put(rank[i], (score[i] + gap * (pos[i] + apos[i]), i))
                wait = []
            got, i = tree.below(rank[j])
            wait.append(j)
        take = float("-inf")
        if i >= 0:
            new = min(k, pos[j] - pos[i], apos[j] - apos[i])
            take = got - gap * (pos[j] + apos[j]) + new
        score[j], prev[j] = (take, i) if take > k else (float(k), -1)
    out, used = [], [False] * n
    for j in sorted(range(n), key=lambda x: (-score[x], x)):
        if score[j] < least or used[j]:
            continue
        c, i = [], j
        while i >= 0 and not used[i]:
            used[i] = True
            c.append(i)
            i = prev[i]
        if score[j] - (score[i] if i >= 0 else 0.0) >= least:
            out.append(c[::-1])
    return out


def equal_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common order (longest common subsequence) of two stretches of any length: a row of the table is one integer's bits."""
    n = len(a)
    if n == len(b) and (a == b).all():
        return n
    if not n or not len(b):
        return 0
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << n) - 1
    row = full
    for y in b.tolist():
        u = row & at.get(y, 0)
        if u:
            row = (row + u | row - u) & full
    return n - row.bit_count()


def _links(a: np.ndarray, b: np.ndarray, pos: np.ndarray, apos: np.ndarray, k: int) -> tuple[list[int], list[float]]:
    """Equal words from each seed of a chain to the next, and what they gain: those less ``IDENTITY`` of all words there."""
    dp, dq = np.diff(pos), np.diff(apos)
    over = np.minimum(k, np.minimum(dp, dq))
    equal = over.tolist()
    for i in np.flatnonzero(np.maximum(dp, dq) > over).tolist():
        p, q, at = int(pos[i]), int(apos[i]), equal[i]
        equal[i] += equal_words(a[p + at : p + int(dp[i])], b[q + at : q + int(dq[i])])
    return equal, (np.array(equal, np.float64) - IDENTITY * np.maximum(dp, dq)).tolist()


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words before the first differing one."""
    other = a != b
    n = int(other.argmax()) if len(other) else 0
    return n if len(other) and other[n] else len(other)


def _whole(a: np.ndarray, b: np.ndarray, pos: np.ndarray, apos: np.ndarray, equal: list[int], k: int) -> tuple[int, int, int, int, float]:
    """A chain with its ends grown while words agree."""
    s, t, e, f = int(pos[0]), int(apos[0]), int(pos[-1]) + k, int(apos[-1]) + k
    same = k + sum(equal)
    n = min(s, t)
    n = _agree(a[s - n : s][::-1], b[t - n : t][::-1])
    s, t, same = s - n, t - n, same + n
    n = min(len(a) - e, len(b) - f)
    n = _agree(a[e : e + n], b[f : f + n])
    e, f, same = e + n, f + n, same + n
    return s, e, t, f, min(1.0, same / max(e - s, f - t))


def align(a: np.ndarray, b: np.ndarray, pos: np.ndarray, apos: np.ndarray, k: int = K) -> tuple[int, int, int, int, float]:
    """Aligned range of both texts and the share of equal words; a, b: words, pos, apos: chain in them."""
    return _whole(a, b, pos, apos, _links(a, b, pos, apos, k)[0], k)


def grow(a: list, b: list, same: float, size: int) -> tuple[int, int, int]:
    """Words of both texts, and equal ones, that an end gains over differing words, while two words in three and ``IDENTITY`` of all are equal."""
    i = j = got = score = best = 0
    out = (0, 0, 0)
    while True:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j, got, score = i + 1, j + 1, got + 1, score + 1
        if score > best:
            best = score
            if same + got >= IDENTITY * (size + max(i, j)):
                out = (i, j, got)
        skip = next(((x, y) for x, y in _SKIPS if a[i + x : i + x + 2] == b[j + y : j + y + 2] and i + x + 1 < len(a) and j + y + 1 < len(b)), None)
        if skip is None or score - 2 * max(skip) < best - 8:
            return out
        i, j, score = i + skip[0], j + skip[1], score - 2 * max(skip)


def _grown(a: np.ndarray, b: np.ndarray, s: int, e: int, t: int, f: int, share: float) -> tuple[int, int, int, int, float]:
    size = max(e - s, f - t)
    same = share * size
    x, y, n = grow(a[:s][::-1].tolist(), b[:t][::-1].tolist(), same, size)
    s, t, same = s - x, t - y, same + n
    x, y, n = grow(a[e:].tolist(), b[f:].tolist(), same, max(e - s, f - t))
    e, f, same = e + x, f + y, same + n
    return s, e, t, f, min(1.0, same / max(e - s, f - t))


def parts(a: np.ndarray, b: np.ndarray, pos: np.ndarray, apos: np.ndarray, k: int = K) -> list[tuple[int, int, int, int, float]]:
    """Aligned ranges of ``IDENTITY`` or more, grown over differing words: the chain, or, if it has less, what is left and right of its worst link, and so on."""
    equal, gain = _links(a, b, pos, apos, k)
    out, todo = [], [(0, len(pos))]
    while todo:
        i, j = todo.pop()
        got = _whole(a, b, pos[i:j], apos[i:j], equal[i : j - 1], k)
        if got[4] >= IDENTITY:
            got = _grown(a, b, *got)
            if got not in out:
                out.append(got)
        elif j - i > 1:
            cut = min(range(i, j - 1), key=gain.__getitem__) + 1
            todo += [(cut, j), (i, cut)]
    return out


def shared(a: np.ndarray, b: np.ndarray, pos: np.ndarray, apos: np.ndarray, least: int = LEAST_SEEDS) -> np.ndarray:
    """Rows (place in a, in b) of all seeds that both stretches hold, at most ``MARGIN`` words off the chain's diagonals; none if fewer than ``least`` seeds of a are in b."""
    g, h = (_grams(w.astype(np.uint64)) for w in (a, b))
    held = np.sort(h)
    p = np.flatnonzero(held[np.minimum(np.searchsorted(held, g), len(held) - 1)] == g) if len(held) else np.zeros(0, np.int64)
    if len(p) < max(least, 1):
        return np.zeros((0, 2), np.int64)
    held, rank = np.unique(h, return_inverse=True)
    wide = len(h) + 1
    at = np.sort(rank * wide + np.arange(len(h)))
    off, base = apos - pos, np.searchsorted(held, g[p]) * wide
    lo = np.searchsorted(at, base + np.clip(p + off.min() - MARGIN, 0, len(h)))
    n = np.searchsorted(at, base + np.clip(p + off.max() + MARGIN + 1, 0, len(h))) - lo
    q = at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())] % wide
    return np.column_stack([np.repeat(p, n), q])


def _grams(words: np.ndarray, k: int = K) -> np.ndarray:
    """Sums that tell runs of k words apart, one from each word on."""
    n = max(len(words) - k + 1, 0)
    out = words[:n]
    for i in range(1, k):
        out = out * np.uint64(_BASE) + words[i : n + i]
    return out


def words_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's words, and where each document's begin, and the end."""
    words, begin = hashed(block.text, block.starts)
    return words, np.searchsorted(begin, [*block.starts.tolist(), len(block.text)])


def occurrences(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of a block's documents, in order of (hash, id, place); the lowest bit of a hash marks long seeds."""
    hs, docs, ps = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    words, cut = words_of(block)
    cut = cut.tolist()
    for d in range(len(block.ids)):
        w = words[cut[d] : cut[d + 1]]
        for long, (h, p) in enumerate((seeds_of(w, K, SPREAD), seeds_of(w, LONG, LONG_SPREAD))):
            hs.append(h.view(np.uint64) >> np.uint64(64 - 8 * HASH_BYTES) & ~np.uint64(1) | np.uint64(long))
            docs.append(np.full(len(h), d, np.int64))
            ps.append(p)
    h, doc, pos = np.concatenate(hs), np.concatenate(docs), np.concatenate(ps)
    order = in_order(h)
    return h[order], block.ids[doc[order]], pos[order]


def matches_of(h: np.ndarray, ids: np.ndarray, pos: np.ndarray, known: Entries, got: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Matches (id, anchor, pos, apos) of a block's occurrences in order: with the first holders of short seeds; with the last before, and both of long seeds.
    ``got``: what ``earlier`` has returned."""
    rows, (h, first, fp, last, lp) = got or earlier(h, ids, pos, known)
    ids, pos = ids[rows], pos[rows]
    long, two = (h & np.uint64(1)).astype(bool), last != first
    steps = np.arange(0, LONG - K + 1, K)
    pick = lambda on, a, ap: np.column_stack([ids[on], a[on], pos[on], ap[on]])
    spread = lambda x: (x[:, None, :] + np.column_stack([0 * steps, 0 * steps, steps, steps])).reshape(-1, 4)
    again = [pick(two & ~long, last, lp), spread(pick(long, first, fp)), spread(pick(long & two, last, lp))]
    return pick(~long, first, fp), np.concatenate(again)


def in_pairs(x: np.ndarray) -> np.ndarray:
    """Rows (id, anchor, pos, apos) in order and without repeats; pairs of one match have too little for a chain and go."""
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    new = np.append(True, (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1]))[: len(x)]
    x = x[~(new & np.append(new[1:], True)[: len(x)])]
    x = x[np.lexsort((x[:, 3], x[:, 2], x[:, 1], x[:, 0]))]
    x = x[np.append(True, (x[1:] != x[:-1]).any(1))[: len(x)]]
    new = np.append(True, (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1]))[: len(x)]
    return x[~(new & np.append(new[1:], True)[: len(x)])]


def by_pair(x: np.ndarray) -> list[np.ndarray]:
    """Rows (id, anchor, pos, apos) in pairs' order, a part a pair."""
    return np.split(x, np.flatnonzero((x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])) + 1) if len(x) else []


def thinned(x: np.ndarray, least: float = LEAST_CHAIN) -> np.ndarray:
    """A pair's matches; of those in step (next words of both texts) every K-th and the last. None if too few are left."""
    x = x[np.lexsort((x[:, 2], x[:, 3] - x[:, 2]))]
    new = np.append(True, (x[1:, 3] - x[1:, 2] != x[:-1, 3] - x[:-1, 2]) | (x[1:, 2] != x[:-1, 2] + 1))[: len(x)]
    at = np.arange(len(x))
    x = x[((at - np.maximum.accumulate(np.where(new, at, 0))) % K == 0) | np.append(new[1:], True)[: len(x)]]
    return x[np.lexsort((x[:, 3], x[:, 2]))] if len(x) * K >= least else x[:0]


CHAINS = "id long, anchor long, chain int, s int, e int, t int, f int, pos array<int>, apos array<int>"


def pair_chains(x: np.ndarray, least: float = LEAST_CHAIN) -> list[tuple]:
    """Rows of ``CHAINS`` of one pair's matches."""
    if not len(x):
        return []
    x = thinned(x, least)
    p, q = x[:, 2], x[:, 3]
    return [(int(x[0, 0]), int(x[0, 1]), n, p[c[0]], p[c[-1]] + K, q[c[0]], q[c[-1]] + K, p[c].astype(np.int32), q[c].astype(np.int32)) for n, c in enumerate(chains(p, q, least=least) if len(x) else [])]


def chain_table(blocks: DataFrame) -> DataFrame:
    """Blocks to chains with the seeds' first holders, a row of each document's other matches (``again``: packed anchors and places, n of them), and one of
    the keys under which it meets all other holders (``rest``) of seeds with more than two; of seeds with two, its matches (``two``, n of them) with the first."""
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (16 << 20)))
    names = [c.split()[0] for c in CHAINS.split(", ")] + ["n", "again", "rest", "two"]

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for block, rows in each_block(batches):
            seeds = occurrences(block)
            known = read(rows, seeds[0])
            got, n = earlier(*seeds, known), held_by(seeds[0], seeds[1], known)
            first, again = matches_of(*seeds, known, got)
            two = first[n[got[0]][got[1][0] & np.uint64(1) == 0] == 2]
            out = []
            for x in by_pair(in_pairs(first)):
                out += [(*c, None, None, None, None) for c in pair_chains(x)]
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            x = in_pairs(again)
            cut = np.flatnonzero(np.append(True, x[1:, 0] != x[:-1, 0])[: len(x)])
            for a, e in zip(cut.tolist(), [*cut[1:].tolist(), len(x)]):
                data = zip_.compress(_planes(x[a:e, 1], 8) + _planes(x[a:e, 2], 4) + _planes(x[a:e, 3] - x[a:e, 2], 8))
                out.append((int(x[a, 0]), *[None] * 8, e - a, data, None, None))
            for i, m, data in _keys(block, *seeds, n):
                out.append((i, *[None] * 8, m, None, zip_.compress(data), None))
            two = two[np.lexsort((two[:, 2], two[:, 3] - two[:, 2], two[:, 1], two[:, 0]))]
            cut = np.flatnonzero(np.append(True, two[1:, 0] != two[:-1, 0])[: len(two)])
            for a, e in zip(cut.tolist(), [*cut[1:].tolist(), len(two)]):
                out.append((int(two[a, 0]), *[None] * 8, e - a, None, None, zip_.compress(all_holders.pack_matches(two[a:e, 1:]))))
            yield _nullable(pd.DataFrame(out, columns=names))

    answered = told(blocks, occurrences)
    out = stored(with_blocks(blocks, answered, tasks).mapInPandas(run, CHAINS + ", n int, again binary, rest binary, two binary"), "chains")
    discard(answered)
    return out


def _keys(block: Block, h: np.ndarray, ids: np.ndarray, pos: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Of each document of a block its id, and the number and packed rows of its keys in ``all_holders``; ``n``: holders of each seed."""
    on = np.flatnonzero((n > 2) & (h & np.uint64(1) == 0))
    if not len(on):
        return
    words, cut = words_of(block)
    doc = np.searchsorted(block.ids, ids[on])
    order = np.argsort(cut[doc] + pos[on])
    on, doc = on[order], doc[order]
    exact = seeds_of(words, MIN_WORDS, 1)[0].view(np.uint64)
    done = 0
    for stop in (np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1).tolist():  # whole documents, some seeds at a time
        if stop - done < KEYED and stop < len(doc):
            continue
        o, d, done = on[done:stop], doc[done:stop], stop
        row, key, sign, flag = all_holders.keys_of(h[o], n[o], cut[d] + pos[o], cut[d], cut[d + 1], words, exact, K, MIN_WORDS)
        order = np.argsort(row, kind="stable")
        row, key, sign, flag = row[order], key[order], sign[order], flag[order]
        of = d[row]
        head = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
        for s, e in zip(head.tolist(), [*head[1:].tolist(), len(of)]):
            yield int(block.ids[of[s]]), e - s, all_holders.pack(key[s:e], pos[o][row[s:e]], sign[s:e], flag[s:e])


KEYED = 1 << 15  # seeds, whose keys are made at once


def _nullable(d: pd.DataFrame) -> pd.DataFrame:
    whole = ("chain", "s", "e", "t", "f", "n")
    return d.assign(**{c: pd.array([None if v is None or v != v else int(v) for v in d[c].tolist()], "Int32") for c in whole})


def chains_of_rest(rows: DataFrame) -> DataFrame:
    """``id, n, again, spans`` to chains of the matches that no span covers."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for i, n, data, spans in zip(b["id"].tolist(), b["n"].tolist(), b["again"], b["spans"]):
                raw = unzip.decompress(data)
                anchor, pos, off = _unplanes(raw, n, 8).view(np.int64), _unplanes(raw[8 * n :], n, 4).view(np.int64), _unplanes(raw[12 * n :], n, 8).view(np.int64)
                x = np.column_stack([np.full(n, i), anchor, pos, pos + off])
                if spans is not None and len(spans):
                    x = x[~covered(pos, spans)]
                for pair in by_pair(x):
                    if len(pair) > 1:
                        out += pair_chains(pair)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHAINS.split(", ")])

    return rows.mapInPandas(run, CHAINS)


def covered(pos: np.ndarray, spans) -> np.ndarray:
    """Whether the K words from each place on are in one of the spans."""
    s = np.array(sorted((x["start"], x["end"]) for x in spans), np.int64)
    furthest = np.maximum.accumulate(s[:, 1])
    k = np.searchsorted(s[:, 0], pos, "right") - 1
    return (k >= 0) & (furthest[k] >= pos + K)


ASKED = 1000  # requests on average that one copy of a text answers


def fetch(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """``id, text`` and requests (id, doc, other, chain, role, start, end) to requests with ``n_words`` and ``words``: hashes of that range.

    A text travels with a list of requests; an id of many requests has many lists, dealt by hash.
    """
    names = [c for c in requests.columns if c != "id"]
    lists = requests.groupBy("id").agg(F.ceil(F.count("*") / ASKED).alias("lists"))
    dealt = requests.join(lists, "id").groupBy("id", F.pmod(F.xxhash64("doc", "other", "chain"), F.col("lists")).alias("list")).agg(F.collect_list(F.struct(*names)).alias("asked"))
    types = dict(requests.dtypes)
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", n_words int, words binary"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(1)
            cut = asked.offsets.to_numpy()
            cut, flat = cut - cut[0], asked.flatten()
            start, end = (flat.field(c).to_numpy().tolist() for c in ("start", "end"))
            sizes: list[int] = []
            got: list[bytes] = []
            done = 0

            def rows() -> pa.RecordBatch:
                part = flat.slice(done, len(got))
                return pa.RecordBatch.from_arrays([*(part.field(n) for n in names), pa.array(sizes, pa.int32()), pa.array(got, pa.binary())], names=[*names, "n_words", "words"])

            for i, t in enumerate(b.column(0)):
                words = word_hashes(t.as_py()).astype("<u4")
                raw = words.tobytes()
                for j in range(cut[i], cut[i + 1]):
                    sizes.append(len(words))
                    got.append(raw[4 * start[j] : 4 * end[j]])
                    if len(got) == 2000:
                        yield rows()
                        sizes, got, done = [], [], done + 2000
            if got:
                yield rows()

    return dealt.join(docs, "id").select("text", "asked").mapInArrow(run, schema)


def _distinct(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, text``: rows that share an id are one document of all their different texts, in order, with a word between them that no text repeats."""
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    if not _repeats(docs, key):
        return rows
    texts = rows.groupBy("id").agg(F.array_sort(F.collect_set("text")).alias("t"))
    return texts.select("id", F.expr("array_join(t, concat(' |id:', id, '| '))").alias("text"))


PARTS = "id long, start int, end int, other_id long, other_start int, identity double, other_end int"


def _aligned(base: DataFrame, found: DataFrame, again: bool = False) -> DataFrame:
    """Stored chains (``CHAINS``) to parts of them: id, start, end, other_id, other_start, identity.

    Words are fetched with a margin of 1.5 times the chain: over differing words, two in three equal, an end that keeps ``IDENTITY`` of all can gain no more.
    Where an end comes to the border of what was fetched (by equal words whose seeds are with other documents), the chain is aligned again with a wider
    margin, until none is left. ``again``: if no part has ``MIN_WORDS``, all seeds that both stretches share are chained, for those of many
    holders may be without a match, and parts of chains with one of the given seeds count too.
    """
    done: list[DataFrame] = []
    margin = MARGIN
    while True:
        got = stored(_with_margin(base, found, margin, again), "parts")
        done.append(got.filter("not near").select(*[c.split()[0] for c in PARTS.split(", ")]))
        open_ = got.filter("near").select("id", F.col("other_id").alias("anchor"), "chain").distinct()
        if not open_.limit(1).count():
            break
        found, margin = stored(found.join(open_, ["id", "anchor", "chain"], "left_semi"), "open"), margin * WIDER
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _with_margin(base: DataFrame, found: DataFrame, margin: int, again: bool) -> DataFrame:
    more = (F.greatest(F.col("e") - F.col("s"), F.col("f") - F.col("t")) * 1.5).cast("int") + margin
    side = lambda who, s, e, role: found.select(F.col(who).alias("id"), F.greatest(F.col(s) - more, F.lit(0)).alias("start"), (F.col(e) + more).alias("end"), F.col("id").alias("doc"), F.col("anchor").alias("other"), "chain", F.lit(role).alias("role"))
    words = fetch(base, side("id", "s", "e", 0).unionByName(side("anchor", "t", "f", 1)))
    pick = lambda role, c: F.first(F.when(F.col("role") == role, F.col(c)), ignorenulls=True)
    both = words.groupBy("doc", "other", "chain").agg(*[pick(r, c).alias(n) for r, x in ((0, "a"), (1, "b")) for c, n in (("words", x), ("start", f"{x}0"), ("n_words", f"{x}n"))])
    ready = found.select(F.col("id").alias("doc"), F.col("anchor").alias("other"), "chain", "pos", "apos").join(both, ["doc", "other", "chain"])
    columns = [*(c.split()[0] for c in PARTS.split(", ")), "chain", "near"]

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for d, o, n, p, q, a, a0, an, b, b0, bn in g[["doc", "other", "chain", "pos", "apos", "a", "a0", "an", "b", "b0", "bn"]].itertuples(index=False):
                x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                p, q = np.asarray(p, np.int64) - a0, np.asarray(q, np.int64) - b0
                got = parts(x, y, p, q)
                if again and all(e - s < MIN_WORDS for s, e, *_ in got) and len(m := shared(x, y, p, q)) >= LEAST_SEEDS:
                    own = np.isin(m[:, 0] * len(y) + m[:, 1], p * len(y) + q)
                    for c in (c for c in chains(m[:, 0], m[:, 1]) if len(c) >= LEAST_SEEDS and own[c].any()):
                        got += [r for r in parts(x, y, m[c, 0], m[c, 1]) if r not in got]
                near = any(_at_border(s, e, a0, an, len(x)) or _at_border(t, f, b0, bn, len(y)) for s, e, t, f, _ in got)
                for s, e, t, f, same in got:
                    out.append((d, s + a0, e + a0, o, t + b0, float(same), f + b0, n, near))
            yield pd.DataFrame(out, columns=columns)

    return ready.mapInPandas(run, PARTS + ", chain int, near boolean")


def _at_border(start: int, end: int, skipped: int, n_words: int, n: int) -> bool:
    """Whether a range of the n words fetched (the text has ``n_words``, ``skipped`` of them before) ends at a side beyond which the text goes on."""
    return (skipped > 0 and start == 0) or (skipped + n < n_words and end == n)


def _chains_of(x: np.ndarray, near: bool) -> list[tuple]:
    """Chains of a pair's matches; of a single one, if seeds that too many hold to be listed are near."""
    return pair_chains(x, K if near else LEAST_CHAIN)


def _reported(base: DataFrame) -> DataFrame:
    """Per document with a passage: id, n_repeated, n_passages, passages, chains."""
    blocks = ordered_blocks(base)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    found = chain_table(blocks)
    discard(blocks)
    first = _aligned(base, found.filter("n is null").drop("n", "again", "rest", "two"))
    settled = first.filter(F.col("end") - F.col("start") >= MIN_WORDS).groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rest = stored(chains_of_rest(found.filter("again is not null").select("id", "n", "again").join(settled, "id", "left")), "rest")
    aligned = first.unionByName(_aligned(base, rest))
    long = F.col("end") - F.col("start") >= MIN_WORDS
    spans = aligned.filter(long).groupBy("id").agg(F.collect_set(F.struct("other_id", "start", "end")).alias("spans"))
    two = found.filter("two is not null").select("id", "n", "two").join(spans, "id", "left")
    others = all_holders.chained(found.filter("rest is not null").select("id", "n", "rest"), all_holders.classes(aligned.filter(long)), two, total, K, LEAST_SEEDS, _chains_of, CHAINS)
    others = stored(others, "others")
    discard(found)
    more = _aligned(base, others, again=True).filter(long)  # chains of a pair may grow to one passage
    aligned = aligned.unionByName(more.groupBy(*[c for c in more.columns if c != "identity"]).agg(F.max("identity").alias("identity")))
    per = aligned.groupBy("id").agg(F.collect_list(F.struct("start", "end", "other_id", "other_start", "identity")).alias("c"))
    return _runs(per)


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per distinct id: key, n_repeated (words), n_passages, passages (start and end word, other document and its start, identity)."""
    base = _distinct(docs, key, text)
    out, zero = base.select("id").join(_reported(base).drop("chains"), "id", "left"), F.lit(0).cast("long")
    return out.select(F.col("id").alias(key), F.coalesce("n_repeated", zero).alias("n_repeated"), F.coalesce("n_passages", zero).alias("n_passages"), "passages")


def pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every aligned chain within a passage: key, other_id (an earlier document), words start to end there and other_start, identity."""
    rows = _reported(_distinct(docs, key, text)).select("id", F.explode("chains").alias("c"))
    return rows.select(F.col("id").alias(key), "c.other_id", "c.start", "c.end", "c.other_start", "c.identity")


def _repeats(docs: DataFrame, key: str) -> bool:
    """Whether an id occurs twice; ids alone are shuffled."""
    return bool(docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).count())


_P = "array<struct<start:int,end:int,other_id:long,other_start:int,identity:double>>"


def _runs(per: DataFrame) -> DataFrame:
    """``id, c`` (chains) to ``id, n_repeated, n_passages, passages, chains`` of documents with a passage: runs covered by overlapping or touching spans, with the longest span's partner, and the chains in them.

    Columns stay Arrow's: as Python objects a batch of many chains is many times as large.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = b.column(1).offsets.to_numpy()
            flat, cut = b.column(1).flatten(), cut - cut[0]
            start, end = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "end"))
            doc = np.repeat(np.arange(len(b)), np.diff(cut))
            head, order, run_, long = merged(doc, *(flat.field(c).to_numpy() for c in ("start", "end", "other_id", "other_start", "identity")))
            s, e = start[order[head]], np.maximum.reduceat(end[order], head) if len(head) else head
            kept = np.flatnonzero(e - s >= MIN_WORDS)
            within = np.sort(order[np.isin(run_, kept)])
            of_run = doc[order[head[kept]]]
            who, partner = np.unique(of_run), flat.take(pa.array(long[kept]))
            found = pa.StructArray.from_arrays([pa.array(s[kept], pa.int32()), pa.array(e[kept], pa.int32()), *(partner.field(c) for c in ("other_id", "other_start", "identity"))], fields=list(flat.type))
            lists = lambda x, of: pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(of, who), len(of)), pa.int32()), x)
            words = np.bincount(of_run, weights=e[kept] - s[kept], minlength=len(b))[who]
            columns = [b.column(0).take(pa.array(who)), pa.array(words, pa.int64()), pa.array(np.bincount(of_run, minlength=len(b))[who], pa.int64()), lists(found, of_run), lists(flat.take(pa.array(within)), doc[within])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_repeated", "n_passages", "passages", "chains"])

    return per.mapInArrow(run, f"id long, n_repeated long, n_passages long, passages {_P}, chains {_P}")


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray, *partner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of overlapping or touching spans of many documents: the first place of each in the order of spans, that order, the run of each place, and each run's longest span (of equal ones the first)."""
    order = np.lexsort((*partner[::-1], end, start, doc))
    d, s, e = (x[order].astype(np.int64) for x in (doc, start, end))
    wide = int(e.max()) + 1 if len(e) else 1
    top = np.maximum.accumulate(d * wide + e) - d * wide  # the furthest end of the document so far
    new = np.append(True, (d[1:] != d[:-1]) | (s[1:] > top[:-1]))[: len(d)]
    head, run = np.flatnonzero(new), np.cumsum(new) - 1
    longest = np.lexsort((np.arange(len(d)), s - e, run))
    return head, order, run, order[longest[head]]
