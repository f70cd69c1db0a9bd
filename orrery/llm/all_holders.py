"""All holders of a seed, two by two, but for those whose places are in one class of passages already.

Passages that are reported (both sides of each) are joined where they overlap in a document; what reported pairs connect is a class (``classes``). A
place in no passage is a class of its document's own. Two holders of a seed are compared unless their places are of one class: copies,
near copies and common passages are a class after the first rounds, so they make no pairs, and no link between classes is left out.

A seed that more than ``CROWD`` documents hold is divided. If two texts agree beyond it by the next two words, the seed two words on stands for it; otherwise
the passage grows from it over at most ``SKIP`` differing words, to the right or to the left, so two words there are the same. Its keys are the seed
with each such two words, and two holders meet in a key only if their words next to the seed differ (``SIGNED``). Texts that agree all along
``least`` words have a key of these words, whose holders are linked with the first (``STAR``). Two crowded seeds of a document with at most ``LINK`` words between
them are a key for each of the two, likewise signed: two texts that share nothing but crowded seeds meet by what they share on both sides of differing words. What is crowded still is compared two by two.

``LINK``: of ``least`` words a fifth may differ. Each differing word parts at most three equal ones that hold no seed, so d of them make a stretch without seeds of 4 d - 3 words: at most
37 in passages of up to 54 words. Longer ones with wider stretches have whole runs of ``least`` words, or parts that meet, unless no stretch of theirs between two seeds is within ``LINK``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from orrery.llm.blocks import _planes, _unplanes, lean
from orrery.llm.components import components
from orrery.llm.suffix_dedup import _mix
from orrery.storage import discard, stored

CROWD, SKIP, LINK = 64, 4, 40
NEAR, SIGNED, STAR = 1, 2, 4  # a crowded seed is near; see above
PART_BYTES, PAIR_BYTES = 4 << 20, 8 << 20  # of text, for each part of the keys and of the pairs
AT_ONCE = 1 << 20  # matches
_RIGHT, _LEFT, _EXACT, _LINK = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
_ROW = (8, 4, 4, 1)  # bytes of key, place, words next to it, flags


def keys_of(h: np.ndarray, n: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, words: np.ndarray, exact: np.ndarray, k: int, least: int) -> tuple[np.ndarray, ...]:
    """Keys of occurrences in order of their places: number of the occurrence, key, words next to it, flags.

    ``h``: seeds, ``n``: their holders, ``at``: place in ``words``, ``begin``, ``end``: of its document there, ``exact``: hashes of the ``least`` words from each place on.
    """
    crowded = n > CROWD
    few, c = np.flatnonzero(~crowded), np.flatnonzero(crowded)
    close = np.zeros(len(few), bool)
    if len(c):
        j = np.searchsorted(at[c], at[few] - least)
        close = (j < len(c)) & (at[c][np.minimum(j, len(c) - 1)] <= at[few] + least)
    out = [(few, _mix(h[few]), np.zeros(len(few), np.uint64), close * NEAR)]
    two = lambda x: _mix(words[x] << np.uint64(32) | words[x + 1])
    for tag, way in ((_RIGHT, 1), (_LEFT, -1)):
        for x in range(1, SKIP + 1):  # holders of the two words next to the seed never differ in them
            j = at[c] + k + x if way > 0 else at[c] - 2 - x
            ok = np.flatnonzero(j + 1 < end[c]) if way > 0 else np.flatnonzero(j >= begin[c])
            i, j = c[ok], j[ok]
            out.append((i, _mix(h[i] + tag ^ two(j)), two(j - way * x) >> np.uint64(32), np.full(len(i), NEAR | SIGNED)))
    lag, place = 1, at[c]
    while len(words_between := place[lag:] - place[:-lag] - k) and (near := (words_between <= LINK) & (begin[c[lag:]] == begin[c[:-lag]])).any():
        x = np.flatnonzero(near & (words_between >= 0))
        i, j = c[x], c[x + lag]
        both = _mix(_mix(h[i] ^ _LINK) + h[j])
        for tag, on, next_to in ((_RIGHT, i, at[i] + k), (_LEFT, j, at[j] - 2)):
            out.append((on, _mix(both ^ tag), two(next_to) >> np.uint64(32), np.full(len(on), NEAR | SIGNED)))
        lag += 1
    i = c[at[c] + least <= end[c]]
    out.append((i, _mix(exact[at[i]] ^ _EXACT), np.zeros(len(i), np.uint64), np.full(len(i), NEAR | STAR)))
    return tuple(np.concatenate(x) for x in zip(*out))


def pack(key: np.ndarray, pos: np.ndarray, sign: np.ndarray, flag: np.ndarray) -> bytes:
    return b"".join(_planes(x, w) for x, w in zip((key, pos, sign, flag), _ROW))


def pack_matches(x: np.ndarray) -> bytes:
    """Rows (anchor, pos, apos)."""
    return _planes(x[:, 0], 8) + _planes(x[:, 1], 4) + _planes(x[:, 2] - x[:, 1], 8)


def open_matches(data: bytes, n: int, spans: list | None, k: int) -> np.ndarray:
    """Packed rows (anchor, pos, apos) but for those within a passage (other_id, start, end) with their anchor."""
    anchor, pos, off = (c.view(np.int64) for c in _columns(data, n, (8, 4, 8)))
    keep = np.ones(n, bool)
    for s in () if spans is None else spans:
        keep &= (anchor != s["other_id"]) | (pos < s["start"]) | (pos + k > s["end"])
    return np.column_stack([anchor, pos, pos + off])[keep]


def _columns(raw: bytes, n: int, widths: tuple) -> list[np.ndarray]:
    at = np.cumsum([0, *widths]) * n
    return [_unplanes(raw[a:], n, w) for a, w in zip(at.tolist(), widths)]


def classes(rows: DataFrame) -> DataFrame:
    """Passages (id, start, end, other_id, other_start, other_end) to ``id, runs``: a document's runs in passages (s, e), in order, with the number of their class."""
    sides = rows.select("id", "start", "end").union(rows.select("other_id", "other_start", "other_end")).distinct()

    def joined(spans: pd.Series) -> pd.Series:
        out = []
        for c in spans:
            runs: list = []
            for s, e in sorted((x["start"], x["end"]) for x in c):
                if runs and s < runs[-1]["e"]:
                    runs[-1]["e"] = max(runs[-1]["e"], e)
                else:
                    runs.append({"s": s, "e": e})
            out.append(runs)
        return pd.Series(out)

    runs = stored(sides.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("c")).select("id", F.pandas_udf(joined, "array<struct<s:int,e:int>>")("c").alias("runs")), "runs")
    node = lambda who, s: F.struct(F.col(who).alias("id"), F.expr(f"filter(runs, r -> r.s <= {s} and {s} < r.e)[0].s").alias("s"))
    links = rows.select("id", "start", "other_id", "other_start").distinct()
    links = links.join(runs, "id").select("other_id", "other_start", node("id", "start").alias("a"))
    links = links.join(runs.withColumnRenamed("id", "other_id"), "other_id").select("a", node("other_id", "other_start").alias("b"))
    of = components(links).select(F.col("node.id").alias("id"), F.col("node.s").alias("s"), F.xxhash64("root.id", "root.s").alias("class"))
    spans = runs.select("id", F.explode("runs").alias("r")).select("id", "r.s", "r.e").join(of, ["id", "s"])
    out = stored(spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "class"))).alias("runs")), "classes")
    discard(runs)
    return out


_SENT = (8, 8, 4, 8, 4, 1)  # bytes of key, id, place, class (0: its document's own), words next to it, flags
_PAIR = (8, 8, 4, 4, 1)  # bytes of id, anchor, place, its place, flags


def matches(key: np.ndarray, ids: np.ndarray, pos: np.ndarray, of: np.ndarray, sign: np.ndarray, flag: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (id, anchor, pos, apos, flag) for any two holders of a key but those of one class: with an earlier holder's first place. Of a ``STAR``, with the first holder alone."""
    order = np.lexsort((pos, ids, key))
    key, ids, pos, of, sign, flag = (x[order] for x in (key, ids, pos, of, sign, flag))
    of = np.where(of == 0, _mix(ids.view(np.uint64)), of)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    if not len(head):
        return
    apart = np.minimum.reduceat(of, head) != np.maximum.reduceat(of, head)
    apart &= (np.minimum.reduceat(sign, head) != np.maximum.reduceat(sign, head)) | (flag[head] & SIGNED == 0)
    size = np.diff(np.append(head, len(key)))
    stop = np.repeat(head + size, size)
    at = np.arange(len(key))
    first = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))  # of its document
    i = at[np.repeat(apart, size) & first & ((flag & STAR == 0) | (at == np.repeat(head, size)))]
    held, many, lag = [], 0, 1
    while len(i := i[i + lag < stop[i]]):
        j = i + lag
        ok = (of[i] != of[j]) & (ids[i] != ids[j]) & ((flag[i] & SIGNED == 0) | (sign[i] != sign[j]))
        a, b = i[ok], j[ok]
        held.append(np.column_stack([ids[b], ids[a], pos[b], pos[a], np.where(flag[a] & STAR, NEAR, flag[a] & flag[b] & NEAR)]).astype(np.int64))
        many, lag = many + len(a), lag + 1
        if many > AT_ONCE:
            yield np.concatenate(held)
            held, many = [], 0
    if many:
        yield np.concatenate(held)


def chained(rest: DataFrame, of: DataFrame, two: DataFrame, total: int, k: int, least: int, chains_of: Callable[[np.ndarray, bool], list], schema: str) -> DataFrame:
    """``id, n, rest`` (packed keys) and classes to chains of all pairs of documents whose places are not of one class.

    ``two`` (``id, n, two, spans``): packed matches of seeds that no third document holds, which need not meet; those within a passage of their pair go.
    ``least`` matches or a crowded seed near one of them are needed. ``chains_of``: a pair's matches, and whether a crowded seed is near, to rows of ``schema``.
    """
    parts, groups = max(8, -(-total // PART_BYTES)), max(8, -(-total // PAIR_BYTES))
    wide = np.uint64(-(-(1 << 64) // parts))
    sent_as = "part int, n long, data binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(part: np.ndarray, columns: tuple, widths: tuple) -> pd.DataFrame:
        zip_ = zstandard.ZstdCompressor(level=1)
        head = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
        out = [(int(part[s]), e - s, zip_.compress(b"".join(_planes(x[s:e], w) for x, w in zip(columns, widths)))) for s, e in zip(head.tolist(), [*head[1:].tolist(), len(part)])]
        return pd.DataFrame(out, columns=["part", "n", "data"])

    @lean
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        held: list = []
        many = 0

        def flush() -> pd.DataFrame:
            columns = [np.concatenate(c) for c in zip(*held)]
            order = np.argsort(columns[0])
            columns = [c[order] for c in columns]
            return cut((columns[0] // wide).astype(np.int64), tuple(columns), _SENT)

        for b in batches:
            for i, n, data, runs in zip(b["id"].tolist(), b["n"].tolist(), b["rest"], b["runs"]):
                key, pos, sign, flag = _columns(unzip.decompress(data), n, _ROW)
                mine = np.zeros(n, np.uint64)
                if runs is not None and len(runs):
                    s, e = (np.array([r[x] for r in runs], np.int64) for x in ("s", "e"))
                    at = np.searchsorted(s, pos.astype(np.int64), "right") - 1
                    inside = (at >= 0) & (e[at] >= pos.astype(np.int64) + k)
                    mine[inside] = np.array([r["class"] for r in runs], np.int64).view(np.uint64)[at[inside]]
                held.append((key, np.full(n, i).view(np.uint64), pos, mine, sign, flag))
                many += n
                if many > AT_ONCE:
                    yield flush()
                    held, many = [], 0
        if held:
            yield flush()

    def parted(batches: Iterator[pd.DataFrame], widths: tuple) -> Iterator[list[np.ndarray]]:
        unzip = zstandard.ZstdDecompressor()
        held: list = []
        part = None
        for b in batches:  # rows come in order of their part
            for r in b.itertuples(index=False):
                if held and part != r.part:
                    yield [np.concatenate(c) for c in zip(*held)]
                    held = []
                part = r.part
                held.append(_columns(unzip.decompress(r.data), int(r.n), widths))
        if held:
            yield [np.concatenate(c) for c in zip(*held)]

    @lean
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, ids, pos, mine, sign, flag in parted(batches, _SENT):
            for x in matches(key, ids.view(np.int64), pos.astype(np.int64), mine, sign, flag.astype(np.int64)):
                yield grouped(x)

    def grouped(x: np.ndarray) -> pd.DataFrame:
        part = (_mix(x[:, 0].view(np.uint64) * _RIGHT + x[:, 1].view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return cut(part[order], tuple(x[order].T), _PAIR)

    @lean
    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        held: list = []
        many = 0
        for b in batches:
            for i, n, data, spans in zip(b["id"].tolist(), b["n"].tolist(), b["two"], b["spans"]):
                x = open_matches(unzip.decompress(data), n, spans, k)
                held.append(np.column_stack([np.full(len(x), i), x, np.full(len(x), NEAR)]))
                many += len(x)
                if many > AT_ONCE:
                    yield grouped(np.concatenate(held))
                    held, many = [], 0
        if many:
            yield grouped(np.concatenate(held))

    @lean
    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for columns in parted(batches, _PAIR):
            x = np.column_stack([c.view(np.int64) for c in columns])
            x = x[np.lexsort((x[:, 3], x[:, 2], x[:, 1], x[:, 0]))]
            head = np.flatnonzero(np.append(True, (x[1:, :2] != x[:-1, :2]).any(1)))
            near = np.bitwise_or.reduceat(x[:, 4], head) > 0
            size = np.diff(np.append(head, len(x)))
            out: list = []
            for p in np.flatnonzero(near | (size >= least)).tolist():
                pair = x[head[p] : head[p] + size[p], :4]
                out += chains_of(pair[np.append(True, (pair[1:] != pair[:-1]).any(1))], bool(near[p]))
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    def met(rows: DataFrame, n: int) -> DataFrame:
        return rows.repartition(n, "part").sortWithinPartitions("part")

    sent = rest.join(of, "id", "left").select("id", "n", "rest", "runs").mapInPandas(send, sent_as)
    found = met(sent, parts).mapInPandas(meet, sent_as).unionByName(two.mapInPandas(direct, sent_as))
    return met(found, groups).mapInPandas(chain, schema)
