"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A token is coded as 16 binary decisions, the bits of its word's hash from the top. Three predictors give each decision a
probability from counts over all training text: of the bits before it alone, of those and the word before, and of those
and two words before (the last two in hashed tables). Their logits and a constant are added under weights gated by the
decision's number, and the weights move after every token by the coding error, so the mix follows the text it reads.
A hash shared by several words is split by their counts. A word that training text lacks costs the share of
words seen once among tokens, and its bytes under counts of up to three bytes before them in the vocabulary.

Counting: each task adds its text to tables of fixed size and to counts of its words; tables are summed by blocks and then broadcast
(``TABLE_BYTES`` in all, whatever the input); word counts grow with the input and are joined back per piece of the input, never
broadcast. Weights start anew every ``LANE`` tokens, so long texts are read in parallel pieces.

What is coded are words and ends, with A-Z lower-cased: white space, its repeats and upper case cost nothing, and ``bits_per_byte`` divides the
bits of the words by the bytes of the whole text.

Results in the odd cases: null text is empty, one end token; a null id is learnt from and not held out; repeated rows are
each counted and scored; an empty table gives no rows; without any training text every word is unknown; other columns are
not read. Texts are scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from orrery.storage import discard, stored

BITS = 16
HASHED = 20  # log2 of the slots of a hashed table
# Cells of each table: tokens by code; ones and zeros of the hashed slots; spelling: pairs, then cells and contexts of two and three bytes.
SIZES = (1 << BITS, 2 << HASHED, 2 << HASHED, 257 * 257, 1 << 20, 1 << 18, 1 << 20, 1 << 18)
CELLS = 1 << 15  # in a block
TABLE_BYTES = 8 * sum(SIZES)
LANE, LANES = 512, 768
START_WEIGHTS, RATE = (1.0, 0.2, 0.2, 0.0), 0.02
BACKOFF = 1.5  # occurrences that a shorter context's estimate is worth
PIECES = 4  # of an input split
PART = 2 << 20  # characters at a time
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LONG_WORD = 64  # bytes; the checksums of longer words are made one by one
_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)  # of the usual table-driven CRC-32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end (empty) token."""
    w = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    w.append(b"")
    return w


def numbered(texts: list) -> tuple[np.ndarray, pa.LargeBinaryArray, np.ndarray]:
    """``tokens`` of all texts, each as its number among the different ones; those, as they are first met; how many tokens each text has."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    low = np.frombuffer(b" ".join([b"", *raw, b""]).lower(), np.uint8)
    inside = (low - np.uint8(9) > 4) & (low != 32)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    last = np.searchsorted(begin, np.cumsum([len(x) + 1 for x in raw]))  # words up to each text's end
    cut = np.cumsum(np.concatenate([[0], np.insert(end - begin, last, 0)]))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(low[inside])]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary, np.diff(last, prepend=0) + 1


def codes_of(words: pa.LargeBinaryArray) -> np.ndarray:
    """``Codes`` of an array's words, a byte of all of them at a time."""
    _, cut, data = words.buffers()
    cut = np.frombuffer(cut, np.int64, len(words) + 1, 8 * words.offset)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    size, h = np.diff(cut), np.full(len(words), 0xFFFFFFFF, np.uint32)
    long = np.flatnonzero(size > _LONG_WORD)
    live = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    i = 0
    while len(live):
        x = h[live]
        h[live] = _CRC[(x ^ data[cut[live] + i]) & np.uint32(0xFF)] ^ x >> np.uint32(8)
        i += 1
        live = live[size[live] > i]
    h ^= np.uint32(0xFFFFFFFF)
    for j in long.tolist():
        h[j] = zlib.crc32(data[cut[j] : cut[j + 1]])
    return h * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def slots(codes: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bits of each code (tokens x 16), and the slot of each decision: the node, and one in each hashed table."""
    codes = codes.astype(np.uint32)
    shift = np.arange(BITS - 1, -1, -1, dtype=np.uint32)
    above = codes[:, None] >> shift
    bits = (above & np.uint32(1)).astype(np.uint8)
    node = above >> np.uint32(1)
    node |= np.uint32(1) << (np.uint32(BITS - 1) - shift)
    mixed = node * np.uint32(0x9E3779B1)
    out = [node]
    for ctx in (one, two):
        h = (ctx + np.uint64(1)) * _A
        h = ((h ^ (h >> np.uint64(29))) * _B >> np.uint64(32)).astype(np.uint32)
        at = mixed ^ h[:, None]
        at *= np.uint32(0x85EBCA6B)
        at >>= np.uint32(32 - HASHED)
        out.append(at)
    return bits, out


def spelling_counts(words: list[bytes]) -> list[np.ndarray]:
    """Counts of the five spelling tables over words."""
    j = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8).astype(np.uint64)
    pair = np.bincount((j[:-1] * np.uint64(257) + j[1:]).astype(np.int64), minlength=SIZES[3])
    out = [pair]
    for k in (2, 3):
        ok = np.ones(max(0, len(j) - k), bool)
        for i in range(1, k):
            ok &= j[i : len(j) - k + i] != 0
        ctx, cell = _spelling_slots(j, k)
        out += [np.bincount(cell[ok], minlength=1 << 20), np.bincount(ctx[ok], minlength=1 << 18)]
    return [x.astype(np.uint32) for x in out]


def _spelling_slots(j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the contexts of k bytes and of what follows them, for each byte from the k-th on."""
    h = np.zeros(max(0, len(j) - k), np.uint64)
    for i in range(k):
        h = (h + j[i : len(j) - k + i] + np.uint64(1)) * _A
    cell = (h + j[k:] + np.uint64(1)) * _B
    return (h >> np.uint64(46)).astype(np.int64), (cell >> np.uint64(44)).astype(np.int64)


def contexts(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Previous code, and the previous two, of each token; ``first`` marks the first token of a text."""
    c = codes.astype(np.uint64) + np.uint64(1)
    one = np.where(first, 0, np.concatenate([[0], c]).astype(np.uint64)[:-1]).astype(np.uint64)
    before = np.where(first, 0, np.concatenate([[0], one]).astype(np.uint64)[:-1]).astype(np.uint64)
    return one, one * np.uint64(1 << 17) + before + np.uint64(1 << 40)


class Codes:
    """Codes of words."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)


STATS = "table int, block int, piece long, word binary, n long, cells binary"


def gather(docs: DataFrame) -> DataFrame:
    """``piece, text, learn`` to rows of counts: table blocks (table >= 0) and word counts of each piece (table -1, n of training)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(n, np.uint32) for n in SIZES[:3]]
        every: list[pa.Array] = [pa.array([], pa.large_binary())]
        counts: dict[int, list] = {}  # of each piece: the part, its words' training tokens, and all
        for b in batches:
            done = 0
            for texts in _by_size(b.column(1).to_pylist(), PART):
                at, words, size = numbered(texts)
                pieces, learnt = (b.column(i).slice(done, len(texts)).to_numpy(zero_copy_only=False) for i in (0, 2))
                done += len(texts)
                learn, piece = np.repeat(learnt, size), np.repeat(pieces, size)
                for p in np.unique(pieces).tolist():
                    on = piece == p
                    counts.setdefault(p, []).append((len(every), *(np.bincount(at[x], minlength=len(words)).astype(np.int32) for x in (on & learn, on))))
                every.append(words)
                first = np.zeros(len(at), bool)
                first[np.cumsum(size) - size] = True
                c = codes_of(words)[at[learn]]
                one, two = contexts(c, first[learn])
                sums[0] += np.bincount(c, minlength=SIZES[0]).astype(np.uint32)
                for a in range(0, len(c), 50_000):
                    bits, where = slots(c[a : a + 50_000], one[a : a + 50_000], two[a : a + 50_000])
                    for s, x in zip(sums[1:3], where[1:]):
                        x <<= np.uint32(1)
                        x |= bits
                        np.add.at(s, x.ravel(), np.uint32(1))
        begin = np.cumsum([len(x) for x in every])
        named = pa.concat_arrays(every).dictionary_encode()
        number, words = named.indices.to_numpy(), named.dictionary
        for p, parts in counts.items():
            n, held = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
            for k, learnt, all_ in parts:
                to = number[begin[k - 1] : begin[k]]
                n[to] += learnt
                held[to] |= all_ > 0
            held = np.flatnonzero(held)
            for a in range(0, len(held), 50_000):
                some = held[a : a + 50_000]
                yield _rows(len(some), table=-1, block=0, piece=p, word=words.take(pa.array(some)).cast(pa.binary()), n=n[some])
        for t, k, c in blocks(sums):
            yield _rows(1, table=t, block=k, piece=0, n=0, cells=[c])

    return docs.select("piece", "text", "learn").mapInArrow(run, STATS)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(size: int, **columns) -> pa.RecordBatch:
    """Rows of ``STATS``; a number stands for a column of it."""
    fields = [x.split() for x in STATS.split(", ")]
    full = lambda x: np.full(size, x) if isinstance(x, int) else x
    return pa.RecordBatch.from_arrays([pa.array(full(columns[c]), _TYPES[t]) if c in columns else pa.nulls(size, _TYPES[t]) for c, t in fields], names=[c for c, _ in fields])


def blocks(sums: list[np.ndarray], first: int = 0) -> list[tuple]:
    """(table, block, cells) of tables from number ``first`` on, without empty blocks."""
    return [(t, k // CELLS, zlib.compress(s[k : k + CELLS].tobytes(), 1)) for t, s in enumerate(sums, first) for k in range(0, len(s), CELLS) if s[k : k + CELLS].any()]


def gather_spelling(vocabulary: DataFrame) -> DataFrame:
    """Blocks of the spelling tables, each word of the vocabulary counted once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(n, np.uint32) for n in SIZES[3:]]
        for b in batches:
            words = [bytes(w) for w in b["word"] if w]
            for s, x in zip(sums, spelling_counts(words) if words else []):
                s += x
        yield pd.DataFrame(blocks(sums, 3), columns=["table", "block", "cells"])

    return vocabulary.select("word").mapInPandas(run, "table int, block int, cells binary")


def summed(stats: DataFrame) -> DataFrame:
    """Blocks added up; a task holds the blocks dealt to it, whose number is fixed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for t, k, c in zip(b["table"].tolist(), b["block"].tolist(), b["cells"]):
                x = np.frombuffer(zlib.decompress(c), np.uint32)
                held[t, k] = held[t, k] + x if (t, k) in held else x.astype(np.uint64)
        yield pd.DataFrame([(t, k, zlib.compress(v.tobytes(), 1)) for (t, k), v in held.items()], columns=["table", "block", "cells"])

    return stats.repartition("table", "block").mapInPandas(run, "table int, block int, cells binary")


class Model:
    """Broadcast tables as logits."""

    def __init__(self, blocks: list, n: int, v: int, n1: int):
        self.n, self.v = n, v
        self.unknown = (n1 + 1) / (n + 2)
        full = [np.zeros(n, np.uint64) for n in SIZES]
        for t, k, c in blocks:
            x = np.frombuffer(zlib.decompress(c), np.uint64)
            full[t][k * CELLS : k * CELLS + len(x)] = x
        self.leaf = full[0].astype(np.float64)
        level, ones, zeros = self.leaf, np.zeros(1 << BITS), np.zeros(1 << BITS)
        for b in range(BITS - 1, -1, -1):  # counts of the decision at each node, from the leaves up
            zeros[1 << b : 2 << b], ones[1 << b : 2 << b] = level[0::2], level[1::2]
            level = level[0::2] + level[1::2]
        logit = lambda one, zero: np.log((one + 0.4) / (zero + 0.4)).astype(np.float32)
        self.logit = [logit(ones, zeros), *(logit(f[1::2], f[0::2]) for f in full[1:3])]
        pairs = full[3].reshape(257, 257).astype(np.float64) + 0.05
        self.pair = pairs / pairs.sum(1, keepdims=True)
        self.longer = [(full[4], full[5]), (full[6], full[7])]
        self.spelt: dict[bytes, float] = {}

    def spelling(self, w: bytes) -> float:
        """log2 probability of a word's bytes and end: each under the longest context, backed by the shorter ones."""
        return float(self.spellings([w])[0])

    def spellings(self, words: list[bytes]) -> np.ndarray:
        if len(self.spelt) > 300_000:
            self.spelt.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.spelt]
        plain = [w for w in new if b"\0" not in w]
        for part in [plain[a : a + 20_000] for a in range(0, len(plain), 20_000)] + [[w] for w in new if b"\0" in w]:
            self.spelt.update(zip(part, self._spelling(part).tolist()))
        return np.array([self.spelt[w] for w in words], np.float64)

    def _spelling(self, words: list[bytes]) -> np.ndarray:
        """Of words without byte 0, which parts them, or of a single word."""
        j = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8).astype(np.uint64)
        p = self.pair[j[:-1].astype(np.int64), j[1:].astype(np.int64)].copy()
        for k, (cells, ctxs) in zip((2, 3), self.longer):
            if len(j) > k:
                ctx, cell = _spelling_slots(j, k)
                ok = np.ones(len(ctx), bool)
                if len(words) > 1:
                    for i in range(1, k):
                        ok &= j[i : len(j) - k + i] != 0
                at, ctx, cell = np.flatnonzero(ok) + k - 1, ctx[ok], cell[ok]
                n = np.maximum(ctxs[ctx], cells[cell]).astype(float)
                p[at] = (cells[cell] + BACKOFF * p[at]) / (n + BACKOFF)
        size = np.array([len(w) + 1 for w in words])
        return np.add.reduceat(np.log2(p), np.cumsum(size) - size)

    def decisions(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log2 probability of each token's code; tokens of a text run on, ``first`` marks their starts."""
        n = len(codes)
        one, two = contexts(codes, first)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        lanes = np.concatenate([np.arange(s, e, LANE) for s, e in zip(starts, ends)]) if n else np.zeros(0, int)
        stop = np.minimum(lanes + LANE, np.repeat(ends, -(-(ends - starts) // LANE)))
        out = np.zeros(n)
        order = np.argsort(lanes - stop, kind="stable")  # longest first, so a group's lanes end together
        for a in range(0, len(order), LANES):
            s, e = lanes[order[a : a + LANES]], stop[order[a : a + LANES]]
            self._mix(codes, one, two, s, e - s, out)
        return out

    def _mix(self, codes: np.ndarray, one: np.ndarray, two: np.ndarray, at: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        w = np.repeat(np.array(START_WEIGHTS, np.float32), len(at) * BITS).reshape(4, len(at), BITS)
        step = 16
        tmp, z = np.empty_like(w), np.empty(w.shape[1:], np.float32)
        for t0 in range(0, int(size[0]), step):
            live = int((size > t0).sum())
            idx = np.arange(t0, t0 + step)[:, None] + at[:live]  # a step's lanes lie together
            flat = np.minimum(idx, len(codes) - 1).ravel()
            bits, where = slots(codes[flat], one[flat], two[flat])
            x = np.empty((4, step * live, BITS), np.float32)
            x[3] = bits
            x[3] *= 2
            x[3] -= 1  # the constant, signed by the bit that came, as all inputs are
            for i, (lg, s) in enumerate(zip(self.logit, where)):
                lg.take(s, out=x[i], mode="clip")  # no slot is out of range; other modes copy first
                x[i] *= x[3]
            x = x.reshape(4, step, live, BITS)
            p = np.ones((step, live, BITS), np.float32)  # of the bits that came
            many = [int((size > t).sum()) for t in range(t0, min(t0 + step, int(size[0])))]
            for t, m in enumerate(many):
                xs, ws, y, u, q = x[:, t, :m], w[:, :m], tmp[:, :m], z[:m], p[t, :m]
                np.multiply(ws, xs, out=y)
                np.add.reduce(y, axis=0, out=u)
                np.minimum(u, 20, out=u)
                np.maximum(u, -20, out=u)
                np.negative(u, out=u)
                np.exp(u, out=u)
                u += 1
                np.divide(1, u, out=q)
                np.subtract(1, q, out=u)
                u *= np.float32(RATE)
                np.multiply(u, xs, out=y)
                ws += y
            q = p.astype(np.float64)  # 16 factors of 2e-9 or more
            for half in (8, 4, 2, 1):
                q = q[..., :half] * q[..., half:]
            q = np.log2(q[..., 0])
            for t, m in enumerate(many):
                out[idx[t, :m]] = q[t, :m]

    def score(self, texts: list, count: dict[bytes, int] | pa.Table) -> list[tuple]:
        """n_tokens, n_known, base_score, score, bits a byte of each text; ``count`` has the words that training text holds (a table: in ``word`` and ``c``)."""
        at, words, sizes = numbered(texts)
        if isinstance(count, dict):
            c = np.array([count.get(w, 0) for w in words.to_pylist()], np.float64)
        else:
            found = pc.index_in(words.cast(pa.binary()), value_set=count.column("word").combine_chunks())
            c = np.where(found.is_valid(), count.column("c").take(found.fill_null(0)).to_numpy(), 0).astype(np.float64) if len(count) else np.zeros(len(words))
        codes = codes_of(words)
        starts = np.cumsum(sizes) - sizes
        first = np.zeros(len(at), bool)
        first[starts] = True
        known = np.log2(1 - self.unknown) + np.log2(np.maximum(c, 1) / np.maximum(self.leaf[codes], np.maximum(c, 1)))
        missing = np.flatnonzero(c == 0)
        unknown = np.zeros(len(c))
        unknown[missing] = np.log2(self.unknown) + self.spellings(words.take(pa.array(missing)).to_pylist())
        lp = np.where((c == 0)[at], unknown[at], self.decisions(codes[at], first) + known[at])
        base = np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))[at]
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        total = add(lp)
        size = np.array([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts])
        return list(zip(sizes.tolist(), add((c > 0)[at].astype(np.int64)).tolist(), add(base).tolist(), (total * np.log10(2)).tolist(), (-total / size).tolist()))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    docs = docs.select(key, text)
    if docs.filter(F.input_file_name() == "").limit(1).count():  # rows that come from no file: pieces need splits of bounded size
        docs = stored(docs, "documents")
    piece = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64(F.col(key), F.octet_length(F.col(text))), F.lit(PIECES)))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), piece.alias("piece"), held_out(F.col(key)).alias("held_out"))
    stats = stored(gather(rows.select("piece", "text", (~F.col("held_out")).alias("learn"))), "counts")
    words = stats.filter("table = -1").select("piece", "word", "n")
    vocabulary = stored(words.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "vocabulary")
    n, v, n1 = vocabulary.agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long"))).first()
    tables = stats.filter("table >= 0").select("table", "block", "cells").unionByName(gather_spelling(vocabulary))
    model = spark.sparkContext.broadcast(([(r.table, r.block, bytes(r.cells)) for r in summed(tables).collect()], n or 0, v, n1 or 0))  # blocks of tables of fixed size
    # a piece is read by one task, so its words come once; a repeat would only be looked up twice
    known = stored(words.select("piece", "word").join(vocabulary, "word").select("piece", "word", "c"), "known")
    discard(stats, vocabulary)
    schema = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    built: list[Model] = []

    def run(docs_: pa.Table, counts: pa.Table) -> pa.Table:
        if not built:
            built.append(Model(*model.value))
        got: list[tuple] = []
        for part in _by_size(docs_.column("text").to_pylist(), 3 << 20):
            got += built[0].score(part, counts)
        made = [pa.array(x, t) for x, t in zip(zip(*got) if got else [[]] * 5, (pa.int64(), pa.int64(), *[pa.float64()] * 3))]
        return pa.table([docs_.column("id"), docs_.column("held_out"), *made], names=[x.split()[0] for x in schema.split(", ")])

    scored = rows.groupBy("piece").cogroup(known.groupBy("piece")).applyInArrow(run, schema)
    return scored.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n or 0).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def _by_size(texts: list, most: int) -> Iterator[list]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
