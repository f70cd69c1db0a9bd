"""Token ids in sorted-string-table shards.

Documents are range-partitioned by key, encoded, and each partition becomes one file:

    data blocks   zstd of entries (shared key bytes, own key bytes, value bytes as varints; key rest; ids), about BLOCK bytes raw
    index         per block: first key, offset, stored size, entries          (sparse: one entry a block)
    Bloom filter  BITS_PER_KEY bits and PROBES probes a document key
    footer        places of index and filter, id width, counts, CRC-32 of both, magic

A key is a byte 1 and the id's eight bytes, big-endian with the sign flipped (so byte order is number order), then the rank among equal
ids; a null id is a byte 0, first in order. Ids take two bytes where the vocabulary allows, else four. Files are named by their
attempt, and only the manifest (a row per file) says which count, so a lost executor leaves an unused file and no gap.

Results in the odd cases: null text is empty (the end id alone); repeated rows and ids are kept, in order of id, then text; an
empty table gives an empty manifest; other columns are not read. Texts are encoded whole.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from orrery.storage import shared_dir, stored

BLOCK = 64 * 1024
BITS_PER_KEY, PROBES = 10, 7
MAGIC = b"ORRSST01"
FOOTER = struct.Struct("<QQQQIQQI8s")  # index at, size; filter at, size; id width; documents; ids; CRC of index and filter; magic
END_ID = 2
MANIFEST = "shard int, path string, docs long, ids long, bytes long, first_key binary, last_key binary"


# Encoding -----------------------------------------------------------------------------------------------------------------

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")
CACHE = 600_000
_PROBES = ("a b", " a", "a ", "a  b", "a\nb c", "New  York, \tand 3 more...\r\n", "é x\x0bß!", "1 2\n\n3", "don't  won't")
TRUSTED = 24  # whole texts compared in a task


class WordEncoder:
    """Ids of whole texts under a tokenizer whose pre-tokens never cross ASCII white space.

    Texts are cut at white space and every distinct piece is encoded once while it is in the cache (emptied when full). For the
    common piece, letters and then signs, the two pre-tokens are encoded by the library's model; any other piece goes
    through the library whole. Whether a tokenizer allows this is tested on ``_PROBES`` when it is loaded and, by ``trust``, on whole texts of
    every task before anything is encoded; if either fails, whole texts go through the library. ``check`` compares one text.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size()
        self.width = 2 if max(self.size, end_id) <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.plain = self.cut = True
        if not all(map(self.check, _PROBES)):
            self.cut = False
        self.plain = self.cut and self._splits_words()

    def trust(self, texts: list) -> None:
        """Fall back to whole texts if any of these is encoded otherwise in pieces."""
        if self.cut and not all(self.check(t) for t in texts if t):
            self.cut = False

    def _splits_words(self) -> bool:
        """Whether letters and signs are separate pre-tokens and case is dropped, as ``_PLAIN`` takes for granted."""
        probes = ["Word", "word...", "Édité,", "x!?)", "ß"]
        return all(self._fast(*_PLAIN.fullmatch(p).groups()) == self._whole(p) for p in probes)

    def _whole(self, piece: str) -> bytes:
        return np.array(self.lib.encode(piece, add_special_tokens=False).ids, self.kind).tobytes()

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            got = np.array([t.id for t in self.lib.model.tokenize(self.bytes_of(part)[0][0])], self.kind).tobytes()
            if len(self.parts) >= CACHE:
                self.parts.clear()
            self.parts[part] = got
        return got

    def _fast(self, letters: str, signs: str) -> bytes:
        return self._part(letters.lower()) + (self._part(signs) if signs else b"")

    def _piece(self, piece: str) -> bytes:
        m = _PLAIN.fullmatch(piece) if self.plain else None
        got = self._fast(*m.groups()) if m else self._whole(piece)
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        self.pieces[piece] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of the text and the end id."""
        if not text:
            return self.end
        if not self.cut:
            return self._whole(text) + self.end
        pieces = self.pieces
        out = [pieces.get(p) or self._piece(p) for p in _SPACE.split(text) if p]
        out.append(self.end)
        return b"".join(out)

    def check(self, text: str) -> bool:
        return self.encode(text) == self._whole(text) + self.end


# File format --------------------------------------------------------------------------------------------------------------


def key_bytes(doc_id: int | None, rank: int | None = 0) -> bytes:
    head = b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", int(doc_id) + (1 << 63))
    return head if rank is None else head + struct.pack(">I", rank)


def key_parts(key: bytes) -> tuple[int | None, int]:
    doc_id = None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)
    return doc_id, struct.unpack(">I", key[-4:])[0]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(k, 7) for k in keys], np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    def __init__(self, stream, width: int, block: int = BLOCK):
        self.out, self.width, self.block = stream, width, block
        self.at = self.docs = self.ids = self.entries = 0
        self.buf, self.prev, self.first, self.last = bytearray(), b"", None, b""
        self.first_key = b""
        self.index, self.heads = [], []
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.docs and key <= self.last:
            raise ValueError("keys must ascend")
        if not self.entries:
            self.prev, self.first = b"", key
        same = next((i for i, (x, y) in enumerate(zip(self.prev, key)) if x != y), min(len(self.prev), len(key)))
        self.buf += _varint(same) + _varint(len(key) - same) + _varint(len(value)) + key[same:] + value
        if not self.docs:
            self.first_key = key
        self.prev = self.last = key
        self.heads.append(key[:-4])
        self.entries += 1
        self.docs += 1
        self.ids += len(value) // self.width
        if len(self.buf) >= self.block:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            data = self.zip.compress(bytes(self.buf))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data), self.entries))
            self.at += len(data)
            self.buf, self.entries = bytearray(), 0

    def close(self) -> int:
        self._flush()
        index = b"".join(struct.pack("<HQII", len(k), at, n, e) + k for k, at, n, e in self.index)
        bits = max(64, len(self.heads) * BITS_PER_KEY + 7 & ~7)
        field = np.zeros(bits, bool)
        for i in range(0, len(self.heads), 65536):
            field[_probes(self.heads[i : i + 65536], bits).ravel().astype(np.int64)] = True
        bloom = np.packbits(field, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.width, self.docs, self.ids, zlib.crc32(index + bloom), MAGIC))
        return self.at + len(index) + len(bloom) + FOOTER.size


class Reader:
    """Lookup and scan of one file; index and filter are held, blocks are read one at a time."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        at, n, bat, bn, self.width, self.docs, self.ids, crc, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        index, self.bloom = self.file.read_at(n, at), self.file.read_at(bn, bat)
        if magic != MAGIC or zlib.crc32(index + self.bloom) != crc:
            raise ValueError(f"damaged table {path}")
        self.blocks, i = [], 0
        while i < n:
            k, off, stored_, entries = struct.unpack_from("<HQII", index, i)
            i += 18
            self.blocks.append((index[i : i + k], off, stored_, entries))
            i += k
        self.keys = [b[0] for b in self.blocks]
        self.unzip = zstandard.ZstdDecompressor()

    def _entries(self, block: tuple) -> Iterator[tuple[bytes, bytes]]:
        raw = self.unzip.decompress(self.file.read_at(block[2], block[1]), max_output_size=1 << 31)
        at, key = 0, b""
        while at < len(raw):
            same, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:same] + raw[at : at + own]
            at += own
            yield key, raw[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for b in self.blocks:
            for key, value in self._entries(b):
                yield key_parts(key)[0], np.frombuffer(value, f"<u{self.width}")

    def may_hold(self, doc_id: int | None) -> bool:
        bits = len(self.bloom) * 8
        p = _probes([key_bytes(doc_id, None)], bits)[0].astype(np.int64)
        return all(self.bloom[i >> 3] >> (i & 7) & 1 for i in p.tolist())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document of that id: the filter, a binary search of the index, then the blocks that can hold it."""
        if not self.blocks or not self.may_hold(doc_id):
            return []
        head, out = key_bytes(doc_id, None), []
        i = max(0, bisect_right(self.keys, key_bytes(doc_id, 0)) - 1)
        while i < len(self.blocks) and (self.keys[i] < head or self.keys[i].startswith(head)):
            out += [np.frombuffer(v, f"<u{self.width}") for k, v in self._entries(self.blocks[i]) if k[:-4] == head]
            i += 1
        return out

    def close(self) -> None:
        self.file.close()


# Spark --------------------------------------------------------------------------------------------------------------------

_encoders: dict = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    """One encoder a worker process; its cache serves later tasks too."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def write_tables(docs: DataFrame, tokenizer: str, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents; returns the manifest (a row per file), itself stored."""
    path = path or shared_dir(docs.sparkSession, "tokens")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    # Text moves once, to key order; encoding follows, so the range sample never pays for it.
    ranged = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, w, stream = encoder(tokenizer, end_id), None, None
        shard = TaskContext.get().partitionId()
        name = f"{path}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        prev, rank = object(), 0
        for b in batches:
            ids, texts = b["id"].astype("Int64"), b["text"]
            if w is None and len(b):
                enc.trust(texts.iloc[:: max(1, len(b) // TRUSTED)].tolist())
            for i, missing, t in zip(ids.fillna(0).tolist(), ids.isna().tolist(), texts.tolist()):
                i = None if missing else i
                rank = rank + 1 if i == prev else 0
                prev = i
                if w is None:
                    store, at = fs.FileSystem.from_uri(path)
                    store.create_dir(at, recursive=True)
                    stream = store.open_output_stream(f"{at}/{name.rsplit('/', 1)[1]}")
                    w = Writer(stream, enc.width)
                w.add(key_bytes(i, rank), enc.encode(t))
        if w is not None:
            size = w.close()
            stream.close()
            yield pd.DataFrame([(shard, name, w.docs, w.ids, size, w.first_key, w.last)], columns=[c.split()[0] for c in MANIFEST.split(", ")])

    return stored(ranged.mapInPandas(write, MANIFEST), "manifest")


def read_tables(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), n_tokens, ids_crc32, shard."""
    n = max(1, manifest.count())  # a task a file
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    files = manifest.select("shard", "path", "docs", F.coalesce(before, F.lit(0)).alias("start"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, path, start in zip(b["shard"], b["path"], b["start"]):
                r, out = Reader(path), []
                for doc_id, ids in r.scan():
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                    start += len(ids)
                    if len(out) == 5000:
                        yield _frame(out, key)
                        out = []
                r.close()
                yield _frame(out, key)

    schema = f"{key} long, start long, n_tokens long, ids_crc32 long, shard int"
    return files.repartition(n, F.col("shard")).mapInPandas(read, schema)


def _frame(rows: list, key: str) -> pd.DataFrame:
    d = pd.DataFrame(rows, columns=[key, "start", "n_tokens", "ids_crc32", "shard"])
    d[key] = pd.array(d[key].tolist(), "Int64")
    return d


def find(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """Point lookup: the manifest's key ranges name the file (one, or two where a range ends inside equal ids)."""
    k = bytearray(key_bytes(doc_id, None))
    near = manifest.filter((F.substring("first_key", 1, len(k)) <= F.lit(k)) & (F.substring("last_key", 1, len(k)) >= F.lit(k))).orderBy("shard")
    return [ids for r in near.select("path").collect() for ids in Reader(r.path).get(doc_id)]
