"""MPEG audio columns: frames found and checked, tags and variable-bitrate tables read, exact durations and seek offsets.

``parse`` walks a stream: past an ID3v2 tag it looks for a frame header whose successor is one too (or the end of the audio), skips
what is not a frame and goes on (a resynchronisation), checks the CRC-16 where a frame has one, reads the Xing/Info or VBRI
table of the first frame, and stops before an ID3v1 or APE tag. Duration is samples / rate, exact, not an estimate from bitrates.

``pack`` stores bytes losslessly in such a stream: every Layer III frame has empty side information (a decoder plays
silence) and carries payload as ancillary data; the bitrate follows what is left, so the stream is of variable bitrate, with a
Xing table (frames, bytes, 100 seek points) and an ID3v2 tag that holds the payload's length. ``unpack`` gives the bytes back.

Results in the odd cases: null or empty media parses to no frames and duration 0, bytes without any frame likewise, with all
of them counted as skipped; a truncated last frame is counted and its bytes are skipped; null text packs as empty (64 zero bytes);
repeated rows give equal media; an empty table gives no rows; other columns pass through or are not read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Fixed values of the format: kbit/s by bitrate index 1..14, sample rates, samples a frame.
KBPS = {
    ("1", 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    ("1", 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    ("1", 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    ("2", 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    ("2", 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    ("2", 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {"1": [44100, 48000, 32000], "2": [22050, 24000, 16000], "2.5": [11025, 12000, 8000]}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
SAMPLES = {("1", 1): 384, ("1", 2): 1152, ("1", 3): 1152, ("2", 1): 384, ("2", 2): 1152, ("2", 3): 576}
SIDE_INFO = {("1", False): 32, ("1", True): 17, ("2", False): 17, ("2", True): 9}
CRC_POLY = 0x8005

LENGTH_KEY = b"payload_bytes"


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ CRC_POLY if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(1 << 16)
def _frame_crc(covered: bytes) -> int:
    """Checksum of a header's and side information's bytes, which recur from frame to frame."""
    return crc16(covered)


def crc16(data: bytes, c: int = 0xFFFF) -> int:
    for b in data:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mono: bool
    size: int
    samples: int
    side: int  # bytes of side information (Layer III)


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame that a four-byte header describes; None if it is none (or of free format, whose size it doesn't tell)."""
    key = bytes(four[:4])
    if key not in _headers:
        if len(_headers) > 100_000:
            _headers.clear()
        _headers[key] = _header(key)
    return _headers[key]


def _header(h: bytes) -> Header | None:
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(h[1] >> 3 & 3), 4 - (h[1] >> 1 & 3)
    b, r = h[2] >> 4, h[2] >> 2 & 3
    if version is None or layer == 4 or b in (0, 15) or r == 3 or h[3] & 3 == 2:
        return None
    family = "1" if version == "1" else "2"
    kbps, rate, pad = KBPS[family, layer][b - 1], RATES[version][r], h[2] >> 1 & 1
    samples, mono = SAMPLES[family, layer], h[3] >> 6 == 3
    size = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    return Header(version, layer, not h[1] & 1, kbps, rate, pad, mono, size, samples, SIDE_INFO[family, mono] if layer == 3 else 0)


@dataclass
class Stream:
    """What a walk over the bytes finds. ``offsets``: byte position of each audio frame (its number times samples is its time)."""

    tags: dict = field(default_factory=dict)
    offsets: list = field(default_factory=list)
    sizes: list = field(default_factory=list)
    kbps: dict = field(default_factory=dict)
    version: str = ""
    layer: int = 0
    rate: int = 0
    samples: int = 0
    mono: bool = False
    duration: float = 0.0
    vbr: str = ""
    vbr_frames: int = 0
    vbr_bytes: int = 0
    toc: bytes = b""
    crc_checked: int = 0
    crc_failed: int = 0
    resyncs: int = 0
    skipped: int = 0
    truncated: bool = False


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, s: Stream) -> int:
    """Text frames of an ID3v2.3/2.4 tag; returns where the tag ends."""
    if len(data) < 10 or data[:3] != b"ID3":
        return 0
    end, at, v4 = min(len(data), 10 + _syncsafe(data[6:10]) + (10 if data[5] & 16 else 0)), 10, data[3] >= 4
    while at + 10 <= end and data[at : at + 4].isalnum():
        name, raw = data[at : at + 4].decode(), data[at + 4 : at + 8]
        n = _syncsafe(raw) if v4 else int.from_bytes(raw, "big")
        body = data[at + 10 : min(end, at + 10 + n)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            s.tags[key] = value
        at += 10 + n
    return end


def _tail(data: bytes) -> tuple[int, dict]:
    """Where an ID3v1 tag, or an APE tag before it, would begin. It counts only if the frames lead up to it."""
    end, tags = len(data), {}
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags["id3v1_title"] = data[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1")
        end -= 128
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack_from("<I", data, end - 20)[0], struct.unpack_from("<I", data, end - 12)[0]
        end = max(0, end - size - (32 if flags >> 31 else 0))
        tags["ape"] = str(size)
    return end, tags


def _vbr_table(data: bytes, at: int, h: Header, s: Stream) -> bool:
    """A Xing/Info table after the side information, or a VBRI one 32 bytes in; such a frame holds no audio."""
    x = at + 4 + 2 * h.protected + h.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        s.vbr, flags, p = data[x : x + 4].decode(), int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        if flags & 1:
            s.vbr_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 2:
            s.vbr_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            s.toc = data[p : p + 100]
        return True
    if data[(v := at + 36) : v + 4] == b"VBRI" and v + 26 <= len(data):
        s.vbr = "VBRI"
        s.vbr_bytes, s.vbr_frames, n, _, width = struct.unpack_from(">IIHHH", data, v + 10)
        s.toc = data[v + 26 : v + 26 + n * width]
        return True
    return False


def parse(data: bytes | None) -> Stream:
    s = Stream()
    if not data:
        return s
    at, end = _id3v2(data, s), len(data)
    tail, tail_tags = _tail(data)
    first, lost = True, False
    while at < end:
        h = header(data[at : at + 4])
        ok = h is not None and at + h.size <= end
        if ok and (first or lost):  # an unproven start needs a successor
            ok = at + h.size in (end, tail) or ((n := header(data[at + h.size : at + h.size + 4])) is not None and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate))
        if not ok:
            if at == tail:  # what carried frames up to here is a tag, not a frame's bytes that look like one
                s.tags |= tail_tags
                break
            if h is not None and at + h.size > end and not lost and not first:
                s.truncated = True
            stop = tail if at < tail else end
            nxt = data.find(b"\xff", at + 1, stop)
            nxt = stop if nxt < 0 else nxt
            s.skipped += nxt - at
            s.resyncs += not lost
            lost, at = True, nxt
            continue
        lost = False
        if first:
            s.version, s.layer, s.rate, s.samples, s.mono, first = h.version, h.layer, h.rate, h.samples, h.mono, False
            if h.layer == 3 and _vbr_table(data, at, h, s):
                at += h.size
                continue
        if h.protected and h.layer == 3:
            s.crc_checked += 1
            s.crc_failed += _frame_crc(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big")
        s.offsets.append(at)
        s.sizes.append(h.size)
        s.kbps[h.kbps] = s.kbps.get(h.kbps, 0) + 1
        at += h.size
    s.duration = len(s.offsets) * s.samples / s.rate if s.rate else 0.0
    return s


# Storing bytes ------------------------------------------------------------------------------------------------------------

_FRAMES: list[tuple[int, bytes]] = []  # payload capacity and first 23 bytes (header, CRC, side information) by bitrate


def _shapes() -> list[tuple[int, bytes]]:
    if not _FRAMES:
        for i in range(1, 15):
            h = bytes([0xFF, 0xFA, i << 4, 0xC0])  # MPEG-1 Layer III, CRC, 44.1 kHz, mono
            side = bytes(header(h).side)
            head = h + crc16(h[2:] + side).to_bytes(2, "big") + side
            _FRAMES.append((header(h).size - len(head), head))
    return _FRAMES


def pack(payload: bytes) -> bytes:
    """The stream that holds ``payload``; equal payloads give equal streams."""
    shapes = _shapes()
    most = shapes[-1][0]
    frames = []
    for a in range(0, len(payload), most):
        part = payload[a : a + most]
        room, head = next((c, h) for c, h in shapes if c >= len(part))
        frames.append(head + part + bytes(room - len(part)))
    text = b"\x03" + LENGTH_KEY + b"\0" + str(len(payload)).encode()
    tag = b"TXXX" + bytes(n >> s & 127 for n in [len(text)] for s in (21, 14, 7, 0)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0)) + tag
    room, head = next((c, h) for c, h in shapes if c >= 120)
    size = len(head) + room + sum(map(len, frames))
    starts, at = [], len(head) + room
    for f in frames:
        starts.append(at)
        at += len(f)
    toc = bytes(min(255, 256 * starts[i * len(starts) // 100] // size) for i in range(100)) if starts else bytes(100)
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + size.to_bytes(4, "big") + toc
    return tag + head + xing + bytes(room - len(xing)) + b"".join(frames)


def unpack(data: bytes, s: Stream | None = None) -> bytes:
    """The payload of a stream from ``pack``; raises if a frame is damaged."""
    s = s or parse(data)
    if s.crc_failed or s.skipped:
        raise ValueError("damaged stream")
    head = len(_shapes()[0][1])
    return b"".join(data[a + head : a + n] for a, n in zip(s.offsets, s.sizes))[: int(s.tags[LENGTH_KEY.decode()])]


def padded(text: str | None, unit: int = 64) -> bytes:
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + bytes(-len(b) % unit if b else unit)


@F.pandas_udf(T.BinaryType())
def pack_text(text: pd.Series) -> pd.Series:
    """Text as a stored stream."""
    return pd.Series([pack(padded(t)) for t in text], dtype=object)


FACTS = "version string, layer int, sample_rate int, mono boolean, frames long, duration double, vbr string, vbr_frames long, vbr_bytes long, crc_checked long, crc_failed long, resyncs long, skipped long, truncated boolean, tags map<string,string>, kbps map<int,long>, seek_offsets array<long>"


def media_facts(media: Column) -> Column:
    """Parsed facts of a binary column, seek offsets included."""
    return F.pandas_udf(_facts, FACTS)(media)


def _facts(media: pd.Series) -> pd.DataFrame:
    out = []
    for m in media:
        s = parse(m)
        out.append((s.version, s.layer, s.rate, s.mono, len(s.offsets), s.duration, s.vbr, s.vbr_frames, s.vbr_bytes, s.crc_checked, s.crc_failed, s.resyncs, s.skipped, s.truncated, s.tags, s.kbps, s.offsets))
    return pd.DataFrame(out, columns=[c.split()[0] for c in FACTS.split(", ")])


def seek(s: Stream, seconds: float) -> int | None:
    """Byte position of the frame that plays at a time."""
    i = int(seconds * s.rate // s.samples) if s.rate and seconds >= 0 else -1
    return s.offsets[i] if 0 <= i < len(s.offsets) else None
