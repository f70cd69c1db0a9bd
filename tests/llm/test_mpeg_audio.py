import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from orrery.llm import mpeg_audio as mp
from orrery.llm.q_mpeg_audio import query


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=9000))
def test_round_trip(data):
    media = mp.pack(data)
    s = mp.parse(media)
    assert mp.unpack(media, s) == data
    assert s.vbr == "Xing" and s.vbr_frames == len(s.offsets) and s.skipped == 0 and s.crc_failed == 0
    assert s.duration == len(s.offsets) * 1152 / 44100


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=700), st.integers(0, 60), st.sampled_from([b"", b"ID3\x04\0\0\0\0\x02\x01", b"\xff\xf3\x10\xc0", b"\xff\xfb\x90\xc0", b"VBRI", b"Xing\0\0\0\x07"]), st.binary(max_size=40))
def test_any_bytes_parse(data, at, head, tail):
    s = mp.parse(data[:at] + head + data[at:] + tail)
    assert s.duration >= 0 and len(s.offsets) == len(s.sizes)
    mp.parse(head + bytes(32) + b"VBRI" + tail)


def test_payload_that_looks_like_a_tag():
    for shift in range(3):
        for body in (b"TAG" * 900, b"APETAGEX" * 400, b"\xff\xfa\x90\xc0" * 500, b"ID3" * 800):
            data = b"x" * shift + body
            assert mp.unpack(mp.pack(data)) == data
    for cut in range(110, 130):
        data = b"a" * 997 + b"TAG" + b"b" * cut
        assert mp.unpack(mp.pack(data)) == data


def test_resync_damage_tags_and_seek():
    payload = bytes(range(256)) * 20
    media = mp.pack(payload)
    s = mp.parse(media)
    assert mp.seek(s, 0) == s.offsets[0] and mp.seek(s, 2.5 * 1152 / 44100) == s.offsets[2] and mp.seek(s, 99) is None
    cut = s.offsets[2]
    noisy = mp.parse(media[:cut] + b"\xff\xfb\x00noise\xff" + media[cut:] + b"TAG" + b"title".ljust(125, b"\0"))
    assert len(noisy.offsets) == len(s.offsets) and noisy.resyncs == 1 and noisy.skipped == 9 and noisy.tags["id3v1_title"] == "title"
    bad = bytearray(media)
    bad[s.offsets[1] + 8] ^= 4
    assert mp.parse(bytes(bad)).crc_failed == 1
    with pytest.raises(ValueError):
        mp.unpack(bytes(bad))
    short = mp.parse(media[:-5])
    assert short.truncated and len(short.offsets) == len(s.offsets) - 1
    ape = b"APETAGEX" + struct.pack("<IIII", 2000, 32, 0, 0) + bytes(8)
    assert len(mp.parse(media + ape).offsets) == len(s.offsets)
    vbri = bytearray(mp.header(b"\xff\xfb\x90\xc0").size)
    vbri[:4] = b"\xff\xfb\x90\xc0"
    vbri[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4000, 7, 2, 1, 2, 1)
    v = mp.parse(bytes(vbri) + media[s.offsets[0] :])
    assert v.vbr == "VBRI" and (v.vbr_frames, v.vbr_bytes, len(v.toc)) == (7, 4000, 4) and len(v.offsets) == len(s.offsets)


def test_header_sizes():
    assert mp.header(b"\xff\xfb\x90\x00").size == 417 and mp.header(b"\xff\xfb\x92\x00").size == 418
    assert mp.header(b"\xff\xfd\x90\x00").samples == 1152 and mp.header(b"\xff\xf3\x90\x00").samples == 576
    assert mp.header(b"\xff\xff\x90\x00").size == 12 * 288000 // 44100 * 4
    assert mp.header(b"\xff\xfb\x00\x00") is None and mp.header(b"\xff\xfb\xf0\x00") is None and mp.header(b"\xff") is None


def plain_frames(media):
    """Offsets of all frames by arithmetic on the headers alone: bitrate index to bytes at 44.1 kHz, past the ID3v2 tag."""
    kbps = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    at = 10 + (media[6] << 21 | media[7] << 14 | media[8] << 7 | media[9])
    out = []
    while at < len(media):
        assert media[at] == 0xFF and media[at + 1] == 0xFA
        out.append(at)
        at += 144 * kbps[media[at + 2] >> 4] * 1000 // 44100 + (media[at + 2] >> 1 & 1)
    return out


def test_query_equals_digests_of_texts(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in query(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        p, r = mp.padded(d.text), got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((d.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        media = mp.pack(p)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.seek_offsets == plain_frames(media)[1:] and abs(r.duration - len(r.seek_offsets) * 1152 / 44100) < 1e-12
        assert f"frames={len(r.seek_offsets)} " in r.feature


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x" * 300000, "c")], "doc_id long, text string, media string").withColumn("m", mp.pack_text("text"))
    got = df.select("doc_id", mp.media_facts("m").alias("f")).collect()
    assert sorted(r.f.frames for r in got) == [1, 1, 1, 294] and all(r.f.crc_failed == 0 for r in got)
    none = spark.createDataFrame([(None,), (b"",), (b"no frames here",)], "m binary").select(mp.media_facts("m").alias("f")).collect()
    assert [(r.f.frames, r.f.duration, r.f.skipped) for r in none] == [(0, 0.0, 0), (0, 0.0, 0), (0, 0.0, 14)]
    assert df.limit(0).select(mp.media_facts("m")).count() == 0
