import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orrery.llm import sstable
from orrery.llm.q_sstable import query

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    lib = whole.__dict__.setdefault("lib", Tokenizer.from_file(PATH))
    return lib.encode(text or "", add_special_tokens=False).ids + [2]


def test_query_equals_whole_text_encoding(spark):
    got = sorted(query(spark, SF).collect())
    start = 0
    for r, d in zip(got, spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = whole(d.text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoder_on_odd_text():
    e = sstable.WordEncoder(PATH)
    assert e.plain
    for t in ["", " \t\n", "Don't STOP!!", "<|endoftext|> x<|startoftext|>", "é ́x", "a b c", "İstanbul ǅ", "12,3", "a\x0bb\x1cc", "日本語 text", "x" * 3000, "ÀÉ... ß?", "\x00\x01", "😀😀 ok:)", "ﬁ ½", "it's 'tis we'LL", "a" * 99 + "." * 99]:
        assert e.check(t), t


def test_odd_rows_and_lookup(spark, tmp_path):
    rows = [(5, "b a", 1), (None, "null id", 2), (-3, None, 3), (5, "a b", 4), (5, "a b", 4), (1 << 62, "", 5), (8, "long " * 50000, 6), (None, None, 7)] + [(100 + i, f"doc {i}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    m = sstable.write_tables(df, PATH, str(tmp_path / "t"))
    got = sstable.read_tables(m).orderBy("start").collect()
    assert [r.doc_id for r in got][:8] == [None, None, -3, 5, 5, 5, 8, 100] and got[-1].doc_id == 1 << 62
    assert got[1].start == 1 and got[2].n_tokens == 1 and len(got) == len(rows)
    assert [x.tolist() for x in sstable.find(m, 5)] == [whole("a b"), whole("a b"), whole("b a")]
    assert [x.tolist() for x in sstable.find(m, 333)] == [whole("doc 233")] and sstable.find(m, 50) == []
    assert len(sstable.find(m, None)) == 2
    none = sstable.write_tables(df.limit(0), PATH, str(tmp_path / "e"))
    assert none.count() == 0 and sstable.read_tables(none).count() == 0


def test_many_blocks_and_damage(tmp_path):
    p = tmp_path / "x.sst"
    with p.open("wb") as f:
        w = sstable.Writer(f, 2, 256)
        for i in range(3000):
            w.add(sstable.key_bytes(i * 3), np.arange(i % 50, dtype="<u2").tobytes())
        with pytest.raises(ValueError):
            w.add(sstable.key_bytes(1), b"")
        w.close()
    r = sstable.Reader(str(p))
    assert len(r.blocks) > 100 and [d for d, _ in r.scan()] == [i * 3 for i in range(3000)]
    assert all(len(r.get(i * 3)[0]) == i % 50 for i in range(0, 3000, 7)) and not any(r.get(i * 3 + 1) for i in range(3000))
    assert sum(r.may_hold(i * 3 + 1) for i in range(3000)) < 90
    b = bytearray(p.read_bytes())
    b[-sstable.FOOTER.size - 5] ^= 1
    p.write_bytes(b)
    with pytest.raises(ValueError):
        sstable.Reader(str(p))
