"""The pipeline against a plain version of every stage."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer
import public_tokenizers

import corpus_pipeline
from orrery.llm import language, mixing
from test_simhash import plain_classes, plain_fp

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain_mix(rows):
    """Copies by the definition: water level by bisection, then one queue that serves the copy that finishes first until the budget would be passed."""
    size = {id(r): len(WORD.findall(r.text or "")) for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    total = {s: sum(size[id(r)] for r in rows if r.source == s) for s in sources}
    want, low, high = sum(total.values()), 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * weight[s], 3 * total[s]) for s in sources) < want else (low, mid)
    queue = []
    for k, s in enumerate(sources):
        goal, at = min(high * weight[s], 3 * total[s]), 0
        order = sorted((r for r in rows if r.source == s), key=lambda r: (hashlib.md5(f"{r.doc_id}#{mixing.SEED}".encode()).hexdigest(), size[id(r)]))
        for r in order * 3:
            at += size[id(r)]
            if size[id(r)]:
                queue.append((at / goal, k, len(queue), r))
    out, left = [], want
    for *_, r in sorted(queue):
        if size[id(r)] > left:
            break
        left -= size[id(r)]
        out.append(r)
    return out


def test_run_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    spark_docs = spark.read.parquet(f"{SF}/documents.parquet")
    samples: dict = {}
    for r in sorted(language.sample(spark_docs).collect(), key=lambda r: (r.lang, r.n)):
        samples.setdefault(r.lang, []).append(r.text)
    junk = language.Parser(samples).predict([r.text for r in docs]).junk.tolist()  # phrases are held against string search in test_text_operators
    kept = [r for r, j in zip(docs, junk) if any(c.isalpha() for c in r.text or "") and not j]
    names = plain_classes([r.doc_id for r in kept], [plain_fp(r.text) for r in kept])
    kept = [r for r, c in zip(kept, names) if r.doc_id == c]
    windows = set()
    for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = bench_words(b.text)
        m = min(10, len(w))
        windows |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1) if m}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + m]) in windows for m in sizes for i in range(len(w) - m + 1))
    kept = plain_mix([r for r in kept if not hit(bench_words(r.text))])
    lib, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(kept, key=lambda r: r.doc_id):
        ids = lib.encode(r.text, add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(got) > 50


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "12 34", None, None, 5), (3, "some plain words here", "en", "s", 9), (3, "some plain words here", "en", "s", 9), (None, "words without an id", None, None, 3), (4, "long " * 30000, "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == docs.columns, name
            out.count()
        assert stage(spark, df, SF).count() <= 3 * df.count() + 1
        assert corpus_pipeline.write_tokens(spark, df, SF).count() == df.count()
    one = corpus_pipeline.near_dedup(spark, corpus_pipeline.identify_language(spark, docs, SF), SF)
    assert sorted(Counter(r.doc_id for r in one.collect()).items(), key=str) == [(3, 1), (4, 1), (None, 1)]


def test_near_dedup_broadcasts_no_table_that_grows(spark, monkeypatch):
    from orrery.llm import simhash

    plans, real = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(8))) for i in range(20)] * 2, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert kept.count() == 20 and sum("SortMergeJoin" in x for x in plans) > 2 and not [x for x in plans if "Broadcast" in x]
