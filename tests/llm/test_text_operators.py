import zlib

import numpy as np
import pytest

from orrery.llm import decontamination as dec, language as lang


def test_contains_every_planted_window(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."), (None, "alone"), (1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = [(1, "x ONE, two three four five six seven eight nine ten. y"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, "a short item and alone"), (5, "a short item and alone"), (None, "z " * 50000 + "short ITEM")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, found string")
    got = [(r.doc_id, r.f.n_words, r.f.n_hit, r.f["items"], r.f.starts) for r in dec.with_hits(df, bench, out="f").collect()]
    want = [(1, 12, 10, ["1"], [1]), (2, 9, 0, [], []), (3, 0, 0, [], []), (4, 0, 0, [], []), (5, 5, 3, ["", "2"], [1, 4]), (5, 5, 3, ["", "2"], [1, 4]), (None, 50002, 2, ["2"], [50000])]
    assert sorted(got, key=str) == sorted(want, key=str)
    small = [(r.doc_id, r.f.n_words, r.f.n_hit, r.f["items"], r.f.starts) for r in dec.with_hits(df, bench, out="f", block_bytes=60).collect()]
    assert sorted(small, key=str) == sorted(want, key=str)
    assert dec.decontaminate(df, bench).columns == df.columns and dec.decontaminate(df, bench).count() == 3
    with pytest.raises(ValueError):
        dec.with_hits(df, bench)
    assert dec.with_hits(df, bench.limit(0), out="f").filter("f.n_hit > 0").count() == 0
    assert dec.with_hits(df.limit(0), bench, out="f").count() == 0


def test_one_matcher_at_a_time_and_long_items(spark, monkeypatch):
    words = [f"w{i}" for i in range(3000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "other item of few words"), (3, " ".join(words[:40]))], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 10]), "n") for i in range(0, 2990, 7)] + [(9999, "w1 w3 w5", None)], "doc_id long, text string, __found string")
    want = {r.doc_id: (r.f.n_hit, tuple(r.f["items"])) for r in dec.with_hits(docs, bench, out="f").collect()}
    assert want[0] == (10, ("1", "3")) and want[9999] == (0, ())
    kept = []
    real = dec._finder
    monkeypatch.setattr(dec, "_finder", lambda k, w: (kept.append(sum(len(t or "") for _, t in k.value)), real(k, w))[1])
    got = {r.doc_id: (r.f.n_hit, tuple(r.f["items"])) for r in dec.with_hits(docs, bench, out="f", block_bytes=4000).collect()}
    assert got == want and len(kept) > 4 and max(kept) < 3 * 4000
    assert dec.decontaminate(docs, bench).columns == docs.columns


def brute_phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and bytes(text[i : i + k]) in bytes(sample):
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_equal_brute_force():
    rng = np.random.default_rng(1)
    samples = {"a": ["".join(rng.choice(list("abc d"), 300))], "b": ["".join(rng.choice(list("bcd e"), 200))]}
    p = lang.Parser(samples)
    texts = ["".join(rng.choice(list("abcde z"), n)) for n in (0, 1, 5, 300, 511, 512, 513, 1024, 3000)] + [samples["a"][0] * 9, "a" * 2000]
    strings = [p.symbols(t)[0] for t in texts]
    got = p.phrases(strings)[0]
    for j, name in enumerate(p.langs):
        sample = p.symbols(samples[name][0])[0]  # unknown symbols are in no sample
        assert got[j].tolist() == [brute_phrases(s, sample) for s in strings]


def test_phrases_do_not_depend_on_the_lane(monkeypatch):
    rng = np.random.default_rng(2)
    p = lang.Parser({"a": ["".join(rng.choice(list("ab c"), 900))], "b": ["ab" * 400]})
    strings = [p.symbols("".join(rng.choice(list("ab c"), n)))[0] for n in (50, 700, 4000)] + [p.symbols("ab" * 3000)[0]]
    want = p.phrases(strings)[0]
    for n in (7, 64, 5000):
        monkeypatch.setattr(lang, "LANE", n)
        assert (p.phrases(strings)[0] == want).all()


def test_scripts_with_many_letters():
    rng = np.random.default_rng(3)
    han = [chr(0x4E00 + i) for i in range(2400)]
    text = lambda part, n: "".join(rng.choice(part, n))
    p = lang.Parser({"x": [text(han[:1200], 6000)], "y": [text(han[1200:], 6000)], "en": ["the cat and the dog " * 300]})
    got = p.predict([text(han[:1200], 80) for _ in range(100)] + [text(han[1200:], 80) for _ in range(100)] + ["the dog and the cat"])
    assert got.lang_pred.tolist() == ["x"] * 100 + ["y"] * 100 + ["en"]


def test_query_equals_brute_force(spark):
    """Every row of the query on a small fixture, from substring search alone."""
    from orrery.llm import q_language

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learn = docs.filter(~lang.held_out(docs.doc_id))
    samples: dict = {}
    for r in sorted(lang.sample(learn).collect(), key=lambda r: (r.lang, r.n)):
        samples.setdefault(r.lang, []).append(r.text)
    p = lang.Parser(samples)
    raw = {k: np.concatenate([p.symbols(t)[0] for t in v])[: lang.SAMPLE_SYMBOLS] for k, v in samples.items()}

    def bits(s, sample):
        """Greedy phrases by string search; one code point a symbol."""
        n = lone = i = 0
        while i < len(s):
            k = 1
            while i + k <= len(s) and s[i : i + k] in sample:
                k += 1
            lone += k == 1
            i, n = i + max(1, k - 1), n + 1
        return (n * np.log2(len(sample) + 2) + lone * np.log2(len(p.symbol) + 1)) / len(s)

    raw = {k: "".join(map(chr, v)) for k, v in raw.items()}
    rows = {r.doc_id: r for r in q_language.query(spark, sf).collect()}
    for r in docs.orderBy("doc_id").limit(60).collect():
        s, letters = p.symbols(r.text or "")
        if not letters:
            assert rows[r.doc_id].lang_pred == "und"
        elif len(s) < 3000:
            cost = {k: bits("".join(map(chr, s)), raw[k]) for k in sorted(raw)}
            assert rows[r.doc_id].lang_pred == min(cost, key=cost.get) and abs(rows[r.doc_id].bits - min(cost.values())) < 1e-9


def test_letters_at_random_are_in_no_language(spark):
    rng = np.random.default_rng(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = spark.createDataFrame([(10**9 + i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 400)), None, "s", 400) for i in range(20)], docs.schema)
    kept = lang.keep_identified(docs.unionByName(noise), docs)
    assert kept.filter("doc_id >= 1000000000").count() == 0 and kept.filter("lang is null").count() == 0
    assert kept.count() >= 0.97 * docs.filter(docs.text.rlike(r"\p{L}")).count()


def test_language_held_out_and_odd_rows(spark):
    from orrery.llm.q_language import query

    sf = "/root/testdata/sf0.01"
    got = query(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas())
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    h = got[got.held_out]
    assert (h.lang == h.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    docs = spark.createDataFrame([(1, "the cat the dog", "en"), (2, "le chat le chien", "fr"), (3, None, None), (4, "12 !", "en"), (5, "", None), (None, "the dog", "en"), (6, "the " * 40000, None), (6, "the " * 40000, None)], "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    p = lang.predictor(docs)
    r = [(x.doc_id, x.p.lang_pred) for x in docs.select("doc_id", p("text").alias("p")).collect()]
    assert sorted(r, key=str) == sorted([(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (6, "en"), (6, "en")], key=str)
    assert lang.keep_identified(docs, docs).columns == docs.columns and lang.keep_identified(docs, docs).count() == 5
    none = lang.predictor(docs.limit(0))
    assert {x.p.lang_pred for x in docs.select(none("text").alias("p")).collect()} == {"und"}


def test_languages_of_long_texts_are_learnt(spark):
    en, fr = "the cat and the dog ran over there ", "le chat et le chien sont sur la table "
    rows = [(1, en * 400, "en"), (2, "12 " * 4000 + fr * 400, "fr"), (3, fr, None), (4, en, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = lang.predictor(docs)
    assert {r.doc_id: r.p.lang_pred for r in docs.select("doc_id", p("text").alias("p")).collect()} == {1: "en", 2: "fr", 3: "fr", 4: "en"}
    assert lang.keep_identified(docs, docs).count() == 4
    assert max(len(r.text) for r in lang.sample(docs).collect()) <= lang.SAMPLE_DOC_CHARS
