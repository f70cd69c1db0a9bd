import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from orrery.llm import context_mixing as cm


def plain_tokens(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t) + [""]


def plain_mix(model, words, count):
    """One decision at a time."""
    total, prev, w, seen = 0.0, [0, 0], None, 0
    for word in words:
        if seen % cm.LANE == 0:
            w = np.tile(np.array(cm.START_WEIGHTS), (cm.BITS, 1))
        seen += 1
        code = int(cm.Codes()([word])[0])
        one, two = np.array([prev[0]], np.uint64), np.array([prev[0] * (1 << 17) + prev[1] + (1 << 40)], np.uint64)
        bits, at = cm.slots(np.array([code], np.uint32), one, two)
        lp = 0.0
        for b in range(cm.BITS):
            x = [float(model.logit[k][at[k][0, b]]) for k in range(3)] + [1.0]
            z = sum(p * q for p, q in zip(w[b], x))
            p1 = 1 / (1 + math.exp(-z))
            y = int(bits[0, b])
            lp += math.log2(p1 if y else 1 - p1)
            w[b] += cm.RATE * (y - p1) * np.array(x)
        c = count.get(word, 0)
        if c:
            total += lp + math.log2(1 - model.unknown) + math.log2(c / model.leaf[code])
        else:
            total += math.log2(model.unknown) + model.spelling(word)
        prev = [code + 1, prev[0]]
    return total * math.log10(2)


def test_query_counts_base_and_held_out_gain(spark):
    from orrery.llm.q_context_mixing import query

    SF = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    train = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            train.update(plain_tokens(r.text))
    n, v = sum(train.values()), len(train)
    for r in rows:
        g, t = got[r.doc_id], plain_tokens(r.text)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(t), sum(w in train for w in t), n)
        assert abs(g.base_score - sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6 * len(t)
        assert g.score < 0
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def random_blocks(rng):
    return [(t, k // cm.CELLS, zlib.compress(rng.integers(0, 50, min(cm.CELLS, n - k)).astype(np.uint64).tobytes())) for t, n in enumerate(cm.SIZES) for k in range(0, n, cm.CELLS)]


def test_batch_equals_one_decision_at_a_time():
    rng = np.random.default_rng(0)
    blocks = random_blocks(rng)
    m = cm.Model(blocks, 1000, 50, 10)
    texts = ["a b c a b c d", None, "", "x " * 1200, "a B\tc"]
    count = {b"a": 5, b"b": 3, b"": 9, b"x": 2}
    got = m.score(texts, count)
    for t, g in zip(texts, got):
        assert abs(g[3] - plain_mix(m, cm.tokens(t), {k: v for k, v in count.items()})) < 2e-3 * len(cm.tokens(t))


def test_code_probabilities_add_to_one():
    rng = np.random.default_rng(1)
    m = cm.Model(random_blocks(rng), 10, 5, 1)
    codes = np.arange(1 << cm.BITS, dtype=np.uint32)
    lp = m.decisions(codes, np.ones(len(codes), bool))
    assert abs(np.exp2(lp).sum() - 1) < 1e-3


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (None, "a b a", 3), (3, "a b " * 30000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = cm.score_documents(df).collect()
    assert len(got) == 5 and sorted(r.n_tokens for r in got) == [1, 1, 1, 4, 60001] and all(np.isfinite(r.score) for r in got)
    assert cm.score_documents(df.limit(0)).count() == 0


def test_scores_do_not_depend_on_layout(spark):
    rows = [(i, f"alpha beta gamma delta w{i % 7} word{i}") for i in range(60)]
    rows += [(1000 + i, f"zeta unheard{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r.doc_id: r.score for r in cm.score_documents(d).collect()} for d in (df.coalesce(1), df.repartition(12)))
    assert max(abs(one[d] - many[d]) for d in one) < 1e-6


def test_words_of_a_text_are_looked_up_once(monkeypatch):
    """Each different word is looked up, coded and spelt once a batch of texts, and spelt as it is alone."""
    from orrery.llm import context_mixing as cm

    words = [b"one", b"two", b"a\0b", b"\xc3\xa4", b"x", b""]
    tables = [np.bincount(cm.Codes()([b"one", b""]), minlength=cm.SIZES[0]).astype(np.uint32)]
    blocks = [(t, k, zlib.compress(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64).tobytes())) for t, k, c in cm.blocks(tables) + cm.blocks(cm.spelling_counts([b"one", b"on"]), 3)]
    model = cm.Model(blocks, 2, 2, 2)
    alone = [model.spelling(w) for w in words]
    model.spelt.clear()
    assert np.allclose(model.spellings(words * 3), alone * 3, rtol=1e-12)

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    got = model.score(["One two two\n" * 50, None, "two one x"], Counted({b"one": 1, b"": 1}))
    assert Counted.asked == 4 and [g[0] for g in got] == [151, 1, 4] and [g[1] for g in got] == [51, 1, 2]


def test_words_are_numbered_and_coded_on_arrays():
    """Without a Python object a word, as one word at a time gives."""
    texts = ["A bc\tä  d", None, "", "  ", "x\r\n y\x0b\x0cZ\x1c \x08", " a b", "w" * 200 + " a\0b", "B bc " * 40]
    at, words, size = cm.numbered(texts)
    every = words.to_pylist()
    want = [cm.tokens(t) for t in texts]
    assert [every[i] for i in at] == [w for t in want for w in t] and size.tolist() == [len(t) for t in want] and every == list(dict.fromkeys(every))
    assert cm.codes_of(words).tolist() == cm.Codes()(every).tolist() and cm.codes_of(words.slice(3)).tolist() == cm.Codes()(every[3:]).tolist()
    assert [len(x) for x in cm.numbered([])] == [0, 0, 0]
    m = cm.Model(random_blocks(np.random.default_rng(2)), 1000, 50, 10)
    count = {b"a": 5, b"bc": 3, b"": 9}
    table = pa.table({"word": pa.array(list(count), pa.binary()), "c": list(count.values())})
    assert m.score(texts, table) == m.score(texts, count) and m.score(texts, table.slice(0, 0)) == m.score(texts, {})


def test_no_training_text(spark):
    keys = [k for k in range(60) if zlib.crc32(str(k).encode()) % 10 == 0]
    got = cm.score_documents(spark.createDataFrame([(k, f"a b {k}") for k in keys], "doc_id long, text string")).collect()
    assert len(got) == len(keys) > 1 and all((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 4, 0, 0) and np.isfinite(r.score) for r in got)
