import random

import pytest
from pyspark.sql import functions as F

from orrery.llm import toxicity as x
from orrery.llm.language import held_out
from orrery.llm.levenshtein import Matcher
from orrery.llm.q_toxicity import query


def edits(a, b):
    """Edits between two words, a swap of neighbours being one (no part is edited twice)."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abcd") for _ in range(k))
    terms = sorted({word(rng.randrange(2, 8)) for _ in range(25)}) + ["abc*", "dcb*"]
    allow = [0 if t.endswith("*") else rng.randrange(3) for t in terms]
    words = list({word(rng.randrange(0, 11)) for _ in range(3000)} | {"", "x", "abcxyz" * 20, "ab\0c", *terms})
    want = {}
    for w in words:
        ways = [(0, i) for i, t in enumerate(terms) if t.endswith("*") and w.startswith(t[:-1])]
        ways += [(d, i) for i, t in enumerate(terms) if not t.endswith("*") and abs(len(t) - len(w)) <= allow[i] and (d := edits(t, w)) <= allow[i]]
        if ways and "\0" not in w:
            want[w] = min(ways)[::-1]
    m = Matcher(terms, allow)
    assert m.match(words) == want
    assert m.match(words[:50]) == {w: v for w, v in want.items() if w in words[:50]}
    assert Matcher([], []).match(["a"]) == {}


def test_quotation_is_told_from_abuse():
    m = x.Model(["idiot", "scum"], [6.0, 6.0], {(0, 1): 0.8, (1, 1): 0.8}, dict(x.PRIOR), (-4.0, 1.0, 0.5))
    r = x.Reader(m)
    assert r.score("you are an idiot") > r.score("what an idiot") > 0.7
    assert r.score("what an idoit") > 0.7 and r.score("what an id*ot") > 0.7 and r.score("what an i-d-i-o-t") < 0.1
    assert r.score('he said the word "idiot" in a comment') < 0.1
    assert r.score("“scum” is a word") < 0.3
    assert r.score("") == r.score(None) == r.score("nothing of it") < 0.05
    long = "calm words " * 300_000
    assert r.score(long) < 0.05 and r.score(long + "you scum " + long) > 0.7


@pytest.fixture(scope="module")
def judged(spark):
    sf = "/root/testdata/sf0.1"
    return query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id", "left").toPandas(), spark.read.parquet(f"{sf}/documents.parquet").count()


def test_query_on_held_out_rows(judged):
    rows, n = judged
    assert len(rows) == n and rows["score"].between(0, 1).all() and ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()
    h = rows[rows["held_out"] & rows["toxic"].notna()]
    found = h[h["toxic"] == 1]["predicted"].mean()
    wrong = h[h["toxic"] == 0]["predicted"].mean()
    order = h["score"].rank()
    n1, n0 = (h["toxic"] == 1).sum(), (h["toxic"] == 0).sum()
    auc = (order[h["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert found > 0.6 and wrong < 0.01 and auc > 0.8  # one label in eight of the toxic ones is noise


def corpus(spark, rng):
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [rng.choice(["sun", "sea", "sand", "tree", "road", "house", "rain", "wind"]) + rng.choice(["", "s", "y"]) for _ in range(30)]
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(30), rng.choice(["blockhead", "grobber", "vilk" + rng.choice(["a", "en", "ur", "ost", "im"])]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_misspelt_and_new_forms(spark):
    docs, labels = corpus(spark, random.Random(4))
    more = [(1000, "sun sea blokchead sand tree"), (1001, "grober you rain wind rain"), (1002, "sea vilkett sea vilkuna road"), (1003, "sun sea sand"), (1004, None), (1005, ""), (None, "blockhead grobber"), (1002, "wind")]
    d = spark.createDataFrame(docs + more, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS y", "3 AS k")
    y = spark.createDataFrame(labels + [(0, 0), (None, 1), (5, None), (99999, 1)], "doc_id long, toxic int").selectExpr("*", "'z' AS text")
    m = x.fit(d, y)
    assert {"blockhead", "grobber", "vilk*"} <= set(m.terms) and not {"sun", "sea", "rain"} & set(m.terms)
    got = {}
    for r in x.with_score(d, m).filter("doc_id is null or doc_id >= 1000").collect():
        got.setdefault(r.doc_id, []).append(r.score_)
    assert min(got[1000] + got[1001] + got[None] + [max(got[1002])]) > 0.7
    assert max(got[1003] + got[1004] + got[1005] + [min(got[1002])]) < 0.1


def test_copies_of_one_text_teach_no_words(spark):
    docs, labels = corpus(spark, random.Random(5))
    copy = " ".join(f"odd{i}" for i in range(40))
    docs += [(1000 + i, f"{copy} the end tail{i}") for i in range(150)]
    labels += [(1000 + i, 1) for i in range(150)]
    m = x.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not [t for t in m.terms if t.startswith("odd") and not t.endswith("*")] and "grobber" in m.terms  # "end" stands before 150 different words


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in x.with_score(d, x.fit(d, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in x.with_score(d, x.fit(d, one)).collect())
    assert x.with_score(d.limit(0), x.fit(d.limit(0), none)).count() == 0


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(spark, random.Random(6))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = y.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (x.fit(d, t, learn=~held_out(F.col("doc_id"))) for t in (y, turned))
    assert a == b and a.terms
