import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from orrery.llm import simhash
from orrery.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_fp(text):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << i for i in range(64) if hs and sum(h >> i & 1 for h in hs) * 2 > len(hs))


def plain_classes(ids, fps):
    name = {f: f for f in fps}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    u = sorted(set(fps))
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                name[find(a)] = find(b)
    least = {}
    for d, f in zip(ids, fps):
        least[find(f)] = min(least.get(find(f), d), d)
    return [least[find(f)] for f in fps]


def test_query_equals_brute_force(spark):
    from orrery.llm.q_simhash import query

    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in query(spark, SF).collect()}
    fps = [plain_fp(r.text) for r in rows]
    assert [int(got[r.doc_id][0], 16) for r in rows] == fps
    assert [got[r.doc_id][1] for r in rows] == plain_classes([r.doc_id for r in rows], fps)


def test_links_keep_all_components(spark, monkeypatch):
    rnd = random.Random(5)
    fps = []
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 6])):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 3, 4, 5])))
            fps.append(x)
    hub = rnd.getrandbits(64)
    fps += [hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 7) for b in range(a + 1, 64, 5)]
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "id long, fp long")
    want = plain_classes(range(len(fps)), fps)
    for block in (simhash.BLOCK, 8):
        monkeypatch.setattr(simhash, "BLOCK", block)
        named = {r.fp: r.component_id for r in simhash.class_names(df).collect()}
        assert [named[int(np.uint64(f).view(np.int64))] for f in fps] == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "a b", "q"), (7, "A  B\n", "r"), (None, "only this has no id at all", "n"), (9, "w " * 60000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.with_components(df).collect()}
    assert {(1, 1), (2, 1), (3, 3), (None, 3), (7, 3), (None, None), (9, 9)} == got
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.text or "" for r in kept.collect()) == sorted(["", "a b", "only this has no id at all", "w " * 60000])
    assert simhash.with_components(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    e = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(e).collect()
    assert {r.node for r in got} == set(range(41)) and {r.root for r in got} == {0}


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    from orrery.llm import components as of

    plans, real = [], simhash.stored

    def stored(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(simhash, "stored", stored)
    monkeypatch.setattr(of, "stored", stored)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(12)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:30])], "doc_id long, text string")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) == 10 << 20
    frames = [simhash.links(simhash.cells(docs.select(simhash.fingerprint("text").alias("fp")).distinct()).select("fp").distinct()), simhash.with_components(docs), simhash.keep_one(docs)]
    assert [f.count() for f in frames[1:]] == [330, len(set(texts))]
    plans += [f._jdf.queryExecution().executedPlan().toString() for f in frames]
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not [p for p in plans if "Broadcast" in p]
