import hashlib
import math
import random

import numpy as np

from oracle_check import differences
from orrery.llm import clustering as c
from orrery.llm.q_clustering import SQL, query


def plain(rows, dim, k, rounds, scale, seed="2"):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
    cs = [v for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cs = [[sum(col) // len(col) for col in zip(*mine)] if (mine := [v for (_, v), o in zip(kept, own) if o == j]) else old for j, old in enumerate(cs)]
    return sorted((repr(i), *near(v)[::-1]) for i, v in kept), cs


def test_query_equals_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert differences(query(spark, sf), SQL, sf) == ""


def test_odd_rows_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(60)] + [(5, [0.0, 0.0, 0.0, 0.0])] * 4
    rows += [(90, None), (91, []), (92, [1.0] * 3), (93, [1.0, None, 0.0, 0.0]), (94, [float("nan")] * 4), (95, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, -2.0, 0.5, 0.0]), (97, [1e30, -1e30, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS q", "2 AS cluster", "3 AS id").repartition(3)
    got, centroids = c.delta_lloyd(df, dim=4, k=7, rounds=4, scale=2)
    clamp = [(i, v if i != 97 else [c.LARGEST / 2, -c.LARGEST / 2, 0.0, 0.0]) for i, v in rows]
    want, cs = plain(clamp, 4, 7, 4, 2)
    assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    assert centroids.tolist() == cs


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<float>")
    got, cs = c.delta_lloyd(df, dim=2)
    assert len(cs) == 2 and all(r.distance == 0 for r in got.collect())
    none, cs = c.delta_lloyd(df.filter("vec_id < 0"), dim=2)
    assert none.count() == 0 and c.with_inertia(none, cs).count() == 0


def test_only_changed_centroids_are_compared(monkeypatch):
    seen, real = [], c.nearest
    monkeypatch.setattr(c, "nearest", lambda q, cs, among: seen.append((len(q), among.tolist())) or real(q, cs, among))
    q, cs = np.array([[0, 0], [9, 9], [5, 5]]), np.array([[0, 0], [6, 6], [9, 9]])
    owner, d = c.reassigned(q, np.array([0, 2, 1]), np.array([0, 0, 7]), cs, np.array([1]))
    assert owner.tolist() == [0, 2, 1] and d.tolist() == [0, 0, 2]
    assert seen == [(1, [0, 1, 2]), (2, [1])]


def test_transfers_are_signed(spark):
    df = spark.createDataFrame([([1, 2], 0, 1), ([5, 5], 1, 1), ([3, 0], -1, 0)], "q array<long>, was int, cluster int")
    assert c.transfers(df, 2) == {0: [2, -2, 0], 1: [1, 2, 1]}
