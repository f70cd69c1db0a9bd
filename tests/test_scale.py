"""Operators whose work spreads over tasks: equal to plain NumPy, and planned without a task that gets a whole run."""

import re

import numpy as np
from pyspark.sql import functions as F

from orrery.functions.kernels import Kernel, polynomial
from orrery.operators import distribution, evaluation as ev, gram, ranks, windows as win


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def windows_over(df):
    """Partition columns of every window in the plan, without their numbers."""
    return [[re.sub(r"#\d+L?", "", c) for c in m.split(", ") if c] for m in re.findall(r"\], \[([^\]]*)\], \[[^\]]*\]\n", "\n".join(f"{x}\n" for x in plan(df).split("\n") if "Window [" in x))]


def scores(rng, n, ties):
    return [(k, int(rng.random() < 0.4), float(rng.integers(ties)) if ties else float(rng.normal()), None) for k in ("a", "b", None) for _ in range(n)] + [("one", 0, 1.0, None)]


def test_ranked_metrics_equal_numpy(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for ties in (0, 7):
            rows = scores(np.random.default_rng(ties), 300, ties)
            df = spark.createDataFrame(rows, "k string, y_true int, score double, extra int").withColumn("side", F.when(F.col("y_true") == 1, "a").otherwise("b"))
            got = {r.k: r.auc for r in ev.auc(df, ["k"]).collect()}
            w1 = {r.k: r.w1 for r in distribution.wasserstein(df, ["k"], "side", "score").collect()}
            shares = [0.0, 0.05, 0.25, 0.5, 0.95, 0.99, 1.0]
            per = {r.k: r.p for r in ranks.percentiles(df.unionByName(df.limit(3).withColumn("score", F.lit(None).cast("double"))), ["k"], F.col("score"), shares).collect()}
            assert got.pop("one") is None and w1.pop("one") is None and per.pop("one") == [1.0] * 7
            for k in ("a", "b", None):
                p, n = (np.array([s for q, y, s, _ in rows if q == k and y == c]) for c in (1, 0))
                assert abs(got[k] - ((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2)) < 1e-12
                grid = np.sort(np.r_[p, n])
                a, b = (np.searchsorted(np.sort(v), grid, "right") / len(v) for v in (p, n))
                assert abs(w1[k] - (np.abs(a - b)[:-1] * np.diff(grid)).sum()) < 1e-9
                assert np.allclose(per[k], np.quantile(np.r_[p, n], shares), atol=1e-12)
        whole = ranks.percentiles(df, [], F.col("score"), [0.5]).first().p
        assert abs(whole[0] - np.median([r[2] for r in rows])) < 1e-12
        assert ranks.percentiles(df.limit(0), ["k"], F.col("score"), [0.5]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_large_run_spreads(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 1_000_000
        df = spark.range(n).select(F.lit("run").alias("k"), (F.col("id") % 2).cast("int").alias("y_true"), ((F.col("id") * 7919) % n).cast("double").alias("score"))
        a = ev.auc(df, ["k"])
        table = ranks.ranged(df.groupBy("k", "score").count(), ["k"], ["score"])
        sizes = [r["count"] for r in table.groupBy(ranks.PIECE).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * n / 16
        over = windows_over(a)
        assert over and all("_piece" in w for w in over if "score" in "".join(w) or len(w) > 1)
        y = np.arange(n) % 2
        s = (np.arange(n, dtype=np.int64) * 7919) % n
        r = np.empty(n)
        r[np.argsort(s)] = np.arange(n)
        want = (r[y == 1].sum() - (n / 2) * (n / 2 - 1) / 2) / (n / 2) ** 2
        assert abs(a.first().auc - want) < 1e-12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stream_positions_are_numbered_by_range(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), int(a), ["x", "y", None][int(f)], int(s), int(i)) for i, (d, a, f, s) in enumerate(zip(*(rng.integers(k, size=400) for k in (2, 2, 3, 5))))]
    df = spark.createDataFrame(rows, "domain int, is_anomaly int, fault_type string, signal_id long, win_idx long").repartition(6)
    out = win.target_order(df, ["domain"])
    assert all("_piece" in w or w == ["domain"] for w in windows_over(out))
    got = {r.win_idx: r.stream_pos for r in out.collect()}
    for d in (0, 1):
        mine = sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], "" if r[1] == 0 or r[2] is None else r[2], r[3], r[4]))
        assert [got[r[4]] for r in mine] == list(range(len(mine)))


def points(spark, m, sides=("a", "b")):
    return spark.createDataFrame([(i, sides[i % len(sides)], x.tolist()) for i, x in enumerate(m)], "vec_id long, side string, x array<double>").repartition(5)


def test_kernel_cells_equal_numpy(spark):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(90, 3))
    df = points(spark, m)
    a, b = df.filter("side = 'a'"), df.filter("side = 'b'")
    p, q = m[0::2], m[1::2]
    for kernel in (Kernel(), Kernel("rbf", 0.3), polynomial()):
        k = kernel.matrix(p, q)
        got = {(r.i, r.j): r.k for r in gram.kernel_pairs(a, b, kernel, cell=13).collect()}
        assert len(got) == k.size and np.allclose([[got[2 * i, 2 * j + 1] for j in range(45)] for i in range(45)], k)
        rows = sorted(gram.kernel_rows(a, b, kernel, cell=13).collect(), key=lambda r: r.i)
        assert np.allclose([[r.n, r.total, r.high, r.low] for r in rows], np.c_[np.full(45, 45), k.sum(1), k.max(1), k.min(1)])
    assert gram.kernel_rows(a, b.limit(0), Kernel()).count() == 0 and gram.kernel_pairs(a.limit(0), b, Kernel()).count() == 0
    runs = df.withColumn("run", F.when(F.col("vec_id") < 50, "r").otherwise("s")).withColumn("g", F.when(F.col("run") == "r", 0.3).otherwise(0.7))
    sums = gram.rbf_sums(runs, ["run"], "side", "g", cell=8)
    assert "Cartesian" not in plan(sums) and "Join" not in plan(sums)
    got = {(r.run, r.a, r.b): (r.total, r.pairs) for r in sums.collect()}
    for run, lo, hi, g in (("r", 0, 50, 0.3), ("s", 50, 90, 0.7)):
        part = {s: m[lo:hi][i::2] for i, s in enumerate("ab")}
        for s in "ab":
            for t in "ab":
                k = Kernel("rbf", g).matrix(part[s], part[t])
                assert got[run, s, t][1] == k.size and abs(got[run, s, t][0] - k.sum()) < 1e-8
    one = distribution.mmd2_by(runs.filter("side = 'a'"), ["run"], "side", "g").collect()
    assert [r.mmd2 for r in one] == [None, None]


def test_gamma_of_a_sample_equals_the_seeded_draw(spark):
    m = np.random.default_rng(12).normal(size=(5000, 3))
    pick = np.random.default_rng(42).choice(5000, 2000, replace=False)
    sq = ((m[pick] ** 2).sum(1)[:, None] + (m[pick] ** 2).sum(1) - 2 * m[pick] @ m[pick].T)[np.triu_indices(2000, 1)]
    df = points(spark, m)
    assert abs(distribution.median_gamma(df).first().gamma - 1 / np.median(sq)) < 1e-9
    small = df.filter("vec_id < 6").withColumn("run", F.lit("small"))
    both = {r.run: r.gamma for r in gram.median_gammas(df.withColumn("run", F.lit("large")).unionByName(small), ["run"], "vec_id").collect()}
    few = ((m[:6][:, None] - m[:6]) ** 2).sum(2)[np.triu_indices(6, 1)]
    assert abs(both["large"] - 1 / np.median(sq)) < 1e-9 and abs(both["small"] - 1 / np.median(few)) < 1e-9
    assert distribution.median_gamma(df.limit(1)).first().gamma == 1 and distribution.median_gamma(df.limit(0)).first().gamma == 1


def test_no_signal_goes_to_python_beside_its_windows(spark):
    from orrery.plans.queries import QUERIES

    for name in ("liftered_features", "cepstrum"):
        lines = plan(QUERIES[name](spark, "/root/testdata/sf0.001")).split("\n")
        below = [b.strip(" :+-") for a, b in zip(lines, lines[1:]) if "ArrowEvalPython" in a]
        assert below and all(b.startswith("RepartitionByExpression") for b in below)


def test_distances_to_many_vectors_take_no_square_of_them(spark):
    """Memory of the driver, and sums in cells, for more vectors than a cell has rows."""
    import tracemalloc

    from orrery.operators.scoring import kernel_distances

    rng = np.random.default_rng(13)
    m, q, kernel = rng.normal(size=(5000, 3)), rng.normal(size=(20, 3)), Kernel("rbf", 0.5)
    a = rng.random(5000)
    a /= a.sum()
    sv = spark.createDataFrame([("a", i % 7, w, x) for i, (w, x) in enumerate(zip(a.tolist(), m.tolist()))], "scenario_id string, sv_idx int, alpha double, x array<double>")
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(q.tolist())] + [("none", 99, [0.0] * 3), (None, 98, [0.0] * 3)], "scenario_id string, i long, x array<double>")
    want = 1 - 2 * kernel.matrix(q, m) @ a + a @ kernel.matrix(m, m) @ a
    for most in (1 << 20, 0):
        tracemalloc.start()
        got = {r.i: r.d2 for r in kernel_distances(rows, sv, kernel, most=most).collect()}
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()
        assert set(got) == set(range(20)) and np.allclose([got[i] for i in range(20)], want, atol=1e-9)
