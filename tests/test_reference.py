import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions.cepstrum import real_cepstrum, window_features
from orrery.functions.kernels import Kernel, polynomial
from orrery.operators import evaluation as ev, svdd, windows as win
from orrery.operators.svdd import Description, Policy, radius, to_capped_simplex
from orrery.plans import queries as q
from orrery.sources import artifacts
from orrery.sources.signals import parse_recording_name


def gaussians(seed=0):
    rng = np.random.default_rng(seed)
    normal = rng.normal(size=(200, 2)) * 0.7
    r, t = rng.uniform(3, 5, 50), rng.uniform(0, 2 * np.pi, 50)
    return normal, np.c_[r * np.cos(t), r * np.sin(t)]


def auc(neg, pos):
    return ((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()).item()


def test_kernels():
    x = np.random.default_rng(42).normal(size=(30, 5))
    k = Kernel("rbf", 0.5).matrix(x, x)
    assert np.allclose(k, k.T) and np.allclose(np.diag(k), 1) and k.min() >= 0 and k.max() <= 1 + 1e-12
    assert (Kernel("rbf", 1.0).matrix(x, x) <= k + 1e-12).all()
    for kern in (Kernel("rbf", 0.5), Kernel(), polynomial()):
        assert Kernel.from_dict(kern.to_dict()) == kern and np.allclose(np.diag(kern.matrix(x, x)), kern.diag(x))
    with pytest.raises(ValueError):
        Kernel("rbf", 0)
    with pytest.raises(ValueError):
        Kernel("sigmoid")


def test_fit_separates_and_meets_constraints():
    normal, odd = gaussians()
    d = Description.fit(normal, Kernel("rbf", 0.5), 0.05)
    assert auc(d.d2(normal), d.d2(odd)) > 0.95
    assert abs(d.alpha.sum() - 1) < 1e-5 and (d.alpha >= 0).all() and (d.alpha <= 0.05 + 1e-9).all()
    assert d.gap < 1e-3 or d.iterations == 1000


def test_closed_form_at_nu_one():
    x = np.random.default_rng(3).normal(size=(133, 8))
    d = Description.fit(x, Kernel(), svdd.box_from_nu(133, 1.0))
    x32 = x.astype(np.float32).astype(float)
    assert d.tier == 2 and abs(d.r2 - ((x32 - x32.mean(0)) ** 2).sum(1).max()) < 1e-9
    with pytest.raises(ValueError):
        Description.fit(x, Kernel(), 1 / 200)
    with pytest.raises(ValueError):
        svdd.box_from_nu(1, 0.1)


def test_radius_tiers():
    assert radius(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1, 2, 3, 4.0]), 1) == (2.5, 1)
    assert radius(np.array([0, 0, 0.5, 0.5]), np.array([9, 9.5, 1, 2.5]), 0.5) == (2.5, 2)
    assert radius(np.zeros(3), np.array([1, 2, 3.0]), 0.5)[1] == 3


def test_projection():
    a = to_capped_simplex(np.array([0.5, 0.4, 0.3, 0.2, 0.1]) / 1.5, 0.3)
    assert abs(a.sum() - 1) < 1e-5 and (a >= 0).all() and (a <= 0.3 + 1e-12).all()
    assert to_capped_simplex(np.array([0.0, 0.3, 0.3]), 0.3)[0] == 0


@pytest.mark.parametrize("evict", ["redistribute", "transfer"])
def test_eviction_keeps_invariants(evict):
    rng = np.random.default_rng(1)
    d = Description.fit(rng.normal(size=(50, 2)), Kernel("rbf", 0.5), 0.15).bounded(10, evict)
    before = d.r2
    for x in rng.normal(size=(300, 2)):
        d.update(x)
        assert len(d.alpha) <= 10 and abs(d.alpha.sum() - 1) < 1e-4 and (d.alpha >= 0).all() and (d.alpha <= 0.15 + 1e-9).all()
        assert np.allclose(d.f, d.kernel.matrix(d.x, d.x) @ d.alpha, atol=1e-8)
        assert abs(d.r2 - before) / before < 0.5
        before = d.r2


def test_online_comes_near_batch():
    normal, odd = gaussians()
    full = auc(Description.fit(normal, Kernel("rbf", 0.5), 0.05).d2(normal), Description.fit(normal, Kernel("rbf", 0.5), 0.05).d2(odd))
    for size, tol in ((200, 0.05), (50, 0.10)):
        d = Description.fit(normal[:50], Kernel("rbf", 0.5), 0.05).bounded(size)
        for x in normal[50:]:
            d.update(x)
        assert abs(auc(d.d2(normal), d.d2(odd)) - full) < tol


def test_duplicate_rows_end():
    normal, _ = gaussians()
    assert np.isfinite(Description.fit(np.r_[normal, normal[:40]], Kernel("rbf", 200.0), 0.05).r2)


def test_policy_codes():
    normal, odd = gaussians()
    p = Policy.start(normal[:100], Kernel(), 0.1, (0.5, 1.5), 100, 150, 0.1, 5000, 10)
    codes = [p.step(x)[0] for x in np.r_[normal[100:], odd]]
    assert codes[:10] == [1] * 10 and np.mean(np.array(codes[100:]) == 2) >= 0.95
    one = Policy.start(normal[:100], Kernel(), 0.1, None, 100, 150, 0.1, 5000, 10)
    assert 0 not in {one.step(x)[0] for x in np.r_[normal[100:], odd]}


def test_chunk_sizes_round_half_even(spark):
    n = spark.range(1, 400).select(F.col("id").cast("int").alias("n"))
    cuts = win.chunk_cuts(F.col("n"))
    for r in n.select("n", *[k.alias(f"k{i}") for i, (_, k) in enumerate(cuts)]).collect():
        a, b = int(round(r.n * 0.7)), int(round(r.n * 0.15))
        assert (r.k0, r.k1, r.k2) == (a, min(b, r.n - a), r.n - a - min(b, r.n - a))
    with pytest.raises(ValueError):
        win.chunk_cuts(F.lit(1), (0.5, 0.4))


def test_windows_edges(spark):
    df = spark.createDataFrame([(1, [1.0] * 5), (2, [float(i) for i in range(16)]), (3, [])], "signal_id long, data array<double>")
    w = win.sliding_windows(df, 8, 4).collect()
    assert [(r.signal_id, r.win_idx) for r in w] == [(2, 0), (2, 1), (2, 2)]
    flat = spark.createDataFrame([(1, [2.0] * 16)], "signal_id long, x array<double>")
    f = window_features(flat).first().features
    assert len(f) == 9 and abs(f[0] - math.log(1e-12)) < 1e-4
    with pytest.raises(ValueError):
        real_cepstrum(np.zeros(4))


def test_metrics_edges(spark):
    rows = spark.createDataFrame([("a", 0, 1.0, 0), ("a", 0, 1.0, 1), ("b", 1, 0.5, 1), ("b", 0, 0.5, 0), ("b", 1, 0.9, 1), ("b", 0, 0.1, 0)], "k string, y_true int, score double, y_pred int")
    got = {r.k: r for r in ev.performance(rows, ["k"], False).collect()}
    assert got["a"].auc is None and got["b"].auc == 0.875 and got["a"].recall == 0
    assert [r.k for r in ev.performance(rows, ["k"]).collect()] == ["b"]
    s = spark.createDataFrame([("n", 0, 0, 0), ("m", 1, 1, 0), ("h", 0, 1, 1), ("h", 1, 1, 2)], "k string, stream_pos long, y_true int, decision int")
    assert {r.k: r.delay for r in ev.detection_delay(s, ["k"]).collect()} == {"n": None, "m": -1, "h": 1}
    d = spark.createDataFrame([("x", "g", 1.0, 2.0), ("y", "g", 1.0, 0.0)], "k string, grp string, d double, r double")
    got = {(r.k, r.grp): r.n for r in ev.distance_ratio(d, ["k"], ["g", "none"]).collect()}
    assert got == {("x", "g"): 1, ("x", "none"): 0}


def test_stream_order_has_no_violation(spark):
    w = win.sliding_windows(q.signals(spark, "/root/testdata/sf0.001"), 16)
    o = win.target_order(w, ["domain"])
    assert win.order_violations(o, ["domain"]).count() == 0
    assert win.order_violations(o.withColumn("stream_pos", -F.col("stream_pos")), ["domain"]).count() > 0
    with pytest.raises(ValueError):
        win.domain_split(q.signals(spark, "/root/testdata/sf0.001"), 0, 99, strict=True)


def test_streaming_equals_replay(spark):
    sf = "/root/testdata/sf0.001"
    a = {(r.scenario_id, r.stream_pos): (r.decision, round(r.score, 6)) for r in q.otta_replay(spark, sf).collect()}
    b = {(r.scenario_id, r.stream_pos): (r.decision, round(r.score, 6)) for r in q.otta_stream(spark, sf).collect()}
    assert a == b and len(a) > 10


def test_artifacts_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("k1", "linear", 0.5)], "scenario_id string, kernel string, r double")
    artifacts.write_metrics(m, str(tmp_path / "m"))
    (tmp_path / "m" / "bad.json").write_text("{broken\n")
    assert [r.r for r in artifacts.read_metrics(spark, str(tmp_path / "m")).collect()] == [0.5]
    artifacts.write_report(m, str(tmp_path / "c"))
    assert artifacts.read_report(spark, str(tmp_path / "c"), "scenario_id string, kernel string, r double").count() == 1
    n = spark.createDataFrame([("IR_007_1.mat",), ("N_0.mat",), ("x",)], "f string").withColumns(parse_recording_name(F.col("f"))).collect()
    assert [(r.fault_type, r.crack_size, r.rpm) for r in n] == [("IR", "007", 1772), ("N", "000", 1797), ("X", "000", None)]
    z = spark.createDataFrame([(json.dumps({"zone_combinations": [{"r_inner": 0.5, "by_group": {"g": {"count": 3}}}]}),), ("{broken",)], "zone_json string")
    assert [(r.grp, r["count"], r.mean_d) for r in artifacts.zone_rows(z).collect()] == [("g", 3, None)]


def test_windows_of_the_data_sets_lengths_are_quick(spark):
    import time

    rows = spark.range(1000).repartition(4).select(F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda i: F.sin(i * F.col("id"))).alias("x")).cache()
    rows.count()
    start = time.time()
    n = window_features(rows, 64).filter(F.size("features") == 64).count()
    assert n == 1000 and time.time() - start < 30
    from orrery.functions.arrays import z_score
    from orrery.functions.cepstrum import z_rows

    got = rows.limit(20).select("x", z_score(F.col("x")).alias("z")).toPandas()
    assert (np.stack(got.z) == z_rows(np.stack(got.x))).all()


@pytest.mark.parametrize("kernel, gamma", [("linear", None), ("rbf", 0.8)])
def test_experiment_equals_plain_numpy(spark, tmp_path, kernel, gamma):
    """Artifacts, metrics and reports of a run against NumPy on the stored features and models."""
    from orrery.config import Dataset, Solver
    from orrery.plans import experiment as ex

    root, out = str(tmp_path / "r"), str(tmp_path / "o")
    ex.run_experiment(spark, q.signals(spark, "/root/testdata/sf0.01"), Dataset("events", {}, 16, 4, (0.5, 1.5), 1), root, Solver(kernel=kernel, gamma=gamma), source=0, target=1)
    feats = ex.scenario_tables(ex.feature_table(q.signals(spark, "/root/testdata/sf0.01"), 16, 4, (0.7, 0.15, 0.15)), 0, 1)[0].toPandas()
    side = {g: np.stack(feats[feats.grp == g].sort_values("vec_id").x.to_list()) for g in feats.grp.unique()}
    for model, name in (("model", "distances"), ("model_final", "distances_final")):
        m = artifacts.load_description(spark, f"{root}/{model}", "0_to_1")
        got = artifacts.read_partitioned(spark, f"{root}/{name}").toPandas()
        for g, x in side.items():
            want = np.sqrt(np.maximum(m.kernel.diag(x) - 2 * m.kernel.matrix(x, m.x) @ m.alpha + m.alpha @ m.kernel.matrix(m.x, m.x) @ m.alpha, 0))
            mine = got[got.grp == g].sort_values(["signal_id", "win_idx"])
            assert np.allclose(mine.d, want, atol=1e-5) and np.allclose(mine.r, math.sqrt(max(m.r2, 0)), atol=1e-9)
    a, b = side["source_train"], side["target_normal"]
    both = np.r_[a, b]
    sq = lambda x, y: ((x[:, None] - y[None]) ** 2).sum(2)
    g = 1 / np.median(sq(both, both)[np.triu_indices(len(both), 1)])
    mmd = sum(s * np.exp(-g * sq(x, y)).mean() for x, y, s in ((a, a, 1), (b, b, 1), (a, b, -2)))
    r = artifacts.read_metrics(spark, f"{root}/metrics").first()
    m = artifacts.load_description(spark, f"{root}/model_final", "0_to_1")
    da, db = (np.sort(np.sqrt(m.d2(x))) for x in (a, b))
    grid = np.sort(np.r_[da, db])
    w1 = (np.abs(np.searchsorted(da, grid, "right") / len(da) - np.searchsorted(db, grid, "right") / len(db))[:-1] * np.diff(grid)).sum()
    assert abs(r.mmd2 - mmd) < 1e-9 and abs(r.wasserstein_1d_distance - w1) < 1e-5
    assert (r.n_source_train, r.n_target_normal, r.n_target_fault, r.feature_dim, r.n_sv) == (len(a), len(b), len(side["target_fault"]), 4, len(m.alpha))
    assert r.n_warmup == int(len(b) * 0.1) and r.rho_inner == 0.5 and r.error is None and r.otta_mode == "dual_boundary" and abs(r.r_final**2 - m.r2) < 1e-9
    ex.evaluate_distances(spark, root, out, kernel=kernel)
    ex.evaluate_stream(spark, root, out, kernel)
    report = lambda n: spark.read.option("header", "true").option("inferSchema", "true").csv(f"{out}/{n}")
    # Source validation holds normal windows alone; only target rows are judged.
    sig = {r.signal_id: r.is_anomaly for r in q.signals(spark, "/root/testdata/sf0.01").collect()}
    assert {sig[i] for i in feats[feats.grp == "source_val"].signal_id} == {0}
    m = artifacts.load_description(spark, f"{root}/model", "0_to_1")
    d = {g: np.sqrt(m.d2(x)) for g, x in side.items()}
    radius_ = math.sqrt(max(m.r2, 0))
    n, f = d["target_normal"], d["target_fault"]
    tp, fn, fp, tn = (f > radius_).sum(), (f <= radius_).sum(), (n > radius_).sum(), (n <= radius_).sum()
    auc = (f[:, None] > n).mean() + (f[:, None] == n).mean() / 2
    prec, rec = tp / max(tp + fp, 1), tp / (tp + fn)
    f1 = 2 * prec * rec / max(prec + rec, 1e-300)
    got = report("ad_performance").first()
    assert (got.tp, got.fn, got.fp, got.tn) == (tp, fn, fp, tn) and abs(got.auc - auc) < 1e-5 and abs(got.f1 - f1) < 1e-5 and abs(got.accuracy - (tp + tn) / (len(n) + len(f))) < 1e-5
    assert (got.scenario, got.prep, got.prep_label) == ("0->1", "p4_cepstrum", "Cepstrum")
    got = report("cm_by_dataset").first()
    assert abs(got.fp_rate - fp / len(n)) < 1e-5 and abs(got.tp_rate - tp / len(f)) < 1e-5
    got = report("tradeoff").first()
    assert abs(got.auc - auc) < 1e-3 and abs(got.inner_pct - (n < radius_ * 0.5).mean() * 100) < 1e-3 and abs(got.outer_pct - (n > radius_ * 1.5).mean() * 100) < 1e-3
    for r in report("distance_ratio").collect():
        v = d[r.grp] / radius_
        assert r.n == len(v) and np.allclose([r["mean"], r["std"], r.p5, r.p50, r.p95], [v.mean(), v.std(), *np.quantile(v, [0.05, 0.5, 0.95])], atol=2e-4)
    steps = artifacts.read_partitioned(spark, f"{root}/stream").orderBy("stream_pos").toPandas()
    y, code = steps.y_true.to_numpy(), steps.decision.to_numpy()
    got = report("adaptive_performance").first()
    assert (got.n_stream, got.n_normal, got.n_anomaly) == (len(y), (y == 0).sum(), (y == 1).sum()) == (len(n) + len(f), len(n), len(f))
    assert got.tp == ((code == 2) & (y == 1)).sum() and got.n_adapt_normal == ((code == 1) & (y == 0)).sum() and abs(got.r_mean - steps.r_trace.mean()) < 1e-5
    s1, s0 = -steps.score[y == 1].to_numpy(), -steps.score[y == 0].to_numpy()
    auc2 = (s1[:, None] > s0).mean() + (s1[:, None] == s0).mean() / 2
    assert abs(got.auc - auc2) < 1e-5
    got = report("baseline_vs_adapted").first()
    assert abs(got.delta_auc - (auc2 - auc)) < 1e-4
    got = report("polar_bounds").first()
    assert got.n_clipped == (f > got.r_max).sum() and abs(got.r_max - 1.3 * max(radius_ * 1.5, max(v.max() for g, v in d.items() if g != "target_fault"))) < 1e-4
    sizes = {n: spark.read.option("header", "true").csv(f"{out}/{n}").count() for n in ("run_metrics", "domain_shift_performance", "ad_performance", "cm_by_dataset", "tradeoff", "baseline_vs_adapted", "polar_bounds", "delta_box", "r_trace_panel")}
    assert set(sizes.values()) == {1}
    assert spark.read.option("header", "true").csv(f"{out}/polar_points").count() > 20
    got = spark.read.option("header", "true").option("inferSchema", "true").csv(f"{out}/adaptive_performance").first()
    assert got.mean_ms > 0 and got.max_ms >= got.p99_ms >= got.p50_ms and got.total_s > 0


def test_preprocessings_side_by_side(spark, tmp_path, caplog):
    """Two preprocessings, one of which fails: its record has the error, and nothing else of it is written; damaged artifacts are named."""
    from orrery.config import Dataset, Solver
    from orrery.functions.features import default_preps
    from orrery.plans import experiment as ex

    def broken(m):
        raise RuntimeError("no such filter")

    root, out = str(tmp_path / "r"), str(tmp_path / "o")
    preps = default_preps(4) | {"p1_moments": lambda m: np.c_[m.mean(1), m.std(1), np.abs(m).max(1)], "p9_broken": broken}
    ex.run_experiment(spark, q.signals(spark, "/root/testdata/sf0.01"), Dataset("cwru", {}, 16, 4, (0.5, 1.5), 1), root, Solver(), source=0, target=1, preps=preps)
    got = {r.prep: r for r in artifacts.read_metrics(spark, f"{root}/metrics").collect()}
    assert set(got) == set(preps) and "no such filter" in got["p9_broken"].error and got["p9_broken"].r is None
    assert all(got[p].error is None and got[p].r > 0 for p in ("p4_cepstrum", "p1_moments")) and got["p1_moments"].feature_dim == 3
    assert {r.prep for r in artifacts.read_partitioned(spark, f"{root}/distances").select("prep").distinct().collect()} == {"p4_cepstrum", "p1_moments"}
    assert artifacts.load_description(spark, f"{root}/model", "0_to_1", "p1_moments").x.shape[1] == 3
    (tmp_path / "r" / "metrics" / "bad.json").write_text("{broken\n")
    part = next((tmp_path / "r" / "distances").rglob("*.parquet"))
    (part.parent / "damaged.parquet").write_text("nothing of it")
    with caplog.at_level("WARNING"):
        ex.evaluate_distances(spark, root, out)
    assert sorted(r.getMessage().split("/")[-1].split(":")[0] for r in caplog.records if r.getMessage().startswith("skipped")) == ["bad.json", "damaged.parquet"]
    rows = spark.read.option("header", "true").csv(f"{out}/ad_performance").collect()
    assert {(r.prep, r.prep_label, r.scenario) for r in rows} == {("p4_cepstrum", "Cepstrum", "0->1"), ("p1_moments", "p1_moments", "0->1")}
    speeds = spark.createDataFrame([("cwru", "1730", "1797", "x"), ("pu", "900", "1730", "p4_cepstrum")], "dataset string, source string, target string, prep string")
    assert [(r.scenario, r.prep_label) for r in ex.labelled(speeds).collect()] == [("A->D", "x"), ("A->1730", "Cepstrum")]


def test_command_line(spark, tmp_path, monkeypatch):
    from orrery import cli

    monkeypatch.setattr(cli, "session", lambda *a, **k: spark)
    root, out = str(tmp_path / "r"), str(tmp_path / "o")
    cli.main(["experiment", "--events", "/root/testdata/sf0.01/events.parquet", "--dataset", "events", "--out-dir", root, "--source", "0", "--target", "1", "--otta-mode", "single", "--nu", "0.2"])
    cli.main(["--log-file", str(tmp_path / "log"), "evaluate", "--results-root", root, "--out-dir", out])
    assert f"reports in {out}" in (tmp_path / "log").read_text()
    cli.main(["--log-file", str(tmp_path / "log"), "query", "scenario_pairs", "--tables", "/root/testdata/sf0.001"])
    assert "|source|target|" in (tmp_path / "log").read_text()
    assert spark.read.option("header", "true").csv(f"{out}/run_metrics").first().otta_mode == "single_boundary"
    for bad in (["experiment", "--out-dir", root], ["experiment", "--signals", "x", "--out-dir", root, "--source", "5"], ["experiment", "--events", "x", "--dataset", "events", "--kernel", "poly", "--out-dir", root]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    cli.logging.basicConfig(handlers=[cli.logging.NullHandler()], force=True)  # pytest closes the stream that the last run logged to


def test_raw_recordings(spark, tmp_path):
    from orrery.sources.signals import read_raw_recordings, read_recordings

    ch = lambda *names: [([{"name": n, "data": [float(i)]} for i, n in enumerate(names)],)]
    for i, (name, rows) in enumerate({"IR_007_1": ch("X_DE_a", "FE", "X_DE_b"), "N_0": ch("FE")}.items()):
        spark.createDataFrame(rows, "channels array<struct<name:string,data:array<double>>>").coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        part = next((tmp_path / f"w{i}").glob("part-*"))
        (tmp_path / "raw").mkdir(exist_ok=True)
        part.rename(tmp_path / "raw" / f"{name}.parquet")
    (tmp_path / "raw" / "IR_014_1.parquet").write_text("damaged")
    found, skipped = read_raw_recordings(spark, str(tmp_path / "raw"))
    assert [(r.data, r.fault_type, r.rpm) for r in found.collect()] == [([2.0], "IR", 1772)] and [r.file for r in skipped.collect()] == ["N_0.parquet"]
    spark.createDataFrame([([1.0, 2.0],)], "data array<double>").coalesce(1).write.parquet(str(tmp_path / "w9"))
    (tmp_path / "plain").mkdir()
    next((tmp_path / "w9").glob("part-*")).rename(tmp_path / "plain" / "OR@06_021_3.parquet")
    assert [(r.fault_type, r.crack_size, r.rpm, r.is_anomaly) for r in read_recordings(spark, str(tmp_path / "plain")).collect()] == [("OR@06", "021", 1730, 1)]


def test_largest_weights_are_projected(spark):
    from orrery.operators.scoring import top_alpha

    rng = np.random.default_rng(4)
    a = rng.uniform(0, 1, 60) ** 3
    df = spark.createDataFrame([("m", i, float(x)) for i, x in enumerate(a)], "model string, sv_idx int, alpha double")
    got = {r.sv_idx: r.alpha for r in top_alpha(df, 20, ["model"], 0.08).collect()}
    top = np.argsort(-a, kind="stable")[:20]
    want = to_capped_simplex(a[top] / a[top].sum(), 0.08)
    assert set(got) == set(top.tolist()) and np.allclose([got[i] for i in top], want) and abs(sum(got.values()) - 1) < 1e-5


def test_kernel_distances_both_ways(spark):
    from orrery.operators.distribution import make_kernel
    from orrery.operators.scoring import kernel_distances

    rng = np.random.default_rng(5)
    train, rows = rng.normal(size=(40, 3)), rng.normal(size=(9, 3))
    for kern in (Kernel("rbf", 0.5), Kernel(), polynomial()):
        m = Description.fit(train, kern, 0.1)
        sv = spark.createDataFrame([("a", i, float(a), x.tolist()) for i, (a, x) in enumerate(zip(m.alpha, m.x))], "scenario_id string, sv_idx int, alpha double, x array<double>")
        df = spark.createDataFrame([("a", i, x.tolist()) for i, x in enumerate(rows)] + [("none", 99, [0.0, 0.0, 0.0])], "scenario_id string, i long, x array<double>")
        for most in (1 << 20, 0):
            got = {r.i: r.d2 for r in kernel_distances(df, sv, kern, most=most).collect()}
            assert set(got) == set(range(9)) and np.allclose([got[i] for i in range(9)], m.d2(rows), atol=1e-6)
    pts = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(train)], "vec_id long, x array<double>")
    d2 = ((train[:, None] - train[None]) ** 2).sum(2)[np.triu_indices(40, 1)]
    assert abs(make_kernel("rbf", pts).gamma - 1 / np.median(d2)) < 1e-9 and make_kernel("linear", pts) == Kernel()
    with pytest.raises(ValueError):
        make_kernel("poly", pts)


def test_single_boundary_codes(spark):
    """otta_single against the rule written out: warm-up rows adapt, then rows inside the moving radius do, others are anomalies."""
    from orrery.operators.svdd import box_from_nu, buffer_size

    sf = "/root/testdata/sf0.01"
    train, rest = q._scenarios(spark, sf)
    t, r = train.toPandas(), rest.toPandas()
    want = {}
    for k, mine in r.groupby("scenario_id"):
        mine = mine.sort_values("stream_pos")
        x = np.stack(t[t.scenario_id == k].sort_values("vec_id").x.to_list())
        c = box_from_nu(len(x), 0.1)
        m = Description.fit(x, Kernel(), c).bounded(buffer_size(len(x), len(mine), c))
        warm = int((mine.y_true == 0).sum() * 0.1)
        for i, (pos, v) in enumerate(zip(mine.stream_pos, mine.x)):
            v = np.asarray(v, float)
            code = 1 if i < warm or m.r2 - m.d2(v)[0] >= 0 else 2
            if code == 1:
                m.update(v, 10)
            want[k, pos] = (code, round(float(m.r2 - m.d2(v)[0]), 9))
    got = {(o.scenario_id, o.stream_pos): (o.decision, round(o.score, 9)) for o in q.otta_single(spark, sf).collect()}
    assert got == want and {v[0] for v in want.values()} == {1, 2}


def test_full_buffer_takes_no_kernel_matrix(monkeypatch):
    """Moves of a full buffer cost a few columns, not the whole kernel matrix, and end where sums made anew end."""
    from orrery.operators import svdd

    rng = np.random.default_rng(21)
    x, rows = rng.normal(size=(400, 6)) * 0.7, rng.normal(size=(300, 6)) * 0.7
    made, plain = [0], Kernel.matrix
    monkeypatch.setattr(Kernel, "matrix", lambda self, a, b, **k: (made.__setitem__(0, made[0] + len(a) * len(b)), plain(self, a, b, **k))[1])
    for kernel in (Kernel(), Kernel("rbf", 0.5), polynomial(2.0, 0.1, 1.0)):
        for evict in ("redistribute", "transfer"):
            start = Description.fit(x, kernel, 1 / 40)
            ends = []
            for anew in (1000, 1):
                monkeypatch.setattr(svdd, "ANEW", anew, raising=False)
                m = start.bounded(200, evict)
                made[0] = 0
                for row in rows:
                    m.update(row)
                if anew > 1:
                    assert made[0] < len(rows) * 20 * 200
                assert np.abs(plain(kernel, m.x, m.x) @ m.alpha - m.f).max() < 1e-12 and abs(m.alpha.sum() - 1) < 1e-6
                ends.append((m.r2, m.norm2, m.alpha.copy()))
            assert np.allclose(ends[0][2], ends[1][2], atol=1e-9) and abs(ends[0][0] - ends[1][0]) < 1e-9
