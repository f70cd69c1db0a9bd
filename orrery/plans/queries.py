"""One query per operator over the test tables; ``oracle.py`` has the SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orrery.functions.arrays import sq_norm, z_score
from orrery.functions.cepstrum import window_features, z_cepstrum
from orrery.functions.kernels import Kernel, polynomial
from orrery.functions.numbers import mapped, near, replaced
from orrery.operators import chunks, distribution, evaluation as ev, gram, plots, scoring, svdd, windows as win
from orrery.operators.large_fit import fit_large
from orrery.plans import experiment as ex
from orrery.plans.fixtures import DIM, KEY, RHO, WINDOW, rounded, scored, signals, source_train, stream, target_normal, vectors
from orrery.sources.artifacts import run_key_columns, zone_rows
from orrery.sources.signals import parse_bearing_name, parse_recording_name, pick_channel, read_signals
from orrery.sources.tables import table
from orrery.storage import shared_dir, stored
from orrery.streaming.adapt import OUT, run_available, start_models

DOMAIN_NAMES = {0: "A", 1: "B", 2: "C", 3: "D"}
PREP_NAMES = {"p0": "cepstrum", "p1": "z-score"}
DATASETS = ["alpha", "beta"]


def domain_split(s: SparkSession, d: str) -> DataFrame:
    return win.domain_split(signals(s, d), 0, 1).select("signal_id", "side", "fault_type", "is_anomaly", F.size("data").alias("n"))


def temporal_split(s: SparkSession, d: str) -> DataFrame:
    return win.temporal_split(signals(s, d)).select("signal_id", "split", "start_idx", "n_samples", F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def _windows(s: SparkSession, d: str) -> DataFrame:
    return win.sliding_windows(signals(s, d), WINDOW)


def window_signal(s: SparkSession, d: str) -> DataFrame:
    w = win.sliding_windows(win.temporal_split(signals(s, d)), WINDOW, 8)
    return w.select("signal_id", "split", "win_idx", F.col("x")[0].alias("first"), F.col("x")[WINDOW - 1].alias("last"), F.size("x").alias("n"))


def source_val_union(s: SparkSession, d: str) -> DataFrame:
    v = win.temporal_split(signals(s, d)).filter("split = 'val'")
    both = v.filter("is_anomaly = 0").unionByName(v.filter("is_anomaly = 1"))
    return both.groupBy("domain", "is_anomaly").agg(F.count("*").alias("n_signals"), F.sum("n_samples").cast("long").alias("n_samples"))


def znorm(s: SparkSession, d: str) -> DataFrame:
    return _windows(s, d).select("signal_id", "win_idx", F.posexplode(z_score(F.col("x"))).alias("pos", "z")).select("signal_id", "win_idx", "pos", F.round(F.col("z").cast("double"), 5).alias("z"))


def cepstrum_query(s: SparkSession, d: str) -> DataFrame:
    c = win.spread(_windows(s, d)).select("signal_id", "win_idx", F.posexplode(z_cepstrum(F.col("x"))).alias("q", "c"))
    return c.select("signal_id", "win_idx", "q", F.round(F.col("c").cast("double"), 4).alias("c"))


def liftered_features(s: SparkSession, d: str) -> DataFrame:
    f = window_features(win.spread(_windows(s, d)), 4)
    return f.select("signal_id", "win_idx", F.size("features").alias("n"), F.round(F.col("features")[1].cast("double"), 4).alias("c1"))


def target_stream_order(s: SparkSession, d: str) -> DataFrame:
    w = win.target_order(_windows(s, d).filter("domain = 1"), ["domain"])
    return w.select("domain", "stream_pos", "signal_id", "win_idx", "fault_type", "is_anomaly")


def label_map(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).groupBy("prep").agg(F.count("*").alias("n")).select("prep", mapped(F.col("prep"), PREP_NAMES).alias("prep_label"), "n")


def domain_map(s: SparkSession, d: str) -> DataFrame:
    dom = signals(s, d).select("domain").distinct()
    two = {k: v for k, v in DOMAIN_NAMES.items() if k < 3}
    p = win.scenario_pairs(dom)
    return p.select("source", "target", F.concat(mapped(F.col("source"), two), F.lit("->"), mapped(F.col("target"), two)).alias("scenario"))


def scenario_pairs(s: SparkSession, d: str) -> DataFrame:
    return win.scenario_pairs(signals(s, d).select("domain").distinct())


def run_key(s: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id").cast("string")
    path = F.when(F.col("label") == 0, F.concat(F.lit("rbf/alpha/1797_to_"), i, F.lit("/p4"))).when(F.col("label") == 1, F.concat(F.lit("beta/"), i, F.lit("_to_900/p4"))).when(F.col("label") == 2, F.concat(F.lit("beta/x_to_"), i, F.lit("/p4"))).otherwise(F.concat(F.lit("x/"), i))
    return vectors(s, d).select("vec_id", path.alias("path")).withColumns(run_key_columns(F.col("path")))


def recording_name(s: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("label") < 5, F.concat(F.lit("n_"), (F.col("label") % 5).cast("string"), F.lit(".mat"))).otherwise(F.concat(F.lit("IR_0"), F.lit("07_"), (F.col("label") - 5).cast("string"), F.lit(".mat")))
    return vectors(s, d).select("vec_id", name.alias("file")).withColumns(parse_recording_name(F.col("file")))


def _kernel_summary(s: SparkSession, d: str, k: Kernel) -> DataFrame:
    v = vectors(s, d)
    r = gram.kernel_rows(source_train(v), target_normal(v), k)
    return rounded(r.select("i", "n", (F.col("total") / F.col("n")).alias("mean_k"), F.col("high").alias("max_k"), F.col("low").alias("min_k")))


def kernel_matrix(s: SparkSession, d: str) -> DataFrame:
    return _kernel_summary(s, d, Kernel("linear"))


def rbf_kernel(s: SparkSession, d: str) -> DataFrame:
    return _kernel_summary(s, d, Kernel("rbf", 0.5))


def poly_kernel(s: SparkSession, d: str) -> DataFrame:
    return _kernel_summary(s, d, polynomial())


def kernel_diag(s: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return rounded(vectors(s, d).select("vec_id", Kernel().diag_column(x).alias("lin"), Kernel("rbf").diag_column(x).alias("rbf"), polynomial().diag_column(x).alias("poly"), sq_norm(x).alias("norm2")))


def svdd_distance(s: SparkSession, d: str) -> DataFrame:
    return rounded(scored(s, d).select("vec_id", "d", "r"))


def rbf_distance(s: SparkSession, d: str) -> DataFrame:
    """Distances under an RBF kernel to the description with equal weights (nu = 1)."""
    v = vectors(s, d).withColumn("scenario_id", F.lit("all"))
    train = source_train(v)
    sv = train.join(F.broadcast(train.agg((1.0 / F.count("*")).alias("alpha")))).select("scenario_id", F.col("vec_id").alias("sv_idx"), "alpha", "x")
    return rounded(scoring.kernel_distances(v, sv, Kernel("rbf", 0.5)).select("vec_id", "d2"))


def svdd_predict(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).select("vec_id", scoring.predict_sign(F.round("d2", 9), F.round("r2", 9)).alias("pred"), F.round(F.col("r2") - F.col("d2"), 6).alias("decision"))


def zone_decision(s: SparkSession, d: str) -> DataFrame:
    r = F.col("r")
    return scored(s, d).select("vec_id", scoring.zone(F.col("d2"), r * RHO[0], r * RHO[1] - 1e-9).alias("zone"))


def r2_tiers(s: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("label") < 3, (F.col("vec_id") % 4) / 10).when(F.col("label") < 7, (F.col("vec_id") % 2) / 2).otherwise(F.lit(0.0))
    c = F.when(F.col("label") < 3, 1.0).otherwise(0.5)
    rows = scored(s, d).select("label", a.alias("alpha"), "d2", c.alias("c"))
    return rounded(scoring.r2_tiers(rows, ["label", "c"], F.col("c"), svdd.EPS))


def topk_alpha(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).select("label", F.col("vec_id").alias("sv_idx"), (F.round("d", 6) + 1e-3 * (F.col("vec_id") % 5)).alias("alpha"))
    return rounded(scoring.top_alpha(rows, 20, ["label"], 0.06))


def buffer_size(s: SparkSession, d: str) -> DataFrame:
    g = scored(s, d).groupBy("label").agg(F.count("*").alias("n"))
    return g.select("label", "n", svdd.buffer_size_column(F.col("n"), F.col("n") * 2, 1 / (F.lit(0.1) * F.col("n")), 100).alias("size"))


def warmup_length(s: SparkSession, d: str) -> DataFrame:
    return stream(s, d).groupBy("scenario_id").agg(F.floor(F.sum((F.col("y_true") == 0).cast("int")) * F.lit(0.1)).cast("long").alias("warmup"))


def confusion_matrix(s: SparkSession, d: str) -> DataFrame:
    return ev.confusion(scored(s, d), KEY)


def auc(s: SparkSession, d: str) -> DataFrame:
    return rounded(ev.auc(scored(s, d), KEY))


def ad_performance(s: SparkSession, d: str) -> DataFrame:
    return rounded(ev.performance(scored(s, d), KEY))


def otta_performance(s: SparkSession, d: str) -> DataFrame:
    return rounded(ev.adaptive_performance(stream(s, d), ["scenario_id"]))


def decision_rates(s: SparkSession, d: str) -> DataFrame:
    return ev.decision_rates(stream(s, d), ["scenario_id"])


def latency_stats(s: SparkSession, d: str) -> DataFrame:
    return rounded(ev.latency(stream(s, d), ["scenario_id"]))


def detection_delay(s: SparkSession, d: str) -> DataFrame:
    rows = stream(s, d)
    return ev.detection_delay(rows.unionByName(rows.filter("y_true = 0").withColumn("scenario_id", F.concat("scenario_id", F.lit("n")))), ["scenario_id"])


def distance_ratio(s: SparkSession, d: str) -> DataFrame:
    return rounded(ev.distance_ratio(scored(s, d), KEY, ["source_train", "source_val", "target_normal", "target_fault"]))


def cm_by_dataset(s: SparkSession, d: str) -> DataFrame:
    return rounded(ev.confusion_by(ev.confusion(scored(s, d), KEY), ["dataset", "prep"]))


def _metric(s: SparkSession, d: str, m: str) -> DataFrame:
    return ev.metric_pivot(ev.performance(scored(s, d), KEY), m, DATASETS)


def metric_pivot(s: SparkSession, d: str) -> DataFrame:
    return rounded(_metric(s, d, "auc"))


def _adapted(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).withColumns({"y_pred": (F.round("d", 9) > F.round(F.col("r") * 0.985, 9)).cast("int"), "score": F.round(-F.col("d") * (F.col("vec_id") % 7), 6)})
    return ev.performance(rows, KEY)


def baseline_vs_otta(s: SparkSession, d: str) -> DataFrame:
    return rounded(ev.compare(ev.performance(scored(s, d), KEY), _adapted(s, d), KEY, ["auc", "f1", "recall"]))


def delta_box(s: SparkSession, d: str) -> DataFrame:
    return rounded(ev.delta_box(ev.compare(ev.performance(scored(s, d), KEY), _adapted(s, d), KEY, ["auc", "f1", "recall"]), "auc"))


def _zones(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d)
    return ev.zone_occupancy(rows, ["dataset", "prep"], F.round(F.col("r") * RHO[0], 9), F.round(F.col("r") * RHO[1] * 0.999, 9))


def zone_ratio(s: SparkSession, d: str) -> DataFrame:
    return rounded(_zones(s, d))


def tradeoff(s: SparkSession, d: str) -> DataFrame:
    return rounded(ev.tradeoff(_zones(s, d), _metric(s, d, "auc"), _metric(s, d, "f1")), 4)


def zone_flatten(s: SparkSession, d: str) -> DataFrame:
    z = rounded(_zones(s, d))
    one = F.struct(F.col("n").alias("count"), "inner_pct", "adaptation_pct", "outer_pct", "mean_d", "std_d")
    groups = z.groupBy("dataset", "prep").agg(F.map_from_entries(F.collect_list(F.struct("grp", one))).alias("by_group"))
    combo = F.struct(F.lit(50.0).alias("r_inner_percentile"), F.lit(95.0).alias("r_outer_percentile"), F.lit(0.5).alias("r_inner"), F.lit(1.5).alias("r_outer"), "by_group")
    docs = groups.select("dataset", "prep", F.to_json(F.struct(F.array(combo).alias("zone_combinations"))).alias("zone_json"))
    return rounded(zone_rows(docs, keep=["dataset", "prep"]).filter(near(F.col("r_inner_percentile"), 50.0)))


def run_summary(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d)
    doc = rows.groupBy("dataset", "prep").agg(F.to_json(F.struct(F.max("r").alias("r_pretrain"), F.count("*").alias("n_stream"), F.lit(None).cast("double").alias("mmd2"))).alias("j"))
    bad = doc.limit(0).unionByName(s.createDataFrame([("alpha", "p9", "{broken")], "dataset string, prep string, j string"))
    got = doc.unionByName(bad).withColumn("m", F.from_json("j", "r_pretrain double, n_stream long, mmd2 double, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return rounded(got.filter("m._corrupt_record is null").select("dataset", "prep", "m.r_pretrain", "m.n_stream", "m.mmd2"))


def median_gamma(s: SparkSession, d: str) -> DataFrame:
    return rounded(distribution.median_gamma(source_train(vectors(s, d))))


def mmd2(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d)
    return rounded(distribution.mmd2(source_train(v), target_normal(v), 0.5), 8)


def wasserstein(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).filter("grp <> 'target_fault'").withColumns({"side": F.when(F.col("grp") == "source_train", "a").otherwise("b"), "dr": F.round("d", 9)})
    return rounded(distribution.wasserstein(rows, ["dataset"], "side", "dr"), 8)


def polar_bounds(s: SparkSession, d: str) -> DataFrame:
    return rounded(plots.polar_bounds(scored(s, d), ["dataset", "prep"], RHO))


def polar_points(s: SparkSession, d: str) -> DataFrame:
    return rounded(plots.polar_points(scored(s, d), ["dataset", "prep"], "vec_id"))


def r_trace_panel(s: SparkSession, d: str) -> DataFrame:
    return rounded(plots.r_trace_panel(stream(s, d), ["scenario_id"]))


def r_trace_points(s: SparkSession, d: str) -> DataFrame:
    return rounded(plots.adapted_points(stream(s, d)).select("scenario_id", "stream_pos", "r_trace", "kind"))


def _scenarios(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(s, d).withColumn("x", F.col("x").cast("array<double>"))
    sc = F.concat(F.lit("k"), (F.col("label") % 5).cast("string"))
    train = source_train(v).select(sc.alias("scenario_id"), "vec_id", "x")
    rest = v.filter("not (label < 5 and vec_id % 2 = 0)").select(sc.alias("scenario_id"), "vec_id", "x", (F.col("label") >= 5).cast("int").alias("y_true"))
    pos = F.row_number().over(Window.partitionBy("scenario_id").orderBy("y_true", "vec_id")) - 1
    return train, rest.select("scenario_id", pos.cast("long").alias("stream_pos"), "y_true", "x")


def svdd_fit(s: SparkSession, d: str) -> DataFrame:
    return svdd.model_rows(svdd.fit_scenarios(_scenarios(s, d)[0], Kernel()), Kernel())


def svdd_fit_closed_form(s: SparkSession, d: str) -> DataFrame:
    """nu = 1: the solver must give the mean and the largest distance."""
    m = svdd.fit_scenarios(_scenarios(s, d)[0], Kernel(), nu=1.0)
    return rounded(svdd.model_rows(m, Kernel()).select("scenario_id", "n_sv", "tier", "r2"), 5)


def svdd_optimality(s: SparkSession, d: str) -> DataFrame:
    """Whether each fit meets the conditions of the optimum, and whether the fit beyond one task finds the same radius."""
    train, kernel = stored(_scenarios(s, d)[0], "train"), Kernel()
    fitted = stored(svdd.fit_scenarios(train, kernel), "fitted")
    sv, models = svdd.support_vectors(fitted), svdd.model_rows(fitted, kernel)
    far = ex.distances(train, sv, models, kernel).select("scenario_id", "vec_id", (F.col("d") * F.col("d")).alias("d2"))
    weights = train.join(sv.select("scenario_id", F.col("x").alias("_x"), "alpha"), (train.scenario_id == sv.scenario_id) & (F.col("x") == F.col("_x")), "left").select(train.scenario_id, "vec_id", F.coalesce("alpha", F.lit(0.0)).alias("alpha"))
    rows = far.join(weights, ["scenario_id", "vec_id"]).join(models.select("scenario_id", "c", "r2"), "scenario_id")
    a, c, d2 = F.col("alpha"), F.col("c"), F.col("d2")
    checked = rows.groupBy("scenario_id").agg(
        F.count("*").alias("n_rows"), F.round(F.max(c), 9).alias("c"), (F.abs(F.sum(a) - 1) < 1e-6).alias("sums_to_one"), ((F.min(a) >= 0) & (F.max(a - c) < 1e-6)).alias("in_box"),
        (F.coalesce(F.max(F.when(a < c - svdd.EPS, d2)) - F.min(F.when(a > svdd.EPS, d2)), F.lit(0.0)) < 2e-3).alias("optimal"), F.sqrt(F.max("r2")).alias("_r"),
    )
    large = [(k, math.sqrt(f.r2), f.gap) for k, f in fit_large(train, 0.1, 1e-4).items()]
    agree = checked.join(F.broadcast(s.createDataFrame(large, "scenario_id string, _large double, _gap double")), "scenario_id")
    return agree.withColumn("large_agrees", (F.abs(F.col("_large") - F.col("_r")) < 0.01 * F.col("_r")) & (F.col("_gap") < 1e-3)).drop("_r", "_large", "_gap")


def model_performance(s: SparkSession, d: str) -> DataFrame:
    """Performance of fitted models (nu = 1) on their target rows: fit, distances and judgement as in a run."""
    train, rest = _scenarios(s, d)
    fitted, kernel = stored(svdd.fit_scenarios(train, Kernel(), nu=1.0), "fitted"), Kernel()
    far = ex.distances(rest, svdd.support_vectors(fitted), svdd.model_rows(fitted, kernel), kernel)
    judged = far.withColumns({"score": F.round("d", 5), "y_pred": (F.round("d", 5) > F.round("r", 5)).cast("int")})
    return rounded(ev.performance(judged, ["scenario_id"]), 5)


def chunk_windows(s: SparkSession, d: str) -> DataFrame:
    """``window_signal`` from signals held as chunks of 10 samples."""
    c = stored(chunks.chunks_from_events(table(s, d, "events"), 10), "chunks")
    w = chunks.chunk_windows(c, chunks.split_spans(c), 10, WINDOW, 8).filter("split <> 'train' or is_anomaly = 0")
    return w.select("signal_id", "split", "win_idx", F.col("x")[0].alias("first"), F.col("x")[WINDOW - 1].alias("last"), F.size("x").alias("n"))


def otta_replay(s: SparkSession, d: str) -> DataFrame:
    train, rest = _scenarios(s, d)
    return svdd.replay(rest, train, Kernel(), rho=RHO)


def otta_single(s: SparkSession, d: str) -> DataFrame:
    train, rest = _scenarios(s, d)
    return svdd.replay(rest, train, Kernel(), rho=None)


LONG = 2048


def znorm_long(s: SparkSession, d: str) -> DataFrame:
    """z-scores of windows of the first data set's length."""
    cell = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("v"))))
    sig = table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 8).cast("long").alias("signal_id")).agg(F.transform(cell, lambda c: c["v"]).alias("data"))
    z = win.sliding_windows(sig, LONG, 1024).repartition("signal_id", "win_idx").select("signal_id", "win_idx", z_score(F.col("x")).alias("z"))
    r = lambda c: F.round(c.cast("double"), 4)
    return z.select("signal_id", "win_idx", F.size("z").alias("n"), r(F.col("z")[0]).alias("first"), r(F.col("z")[LONG - 1]).alias("last"), r(F.array_max("z")).alias("top"))


def bearing_name(s: SparkSession, d: str) -> DataFrame:
    condition = F.when(F.col("label") < 5, "N15_M07_F10").when(F.col("label") < 9, "N09_M07_F10").otherwise("N99_M00_F00")
    bearing = F.element_at(F.array(*[F.lit(b) for b in ("K001", "KI04", "KA30", "X1")]), (F.col("vec_id") % 4 + 1).cast("int"))
    name = F.concat_ws("_", condition, bearing, (F.col("vec_id") % 20 + 1).cast("string"))
    return vectors(s, d).select("vec_id", F.concat(name, F.lit(".mat")).alias("file")).withColumns(parse_bearing_name(F.col("file")))


def channel_pick(s: SparkSession, d: str) -> DataFrame:
    """The last channel with "DE" in its name, and the first "vibration_1"."""
    one = lambda n, v: F.struct(n.alias("name"), F.array(v.cast("double")).alias("data"))
    i, k = F.col("vec_id"), F.col("label")
    names = (F.when(k < 3, "X097_DE_time").otherwise("vibration_1"), F.when(k % 2 == 0, "X098_DE_time").otherwise("X098_FE_time"), F.when(k > 6, "vibration_1").otherwise("force"))
    c = F.array(*[one(n, i + j) for j, n in enumerate(names)])
    return vectors(s, d).select("vec_id", pick_channel(c, part="DE")[0].alias("drive_end"), pick_channel(c, name="vibration_1")[0].alias("vibration"))


def value_replace(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).groupBy(replaced(F.col("prep"), {"p2": "p1"}).alias("prep")).agg(F.count("*").alias("n"))


def kept_signals(s: SparkSession, d: str) -> DataFrame:
    """Rows of the excluded label go after loading."""
    path = shared_dir(s, "signals")
    v = vectors(s, d).select(F.col("vec_id").alias("signal_id"), F.when(F.col("label") == 7, 999).when(F.col("label") > 0, F.col("label")).cast("int").alias("label"), F.col("x").cast("array<double>").alias("data"))
    v.write.parquet(path)
    return read_signals(s, path).groupBy("label").agg(F.count("*").alias("n"))


def seeded_order(s: SparkSession, d: str) -> DataFrame:
    return win.shuffled(vectors(s, d), ["label"], ["vec_id"]).select("label", "vec_id", "shuffle_pos")


def _run(s: SparkSession, d: str, kernel: Kernel) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows by group, fitted models, and a whole run of the test scenarios."""
    train, rest = _scenarios(s, d)
    both = train.withColumn("grp", F.lit("source_train")).unionByName(rest.select("scenario_id", (F.col("stream_pos") + 10**9).alias("vec_id"), "x", F.when(F.col("y_true") == 0, "target_normal").otherwise("target_fault").alias("grp")))
    return both, svdd.fit_scenarios(train, kernel), stored(svdd.replay_run(rest, train, kernel, rho=RHO), "run")


def final_distances(s: SparkSession, d: str) -> DataFrame:
    """Distances under the model as the stream leaves it, with an RBF kernel."""
    kernel = Kernel("rbf", 0.5)
    rows, _, run = _run(s, d, kernel)
    ends = run.groupBy("scenario_id").agg(F.first("r2").alias("r2"), F.first("center_norm_sq").alias("center_norm_sq"))
    return rounded(ex.distances(rows, run.filter("kind = 'vector'"), ends, kernel).select("scenario_id", "vec_id", "grp", "d", "r"), 5)


def run_metrics(s: SparkSession, d: str) -> DataFrame:
    rows, fitted, run = _run(s, d, Kernel())
    ends = run.groupBy("scenario_id").agg(F.first("r2").alias("r2"), F.first("center_norm_sq").alias("center_norm_sq"))
    after = stored(ex.distances(rows, run.filter("kind = 'vector'"), ends, Kernel()), "after")
    return rounded(ex.run_metrics(rows, svdd.model_rows(fitted, Kernel()), run, ex.shift_distances(rows, after), RHO), 5)


def otta_stream(s: SparkSession, d: str) -> DataFrame:
    """The stateful streaming operator, run over everything available."""
    train, rest = _scenarios(s, d)
    counts = rest.groupBy("scenario_id").agg(F.sum((F.col("y_true") == 0).cast("long")).alias("n_normal"), F.count("*").alias("n_stream"))
    models = stored(start_models(train, counts, Kernel(), rho=RHO), "models")
    source, sink = shared_dir(s, "stream-in"), shared_dir(s, "stream-out")
    rest.repartition(4, "scenario_id").write.parquet(source)
    run_available(s, source, "scenario_id string, stream_pos long, y_true int, x array<double>", models, Kernel(), sink, shared_dir(s, "stream-ck"), RHO)
    return s.read.schema(OUT).parquet(sink)


QUERIES = {
    f.__name__: f
    for f in (
        domain_split, temporal_split, window_signal, source_val_union, znorm, liftered_features, target_stream_order, label_map, domain_map, scenario_pairs, run_key, recording_name,
        kernel_matrix, rbf_kernel, poly_kernel, kernel_diag, svdd_distance, rbf_distance, svdd_predict, zone_decision, r2_tiers, topk_alpha, buffer_size, warmup_length, confusion_matrix, auc, ad_performance,
        otta_performance, decision_rates, latency_stats, detection_delay, distance_ratio, cm_by_dataset, metric_pivot, baseline_vs_otta, delta_box, zone_ratio, tradeoff, zone_flatten, run_summary,
        znorm_long, bearing_name, channel_pick, value_replace, kept_signals, seeded_order, final_distances, run_metrics, median_gamma, mmd2, wasserstein, polar_bounds, polar_points, r_trace_panel, r_trace_points, svdd_fit, svdd_fit_closed_form, svdd_optimality, model_performance, chunk_windows, otta_replay, otta_single, otta_stream,
    )
} | {"cepstrum": cepstrum_query}
