"""The three entry points as plans: train and stream all scenarios, evaluate distances, evaluate decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery import schemas
from orrery.config import DATASETS, Dataset, Solver
from orrery.functions.arrays import dot, sq_norm
from orrery.functions.features import PREP_LABELS, Prep, default_preps, with_preps
from orrery.functions.kernels import Kernel
from orrery.functions.numbers import mapped, replaced
from orrery.operators import chunks, distribution, evaluation as ev, gram, plots, scoring, svdd, windows as win
from orrery.sources import artifacts
from orrery.storage import stored

KEY = ["kernel", "dataset", "scenario_id", "source", "target", "prep"]
GROUPS = ["source_train", "source_val", "target_normal", "target_fault"]
PREP_RENAMED = {"p6_stat": "p6_tds"}  # fixed value: an earlier name of a preprocessing in stored runs


def feature_table(signals: DataFrame, window: int, lifter_n: int | None, ratios: tuple[float, ...], preps: dict[str, Prep] | None = None, chunk: int | None = None) -> DataFrame:
    """Windows of the temporal chunks (as a source) and of whole signals (as a target, split ``target``), with the features ``x`` of every ``prep``.

    Windows are spread before Python reads them: a few long signals would otherwise feed a few tasks. Signals with a ``chunk_no`` are
    chunks of ``chunk`` samples each (``chunks``), and no task holds more of a signal than a chunk and a window.
    """
    if chunk:
        spans = chunks.split_spans(signals, ratios).filter("split <> 'test'").unionByName(chunks.whole_spans(signals))
        w = chunks.chunk_windows(signals, spans, chunk, window).filter("split <> 'train' or is_anomaly = 0").repartition("signal_id", "win_idx")
        return with_preps(w, preps or default_preps(lifter_n)).withColumn("vec_id", F.col("signal_id") * 1_000_000_000 + F.col("win_idx"))
    parts = win.temporal_split(signals, ratios).select("signal_id", "domain", "fault_type", "is_anomaly", "split", "data")
    whole = signals.select("signal_id", "domain", "fault_type", "is_anomaly", F.lit("target").alias("split"), "data")
    w = win.sliding_windows(parts.filter("split <> 'test'").unionByName(whole), window).repartition("signal_id", "win_idx")
    return with_preps(w, preps or default_preps(lifter_n)).withColumn("vec_id", F.col("signal_id") * 1_000_000_000 + F.col("win_idx"))


def scenario_tables(features: DataFrame, source: int | None = None, target: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Feature rows of every (source, target) pair and preprocessing by group, and the target streams in order."""
    pairs = win.scenario_pairs(features.select("domain").distinct())
    for name, wanted in (("source", source), ("target", target)):
        if wanted is not None:
            pairs = pairs.filter(F.col(name) == wanted)
            if pairs.isEmpty():
                raise ValueError(f"no scenario with {name} {wanted}")
    pairs = pairs.withColumn("scenario_id", F.concat_ws("_to_", F.col("source").cast("string"), F.col("target").cast("string")))
    src = features.filter("split = 'train' or split = 'val' and is_anomaly = 0").join(pairs, F.col("domain") == F.col("source")).withColumn("grp", F.when(F.col("split") == "train", "source_train").otherwise("source_val"))
    tgt = features.filter("split = 'target'").join(pairs, F.col("domain") == F.col("target")).withColumn("grp", F.when(F.col("is_anomaly") == 0, "target_normal").otherwise("target_fault"))
    return src.unionByName(tgt), win.target_order(tgt, ["scenario_id", "prep"]).withColumn("y_true", F.col("is_anomaly"))


def distances(rows: DataFrame, vectors: DataFrame, models: DataFrame, kernel: Kernel) -> DataFrame:
    """Distance ``d`` of every row to its scenario's model, and its radius ``r``. ``models``: scenario_id, r2, center_norm_sq.

    Under the linear kernel the vectors collapse to one centre a scenario; any other kernel goes through ``scoring.kernel_distances``.
    """
    if kernel.name != "linear":
        d = scoring.kernel_distances(rows, vectors, kernel).join(models.select("scenario_id", "r2"), "scenario_id")
        return d.withColumns({"d": F.sqrt("d2"), "r": F.sqrt(F.greatest("r2", F.lit(0.0)))})
    dim = F.posexplode("x").alias("pos", "v")
    c = vectors.select("scenario_id", "alpha", dim).groupBy("scenario_id", "pos").agg(F.sum(F.col("alpha") * F.col("v")).alias("v"))
    center = c.groupBy("scenario_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("center"))
    model = models.select("scenario_id", "r2", F.col("center_norm_sq").alias("norm2")).join(center, "scenario_id")
    # the constant of the linear kernel cancels, as weights add up to 1
    d2 = F.greatest(sq_norm(F.col("x")) - 2 * dot(F.col("x"), F.col("center")) + sq_norm(F.col("center")), F.lit(0.0))
    return rows.join(model, "scenario_id").withColumns({"d": F.sqrt(d2), "r": F.sqrt(F.greatest("r2", F.lit(0.0)))}).drop("center", "norm2")


def shift_distances(rows: DataFrame, final: DataFrame) -> DataFrame:
    """Per scenario: squared MMD of the features of source_train and target_normal under an RBF kernel with the median heuristic of both,
    and the Wasserstein-1 distance of their distances under the final model. All scenarios go through one plan."""
    pool = rows.filter("grp in ('source_train', 'target_normal')").select("scenario_id", "vec_id", F.when(F.col("grp") == "source_train", "a").otherwise("b").alias("side"), "x")
    gammas = gram.median_gammas(pool.withColumn("_k", F.struct("side", "vec_id")), ["scenario_id"], "_k")
    m = distribution.mmd2_by(pool.join(stored(gammas, "gammas"), "scenario_id"), ["scenario_id"], "side", "gamma")
    sides = final.filter("grp in ('source_train', 'target_normal')").withColumn("side", F.when(F.col("grp") == "source_train", "a").otherwise("b"))
    w = distribution.wasserstein(sides, ["scenario_id"], "side", "d").withColumnRenamed("w1", "wasserstein_1d_distance")
    return w.join(m, "scenario_id", "full")


def run_metrics(rows: DataFrame, models: DataFrame, run: DataFrame, shift: DataFrame, rho: tuple[float, float] | None, errors: DataFrame | None = None) -> DataFrame:
    """One record per scenario; a scenario whose fit failed, or with an ``error`` (``errors``: scenario_id, failed) before that, has its error and nulls."""
    n = lambda g: F.sum((F.col("grp") == g).cast("long")).alias(f"n_{g}")
    counts = rows.groupBy("scenario_id").agg(n("source_train"), n("target_normal"), n("target_fault"), F.max(F.size("x")).alias("feature_dim"))
    ends = run.groupBy("scenario_id").agg(*[F.first(c).alias(c) for c in ("r_pretrain", "r_final", "n_warmup", "buffer_size")], F.sum((F.col("kind") == "vector").cast("int")).cast("int").alias("n_sv"))
    out = counts.join(ends, "scenario_id", "left").join(shift, "scenario_id", "left").join(models.select("scenario_id", "error"), "scenario_id", "left")
    if errors is not None:
        out = out.join(errors, "scenario_id", "left").withColumn("error", F.coalesce("failed", "error")).drop("failed")
    inner, outer = rho or (None, None)
    extra = {"otta_mode": F.lit("dual_boundary" if rho else "single_boundary"), "rho_inner": F.lit(inner).cast("double"), "rho_outer": F.lit(outer).cast("double")}
    return out.withColumnRenamed("r_pretrain", "r").withColumns(extra)


def _run_id() -> Column:
    """A scenario under one preprocessing."""
    return F.concat_ws("|", "scenario_id", "prep")


def _plain(df: DataFrame) -> DataFrame:
    """``scenario_id`` of a run as scenario_id and prep."""
    return df.withColumns({"scenario_id": F.substring_index("scenario_id", "|", 1), "prep": F.substring_index("scenario_id", "|", -1)})


def run_experiment(spark: SparkSession, signals: DataFrame, dataset: Dataset, out: str, solver: Solver | None = None, source: int | None = None, target: int | None = None, preps: dict[str, Prep] | None = None, chunk: int | None = None) -> None:
    """Artifacts of all scenarios and preprocessings below ``out``, partitioned by run key: distances before and after adaptation, stream with latencies,
    metrics, and both models. Runs go in parallel, one task each; one that fails, in its preprocessing or its fit, leaves an error in ``metrics``."""
    solver = solver or Solver()
    rows, stream = scenario_tables(stored(feature_table(signals, dataset.window, dataset.lifter_n, solver.ratios, preps, chunk), "features"), source, target)
    rows, stream = stored(rows.withColumn("scenario_id", _run_id()).drop("prep"), "rows"), stored(stream.filter("x is not null").select(_run_id().alias("scenario_id"), "stream_pos", "y_true", "x"), "stream")
    errors = rows.groupBy("scenario_id").agg(F.min("error").alias("failed"))
    train = rows.filter("grp = 'source_train' and x is not null").select("scenario_id", "vec_id", "x")
    kernel = Kernel(solver.kernel, solver.gamma) if solver.gamma else distribution.make_kernel(solver.kernel, train)
    fitted = stored(svdd.fit_scenarios(train, kernel, solver.nu, solver.max_iter, solver.tol), "models")
    models = svdd.model_rows(fitted, kernel)
    rho = dataset.rho if solver.mode == "dual" else None
    run = stored(svdd.replay_run(stream, train, kernel, solver.nu, rho, solver.warmup_share, solver.buffer_cap, solver.inner_iter, max_iter=solver.max_iter, tol=solver.tol), "run")
    last = run.filter("kind = 'vector'").select("scenario_id", "sv_idx", "alpha", "x")
    ends = run.groupBy("scenario_id").agg(F.first("r2").alias("r2"), F.first("center_norm_sq").alias("center_norm_sq"), F.first("c").alias("c"), F.sum((F.col("kind") == "vector").cast("int")).cast("int").alias("n_sv"))
    tag = {"kernel": F.lit(kernel.name), "dataset": F.lit(dataset.name), "source": F.substring_index("scenario_id", "_to_", 1), "target": F.substring_index("scenario_id", "_to_", -1)}
    radius = {"rho_inner": F.lit(rho[0] if rho else None).cast("double"), "rho_outer": F.lit(rho[1] if rho else None).cast("double")}
    usable = rows.filter("x is not null")
    before = distances(usable, svdd.support_vectors(fitted), models, kernel)
    after = stored(distances(usable, last, ends, kernel), "after")
    for d, name in ((before, "distances"), (after, "distances_final")):
        artifacts.write_partitioned(_plain(d).withColumns(tag | radius).select(*KEY, "grp", "signal_id", "win_idx", "d", "r", *radius), f"{out}/{name}", KEY)
    steps = run.filter("kind = 'step'").select("scenario_id", "stream_pos", "decision", "score", "y_true", "r_trace", "latency_s", "r_pretrain", "r_final")
    artifacts.write_partitioned(_plain(steps).withColumns(tag), f"{out}/stream", KEY)
    metrics = _plain(run_metrics(rows, models, run, shift_distances(usable, after), rho, errors)).withColumns(tag)
    artifacts.write_metrics(metrics, f"{out}/metrics")
    artifacts.save_model(_plain(models), _plain(svdd.support_vectors(fitted)), f"{out}/model")
    final = ends.withColumns({"kernel": F.lit(kernel.name), "gamma": F.lit(kernel.gamma), "coef0": F.lit(kernel.coef0), "degree": F.lit(kernel.degree), "tier": F.lit(None).cast("int"), "iterations": F.lit(None).cast("int"), "gap": F.lit(None).cast("double"), "error": F.lit(None).cast("string")})
    artifacts.save_model(_plain(final), _plain(last), f"{out}/model_final")


def labelled(df: DataFrame) -> DataFrame:
    """Reports name domains by letter where the data set has one, the scenario by both (``A->B``), and the preprocessing by its label."""
    letters = {f"{name} {rpm}": letter for name, d in DATASETS.items() for letter, rpm in d.domains.items()}
    letter = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])[F.concat_ws(" ", "dataset", c)], F.col(c))
    named = df.withColumns({"source": letter("source"), "target": letter("target"), "prep_label": mapped(F.col("prep"), PREP_LABELS)})
    return named.withColumn("scenario", F.concat_ws("->", "source", "target"))


def _of(df: DataFrame, kernel: str | None) -> DataFrame:
    return df if kernel is None else df.filter(F.col("kernel") == kernel)


def evaluate_distances(spark: SparkSession, root: str, out: str, rho: tuple[float, float] = (0.5, 1.5), kernel: str | None = None) -> None:
    """Run metrics, performance, confusion by data set, distance ratios, zone shares, their trade-off and polar tables from stored runs."""
    summary = ["kernel", "dataset", "scenario", "scenario_id", "prep", "prep_label", "r", "mmd2", "wasserstein_1d_distance", "feature_dim", "n_source_train", "n_target_normal", "n_target_fault"]
    artifacts.report_skipped(spark, f"{root}/metrics", f"{root}/distances")
    metrics = labelled(_of(artifacts.read_metrics(spark, f"{root}/metrics"), kernel))
    artifacts.write_report(metrics.orderBy(*KEY), f"{out}/run_metrics", None)
    artifacts.write_report(metrics.select(*summary).orderBy("kernel", "dataset", "scenario_id", "prep"), f"{out}/domain_shift_performance", None)
    d = _of(artifacts.read_partitioned(spark, f"{root}/distances", schemas.DISTANCES), kernel).withColumn("y_true", (F.col("grp") == "target_fault").cast("int"))
    judged = d.filter("grp in ('target_normal', 'target_fault')").withColumns({"y_pred": (F.col("d") > F.col("r")).cast("int"), "score": F.col("d")})
    perf = stored(ev.performance(judged, KEY), "performance")
    artifacts.write_report(labelled(perf).orderBy(*KEY), f"{out}/ad_performance", 6)
    artifacts.write_report(ev.confusion_by(perf.withColumn("prep", replaced(F.col("prep"), PREP_RENAMED)), ["kernel", "dataset", "prep"]), f"{out}/cm_by_dataset", 6)
    artifacts.write_report(labelled(ev.distance_ratio(d, KEY, GROUPS)), f"{out}/distance_ratio", 4)
    zones = ev.zone_occupancy(d, KEY, F.col("r") * F.coalesce("rho_inner", F.lit(rho[0])), F.col("r") * F.coalesce("rho_outer", F.lit(rho[1])))
    artifacts.write_report(zones, f"{out}/zone_ratio", None)
    names = [r.dataset for r in perf.select("dataset").distinct().orderBy("dataset").collect()]  # configured data sets
    artifacts.write_report(ev.tradeoff(zones, ev.metric_pivot(perf, "auc", names), ev.metric_pivot(perf, "f1", names)), f"{out}/tradeoff", 4)
    artifacts.write_report(plots.polar_bounds(d, KEY, rho), f"{out}/polar_bounds", 6)
    artifacts.write_report(plots.polar_points(d.withColumn("vec_id", F.concat_ws("-", "signal_id", "win_idx")), KEY, "vec_id"), f"{out}/polar_points", 6)


def evaluate_stream(spark: SparkSession, root: str, out: str, kernel: str | None = None) -> None:
    """Performance and latency of decisions, the comparison with the frozen model, its spread, and the radius trace's tables. Runs of one
    class stay, with a null AUC."""
    artifacts.report_skipped(spark, None, f"{root}/stream")
    s = _of(artifacts.read_partitioned(spark, f"{root}/stream", schemas.STREAM), kernel)
    sizes = s.groupBy(*KEY).agg(F.count("*").alias("n_stream"), F.sum((F.col("y_true") == 0).cast("long")).alias("n_normal"), F.sum((F.col("y_true") == 1).cast("long")).alias("n_anomaly"))
    perf = stored(labelled(ev.adaptive_performance(s, KEY).join(ev.latency(s, KEY), KEY).join(sizes, KEY)), "adaptive")
    artifacts.write_report(perf.orderBy(*KEY), f"{out}/adaptive_performance", 6)
    base = spark.read.option("header", "true").option("inferSchema", "false").csv(f"{out}/ad_performance")
    cast = lambda df: df.select(*[F.col(c).cast("string") for c in KEY], *[F.col(c).cast("double") for c in ("auc", "f1", "recall")])
    both = ev.compare(_of(cast(base), kernel), cast(perf), KEY, ["auc", "f1", "recall"])
    artifacts.write_report(both, f"{out}/baseline_vs_adapted", 6)
    artifacts.write_report(ev.delta_box(both, "auc"), f"{out}/delta_box", 6)
    artifacts.write_report(plots.r_trace_panel(s, KEY), f"{out}/r_trace_panel", 6)
    artifacts.write_report(plots.adapted_points(s).select(*KEY, "stream_pos", "r_trace", "kind"), f"{out}/r_trace_points", 6)
