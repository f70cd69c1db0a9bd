"""Metrics of scored runs, each one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.numbers import growth_pct, ratio
from orrery.operators.ranks import _joined, ranged, with_percentiles, with_running
from orrery.operators.scoring import ANOMALY


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def confusion(rows: DataFrame, by: list[str], y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    t, p = F.col(y) == 1, F.col(pred) == 1
    return rows.groupBy(*by).agg(_count(t & p).alias("tp"), _count(~t & ~p).alias("tn"), _count(~t & p).alias("fp"), _count(t & ~p).alias("fn"))


def with_rates(cm: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    prec, rec = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return cm.select("*", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), prec.alias("prec"), rec.alias("recall"), ratio(2 * prec * rec, prec + rec).alias("f1"))


def auc(rows: DataFrame, by: list[str], y: str = "y_true", score: str = "score") -> DataFrame:
    """Exact ROC-AUC with ties counted half; null when a class is missing.

    Rows are counted per distinct score first and ranked over ranges of scores (``ranks``), so a run spreads over tasks.
    """
    per = rows.groupBy(*by, score).agg(_count(F.col(y) == 1).alias("p"), _count(F.col(y) == 0).alias("n"))
    wins = with_running(ranged(per, by, [score]), by, [score], ["n"]).withColumn("w", F.col("p") * (F.col("n_before") + F.col("n") / 2))
    out = wins.groupBy(*by).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auc"))


def performance(rows: DataFrame, by: list[str], both_classes: bool = True) -> DataFrame:
    """Counts, rates and AUC per run; runs of one class are left out, or kept with a null AUC."""
    a = auc(rows, by)
    m = with_rates(confusion(rows, by)).join(a, by, "inner" if by else "cross")
    return m.filter(F.col("auc").isNotNull()) if both_classes else m


def decision_rates(stream: DataFrame, by: list[str]) -> DataFrame:
    n = lambda d, t: _count((F.col("decision") == d) & (F.col("y_true") == t))
    return stream.groupBy(*by).agg(
        *[n(d, t).alias(f"n_{name}_{cls}") for d, name in enumerate(("skip", "adapt", "anomaly")) for t, cls in ((0, "normal"), (1, "fault"))]
    )


def latency(stream: DataFrame, by: list[str], seconds: str = "latency_s") -> DataFrame:
    ms = F.col(seconds) * 1000
    base = stream.groupBy(*by).agg(F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"), F.sum(F.col(seconds)).alias("total_s"))
    return with_percentiles(base, stream, by, ms, {"p50_ms": 0.5, "p99_ms": 0.99}).select(*by, "mean_ms", "p50_ms", "p99_ms", "max_ms", "total_s")


def detection_delay(stream: DataFrame, by: list[str]) -> DataFrame:
    """Steps from the first fault to the first detected fault; -1 never detected, null without faults."""
    fault, hit = F.col("y_true") == 1, (F.col("y_true") == 1) & (F.col("decision") == ANOMALY)
    out = stream.groupBy(*by).agg(F.min(F.when(fault, F.col("stream_pos"))).alias("_f"), F.min(F.when(hit, F.col("stream_pos"))).alias("_h"))
    return out.select(*by, F.when(F.col("_f").isNull(), F.lit(None)).when(F.col("_h").isNull(), F.lit(-1)).otherwise(F.col("_h") - F.col("_f")).cast("long").alias("delay"))


def adaptive_performance(stream: DataFrame, by: list[str]) -> DataFrame:
    """Rates from decision codes, AUC of the negated score, delay, radius trace and growth. ``r_pretrain`` and ``r_final`` are run constants."""
    rows = stream.withColumns({"y_pred": (F.col("decision") == ANOMALY).cast("int"), "neg": -F.col("score")})
    base = with_rates(confusion(rows, by)).join(auc(rows, by, score="neg"), by).join(decision_rates(rows, by), by).join(detection_delay(rows, by), by)
    trace = rows.groupBy(*by).agg(
        F.avg("r_trace").alias("r_mean"), F.stddev_pop("r_trace").alias("r_std"), F.max("r_pretrain").alias("r_pretrain"), F.max("r_final").alias("r_final")
    )
    return base.join(trace.withColumn("r_growth_pct", growth_pct(F.col("r_pretrain"), F.col("r_final"))), by)


def distance_ratio(distances: DataFrame, by: list[str], groups: list[str], d: str = "d", r: str = "r") -> DataFrame:
    """Statistics of d/R per group of each run with R > 0; a group without rows has n = 0 and nulls."""
    ok = distances.filter(F.col(r) > 0)
    q = F.col(d) / F.col(r)
    stats = ok.groupBy(*by, "grp").agg(F.count(d).alias("n"), F.avg(q).alias("mean"), F.stddev_pop(q).alias("std"))
    stats = with_percentiles(stats, ok, [*by, "grp"], q, {f"p{p}": p / 100 for p in (5, 25, 50, 75, 95)})
    spine = ok.select(*by).distinct().withColumn("grp", F.explode(F.array(*[F.lit(g) for g in groups])))
    out = _joined(spine, stats, [*by, "grp"], "left")
    return out.select(*by, "grp", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", *[f"p{p}" for p in (5, 25, 50, 75, 95)])


def confusion_by(cm: DataFrame, by: list[str]) -> DataFrame:
    """Counts summed over runs and row-normalised; an empty class row is 0."""
    s = cm.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])
    n, p = F.col("tn") + F.col("fp"), F.col("tp") + F.col("fn")
    return s.select("*", ratio(F.col("tn"), n).alias("tn_rate"), ratio(F.col("fp"), n).alias("fp_rate"), ratio(F.col("fn"), p).alias("fn_rate"), ratio(F.col("tp"), p).alias("tp_rate"))


def metric_pivot(rows: DataFrame, metric: str, datasets: list[str]) -> DataFrame:
    """Mean per prep with a column per dataset, and the mean of the columns that are present."""
    wide = rows.groupBy("prep").pivot("dataset", datasets).agg(F.avg(metric))
    vals = F.filter(F.array(*[F.col(d) for d in datasets]), lambda v: v.isNotNull())
    return wide.withColumn("overall", F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / F.size(vals)))


def compare(base: DataFrame, adapted: DataFrame, by: list[str], metrics: list[str], decimals: int = 6) -> DataFrame:
    """Inner join of two reports whose numbers were rounded on writing; delta = adapted - base."""
    b = base.select(*by, *[F.round(m, decimals).alias(f"{m}_base") for m in metrics])
    a = adapted.select(*by, *[F.round(m, decimals).alias(f"{m}_adapted") for m in metrics])
    return b.join(a, by).select("*", *[(F.col(f"{m}_adapted") - F.col(f"{m}_base")).alias(f"delta_{m}") for m in metrics])


def zone_occupancy(distances: DataFrame, by: list[str], inner: Column, outer: Column) -> DataFrame:
    d = F.col("d")
    return distances.groupBy(*by, "grp").agg(
        F.count("d").alias("n"),
        (_count(d < inner) * 100 / F.count("d")).alias("inner_pct"),
        (_count((d >= inner) & (d <= outer)) * 100 / F.count("d")).alias("adaptation_pct"),
        (_count(d > outer) * 100 / F.count("d")).alias("outer_pct"),
        F.avg("d").alias("mean_d"),
        F.stddev_pop("d").alias("std_d"),
    )


def tradeoff(zones: DataFrame, auc_pivot: DataFrame, f1_pivot: DataFrame) -> DataFrame:
    """Zone shares of target normals per prep beside both metrics; the pivots hold one row per prep."""
    z = zones.filter(F.col("grp") == "target_normal").groupBy("prep").agg(*[F.avg(c).alias(c) for c in ("inner_pct", "adaptation_pct", "outer_pct")])
    a = auc_pivot.select("prep", F.col("overall").alias("auc"))
    f = f1_pivot.select("prep", F.col("overall").alias("f1"))
    return z.join(a, "prep", "left").join(f, "prep", "left")


def delta_box(compared: DataFrame, metric: str) -> DataFrame:
    """Quartiles of a delta per prep, for a box plot."""
    n = compared.groupBy("prep").agg(F.count("*").alias("n"))
    return with_percentiles(n, compared, ["prep"], F.col(f"delta_{metric}"), {"lo": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "hi": 1.0})
