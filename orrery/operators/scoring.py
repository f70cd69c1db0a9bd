"""Scoring against a trained description and the decision rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.arrays import mean_vector, sq_dist
from orrery.functions.kernels import Kernel
from orrery.operators.ranks import with_percentiles
from orrery.storage import stored

SKIP, ADAPT, ANOMALY = 0, 1, 2
EPS = 10 * float(np.finfo(np.float32).eps)


def center_model(train: DataFrame, dim: int, x: str = "x") -> DataFrame:
    """Closed form at nu = 1 with the linear kernel: the centre is the mean and R2 the largest squared distance. One row."""
    center = train.agg(mean_vector(dim, x).alias("center"))
    far = train.join(F.broadcast(center)).agg(F.first("center").alias("center"), F.max(sq_dist(F.col(x), F.col("center"))).alias("r2"))
    return far.withColumn("r", F.sqrt("r2"))


def with_distance(rows: DataFrame, model: DataFrame, x: str = "x") -> DataFrame:
    """``d2`` and ``d`` to the one-row linear model's centre; the model is one vector."""
    out = rows.join(F.broadcast(model))
    return out.withColumn("d2", sq_dist(F.col(x), F.col("center"))).withColumn("d", F.sqrt("d2"))


def predict_distance(d: Column, r: Column) -> Column:
    """1 beyond the radius; a tie is normal."""
    return (d > r).cast("int")


def predict_sign(d2: Column, r2: Column) -> Column:
    return F.when(r2 - d2 >= 0, 1).otherwise(-1)


def zone(d2: Column, inner: Column, outer: Column) -> Column:
    """Skip inside the inner radius, anomaly outside the outer one, adapt between and on ties."""
    return F.when(d2 < inner * inner, SKIP).when(d2 > outer * outer, ANOMALY).otherwise(ADAPT)


def r2_tiers(rows: DataFrame, by: list[str], c: Column, eps: float) -> DataFrame:
    """R2 from (alpha, d2): mean over margin vectors, else largest over active ones, else the 0.95 quantile."""
    a, d2 = F.col("alpha"), F.col("d2")
    out = rows.groupBy(*by).agg(F.avg(F.when((a > eps) & (a < c - eps), d2)).alias("_t1"), F.max(F.when(a > eps, d2)).alias("_t2"))
    none = out.filter(F.coalesce("_t1", "_t2").isNull()).select(*by)
    out = with_percentiles(out, rows.join(none, by, "left_semi"), by, d2, {"_t3": 0.95})
    tier = F.when(F.col("_t1").isNotNull(), 1).when(F.col("_t2").isNotNull(), 2).otherwise(3)
    return out.select(*by, F.coalesce("_t1", "_t2", "_t3").alias("r2"), tier.alias("tier"))


def top_alpha(vectors: DataFrame, n: int, by: list[str], c: float, eps: float = EPS, rounds: int = 50) -> DataFrame:
    """The n largest weights of each model, scaled to sum 1 and moved into [0, c]: clipped, then what is missing spread over weights strictly
    between the bounds, and again, as ``svdd.to_capped_simplex`` has it. A model's weights are an array of n, folded in the JVM."""
    w = Window.partitionBy(*by).orderBy(F.desc("alpha"), "sv_idx")
    kept = vectors.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    rows = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", *[x for x in vectors.columns if x not in by]))).alias("_v"))
    clip = lambda a: F.transform(a, lambda x: F.greatest(F.least(x, F.lit(c)), F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    open_ = lambda x: (x > 0) & (x < c - eps)

    def spread(a: Column) -> Column:
        lack, k = F.lit(1.0) - total(a), F.size(F.filter(a, open_))
        more = F.transform(F.array(F.struct(lack.alias("lack"), k.alias("k"))), lambda t: F.when((F.abs(t["lack"]) <= eps) | (t["k"] == 0), a).otherwise(clip(F.transform(a, lambda x: F.when(open_(x), x + t["lack"] / F.greatest(t["k"], F.lit(1))).otherwise(x)))))
        return more[0]

    first = F.transform(F.array(F.transform("_v", lambda v: v["alpha"].cast("double"))), lambda a: F.transform(F.array(total(a)), lambda s: clip(F.transform(a, lambda x: x / s)))[0])[0]
    done = rows.withColumn("_a", first).withColumn("_a", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("_a"), lambda a, _: spread(a)))
    flat = done.select(*by, F.explode(F.arrays_zip("_v", "_a")).alias("_r")).select(*by, "_r._v.*", F.col("_r._a").alias("_new"))
    return flat.withColumn("alpha", F.col("_new")).drop("_new")


BROADCAST_BYTES = 4 << 20
AT_ONCE = 1 << 21  # kernel values of a task at a time


def kernel_distances(rows: DataFrame, vectors: DataFrame, kernel: Kernel, by: str = "scenario_id", x: str = "x", most: int = BROADCAST_BYTES) -> DataFrame:
    """``d2`` of rows to the description of their scenario under any kernel. ``vectors``: key, sv_idx, alpha, x.

    Descriptions of up to ``most`` bytes together are broadcast and applied to Arrow batches; larger ones meet rows, and one another for their
    norms, in cells of a grid (``gram.weighted_sums``), both giving the same numbers. Rows of a scenario without vectors are left out.
    """
    from orrery.operators import gram  # it uses this module

    size = vectors.agg(F.sum(F.size("x") * 8 + 16)).first()[0] or 0
    if size > most:
        held = stored(vectors.select(by, "alpha", F.col("x").alias(x), F.monotonically_increasing_id().alias("_row")), "vectors")
        own = gram.weighted_sums(held, held, kernel, by, "_row", x).select("_row", F.col("total").alias("_total"))
        norm = held.select(by, "_row", "alpha").join(own, "_row").groupBy(by).agg(F.sum(F.col("alpha") * F.col("_total")).alias("_norm"))
        numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
        cross = gram.weighted_sums(numbered, held, kernel, by, "_row", x).select("_row", F.col("total").alias("_cross"))
        both = numbered.join(cross, "_row").join(norm, by)
        return both.select(*rows.columns, F.greatest(kernel.diag_column(F.col(x)) - 2 * F.col("_cross") + F.col("_norm"), F.lit(0.0)).alias("d2"))
    held: dict = {}
    for r in vectors.orderBy(by, "sv_idx").toLocalIterator():
        held.setdefault(r[by], []).append((r.alpha, r.x))
    models = {k: (np.array([a for a, _ in v]), np.array([y for _, y in v], float)) for k, v in held.items()}

    def sums(q: np.ndarray, a: np.ndarray, m: np.ndarray) -> np.ndarray:
        step = max(1, AT_ONCE // len(m))
        return np.concatenate([kernel.matrix(q[i : i + step], m) @ a for i in range(0, len(q), step)])

    sent = rows.sparkSession.sparkContext.broadcast({k: (a, m, float(a @ sums(m, a, m))) for k, (a, m) in models.items()})
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", d2 double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, g in b.groupby(by, sort=False):
                if key in sent.value:
                    a, m, norm = sent.value[key]
                    q = np.stack(g[x].to_list()).astype(float)
                    yield g.assign(d2=np.maximum(kernel.diag(q) - 2 * sums(q, a, m) + norm, 0))

    return rows.mapInPandas(run, schema)
