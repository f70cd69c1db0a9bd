"""Distances between the source and target distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.functions.kernels import Kernel
from orrery.operators import gram
from orrery.operators.ranks import _joined, ranged, with_next, with_running


def median_gamma(rows: DataFrame, key: str = "vec_id", x: str = "x", limit: int = 2000, seed: int = 42) -> DataFrame:
    """``gram.median_gammas`` of the table as one run; 1 without rows."""
    one = gram.median_gammas(rows.withColumn("_run", F.lit(0)), ["_run"], key, x, limit, seed)
    return one.agg(F.coalesce(F.max("gamma"), F.lit(1.0)).alias("gamma"))


def mmd2_by(rows: DataFrame, by: list[str], side: str, gamma: str, x: str = "x") -> DataFrame:
    """Biased squared MMD between sides ``a`` and ``b`` of each run, with its RBF kernel; null when a side is empty."""
    sums = gram.rbf_sums(rows, by, side, gamma, x)
    mean = lambda a, b: F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("total") / F.col("pairs")))
    return sums.groupBy(*by).agg((mean("a", "a") + mean("b", "b") - 2 * mean("a", "b")).alias("mmd2"))


def mmd2(source: DataFrame, target: DataFrame, gamma: float, key: str = "vec_id", x: str = "x") -> DataFrame:
    """Biased squared MMD with an RBF kernel; one row."""
    side = lambda df, s: df.select(F.col(x).alias("x"), F.lit(s).alias("side"), F.lit(gamma).alias("gamma"), F.lit(0).alias("_run"))
    both = side(source, "a").unionByName(side(target, "b"))
    return mmd2_by(both, ["_run"], "side", "gamma").select("mmd2")


def wasserstein(rows: DataFrame, by: list[str], side: str, value: str) -> DataFrame:
    """1-D Wasserstein-1 between ``side`` 'a' and 'b' of each group: area between the two distribution functions.

    Counted per distinct value first, then accumulated over ranges of values; null values are left out, and null is the result when a side is empty.
    """
    per = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.sum((F.col(side) == "a").cast("long")).alias("a"), F.sum((F.col(side) == "b").cast("long")).alias("b"))
    table = ranged(per, by, ["v"])
    steps = with_next(with_running(table, by, ["v"], ["a", "b"]), by, "v", "next")
    tot = table.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    joined = _joined(steps, tot, by) if by else steps.join(F.broadcast(tot))
    share = lambda s: (F.col(f"{s}_before") + F.col(s)) / F.nullif(F.col(f"n{s}"), F.lit(0))
    area = F.sum(F.abs(share("a") - share("b")) * F.coalesce(F.col("next") - F.col("v"), F.lit(0.0)))
    return joined.groupBy(*by).agg(F.when(F.max("na") * F.max("nb") > 0, area).alias("w1"))


def make_kernel(name: str, rows: DataFrame, key: str = "vec_id", x: str = "x") -> Kernel:
    """``linear``, or ``rbf`` with the median heuristic over ``rows``."""
    if name == "rbf":
        return Kernel("rbf", float(median_gamma(rows, key, x).first().gamma))
    if name == "linear":
        return Kernel("linear")
    raise ValueError(f"unknown kernel {name}")
