"""Array expressions evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def sq_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))


def sq_dist(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))))


def z_score(x: Column, floor: float = 1e-10) -> Column:
    """Per-array z-score with population deviation; a deviation below ``floor`` counts as 1. Single precision, as the
    cepstrum's zero-frequency bin is defined by that rounding."""
    # The moments are fields of a one-element array's struct, so that they are evaluated once a window, not once an element.
    one = F.transform(F.array(x), lambda w: F.struct(w.alias("w"), mean(w).alias("m")))
    two = F.transform(one, lambda t: F.struct(t["w"].alias("w"), t["m"].alias("m"), F.sqrt(_squares(t["w"], t["m"]) / F.greatest(F.size(t["w"]), F.lit(1))).alias("s")))
    unit = F.transform(two, lambda t: F.struct(t["w"].alias("w"), t["m"].alias("m"), F.when(t["s"] < floor, F.lit(1.0)).otherwise(t["s"]).alias("s")))
    return F.transform(unit, lambda t: F.transform(t["w"], lambda v: ((v - t["m"]) / t["s"]).cast("float")))[0]


def _squares(x: Column, m: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))


def lifter(x: Column, n: int | None) -> Column:
    """The first n coefficients; None keeps all."""
    return x if n is None else F.slice(x, 1, n)


def mean_vector(dim: int, x: str = "x") -> Column:
    """Aggregate: element-wise mean of arrays of a known length, one partial sum per element and no explode."""
    return F.array(*[F.avg(F.col(x)[i].cast("double")) for i in range(dim)])
