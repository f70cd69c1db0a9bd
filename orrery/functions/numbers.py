"""Scalar expressions of the reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def growth_pct(before: Column, after: Column) -> Column:
    return F.when(before > 0, (after - before) / before * 100)


def mapped(key: Column, names: dict) -> Column:
    """The name for a key, or the key itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key], key.cast("string"))


def replaced(value: Column, names: dict) -> Column:
    """Old names become new ones; any other value, null too, stays."""
    out = value
    for old, new in names.items():
        out = F.when(value == old, F.lit(new)).otherwise(out)
    return out


def near(a: Column, b: float, tol: float = 1e-6) -> Column:
    return F.abs(a - F.lit(b)) < tol
