"""Preprocessings: named functions from a matrix of windows to a matrix of features, applied to Arrow batches side by side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from orrery.functions.cepstrum import _by_length, real_cepstrum, z_rows

Prep = Callable[[np.ndarray], np.ndarray]
CEPSTRUM = "p4_cepstrum"
# Names of preprocessings in reports.
PREP_LABELS = {CEPSTRUM: "Cepstrum"}


def default_preps(lifter_n: int | None = None) -> dict[str, Prep]:
    """The cepstrum of z-scored windows, up to ``lifter_n`` coefficients."""
    return {CEPSTRUM: lambda m: real_cepstrum(z_rows(m))[:, :lifter_n]}


def _guarded(fn: Prep):
    @F.pandas_udf("features array<double>, error string")
    def run(windows: pd.Series) -> pd.DataFrame:
        try:
            out, error = _by_length(windows, lambda m: np.asarray(fn(m), np.float64)), None
        except Exception as e:  # noqa: BLE001 - whatever a preprocessing raises is a record of its run
            out, error = pd.Series([None] * len(windows)), f"{type(e).__name__}: {e}"
        return pd.DataFrame({"features": out.to_numpy(), "error": [error] * len(windows)})

    return run


def with_preps(windows: DataFrame, preps: dict[str, Prep], x: str = "x") -> DataFrame:
    """A row for each window and preprocessing: ``prep``, ``x`` (its features) and ``error`` (with null features) in place of the window."""
    done = windows.withColumns({f"_p{i}": _guarded(fn)(F.col(x)) for i, fn in enumerate(preps.values())}).drop(x)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("prep"), F.col(f"_p{i}.features").alias("x"), F.col(f"_p{i}.error").alias("error")) for i, name in enumerate(preps)]))
    return done.withColumn("_p", each).select("*", "_p.*").drop("_p", *[f"_p{i}" for i in range(len(preps))])
