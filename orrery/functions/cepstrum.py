"""Real cepstrum of equal-length windows, one Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from orrery.functions.arrays import lifter


def real_cepstrum(rows: np.ndarray) -> np.ndarray:
    """Rows of a matrix; coefficients 0..n//2. Only matrices are taken."""
    if rows.ndim != 2:
        raise ValueError("a matrix of windows is needed")
    n = rows.shape[1]
    power = np.log(np.abs(np.fft.fft(rows.astype(np.float64), axis=1)) + 1e-12)
    return np.fft.ifft(power, axis=1).real[:, : n // 2 + 1].astype(np.float32)


def z_rows(rows: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """z-score of each row as ``arrays.z_score`` has it, to the last bit: sums run in order and results are single precision."""
    n = rows.shape[1]
    d = rows - (np.cumsum(rows, axis=1)[:, -1:] / n)
    s = np.sqrt(np.cumsum(d * d, axis=1)[:, -1:] / n)
    return (d / np.where(s < floor, 1.0, s)).astype(np.float32)


def _by_length(windows: pd.Series, of) -> pd.Series:
    """``of`` on the matrix of all windows of a length at once; null and empty windows give null."""
    out: list = [None] * len(windows)
    lengths = windows.map(lambda w: -1 if w is None else len(w)).to_numpy()
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        for i, row in zip(at, of(np.stack(windows.iloc[at].to_list()).astype(np.float64))):
            out[i] = row
    return pd.Series(out, index=windows.index)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _cepstrum(windows: pd.Series) -> pd.Series:
    return _by_length(windows, real_cepstrum)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _z_cepstrum(windows: pd.Series) -> pd.Series:
    return _by_length(windows, lambda m: real_cepstrum(z_rows(m)))


def cepstrum(x: Column) -> Column:
    return _cepstrum(x)


def z_cepstrum(x: Column) -> Column:
    """Cepstrum of the z-scored window, both in one Arrow function: linear in the window but for the FFT."""
    return _z_cepstrum(x)


def window_features(windows: DataFrame, lifter_n: int | None = None) -> DataFrame:
    """z-score, cepstrum, lifter of each row's window ``x``: works alike on a table and on a stream."""
    return windows.withColumn("features", lifter(z_cepstrum(F.col("x")), lifter_n)).drop("x")
