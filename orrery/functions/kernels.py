"""Kernels: a small frozen description with a column form and a matrix form."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, functions as F

from orrery.functions.arrays import dot, sq_dist, sq_norm


@dataclass(frozen=True)
class Kernel:
    """``linear``: x.y + coef0; ``rbf``: exp(-gamma |x-y|^2); ``poly``: (gamma x.y + coef0)^degree."""

    name: str = "linear"
    gamma: float = 1.0
    coef0: float = 0.0
    degree: float = 3.0

    def __post_init__(self) -> None:
        if self.name not in ("linear", "rbf", "poly"):
            raise ValueError(f"unknown kernel {self.name}")
        if self.name == "rbf" and self.gamma <= 0:
            raise ValueError("gamma must be positive")

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> Kernel:
        return Kernel(**d)

    def column(self, x: Column, y: Column) -> Column:
        if self.name == "rbf":
            return F.exp(-F.lit(self.gamma) * F.greatest(sq_dist(x, y), F.lit(0.0)))
        if self.name == "poly":
            return F.pow(F.lit(self.gamma) * dot(x, y) + F.lit(self.coef0), F.lit(self.degree))
        return dot(x, y) + F.lit(self.coef0)

    def diag_column(self, x: Column) -> Column:
        if self.name == "rbf":
            return F.lit(1.0)
        if self.name == "poly":
            return F.pow(F.lit(self.gamma) * sq_norm(x) + F.lit(self.coef0), F.lit(self.degree))
        return sq_norm(x) + F.lit(self.coef0)

    def matrix(self, a: np.ndarray, b: np.ndarray, aa: np.ndarray | None = None, bb: np.ndarray | None = None) -> np.ndarray:
        """Values of all pairs of rows; ``aa``, ``bb``: the rows' squared norms, if known."""
        g = a @ b.T
        if self.name == "rbf":
            d2 = ((a * a).sum(1) if aa is None else aa)[:, None] + ((b * b).sum(1) if bb is None else bb)[None, :] - 2 * g
            return np.exp(-self.gamma * np.maximum(d2, 0))
        return (self.gamma * g + self.coef0) ** self.degree if self.name == "poly" else g + self.coef0

    def diag(self, a: np.ndarray) -> np.ndarray:
        n = (a * a).sum(1)
        if self.name == "rbf":
            return np.ones(len(a))
        return (self.gamma * n + self.coef0) ** self.degree if self.name == "poly" else n + self.coef0


def polynomial(degree: float = 3.0, gamma: float = 1.0, coef0: float = 1.0) -> Kernel:
    return Kernel("poly", gamma, coef0, degree)
