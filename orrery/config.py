"""Settings of the two public bearing data sets and of the solver."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Dataset:
    name: str
    domains: dict[str, int]
    window: int
    lifter_n: int | None
    rho: tuple[float, float]
    sampling_rate: int


# Shaft speeds by domain, window and lifter lengths, radius factors.
DATASETS = {
    "cwru": Dataset("cwru", {"A": 1730, "B": 1750, "C": 1772, "D": 1797}, 2048, 64, (0.5, 1.5), 12000),
    "pu": Dataset("pu", {"A": 900, "B": 1500}, 4096, 512, (0.5, 1.2), 64000),
}


@dataclass(frozen=True)
class Solver:
    nu: float = 0.1
    max_iter: int = 1000
    tol: float = 1e-3
    buffer_cap: int = 5000
    warmup_share: float = 0.10
    inner_iter: int = 10
    mode: str = "dual"  # or "single": one moving radius
    kernel: str = "linear"
    gamma: float | None = None
    ratios: tuple[float, ...] = field(default=(0.70, 0.15, 0.15))
