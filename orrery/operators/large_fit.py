"""The linear one-class description of runs too large for one task.

The weights live in the polytope of sum 1 and box [0, C]. Its vertex that violates the optimality conditions most puts C on the rows with the largest
gradients, which are those farthest from the centre; for the dual it is two sums, of x and of |x|^2. So a round is two passes over the rows: one counts
squared distances in bins and finds where the nu-share of the largest begins, one adds up the rows beyond it (those in the bin in part, so that
weights sum to 1 exactly). The driver keeps the sums of the vertices (a vector each) and mixes them to the best weights (simplicial decomposition). Rounds end
when the duality gap, an upper bound of what any weights could still gain, is below the tolerance; the gap is returned. A row's weight follows from the vertices that hold it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BINS = 4096
ROUNDS = 300


@dataclass
class Vertex:
    """Weight ``high`` on rows whose squared distance from ``at`` is above ``top``, ``part`` on those above ``low``; without ``at`` the same on all."""

    mean: np.ndarray
    square: float
    at: np.ndarray | None = None
    low: float = 0.0
    top: float = 0.0
    high: float = 0.0
    part: float = 0.0

    def weights(self, x: np.ndarray) -> np.ndarray:
        if self.at is None:
            return np.full(len(x), self.high)
        g = sq_distance(x, self.at)
        return np.where(g > self.top, self.high, np.where(g > self.low, self.part, 0.0))


@dataclass
class Fit:
    n: int
    c: float
    vertices: list[Vertex]
    mix: np.ndarray
    low: float = 0.0
    high: float = 0.0
    gap: float = math.inf
    rounds: int = 0
    r2: float = 0.0
    done: bool = False
    bins: np.ndarray = field(default_factory=lambda: np.zeros(BINS + 2))

    @property
    def center(self) -> np.ndarray:
        return sum(w * v.mean for w, v in zip(self.mix, self.vertices))

    @property
    def square(self) -> float:
        return float(sum(w * v.square for w, v in zip(self.mix, self.vertices)))


def sq_distance(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The dual's gradient but for a constant."""
    return ((x - a) ** 2).sum(1)


def wider(f: Fit) -> None:
    f.low, f.high = f.low - 2 * (f.high - f.low), f.high + 2 * (f.high - f.low)


def best_mix(means: np.ndarray, squares: np.ndarray, start: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """Weights w of sum 1, none below 0, that maximise squares.w - |means'w|^2, by moving mass between pairs."""
    k, w = 2 * means @ means.T, start.copy()
    g = squares - k @ w
    for _ in range(rounds):
        held = np.flatnonzero(w > 0)
        i, j = int(np.argmax(g)), int(held[np.argmin(g[held])])
        if g[i] - g[j] < 1e-12:
            break
        bend = k[i, i] + k[j, j] - 2 * k[i, j]
        step = min(w[j], (g[i] - g[j]) / bend) if bend > 0 else w[j]
        w[i] += step
        w[j] = 0.0 if step == w[j] else w[j] - step
        g -= step * (k[:, i] - k[:, j])
    return w / w.sum()


def _summed(rows: DataFrame, by: str, of, width) -> dict[str, np.ndarray]:
    """Sums over all rows of ``of(run, matrix)``, a vector for each run; partial sums are a row for each task and run."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            runs = np.array(b.column(0).to_pylist(), object)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(runs), -1) if len(set(map(len, b.column(1)))) <= 1 else None
            for r in set(runs.tolist()):
                mine = x[runs == r] if x is not None else np.array([v for v, q in zip(b.column(1).to_pylist(), runs) if q == r], float)
                got = of(r, mine)
                if got is not None:
                    held[r] = held.get(r, 0) + got
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["run", "sums"])

    parts = rows.select(F.col(by).cast("string").alias("run"), F.col("x").cast("array<double>").alias("x")).mapInArrow(part, "run string, sums array<double>")
    total = parts.select("run", F.posexplode("sums").alias("i", "v")).groupBy("run", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in total.collect():  # a vector a run
        out.setdefault(r.run, np.zeros(width(r.run)))[r.i] = r.v
    return out


def _counts(rows: DataFrame, by: str, fits: dict[str, Fit]) -> dict[str, np.ndarray]:
    """Rows by bin of their squared distance, and outside on both sides."""
    state = {k: (f.center, f.low, f.high) for k, f in fits.items() if not f.done}

    def of(run: str, x: np.ndarray) -> np.ndarray | None:
        if run not in state:
            return None
        a, low, high = state[run]
        at = np.clip(np.floor((sq_distance(x, a) - low) / (high - low) * BINS), -1, BINS).astype(int) + 1
        return np.bincount(at, minlength=BINS + 2).astype(float)

    return _summed(rows, by, of, lambda _: BINS + 2)


def _edges(f: Fit, counts: np.ndarray, share: float) -> tuple[float, float, float, float] | None:
    """Bounds of the bin in which the largest ``share`` rows end, how many lie above, and how many in it; None if it is outside."""
    above = np.cumsum(counts[::-1])[::-1]
    at = int(np.flatnonzero(above >= share - 1e-9)[-1])
    if at == 0 or at == BINS + 1:
        return None
    step = (f.high - f.low) / BINS
    return f.low + (at - 1) * step, f.low + at * step, above[at + 1], counts[at]


def fit_large(train: DataFrame, nu: float = 0.1, tol: float = 1e-3, by: str = "scenario_id", rounds: int = ROUNDS) -> dict[str, Fit]:
    """A fit for each run of at least two rows (``by``, ``x``). No task holds more than a batch of rows; the driver holds a vector a round and run."""
    rows = train.filter("x is not null")
    first = rows.groupBy(F.col(by).cast("string").alias("run")).agg(F.max(F.size("x")).alias("d")).collect()
    dim = {r.run: r.d for r in first}
    start = _summed(rows, by, lambda _, x: np.r_[len(x), (x * x).sum(), x.sum(0)], lambda r: dim[r] + 2)
    fits: dict[str, Fit] = {}
    for run, s in start.items():
        n = int(s[0])
        if n < 2 or nu * n < 1:
            continue
        fits[run] = Fit(n, 1 / (nu * n), [Vertex(s[2:] / n, s[1] / n, high=1 / n)], np.ones(1))
    spread = _summed(rows, by, lambda r, x: _extent(fits.get(r), x), lambda _: 2) if fits else {}
    for run, f in fits.items():
        f.low, f.high = -1e-9, 4 * spread[run][0] + 1e-9
    for turn in range(rounds):
        todo = {k: f for k, f in fits.items() if not f.done}
        if not todo:
            break
        bounds = {}
        counts = _counts(rows, by, todo)
        for k, f in todo.items():
            e = _edges(f, counts[k], nu * f.n)
            if e is None:
                wider(f)
            else:
                bounds[k] = e
        _round(rows, by, {k: todo[k] for k in bounds}, bounds, dim, nu, tol)
    _radii(rows, by, fits, nu)
    return fits


def _extent(f: Fit | None, x: np.ndarray) -> np.ndarray | None:
    """The mean squared distance from the centre, in parts."""
    return None if f is None else np.array([sq_distance(x, f.center).sum() / f.n, 0.0])


def _round(rows: DataFrame, by: str, fits: dict[str, Fit], bounds: dict, dim: dict, nu: float, tol: float) -> None:
    """Add each run's most violating vertex, or end the run."""
    state = {k: (f.center, bounds[k][0], bounds[k][1]) for k, f in fits.items()}

    def of(run: str, x: np.ndarray) -> np.ndarray | None:
        if run not in state:
            return None
        a, low, top = state[run]
        g, sq = sq_distance(x, a), (x * x).sum(1)
        out = []
        for m in (g > top, (g > low) & (g <= top)):
            out += [m.sum(), g[m].sum(), sq[m].sum(), *x[m].sum(0)]
        return np.array(out, float)

    for k, s in (_summed(rows, by, of, lambda r: 2 * (dim[r] + 3)) if fits else {}).items():
        f, half = fits[k], dim[k] + 3
        (n1, g1, q1, *v1), (n2, _, q2, *v2) = s[:half], s[half:]
        left = 1 - f.c * n1
        part = left / n2 if n2 else 0.0
        a = f.center
        f.gap = float(f.c * g1 + left * bounds[k][1] - (f.square - a @ a))
        f.rounds += 1
        if f.gap <= tol * max(1e-12, f.square - a @ a):
            f.done = True
            continue
        f.vertices.append(Vertex(f.c * np.array(v1) + part * np.array(v2), f.c * q1 + part * q2, a, bounds[k][0], bounds[k][1], f.c, part))
        means = np.array([v.mean for v in f.vertices])
        w = best_mix(means - means[0], np.array([v.square for v in f.vertices]) - 2 * means @ means[0], np.r_[f.mix, 0.0])
        keep = w > 1e-12
        keep[-1] = True
        f.vertices, f.mix = [v for v, q in zip(f.vertices, keep) if q], w[keep] / w[keep].sum()
        width = bounds[k][1] - bounds[k][0]
        mid = (bounds[k][0] + bounds[k][1]) / 2
        span = max((f.high - f.low) / 4, 64 * width)  # bins narrow as the threshold settles
        if span < f.high - f.low:
            f.low, f.high = mid - span / 2, mid + span / 2


def _radii(rows: DataFrame, by: str, fits: dict[str, Fit], nu: float) -> None:
    """R2: the distance beyond which lies the nu-share, found to a bin of a bin."""
    for f in fits.values():
        f.done = False
    for _ in range(4):
        counts = _counts(rows, by, fits) if fits else {}
        for k, f in fits.items():
            e = _edges(f, counts[k], nu * f.n)
            if e is None:
                wider(f)
                continue
            f.r2 = float((e[0] + e[1]) / 2)
            step = e[1] - e[0]
            f.low, f.high = e[0] - 2 * step, e[1] + 2 * step
    for f in fits.values():
        f.done = True


def with_weights(train: DataFrame, fits: dict[str, Fit], by: str = "scenario_id", x: str = "x") -> DataFrame:
    """Rows with ``alpha``, the weight that the fit of their run gives them (null without one)."""
    runs = {k: [(w, v) for w, v in zip(f.mix, f.vertices) if w > 0] for k, f in fits.items()}

    @F.udf("double", useArrow=True)
    def alpha(run, v):
        if v is None or run not in runs:
            return None
        m = np.asarray(v, float)[None]
        return float(sum(w * q.weights(m)[0] for w, q in runs[run]))

    return train.withColumn("alpha", alpha(F.col(by).cast("string"), F.col(x).cast("array<double>")))
