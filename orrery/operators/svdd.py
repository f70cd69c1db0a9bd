"""One-class description: fit per scenario, and the bounded online state that adapts it.

The fit works on one scenario's training windows in one task (scenarios run in parallel), the online state holds at
most ``capacity`` vectors and no kernel matrix: the two kernel rows a step needs are computed when needed.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.kernels import Kernel
from orrery.operators.scoring import EPS

AT_ONCE = 1 << 20  # kernel values at a time
ROUNDING, FEW, ANEW = 1e-17, 64, 1000  # of a weight; columns that cost less than the shared set; moves after which rounding is shed


def box_from_nu(n: int, nu: float) -> float:
    if n < 2:
        raise ValueError("at least two training rows are needed")
    return 1.0 / (nu * n)


def buffer_size(n_source: int, n_stream: int, c: float, cap: int = 5000) -> int:
    return max(min(n_source + n_stream, cap), math.ceil(1.0 / c) + 1)


def buffer_size_column(n_source: Column, n_stream: Column, c: Column, cap: int = 5000) -> Column:
    """``buffer_size`` of columns; 1 / c is rounded at the ninth place, as it stands for nu times a count."""
    return F.greatest(F.least(n_source + n_stream, F.lit(cap)), F.ceil(F.round(1 / c, 9)) + 1).cast("long")


def warmup_length(n_normal: int, share: float = 0.10) -> int:
    return int(n_normal * share)


def radius(alpha: np.ndarray, d2: np.ndarray, c: float) -> tuple[float, int]:
    """R2 and its tier: margin mean, active maximum, 0.95 quantile."""
    active = alpha > EPS
    margin = active & (alpha < c - EPS)
    if margin.any():
        return float(d2[margin].mean()), 1
    return (float(d2[active].max()), 2) if active.any() else (float(np.quantile(d2, 0.95)), 3)


def to_capped_simplex(a: np.ndarray, c: float, rounds: int = 50) -> np.ndarray:
    """Weights moved to sum 1 within [0, c]: clip, spread what is missing over weights strictly between the bounds, repeat.
    Zeros get nothing; without a free weight the clipped point is returned."""
    a = np.clip(a, 0.0, c)
    for _ in range(rounds):
        lack = 1.0 - a.sum()
        open_ = (a > 0) & (a < c - EPS)
        if abs(lack) <= EPS or not open_.any():
            break
        a = a.copy()
        a[open_] += lack / open_.sum()
        a = np.clip(a, 0.0, c)
    return a


@dataclass
class Description:
    """Vectors, weights and ``f`` = K.alpha of a fitted or adapting model."""

    kernel: Kernel
    c: float
    x: np.ndarray
    alpha: np.ndarray
    f: np.ndarray
    diag: np.ndarray
    r2: float = 0.0
    tier: int = 0
    norm2: float = 0.0
    iterations: int = 0
    gap: float = 0.0
    capacity: int = 0
    evict: str = "redistribute"
    _room: tuple | None = None  # x, alpha, f, diag and squared norms with space for ``capacity`` vectors, from the first update on
    _open: tuple | None = None  # which vectors shared the last even spread of weight, and K times that set
    _moves: int = 0

    @staticmethod
    def fit(x: np.ndarray, kernel: Kernel, c: float, max_iter: int = 1000, tol: float = 1e-3) -> Description:
        """Pairwise ascent on the dual from equal weights: mass moves from the most satisfied to the most violating vector.
        Pairs that can't move are set aside until another pair does."""
        x = np.asarray(x, np.float32).astype(np.float64)
        n = len(x)
        if n == 0 or c * n < 1 - 1e-12:
            raise ValueError("C * N must be at least 1")
        diag = kernel.diag(x)
        a = np.full(n, 1.0 / n)
        # Kernel columns are made when a step needs them, so memory follows N, not its square.
        f = np.concatenate([kernel.matrix(x[b : b + 512], x) @ a for b in range(0, n, 512)])
        column = lambda m: kernel.matrix(x, x[m : m + 1])[:, 0]
        stuck: set[tuple[int, int]] = set()
        it, gap = 0, 0.0
        for it in range(1, max_iter + 1):
            g = diag - 2 * f
            up, down = np.flatnonzero(a < c - EPS), np.flatnonzero(a > EPS)
            if not len(up) or not len(down):
                break
            i, j = _open_pair(g, up, down, stuck)
            if i < 0:
                break
            gap = g[i] - g[j]
            if gap < tol:
                break
            ki, kj = column(i), column(j)
            eta = diag[i] + diag[j] - 2 * ki[j]
            step = min(gap / (2 * eta), c - a[i], a[j]) if eta > EPS else 0.0
            if abs(step) < EPS:
                stuck.add((i, j))
                continue
            a[i] += step
            a[j] -= step
            f += step * (ki - kj)
            stuck.clear()
        keep = a > EPS
        d = Description(kernel, c, x[keep], a[keep], f[keep], diag[keep], iterations=it, gap=float(gap))
        d._refresh()
        return d

    def _refresh(self) -> None:
        self.norm2 = float(self.alpha @ self.f)
        self.r2, self.tier = radius(self.alpha, np.maximum(self.diag - 2 * self.f + self.norm2, 0), self.c)

    def d2(self, rows: np.ndarray) -> np.ndarray:
        rows = np.atleast_2d(rows).astype(np.float64)
        return np.maximum(self.kernel.diag(rows) - 2 * self.kernel.matrix(rows, self.x, bb=self._squares()) @ self.alpha + self.norm2, 0)

    def bounded(self, capacity: int, evict: str = "redistribute") -> Description:
        """A copy ready to adapt: the largest weights that fit, scaled to sum 1."""
        top = np.sort(np.argsort(-self.alpha, kind="stable")[:capacity])
        a = to_capped_simplex(self.alpha[top] / self.alpha[top].sum(), self.c)
        x = self.x[top]
        f = np.concatenate([self.kernel.matrix(x[b : b + 512], x) @ a for b in range(0, len(x), 512)])
        d = Description(self.kernel, self.c, x, a, f, self.diag[top], capacity=capacity, evict=evict)
        d._refresh()
        return d

    def update(self, row: np.ndarray, inner_iter: int = 10, tol: float = 1e-3) -> None:
        """Take one vector in: a free slot, or the slot of the smallest weight; then steps that involve the new vector."""
        row = np.asarray(row, np.float64)
        own = float(self.kernel.diag(row[None])[0])
        n = len(self.x)
        if self._room is None:
            size = max(n, self.capacity)
            self._room = tuple(np.empty((size, *v.shape[1:])) for v in (self.x, self.alpha, self.f, self.diag, self.alpha))
            for to, v in zip(self._room, (self.x, self.alpha, self.f, self.diag, (self.x * self.x).sum(1))):
                to[:n] = v
        if n < self.capacity:
            new = n
            self._put(new, row, own)
            self._see(n + 1)
            self.alpha[new] = self.f[new] = 0.0
            k_new = self._row(row)
            self.f[new] = k_new @ self.alpha
            self._open = None
        else:
            self._see(n)
            new = int(np.argmin(self.alpha))
            gone, scale = self.alpha[new], 1.0
            a = self.alpha.copy()
            if self.evict == "transfer":
                a[new] = gone
            else:
                a[new] = 0.0
                if (rest := a.sum()) > EPS:
                    scale = 1 + gone / rest
                    a = to_capped_simplex(a * scale, self.c)
            k_old = self._row(self.x[new]) if gone or (self._open is not None and self._open[0][new]) else None
            self._put(new, row, own)
            k_new = self._row(row)
            self._move(a, new, scale, k_old, k_new)
        for _ in range(inner_iter):
            g = self.diag - 2 * self.f
            moves = []
            if self.alpha[new] < self.c - EPS and (others := np.flatnonzero((self.alpha > EPS) & (np.arange(len(g)) != new))).size:
                j = int(others[np.argmin(g[others])])
                moves.append((g[new] - g[j], new, j))
            if self.alpha[new] > EPS and (others := np.flatnonzero((self.alpha < self.c - EPS) & (np.arange(len(g)) != new))).size:
                i = int(others[np.argmax(g[others])])
                moves.append((g[i] - g[new], i, new))
            if not moves:
                break
            gap, i, j = max(moves, key=lambda m: m[0])
            if gap < tol:
                break
            other = j if i == new else i
            k_other = self._row(self.x[other])
            eta = self.diag[i] + self.diag[j] - 2 * k_new[other]
            step = min(gap / (2 * eta), self.c - self.alpha[i], self.alpha[j]) if eta > EPS else 0.0
            if abs(step) < EPS:
                break
            self.alpha[i] += step
            self.alpha[j] -= step
            self.f += step * ((k_new - k_other) if i == new else (k_other - k_new))
        self._refresh()

    def _squares(self) -> np.ndarray | None:
        return None if self._room is None else self._room[4][: len(self.x)]

    def _see(self, n: int) -> None:
        self.x, self.alpha, self.f, self.diag = (v[:n] for v in self._room[:4])

    def _put(self, at: int, row: np.ndarray, own: float) -> None:
        x, _, _, diag, squares = self._room
        x[at], diag[at], squares[at] = row, own, row @ row

    def _row(self, row: np.ndarray) -> np.ndarray:
        return self.kernel.matrix(self.x, row[None], aa=self._squares())[:, 0]

    def _times(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """K's columns ``at`` times weights, some at a time."""
        out, step, squares = np.zeros(len(self.x)), max(1, AT_ONCE // len(self.x)), self._squares()
        for i in range(0, len(at), step):
            p = at[i : i + step]
            out += self.kernel.matrix(self.x, self.x[p], aa=squares, bb=squares[p]) @ weights[i : i + step]
        return out

    def _move(self, a: np.ndarray, new: int, scale: float, k_old: np.ndarray | None, k_new: np.ndarray) -> None:
        """Weights ``a`` and their ``f`` after slot ``new`` has been given another vector (``k_old``, ``k_new``: kernel values of the one before and of this one).

        All weights were scaled, those between the bounds then moved by the same amount (``shift``), and few moved otherwise. So f is scaled, gets that
        amount of K times the set of these, and columns of the few. Where most moved otherwise, and after every ``ANEW`` moves, f is summed anew.
        """
        self._moves += 1
        gone = self.alpha[new]
        moved = a - scale * self.alpha
        moved[new] = 0.0
        free = (a > 0) & (a < self.c - EPS)
        free[new] = False
        shift = float(np.median(moved[free])) if free.any() else 0.0
        others = np.abs(moved) > ROUNDING
        use = abs(shift) > ROUNDING and others.sum() > FEW
        if self._open is not None:  # the slot's vector leaves the set
            held, u = self._open
            if held[new]:
                held[new] = False
                u -= k_old
            u[new] = k_new[held].sum()
        if use:
            held, u = self._open if self._open is not None else (np.zeros(len(a), bool), np.zeros(len(a)))
            turn = np.flatnonzero(held != free)
            if self._moves % ANEW == 0 or len(turn) > len(a) // 2:
                u, turn = self._times(at := np.flatnonzero(free), np.ones(len(at))), turn[:0]
            self._open = free, u + self._times(turn, np.where(free[turn], 1.0, -1.0))
            moved = moved - shift * free
            others = np.abs(moved) > ROUNDING
        f = scale * (self.f - gone * k_old if gone else self.f)
        if self._moves % ANEW == 0 or others.sum() > len(a) // 2:
            live = np.flatnonzero(a > 0)
            f = self._times(live, a[live])
        else:
            f = f + self._times(at := np.flatnonzero(others), moved[at]) + a[new] * k_new
            if use:
                f += shift * self._open[1]
            f[new] = k_new @ a
        self.alpha[:], self.f[:] = a, f

    def to_bytes(self) -> bytes:
        """Doubles: number of vectors, C, capacity, weights, f, vectors."""
        return np.concatenate([[len(self.alpha), self.c, self.capacity], self.alpha, self.f, self.x.ravel()]).astype("<f8").tobytes()

    @staticmethod
    def from_bytes(kernel: Kernel, data: bytes, evict: str = "redistribute") -> Description:
        v = np.frombuffer(data, "<f8")
        n = int(v[0])
        x = v[3 + 2 * n :].reshape(n, -1).copy()
        d = Description(kernel, float(v[1]), x, v[3 : 3 + n].copy(), v[3 + n : 3 + 2 * n].copy(), kernel.diag(x), capacity=int(v[2]), evict=evict)
        d._refresh()
        return d


def _open_pair(g: np.ndarray, up: np.ndarray, down: np.ndarray, stuck: set) -> tuple[int, int]:
    i, j = int(up[np.argmax(g[up])]), int(down[np.argmin(g[down])])
    if (i, j) not in stuck:
        return i, j
    for i in up[np.argsort(-g[up], kind="stable")]:
        for j in down[np.argsort(g[down], kind="stable")]:
            if (int(i), int(j)) not in stuck:
                return int(i), int(j)
    return -1, -1


def fit_scenarios(train: DataFrame, kernel: Kernel, nu: float = 0.1, max_iter: int = 1000, tol: float = 1e-3, by: str = "scenario_id", order: str = "vec_id", x: str = "x") -> DataFrame:
    """Support vectors and model numbers per scenario (``train``: key, order column, vector). A failed fit becomes a row with ``error``."""
    schema = f"{by} string, c double, r2 double, center_norm_sq double, tier int, iterations int, gap double, sv_idx int, alpha double, x array<double>, error string"

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(rows.sort_values(order)[x].to_list()) if len(rows) else np.zeros((0, 1))
        try:
            d = Description.fit(m, kernel, box_from_nu(len(m), nu), max_iter, tol)
        except ValueError as e:
            return pd.DataFrame([{by: key[0], "error": str(e)}], columns=[c.split()[0] for c in schema.split(", ")])
        n = len(d.alpha)
        return pd.DataFrame({by: [key[0]] * n, "c": d.c, "r2": d.r2, "center_norm_sq": d.norm2, "tier": d.tier, "iterations": d.iterations, "gap": d.gap, "sv_idx": np.arange(n), "alpha": d.alpha, "x": list(d.x), "error": None})

    return dealt(train.select(train[by].cast("string").alias(by), order, x), by).groupBy(by).applyInPandas(fit, schema)


RUN = (
    "kind string, stream_pos long, decision int, score double, y_true int, r_trace double, latency_s double, r_pretrain double, r_final double, "
    "sv_idx int, alpha double, x array<double>, c double, r2 double, center_norm_sq double, n_warmup long, buffer_size long"
)


def replay_run(stream: DataFrame, train: DataFrame, kernel: Kernel, nu: float = 0.1, rho: tuple[float, float] | None = (0.5, 1.5), warmup_share: float = 0.10, cap: int = 5000, inner_iter: int = 10, by: str = "scenario_id", max_iter: int = 1000, tol: float = 1e-3) -> DataFrame:
    """Fit on each scenario's training rows and decide its stream in order. ``stream``: key, stream_pos, y_true, x.

    Rows of two kinds: ``step``, a decision with the time it took, and ``vector``, a vector of the model as the stream leaves it. Both
    repeat the run's constants. A scenario without two training rows, or without a stream, has none.
    """
    out = f"{by} string, {RUN}"
    columns = [c.split()[0] for c in out.split(", ")]

    def run(key: tuple, fit_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if len(fit_rows) < 2 or not len(rows):
            return pd.DataFrame(columns=columns)
        rows = rows.sort_values("stream_pos")
        policy = Policy.start(np.stack(fit_rows.sort_values("vec_id")["x"].to_list()), kernel, nu, rho, int((rows["y_true"] == 0).sum()), len(rows), warmup_share, cap, inner_iter, max_iter, tol)
        got = []
        for v in rows["x"]:
            row = np.asarray(v, float)
            start = time.perf_counter()
            code = policy.act(row)
            took = time.perf_counter() - start
            got.append((code, *policy.state(row), took))
        steps = pd.DataFrame(got, columns=["decision", "score", "r_trace", "latency_s"]).assign(kind="step", x=None, stream_pos=rows["stream_pos"].to_numpy(), y_true=rows["y_true"].to_numpy())
        m = policy.model
        vectors = pd.DataFrame({"kind": "vector", "sv_idx": np.arange(len(m.alpha)), "alpha": m.alpha, "x": list(m.x)})
        res = pd.concat([steps, vectors], ignore_index=True)
        res = res.assign(**{by: key[0], "r_pretrain": policy.r_pretrain, "r_final": math.sqrt(max(m.r2, 0)), "c": m.c, "r2": m.r2, "center_norm_sq": m.norm2, "n_warmup": policy.warmup, "buffer_size": m.capacity})
        for name in ("stream_pos", "decision", "y_true", "sv_idx"):
            res[name] = res[name].astype("Int64")
        return res[columns]

    # fresh attributes: both sides may come from one table, whose columns a cogroup would confuse
    return dealt(fresh(train), by).groupBy(by).cogroup(dealt(fresh(stream), by).groupBy(by)).applyInPandas(run, out)


def replay(stream: DataFrame, train: DataFrame, kernel: Kernel, nu: float = 0.1, rho: tuple[float, float] | None = (0.5, 1.5), warmup_share: float = 0.10, cap: int = 5000, inner_iter: int = 10, by: str = "scenario_id") -> DataFrame:
    """The decisions of ``replay_run``."""
    steps = replay_run(stream, train, kernel, nu, rho, warmup_share, cap, inner_iter, by).filter("kind = 'step'")
    return steps.select(by, "stream_pos", "decision", "score", "y_true", "r_trace", "r_pretrain")


def fresh(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def dealt(df: DataFrame, by: str) -> DataFrame:
    """Rows by scenario in as many parts as a shuffle has: small in bytes but long to compute, they are not to be put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


@dataclass
class Policy:
    """Skip, adapt or report: two frozen radii around the trained description, or one moving radius when ``rho`` is None."""

    model: Description
    rho: tuple[float, float] | None
    warmup: int
    inner_iter: int
    r_pretrain: float
    seen: int = 0
    tol: float = 1e-3

    @staticmethod
    def start(train: np.ndarray, kernel: Kernel, nu: float, rho: tuple[float, float] | None, n_normal: int, n_stream: int, share: float, cap: int, inner_iter: int, max_iter: int = 1000, tol: float = 1e-3) -> Policy:
        c = box_from_nu(len(train), nu)
        m = Description.fit(train, kernel, c, max_iter, tol).bounded(buffer_size(len(train), n_stream, c, cap))
        return Policy(m, rho, warmup_length(n_normal, share), inner_iter, math.sqrt(max(m.r2, 0)), tol=tol)

    def act(self, row: np.ndarray) -> int:
        """The decision by the model as it was, and what follows from it; this is what latency measures."""
        d2 = float(self.model.d2(row)[0])
        if self.seen < self.warmup:
            code = 1
        elif self.rho is None:
            code = 1 if self.model.r2 - d2 >= 0 else 2
        else:
            inner, outer = (p * self.r_pretrain for p in self.rho)
            code = 0 if d2 < inner**2 else 2 if d2 > outer**2 else 1
        if code == 1:
            self.model.update(row, self.inner_iter, self.tol)
        self.seen += 1
        return code

    def step(self, row: np.ndarray) -> tuple[int, float, float]:
        """The decision by the model as it was; score and radius by the model as it is after."""
        return self.act(row), *self.state(row)

    def state(self, row: np.ndarray) -> tuple[float, float]:
        return float(self.model.r2 - self.model.d2(row)[0]), math.sqrt(max(self.model.r2, 0))


def support_vectors(fitted: DataFrame) -> DataFrame:
    return fitted.filter("error is null").select("scenario_id", "sv_idx", "alpha", "x")


def model_rows(fitted: DataFrame, kernel: Kernel, by: str = "scenario_id") -> DataFrame:
    agg = fitted.groupBy(by).agg(*[F.first(c).alias(c) for c in ("c", "r2", "center_norm_sq", "tier", "iterations", "gap", "error")], F.count("sv_idx").cast("int").alias("n_sv"))
    return agg.select(by, F.lit(kernel.name).alias("kernel"), F.lit(kernel.gamma).alias("gamma"), F.lit(kernel.coef0).alias("coef0"), F.lit(kernel.degree).alias("degree"), "c", "r2", "center_norm_sq", "n_sv", "tier", "iterations", "gap", "error")
