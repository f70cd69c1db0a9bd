"""Kernel values of all pairs of rows, as cells of a grid.

Both sides are dealt into groups of about ``CELL_ROWS`` rows; a task gets a group of each and makes their kernel values as one matrix product, a strip at a
time. A row travels once for each group of the other side, never once a pair, and sums are taken where the values are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.functions.kernels import Kernel
from orrery.operators.ranks import positions
from orrery.operators.svdd import fresh

CELL_ROWS, STRIP = 4096, 512


def _matrix(t: pa.Table) -> np.ndarray:
    return np.array(t.column("x").to_pylist(), np.float64).reshape(t.num_rows, -1)


def _grid(a: DataFrame, b: DataFrame, key: str, x: str, cell: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, x) of both sides with the cells they belong to, ``g`` and ``h``."""
    n, m = (max(1, -(-df.count() // cell)) for df in (a, b))
    deal = lambda df, k: df.select(F.col(key).alias("id"), F.col(x).cast("array<double>").alias("x"), (F.monotonically_increasing_id() % k).cast("int").alias("_own"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = deal(a, n).select("id", "x", F.col("_own").alias("g"), every(m).alias("h"))
    return fresh(left), fresh(deal(b, m).select("id", "x", every(n).alias("g"), F.col("_own").alias("h")))


def _strips(left: pa.Table, right: pa.Table, kernel: Kernel) -> Iterator[tuple[int, np.ndarray]]:
    if left.num_rows and right.num_rows:
        a, b = _matrix(left), _matrix(right)
        for s in range(0, len(a), STRIP):
            yield s, kernel.matrix(a[s : s + STRIP], b)


def kernel_pairs(a: DataFrame, b: DataFrame, kernel: Kernel, key: str = "vec_id", x: str = "x", cell: int = CELL_ROWS) -> DataFrame:
    """``i, j, k`` of every pair."""
    left, right = _grid(a, b, key, x, cell)
    kinds = (dict(a.dtypes)[key], dict(b.dtypes)[key])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j = left.column("id").combine_chunks(), right.column("id").combine_chunks()
        for s, k in _strips(left, right, kernel):
            at = np.repeat(np.arange(s, s + len(k)), k.shape[1])
            yield pa.RecordBatch.from_arrays([i.take(pa.array(at)), j.take(pa.array(np.tile(np.arange(k.shape[1]), len(k)))), pa.array(k.ravel())], ["i", "j", "k"])

    def table(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(run(key, left, right))
        return pa.Table.from_batches(out) if out else pa.table({"i": left.column("id").slice(0, 0), "j": right.column("id").slice(0, 0), "k": pa.array([], pa.float64())})

    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(table, f"i {kinds[0]}, j {kinds[1]}, k double")


def kernel_rows(a: DataFrame, b: DataFrame, kernel: Kernel, key: str = "vec_id", x: str = "x", cell: int = CELL_ROWS) -> DataFrame:
    """For each row of ``a`` the number, sum, largest and smallest of its kernel values with all rows of ``b``: ``i, n, total, high, low``."""
    left, right = _grid(a, b, key, x, cell)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(k.sum(1), k.max(1), k.min(1)) for _, k in _strips(left, right, kernel)]
        total, high, low = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0),) * 3
        return pa.table({"i": left.column("id").slice(0, len(total)), "n": pa.array(np.full(len(total), right.num_rows, np.int64)), "total": pa.array(total), "high": pa.array(high), "low": pa.array(low)})

    cells = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(run, f"i {dict(a.dtypes)[key]}, n long, total double, high double, low double")
    return cells.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("high").alias("high"), F.min("low").alias("low"))


def weighted_sums(rows: DataFrame, vectors: DataFrame, kernel: Kernel, by: str, key: str, x: str = "x", cell: int = CELL_ROWS) -> DataFrame:
    """For each row the sum of its kernel values with its run's ``vectors`` (by, alpha, x), times their weights: ``by, key, total``.
    Rows of a run without vectors, and rows of none, have no sum."""
    dealt = [df.filter(F.col(by).isNotNull()) for df in (rows, vectors)]
    n, m = (max(1, -(-(df.groupBy(by).count().agg(F.max("count")).first()[0] or 0) // cell)) for df in dealt)
    own = lambda k: (F.monotonically_increasing_id() % k).cast("int").alias("_own")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    v = F.col(x).cast("array<double>").alias("x")
    left = dealt[0].select(by, key, v, own(n)).select(by, key, "x", F.col("_own").alias("g"), every(m).alias("h"))
    right = dealt[1].select(by, F.col("alpha").cast("double").alias("alpha"), v, own(m)).select(by, "alpha", "x", every(n).alias("g"), F.col("_own").alias("h"))
    kind = dict(rows.dtypes)

    def run(group: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a = right.column("alpha").to_numpy()
        parts = [k @ a for _, k in _strips(left, right, kernel)]
        some = left.slice(0, sum(map(len, parts)))
        return pa.table({by: some.column(by), key: some.column(key), "total": pa.array(np.concatenate([np.zeros(0), *parts]))})

    keys = [by, "g", "h"]
    cells = fresh(left).groupBy(*keys).cogroup(fresh(right).groupBy(*keys)).applyInArrow(run, f"`{by}` {kind[by]}, `{key}` {kind[key]}, total double")
    return cells.groupBy(by, key).agg(F.sum("total").alias("total"))


def rbf_sums(rows: DataFrame, by: list[str], side: str, gamma: str, x: str = "x", cell: int = CELL_ROWS) -> DataFrame:
    """For each run the summed RBF kernel values between sides: ``by, a, b, total, pairs``. ``gamma``: a column, the same over a run. Cells below
    the diagonal are those above it turned round, so half of them are made."""
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    n = max(1, -(-most // cell))
    own = rows.select(*by, F.col(side).alias("side"), F.col(gamma).cast("double").alias("gamma"), F.col(x).cast("array<double>").alias("x"), (F.monotonically_increasing_id() % n).cast("int").alias("_own"))
    left = own.select("*", F.col("_own").alias("g"), F.explode(F.sequence("_own", F.lit(n - 1))).alias("h")).drop("_own")
    right = own.select("*", F.explode(F.sequence(F.lit(0), "_own")).alias("g"), F.col("_own").alias("h")).drop("_own")
    keys = [*by, "g", "h"]
    kind = dict(rows.dtypes)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {}
        if left.num_rows and right.num_rows:
            kernel = Kernel("rbf", left.column("gamma")[0].as_py())
            p, q = (np.array(t.column("side").to_pylist(), object) for t in (left, right))
            for s, k in _strips(left, right, kernel):
                mine = p[s : s + len(k)]
                for a in np.unique(mine):
                    for b in np.unique(q):
                        part = k[mine == a][:, q == b]
                        for pair in [(a, b)] if key[-1] == key[-2] else [(a, b), (b, a)]:
                            t, c = out.get(pair, (0.0, 0))
                            out[pair] = (t + float(part.sum()), c + part.size)
        own = {f"_{n}": k for n, k in zip(by, key)}
        schema = pa.schema([*[(n, k.type) for n, k in own.items()], ("a", pa.string()), ("b", pa.string()), ("total", pa.float64()), ("pairs", pa.int64())])
        return pa.Table.from_pylist([{**{n: k.as_py() for n, k in own.items()}, "a": a, "b": b, "total": t, "pairs": c} for (a, b), (t, c) in out.items()], schema)

    cells = fresh(left).groupBy(*keys).cogroup(fresh(right).groupBy(*keys)).applyInArrow(run, ", ".join([*[f"`_{n}` {kind[n]}" for n in by], "a string", "b string", "total double", "pairs long"]))
    return cells.withColumnsRenamed({f"_{n}": n for n in by}).groupBy(*by, "a", "b").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def median_gammas(rows: DataFrame, by: list[str], key: str, x: str = "x", limit: int = 2000, seed: int = 42) -> DataFrame:
    """``by, gamma``: 1 / median squared distance over pairs of each run; 1 with fewer than two rows or a median of 0. Of a run above ``limit`` rows those
    positions (in key order) count that the seeded draw names; the estimate is defined on that sample, so a task sees at most ``limit`` rows."""
    mine = rows.select(*by, F.col(key).alias("_key"), F.col(x).cast("array<double>").alias("x"))
    sizes = mine.groupBy(*by).count().filter(F.col("count") > limit).collect()  # a row a large run
    if sizes:
        names = ", ".join([*[f"`{n}` {t}" for n, t in mine.dtypes if n in by], "_row long"])
        drawn = mine.sparkSession.createDataFrame([(*[r[n] for n in by], int(i)) for r in sizes for i in np.random.default_rng(seed).choice(r["count"], limit, replace=False)], names)
        large = mine.join(F.broadcast(drawn.select(*by).distinct()), by, "left_semi")
        numbered = positions(large, by, {"k": F.col("_key")}, "_row")
        mine = mine.join(F.broadcast(drawn.select(*by).distinct()), by, "left_anti").unionByName(numbered.join(F.broadcast(drawn), [*by, "_row"], "left_semi").drop("_row"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        m, gamma = _matrix(rows), 1.0
        if len(m) > 1:
            n2 = (m * m).sum(1)
            d2 = np.maximum(n2[:, None] + n2[None, :] - 2 * m @ m.T, 0)
            med = float(np.median(d2[np.triu_indices(len(m), 1)]))
            gamma = 1 / med if med > 0 else 1.0
        return pa.table({**{f"_{n}": pa.array([k.as_py()], k.type) for n, k in zip(by, key)}, "gamma": pa.array([gamma])})

    out = mine.groupBy(*by).applyInArrow(run, ", ".join([*[f"`_{n}` {t}" for n, t in mine.dtypes if n in by], "gamma double"]))
    return out.withColumnsRenamed({f"_{n}": n for n in by})
