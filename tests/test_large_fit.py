import numpy as np

from orrery.functions.kernels import Kernel
from orrery.operators.large_fit import best_mix, fit_large, with_weights
from orrery.operators.svdd import Description


def test_same_description_as_in_one_task(spark):
    rng = np.random.default_rng(8)
    runs = {"a": rng.normal(size=(900, 3)), "b": rng.exponential(size=(500, 5)) + 40, "c": np.repeat(rng.normal(size=(10, 3)), 30, 0)}
    rows = [(k, i, x.tolist()) for k, m in runs.items() for i, x in enumerate(m)] + [("tiny", 0, [1.0, 2.0, 3.0]), ("a", 9999, None)]
    df = spark.createDataFrame(rows, "scenario_id string, vec_id long, x array<double>").repartition(7)
    fits = fit_large(df, 0.1, 1e-4)
    assert set(fits) == set(runs)
    got = with_weights(df, fits).toPandas()
    assert got[got.scenario_id == "tiny"].alpha.isna().all()
    for k, m in runs.items():
        f = fits[k]
        one = Description.fit(m, Kernel(), 1 / (0.1 * len(m)), 200_000, 1e-5)
        dual = lambda a, x: a @ (x * x).sum(1) - (a @ x) @ (a @ x)
        mine = got[(got.scenario_id == k) & got.x.notna()].sort_values("vec_id").alpha.to_numpy()
        assert abs(mine.sum() - 1) < 1e-9 and mine.min() >= 0 and mine.max() <= f.c * (1 + 1e-9)
        best = dual(one.alpha / one.alpha.sum(), one.x)
        assert f.gap <= 1e-4 * max(1e-12, f.square - f.center @ f.center) and dual(mine, m) > best - f.gap - 1e-3 * abs(best - one.norm2)
        assert abs(np.sqrt(f.r2) - np.sqrt(one.r2)) < 2e-2 * np.sqrt(one.r2)
        d2 = ((m - f.center) ** 2).sum(1)
        assert (d2 > f.r2 * 1.01).sum() <= 0.1 * len(m) + 1e-9 <= (d2 > f.r2 * 0.99).sum()


def test_many_rows_in_many_tasks(spark):
    n, dim = 1_000_000, 3
    from pyspark.sql import functions as F

    df = spark.range(n, numPartitions=8).select(F.lit("big").alias("scenario_id"), F.array(*[F.sin(F.col("id") * (7919 + 31 * k)) * (k + 1) for k in range(dim)]).alias("x"))
    f = fit_large(df, 0.1, 1e-3)["big"]
    x = np.stack([np.sin(np.arange(n) * (7919.0 + 31 * k)) * (k + 1) for k in range(dim)], 1)
    d2 = ((x - f.center) ** 2).sum(1)
    assert f.n == n and f.rounds < 100 and abs(f.r2 - np.quantile(d2, 0.9)) < 1e-3
    # Nothing that any weights can do beats the gap: the largest tenth's mean against the weights' own.
    g = np.sort((x * x).sum(1) - 2 * x @ f.center)
    assert g[-n // 10 :].mean() - (f.square - 2 * f.center @ f.center) <= f.gap + 1e-9


def test_best_mix():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(6, 2)), rng.normal(size=6) + 2
    w = best_mix(a, b, np.eye(6)[0])
    value = lambda w: b @ w - (a.T @ w) @ (a.T @ w)
    assert all(value(w) >= value(v) - 1e-9 for v in rng.dirichlet(np.ones(6) * 0.3, 3000))
