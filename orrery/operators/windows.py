"""Domain split, temporal chunks, windows and the target order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.operators.ranks import positions

SPLITS = ("train", "val", "test")
RATIOS = (0.70, 0.15, 0.15)


def domain_split(signals: DataFrame, source: int, target: int, strict: bool = False) -> DataFrame:
    """Signals of the source and target domains with a ``side``. ``strict`` raises when a side is empty (one-row probes)."""
    side = F.when(F.col("domain") == source, "source").when(F.col("domain") == target, "target")
    out = signals.filter(F.col("domain").isin(source, target)).withColumn("side", side)
    if strict:
        for s in ("source", "target"):
            if not out.filter(F.col("side") == s).limit(1).count():
                raise ValueError(f"no {s} signals")
    return out


def chunk_cuts(n: Column, ratios: tuple[float, ...] = RATIOS) -> list[tuple[Column, Column]]:
    """[start, length) of each chunk: half-even rounded shares in double arithmetic; the last takes what is left."""
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    sizes = [F.bround(n.cast("double") * F.lit(float(r)), 0).cast("int") for r in ratios[:-1]]
    out, start = [], F.lit(0)
    for s in sizes:
        end = F.least(start + s, n)
        out.append((start, end - start))
        start = end
    return [*out, (start, n - start)]


def temporal_split(signals: DataFrame, ratios: tuple[float, ...] = RATIOS, names: tuple[str, ...] = SPLITS) -> DataFrame:
    """A row per signal and chunk; train keeps normal signals only."""
    cuts = chunk_cuts(F.size("data"), ratios)
    parts = F.array(*[F.struct(F.lit(n).alias("split"), s.cast("int").alias("start_idx"), k.cast("int").alias("n_samples")) for n, (s, k) in zip(names, cuts, strict=True)])
    rows = signals.withColumn("_p", F.explode(parts)).select("*", "_p.*").drop("_p")
    rows = rows.filter((F.col("split") != "train") | (F.col("is_anomaly") == 0))
    return rows.withColumn("data", F.slice("data", F.col("start_idx") + 1, F.greatest(F.col("n_samples"), F.lit(0))))


def sliding_windows(signals: DataFrame, size: int, stride: int | None = None, data: str = "data") -> DataFrame:
    """Windows ``x`` of ``size`` samples every ``stride`` (default: size); the tail goes and short signals give none."""
    step = stride or size
    n = F.floor((F.size(data) - size) / F.lit(step)).cast("int") + 1
    idx = F.when(F.size(data) >= size, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = signals.withColumn("win_idx", F.explode(idx))
    return rows.withColumn("x", F.slice(data, F.col("win_idx") * step + 1, size)).withColumn("win_idx", F.col("win_idx").cast("long")).drop(data)


def spread(windows: DataFrame) -> DataFrame:
    """Windows dealt over tasks before Python reads them: else few long signals feed few tasks, and each window goes to Python's queue with its whole signal beside it."""
    return windows.repartition("signal_id", "win_idx")


def target_order(windows: DataFrame, by: list[str]) -> DataFrame:
    """``stream_pos`` within ``by``: normals in input order, then faults grouped by type. Numbered over ranges of that order (``ranks``)."""
    kind = F.when(F.col("is_anomaly") == 1, F.col("fault_type"))
    return positions(windows, by, {"anomaly": F.col("is_anomaly"), "kind": kind, "signal": F.col("signal_id"), "win": F.col("win_idx")}, "stream_pos")


def shuffled(rows: DataFrame, by: list[str], key: list[str], seed: int = 42) -> DataFrame:
    """``shuffle_pos`` within ``by``: the order of a seeded hash of the key, then the key. The same on every run and for any partitioning."""
    h = F.md5(F.concat_ws("#", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))
    return rows.withColumn("shuffle_pos", F.row_number().over(Window.partitionBy(*by).orderBy(h, *key)).cast("long") - 1)


def order_violations(stream: DataFrame, by: list[str]) -> DataFrame:
    """Rows where the label falls or a fault block reopens; an ordered stream has none."""
    w = Window.partitionBy(*by).orderBy("stream_pos")
    prev_y, prev_f = F.lag("is_anomaly").over(w), F.lag("fault_type").over(w)
    starts = stream.withColumn("_drop", prev_y > F.col("is_anomaly")).withColumn("_new", (F.col("is_anomaly") == 1) & ((prev_f != F.col("fault_type")) | prev_y.isNull() | (prev_y == 0)))
    again = F.sum(F.col("_new").cast("int")).over(Window.partitionBy(*by, "fault_type"))
    return starts.withColumn("_n", again).filter(F.col("_drop") | (F.col("_new") & (F.col("_n") > 1))).drop("_drop", "_new", "_n")


def scenario_pairs(domains: DataFrame) -> DataFrame:
    """Ordered pairs of distinct domains; the domain list is a handful of configuration rows."""
    a, b = domains.select(F.col("domain").alias("source")), domains.select(F.col("domain").alias("target"))
    return a.join(b, F.col("source") != F.col("target"))
