"""Plot-data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from orrery.operators.ranks import with_percentiles


def polar_bounds(scored: DataFrame, by: list[str], rho: tuple[float, float] | None = None) -> DataFrame:
    """Inner and outer radius, plot limit and number of clipped faults per run. Without ``rho`` the radii are the 50th and
    95th percentile of source_val, or of source_train where there is none."""
    d, g = F.col("d"), F.col("grp")
    b = scored.groupBy(*by).agg(F.max("r").alias("r"), F.max(F.when(g != "target_fault", d)).alias("_m"))
    if rho is None:
        for i, name in enumerate(("source_val", "source_train")):
            b = with_percentiles(b, scored.filter(g == name), by, d, {f"_in{i}": 0.5, f"_out{i}": 0.95})
        b = b.withColumns({"r_inner": F.coalesce("_in0", "_in1"), "r_outer": F.coalesce("_out0", "_out1")})
    else:
        b = b.withColumns({"r_inner": F.col("r") * rho[0], "r_outer": F.col("r") * rho[1]})
    b = b.select(*by, "r", "r_inner", "r_outer", (F.greatest("r", "r_outer", "_m") * 1.3).alias("r_max"))
    faults = scored.filter(g == "target_fault").select(*by, "d").join(b.select(*by, "r_max"), by)
    n = faults.groupBy(*by).agg(F.sum((F.col("d") > F.col("r_max")).cast("long")).alias("n_clipped"))
    return b.join(n, by, "left").withColumn("n_clipped", F.coalesce("n_clipped", F.lit(0)))


def polar_points(scored: DataFrame, by: list[str], key: str, per_group: int = 500) -> DataFrame:
    """At most ``per_group`` points of each run and group, chosen and turned by the MD5 of their key."""
    h = F.md5(F.col(key).cast("string").cast("binary"))
    turn = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0 * 6.283185307179586
    w = Window.partitionBy(*by, "grp").orderBy("_h", key)
    rows = scored.withColumn("_h", h).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_group)
    return rows.select(*by, "grp", key, (F.col("d") * F.cos(turn)).alias("px"), (F.col("d") * F.sin(turn)).alias("py"))


def r_trace_panel(stream: DataFrame, by: list[str], warmup_share: float = 0.10) -> DataFrame:
    p, y = F.col("stream_pos"), F.col("y_true")
    return stream.groupBy(*by).agg(
        F.min(F.when(y == 1, p)).alias("first_fault"), F.max(F.when(y == 1, p)).alias("last_fault"),
        F.floor(F.sum((y == 0).cast("int")) * F.lit(warmup_share)).cast("long").alias("warmup"),
        F.sum(((F.col("decision") == 1) & (y == 0)).cast("long")).alias("adapted_normal"), F.sum(((F.col("decision") == 1) & (y == 1)).cast("long")).alias("adapted_fault"),
        F.min("r_trace").alias("r_min"), F.max("r_trace").alias("r_max"),
    )


def adapted_points(stream: DataFrame) -> DataFrame:
    return stream.filter("decision = 1").withColumn("kind", F.when(F.col("y_true") == 0, "adapted_normal").otherwise("adapted_fault"))
