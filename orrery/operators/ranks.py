"""Exact ranks, running sums and percentiles of runs of any size, over ranges of values.

Rows are range-partitioned by run and value and stored with the number of their range (``PIECE``), so a run spreads over as many ranges as it
needs. Sums of whole ranges are accumulated (a row for each run and range); only rows within a range are ordered by a window. A value
that repeats is counted first, so that a range can't hold more than its share of different values and no tie crosses a border.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.storage import stored

PIECE = "_piece"


def ranged(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows stored by ranges of (``by``, ``order``), with ``PIECE``."""
    return stored(rows.repartitionByRange(*[F.col(c) for c in (*by, *order)]).withColumn(PIECE, F.spark_partition_id()), "ranges")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_key_{k}"]) for k in keys])


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``b``'s other columns beside ``a``'s, nulls in the keys being equal."""
    b = b.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    return a.join(b, _same(a, b, keys), how).drop(*[f"_key_{k}" for k in keys])


def pieces(table: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """A row for each run and range: its sums, and ``<name>_ahead``, the sums of the run's ranges before it. These are as many rows as there are ranges."""
    each = table.groupBy(*by, PIECE).agg(*[c.alias(n) for n, c in sums.items()])
    ahead = Window.partitionBy(*by).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*by, PIECE, *sums, *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}_ahead") for n in sums])


def with_running(table: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows of a ``ranged`` table with ``<column>_before``: the sum over the run's rows ahead of them."""
    at = pieces(table, by, **{f"_n{i}": F.sum(c) for i, c in enumerate(columns)})
    at = at.select(*by, PIECE, *[f"_n{i}_ahead" for i in range(len(columns))])
    before = Window.partitionBy(*by, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = table.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_l{i}") for i, c in enumerate(columns)])
    out = _joined(local, at, [*by, PIECE])
    return out.select(*table.columns, *[(F.col(f"_l{i}") + F.col(f"_n{i}_ahead")).alias(f"{c}_before") for i, c in enumerate(columns)])


def with_next(table: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Rows of a ``ranged`` table of different values with the run's next value, across ranges."""
    first = table.groupBy(*by, PIECE).agg(F.min(value).alias("_first"))
    after = first.select(*by, PIECE, F.lead("_first").over(Window.partitionBy(*by).orderBy(PIECE)).alias("_after"))
    local = table.withColumn("_lead", F.lead(value).over(Window.partitionBy(*by, PIECE).orderBy(value)))
    return _joined(local, after, [*by, PIECE]).withColumn(name, F.coalesce("_lead", "_after")).drop("_lead", "_after")


def positions(rows: DataFrame, by: list[str], order: dict[str, Column], name: str) -> DataFrame:
    """Rows numbered from 0 within ``by`` in the order of the given columns."""
    keyed = rows.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order.values())], F.lit(1).cast("long").alias("_one"))
    keys = [f"_o{i}" for i in range(len(order))]
    out = with_running(ranged(keyed, by, keys), by, keys, ["_one"])
    return out.withColumn(name, F.col("_one_before")).drop(*keys, PIECE, "_one", "_one_before")


def percentiles(rows: DataFrame, by: list[str], value: Column, shares: list[float], name: str = "p") -> DataFrame:
    """``by`` and ``name``: the exact percentiles of each run (nulls left out), interpolated between the two neighbours.

    Values are counted by range; a percentile's neighbours are looked for only in the ranges that hold their ranks.
    """
    counts = rows.select(*by, value.cast("double").alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    table = ranged(counts, by, ["_v"])
    at = pieces(table, by, _n=F.sum("_c"))
    whole = at.groupBy(*by).agg(F.sum("_n").alias("_total"))
    rank = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("_total") - 1) * F.lit(q)).alias("r")) for i, q in enumerate(shares)])
    asked = whole.select(*by, F.explode(rank).alias("_w")).select(*by, F.col("_w.i").alias("_i"), F.col("_w.r").alias("_r"))
    held = _joined(at, asked, by) if by else at.crossJoin(F.broadcast(asked))  # a run's ranges with its few ranks
    held = held.filter((F.col("_n_ahead") <= F.ceil("_r")) & (F.floor("_r") < F.col("_n_ahead") + F.col("_n")))
    wanted = _joined(table, held.select(*by, PIECE).distinct(), [*by, PIECE], "left_semi")
    before = Window.partitionBy(*by, PIECE).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    local = wanted.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    found = _joined(local, held.select(*by, PIECE, "_i", "_r", "_n_ahead"), [*by, PIECE]).withColumn("_b", F.col("_b") + F.col("_n_ahead"))
    holds = lambda r: (F.col("_b") <= r) & (r < F.col("_b") + F.col("_c"))
    low, high = F.max(F.when(holds(F.floor("_r")), F.col("_v"))), F.max(F.when(holds(F.ceil("_r")), F.col("_v")))
    one = found.groupBy(*by, "_i", "_r").agg(low.alias("_lo"), high.alias("_hi"))
    one = one.withColumn("_x", F.col("_lo") + (F.col("_r") - F.floor("_r")) * (F.col("_hi") - F.col("_lo")))
    out = one.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_p"))
    return out.select(*by, F.transform("_p", lambda s: s["_x"]).alias(name))


def with_percentiles(grouped: DataFrame, rows: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """A table of runs (``by``) with a column for each named percentile of ``value``; null where a run has no value."""
    p = percentiles(rows, by, value, list(shares.values()), "_p")
    out = _joined(grouped, p, by, "left") if by else grouped.join(F.broadcast(p), how="left")
    return out.select(*grouped.columns, *[F.col("_p")[i].alias(n) for i, n in enumerate(shares)])
