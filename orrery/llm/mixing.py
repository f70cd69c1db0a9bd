"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled (hash) order, gone through up to ``REPEATS`` times. A copy's virtual finish
time is its source's words up to its end divided by the source's target; all copies are range-sorted by it, and the mix is cut where
the running total of words would pass the budget (ties in time go by source, null last).

Running totals never gather a source: documents are dealt by (source, first ``RUN_DIGITS`` hex digits of the hash), each such run is summed,
and only the sums (4,096 a source) are accumulated; the global total likewise, by the ranges of the sort.

Results in the odd cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0
take 0 words; a source of size 0 has target 0; rows of one id, null ids too, share a hash and follow each other by size, then by the hash of their text, so
that reruns take the same (repeated rows each count); an empty table gives no rows; other columns are not read by ``plan_mix`` and pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.storage import discard, stored

REPEATS = 3
RUN_DIGITS = 3
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, budget_share: float = 1.0, most: int = REPEATS) -> DataFrame:
    """``source_key, source_size`` to ``target``: shares by weight 1, 2, 3, ... of the budget, none above ``most`` times its size.

    The level at which capped sources stop is found in one ordered pass over the sources (a row each): with sources sorted by
    cap / weight, the first one whose level, were it and all after it uncapped, stays below its own cap sets the level for all.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source_key").isNull(), "source_key")) - 1
    s = sizes.withColumn("w", (rank % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source_key").isNull(), "source_key")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double") * budget_share)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything))
    return s.select("source_key", "source_size", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


_TIME = ("__finish", "__null", "__source")


def _queued(rows: DataFrame, budget_share: float, most: int, seed: str) -> DataFrame:
    """Rows with ``__id, __source, __size`` (and ``__tie``, which orders rows equal in these) gain size and target of their source, and ``__before``: words of their queue ahead of them."""
    key = F.md5(F.concat(F.coalesce(F.col("__id").cast("string"), F.lit("")), F.lit("#" + seed)).cast("binary"))
    rows = rows.withColumn("__key", key).withColumn("__run", F.substring("__key", 1, RUN_DIGITS))
    runs = rows.groupBy("__source", "__run").agg(F.sum("__size").alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy("__source").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__offset", F.coalesce(ahead, F.lit(0))).drop("__n")
    goal = targets(rows.groupBy(F.col("__source").alias("source_key")).agg(F.sum("__size").alias("source_size")), budget_share, most)
    runs = runs.join(goal, F.col("__source").eqNullSafe(F.col("source_key")), "left").drop("source_key")
    runs = runs.withColumnsRenamed({"__source": "__s", "__run": "__r"})
    tie = ["__tie"] if "__tie" in rows.columns else []
    order = Window.partitionBy("__source", "__run").orderBy("__key", "__size", *tie).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__before", F.coalesce(F.sum("__size").over(order), F.lit(0)))
    q = local.join(runs, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__run") == F.col("__r")))
    return q.withColumn("__before", F.col("__offset") + F.col("__before")).drop("__s", "__r", "__key", "__run", "__offset")


def _finish(p: Column) -> Column:
    """Virtual finish time of a document's copy in pass p: words of its source up to its end, over the source's target."""
    return (p * F.col("source_size") + F.col("__before") + F.col("__size")).cast("double") / F.col("target")


def _copies(q: DataFrame, most: int) -> DataFrame:
    """A row for every copy that can be taken: its finish time, source and size."""
    live = q.filter((F.col("__size") > 0) & (F.col("target") > 0)).withColumn("__pass", F.explode(F.array(*[F.lit(p) for p in range(most)])))
    return live.select(_finish(F.col("__pass")).alias("__finish"), F.col("__source").isNull().alias("__null"), "__source", "__size")


def _cut(q: DataFrame, most: int, budget_share: float) -> DataFrame:
    """The last copy, in the global order of finish times, with which the running total stays within the budget: one row, or none.

    Copies are sorted by ranges and stored with their range's number; sums of whole ranges (a row each) tell the range in which
    the budget ends, and only that one is read again in order. Within a source finish times differ, so time and source name a copy.
    """
    copies = _copies(q, most)
    ranged = copies.repartitionByRange(*[F.col(c) for c in _TIME]).sortWithinPartitions(*_TIME).withColumn("__range", F.spark_partition_id())
    queue = stored(ranged, "queue")
    # ranges number themselves in order; what is left of the budget as each begins
    sums = queue.groupBy("__range").agg(F.sum("__size").alias("__n"), F.max(F.struct(*_TIME)).alias("__max"))
    budget = q.agg((F.sum("__size") * F.lit(float(budget_share))).alias("__budget"))
    up_to = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("__range", "__max", up_to.alias("__start")).join(F.broadcast(budget))
    last = starts.filter(F.col("__start") < F.col("__budget")).agg(F.max_by(F.struct("__range", "__start", "__budget"), "__range").alias("r")).select("r.*")
    inside = queue.join(F.broadcast(last), "__range")
    total = F.col("__start") + F.sum("__size").over(Window.partitionBy("__range").orderBy(*_TIME))
    kept = inside.withColumn("__total", total).filter(F.col("__total") <= F.col("__budget")).agg(F.max(F.struct(*_TIME)).alias("c"))
    # if that range's first copy is already too much, the cut is the end of the ranges before it
    whole = starts.join(F.broadcast(last.select(F.col("__range").alias("__last"))), F.col("__range") < F.col("__last")).agg(F.max("__max").alias("c"))
    return kept.union(whole).agg(F.max("c").alias("__cut"))


def _taken(q: DataFrame, most: int, budget_share: float) -> DataFrame:
    """``__copies`` of each row: those at or before the cut."""
    at = lambda p: F.struct(_finish(F.lit(p)).alias("__finish"), F.col("__source").isNull().alias("__null"), F.col("__source").alias("__source"))
    n = sum(F.when((F.col("__size") > 0) & (F.col("target") > 0), (at(p) <= F.col("__cut")).cast("int")).otherwise(0) for p in range(most))
    cut = stored(_cut(q, most, budget_share), "cut")  # one row
    return q.join(F.broadcast(cut)).withColumn("__copies", F.coalesce(n, F.lit(0))).drop("__cut")


def plan_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", budget_share: float = 1.0, most: int = REPEATS, seed: str = SEED) -> DataFrame:
    """Per document: key, size, source_size, target, taken (words, repeats counted), finish_time of the first copy."""
    rows = docs.select(F.col(key).alias("__id"), F.col(source).alias("__source"), word_count(F.col(text)).alias("__size"))
    q = _taken(stored(_queued(rows, budget_share, most, seed), "queued"), most, budget_share)
    time = F.when(F.col("target") > 0, _finish(F.lit(0)))
    return q.select(F.col("__id").alias(key), F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).cast("long").alias("taken"), time.alias("finish_time"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", budget_share: float = 1.0, most: int = REPEATS, seed: str = SEED, ordered: bool = True) -> DataFrame:
    """The mixed rows: whole documents, repeated as often as taken, sorted by ranges of virtual finish time unless not ``ordered``."""
    narrow = docs.select(F.col(key).alias("__id"), F.col(source).alias("__source"), word_count(F.col(text)).alias("__size"))
    q = stored(_queued(narrow, budget_share, most, seed), "queued")
    cut = stored(_cut(q, most, budget_share), "cut")
    discard(q)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    wide = _queued(docs.select(F.col(key).alias("__id"), F.col(source).alias("__source"), word_count(F.col(text)).alias("__size"), F.xxhash64(text).alias("__tie"), row.alias("__row")), budget_share, most, seed)
    at = F.struct(_finish(F.col("__pass")).alias("__finish"), F.col("__source").isNull().alias("__null"), F.col("__source").alias("__source"))
    live = wide.filter((F.col("__size") > 0) & (F.col("target") > 0)).join(F.broadcast(cut))
    # passes are tested before rows are repeated, so that a row is copied only as often as it is taken
    passes = F.filter(F.array(*[F.lit(p) for p in range(most)]), lambda p: F.struct(_finish(p).alias("__finish"), F.col("__source").isNull().alias("__null"), F.col("__source").alias("__source")) <= F.col("__cut"))
    q = live.withColumn("__pass", F.explode(passes)).withColumn("__at", at)
    if ordered:
        q = q.repartitionByRange("__at").sortWithinPartitions("__at")
    return q.select("__row.*")
