"""Signals as chunks of samples, for signals larger than a row should be.

A chunk is a row (signal, ``chunk_no``, ``data``) of ``size`` samples, the last of a signal holding what is left. Windows are cut where their first
sample lies; each chunk hands as much of its start to the chunks before it as their last windows need, so no more than the borders travels beside the
chunks, and a task holds a chunk and a window at a time, whatever the length of the signal. Cuts of the temporal split are positions, not slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.operators.ranks import positions
from orrery.operators.windows import RATIOS, SPLITS, chunk_cuts
from orrery.sources.signals import NORMAL_EVENTS

KEY = ["signal_id", "domain", "fault_type", "is_anomaly"]


def chunk_signals(signals: DataFrame, size: int) -> DataFrame:
    """Chunks of signals that are stored as arrays."""
    no = F.when(F.size("data") > 0, F.sequence(F.lit(0), F.floor((F.size("data") - 1) / size).cast("int")))
    return signals.select(*KEY, "data", F.explode(no).alias("chunk_no")).select(*KEY, F.col("chunk_no").cast("long").alias("chunk_no"), F.slice("data", F.col("chunk_no") * size + 1, size).alias("data"))


def chunks_from_events(events: DataFrame, size: int, domains: int = 4) -> DataFrame:
    """``signals_from_events`` as chunks: values are numbered over ranges of (ts, event_id), and only ``size`` of them are gathered at once."""
    rows = events.filter(F.col("user_id").isNotNull() & F.col("event_type").isNotNull())
    rows = rows.select((F.col("user_id") % domains).cast("int").alias("domain"), F.col("event_type").alias("channel"), "ts", "event_id", "value")
    at = positions(rows, ["domain", "channel"], {"ts": F.col("ts"), "id": F.col("event_id"), "v": F.col("value")}, "pos")
    cell = F.array_sort(F.collect_list(F.struct("pos", "value")))
    chunks = at.groupBy("domain", "channel", F.floor(F.col("pos") / size).alias("chunk_no")).agg(F.transform(cell, lambda s: s["value"]).alias("data"))
    names = [(r.domain, r.channel) for r in chunks.select("domain", "channel").distinct().orderBy("domain", "channel").collect()]  # a fixed handful
    ids = events.sparkSession.createDataFrame([(d, c, i + 1) for i, (d, c) in enumerate(names)], "domain int, channel string, signal_id long")
    normal = F.col("channel").isin(NORMAL_EVENTS)
    return chunks.join(F.broadcast(ids), ["domain", "channel"]).select("signal_id", "domain", F.when(normal, "N").otherwise(F.col("channel")).alias("fault_type"), (~normal).cast("int").alias("is_anomaly"), "chunk_no", "data")


def lengths(chunks: DataFrame) -> DataFrame:
    """``signal_id, n``."""
    return chunks.groupBy("signal_id").agg(F.sum(F.size("data").cast("long")).alias("n"))


def whole_spans(chunks: DataFrame, name: str = "target") -> DataFrame:
    return lengths(chunks).select("signal_id", F.lit(name).alias("split"), F.lit(0).cast("long").alias("start_idx"), F.col("n").alias("n_samples"))


def split_spans(chunks: DataFrame, ratios: tuple[float, ...] = RATIOS, names: tuple[str, ...] = SPLITS) -> DataFrame:
    """Positions of the temporal chunks of every signal: ``signal_id, split, start_idx, n_samples``."""
    parts = F.array(*[F.struct(F.lit(n).alias("split"), s.cast("long").alias("start_idx"), F.greatest(k, F.lit(0)).cast("long").alias("n_samples")) for n, (s, k) in zip(names, chunk_cuts(F.col("n"), ratios), strict=True)])
    return lengths(chunks).select("signal_id", F.explode(parts).alias("_p")).select("signal_id", "_p.*")


def chunk_windows(chunks: DataFrame, spans: DataFrame, size: int, window: int, stride: int | None = None) -> DataFrame:
    """Windows ``x`` of every span, numbered from its start by ``win_idx``; tails go, and short spans give none. ``size``: samples a chunk."""
    step, reach = stride or window, -(-(window - 1) // size)  # chunks that may need of this one
    owner = F.explode(F.sequence(F.greatest(F.col("chunk_no") - reach, F.lit(0).cast("long")), "chunk_no"))
    given = chunks.select(*KEY, "chunk_no", "data", owner.alias("own"))
    need = (F.col("own") + 1) * size + window - 1 - F.col("chunk_no") * size
    given = given.withColumn("data", F.slice("data", F.lit(1), F.greatest(need, F.lit(0)).cast("int"))).filter(F.size("data") > 0)
    pieces = F.array_sort(F.collect_list(F.struct("chunk_no", "data")))
    held = given.groupBy(*KEY, "own").agg(F.flatten(F.transform(pieces, lambda p: p["data"])).alias("data"), F.min("chunk_no").alias("_first")).filter("_first = own")
    at = held.join(spans, "signal_id")
    low = F.greatest(F.ceil((F.col("own") * size - F.col("start_idx")) / step), F.lit(0)).cast("long")
    high = F.least(F.floor(((F.col("own") + 1) * size - 1 - F.col("start_idx")) / step), F.floor((F.col("n_samples") - window) / step)).cast("long")
    at = at.withColumns({"_low": low, "_high": high}).filter("_low <= _high and n_samples >= " + str(window)).withColumn("win_idx", F.explode(F.sequence("_low", "_high")))
    first = (F.col("start_idx") + F.col("win_idx") * step - F.col("own") * size + 1).cast("int")
    return at.select(*KEY, "split", "win_idx", F.slice("data", first, F.lit(window)).alias("x"))
