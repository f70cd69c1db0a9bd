"""The adaptive decision as a Structured Streaming query with keyed state, whatever the order in which rows come."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orrery.functions.cepstrum import window_features
from orrery.functions.kernels import Kernel
from orrery.operators.svdd import Description, Policy, dealt, fresh
from orrery.streaming.assemble import window_stream

OUT = "scenario_id string, stream_pos long, decision int, score double, y_true int, r_trace double, latency_s double, missing long"
STATE = "model binary, seen long, next long, warmup long, r_pretrain double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAIT_MS = 3_600_000


class Adapter(StatefulProcessor):
    """One scenario's description as keyed state: begun from its fitted model, moved by its rows in the order of stream_pos.

    A row whose position is next is decided at once; one that is early waits in a map by position until the gap before it
    closes. A gap that stays open for ``wait_ms`` is given up: a row with ``missing`` positions and no decision reports it, and what waited goes on.
    """

    def __init__(self, kernel: Kernel, rho: tuple[float, float] | None, inner_iter: int, wait_ms: int = WAIT_MS):
        self.kernel, self.rho, self.inner_iter, self.wait_ms = kernel, rho, inner_iter, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("description", STATE)
        self.early = handle.getMapState("early", "pos long", "y int, x array<double>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803 - names of the interface
        r = initialState.iloc[0]
        self.state.update((bytes(r["model"]), 0, 0, int(r["warmup"]), float(r["r_pretrain"])))

    def _decide(self, key: tuple, rows: dict[int, tuple], now_ms: int, give_up: bool) -> pd.DataFrame:
        """Decide what is in order; ``rows``: new ones by position."""
        model, seen, at, warmup, r0 = self.state.get()
        p = Policy(Description.from_bytes(self.kernel, bytes(model)), self.rho, warmup, self.inner_iter, r0, seen)
        waiting = {k[0] for k in self.early.keys()}
        out: list[tuple] = []
        while True:
            if at in rows:
                y, x = rows.pop(at)
            elif at in waiting:
                y, x = self.early.getValue((at,))
            elif give_up and (ahead := min([*waiting, *rows], default=None)) is not None:
                out.append((key[0], at, None, None, None, None, None, ahead - at))
                at, give_up = ahead, False
                continue
            else:
                break
            if at in waiting:
                self.early.removeKey((at,))
                waiting.discard(at)
            row = np.asarray(x, float)
            start = time.perf_counter()
            code = p.act(row)
            took = time.perf_counter() - start
            score, r = p.state(row)
            out.append((key[0], at, code, score, None if y is None else int(y), r, took, None))
            at += 1
        for pos, (y, x) in rows.items():
            if pos not in waiting:
                self.early.updateValue((pos,), (None if y is None else int(y), [float(v) for v in x]))
                waiting.add(pos)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if waiting:
            self.handle.registerTimer(now_ms + self.wait_ms)
        if out:
            self.state.update((p.model.to_bytes(), p.seen, at, warmup, r0))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        return frame.astype({"decision": "Int32", "y_true": "Int32", "missing": "Int64", "stream_pos": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return
        at = self.state.get()[2]
        new: dict[int, tuple] = {}
        for batch in rows:
            for pos, y, x in zip(batch["stream_pos"], batch["y_true"], batch["x"]):
                if pos == pos and pos >= at:  # earlier ones are replays
                    new.setdefault(int(pos), (None if y != y else y, x))
        yield self._decide(key, new, timerValues.getCurrentProcessingTimeInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._decide(key, {}, timerValues.getCurrentProcessingTimeInMs(), True)

    def close(self) -> None:
        pass


def adapt_stream(stream: DataFrame, models: DataFrame, kernel: Kernel, rho: tuple[float, float] | None = (0.5, 1.5), inner_iter: int = 10, wait_ms: int = WAIT_MS) -> DataFrame:
    """``stream``: scenario_id, stream_pos (0, 1, ...), y_true, x. ``models``: scenario_id, model (binary), warmup, r_pretrain.

    A model is the initial state of its scenario, so it is shuffled once and never travels with rows. Rows are decided in the order of
    stream_pos across micro-batches; those that come early are held (``Adapter``), a position that comes again is passed over, and rows of
    a scenario without a model, or without a position, give nothing. State is the bounded description and what waits. ``latency_s`` is the
    time of the decision. The session needs the RocksDB state store (``PROVIDER``).
    """
    return stream.groupBy("scenario_id").transformWithStateInPandas(Adapter(kernel, rho, inner_iter, wait_ms), OUT, "Append", "ProcessingTime", initialState=models.groupBy("scenario_id"))


def start_models(train: DataFrame, counts: DataFrame, kernel: Kernel, nu: float = 0.1, rho: tuple[float, float] | None = (0.5, 1.5), share: float = 0.10, cap: int = 5000) -> DataFrame:
    """A fitted, bounded start state per scenario. ``counts``: scenario_id, n_normal, n_stream."""

    def fit(key: tuple, rows: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2 or not len(n):
            return pd.DataFrame(columns=["scenario_id", "model", "warmup", "r_pretrain"])
        p = Policy.start(np.stack(rows.sort_values("vec_id")["x"].to_list()), kernel, nu, rho, int(n["n_normal"].iloc[0]), int(n["n_stream"].iloc[0]), share, cap, 10)
        return pd.DataFrame([(key[0], p.model.to_bytes(), p.warmup, p.r_pretrain)], columns=["scenario_id", "model", "warmup", "r_pretrain"])

    return dealt(fresh(train), "scenario_id").groupBy("scenario_id").cogroup(dealt(fresh(counts), "scenario_id").groupBy("scenario_id")).applyInPandas(fit, "scenario_id string, model binary, warmup long, r_pretrain double")


def run_available(spark: SparkSession, source: str, schema: str, models: DataFrame, kernel: Kernel, sink: str, checkpoint: str, rho: tuple[float, float] | None = (0.5, 1.5), wait_ms: int = WAIT_MS, files: int = 4) -> None:
    """Decide everything in the Parquet directory ``source``, ``files`` at a time, and append it to ``sink``; restarts go on from ``checkpoint``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timers alone would keep the run going for ever; they fire with the next rows
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    q = adapt_stream(rows, models, kernel, rho, wait_ms=wait_ms).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def run_samples(spark: SparkSession, source: str, schema: str, models: DataFrame, kernel: Kernel, window: int, lifter_n: int | None, sink: str, checkpoint: str, rho: tuple[float, float] | None = (0.5, 1.5), files: int = 4) -> None:
    """As ``run_available`` for a stream of samples (``assemble.window_stream``): windows, their features and the decisions in one streaming query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = window_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source), window)
    features = window_features(rows, lifter_n).select("scenario_id", "stream_pos", "y_true", F.col("features").cast("array<double>").alias("x"))
    q = adapt_stream(features, models, kernel, rho).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
