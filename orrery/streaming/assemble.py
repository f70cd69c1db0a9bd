"""Windows of a stream of samples: chunks of any length, in any order, become windows with the tail kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "scenario_id string, stream_pos long, y_true int, x array<double>"


class Assembler(StatefulProcessor):
    """One stream's samples since its last whole window. Chunks that come before their turn wait; one that comes again is passed over."""

    def __init__(self, window: int, stride: int):
        self.window, self.stride = window, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", "next long, windows long, skip long, tail array<double>")
        self.early = handle.getMapState("early", "chunk_no long", "y int, data array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        at, count, skip, tail = self.state.get() if self.state.exists() else (0, 0, 0, [])
        new: dict[int, tuple] = {}
        for b in rows:
            for no, y, data in zip(b["chunk_no"], b["y_true"], b["data"]):
                if no >= at:
                    new.setdefault(int(no), (int(y), [float(v) for v in (data if data is not None else [])]))
        waiting = {k[0] for k in self.early.keys()}
        held, out = np.asarray(tail, float), []
        while at in new or at in waiting:
            y, data = new.pop(at) if at in new else self.early.getValue((at,))
            if at in waiting:
                self.early.removeKey((at,))
                waiting.discard(at)
            held = np.r_[held, np.asarray(data, float)]
            cut = min(skip, len(held))
            held, skip = held[cut:], skip - cut
            while len(held) >= self.window:
                out.append((key[0], count, y, held[: self.window].tolist()))  # labelled by the chunk that completes it
                count += 1
                cut = min(self.stride, len(held))
                held, skip = held[cut:], self.stride - cut
            at += 1
        for no, v in new.items():
            if no not in waiting:
                self.early.updateValue((no,), v)
        self.state.update((at, count, skip, held.tolist()))
        yield pd.DataFrame(out, columns=["scenario_id", "stream_pos", "y_true", "x"])

    def close(self) -> None:
        pass


def window_stream(samples: DataFrame, window: int, stride: int | None = None) -> DataFrame:
    """``samples``: scenario_id, chunk_no (0, 1, ...), y_true, data. Windows as ``windows.sliding_windows`` cuts them of the whole, in stream order.

    State is less than a window of samples a stream, and the chunks that wait for one before them.
    """
    return samples.groupBy("scenario_id").transformWithStateInPandas(Assembler(window, stride or window), OUT, "Append", "None")
