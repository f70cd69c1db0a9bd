import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions.cepstrum import window_features
from orrery.functions.kernels import Kernel
from orrery.operators import chunks, windows as win
from orrery.plans import experiment as ex
from orrery.plans.fixtures import signals
from orrery.sources.tables import table
from orrery.streaming import adapt

SF = "/root/testdata/sf0.001"


def as_set(df):
    return sorted((r.signal_id, r.split, r.win_idx, tuple(r.x)) for r in df.select("signal_id", "split", "win_idx", "x").collect())


@pytest.mark.parametrize("size, window, stride", [(7, 5, 3), (4, 16, 16), (50, 8, 40), (1000, 9, 1), (3, 10, 25)])
def test_windows_across_chunks_equal_those_of_arrays(spark, size, window, stride):
    lens = [0, 1, 3, 4, 45, 85, 15, 30, 57]
    rows = [(i, 0, "N", int(i % 3 == 0), [float(i * 1000 + j) for j in range(n)]) for i, n in enumerate(lens)]
    sig = spark.createDataFrame(rows, "signal_id long, domain int, fault_type string, is_anomaly int, data array<double>")
    parts = chunks.chunk_signals(sig, size).repartition(5)
    assert max(r.n for r in parts.select(F.size("data").alias("n")).collect()) <= size
    split = win.temporal_split(sig)
    want = as_set(win.sliding_windows(split, window, stride))
    got = chunks.chunk_windows(parts, chunks.split_spans(parts), size, window, stride).filter("split <> 'train' or is_anomaly = 0")
    assert as_set(got) == want
    whole = win.sliding_windows(sig.withColumn("split", F.lit("target")), window, stride)
    assert as_set(chunks.chunk_windows(parts, chunks.whole_spans(parts), size, window, stride)) == as_set(whole)


def test_events_as_chunks(spark):
    sig = signals(spark, SF)
    got = chunks.chunks_from_events(table(spark, SF, "events"), 10)
    want = {(r.signal_id, r.chunk_no): r.data for r in chunks.chunk_signals(sig, 10).collect()}
    assert {(r.signal_id, r.chunk_no): r.data for r in got.collect()} == want
    a = ex.feature_table(sig, 16, 4, (0.7, 0.15, 0.15)).drop("error")
    b = ex.feature_table(got, 16, 4, (0.7, 0.15, 0.15), chunk=10).drop("error")
    key = lambda df: sorted((r.signal_id, r.split, r.win_idx, r.domain, r.fault_type, r.prep, tuple(r.x)) for r in df.collect())
    assert key(a) == key(b) and a.count() > 50


@pytest.mark.parametrize("size", [5, 40])
def test_stream_of_samples_equals_batch(spark, tmp_path, size):
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=330), "b": rng.normal(size=100)}
    train = [(s, i, rng.normal(size=16).tolist()) for s in data for i in range(20)]
    t = window_features(spark.createDataFrame(train, "scenario_id string, vec_id long, x array<double>"), 4).select("scenario_id", "vec_id", F.col("features").cast("array<double>").alias("x"))
    models = adapt.start_models(t, spark.createDataFrame([(s, len(v) // 16, len(v) // 16) for s, v in data.items()], "scenario_id string, n_normal long, n_stream long"), Kernel()).cache()
    source, sink, plain_in, plain_out = (str(tmp_path / n) for n in ("in", "out", "w", "w_out"))
    schema = "scenario_id string, chunk_no long, y_true int, data array<double>"
    rows = [(s, k, 0, v[k * size : (k + 1) * size].tolist()) for s, v in data.items() for k in range(-(-len(v) // size))]
    for part in (rows[len(rows) // 2 :], rows[: len(rows) // 2]):  # the later half first
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    adapt.run_samples(spark, source, schema, models, Kernel(), 16, 4, sink, str(tmp_path / "ck"), files=1)
    w = [(s, k, 0, v[k * 16 : (k + 1) * 16].tolist()) for s, v in data.items() for k in range(len(v) // 16)]
    f = window_features(spark.createDataFrame(w, "scenario_id string, stream_pos long, y_true int, x array<double>"), 4)
    f.select("scenario_id", "stream_pos", "y_true", F.col("features").cast("array<double>").alias("x")).coalesce(1).write.parquet(plain_in)
    adapt.run_available(spark, plain_in, "scenario_id string, stream_pos long, y_true int, x array<double>", models, Kernel(), plain_out, str(tmp_path / "ck2"))
    read = lambda p: sorted((r.scenario_id, r.stream_pos, r.decision, round(r.score, 9)) for r in spark.read.schema(adapt.OUT).parquet(p).collect())
    assert read(sink) == read(plain_out) and len(read(sink)) == 330 // 16 + 100 // 16
