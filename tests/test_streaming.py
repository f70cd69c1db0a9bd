import time

import numpy as np
import pytest

from orrery.functions.kernels import Kernel
from orrery.streaming.adapt import OUT, run_available, start_models

ROW = "scenario_id string, stream_pos long, y_true int, x array<double>"


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(7)
    train = spark.createDataFrame([(s, i, rng.normal(size=3).tolist()) for s in "ab" for i in range(30)], "scenario_id string, vec_id long, x array<double>")
    rows = [(s, i, int(i > 29), (rng.normal(size=3) * (1 if i < 30 else 3)).tolist()) for s in "ab" for i in range(40)]
    counts = spark.createDataFrame([(s, 30, 40) for s in "ab"], "scenario_id string, n_normal long, n_stream long")
    return start_models(train, counts, Kernel("rbf", 0.4)).cache(), rows


def put(spark, path, batches):
    for b in batches:  # a file a batch, in this order
        spark.createDataFrame(b, ROW).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def run(spark, case, tmp_path, batches, wait_ms=3_600_000, again=()):
    source, sink, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    put(spark, source, batches)
    run_available(spark, source, ROW, case[0], Kernel("rbf", 0.4), sink, ck, wait_ms=wait_ms, files=1)
    for more in again:
        time.sleep(1)
        put(spark, source, [more])
        run_available(spark, source, ROW, case[0], Kernel("rbf", 0.4), sink, ck, wait_ms=wait_ms, files=1)
    return spark.read.schema(OUT).parquet(sink).collect()


def decisions(rows):
    return {(r.scenario_id, r.stream_pos): (r.decision, round(r.score, 9), r.y_true, round(r.r_trace, 9)) for r in rows if r.missing is None}


@pytest.fixture(scope="module")
def in_order(spark, case, tmp_path_factory):
    return decisions(run(spark, case, tmp_path_factory.mktemp("s"), [case[1]]))


def test_reversed_batches_lose_nothing(spark, case, in_order, tmp_path):
    rows = sorted(case[1], key=lambda r: -r[1])
    got = run(spark, case, tmp_path, [rows[i : i + 16] for i in range(0, 80, 16)] + [rows[:10]])
    assert len(got) == 80 and decisions(got) == in_order
    assert all(r.latency_s > 0 for r in got)


def test_restart_goes_on_and_repeats_are_passed_over(spark, case, in_order, tmp_path):
    rows = case[1]
    parts = [[r for r in rows if r[1] % 3 == k] for k in (2, 0, 1)]
    got = run(spark, case, tmp_path, [parts[0] + parts[0][:5]], again=[parts[1], parts[2] + parts[0]])
    assert len(got) == 80 and decisions(got) == in_order


def test_a_gap_that_stays_is_reported(spark, case, in_order, tmp_path):
    rows = [r for r in case[1] if r[1] not in (20, 21)]
    got = run(spark, case, tmp_path, [rows], wait_ms=200, again=[[("c", 0, 0, [0.0, 0.0, 0.0])]])
    assert sorted((r.scenario_id, r.stream_pos, r.missing) for r in got if r.missing is not None) == [("a", 20, 2), ("b", 20, 2)]
    mine = decisions(got)
    assert set(mine) == {(r[0], r[1]) for r in rows}
    assert all(mine[k] == in_order[k] for k in mine if k[1] < 20)
