"""Lifetimes of streamed state: results don't depend on the cut into batches, and silent clips leave no state."""

import datetime as dt

import numpy as np

from ripplefield.operators import dynamics
from ripplefield.streaming import timed

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_lifetime_and_late_samples(spark, tmp_path):
    schema = "clip_id string, idx long, ts timestamp, v double"
    batches = [
        [("a", 0, at(0), 1.0), ("a", 1, at(10), -2.0), ("b", 0, at(5), 3.0), (None, 0, at(6), 1.0)],
        [("a", 2, at(20), 0.5), ("a", 9, at(9), 7.0), ("b", 1, None, 9.0)],  # a sample older than the clip's last, and one without a time
        [("b", 2, at(1000), 4.0), ("b", 3, at(1001), 1.0)],
        [("b", 4, at(2000), 2.0)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    before = spark.conf.get(timed.PROVIDER[0])
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    try:
        out = timed.live_envelope(live, 64.0, 20, 100, 60.0)
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "level").load(str(tmp_path / "log")).collect()
    finally:
        spark.conf.set(timed.PROVIDER[0], before)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("idx").collect():
        got.setdefault(r.clip_id, []).append((r.idx, r.v))
    follow = lambda x: dynamics.follow(np.array(x), 64.0, 20, 100).tolist()
    want = {
        "a": list(zip([0, 1, 2], follow([1.0, -2.0, 0.5]))),
        "b": list(zip([0, 2, 3, 4], follow([3.0]) + follow([4.0, 1.0]) + follow([2.0]))),  # each silence starts afresh
        None: list(zip([0], follow([1.0]))),
    }
    assert set(got) == set(want)
    assert all([i for i, _ in got[k]] == [i for i, _ in want[k]] and np.allclose([v for _, v in got[k]], [v for _, v in want[k]]) for k in want)
    assert [r.key.clip_id for r in state] == ["b"]  # the other clips' lifetimes are over
