"""Streams give what the batch operators give on the same samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplefield.operators import codec, dynamics, iir
from ripplefield.streaming import stateful

N = 240


@pytest.fixture()
def stream(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(2, N))
    for k in range(3):
        rows = [(c, 0, i, float(x[c, i])) for c in range(2) for i in range(k * 80, (k + 1) * 80)]
        if k == 2:
            rows.append((0, 0, 5, 99.0))  # late: dropped
        spark.createDataFrame(rows, "clip_id long, ch int, idx long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return x, spark.readStream.schema("clip_id long, ch int, idx long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
        return spark.table(name).orderBy("clip_id", "idx").collect()
    finally:
        q.stop()


def test_filters(spark, stream):
    x, s = stream
    sections = iir.design("butterworth", "lowpass", 3, 800.0, 8000)
    got = run(spark, stateful.stream_sections(s, sections), "sections")
    assert len(got) == 2 * N
    for c in range(2):
        y = np.array([r.v for r in got if r.clip_id == c])
        assert np.allclose(y, iir.cascade(x[c], sections)[0], atol=1e-9)


def test_follower_delay_and_residual(spark, stream):
    x, s = stream
    got = run(spark, stateful.stream_envelope(s, 8000, 5, 50), "envelope")
    assert np.allclose([r.v for r in got if r.clip_id == 1], dynamics.follow(x[1], 8000, 5, 50), atol=1e-9)
    for method in ("rms", "hybrid"):
        got = run(spark, stateful.stream_envelope(s, 8000, 5, 50, method), f"envelope_{method}")
        assert np.allclose([r.v for r in got if r.clip_id == 1], dynamics.follow(x[1], 8000, 5, 50, method), atol=1e-9)
    got = run(spark, stateful.stream_prediction_synthesis(s, [0.5, -0.25]), "synthesis")
    assert np.allclose([r.v for r in got if r.clip_id == 1], codec.lpc_synthesis(x[1], np.array([0.5, -0.25])), atol=1e-9)
    got = run(spark, stateful.stream_delay(s, 7), "delay")
    assert np.allclose([r.v for r in got if r.clip_id == 0], np.r_[np.zeros(7), x[0][:-7]])
    got = run(spark, stateful.stream_prediction_residual(s, [0.5, -0.25]), "residual")
    past = np.r_[0, 0, x[0]]
    assert np.allclose([r.v for r in got if r.clip_id == 0], x[0] - 0.5 * past[1:-1] + 0.25 * past[:-2])


def test_event_time(spark, tmp_path):
    rows = [(0, f"2024-01-01 00:00:{s:02d}", float(s)) for s in (0, 1, 2, 10, 11, 40)]
    spark.createDataFrame(rows, "clip_id long, ts string, v double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("clip_id long, ts timestamp, v double").parquet(str(tmp_path / "e"))
    q = stateful.activity_sessions(s, "5 seconds", "1 second").writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("sessions").collect()) == [2, 3]
    q = stateful.windowed_levels(s, "10 seconds", "10 seconds", "1 second").writeStream.format("memory").queryName("levels").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.n for r in spark.table("levels").collect()} == {3, 2}
