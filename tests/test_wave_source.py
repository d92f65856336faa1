"""The WAVE data source: ranges, pushed-down filters, kinds of samples, and the writer's commit."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplefield.sources import files, wave


def test_ranges_and_filters(spark, tmp_path):
    samples = np.arange(-100, 100).reshape(100, 2)
    (tmp_path / "a.wav").write_bytes(files.wave_bytes(samples, 8000))
    (tmp_path / "b.wav").write_bytes(files.wave_bytes(samples[:10], 16000))
    df = wave.read_clips(spark, str(tmp_path), 16)
    assert df.rdd.getNumPartitions() == 7  # the last four frames of one file share a task with the ten of the other
    got = {(os.path.basename(r.path), r.sample_rate, r.ch, r.idx): r.v for r in df.collect()}
    assert got == {(n, rate, c, i): float(samples[i, c]) for n, rate, k in (("a.wav", 8000, 100), ("b.wav", 16000, 10)) for i in range(k) for c in (0, 1)}
    some = df.where((F.col("ch") == 1) & (F.col("idx") >= 20) & (F.col("idx") < 40) & (F.col("v") > -50))
    assert some.rdd.getNumPartitions() == 2  # frames 20 to 39 in ranges of 16; the short file has none
    assert sorted(r.idx for r in some.collect()) == [i for i in range(20, 40) if samples[i, 1] > -50]
    assert df.where("ch = 5").count() == 0


@pytest.mark.parametrize("tag,bits,kind", [(1, 8, "u1"), (1, 32, "<i4"), (3, 32, "<f4"), (3, 64, "<f8")])
def test_kinds(spark, tmp_path, tag, bits, kind):
    x = np.arange(5).astype(kind)
    raw = files.wave_bytes(np.zeros((1, 1)), 8000)
    width = bits // 8
    import struct

    head = raw[:20] + struct.pack("<HHIIHH", tag, 1, 8000, 8000 * width, width, bits) + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(x.tobytes())) + x.tobytes()
    (tmp_path / "x.wav").write_bytes(head)
    assert [r.v for r in wave.read_clips(spark, str(tmp_path), 2).orderBy("idx").collect()] == x.astype(float).tolist()
    (tmp_path / "y.wav").write_bytes(b"not one")
    with pytest.raises(Exception, match="no RIFF"):
        wave.read_clips(spark, str(tmp_path)).count()


def test_writer_leaves_only_what_is_committed(spark, tmp_path):
    rng = np.random.default_rng(0)
    clips = {k: rng.normal(size=n) for k, n in ((1, 1), (2, 30), (3, 500))}
    df = spark.createDataFrame([(k, 0, i, float(v)) for k, x in clips.items() for i, v in enumerate(x)], "clip_id long, ch int, idx long, v double").repartition(5)
    wave.write_clips(df, str(tmp_path), 22050)
    assert sorted(os.listdir(tmp_path)) == ["clip-1.wav", "clip-2.wav", "clip-3.wav"]
    for k, x in clips.items():
        rate, v = files.parse_wave((tmp_path / f"clip-{k}.wav").read_bytes())
        assert rate == 22050 and (v[:, 0] == x).all()
    bad = df.withColumn("v", F.when(F.col("clip_id") == 3, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("v")))
    other = tmp_path / "other"
    other.mkdir()
    with pytest.raises(Exception, match="stop"):
        wave.write_clips(bad, str(other), 8000)
    assert os.listdir(other) == []


def test_table_functions_refuse_other_tables(spark):
    files.register_table_functions(spark)
    for sql in ("SELECT * FROM clip_windows(TABLE(SELECT 1 AS a), 4, 2)", "SELECT * FROM clip_windows(TABLE(SELECT 1 AS clip_id, 0 AS idx, 0D AS v), 0, 2)"):
        with pytest.raises(Exception, match="needed|positive"):
            spark.sql(sql).collect()
    got = spark.sql("SELECT * FROM clip_splits(TABLE(SELECT 'x' AS clip_id, id AS idx, cast(id AS double) AS v FROM range(5)), 3) ORDER BY segment").collect()
    assert [tuple(r) for r in got] == [("x", 0, 3, 2.0), ("x", 1, 2, 4.0)]


def test_many_short_files_share_partitions(tmp_path):
    for k in range(600):
        (tmp_path / f"{k:03}.wav").write_bytes(files.wave_bytes(np.full((50, 1), k), 8000))
    reader = wave.WaveReader(str(tmp_path), 16)
    found = reader.partitions()
    assert len(found) <= 300 and all(p.last - p.first <= 16 for r in found for p in r.parts)
    rows = [x for r in found for b in reader.read(r) for x in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
    assert sorted(rows) == [(str(tmp_path / f"{k:03}.wav"), i, float(k)) for k in range(600) for i in range(50)]
