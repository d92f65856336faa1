"""Correlation by blocks and radix selection against numpy, for blocks of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplefield.operators import correlation, peaks, pitch, selection, stats
from tests.test_chunks import LENGTHS, clips, signals  # noqa: F401


def products(x, y, lag):
    terms = [x[i] * y[i + lag] for i in range(len(x)) if 0 <= i + lag < len(y)]
    return sum(terms), len(terms)


@pytest.mark.parametrize("chunk", [7, 50, 1000])
@pytest.mark.parametrize("low,high", [(0, 8), (-5, 3), (-200, 220)])
def test_lag_sums(clips, signals, chunk, low, high):  # noqa: F811
    other = clips.withColumn("v", F.col("v") * F.col("idx") + 1)
    got = {(r.clip_id, r.lag): (r.s, r.n) for r in correlation.lag_sums(clips, other, low, high, chunk=chunk).collect()}
    want = {(k, lag): products(x, x * np.arange(len(x)) + 1, lag) for k, x in signals.items() for lag in range(low, high + 1)}
    want = {k: v for k, v in want.items() if v[1]}
    assert set(got) == set(want)
    assert all(got[k][1] == n and abs(got[k][0] - s) < 1e-8 for k, (s, n) in want.items())


def test_blocks_through_spectra_and_directly():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=90), rng.normal(size=41)
    far = correlation.block_products(a, b, -120, 120)
    assert np.allclose(far, [products(a, b, m)[0] for m in range(-120, 121)])
    assert np.allclose(far[115:126], correlation.block_products(a, b, -5, 5))


@pytest.mark.parametrize("chunk", [9, 1000])
def test_differences_leave_the_end_out(clips, signals, chunk):  # noqa: F811
    got = {(r.clip_id, r.lag): r.d for r in pitch.difference_function(clips, 4, 16, chunk).collect()}
    want = {(k, lag): sum((x[i] - x[i + lag]) ** 2 for i in range(len(x) - 16)) for k, x in signals.items() if len(x) > 16 for lag in range(4, 17)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("method", ["yin", "autocorrelation"])
@pytest.mark.parametrize("chunk", [11, 1000])
def test_pitch_of_whole_clips(clips, signals, chunk, method):  # noqa: F811
    got = {r.clip_id: r.frequency for r in pitch.detect_pitch(clips, 64.0, method, 0.9, 4, 16, chunk).collect()}
    assert set(got) == set(LENGTHS)
    for k, x in signals.items():
        lag = pitch.yin(x, 4, 16, 0.9) if method == "yin" else pitch.best_lag(x, 4, 16)
        assert got[k] == (64.0 / lag if lag else None)


def test_correlation_shuffles_no_row_a_lag(clips):  # noqa: F811
    plan = stats.autocorrelation(clips, 5000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence(0, 5000" not in plan and "MapInArrow" in plan


VALUES = [0.0, -0.0, 1e-320, -1e300, 1e300, 2.5, 2.5, 2.5, -7.0, float("inf"), float("-inf"), float("nan"), 3.0]


def test_order_statistics(spark):
    rng = np.random.default_rng(4)
    groups = {"x": VALUES, None: rng.normal(size=500).tolist(), "one": [4.0], "ties": [1.5] * 300}
    rows = [(k, v) for k, x in groups.items() for v in x] + [("x", None), ("nulls", None)]
    df = spark.createDataFrame(rows, "clip_id string, v double").repartition(4)
    ranks = {f"r{j}": (lambda n, j=j: F.lit(j)) for j in (0, 3, 12, 299)}
    got = {r.clip_id: r for r in selection.order_statistics(df, F.col("v"), middle=lambda n: F.floor(n / 2), none=lambda n: F.lit(-1), **ranks).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        ordered = sorted(x, key=lambda v: (v != v, v))
        at = lambda j: ordered[j] if 0 <= j < len(ordered) else None
        want = [len(x), at(len(x) // 2), None, at(0), at(3), at(12), at(299)]
        assert str([got[k].n, got[k].middle, got[k].none, got[k].r0, got[k].r3, got[k].r12, got[k].r299]) == str([w if w != 0 else 0.0 for w in want])


def test_no_window_or_sort_by_clip(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("clip_id"), F.col("id").alias("frame"), F.rand(1).alias("x"))
    for plan in (peaks.normalize_strength(df, m)._jdf.queryExecution().optimizedPlan().toString() for m in ("median", "peak", "zscore")):
        assert "Window" not in plan and "Sort" not in plan
