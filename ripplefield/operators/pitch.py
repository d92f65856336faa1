"""Pitch and harmony: lags by blocks, numpy for frames, profiles as a small table for keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplefield.functions.scales import NOTES
from ripplefield.operators import spectral
from ripplefield.operators.chunks import CHUNK, Piece, map_pieces
from ripplefield.operators.correlation import lag_sums
from ripplefield.operators.filterbanks import BROADCAST_ROWS, chromagram  # noqa: F401
from ripplefield.operators.frames import frame_arrays

# The Krumhansl profiles of major and minor keys, from the tonic.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def _range(sample_rate: float, low: float, high: float) -> tuple[int, int]:
    if not 0 < low < high:
        raise ValueError("frequencies must be ordered and positive")
    return max(1, int(sample_rate / high)), int(sample_rate / low)


def difference_function(df: DataFrame, low_lag: int, high_lag: int, chunk: int = CHUNK) -> DataFrame:
    """``(clip_id, lag, d)``: squared differences at each lag over the first n - high_lag samples."""
    return _differences(df.where("ch = 0"), low_lag, high_lag, chunk).select("clip_id", "lag", "d")


def _differences(df: DataFrame, low: int, high: int, chunk: int) -> DataFrame:
    return lag_sums(df, df, low, high, "differences", trim=high, chunk=chunk).select("clip_id", "ch", "lag", F.col("s").alias("d"))


def yin(x: np.ndarray, low: int, high: int, threshold: float) -> int | None:
    """The lag under the threshold of the normalised difference, moved to the minimum within five lags."""
    n = len(x)
    if high >= n / 2:
        return None
    d = np.zeros(high + 1)
    for lag in range(low, high + 1):
        e = x[: n - high] - x[lag : lag + n - high]
        d[lag] = e @ e
    run = np.cumsum(d)
    lags = np.arange(high + 1)
    norm = np.where(run > 0, d * lags / np.where(run > 0, run, 1), 1.0)
    under = np.flatnonzero((lags >= low) & (norm < threshold))
    if not len(under):
        return None
    a, b = max(low, under[0] - 5), min(high, under[0] + 5)
    return int(a + np.argmin(norm[a : b + 1]))


def best_lag(x: np.ndarray, low: int, high: int) -> int | None:
    """The lag of greatest raw autocorrelation; None if it isn't positive."""
    high = min(high, len(x) - 1)
    if high < low:
        return None
    r = [x[: len(x) - k] @ x[k:] for k in range(low, high + 1)]
    k = int(np.argmax(r))
    return low + k if r[k] > 0 else None


def _pitch(x, method, sample_rate, threshold, low, high):
    a, b = _range(sample_rate, low, high)
    lag = yin(x, a, b, threshold) if method == "yin" else best_lag(x, a, b)
    return sample_rate / lag if lag else None


def detect_pitch(df: DataFrame, sample_rate: float, method: str = "yin", threshold: float = 0.1, low: float = 50.0, high: float = 500.0, chunk: int = CHUNK) -> DataFrame:
    """``(clip_id, ch, frequency)`` of clips of any length; null where no period is found.

    Sums by lag come from blocks; what is chosen among is one row a lag, a number set by the parameters.
    """
    if method not in ("yin", "autocorrelation"):
        raise ValueError("method must be yin or autocorrelation")
    a, b = _range(sample_rate, low, high)
    key = F.struct("clip_id", "ch").alias("key")
    channels = df.groupBy(key).agg(F.count("*").alias("n"))
    if method == "autocorrelation":
        sums = lag_sums(df, df, a, b, chunk=chunk) if a <= b else None
        best = sums.groupBy(key).agg(F.max_by(F.struct("lag", "s"), F.struct("s", -F.col("lag"))).alias("z")) if sums is not None else None
        found = best.select("key", F.when(F.col("z.s") > 0, F.col("z.lag")).alias("lag")) if best is not None else channels.select("key", F.lit(None).cast("int").alias("lag"))
    else:
        d = _differences(df, a, b, chunk).select(key, "lag", "d")
        so_far = Window.partitionBy("key").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
        run = F.sum("d").over(so_far)
        norm = d.select("key", "lag", F.when(run > 0, F.col("d") * F.col("lag") / F.when(run > 0, run)).otherwise(F.lit(1.0)).alias("norm"))
        under = norm.groupBy("key").agg(F.min(F.when(F.col("norm") < threshold, F.col("lag"))).alias("at"))
        near = norm.join(under, "key").where(F.abs(F.col("lag") - F.col("at")) <= 5)
        least = near.groupBy("key").agg(F.min_by("lag", F.struct("norm", "lag")).alias("lag"))
        found = least.join(channels.where(F.col("n") > 2 * b), "key").select("key", "lag")
    out = channels.join(found, "key", "left")
    return out.select("key.clip_id", "key.ch", (F.lit(float(sample_rate)) / F.col("lag")).alias("frequency"))


def track_pitch(df: DataFrame, window: int, hop: int, sample_rate: float, method: str = "yin", threshold: float = 0.1, low: float = 50.0, high: float = 500.0) -> DataFrame:
    """``(clip_id, ch, frame, seconds, frequency)`` until less than half a window is left; each window is a row of its own."""
    if not 0 < hop < window:
        raise ValueError("the window must be longer than the hop")
    if method not in ("yin", "autocorrelation"):
        raise ValueError("method must be yin or autocorrelation")
    arrays = frame_arrays(df, window, hop, "none").where(F.size("w") >= window / 2)
    arrays = arrays.select(F.struct("clip_id", "ch").alias("key"), F.col("frame").alias("chunk"), F.transform("w", lambda v: v.cast("double")).alias("w"))

    def kernel(p: Piece) -> dict:
        return {"frequency": _pitch(p.arrays["w"], method, sample_rate, threshold, low, high)}

    out = map_pieces(arrays, kernel, "frequency double")
    return out.select("key.clip_id", "key.ch", F.col("chunk").alias("frame"), (F.col("chunk") * hop / float(sample_rate)).alias("seconds"), "frequency")


def mean_pitch(contour: DataFrame) -> DataFrame:
    """Mean of the voiced frames; null without any."""
    return contour.groupBy("clip_id", "ch").agg(F.avg("frequency").alias("mean_pitch"))


def voiced_frames(contour: DataFrame) -> DataFrame:
    return contour.where("frequency is not null")


def harmonic_analysis(spec: DataFrame, fundamental: float, harmonics: int, tolerance: float) -> DataFrame:
    """Greatest power within a share of each harmonic, over that of the first."""
    k = F.explode(F.sequence(F.lit(1), F.lit(harmonics))).alias("harmonic")
    s = spec.select("clip_id", "ch", "freq_hz", spectral.power().alias("p"), k)
    near = s.where(F.abs(F.col("freq_hz") - F.col("harmonic") * fundamental) <= tolerance * F.col("harmonic") * fundamental)
    top = near.groupBy("clip_id", "ch", "harmonic").agg(F.max("p").alias("p"))
    first = F.max(F.when(F.col("harmonic") == 1, F.col("p"))).over(Window.partitionBy("clip_id", "ch"))
    return top.select("clip_id", "ch", "harmonic", F.coalesce(F.try_divide(F.col("p"), first), F.lit(0.0)).alias("level"))


def harmonic_to_noise(spec: DataFrame, fundamental: float, harmonics: int, resolution: float) -> DataFrame:
    """10 log10 of the power within a bin of the harmonics over the rest."""
    k = F.round(F.col("freq_hz") / fundamental)
    near = (k >= 1) & (k <= harmonics) & (F.abs(F.col("freq_hz") - k * fundamental) <= resolution)
    p = spectral.power()
    g = spec.groupBy("clip_id", "ch").agg(F.sum(F.when(near, p).otherwise(0.0)).alias("h"), F.sum(p).alias("t"))
    ratio = F.try_divide(F.col("h"), F.col("t") - F.col("h"))
    return g.select("clip_id", "ch", F.when(F.col("t") > F.col("h"), 10 * F.log10(F.when(ratio > 0, ratio))).otherwise(F.lit(float("inf"))).alias("hnr_db"))


def estimate_key(chroma: DataFrame, compat: bool = False) -> DataFrame:
    """Key of the greatest Pearson correlation of mean chroma with 24 rotated profiles; ``(r + 1) / 2`` is its confidence.

    ``compat`` rotates the profiles the other way, as the original does.
    """
    rows = [
        (NOTES[t], mode, pc, float(profile[(pc + t) % 12 if compat else (pc - t) % 12]))
        for mode, profile in (("major", MAJOR), ("minor", MINOR))
        for t in range(12)
        for pc in range(12)
    ]
    table = F.broadcast(chroma.sparkSession.createDataFrame(rows, "tonic string, mode string, band int, weight double"))  # 288 rows
    mean = chroma.groupBy("clip_id", "band").agg(F.avg("value").alias("x"))
    r = mean.join(table, "band").groupBy("clip_id", "tonic", "mode").agg(F.corr("x", "weight").alias("r"))
    r = r.withColumn("r", F.when(F.isnan("r") | F.col("r").isNull(), F.lit(0.0)).otherwise(F.col("r")))
    best = r.groupBy("clip_id").agg(F.max_by(F.struct("tonic", "mode", "r"), F.struct(F.round("r", 12), "mode", "tonic")).alias("k"))
    return best.select("clip_id", F.col("k.tonic").alias("tonic"), F.col("k.mode").alias("mode"), ((F.col("k.r") + 1) / 2).alias("confidence"))
