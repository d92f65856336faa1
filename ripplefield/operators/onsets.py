"""Onset detection over spectra ``(clip_id, ch, frame, bin, freq_hz, re, im)``: lags per bin, sums per frame."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplefield.operators import peaks, spectral
from ripplefield.operators.chunks import settled
from ripplefield.operators.filterbanks import cqt_kernels, over_tones


def BIN() -> Window:
    """One bin over the frames."""
    return Window.partitionBy("clip_id", "ch", "bin").orderBy("frame")


METHODS = ("energy", "magnitude", "complex", "rectified")


def _series(spec: DataFrame, term: Column) -> DataFrame:
    return spec.select("clip_id", "frame", F.coalesce(term, F.lit(0.0)).alias("t")).groupBy("clip_id", "frame").agg(F.sum("t").alias("x"))


def flux(spec: DataFrame, method: str = "energy") -> DataFrame:
    """``(clip_id, frame, x)``: change of the spectrum against the frame before; 0 in the first."""
    m = spectral.magnitude()
    if method == "energy":
        d = m - F.lag(m).over(BIN())
        return _series(spec, F.greatest(d, F.lit(0.0)))
    if method == "magnitude":
        return _series(spec, F.abs(m - F.lag(m).over(BIN())))
    if method == "complex":
        dre, dim = F.col("re") - F.lag("re").over(BIN()), F.col("im") - F.lag("im").over(BIN())
        return _series(spec, F.sqrt(dre * dre + dim * dim))
    if method == "rectified":
        return flux(spec, "energy")
    raise ValueError(f"method must be one of {METHODS}")


energy_odf = flux


def adaptive_zero(series: DataFrame, median_length: int, multiplier: float) -> DataFrame:
    """Zero where a value lies below the local median times a factor."""
    med = peaks.median_filter(series.withColumn("own", F.col("x")), median_length)
    return med.select("clip_id", "frame", F.when(F.col("own") < F.col("x") * multiplier, F.lit(0.0)).otherwise(F.col("own")).alias("x"))


def princarg(angle: Column) -> Column:
    """An angle within (-pi, pi]."""
    w = F.pmod(angle + math.pi, F.lit(2 * math.pi))
    return F.when(w == 0, F.lit(math.pi)).otherwise(w - math.pi)


def magnitude_difference(spec: DataFrame) -> DataFrame:
    """Per bin, against the frame before; 0 in the first."""
    m = spectral.magnitude()
    return spec.select("clip_id", "ch", "frame", "bin", F.coalesce(m - F.lag(m).over(BIN()), F.lit(0.0)).alias("d"))


def phase_deviation(spec: DataFrame, hop: int, sample_rate: float) -> DataFrame:
    """Per bin, distance of the phase step from the one its frequency implies; 0 in the first frame."""
    phase = F.atan2("im", "re")
    step = phase - F.lag(phase).over(BIN()) - 2 * math.pi * F.col("freq_hz") * hop / sample_rate
    return spec.select("clip_id", "ch", "frame", "bin", F.coalesce(F.abs(princarg(step)), F.lit(0.0)).alias("p"))


def complex_odf(spec: DataFrame, hop: int, sample_rate: float, magnitude_weight: float = 0.7, phase_weight: float = 0.3, rectify: bool = True, compression: float | None = 100.0) -> DataFrame:
    """Weighted sum of magnitude rise and phase deviation per frame."""
    d = magnitude_difference(spec).join(phase_deviation(spec, hop, sample_rate), ["clip_id", "ch", "frame", "bin"])
    rise = F.greatest("d", F.lit(0.0)) if rectify else F.abs("d")
    x = d.groupBy("clip_id", "frame").agg((magnitude_weight * F.sum(rise) + phase_weight * F.sum("p")).alias("x"))
    return peaks.log_compress(x, compression) if compression else x


@dataclass(frozen=True)
class OnsetConfig:
    """Hop, median length and factor of the detection function, and the picker."""

    hop: int = 512
    median: int = 5
    multiplier: float = 1.5
    f_min: float = 32.7
    bins: int = 84
    picker: peaks.PeakConfig = peaks.PeakConfig()


PRESETS = {"percussive": OnsetConfig(256, 3, 2.0), "musical": OnsetConfig(512, 7, 1.2), "speech": OnsetConfig(256, 9, 1.1)}


def effective_window(sample_rate: float, f_min: float) -> int:
    """Longest analysis tone: four periods of the lowest frequency."""
    return max(1, int(4 * sample_rate / f_min))


def _over_frames(df: DataFrame, sample_rate: float, c: OnsetConfig, terms: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``(clip_id, frame, x)``: sums over bins and channels of ``terms(before, now, freq)`` of constant-Q values; 0 in the first frame.

    A frame meets the one before it in the task that transforms the channel, so one number a frame is shuffled; a term
    that is no number counts 0.
    """
    kernels = cqt_kernels(sample_rate, c.f_min, c.bins, 12, effective_window(sample_rate, c.f_min))
    freq = np.array([f for f, _ in kernels])

    def emit(s: np.ndarray, lead: int) -> dict[str, np.ndarray]:
        t = terms(s[:, :-1], s[:, 1:], freq)
        x = np.where(np.isnan(t), 0.0, t).sum(axis=2, keepdims=True)
        return {"x": x if lead else np.concatenate([np.zeros((len(s), 1, 1)), x], axis=1)}

    return over_tones(df, kernels, c.hop, emit, "x double").groupBy("clip_id", "frame").agg(F.sum("x").alias("x"))


def _flux_terms(method: str) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """What ``flux`` sums over bins."""
    if method in ("energy", "rectified"):
        return lambda a, b, _: np.maximum(np.abs(b) - np.abs(a), 0)
    if method == "magnitude":
        return lambda a, b, _: np.abs(np.abs(b) - np.abs(a))
    if method == "complex":
        return lambda a, b, _: np.abs(b - a)
    raise ValueError(f"method must be one of {METHODS}")


def _complex_terms(hop: int, sample_rate: float, magnitude_weight: float = 0.7, phase_weight: float = 0.3, rectify: bool = True) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """What ``complex_odf`` sums over bins."""

    def terms(a: np.ndarray, b: np.ndarray, freq: np.ndarray) -> np.ndarray:
        d = np.abs(b) - np.abs(a)
        phase = lambda s: np.arctan2(s.imag + 0.0, s.real + 0.0)  # noqa: E731  (no negative zeros)
        w = np.mod(phase(b) - phase(a) - 2 * np.pi * freq * hop / sample_rate + np.pi, 2 * np.pi)
        p = np.where(w == 0, np.pi, np.abs(w - np.pi))
        return magnitude_weight * (np.maximum(d, 0) if rectify else np.abs(d)) + phase_weight * p

    return terms


def onset_detection_function(df: DataFrame, sample_rate: float, c: OnsetConfig = OnsetConfig()) -> DataFrame:
    """Positive flux of the constant-Q magnitudes, zeroed below the local median."""
    return adaptive_zero(_over_frames(df, sample_rate, c, _flux_terms("energy")), c.median, c.multiplier)


def _seconds(picked: DataFrame, hop: int, sample_rate: float) -> DataFrame:
    return picked.select("clip_id", "frame", (F.col("frame") * hop / sample_rate).alias("seconds"))


def detect_onsets(df: DataFrame, sample_rate: float, c: OnsetConfig = OnsetConfig()) -> DataFrame:
    """Times of the picked peaks of the detection function."""
    return _seconds(peaks.pick_peaks(settled(onset_detection_function(df, sample_rate, c)), c.picker), c.hop, sample_rate)


def detect_onsets_flux(df: DataFrame, sample_rate: float, method: str = "energy", compression: float = 100.0, c: OnsetConfig = OnsetConfig()) -> DataFrame:
    """Flux, rectified and compressed, then picked."""
    series = settled(_over_frames(df, sample_rate, c, _flux_terms(method)))  # the picker reads it several times
    return _seconds(peaks.pick_peaks(peaks.log_compress(peaks.rectify(series), compression), c.picker), c.hop, sample_rate)


def detect_onsets_complex(df: DataFrame, sample_rate: float, c: OnsetConfig = OnsetConfig(), compression: float | None = 100.0, **weights) -> DataFrame:
    """Complex detection function, then picked."""
    series = settled(_over_frames(df, sample_rate, c, _complex_terms(c.hop, sample_rate, **weights)))
    return _seconds(peaks.pick_peaks(peaks.log_compress(series, compression) if compression else series, c.picker), c.hop, sample_rate)
