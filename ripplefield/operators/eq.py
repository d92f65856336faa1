"""Parametric equaliser: second-order sections from the usual cookbook formulas, applied as one cascade."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefield.operators.iir import apply_sections, frequency_response

KINDS = ("peak", "low_shelf", "high_shelf", "low_pass", "high_pass", "band_pass", "band_stop")


@dataclass(frozen=True)
class Band:
    """One band of an equaliser."""

    kind: str
    frequency: float
    gain_db: float = 0.0
    q: float = 0.707
    enabled: bool = True


def section(band: Band, sample_rate: float) -> np.ndarray:
    """(b0, b1, b2, 1, a1, a2) of a band; shelves scale their slope term by sqrt(2 A)."""
    if band.kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if not 0 < band.frequency < sample_rate / 2 or band.q <= 0 or abs(band.gain_db) > 40:
        raise ValueError("frequency below half the rate, positive Q, at most 40 dB")
    amp = 10 ** (band.gain_db / 40)
    w = 2 * math.pi * band.frequency / sample_rate
    c, alpha = math.cos(w), math.sin(w) / (2 * band.q)
    if band.kind == "peak":
        b, a = (1 + alpha * amp, -2 * c, 1 - alpha * amp), (1 + alpha / amp, -2 * c, 1 - alpha / amp)
    elif band.kind.endswith("shelf"):
        s = 1 if band.kind == "low_shelf" else -1
        up, down, t = amp + 1, amp - 1, math.sqrt(2 * amp) * alpha
        b = (amp * (up - s * down * c + t), s * 2 * amp * (down - s * up * c), amp * (up - s * down * c - t))
        a = (up + s * down * c + t, -s * 2 * (down + s * up * c), up + s * down * c - t)
    else:
        numerators = {
            "low_pass": ((1 - c) / 2, 1 - c, (1 - c) / 2),
            "high_pass": ((1 + c) / 2, -(1 + c), (1 + c) / 2),
            "band_pass": (alpha, 0.0, -alpha),
            "band_stop": (1.0, -2 * c, 1.0),
        }
        b, a = numerators[band.kind], (1 + alpha, -2 * c, 1 - alpha)
    return np.array([*b, *a]) / a[0]


def apply_parametric_eq(df: DataFrame, bands: Sequence[Band], sample_rate: float, output_gain_db: float = 0.0, bypass: bool = False) -> DataFrame:
    """Enabled bands in order, then the output gain; a bypassed equaliser changes nothing."""
    if bypass:
        return df
    used = [section(b, sample_rate) for b in bands if b.enabled]
    out = apply_sections(df, np.array(used)) if used else df
    return out.withColumn("v", F.col("v") * 10 ** (output_gain_db / 20)) if output_gain_db else out


def apply_eq_band(df: DataFrame, band: Band, sample_rate: float) -> DataFrame:
    return apply_parametric_eq(df, [band], sample_rate)


def three_band(low=(200.0, 0.0), mid=(1000.0, 0.0, 1.0), high=(4000.0, 0.0)) -> list[Band]:
    """Low shelf, peak and high shelf as (Hz, dB[, Q]); shelves have Q 0.707."""
    if not low[0] < mid[0] < high[0]:
        raise ValueError("the bands must be ordered")
    return [Band("low_shelf", *low), Band("peak", *mid), Band("high_shelf", *high)]


def eq_frequency_response(bands: Sequence[Band], frequencies: Sequence[float], sample_rate: float, output_gain_db: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Product of the bands' magnitudes and sum of their phases."""
    mag, phase = np.full(len(frequencies), 10 ** (output_gain_db / 20)), np.zeros(len(frequencies))
    for b in bands:
        if b.enabled:
            m, p = frequency_response(section(b, sample_rate)[None], frequencies, sample_rate)
            mag, phase = mag * m, phase + p
    return mag, phase
