"""Dynamics: an envelope follower per channel, then static curves as expressions.

The follower's coefficient depends on its own detector, so it is a scan; everything after it is a projection.
Look-ahead is fully compensated in the original and has no effect, so it is no parameter here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.operators.chunks import CHUNK, Piece, Recurrence, cut, long_form, scan
from ripplefield.operators.recurrence import varying_one_pole

DETECTORS = ("peak", "rms", "hybrid")
#: Window of the RMS detector.
RMS_MS = 10.0
FLOOR = 1e-10


def rms_samples(sample_rate: float) -> int:
    """Length of the RMS detector's window."""
    return max(1, int(RMS_MS / 1000 * sample_rate))


def detector(x: np.ndarray, sample_rate: float, method: str) -> np.ndarray:
    """Absolute value, RMS of the trailing 10 ms (fewer at the start), or the greater of both."""
    if method not in DETECTORS:
        raise ValueError(f"method must be one of {DETECTORS}")
    peak = np.abs(x)
    if method == "peak":
        return peak
    size = rms_samples(sample_rate)
    total = np.cumsum(np.r_[0.0, x * x])
    i = np.arange(1, len(x) + 1)
    low = np.maximum(i - size, 0)
    rms = np.sqrt(np.maximum(total[i] - total[low], 0) / (i - low))
    return rms if method == "rms" else np.maximum(peak, rms)


def follow(x: np.ndarray, sample_rate: float, attack_ms: float, release_ms: float, method: str = "peak", state: list | None = None) -> np.ndarray:
    """Envelope of the samples; see ``follow_detector``."""
    return follow_detector(detector(x, sample_rate, method), sample_rate, attack_ms, release_ms, state)


def follow_detector(d: np.ndarray, sample_rate: float, attack_ms: float, release_ms: float, state: list | None = None) -> np.ndarray:
    """Attack while the detector rises against its last value, release otherwise; ``state`` is its last value and the envelope's."""
    up, down = (math.exp(-1 / (t / 1000 * sample_rate)) for t in (attack_ms, release_ms))
    last, e = (state[0], state[1]) if state else (0.0, 0.0)
    coefficient = np.where(d > np.r_[last, d[:-1]], up, down) if len(d) else d
    out = varying_one_pole(coefficient, (1 - coefficient) * d, e)
    if state is not None:
        state[:] = [float(d[-1]), float(out[-1])] if len(d) else [last, e]
    return out


def follower(df: DataFrame, sample_rate: float, attack_ms: float, release_ms: float, method: str = "peak", chunk: int = CHUNK) -> DataFrame:
    """Adds the follower of every channel as ``e``, for clips of any length.

    Its coefficient varies by sample with the detector, which sees its window through the chunk's halo; given the
    coefficients the follower is affine in its last value, so chunks are a prefix scan of (product, offset).
    """
    up, down = (math.exp(-1 / (t / 1000 * sample_rate)) for t in (attack_ms, release_ms))
    halo = 1 if method == "peak" else rms_samples(sample_rate)

    def coefficients(p: Piece) -> tuple[np.ndarray, np.ndarray]:
        skip = p.row["skip"]
        d = detector(p.arrays["v"][: skip + p.row["own"]], sample_rate, method)
        own = d[skip:]
        c = np.where(own > np.r_[d[skip - 1] if skip else 0.0, own[:-1]], up, down)
        return c, (1 - c) * own

    def drive(p: Piece) -> tuple[float, float]:
        c, b = coefficients(p)
        return np.prod(c), varying_one_pole(c, b)[-1]

    def run(p: Piece, z: np.ndarray | None) -> dict:
        return {"v": p.own(), "e": varying_one_pole(*coefficients(p), 0.0 if z is None else z[0]), "first": p.row["first"]}

    arrays = cut(df, chunk, halo, 1)
    last = F.size("v") <= F.col("skip") + F.col("own")
    return long_form(scan(arrays, Recurrence(1, drive, run), "v array<double>, e array<double>, first long", last), "v", "e")


def envelope(df: DataFrame, sample_rate: float, attack_ms: float, release_ms: float, method: str = "peak", chunk: int = CHUNK) -> DataFrame:
    """The follower of every channel."""
    return follower(df, sample_rate, attack_ms, release_ms, method, chunk).select("clip_id", "ch", "idx", F.col("e").alias("v"))


@dataclass(frozen=True)
class Dynamics:
    """Settings of a compressor, limiter, gate or expander."""

    threshold_db: float = -12.0
    ratio: float = 4.0
    attack_ms: float = 5.0
    release_ms: float = 50.0
    makeup_db: float = 0.0
    knee: str = "soft"
    knee_db: float = 2.0
    detection: str = "rms"

    def __post_init__(self):
        if self.ratio < 1 or not 0.01 <= self.attack_ms <= 1000 or not 1 <= self.release_ms <= 10000 or abs(self.makeup_db) > 40 or not 0 <= self.knee_db <= 20 or self.knee not in ("soft", "hard"):
            raise ValueError("setting out of range")


# The named settings.
COMPRESSORS = {
    "default": Dynamics(),
    "vocal": Dynamics(-18, 3, 2, 100, 3, "soft", 4),
    "drum": Dynamics(-8, 6, 0.1, 20, 2, "hard", 0.5, "peak"),
    "bus": Dynamics(-20, 2, 10, 200, 1, "soft", 6),
}
LIMITERS = {
    "default": Dynamics(-0.1, 1, 0.5, 50, 0, "soft", 1, "peak"),
    "transparent": Dynamics(-0.1, 1, 0.1, 100, 0, "soft", 2, "peak"),
    "mastering": Dynamics(-0.3, 1, 1, 200, 0, "soft", 3, "hybrid"),
    "broadcast": Dynamics(-1, 1, 0.5, 50, 0, "hard", 0.5, "peak"),
}
GATES = {"default": Dynamics(-40, 10, 1, 100, detection="peak"), "noise_gate": Dynamics(-45, 20, 0.5, 150, detection="peak")}
EXPANDERS = {"default": Dynamics(-40, 2, 1, 100), "gentle": Dynamics(-50, 1.5, 5, 200)}


def compression_gain(level_db: Column, c: Dynamics) -> Column:
    """Reduction in dB above the threshold; the soft knee lies above it only."""
    over = level_db - c.threshold_db
    reduce_by = lambda x, r: x - x / r
    if c.knee == "hard":
        return F.when(over <= 0, F.lit(0.0)).otherwise(reduce_by(over, c.ratio))
    half = c.knee_db / 2
    share = over / half if half else F.lit(0.0)
    inner = reduce_by(over, 1 + (c.ratio - 1) * share * share)
    return F.when(over <= 0, F.lit(0.0)).when(over <= half, inner).otherwise(half - half / c.ratio + reduce_by(over - half, c.ratio))


def limiting_gain(level_db: Column, c: Dynamics) -> Column:
    """Reduction in dB above the ceiling."""
    over = level_db - c.threshold_db
    if c.knee == "hard":
        return F.when(over <= 0, F.lit(0.0)).otherwise(over)
    half = c.knee_db / 2
    share = over / half if half else F.lit(0.0)
    return F.when(over <= 0, F.lit(0.0)).when(over <= half, over * share * share).otherwise(over)


def gate_gain(level_db: Column, c: Dynamics) -> Column:
    under = c.threshold_db - level_db
    return F.when(under <= 0, F.lit(0.0)).otherwise(under * (c.ratio - 1) / c.ratio)


def expander_gain(level_db: Column, c: Dynamics) -> Column:
    under = c.threshold_db - level_db
    return F.when(under <= 0, F.lit(0.0)).otherwise(under * (c.ratio - 1))


def level_db(v: Column) -> Column:
    """20 log10 with a floor of -200 dB."""
    return 20 * F.log10(F.greatest(v, F.lit(FLOOR)))


def _controlled(df: DataFrame, sidechain: DataFrame | None, gain, c: Dynamics, sample_rate: float, chunk: int) -> DataFrame:
    """The gain follows the signal itself, without a join, or a side chain, joined by sample."""
    keys = ["clip_id", "ch", "idx"]
    both = follower(df if sidechain is None else sidechain, sample_rate, c.attack_ms, c.release_ms, c.detection, chunk)
    if sidechain is not None:
        both = df.select(*keys, "v").join(both.select(*keys, "e"), keys)
    return both.select(*keys, (F.col("v") * F.pow(F.lit(10.0), (c.makeup_db - gain(level_db(F.col("e")), c)) / 20)).alias("v"))


def apply_compressor(df, c: Dynamics, sample_rate, sidechain: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Compress by the signal's own level, or by that of a side chain of the same shape."""
    return _controlled(df, sidechain, compression_gain, c, sample_rate, chunk)


def apply_limiter(df, c: Dynamics, sample_rate, sidechain: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    return _controlled(df, sidechain, limiting_gain, c, sample_rate, chunk)


def apply_gate(df, c: Dynamics, sample_rate, chunk: int = CHUNK) -> DataFrame:
    return _controlled(df, None, gate_gain, c, sample_rate, chunk)


def apply_expander(df, c: Dynamics, sample_rate, chunk: int = CHUNK) -> DataFrame:
    return _controlled(df, None, expander_gain, c, sample_rate, chunk)


def gain_reduction(df, c: Dynamics, sample_rate, chunk: int = CHUNK) -> DataFrame:
    """Reduction in dB of every sample of the first channel."""
    env = envelope(df.where("ch = 0"), sample_rate, c.attack_ms, c.release_ms, c.detection, chunk)
    return env.withColumn("v", compression_gain(level_db(F.col("v")), c))


def compression_curve(levels: DataFrame, c: Dynamics) -> DataFrame:
    """Output level of each ``level_db``."""
    return levels.withColumn("out_db", F.col("level_db") - compression_gain(F.col("level_db"), c) + c.makeup_db)


class Lookahead:
    """A delay of ``n`` samples, in blocks."""

    def __init__(self, n: int):
        self.n = n
        self.reset()

    def process(self, block: np.ndarray) -> np.ndarray:
        """The samples of ``n`` ago; zeros before the first."""
        both = np.r_[self.ring, np.asarray(block, float)]
        self.ring = both[len(both) - self.n :]
        return both[: len(both) - self.n]

    def reset(self) -> None:
        self.ring = np.zeros(self.n)
