"""Envelopes of channels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefield.operators import chunks
from ripplefield.operators.chunks import CHUNK
from ripplefield.operators.dynamics import envelope
from ripplefield.operators.frames import frame_aggregate
from ripplefield.operators.kernels import map_channel


def amplitude_envelope(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.abs("v"))


def rms_envelope(df: DataFrame, size: int, hop: int) -> DataFrame:
    """Root mean square of windows at 0, hop, ..; the last ones are shorter."""
    return frame_aggregate(df, size, hop, "none", v=F.sqrt(F.avg(F.col("v") * F.col("v"))))


def moving_average_envelope(df: DataFrame, size: int, hop: int) -> DataFrame:
    """Mean absolute value of windows at 0, hop, ..; the last ones are shorter."""
    return frame_aggregate(df, size, hop, "none", v=F.avg(F.abs("v")))


def hilbert(x: np.ndarray) -> np.ndarray:
    """Quadrature signal: positive frequencies turned by a quarter; DC and the highest bin stay out."""
    s = np.fft.fft(x)
    n = len(x)
    turn = np.zeros(n)
    turn[1 : (n + 1) // 2], turn[n // 2 + 1 :] = 1, -1
    return np.fft.ifft(-1j * turn * s).real


def analytic_envelope(df: DataFrame) -> DataFrame:
    """Magnitude of the analytic signal."""
    return map_channel(df, lambda x: np.hypot(x, hilbert(x)))


def attack_decay_envelope(df: DataFrame, sample_rate: float, attack_ms: float, release_ms: float, method: str = "peak", chunk: int = CHUNK) -> DataFrame:
    """The follower's value, latched in one track while it rises and in the other while it falls: ``(attack, decay)``."""
    e = envelope(df, sample_rate, attack_ms, release_ms, method, chunk)
    # the value before comes with the chunk's halo
    pairs = chunks.windowed(e, lambda w: F.struct("v", (F.col("v") > F.coalesce(F.lag("v").over(w), F.lit(0.0))).alias("up")), 1, 0, chunk)
    v, up = F.col("v.v"), F.col("v.up")
    held = chunks.latest(pairs, chunk, attack=F.when(up, v), decay=F.when(~up, v))
    return held.select("clip_id", "ch", "idx", F.coalesce("attack", F.lit(0.0)).alias("attack"), F.coalesce("decay", F.lit(0.0)).alias("decay"))
