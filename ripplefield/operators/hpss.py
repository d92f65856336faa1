"""Harmonic and percussive parts: medians along time and frequency of a spectrogram, masks, inverse transform."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.operators import spectral
from ripplefield.operators.chunks import Piece, long_form, map_pieces, with_halo

#: Frames of a tile.
TILE = 128


@dataclass(frozen=True)
class HpssConfig:
    """Transform and median sizes, and the softness of the masks."""

    n_fft: int = 2048
    hop: int = 512
    harmonic: int = 17
    percussive: int = 17
    softness: float = 0.3

    def __post_init__(self):
        if self.n_fft & (self.n_fft - 1) or not 0 < self.hop <= self.n_fft or not 1 <= self.harmonic <= 101 or not 1 <= self.percussive <= 101 or not 0 <= self.softness <= 1:
            raise ValueError("setting out of range")


# The named settings.
PRESETS = {
    "musical": HpssConfig(2048, 512, 31, 31, 0.5),
    "percussive": HpssConfig(2048, 256, 17, 51, 0.1),
    "harmonic": HpssConfig(4096, 512, 51, 17, 0.1),
    "realtime": HpssConfig(1024, 256, 11, 11, 0.3),
}


def running_median(x: np.ndarray, size: int, axis: int, before: int = 0, after: int = 0) -> np.ndarray:
    """Median of a neighbourhood along an axis, reflected at the ends.

    ``before`` and ``after`` rows of a tile's halo have no result; where the halo is shorter than the neighbourhood the
    signal ends, and is reflected.
    """
    left, right = size // 2, size - 1 - size // 2
    pad, mode, skip = [(0, 0)] * x.ndim, "reflect", 0
    if before < left and after < right:  # all of the signal is here, and it may be shorter than what is reflected
        pad[axis], skip = (left, right), before
        mode = "reflect" if x.shape[axis] > max(pad[axis]) else "symmetric" if x.shape[axis] > max(pad[axis]) - 1 else "edge"
    else:
        pad[axis], skip = (max(0, left - before), max(0, right - after)), max(0, before - left)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode=mode), size, axis=axis)
    return np.median(np.take(view, range(skip, skip + x.shape[axis] - before - after), axis=axis), axis=-1)


def masks(h: Column, p: Column, softness: float) -> tuple[Column, Column]:
    """Shares of both parts, mixed with a hard decision; a tie is harmonic."""
    total = h + p + 1e-10
    hard_h, hard_p = F.when(h >= p, 1.0).otherwise(0.0), F.when(p > h, 1.0).otherwise(0.0)
    return softness * h / total + (1 - softness) * hard_h, softness * p / total + (1 - softness) * hard_p


def separated(df: DataFrame, c: HpssConfig, sample_rate: float, tile: int = TILE) -> DataFrame:
    """Spectrum with the two medians ``h`` and ``p`` of its magnitudes.

    Tiles are frames by all bins, whose number the transform bounds; the halo along time is half a neighbourhood, and the
    other axis needs none.
    """
    bins, (left, right) = c.n_fft // 2 + 1, (c.harmonic // 2, c.harmonic - 1 - c.harmonic // 2)
    spec = spectral.stft(df, c.n_fft, c.hop, sample_rate)
    dealt = with_halo(spec.select(F.struct("clip_id", "ch").alias("key"), F.col("frame").alias("idx"), "bin", "re", "im"), tile, left, right)
    tiles = dealt.groupBy("key", "chunk").agg(
        F.min(F.when(F.col("own"), F.col("idx"))).cast("long").alias("first"),
        F.count_if((F.col("idx") < F.col("chunk") * tile) & (F.col("bin") == 0)).alias("skip"),
        F.count_if(F.col("own") & (F.col("bin") == 0)).alias("own"),
        F.sort_array(F.collect_list(F.struct("idx", "bin", "re", "im"))).alias("s"),
    )
    tiles = tiles.where("own > 0").select("key", F.col("chunk").cast("long").alias("chunk"), "first", "skip", "own", F.col("s.re").alias("re"), F.col("s.im").alias("im"))

    def medians(t: Piece) -> dict:
        re, im = (t.arrays[k].reshape(-1, bins) for k in ("re", "im"))
        skip, own = t.row["skip"], t.row["own"]
        m, mine = np.hypot(re, im), slice(skip, skip + own)
        h = running_median(m, c.harmonic, 0, skip, len(m) - skip - own)
        p = running_median(m[mine], c.percussive, 1)
        return {"first": t.row["first"] * bins, "re": re[mine].ravel(), "im": im[mine].ravel(), "h": h.ravel(), "p": p.ravel()}

    done = long_form(map_pieces(tiles, medians, "first long, re array<double>, im array<double>, h array<double>, p array<double>"), "re", "im", "h", "p")
    frame, place = F.floor(F.col("idx") / bins).cast("long"), F.pmod("idx", F.lit(bins)).cast("int")
    return done.select("clip_id", "ch", frame.alias("frame"), place.alias("bin"), (place * (sample_rate / c.n_fft)).alias("freq_hz"), "re", "im", "h", "p")


def hpss(df: DataFrame, sample_rate: float, c: HpssConfig = HpssConfig(), tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Harmonic and percussive signals."""
    if sample_rate / c.n_fft > 50:
        raise ValueError("bins wider than 50 Hz separate nothing")
    both = separated(df, c, sample_rate, tile)
    out = []
    for mask in masks(F.col("h"), F.col("p"), c.softness):
        part = both.select("clip_id", "ch", "frame", "bin", "freq_hz", (F.col("re") * mask).alias("re"), (F.col("im") * mask).alias("im"))
        out.append(spectral.istft(part, c.n_fft, c.hop))
    return out[0], out[1]
