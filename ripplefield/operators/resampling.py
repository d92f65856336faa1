"""Resampling: linear between neighbouring samples, better qualities by a windowed sinc over chunks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplefield.operators.chunks import CHUNK, Piece, cut, long_form, map_pieces


@dataclass(frozen=True)
class Sinc:
    """Taps, cutoff and window of an interpolator."""

    taps: int
    cutoff: float
    window: str


# The two sinc qualities.
QUALITIES = {"medium": Sinc(128, 0.95, "hann"), "high": Sinc(256, 0.95, "blackman")}


#: Weights of a polyphase table; beyond it they are computed for each output.
LARGEST_TABLE = 1 << 22


def resample_linear(df: DataFrame, source: int, target: int) -> DataFrame:
    """``ceil(n target / source)`` samples interpolated between neighbours; whole decimation takes every k-th sample.

    Output i lies at i source / target; every input sample emits the outputs between it and its successor, so
    there is no join.
    """
    if source < 1 or target < 1:
        raise ValueError("rates must be positive")
    if source == target:
        return df
    w = Window.partitionBy("clip_id", "ch").orderBy("idx")
    nxt = F.coalesce(F.lead("v").over(w), F.col("v"))
    first = F.ceil(F.col("idx") * F.lit(target) / F.lit(source))
    last = F.ceil((F.col("idx") + 1) * F.lit(target) / F.lit(source)) - 1
    dealt = df.select("clip_id", "ch", "idx", "v", nxt.alias("nxt"), first.alias("a"), last.alias("b")).where("a <= b")
    out = dealt.select("clip_id", "ch", "idx", "v", "nxt", F.explode(F.sequence("a", "b")).alias("to"))
    t = F.col("to") * F.lit(source) / F.lit(target) - F.col("idx")
    return out.select("clip_id", "ch", F.col("to").alias("idx"), (F.col("v") + (F.col("nxt") - F.col("v")) * t).alias("v"))


def sinc_half(source: int, target: int, q: Sinc) -> int:
    """Source samples on each side of an output."""
    return -(-q.taps * max(source, target) // (2 * target))


def sinc_weights(remainders: np.ndarray, source: int, target: int, q: Sinc) -> np.ndarray:
    """Weights of the source samples around outputs that lie ``remainder / target`` after a source sample."""
    half, scale = sinc_half(source, target, q), min(1.0, target / source) * q.cutoff
    d = remainders[:, None] / target - np.arange(-half + 1, half + 1)
    u = np.clip(0.5 + d / (2 * half), 0, 1)
    win = 0.5 - 0.5 * np.cos(2 * np.pi * u) if q.window == "hann" else 0.42 - 0.5 * np.cos(2 * np.pi * u) + 0.08 * np.cos(4 * np.pi * u)
    return scale * np.sinc(scale * d) * win


def resample_sinc(df: DataFrame, source: int, target: int, q: Sinc, chunk: int = CHUNK) -> DataFrame:
    """``ceil(n target / source)`` windowed-sinc outputs, over chunks of the source; beyond the ends lie zeros.

    Both grids are rational: output i lies at ``i source / target``, in exact integers, and belongs to the chunk of
    the source sample at or before it.  The halo is in source samples; the offsets repeat, so their
    weights are a polyphase table unless that would be larger than the work itself.
    """
    common = math.gcd(source, target)
    source, target = source // common, target // common
    half = sinc_half(source, target, q)

    def kernel(p: Piece) -> dict:
        x, skip, first, own = p.arrays["v"], p.row["skip"], p.row["first"], p.row["own"]
        padded = np.concatenate([np.zeros(max(0, half - 1 - skip)), x, np.zeros(max(0, half - (len(x) - skip - own)))])
        windows = np.lib.stride_tricks.sliding_window_view(padded[max(0, skip - half + 1) :], 2 * half)  # of each own sample
        begin, end = -(-first * target // source), -(-(first + own) * target // source)
        table = sinc_weights(np.arange(target), source, target, q) if target * 2 * half <= LARGEST_TABLE else None
        out = np.empty(end - begin)
        for start in range(begin, end, 4096):
            at = np.arange(start, min(start + 4096, end)) * source
            weights = sinc_weights(at % target, source, target, q) if table is None else table[at % target]
            out[start - begin : start - begin + len(at)] = (windows[at // target - first] * weights).sum(axis=1)
        return {"v": out, "first": begin}

    return long_form(map_pieces(cut(df, chunk, half, half), kernel, "v array<double>, first long"), "v")


def resample(df: DataFrame, source: int, target: int, quality: str = "medium") -> DataFrame:
    """``fast`` is linear, ``medium`` and ``high`` are sincs; an equal rate changes nothing."""
    if quality == "fast" or source == target:
        return resample_linear(df, source, target)
    if quality not in QUALITIES:
        raise ValueError("quality must be fast, medium or high")
    return resample_sinc(df, source, target, QUALITIES[quality])


def resample_by_ratio(df: DataFrame, source: int, ratio: float, quality: str = "medium") -> DataFrame:
    """To the rate ``round(source * ratio)``."""
    if ratio <= 0:
        raise ValueError("the ratio must be positive")
    return resample(df, source, int(source * ratio + 0.5), quality)
