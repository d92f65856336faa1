"""Amplitude processing: projections, and whole-clip statistics joined back by a window."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplefield.operators.chunks import recursive_filter
from ripplefield.operators.kernels import map_channel
from ripplefield.operators.clipwise import with_clip


METHODS = ("minmax", "peak", "mean", "median", "zscore")
#: Filters of at least this many taps go through the frequency domain.
LONG_TAPS = 256


def normalize(df: DataFrame, method: str = "peak", low: float = -1.0, high: float = 1.0, target: float = 1.0) -> DataFrame:
    """Rescale each clip.

    ``minmax`` to [low, high] (a constant clip to the middle), ``peak`` to a target peak (silence stays),
    ``mean`` and ``median`` (the middle sample by position, mono only) to zero, ``zscore`` to unit deviation
    (a constant clip is only centred).
    """
    v = F.col("v")
    if method == "minmax":
        if low >= high:
            raise ValueError("low must lie below high")
        found, a, b = {"a__": F.min(v), "b__": F.max(v)}, F.col("a__"), F.col("b__")
        out = F.when(b > a, low + (v - a) * (high - low) / F.nullif(b - a, F.lit(0.0))).otherwise(F.lit((low + high) / 2))
    elif method == "peak":
        found, peak = {"a__": F.max(F.abs(v))}, F.col("a__")
        out = F.when(peak > 0, v * abs(target) / F.nullif(peak, F.lit(0.0))).otherwise(v)
    elif method == "mean":
        found, out = {"a__": F.avg(v)}, v - F.col("a__")
    elif method == "median":
        sized, n = with_clip(df, n__=F.max("idx") + 1, c__=F.max("ch")), F.col("n__")
        middle = (F.col("idx") == F.floor(n / 2)) | ((n % 2 == 0) & (F.col("idx") == F.floor(n / 2) - 1))
        marked = sized.withColumn("m__", F.when(middle & (F.col("c__") == 0), v))
        return with_clip(df, source=marked, m__=F.avg("m__")).withColumn("v", v - F.col("m__")).drop("m__")
    elif method == "zscore":
        found, std = {"a__": F.avg(v), "b__": F.stddev_pop(v)}, F.col("b__")
        out = (v - F.col("a__")) / F.when(std > 0, std).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"method must be one of {METHODS}")
    return with_clip(df, **found).withColumn("v", out).drop(*found)


def scale(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumn("v", F.col("v") * F.lit(float(factor)))


def clip(df: DataFrame, low: float, high: float) -> DataFrame:
    if low > high:
        raise ValueError("low must not lie above high")
    return df.withColumn("v", F.greatest(F.least(F.col("v"), F.lit(float(high))), F.lit(float(low))))


def remove_dc_offset(df: DataFrame) -> DataFrame:
    return normalize(df, "mean")


def apply_window(df: DataFrame, window: Sequence[float]) -> DataFrame:
    """Multiply by a window of the clip's own length; another length stops the query."""
    weights = F.array(*(F.lit(float(x)) for x in window))
    w = F.when(F.col("n__") == len(window), F.get(weights, F.col("idx").cast("int"))).otherwise(F.raise_error(F.lit("window and clip differ in length")).cast("double"))
    return with_clip(df, n__=F.max("idx") + 1).withColumn("v", F.col("v") * w).drop("n__")


def apply_filter(df: DataFrame, taps: Sequence[float]) -> DataFrame:
    """Finite response, valid part only: ``y[i] = sum_k x[i + k] taps[k]``.

    Short filters are sums over leads of one window; long ones go through the frequency domain.
    """
    if not len(taps):
        raise ValueError("no taps")
    if len(taps) < LONG_TAPS:
        w = Window.partitionBy("clip_id", "ch").orderBy("idx")
        y = sum((F.lead("v", k).over(w) * F.lit(float(t)) for k, t in enumerate(taps)), F.lit(0.0))
        return df.select("clip_id", "ch", "idx", y.alias("v")).where("v is not null")
    h = np.asarray(taps, float)

    def kernel(x: np.ndarray) -> np.ndarray:
        if len(x) < len(h):
            return x[:0]
        size = 1 << (len(x) + len(h)).bit_length()
        y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h[::-1], size), size)
        return y[len(h) - 1 : len(x)]

    return map_channel(df, kernel)


def _sign(v: Column) -> Column:
    return F.when(v < 0, -1.0).otherwise(1.0)


def mu_compress(df: DataFrame, mu: float = 255.0, compat: bool = False) -> DataFrame:
    """Mu-law: ``sgn(x) ln(1 + mu |x|) / ln(1 + mu)``; ``compat`` adds ln(1 + mu) inside the log instead of 1."""
    if mu <= 0:
        raise ValueError("mu must be positive")
    v, c = F.col("v"), math.log1p(mu)
    inner = mu * F.abs(v) + (c if compat else 1.0)
    return df.withColumn("v", _sign(v) * F.log(inner) / c)


def mu_expand(df: DataFrame, mu: float = 255.0) -> DataFrame:
    """Inverse of the mu-law."""
    if mu <= 0:
        raise ValueError("mu must be positive")
    v = F.col("v")
    return df.withColumn("v", _sign(v) * (F.pow(F.lit(1 + mu), F.abs(v)) - 1) / mu)


def _checked(cutoff: float, sample_rate: float) -> None:
    if not 0 < cutoff < sample_rate / 2:
        raise ValueError("a cutoff lies between 0 and half the rate")


def low_pass(df: DataFrame, cutoff: float, sample_rate: float) -> DataFrame:
    """One pole: ``y = a x + (1 - a) y'`` with a = 2 pi fc / sr and y[0] = x[0]; diverges for fc > sr / pi."""
    _checked(cutoff, sample_rate)
    a = 2 * math.pi * cutoff / sample_rate
    return recursive_filter(df, np.array([[a, 0.0, 0.0, 1.0, a - 1, 0.0]]), start=lambda x: np.array([(1 - a) * x, 0.0]))


def high_pass(df: DataFrame, cutoff: float, sample_rate: float) -> DataFrame:
    """RC high-pass: ``y = a (y' + x - x')`` with a = rc / (rc + dt) and y[0] = 0."""
    _checked(cutoff, sample_rate)
    rc, dt = 1 / (2 * math.pi * cutoff), 1 / sample_rate
    a = rc / (rc + dt)
    return recursive_filter(df, np.array([[a, -a, 0.0, 1.0, -a, 0.0]]), start=lambda x: np.array([-a * x, 0.0]))


def band_pass(df: DataFrame, low: float, high: float, sample_rate: float) -> DataFrame:
    if low >= high:
        raise ValueError("low must lie below high")
    return low_pass(high_pass(df, low, sample_rate), high, sample_rate)


def checked_map(df: DataFrame, f: Callable[[Column], Column], bad: Callable[[Column], Column], message: str) -> DataFrame:
    """An expression over every sample that stops the query where ``bad`` holds."""
    v = F.col("v")
    return df.withColumn("v", F.when(bad(v), F.raise_error(F.lit(message)).cast("double")).otherwise(f(v)))


def fold(df: DataFrame, init: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """Fold the ordered samples of every channel (short clips: an array per channel)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"])
    return df.groupBy("clip_id", "ch").agg(ordered.alias("s")).select("clip_id", "ch", F.aggregate("s", init, step).alias("folded"))


def window_function(spark: SparkSession, kind: str, n: int, periodic: bool = False) -> list[float]:
    """Values of a window function: hann, hamming, blackman, rectangular or sine."""
    k = np.arange(n)
    m = n if periodic else max(n - 1, 1)
    # The usual cosine coefficients.
    forms = {
        "hann": 0.5 - 0.5 * np.cos(2 * np.pi * k / m),
        "hamming": 0.54 - 0.46 * np.cos(2 * np.pi * k / m),
        "blackman": 0.42 - 0.5 * np.cos(2 * np.pi * k / m) + 0.08 * np.cos(4 * np.pi * k / m),
        "rectangular": np.ones(n),
        "sine": np.sin(np.pi * (k + 0.5) / n),
    }
    if kind not in forms:
        raise ValueError(f"window must be one of {sorted(forms)}")
    return forms[kind].tolist()
