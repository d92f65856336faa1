"""Spectra.  Long form ``(clip_id, ch, frame, bin, freq_hz, re, im)``; power is ``re^2 + im^2``, unscaled.

Short transforms can be an ordinary join with a table of sines (``dft``); the others are numpy ``rfft`` in
Arrow batches of frames.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplefield.operators.elementwise import window_function
from ripplefield.operators.frames import frame_arrays
from ripplefield.operators.chunks import Piece
from ripplefield.operators.kernels import map_channel, pair_channel
from ripplefield.operators.overlap import BLOCK, frame_blocks, overlap_add, synthesis

SPECTRUM = "clip_id long, ch int, frame long, bin int, freq_hz double, re double, im double"
KEYS = ("clip_id", "ch", "frame")


def dft(df: DataFrame, n: int, sample_rate: float) -> DataFrame:
    """One-sided transform of clips of ``n`` samples as a sum per bin: expressions only, for short clips."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("bin")
    w = 2 * math.pi / n * F.pmod(F.col("bin") * F.col("idx"), F.lit(n))
    terms = df.where(F.col("idx") < n).select("clip_id", "ch", "idx", "v", bins)
    g = terms.groupBy("clip_id", "ch", "bin").agg(F.sum(F.col("v") * F.cos(w)).alias("re"), F.sum(-F.col("v") * F.sin(w)).alias("im"))
    return g.select("clip_id", "ch", F.lit(0).cast("long").alias("frame"), "bin", (F.col("bin") * sample_rate / n).alias("freq_hz"), "re", "im")


def _transform(arrays: DataFrame, n_fft: int, sample_rate: float, window: list[float] | None) -> DataFrame:
    """``rfft`` of the array ``w`` of every row, cut or zero-filled to ``n_fft``; a narrow pass over Arrow batches."""
    win = np.asarray(window) if window is not None else None
    freq = np.arange(n_fft // 2 + 1) * sample_rate / n_fft

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.zeros((len(pdf), n_fft))
            for k, w in enumerate(pdf["w"]):
                m = min(len(w), n_fft)
                x[k, :m] = np.asarray(w[:m], float) * (win[:m] if win is not None else 1.0)
            s = np.fft.rfft(x, axis=1)
            b = len(freq)
            yield pd.DataFrame({**{c: np.repeat(pdf[c].to_numpy(), b) for c in KEYS}, "bin": np.tile(np.arange(b, dtype=np.int32), len(pdf)), "freq_hz": np.tile(freq, len(pdf)), "re": s.real.ravel(), "im": s.imag.ravel()})

    return arrays.select(*KEYS, "w").mapInPandas(each, SPECTRUM.replace("clip_id long", f"clip_id {arrays.schema['clip_id'].dataType.simpleString()}"))


def whole(df: DataFrame) -> DataFrame:
    """Every channel as one frame: ``(clip_id, ch, frame, w)``."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"])
    return df.groupBy("clip_id", "ch").agg(ordered.alias("w")).select("clip_id", "ch", F.lit(0).cast("long").alias("frame"), "w")


def fft(df: DataFrame, n_fft: int, sample_rate: float) -> DataFrame:
    """One-sided transform of every channel; short ones are filled with zeros."""
    if n_fft < 1:
        raise ValueError("n_fft must be positive")
    return _transform(whole(df), n_fft, sample_rate, None)


def clip_spectrum(df: DataFrame, sample_rate: float, window: str | None = None) -> DataFrame:
    """One-sided transform over each channel's own length."""

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx")["v"].to_numpy(float)
        n = len(x)
        s = np.fft.rfft(x * (np.asarray(window_function(None, window, n)) if window else 1.0))
        return pd.DataFrame({"clip_id": key[0], "ch": np.int32(key[1]), "frame": 0, "bin": np.arange(len(s), dtype=np.int32), "freq_hz": np.arange(len(s)) * sample_rate / n, "re": s.real, "im": s.imag})

    return df.groupBy("clip_id", "ch").applyInPandas(each, SPECTRUM)


def magnitude() -> Column:
    return F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def power() -> Column:
    return F.col("re") * F.col("re") + F.col("im") * F.col("im")


def rfft(df: DataFrame, n_fft: int, sample_rate: float) -> DataFrame:
    """Magnitudes of ``fft``."""
    return fft(df, n_fft, sample_rate).withColumn("magnitude", magnitude())


def _centred(df: DataFrame, n_fft: int, centre: bool) -> DataFrame:
    from ripplefield.operators.editing import pad_samples

    return pad_samples(df, n_fft // 2, n_fft // 2) if centre else df


def stft(df: DataFrame, n_fft: int, hop: int, sample_rate: float, window: str = "hann", centre: bool = True) -> DataFrame:
    """Transforms of windowed frames (periodic window, full frames); ``centre`` pads half a frame at both ends."""
    arrays = frame_arrays(_centred(df, n_fft, centre), n_fft, hop, "skip")
    return _transform(arrays, n_fft, sample_rate, window_function(None, window, n_fft, periodic=True))


def istft(spec: DataFrame, n_fft: int, hop: int, window: str = "hann", centre: bool = True, length: int | None = None, block: int = BLOCK) -> DataFrame:
    """Overlap-add inverse, divided by the sum of squared windows, over blocks of frames and samples."""
    win = np.asarray(window_function(None, window, n_fft, periodic=True))

    def frames_of(p: Piece) -> tuple[int, np.ndarray]:
        s = (p.arrays["re"] + 1j * p.arrays["im"]).reshape(-1, n_fft // 2 + 1)
        return p.row["first"], np.fft.irfft(s, n_fft, axis=1)

    sums = overlap_add(frame_blocks(spec, hop, block), frames_of, win, hop, block)
    out = synthesis(sums, 1e-10, n_fft // 2 if centre else 0, n_fft // 2 if centre else 0)
    return out.where(F.col("idx") < length) if length is not None else out


def to_db(value: Column, floor_db: float = -80.0) -> Column:
    """10 log10 of a power with a floor."""
    return F.greatest(10 * F.log10(F.greatest(value, F.lit(1e-300))), F.lit(floor_db))


AMPLITUDES = {"power": power, "magnitude": magnitude, "db": lambda: to_db(power())}


def linear_spectrogram(df: DataFrame, n_fft: int, hop: int, sample_rate: float, scale: str = "power", window: str = "hann", centre: bool = True) -> DataFrame:
    """``value`` of each frame and bin as power, magnitude or dB."""
    if scale not in AMPLITUDES:
        raise ValueError(f"scale must be one of {sorted(AMPLITUDES)}")
    return stft(df, n_fft, hop, sample_rate, window, centre).select(*KEYS, "bin", "freq_hz", AMPLITUDES[scale]().alias("value"))


def power_spectral_density(df: DataFrame, window_size: int, overlap: float, sample_rate: float) -> DataFrame:
    """Welch average of Hann-windowed power, over the bin width (not over the window's energy)."""
    if not 0 <= overlap < 1:
        raise ValueError("the overlap lies in [0, 1)")
    hop = max(1, int((1 - overlap) * window_size))
    s = _transform(frame_arrays(df, window_size, hop, "skip"), window_size, sample_rate, window_function(None, "hann", window_size))
    return s.groupBy("clip_id", "ch", "bin", "freq_hz").agg((F.avg(power()) / (sample_rate / window_size)).alias("density"))


def magphase(spec: DataFrame, exponent: float = 1.0) -> DataFrame:
    """Magnitude to a power and unit phase (1 + 0i where the magnitude is 0)."""
    m = magnitude()
    unit = lambda c, other: F.when(m > 0, F.col(c) / F.nullif(m, F.lit(0.0))).otherwise(F.lit(other))
    return spec.select(*KEYS, "bin", "freq_hz", F.pow(m, F.lit(float(exponent))).alias("magnitude"), unit("re", 1.0).alias("phase_re"), unit("im", 0.0).alias("phase_im"))


def convolve(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full linear convolution of the same channels of two signals."""

    def kernel(x: np.ndarray, y: np.ndarray) -> dict:
        n = len(x) + len(y) - 1
        v = np.convolve(x, y) if min(len(x), len(y)) <= 64 else np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(y, n), n)
        return {"idx": np.arange(n), "v": v}

    return pair_channel(a, b, kernel, "idx long, v double")


def convolve_taps(df: DataFrame, taps: list[float]) -> DataFrame:
    """Full convolution with a short response as one explode and one sum per output sample."""
    t = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(h)).alias("h")) for k, h in enumerate(taps)))
    terms = df.select("clip_id", "ch", "idx", "v", F.explode(t).alias("t"))
    return terms.groupBy("clip_id", "ch", (F.col("idx") + F.col("t.k")).alias("idx")).agg(F.sum(F.col("v") * F.col("t.h")).alias("v"))


def deconvolve(a: DataFrame, b: DataFrame, regularization: float = 1e-10) -> DataFrame:
    """Regularised spectral division of ``a`` by ``b``."""

    def kernel(x: np.ndarray, y: np.ndarray) -> dict:
        n = max(len(x), len(y))
        p, q = np.fft.rfft(x, n), np.fft.rfft(y, n)
        v = np.fft.irfft(p * np.conj(q) / (np.abs(q) ** 2 + regularization), n)[: max(1, len(x) - len(y) + 1)]
        return {"idx": np.arange(len(v)), "v": v}

    return pair_channel(a, b, kernel, "idx long, v double")


def hilbert_signal(df: DataFrame) -> DataFrame:
    """Quadrature signal of every channel."""
    from ripplefield.operators.envelopes import hilbert

    return map_channel(df, hilbert)


def GROUP() -> Window:
    """All bins of a frame."""
    return Window.partitionBy(*KEYS)


def features(spec: DataFrame, rolloff: float = 0.85) -> DataFrame:
    """Centroid, bandwidth, rolloff, flatness, crest and slope of every frame from one spectrum; silent frames give 0."""
    if not 0 < rolloff < 1:
        raise ValueError("the share lies in (0, 1)")
    p, m, f = F.col("p"), F.col("m"), F.col("freq_hz")
    run = F.sum("p").over(GROUP().orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    s = spec.select(*KEYS, "bin", "freq_hz", power().alias("p"), magnitude().alias("m"))
    s = s.withColumns({"run": run, "all": F.sum("p").over(GROUP()), "mid": F.try_divide(F.sum(f * m).over(GROUP()), F.sum(m).over(GROUP()))})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    flat = F.try_divide(F.exp(F.avg(F.log(p + 1e-10))), F.avg(p))
    return s.groupBy(*KEYS).agg(
        zero(F.try_divide(F.sum(f * p), F.sum(p))).alias("centroid"),
        zero(F.sqrt(F.try_divide(F.sum((f - F.col("mid")) * (f - F.col("mid")) * m), F.sum(m)))).alias("bandwidth"),
        zero(F.min(F.when(F.col("run") >= rolloff * F.col("all"), f))).alias("rolloff"),
        F.least(F.greatest(zero(flat), F.lit(0.0)), F.lit(1.0)).alias("flatness"),
        zero(F.try_divide(F.max(m), F.avg(m))).alias("crest"),
        zero(F.regr_slope(m, f)).alias("slope"),
    )


def contrast_edges(n_bins: int, bands: int) -> list[tuple[int, int]]:
    """Geometric bands of bins from bin 1 to the end."""
    edges = np.unique(np.round(np.geomspace(1, n_bins, bands + 1)).astype(int))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def contrast(spec: DataFrame, bands: int, n_bins: int) -> DataFrame:
    """Per band: mean of the loudest minus mean of the quietest fiftieth of the bins, in dB of magnitude."""
    edges = contrast_edges(n_bins, bands)
    band = F.coalesce(*(F.when(F.col("bin").between(a, b - 1), F.lit(k)) for k, (a, b) in enumerate(edges)))
    s = spec.select(*KEYS, "bin", (10 * F.log10(magnitude() + 1e-10)).alias("db"), band.alias("band")).where("band is not null")
    w = Window.partitionBy(*KEYS, "band")
    s = s.withColumns({"n": F.count("*").over(w), "up": F.row_number().over(w.orderBy("db", "bin")), "down": F.row_number().over(w.orderBy(F.desc("db"), "bin"))})
    k = F.least(F.greatest(F.round(F.col("n") * 0.02), F.lit(1)), F.col("n"))
    return s.groupBy(*KEYS, "band").agg((F.avg(F.when(F.col("down") <= k, F.col("db"))) - F.avg(F.when(F.col("up") <= k, F.col("db")))).alias("contrast"))


def windowed_series(df: DataFrame, size: int, hop: int, sample_rate: float) -> DataFrame:
    """Overlay series of zero-padded windows: time of the centre, RMS, peak, energy and crossings per second."""
    from ripplefield.operators.frames import frames

    cut = frames(df, size, hop, "zero")
    prev = F.lag("v").over(Window.partitionBy("clip_id", "ch", "frame").orderBy("pos"))
    crossed = F.coalesce(((prev > 0) & (F.col("v") <= 0)) | ((prev <= 0) & (F.col("v") > 0)), F.lit(False)).cast("int")
    g = cut.withColumn("x", crossed).groupBy("clip_id", "frame").agg(F.avg(F.col("v") * F.col("v")).alias("energy"), F.max(F.abs("v")).alias("peak"), F.sum("x").alias("x"))
    return g.select("clip_id", "frame", ((F.col("frame") * hop + size / 2) / sample_rate).alias("seconds"), F.sqrt("energy").alias("rms"), "peak", "energy", (F.col("x") * sample_rate / size).alias("zcr"))


def windowed_features(df: DataFrame, size: int, hop: int, sample_rate: float, rolloff: float = 0.85) -> DataFrame:
    """Centroid and rolloff of zero-padded windows of the first channel, at their centres."""
    arrays = frame_arrays(df.where("ch = 0"), size, hop, "zero")
    f = features(_transform(arrays, size, sample_rate, None), rolloff)
    return f.select("clip_id", "frame", ((F.col("frame") * hop + size / 2) / sample_rate).alias("seconds"), "centroid", "rolloff")
