"""Filterbanks: tables of (band, bin, weight), broadcast to the spectrum and summed per band.

A bank's size is set by its own parameters (bands x bins), never by the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefield.operators import spectral
from ripplefield.operators.kernels import arrays_of, channel_arrays

#: A bank of more rows than this is joined by shuffle instead.
BROADCAST_ROWS = 1_000_000


def mel(f):
    return 2595 * np.log10(1 + np.asarray(f, float) / 700)


def inverse_mel(m):
    return 700 * (10 ** (np.asarray(m, float) / 2595) - 1)


def triangles(edges: np.ndarray, n_fft: int, sample_rate: float) -> np.ndarray:
    """Triangular weights (bands x bins) between neighbouring edges in Hz, peak 1."""
    f = np.arange(n_fft // 2 + 1) * sample_rate / n_fft
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    up, down = (f - left) / np.maximum(mid - left, 1e-12), (right - f) / np.maximum(right - mid, 1e-12)
    return np.maximum(0, np.minimum(up, down))


def mel_bank(n_mels: int, n_fft: int, sample_rate: float, low: float = 0.0, high: float | None = None) -> np.ndarray:
    return triangles(inverse_mel(np.linspace(mel(low), mel(high or sample_rate / 2), n_mels + 2)), n_fft, sample_rate)


def log_bank(n_bands: int, n_fft: int, sample_rate: float, low: float, high: float | None = None) -> np.ndarray:
    """Triangles at frequencies of constant ratio."""
    if low <= 0:
        raise ValueError("the lowest frequency must be positive")
    return triangles(np.geomspace(low, high or sample_rate / 2, n_bands + 2), n_fft, sample_rate)


def gammatone_bank(n_bands: int, n_fft: int, sample_rate: float, low: float = 50.0, high: float | None = None) -> np.ndarray:
    """Fourth-order gammatone magnitudes at centres evenly spaced in equivalent rectangular bandwidths."""
    scale = lambda f: 21.4 * np.log10(1 + 0.00437 * f)
    centres = (10 ** (np.linspace(scale(low), scale(high or sample_rate / 2), n_bands) / 21.4) - 1) / 0.00437
    width = 1.019 * 24.7 * (4.37 * centres / 1000 + 1)
    f = np.arange(n_fft // 2 + 1) * sample_rate / n_fft
    return (1 + ((f - centres[:, None]) / width[:, None]) ** 2) ** -2.0


def chroma_bank(n_fft: int, sample_rate: float, low: float = 27.5) -> np.ndarray:
    """Each bin from ``low`` upwards goes to the nearest pitch class, from C."""
    f = np.arange(n_fft // 2 + 1) * sample_rate / n_fft
    bank = np.zeros((12, len(f)))
    k = np.flatnonzero(f >= low)
    bank[np.round(12 * np.log2(f[k] / 440) + 69).astype(int) % 12, k] = 1
    return bank


def apply_bank(values: DataFrame, bank: np.ndarray) -> DataFrame:
    """``(clip_id, ch, frame, band, value)``: weighted sums over bins of ``value``."""
    spark = values.sparkSession
    band, at = np.nonzero(bank)
    rows = pd.DataFrame({"band": band.astype(np.int32), "bin": at.astype(np.int32), "weight": bank[band, at]})
    table = spark.createDataFrame(rows, "band int, bin int, weight double")
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
    return values.join(table, "bin").groupBy("clip_id", "ch", "frame", "band").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def _scaled(bands: DataFrame, scale: str) -> DataFrame:
    out = {"power": F.col("value"), "magnitude": F.sqrt("value"), "db": spectral.to_db(F.col("value"))}
    if scale not in out:
        raise ValueError(f"scale must be one of {sorted(out)}")
    return bands.withColumn("value", out[scale])


def banked(df: DataFrame, bank: np.ndarray, n_fft: int, hop: int, sample_rate: float, scale: str = "power", **options) -> DataFrame:
    """Band powers of a spectrogram, as power, magnitude or dB."""
    return _scaled(apply_bank(spectral.linear_spectrogram(df, n_fft, hop, sample_rate, "power", **options), bank), scale)


def mel_spectrogram(df, n_mels, n_fft, hop, sample_rate, scale="power", low=0.0, high=None, **options):
    return banked(df, mel_bank(n_mels, n_fft, sample_rate, low, high), n_fft, hop, sample_rate, scale, **options)


def loghz_spectrogram(df, n_bands, n_fft, hop, sample_rate, scale="power", low=20.0, high=None, **options):
    return banked(df, log_bank(n_bands, n_fft, sample_rate, low, high), n_fft, hop, sample_rate, scale, **options)


def gammatone_spectrogram(df, n_bands, n_fft, hop, sample_rate, scale="power", low=50.0, high=None, **options):
    return banked(df, gammatone_bank(n_bands, n_fft, sample_rate, low, high), n_fft, hop, sample_rate, scale, **options)


def chromagram(df: DataFrame, n_fft: int, hop: int, sample_rate: float, **options) -> DataFrame:
    """Power of each pitch class and frame, the loudest class of a frame at 1."""
    c = banked(df, chroma_bank(n_fft, sample_rate), n_fft, hop, sample_rate, "power", **options)
    top = F.max("value").over(spectral.GROUP())
    return c.withColumn("value", F.coalesce(F.try_divide(F.col("value"), top), F.lit(0.0)))


def mfcc(df: DataFrame, n_mfcc: int, n_mels: int, n_fft: int, hop: int, sample_rate: float, **options) -> DataFrame:
    """Orthonormal cosine transform of the mel spectrogram in dB."""
    logmel = mel_spectrogram(df, n_mels, n_fft, hop, sample_rate, "db", **options).withColumnRenamed("band", "bin")
    k, m = np.arange(n_mfcc)[:, None], np.arange(n_mels)[None, :]
    dct = np.cos(math.pi * k * (2 * m + 1) / (2 * n_mels)) * np.sqrt(2 / n_mels)
    dct[0] /= math.sqrt(2)
    return apply_bank(logmel, np.where(dct == 0, 1e-300, dct)).withColumnRenamed("band", "coefficient")


def cqt_kernels(sample_rate: float, f_min: float, bins: int, per_octave: int, longest: int) -> list[tuple[float, np.ndarray]]:
    """Frequency and windowed complex tone of each constant-Q bin; tones are no longer than ``longest``."""
    q = 1 / (2 ** (1 / per_octave) - 1)
    out = []
    for k in range(bins):
        f = f_min * 2 ** (k / per_octave)
        if f >= sample_rate / 2:
            break
        n = max(1, min(longest, int(round(q * sample_rate / f))))
        w = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n)
        out.append((f, w / w.sum() * np.exp(-2j * np.pi * f / sample_rate * np.arange(n))))
    return out


#: Samples under the tones that a task looks at in one go.
CELLS = 1 << 20


def tones(x: np.ndarray, kernels: list[tuple[float, np.ndarray]], hop: int, first: int, past: int) -> np.ndarray:
    """Constant-Q values (clips x frames x bins) of equally long clips (rows of ``x``), for frames ``[first, past)``."""
    half = max((len(k) for _, k in kernels), default=1) // 2 + 1
    low, high = first * hop - half, (past - 1) * hop + half
    near = np.pad(x[:, max(low, 0) : high], ((0, 0), (max(-low, 0), max(high - x.shape[1], 0))))
    at = np.arange(past - first) * hop + half
    s = np.empty((len(x), past - first, len(kernels)), complex)
    for b, (_, k) in enumerate(kernels):
        v = np.lib.stride_tricks.sliding_window_view(near, len(k), axis=1)[:, at - len(k) // 2] @ np.c_[k.real, k.imag]
        s[..., b] = v[..., 0] + 1j * v[..., 1]
    return s


def over_tones(df: DataFrame, kernels: list[tuple[float, np.ndarray]], hop: int, emit: Callable[[np.ndarray, int], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``(clip_id, ch, frame, *schema)`` by ``emit(values, lead)`` from constant-Q values (clips x frames x bins).

    The values come in blocks of frames; ``lead`` is 1 if the first frame is the one before the block, which ``emit`` leaves out
    of its arrays (clips x frames x rows of a frame).  Channels of one length in a batch are transformed together.
    """
    longest = max((len(k) for _, k in kernels), default=1)
    names = [f.split()[0] for f in schema.split(", ")]

    def blocks(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        for n in np.unique(lengths[lengths > 0]):
            rows, frames = np.flatnonzero(lengths == n), -(-int(n) // hop)
            clips, step = max(1, CELLS // (frames * longest)), max(1, CELLS // longest)
            for r in range(0, len(rows), clips):
                for a in range(0, frames, step):
                    yield rows[r : r + clips], a, min(a + step, frames)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            channels = list(arrays_of(batch))
            for rows, a, e in blocks(np.array([len(x) for x in channels], np.int64)):
                lead = min(a, 1)
                found = emit(tones(np.stack([channels[r] for r in rows]).astype(float), kernels, hop, a - lead, e), lead)
                wide = found[names[0]].shape[2]
                back = pa.array(np.repeat(rows, (e - a) * wide))
                frame = np.tile(np.repeat(np.arange(a, e), wide), len(rows))
                columns = [pa.array(found[n].ravel(), from_pandas=True) for n in names]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(back), batch.column(1).take(back), pa.array(frame), *columns], ["clip_id", "ch", "frame", *names])

    return channel_arrays(df).mapInArrow(each, f"clip_id long, ch int, frame long, {schema}")


def constant_q(df: DataFrame, f_min: float, bins: int, hop: int, sample_rate: float, per_octave: int = 12, longest: int | None = None) -> DataFrame:
    """Complex constant-Q transform at every hop, tones centred on it: spectrum form."""
    kernels = cqt_kernels(sample_rate, f_min, bins, per_octave, longest or int(4 * sample_rate / f_min))
    freq = np.array([f for f, _ in kernels])

    def spectrum(s: np.ndarray, lead: int) -> dict[str, np.ndarray]:
        s = s[:, lead:]
        return {"bin": np.broadcast_to(np.arange(len(freq), dtype=np.int32), s.shape), "freq_hz": np.broadcast_to(freq, s.shape), "re": s.real, "im": s.imag}

    return over_tones(df, kernels, hop, spectrum, "bin int, freq_hz double, re double, im double")


def cqt_spectrogram(df: DataFrame, f_min: float, bins: int, hop: int, sample_rate: float, scale: str = "power", **options) -> DataFrame:
    """Constant-Q transform as power, magnitude or dB."""
    s = constant_q(df, f_min, bins, hop, sample_rate, **options)
    return s.select("clip_id", "ch", "frame", "bin", "freq_hz", spectral.AMPLITUDES[scale]().alias("value"))
