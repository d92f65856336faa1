"""Codecs: a perceptual transform codec, a linear-prediction speech codec, and a codec that chooses per frame.

Frames of a channel depend on the ones before (prediction history, overlaps), so a channel is one row with an ordered
array; Arrow batches hold many clips.  Encoded audio is rows of integers.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefield.operators.kernels import arrays_of, channel_arrays
from ripplefield.operators.psycho import PRESETS, SELF_MASKING_DB, TONAL_DB, Masking, band_layout
from ripplefield.operators.quantise import MAX_WORD
from ripplefield.operators.recurrence import biquad


# --- lapped transform -------------------------------------------------------------------------------------

@functools.lru_cache(maxsize=32)
def mdct_basis(half: int) -> np.ndarray:
    """Windowed cosine basis (2 half x half) of the lapped transform with the sine window."""
    n = np.arange(2 * half)
    window = np.sin(np.pi * (n + 0.5) / (2 * half))
    phase = np.pi / half * np.outer(n + 0.5 + half / 2, np.arange(half) + 0.5)
    return window[:, None] * np.cos(phase) * np.sqrt(2 / half)


def mdct(x: np.ndarray, half: int) -> np.ndarray:
    """Coefficients (frames x half); half a frame of zeros at both ends makes it invertible."""
    frames = -(-len(x) // half) + 1
    padded = np.zeros((frames + 1) * half)
    padded[half : half + len(x)] = x
    view = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)[::half]
    return view @ mdct_basis(half)


def imdct(c: np.ndarray, half: int, length: int) -> np.ndarray:
    """Overlap-add inverse of ``mdct``."""
    frames = c @ mdct_basis(half).T
    out = np.zeros((len(c) + 1) * half)
    for k, f in enumerate(frames):
        out[k * half : (k + 2) * half] += f
    return out[half : half + length]


# --- batches of coded rows --------------------------------------------------------------------------------

#: Rows of a batch that are coded before their result is handed on.
RUN = 64
SEGMENT = {"length": pa.int32(), "frames": pa.int32(), "steps": pa.list_(pa.float64()), "q": pa.list_(pa.int32())}
PART = {"mode": pa.string(), "a": pa.list_(pa.float64()), "step": pa.list_(pa.float64()), "q": pa.list_(pa.int32())}


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in short runs of rows, so that what a task holds of results stays small."""
    return (batch.slice(a, RUN) for a in range(0, batch.num_rows, RUN))


def _long(rows: pa.RecordBatch, found: list[np.ndarray], first: list[int]) -> pa.RecordBatch:
    """Long form of one array a row, numbered from ``first``."""
    back = pa.array(np.repeat(np.arange(len(found)), [len(v) for v in found]))
    idx = np.concatenate([a + np.arange(len(v)) for a, v in zip(first, found, strict=True)])
    return pa.RecordBatch.from_arrays([rows.column(0).take(back), rows.column(1).take(back), pa.array(idx, pa.int64()), pa.array(np.concatenate(found), from_pandas=True)], ["clip_id", "ch", "idx", "v"])


# --- perceptual codec -------------------------------------------------------------------------------------

@functools.lru_cache(maxsize=32)
def _bands(kind: str, bands: int, sample_rate: int, half: int) -> tuple[tuple, np.ndarray, np.ndarray]:
    """A layout, the band of each bin, and how many bins are of each band."""
    layout = tuple(band_layout(kind, bands, sample_rate, half))
    of = np.zeros(half, int)
    for k, s, e, _, _ in layout:
        of[s:e] = k
    return layout, of, np.bincount(of, minlength=len(layout))


@functools.lru_cache(maxsize=32)
def _masks(layout: tuple, cfg: Masking, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What masking takes from the layout alone: means over bins, slopes between bands, threshold in quiet."""
    mean = np.zeros((len(layout), half))
    for k, s, e, _, _ in layout:
        mean[k, s:e] = 1 / (e - s)
    centre = np.array([b[3] for b in layout])
    z = np.maximum(26.81 * centre / (1960 + centre) - 0.53, 0)
    dz = z[None, :] - z[:, None]
    k = np.maximum(centre, 1e-9) / 1000
    quiet = np.clip(3.64 * k**-0.8 - 6.5 * np.exp(-0.6 * (k - 3.3) ** 2) + 1e-3 * k**4, -20, 60)
    return mean, np.where(dz >= 0, cfg.up * dz, -cfg.down * dz), quiet


def analyse(c: np.ndarray, layout, cfg: Masking) -> tuple[np.ndarray, np.ndarray]:
    """Band energies and masking thresholds in dB from mean bin power."""
    mean, slopes, quiet = _masks(tuple(layout), cfg, c.shape[1])
    energy = 10 * np.log10(mean @ (c * c).mean(axis=0) + cfg.eps)
    left, right = np.r_[np.nan, energy[:-1]], np.r_[energy[1:], np.nan]
    near = np.where(np.isnan(left), right, np.where(np.isnan(right), left, (left + right) / 2))
    tonal = energy - np.where(np.isnan(near), energy, near) >= TONAL_DB
    loss = np.where(tonal, cfg.tonal_gain, cfg.noise_gain)[:, None] + slopes
    np.fill_diagonal(loss, SELF_MASKING_DB)
    return energy, np.maximum((energy[:, None] - loss).max(axis=0), quiet)


@dataclass(frozen=True)
class PerceptualCodec:
    """Transform codec at a bit rate: bits by energy and importance, steps by the bands' variances."""

    sample_rate: int
    bit_rate: int = 128_000
    half: int = 512
    bands: int = 24
    layout: str = "bark"
    masking: str = "mpeg1"
    segment: int = 44_100

    def encode_segment(self, x: np.ndarray) -> dict:
        c = mdct(x, self.half)
        layout, of, count = _bands(self.layout, self.bands, self.sample_rate, self.half)
        energy, threshold = analyse(c, layout, PRESETS[self.masking])
        weight = 10 ** (energy / 10) * (1 + np.maximum(energy - threshold, 0))
        budget = self.bit_rate * len(x) / self.sample_rate
        bits = np.round(weight / max(weight.sum(), 1e-300) * budget)
        n = count * len(c)
        var = np.bincount(of, weights=(c * c).mean(axis=0), minlength=len(layout)) / np.maximum(count, 1)
        peak = np.zeros(len(layout))
        np.maximum.at(peak, of, np.abs(c).max(axis=0, initial=0))
        rate = bits.sum() / max(n.sum(), 1)
        log_var = np.log2(np.where(var > 0, var, 1.0))
        mean = log_var[var > 0].mean() if (var > 0).any() else 0.0
        w = np.clip(rate + 0.5 * (log_var - mean), 0, MAX_WORD)
        coarse = (w < 0.5) | (var <= 0)
        step = np.maximum(2 * peak / np.where(coarse, 1.0, 2.0**w), 1e-6)
        top = np.where(coarse, 0, 2.0 ** np.minimum(np.ceil(w), MAX_WORD) - 1)
        q = np.clip(np.round(c / step[of]), -top[of], top[of]).astype(np.int32)
        return {"length": len(x), "frames": len(c), "steps": step.tolist(), "q": q.ravel().tolist()}

    def decode_segment(self, length: int, frames: int, steps: np.ndarray, q: np.ndarray) -> np.ndarray:
        of = _bands(self.layout, self.bands, self.sample_rate, self.half)[1]
        return imdct(np.asarray(q, float).reshape(frames, self.half) * np.asarray(steps, float)[of], self.half, length)

    def encode(self, df: DataFrame) -> DataFrame:
        """``(clip_id, ch, segment, length, frames, steps, q)``; segments are coded apart, so a long clip is many tasks."""
        codec = self

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows in _runs(b):
                    found = [codec.encode_segment(x) for x in arrays_of(rows, 3)]
                    columns = [pa.array([f[n] for f in found], kind) for n, kind in SEGMENT.items()]
                    yield pa.RecordBatch.from_arrays([*rows.columns[:3], *columns], ["clip_id", "ch", "segment", *SEGMENT])

        cut = df.select("clip_id", "ch", "idx", F.col("v").cast("double").alias("v"), F.floor(F.col("idx") / self.segment).cast("int").alias("segment"))
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"])
        arrays = cut.groupBy("clip_id", "ch", "segment").agg(ordered.alias("w")).select(F.col("clip_id").cast("long").alias("clip_id"), F.col("ch").cast("int").alias("ch"), "segment", "w")
        return arrays.mapInArrow(each, "clip_id long, ch int, segment int, length int, frames int, steps array<double>, q array<int>")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """Long form of encoded clips; every segment where it lies."""
        codec = self

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows in _runs(b):
                    sizes = zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), arrays_of(rows, 5), arrays_of(rows, 6), strict=True)
                    found = [codec.decode_segment(*s) for s in sizes]
                    yield _long(rows, found, [codec.segment * s for s in rows.column(2).to_pylist()])

        return encoded.select("clip_id", "ch", "segment", "length", "frames", "steps", "q").mapInArrow(each, "clip_id long, ch int, idx long, v double")


# --- linear prediction ------------------------------------------------------------------------------------

def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    """Of the Hamming-windowed frame, for lags 0..lags."""
    n = len(x)
    w = x * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1)))
    return np.array([w[: n - k] @ w[k:] if k < n else 0.0 for k in range(lags + 1)])


def levinson_durbin(r: np.ndarray, order: int, loading: float = 1e-5) -> tuple[np.ndarray, float] | None:
    """Predictor coefficients and residual energy; None for silence."""
    if r[0] <= 0:
        return None
    a, err = np.zeros(order), r[0] * (1 + loading)
    for k in range(order):
        reflect = (r[k + 1] - a[:k] @ r[k:0:-1]) / err
        a[:k] -= reflect * a[:k][::-1]
        a[k] = reflect
        err *= 1 - reflect * reflect
    return a, float(err)


def lpc_analysis(x: np.ndarray, order: int) -> np.ndarray:
    """Predictor of order min(order, n / 2); zeros for silence."""
    order = min(order, len(x) // 2)
    found = levinson_durbin(autocorrelation(x, order), order) if order else None
    return found[0] if found else np.zeros(order)


def lpc_residual(x: np.ndarray, a: np.ndarray, history: np.ndarray | None = None) -> np.ndarray:
    """Prediction error; ``history`` holds the samples before the frame, oldest first."""
    p = len(a)
    if not p or not len(x):
        return np.array(x, float)
    both = np.r_[np.zeros(p), np.empty(0) if history is None else history][-p:]
    return x - np.convolve(np.r_[both, x], a)[p - 1 : p - 1 + len(x)]


def lpc_synthesis(e: np.ndarray, a: np.ndarray, history: np.ndarray | None = None) -> np.ndarray:
    """Inverse of ``lpc_residual``."""
    p = len(a)
    both = np.r_[np.zeros(p) if history is None else np.r_[np.zeros(p), history][-p:] if p else np.empty(0), np.zeros(len(e))]
    for i, v in enumerate(e):
        both[p + i] = v + (a @ both[i : i + p][::-1] if p else 0.0)
    return both[p:]


def estimate_pitch(x: np.ndarray, sample_rate: int, least: float = 0.3) -> tuple[int, float] | None:
    """Lag and normalised correlation of the strongest period within 50..500 Hz; None below ``least``."""
    low, high = max(1, sample_rate // 500), min(len(x) - 1, sample_rate // 50)
    if high < low:
        return None
    size = 1 << (2 * len(x) - 1).bit_length()
    spectrum = np.fft.rfft(x, size)
    r = np.fft.irfft(spectrum * spectrum.conj(), size)[low : high + 1]
    total = np.cumsum(np.r_[0.0, x * x])
    lags = np.arange(low, high + 1)
    norm = np.sqrt((total[-1] - total[lags]) * total[len(x) - lags])
    r = np.where(norm > 1e-12 * total[-1], r / np.where(norm > 0, norm, 1), 0.0)
    k = int(np.argmax(r))
    return (low + k, float(r[k])) if r[k] >= least else None


def ltp_residual(x: np.ndarray, lag: int, gain: float) -> np.ndarray:
    """Long-term prediction error."""
    return x - gain * np.r_[np.zeros(min(lag, len(x))), x[:-lag] if lag < len(x) else []]


def ltp_synthesis(e: np.ndarray, lag: int, gain: float) -> np.ndarray:
    """Inverse of ``ltp_residual``."""
    y = np.array(e, float)
    for at in range(lag, len(y), lag):  # a whole lag at a time
        part = y[at : at + lag]
        part += gain * y[at - lag : at - lag + len(part)]
    return y


# --- frames of speech, music and both ---------------------------------------------------------------------

ORDER, LEVELS = 16, 32767


def speech_encode(x: np.ndarray, history: np.ndarray) -> dict:
    """Predictor and scaled 16-bit residual of a frame."""
    a = lpc_analysis(x, ORDER)
    e = lpc_residual(x, a, history)
    scale = float(np.abs(e).max(initial=0)) / LEVELS or 1.0
    return {"mode": "speech", "a": a.tolist(), "step": [scale], "q": np.round(e / scale).astype(int).tolist()}


def speech_decode(f, history: np.ndarray) -> np.ndarray:
    return lpc_synthesis(np.asarray(f["q"], float) * f["step"][0], np.asarray(f["a"], float), history)


def music_encode(x: np.ndarray, codec: PerceptualCodec) -> dict:
    s = codec.encode_segment(x)
    return {"mode": "music", "a": [], "step": s["steps"], "q": s["q"]}


def music_decode(f, n: int, codec: PerceptualCodec) -> np.ndarray:
    return codec.decode_segment(n, len(f["q"]) // codec.half, f["step"], f["q"])


def crossover(x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """One-pole low part and what it leaves."""
    low = biquad(x, (alpha, 0.0, 0.0), (1.0, alpha - 1, 0.0))[0]
    return low, x - low


def detect_mode(x: np.ndarray, bandwidth: str = "full") -> str:
    """Narrow bands are speech; else flatness of the energies of eight stretches: above 0.8 music, below 0.4 speech, else both."""
    if bandwidth in ("narrow", "medium", "wide"):
        return "speech"
    size = len(x) // 8
    if len(x) < 4 or size == 0:
        return "music"
    e = (x[: 8 * size].reshape(8, size) ** 2).sum(axis=1) + 1e-10
    flat = np.exp(np.log(e).mean()) / e.mean()
    return "music" if flat > 0.8 else "speech" if flat < 0.4 else "hybrid"


def frame_size(sample_rate: int, ms: float) -> int:
    """Samples of a frame: rounded, even, at least 4."""
    n = int(np.floor(sample_rate * ms / 1000 + 0.5))
    return max(4, n - n % 2)


@dataclass(frozen=True)
class FrameCodec:
    """20 ms frames, each coded as speech, music or both, with the prediction history carried in order."""

    sample_rate: int
    bit_rate: int = 64_000
    frame_ms: float = 20.0
    bandwidth: str = "full"
    mode: str | None = None

    def _music(self) -> PerceptualCodec:
        return PerceptualCodec(self.sample_rate, self.bit_rate, max(2, frame_size(self.sample_rate, self.frame_ms) // 2), 21, "celt")

    def encode_channel(self, x: np.ndarray) -> list[dict]:
        n, music, history, out = frame_size(self.sample_rate, self.frame_ms), self._music(), np.zeros(ORDER), []
        alpha = 1 - np.exp(-2 * np.pi * min(8000, self.sample_rate / 4) / self.sample_rate)
        for start in range(0, len(x), n):
            f = np.zeros(n)
            f[: len(x[start : start + n])] = x[start : start + n]
            mode = self.mode or detect_mode(f, self.bandwidth)
            if mode == "speech":
                parts = [speech_encode(f, history)]
            elif mode == "music":
                parts = [music_encode(f, music)]
            else:
                low, high = crossover(f, alpha)
                parts = [speech_encode(low, history), music_encode(high, music)]
            heard = self.decode_frame(parts, n, history, music)
            history = np.r_[history, heard[0]][-ORDER:] if heard[0] is not None else np.zeros(ORDER)
            out.append(parts)
        return out

    def decode_frame(self, parts: list[dict], n: int, history: np.ndarray, music: PerceptualCodec):
        """The decoded speech part (None if there is none) and the whole frame."""
        speech = next((speech_decode(p, history) for p in parts if p["mode"] == "speech"), None)
        rest = next((music_decode(p, n, music) for p in parts if p["mode"] == "music"), None)
        return speech, sum(p for p in (speech, rest) if p is not None)

    def encode(self, df: DataFrame) -> DataFrame:
        """``(clip_id, ch, frame, part, length, mode, a, step, q)``."""
        codec = self

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows in _runs(b):
                    found = [(r, k, j, len(x), p) for r, x in enumerate(arrays_of(rows)) for k, parts in enumerate(codec.encode_channel(x)) for j, p in enumerate(parts)]
                    back = pa.array([r for r, *_ in found], pa.int64())
                    numbers = [pa.array([f[c] for f in found], pa.int32()) for c in (1, 2, 3)]
                    columns = [pa.array([p[n] for *_, p in found], kind) for n, kind in PART.items()]
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(back), rows.column(1).take(back), *numbers, *columns], ["clip_id", "ch", "frame", "part", "length", *PART])

        return channel_arrays(df).select("clip_id", F.col("ch").cast("int").alias("ch"), "w").mapInArrow(each, "clip_id long, ch int, frame int, part int, length int, mode string, a array<double>, step array<double>, q array<int>")

    def decode_channel(self, length: int, rows: list[dict]) -> np.ndarray:
        """The samples of a channel from its parts in order of frames."""
        n, music, history, out = frame_size(self.sample_rate, self.frame_ms), self._music(), np.zeros(ORDER), []
        for _, parts in itertools.groupby(rows, key=lambda p: p["frame"]):
            speech, whole = self.decode_frame(list(parts), n, history, music)
            history = np.r_[history, speech][-ORDER:] if speech is not None else np.zeros(ORDER)
            out.append(whole)
        return np.concatenate(out)[:length]

    def decode(self, encoded: DataFrame) -> DataFrame:
        """Long form of encoded clips."""
        codec = self

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows in _runs(b):
                    found = [codec.decode_channel(n, parts.as_py()) for n, parts in zip(rows.column(2).to_pylist(), rows.column(3), strict=True)]
                    yield _long(rows, found, [0] * len(found))

        parts = F.sort_array(F.collect_list(F.struct("frame", "part", "mode", "a", "step", "q")))
        arrays = encoded.groupBy("clip_id", "ch").agg(F.max("length").alias("length"), parts.alias("parts"))
        return arrays.mapInArrow(each, "clip_id long, ch int, idx long, v double")


def stereo_encode(df: DataFrame, codec) -> DataFrame:
    """Mid and side of stereo clips, each coded as a channel."""
    from ripplefield.operators.channels import mid_side
    from ripplefield.operators.container import require_channels

    return codec.encode(mid_side(require_channels(df, 2)))


def stereo_decode(encoded: DataFrame, codec) -> DataFrame:
    from ripplefield.operators.channels import left_right

    return left_right(codec.decode(encoded))


def round_trip_snr(df: DataFrame, codec) -> DataFrame:
    """Signal-to-noise ratio of decoding what was encoded, per clip."""
    from ripplefield.operators.compare import snr
    from ripplefield.operators.container import arithmetic

    return snr(df, arithmetic(df, codec.decode(codec.encode(df)), "-"))
