"""Editing in time: filters, shifted indices and unions.  Seconds become samples by truncation here."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplefield.functions import draws
from ripplefield.operators.chunks import Piece, cut, map_pieces, recursive_filter
from ripplefield.operators.clipwise import with_clip
from ripplefield.operators.overlap import overlap_add, synthesis


def N() -> Column:
    """Samples per channel, where ``_sized`` has added them."""
    return F.col("n__")


def _sized(df: DataFrame) -> DataFrame:
    return with_clip(df, n__=F.max("idx") + 1)


def _stop(message: str, kind: str = "long") -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def samples_of(seconds: float, sample_rate: float) -> int:
    """Whole samples of a time, truncated."""
    return int(seconds * sample_rate)


def reverse(df: DataFrame) -> DataFrame:
    return _sized(df).select("clip_id", "ch", (N() - 1 - F.col("idx")).alias("idx"), "v")


def trim(df: DataFrame, start: float, end: float, sample_rate: float) -> DataFrame:
    """Samples between two times; a range that leaves a clip stops the query."""
    if start < 0 or end <= start:
        raise ValueError("the range must be ordered and not negative")
    a, b = samples_of(start, sample_rate), samples_of(end, sample_rate)
    idx = F.when(N() >= end * sample_rate, F.col("idx") - a).otherwise(_stop("the range leaves the clip"))
    return _sized(df).where(F.col("idx").between(a, b - 1)).select("clip_id", "ch", idx.alias("idx"), "v")


def pad(df: DataFrame, before: float, after: float, sample_rate: float, value: float = 0.0) -> DataFrame:
    """Constant samples before and after."""
    if before < 0 or after < 0:
        raise ValueError("padding must not be negative")
    return pad_samples(df, samples_of(before, sample_rate), samples_of(after, sample_rate), value)


def pad_samples(df: DataFrame, before: int, after: int | Column, value: float = 0.0) -> DataFrame:
    """Constant samples before and after, by count; ``after`` may depend on the clip's length ``n__``."""
    sized = _sized(df)
    moved = sized.select("clip_id", "ch", (F.col("idx") + before).alias("idx"), "v")
    at_start = sized.where("idx = 0").withColumn("k__", (after if isinstance(after, Column) else F.lit(after)).cast("long"))
    lead = at_start.where(F.lit(before) > 0).select("clip_id", "ch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(before - 1, 0)).cast("long"))).alias("idx"), F.lit(float(value)).alias("v"))
    tail = at_start.where("k__ > 0").select("clip_id", "ch", F.explode(F.sequence(N() + before, N() + before + F.col("k__") - 1)).alias("idx"), F.lit(float(value)).alias("v"))
    return moved.unionByName(lead).unionByName(tail)


def pad_samples_right(df: DataFrame, target: int, value: float = 0.0) -> DataFrame:
    """At least ``target`` samples."""
    return pad_samples(df, 0, F.greatest(F.lit(target) - N(), F.lit(0)), value)


def pad_to_duration(df: DataFrame, seconds: float, sample_rate: float, value: float = 0.0, side: str = "right") -> DataFrame:
    """At least a duration, filled on the right or the left."""
    if side not in ("left", "right"):
        raise ValueError("side must be left or right")
    target = samples_of(seconds, sample_rate)
    out = pad_samples_right(df, target, value)
    if side == "right":
        return out
    own = df.groupBy("clip_id").agg((F.max("idx") + 1).alias("own__"))
    shift = F.greatest(F.lit(target) - F.col("own__"), F.lit(0))
    placed = F.when(F.col("idx") < F.col("own__"), F.col("idx") + shift).otherwise(F.col("idx") - F.col("own__"))
    return out.join(own, "clip_id").select("clip_id", "ch", placed.alias("idx"), "v")


def split(df: DataFrame, seconds: float, sample_rate: float) -> DataFrame:
    """Segments of a length, the last may be short: adds ``segment``; a clip shorter than one stops the query."""
    size = samples_of(seconds, sample_rate)
    if size < 1:
        raise ValueError("a segment needs samples")
    segment = F.when(N() >= size, F.floor(F.col("idx") / size)).otherwise(_stop("segment longer than the clip"))
    return _sized(df).select("clip_id", "ch", segment.cast("long").alias("segment"), F.pmod("idx", F.lit(size)).alias("idx"), "v")


def concatenate(parts: Sequence[DataFrame]) -> DataFrame:
    """Clips of the same id one after the other; all parts need the same channels."""
    if not parts:
        raise ValueError("nothing to concatenate")
    tagged = reduce(DataFrame.unionByName, (p.select("clip_id", "ch", "idx", "v").withColumn("part", F.lit(k)) for k, p in enumerate(parts)))
    lengths = tagged.groupBy("clip_id", "part").agg((F.max("idx") + 1).alias("n"), (F.max("ch") + 1).alias("c"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("clip_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.min("c").over(Window.partitionBy("clip_id")) == F.max("c").over(Window.partitionBy("clip_id"))  # rows are parts
    offsets = lengths.select("clip_id", "part", F.when(same, before).otherwise(_stop("parts differ in channels")).alias("at"))
    return tagged.join(offsets, ["clip_id", "part"]).select("clip_id", "ch", (F.col("idx") + F.col("at")).alias("idx"), "v")


def mix(sources: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted sum of clips of one shape (default 1 / count); other shapes stop the query."""
    if not sources or (weights is not None and len(weights) != len(sources)):
        raise ValueError("one weight a source")
    w = weights or [1 / len(sources)] * len(sources)
    both = reduce(DataFrame.unionByName, (s.select("clip_id", "ch", "idx", (F.col("v") * F.lit(float(x))).alias("v")) for s, x in zip(sources, w, strict=True)))
    summed = both.groupBy("clip_id", "ch", "idx").agg(F.sum("v").alias("v"), F.count("*").alias("k"))
    return summed.select("clip_id", "ch", "idx", F.when(F.col("k") == len(sources), F.col("v")).otherwise(_stop("clips differ in shape", "double")).alias("v"))


CURVES = {
    "linear": lambda p: p,
    "exponential": lambda p: p * p,
    "logarithmic": lambda p: F.log1p(p) / math.log(2),
    "smoothstep": lambda p: p * p * (3 - 2 * p),
}


def _curve(name: str):
    if name not in CURVES:
        raise ValueError(f"curve must be one of {sorted(CURVES)}")
    return CURVES[name]


def fade_in(df: DataFrame, seconds: float, sample_rate: float, curve: str = "linear") -> DataFrame:
    """Gain g(i / n) over the first n samples."""
    if seconds <= 0:
        raise ValueError("the duration must be positive")
    n = F.least(F.lit(samples_of(seconds, sample_rate)), N())
    return _sized(df).withColumn("v", F.when(F.col("idx") < n, F.col("v") * _curve(curve)(F.col("idx") / n)).otherwise(F.col("v"))).drop("n__")


def fade_out(df: DataFrame, seconds: float, sample_rate: float, curve: str = "linear") -> DataFrame:
    """Gain g(1 - i / n) over the last n samples, so the last one keeps g(1 / n)."""
    if seconds <= 0:
        raise ValueError("the duration must be positive")
    n = F.least(F.lit(samples_of(seconds, sample_rate)), N())
    i = F.col("idx") - (N() - n)
    return _sized(df).withColumn("v", F.when(i >= 0, F.col("v") * _curve(curve)(1 - i / n)).otherwise(F.col("v"))).drop("n__")


def repeat(df: DataFrame, count: int) -> DataFrame:
    if count < 1:
        raise ValueError("at least once")
    dealt = _sized(df).withColumn("k__", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return dealt.select("clip_id", "ch", (F.col("idx") + F.col("k__") * N()).alias("idx"), "v")


def _threshold(db: float) -> float:
    return 10 ** (db / 20)


def trim_silence(df: DataFrame, threshold_db: float) -> DataFrame:
    """Drop leading and trailing instants at which no channel exceeds the threshold; all silent: zeros stay."""
    loud = F.when(F.abs("v") > _threshold(threshold_db), F.col("idx"))
    marked = with_clip(df, a__=F.min(loud), b__=F.max(loud))
    a = F.coalesce("a__", F.lit(0))
    keep = F.col("a__").isNull() | F.col("idx").between(F.col("a__"), F.col("b__"))
    v = F.when(F.col("a__").isNull(), F.lit(0.0)).otherwise(F.col("v"))
    return marked.where(keep).select("clip_id", "ch", (F.col("idx") - a).alias("idx"), v.alias("v"))


def silence_runs(df: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """Runs of instants at which all channels are silent: ``(clip_id, start, end)`` by gaps and islands."""
    v = F.max(F.abs("v"))
    one = df.groupBy("clip_id", "idx").agg((v < threshold if strict else v <= threshold).alias("quiet"))
    order = Window.partitionBy("clip_id").orderBy("idx")
    quiet = one.where("quiet").withColumn("g", F.col("idx") - F.row_number().over(order))
    return quiet.groupBy("clip_id", "g").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end")).drop("g")


def trim_all_silence(df: DataFrame, threshold_db: float, min_seconds: float, sample_rate: float) -> DataFrame:
    """Remove every silence of at least a duration, wherever it lies; what is left is closed up."""
    least = samples_of(min_seconds, sample_rate)
    order = Window.partitionBy("clip_id").orderBy("idx")
    one = df.groupBy("clip_id", "idx").agg((F.max(F.abs("v")) <= _threshold(threshold_db)).alias("quiet"))
    runs = one.withColumn("g", F.col("idx") - F.row_number().over(Window.partitionBy("clip_id", "quiet").orderBy("idx")))
    run = F.count("*").over(Window.partitionBy("clip_id", "quiet", "g"))
    kept = runs.withColumn("run", run).where(~F.col("quiet") | (F.col("run") < least))
    placed = kept.select("clip_id", "idx", (F.row_number().over(order) - 1).cast("long").alias("to"))
    return df.join(placed, ["clip_id", "idx"]).select("clip_id", "ch", F.col("to").alias("idx"), "v")


def add_noise(df: DataFrame, snr_db: float, color: str = "white", seed: int = 0, compat: bool = False) -> DataFrame:
    """Noise at a signal-to-noise ratio: Gaussian of that RMS; ``compat`` is uniform with that amplitude."""
    if not -60 <= snr_db <= 60:
        raise ValueError("the ratio lies in [-60, 60] dB")
    keys = (seed, F.col("clip_id"), F.col("ch"), F.col("idx"))
    df = with_clip(df, p__=F.avg(F.col("v") * F.col("v")))
    level = F.sqrt("p__") * 10 ** (-snr_db / 20)
    if color == "white":
        return df.withColumn("v", F.col("v") + level * ((2 * draws.uniform(*keys) - 1) if compat else draws.gaussian(*keys))).drop("p__")
    if color not in ("pink", "brown"):
        raise ValueError("color must be white, pink or brown")
    poles = {"pink": 0.95, "brown": 0.999}[color]
    one_pole = np.array([[math.sqrt(1 - poles**2), 0.0, 0.0, 1.0, -poles, 0.0]])
    noise = recursive_filter(df.withColumn("v", draws.gaussian(*keys)), one_pole)
    both = df.withColumn("l__", level).join(noise.withColumnRenamed("v", "w__"), ["clip_id", "ch", "idx"])
    return both.select("clip_id", "ch", "idx", (F.col("v") + F.col("l__") * F.col("w__")).alias("v"))


def random_gain(df: DataFrame, low_db: float, high_db: float, seed: int = 0) -> DataFrame:
    """One gain per clip, drawn by its id and the seed."""
    if not -40 <= low_db <= high_db <= 20:
        raise ValueError("gains lie in [-40, 20] dB")
    u = draws.uniform(seed, F.col("clip_id"))
    return df.withColumn("v", F.col("v") * F.pow(F.lit(10.0), (low_db + u * (high_db - low_db)) / 20))


def pitch_shift(df: DataFrame, semitones: float, n_fft: int = 2048, hop: int = 512, preserve_formants: bool = False, frames: int = 256) -> DataFrame:
    """Phase-vocoder shift of every channel; the length stays.

    Phases accumulate by bin: each chunk of frames sums its steps, a running sum over the chunks of every bin gives the
    phases that a chunk begins with, and frames are then synthesised in parallel and overlapped.
    """
    if abs(semitones) > 12:
        raise ValueError("at most an octave")
    if abs(semitones) < 1e-6:
        return df
    voice = Vocoder(2 ** (semitones / 12), n_fft, hop, preserve_formants, max(frames, n_fft // hop + 2))
    moved = df.select("clip_id", "ch", (F.col("idx") + n_fft // 2).alias("idx"), "v")
    arrays = cut(moved, voice.frames * hop, hop, n_fft)
    steps = map_pieces(arrays, lambda p: {"s": np.fmod(voice.steps(p).sum(axis=0), 2 * np.pi)}, "s array<double>")
    by_bin = steps.select("key", "chunk", F.posexplode("s").alias("bin", "s"))
    so_far = Window.partitionBy("key", "bin").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bin.withColumn("z", F.coalesce(F.sum("s").over(so_far), F.lit(0.0))).groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("bin", "z"))).alias("z"))
    met = arrays.join(starts.select("key", "chunk", F.col("z.z").alias("z")), ["key", "chunk"])
    sums = overlap_add(met, voice.synthesis, voice.window, hop)
    out = synthesis(sums, 1e-9, n_fft // 2, 0, floor=True)
    sized = with_clip(out, ("clip_id", "ch"), source=df, n__=F.max("idx") + 1)
    return sized.where(F.col("idx") < F.col("n__")).drop("n__")


def envelope_of(magnitude: np.ndarray) -> np.ndarray:
    """Moving average of a magnitude spectrum over a fiftieth of its bins, held in 10..40."""
    w = int(np.clip(len(magnitude) // 50, 10, 40))
    padded = np.pad(magnitude, (w // 2, w - 1 - w // 2), mode="edge")
    return np.convolve(padded, np.ones(w) / w, "valid")


class Vocoder:
    """Moves the bins of each frame by a ratio, with phases accumulated at the new frequencies; works on chunks of frames."""

    def __init__(self, ratio: float, n_fft: int, hop: int, formants: bool, frames: int):
        self.n_fft, self.hop, self.formants, self.frames, self.ratio = n_fft, hop, formants, frames, ratio
        self.window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
        bins = np.arange(n_fft // 2 + 1)
        self.expected = 2 * np.pi * hop * bins / n_fft
        self.target = np.round(bins * ratio).astype(int)
        self.inside = self.target < len(bins)

    def spectra(self, p: Piece) -> tuple[int, np.ndarray, np.ndarray]:
        """The first frame's number, the magnitudes of a chunk's frames, and the phases of these and the one before."""
        number, x = p.row["chunk"] * self.frames, p.arrays["v"]
        low, at = (number - 1) * self.hop, p.row["first"] - p.row["skip"]
        end = at + len(x)
        count = min(self.frames, -(-(end - number * self.hop) // self.hop))
        padded = np.zeros((count + 1) * self.hop + self.n_fft)
        inside = min(end, low + len(padded)) - at
        padded[at - low : at - low + inside] = x[:inside]
        view = np.lib.stride_tricks.sliding_window_view(padded, self.n_fft)[:: self.hop][: count + 1]
        s = np.fft.rfft(view * self.window, axis=1)
        return number, np.abs(s[1:]), np.angle(s)

    def _steps(self, number: int, phase: np.ndarray) -> np.ndarray:
        drift = np.angle(np.exp(1j * (np.diff(phase, axis=0) - self.expected)))
        out = np.zeros_like(drift)
        out[:, self.target[self.inside]] = ((self.expected + drift) * self.ratio)[:, self.inside]
        if number == 0:
            out[0] = phase[1]  # the first frame keeps its phases
        return out

    def steps(self, p: Piece) -> np.ndarray:
        """What each frame adds to the phases."""
        number, _, phase = self.spectra(p)
        return self._steps(number, phase)

    def synthesis(self, p: Piece) -> tuple[int, np.ndarray]:
        """Frames with moved bins and true phases."""
        number, magnitude, phase = self.spectra(p)
        total = np.cumsum(self._steps(number, phase), axis=0) + p.arrays["z"]
        moved = np.zeros_like(magnitude)
        for source, target in zip(np.flatnonzero(self.inside), self.target[self.inside], strict=True):
            moved[:, target] += magnitude[:, source]
        if self.formants:
            moved = np.array([m * envelope_of(own) / np.maximum(envelope_of(m), 1e-12) for m, own in zip(moved, magnitude, strict=True)])
        return number, np.fft.irfft(moved * np.exp(1j * total), self.n_fft, axis=1)


def perturb(df: DataFrame, method: str, sample_rate: float = 44100.0, seed: int = 0, **options) -> DataFrame:
    """Augmentation by name: noise, gain, high_pass, low_pass or pitch_shift."""
    from ripplefield.operators import elementwise

    table = {
        "noise": lambda: add_noise(df, seed=seed, **options),
        "gain": lambda: random_gain(df, seed=seed, **options),
        "high_pass": lambda: elementwise.high_pass(df, sample_rate=sample_rate, **options),
        "low_pass": lambda: elementwise.low_pass(df, sample_rate=sample_rate, **options),
        "pitch_shift": lambda: pitch_shift(df, **options),
    }
    if method not in table:
        raise ValueError(f"method must be one of {sorted(table)}")
    return table[method]()
