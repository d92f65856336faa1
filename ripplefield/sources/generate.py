"""Signal generators: ranges with projections, so that any length is made in parallel without a shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplefield.functions import draws

TAU = 2 * math.pi


def length(duration: float, sample_rate: int) -> int:
    """Samples of a duration; truncated."""
    if sample_rate < 1 or duration < 0:
        raise ValueError("the rate must be positive and the duration not negative")
    return int(duration * sample_rate)


def from_expression(spark: SparkSession, n: int, v: Column, clip_id: int = 0) -> DataFrame:
    """A mono clip whose samples are an expression over ``idx``."""
    return spark.range(n).select(F.lit(clip_id).cast("long").alias("clip_id"), F.lit(0).alias("ch"), F.col("id").alias("idx")).withColumn("v", v.cast("double"))


def _t(rate: int) -> Column:
    return F.col("idx") / F.lit(float(rate))


def sine_wave(spark, frequency, duration, rate, amplitude=1.0):
    return from_expression(spark, length(duration, rate), amplitude * F.sin(TAU * frequency * _t(rate)))


def cosine_wave(spark, frequency, duration, rate, amplitude=1.0):
    return from_expression(spark, length(duration, rate), amplitude * F.cos(TAU * frequency * _t(rate)))


def square_wave(spark, frequency, duration, rate, amplitude=1.0):
    high = F.sin(TAU * frequency * _t(rate)) >= 0
    return from_expression(spark, length(duration, rate), F.when(high, F.lit(float(amplitude))).otherwise(F.lit(-float(amplitude))))


def sawtooth_wave(spark, frequency, duration, rate, amplitude=1.0):
    return from_expression(spark, length(duration, rate), amplitude * (2 * F.pmod(frequency * _t(rate) - 1, F.lit(1.0)) - 1))


def triangle_wave(spark, frequency, duration, rate, amplitude=1.0):
    """Closed-form phase, where an accumulated one would drift by rounding."""
    p = F.pmod(F.col("idx") * F.lit(frequency / rate), F.lit(1.0))
    return from_expression(spark, length(duration, rate), amplitude * F.when(p < 0.5, 4 * p - 1).otherwise(3 - 4 * p))


def chirp(spark, start, stop, duration, rate, amplitude=1.0):
    """Linear sweep."""
    k = (stop - start) / duration
    return from_expression(spark, length(duration, rate), amplitude * F.sin(TAU * (start * _t(rate) + k * _t(rate) * _t(rate) / 2)))


def exponential_chirp(spark, start, stop, duration, rate, amplitude=1.0):
    """Exponential sweep; equal ends are a tone."""
    if start <= 0 or stop <= 0:
        raise ValueError("frequencies must be positive")
    k = (stop / start) ** (1 / duration)
    phase = start * _t(rate) if abs(k - 1) < 1e-15 else start * (F.pow(F.lit(k), _t(rate)) - 1) / math.log(k)
    return from_expression(spark, length(duration, rate), amplitude * F.sin(TAU * phase))


def _harmonics(spark, frequency, duration, rate, amplitude, step, term) -> DataFrame:
    most = int(rate / 2 / frequency)
    if most < 1:
        raise ValueError("the fundamental lies above half the rate")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(most), F.lit(step)), F.lit(0.0), lambda acc, k: acc + term(k, TAU * frequency * _t(rate)))
    return from_expression(spark, length(duration, rate), amplitude * total)


def square_wave_bandlimited(spark, frequency, duration, rate, amplitude=1.0):
    return _harmonics(spark, frequency, duration, rate, amplitude * 4 / math.pi, 2, lambda k, w: F.sin(w * k) / k)


def sawtooth_wave_bandlimited(spark, frequency, duration, rate, amplitude=1.0):
    sign = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    return _harmonics(spark, frequency, duration, rate, amplitude * 2 / math.pi, 1, lambda k, w: sign(k) * F.sin(w * k) / k)


def triangle_wave_bandlimited(spark, frequency, duration, rate, amplitude=1.0):
    sign = lambda k: F.when((k - 1) % 4 == 0, 1.0).otherwise(-1.0)
    return _harmonics(spark, frequency, duration, rate, amplitude * 8 / math.pi**2, 2, lambda k, w: sign(k) * F.sin(w * k) / (k * k))


def fm_signal(spark, carrier, modulator, index, duration, rate, amplitude=1.0):
    t = _t(rate)
    return from_expression(spark, length(duration, rate), amplitude * F.sin(TAU * carrier * t + index * F.sin(TAU * modulator * t)))


def am_signal(spark, carrier, modulator, depth, duration, rate, amplitude=1.0):
    t = _t(rate)
    return from_expression(spark, length(duration, rate), amplitude * ((1 - depth) + depth * F.sin(TAU * modulator * t)) * F.sin(TAU * carrier * t))


def impulse(spark, duration, rate, amplitude=1.0, position=0.0):
    return from_expression(spark, length(duration, rate), F.when(F.col("idx") == int(position * rate), F.lit(float(amplitude))).otherwise(F.lit(0.0)))


def compound_tone(spark, components: Sequence[tuple[float, float]], duration, rate):
    """Sum of sines given as (frequency, amplitude)."""
    if not components:
        raise ValueError("at least one component")
    return from_expression(spark, length(duration, rate), reduce(lambda a, b: a + b, (a * F.sin(TAU * f * _t(rate)) for f, a in components)))


def exponential_bursts(spark, burst_rate, decay_rate, duration, rate, amplitude=1.0, seed=0):
    """Decaying bursts of noise and a 200 Hz tone; the seed makes them repeatable."""
    t = _t(rate)
    phase = F.pmod(burst_rate * t, F.lit(1.0))
    body = 0.7 * (2 * draws.uniform(seed, F.col("idx")) - 1) + 0.3 * F.sin(TAU * 200 * t)
    return from_expression(spark, length(duration, rate), F.when(phase < 0.1, amplitude * F.exp(-decay_rate * phase / burst_rate) * body).otherwise(F.lit(0.0)))


def silence(spark, duration, rate):
    return from_expression(spark, length(duration, rate), F.lit(0.0))


def white_noise(spark, duration, rate, amplitude=1.0, seed=0):
    return from_expression(spark, length(duration, rate), amplitude * (2 * draws.uniform(seed, F.col("idx")) - 1))


# Poles and gains of the usual seven-term pink-noise filter, and its output gain.
PINK_POLES = (0.99886, 0.99332, 0.96900, 0.86650, 0.55000, -0.7616)
PINK_GAINS = (0.0555179, 0.0750759, 0.1538520, 0.3104856, 0.5329522, -0.0168980)
PINK_DIRECT, PINK_LAST, PINK_SCALE = 0.5362, 0.115926, 0.11


def _recurrence(spark, duration, rate, seed, step, chunk_init, schema="clip_id long, ch int, idx long, v double"):
    """Clips whose samples depend on the one before: one ordered pass per clip in Arrow batches."""
    import pandas as pd

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        pdf["v"] = step(pdf["v"].to_numpy(), chunk_init)
        return pdf

    return white_noise(spark, duration, rate, 1.0, seed).groupBy("clip_id").applyInPandas(each, schema)


def _pink(x, scale):
    import numpy as np

    from ripplefield.operators.recurrence import one_pole

    y = PINK_DIRECT * x
    for p, g in zip(PINK_POLES, PINK_GAINS, strict=True):
        y = y + one_pole(g * x, p)
    return scale * PINK_SCALE * (y + np.r_[0.0, PINK_LAST * x[:-1]])


def _brown(x, args):
    import numpy as np

    step, amplitude = args
    out, level = np.empty_like(x), 0.0
    for i, d in enumerate(x.tolist()):
        level = min(1.0, max(-1.0, level + step * d))
        out[i] = level
    return amplitude * out


def pink_noise(spark, duration, rate, amplitude=1.0, seed=0):
    return _recurrence(spark, duration, rate, seed, _pink, amplitude)


def brown_noise(spark, duration, rate, step=0.02, amplitude=1.0, seed=0):
    """Integrated noise, held within full scale at every step."""
    return _recurrence(spark, duration, rate, seed, _brown, (step, amplitude))


def on_channels(df: DataFrame, channels: int) -> DataFrame:
    """The same samples on each of ``channels`` channels; narrow."""
    if channels < 1:
        raise ValueError("at least one channel")
    return df.drop("ch").select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("ch"), "idx", "v")


def stereo_sine_wave(spark, frequency, duration, rate, amplitude=1.0):
    return on_channels(sine_wave(spark, frequency, duration, rate, amplitude), 2)


def stereo_chirp(spark, start, stop, duration, rate, amplitude=1.0):
    return on_channels(chirp(spark, start, stop, duration, rate, amplitude), 2)


def stereo_silence(spark, duration, rate):
    return on_channels(silence(spark, duration, rate), 2)


def multichannel_compound_tone(spark, components, duration, rate, channels):
    return on_channels(compound_tone(spark, components, duration, rate), channels)


class SampleBuilder:
    """Generated segments one after the other: ``SampleBuilder(spark, 8000).add(sine_wave, 440, 0.1).build()``."""

    def __init__(self, spark: SparkSession, rate: int):
        self.spark, self.rate, self.parts, self.total = spark, rate, [], 0

    def add(self, generator, *args, duration: float, **kwargs) -> SampleBuilder:
        """Append a generator's segment of a duration."""
        part = generator(self.spark, *args, duration=duration, rate=self.rate, **kwargs)
        self.parts.append(part.withColumn("idx", F.col("idx") + self.total))
        self.total += length(duration, self.rate)
        return self

    def build(self) -> DataFrame:
        """The clip; an error if nothing was added."""
        if not self.parts:
            raise ValueError("nothing to build")
        return reduce(DataFrame.unionByName, self.parts)
