"""Quantisation: steps, bit allocation and word lengths as expressions over bands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_WORD = 24


def FRAME() -> Window:
    """All bands of a frame."""
    return Window.partitionBy("clip_id", "frame")


def step_size(noise_db: Column) -> Column:
    """Step whose uniform quantisation noise has a level, at least 1e-6."""
    return F.greatest(F.pow(F.lit(10.0), noise_db / 20) * math.sqrt(12), F.lit(1e-6))


def max_index(bits: Column) -> Column:
    """Largest index of a word length."""
    return F.when(bits <= 0, F.lit(0)).when(bits >= 31, F.lit(2147483647)).otherwise(F.pow(F.lit(2.0), bits - 1).cast("long") - 1).cast("long")


def allocate_bits(metrics: DataFrame, total_bits: int, min_bits: int) -> DataFrame:
    """Bits of each band: a minimum, and a share of the rest by energy times (1 + importance)."""
    weight = F.pow(F.lit(10.0), F.col("energy_db") / 10) * (1 + F.greatest("importance", F.lit(0.0)))
    bands = F.count("*").over(FRAME())
    rest = F.greatest(F.lit(total_bits) - bands * min_bits, F.lit(0))
    share = F.coalesce(F.try_divide(weight, F.sum(weight).over(FRAME())), F.lit(0.0))
    return metrics.withColumn("bits", (min_bits + F.round(share * rest)).cast("long")).withColumn("step", step_size(F.col("threshold_db")))


def quantize(v: Column, step: Column, bits: Column) -> Column:
    """Nearest index, halves away from zero, held within the word."""
    q = F.round(v / step).cast("long")
    return F.greatest(F.least(q, max_index(bits)), -max_index(bits))


def dequantize(q: Column, step: Column) -> Column:
    return q * step


def refine_steps(coefficients: DataFrame, allocation: DataFrame) -> DataFrame:
    """Word length and step of each band by the classic rate rule: mean rate plus half the log-variance over the mean.

    ``coefficients`` has (clip_id, band, value) and ``allocation`` (clip_id, band, bits).
    """
    clip = Window.partitionBy("clip_id")
    s = coefficients.groupBy("clip_id", "band").agg(F.max(F.abs("value")).alias("peak"), F.avg(F.col("value") * F.col("value")).alias("var"), F.count("*").alias("n"))
    s = s.join(allocation, ["clip_id", "band"])
    mean_rate = F.sum("bits").over(clip) / F.sum("n").over(clip)
    log_var = F.when(F.col("var") > 0, F.log2(F.when(F.col("var") > 0, F.col("var"))))
    w = F.greatest(F.least(mean_rate + 0.5 * (log_var - F.avg(log_var).over(clip)), F.lit(float(MAX_WORD))), F.lit(0.0))
    s = s.withColumn("w", F.coalesce(w, F.lit(0.0)))
    coarse = (F.col("w") < 0.5) | (F.col("var") <= 0)
    step = F.greatest(2 * F.col("peak") / F.when(coarse, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.col("w"))), F.lit(1e-6))
    word = F.when(coarse, F.lit(1)).otherwise(F.least(F.ceil("w") + 1, F.lit(MAX_WORD + 1))).cast("long")
    return s.select("clip_id", "band", step.alias("step"), word.alias("word"))
