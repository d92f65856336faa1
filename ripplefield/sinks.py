"""Data behind plots: what a chart of a signal needs, reduced in Spark; rendering is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def waveform(df: DataFrame, points: int, sample_rate: float) -> DataFrame:
    """At most ``points`` buckets a channel with their least and greatest sample."""
    if points < 1:
        raise ValueError("at least one point")
    n = F.max("idx").over(Window.partitionBy("clip_id")) + 1
    size = F.ceil(n / points)
    sized = df.select("clip_id", "ch", "idx", "v", size.alias("k"))
    return sized.groupBy("clip_id", "ch", F.floor(F.col("idx") / F.col("k")).alias("point")).agg((F.min("idx") / sample_rate).alias("seconds"), F.min("v").alias("low"), F.max("v").alias("high"))


def lissajous(df: DataFrame, max_points: int) -> DataFrame:
    """Every k-th instant of stereo as (x, y)."""
    n = F.max("idx").over(Window.partitionBy("clip_id")) + 1
    kept = df.withColumn("k__", F.ceil(n / max_points)).where(F.col("idx") % F.col("k__") == 0)
    return kept.groupBy("clip_id", "idx").agg(F.max(F.when(F.col("ch") == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("ch") == 1, F.col("v"))).alias("y"))


def phase_spectrum(spec: DataFrame, unwrap: bool = False) -> DataFrame:
    """Phase of each bin; unwrapped along the bins if asked."""
    out = spec.select("clip_id", "ch", "frame", "bin", "freq_hz", F.atan2("im", "re").alias("phase"))
    if not unwrap:
        return out
    w = Window.partitionBy("clip_id", "ch", "frame").orderBy("bin")
    jump = F.round((F.col("phase") - F.lag("phase").over(w)) / (2 * math.pi))
    stepped = out.withColumn("j", F.coalesce(jump, F.lit(0.0)))
    return stepped.withColumn("phase", F.col("phase") - 2 * math.pi * F.sum("j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("j")


def magnitude_spectrum(spec: DataFrame, db: bool = False) -> DataFrame:
    """Magnitude of each bin, or its dB."""
    m = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return spec.select("clip_id", "ch", "frame", "bin", "freq_hz", (20 * F.log10(F.greatest(m, F.lit(1e-10))) if db else m).alias("magnitude"))
