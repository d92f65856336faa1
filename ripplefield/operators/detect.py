"""Detection of silence, clipping, noise floor, pitch and bandwidth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplefield.operators.editing import silence_runs
from ripplefield.operators.clipwise import with_clip
from ripplefield.operators.correlation import lag_sums
from ripplefield.operators.selection import order_statistics

# The usual sample rates, in ascending order.
COMMON_RATES = (8000, 11025, 16000, 22050, 32000, 44100, 48000, 88200, 96000)


def silence_regions(df: DataFrame, threshold: float, sample_rate: float) -> DataFrame:
    """Runs in which every channel stays strictly below the threshold, in seconds."""
    r = silence_runs(df, threshold, strict=True)
    return r.select("clip_id", (F.col("start") / sample_rate).alias("start"), (F.col("end") / sample_rate).alias("end"))


def clipping_regions(df: DataFrame, ratio: float, sample_rate: float, full_scale: float = 1.0) -> DataFrame:
    """Runs in which some channel reaches the ratio of full scale, in seconds."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio lies in (0, 1]")
    one = df.groupBy("clip_id", "idx").agg((F.max(F.abs("v")) >= ratio * full_scale).alias("hit")).where("hit")
    runs = one.withColumn("g", F.col("idx") - F.row_number().over(Window.partitionBy("clip_id").orderBy("idx")))
    return runs.groupBy("clip_id", "g").agg((F.min("idx") / sample_rate).alias("start"), ((F.max("idx") + 1) / sample_rate).alias("end")).drop("g")


def dynamic_range(df: DataFrame) -> DataFrame:
    """Peak, RMS and their ratio in dB (infinite for silence)."""
    g = df.groupBy("clip_id").agg(F.max(F.abs("v")).alias("peak"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    db = F.when(F.col("rms") > 0, 20 * F.log10(F.col("peak") / F.nullif(F.col("rms"), F.lit(0.0)))).otherwise(F.lit(float("inf")))
    return g.select("clip_id", "peak", "rms", db.alias("dynamic_range_db"))


def noise_floor(df: DataFrame) -> DataFrame:
    """The absolute value at a tenth of the sorted samples, in dB; null for under ten samples or a zero."""
    low = order_statistics(df, F.abs("v"), a=lambda n: F.floor(n / 10))
    at = F.when((F.col("n") >= 10) & (F.col("a") > 0), F.col("a"))
    return low.select("clip_id", (20 * F.log10(at)).alias("noise_floor_db"))


def frequency_range(spectrum: DataFrame, share: float = 0.01) -> DataFrame:
    """Lowest and highest frequency whose power exceeds a share of the greatest; over ``(clip_id, freq_hz, power)``."""
    loud = with_clip(spectrum, t=F.max("power")).where(F.col("power") > share * F.col("t"))
    return loud.groupBy("clip_id").agg(F.min("freq_hz").alias("low_hz"), F.max("freq_hz").alias("high_hz"))


def fundamental(df: DataFrame, sample_rate: float, low: float = 50.0, high: float = 2000.0, least: float = 0.1) -> DataFrame:
    """Rate over the lag of greatest normalised autocorrelation of the first channel; null below ``least``."""
    a, b = max(1, int(sample_rate / high)), max(1, int(sample_rate / low))
    first = df.where("ch = 0")
    energy = first.groupBy("clip_id").agg(F.sum(F.col("v") * F.col("v")).alias("e"), (F.max("idx") + 1).alias("n"))
    r = lag_sums(first, first, a, b).select("clip_id", "lag", "s")
    c = r.join(energy, "clip_id").where(F.col("lag") < F.col("n") / 2).withColumn("c", F.try_divide("s", "e"))
    best = c.groupBy("clip_id").agg(F.max_by("lag", F.struct("c", -F.col("lag"))).alias("lag"), F.max("c").alias("c"))
    return best.select("clip_id", F.when(F.col("c") > least, sample_rate / F.col("lag")).alias("frequency"))


def cutoff_rate(spectrum: DataFrame, nyquist: float) -> DataFrame:
    """The first common rate at whose half the spectrum's energy drops: more than twice as much below as above; else null."""
    cuts = F.explode(F.array(*(F.lit(r) for r in COMMON_RATES))).alias("rate")
    s = spectrum.select("clip_id", "freq_hz", "power", cuts).where(F.col("rate") / 2 < nyquist)
    g = s.groupBy("clip_id", "rate").agg(F.sum(F.when(F.col("freq_hz") < F.col("rate") / 2, F.col("power")).otherwise(0.0)).alias("below"), F.sum(F.when(F.col("freq_hz") >= F.col("rate") / 2, F.col("power")).otherwise(0.0)).alias("above"))
    return g.groupBy("clip_id").agg(F.min(F.when(F.col("below") > 2 * F.col("above"), F.col("rate"))).cast("long").alias("rate"))
