"""Descriptive statistics per clip: one partial/final aggregation, at most one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplefield.operators.chunks import CHUNK
from ripplefield.operators.clipwise import with_clip
from ripplefield.operators.correlation import lag_sums

CLIP = ["clip_id"]
CHANNEL = ["clip_id", "ch"]


def along(*keys: str) -> Window:
    """Samples of one channel in order; every window of the library uses this partitioning."""
    return Window.partitionBy(*(keys or CHANNEL)).orderBy("idx")


def levels(df: DataFrame) -> DataFrame:
    """Count, mean, peak, RMS, extremes and population moments of each clip in a single pass."""
    v = F.col("v")
    return df.groupBy("clip_id").agg(
        F.count("*").alias("n"),
        F.max(F.abs(v)).alias("peak"),
        F.min(v).alias("min_sample"),
        F.max(v).alias("max_sample"),
        F.avg(v).alias("mean"),
        F.sum(v).alias("total"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        F.var_pop(v).alias("variance"),
        F.stddev_pop(v).alias("std_dev"),
    )


def sign_change() -> Column:
    """Whether a sample crosses zero against the one before it; zero counts with the negative side.

    The window is partitioned by clip alone and ordered by channel, so that it shares its exchange with
    aggregates by clip (and with adapters that number samples by clip).
    """
    w = Window.partitionBy("clip_id").orderBy("ch", "idx")
    prev, v = F.when(F.lag("ch").over(w) == F.col("ch"), F.lag("v").over(w)), F.col("v")
    return F.coalesce(((prev > 0) & (v <= 0)) | ((prev <= 0) & (v > 0)), F.lit(False)).cast("long")


def crossings(df: DataFrame) -> DataFrame:
    """Sign changes per clip, summed over channels."""
    return df.select("clip_id", "ch", "idx", "v").withColumn("c", sign_change()).groupBy("clip_id").agg(F.sum("c").alias("zero_crossings"))


def crossing_rate(df: DataFrame, sample_rate: float) -> DataFrame:
    """Sign changes per second of the clip."""
    length = df.groupBy("clip_id").agg((F.max("idx") + 1).alias("n"))
    return crossings(df).join(length, "clip_id").select("clip_id", (F.col("zero_crossings") * sample_rate / F.col("n")).alias("zcr"))


def statistics(df: DataFrame) -> DataFrame:
    """``levels`` and ``crossings`` together, over one exchange by clip."""
    v = F.col("v")
    return (
        df.withColumn("_c", sign_change())
        .groupBy("clip_id")
        .agg(
            F.count("*").alias("n"),
            F.sqrt(F.avg(v * v)).alias("rms"),
            F.max(F.abs(v)).alias("peak"),
            F.avg(v).alias("mean"),
            F.stddev_pop(v).alias("std_dev"),
            F.sum("_c").alias("zero_crossings"),
        )
    )


def midpoint_sample(df: DataFrame) -> DataFrame:
    """The sample in the middle by position (two middle ones averaged); null for more than one channel."""
    marked = with_clip(df.select("clip_id", "ch", "idx", "v"), n=F.max("idx") + 1, c=F.max("ch") + 1)
    middle = (F.col("idx") == F.floor(F.col("n") / 2)) | ((F.col("n") % 2 == 0) & (F.col("idx") == F.floor(F.col("n") / 2) - 1))
    return marked.groupBy("clip_id").agg(F.avg(F.when(middle & (F.col("c") == 1), F.col("v"))).alias("midpoint"))


def mean_by_channel(df: DataFrame) -> DataFrame:
    """Mean of each channel."""
    return df.groupBy("clip_id", "ch").agg(F.avg("v").alias("mean"))


def mean_by_instant(df: DataFrame) -> DataFrame:
    """Mean over the channels at each instant."""
    return df.groupBy("clip_id", "idx").agg(F.avg("v").alias("mean"))


def variance_by_channel(df: DataFrame, ddof: int = 0) -> DataFrame:
    """Variance and deviation of each channel with ``n - ddof`` as divisor."""
    moments = df.groupBy("clip_id", "ch").agg(F.var_pop("v").alias("p"), F.count("*").alias("n"))
    var = F.try_divide(F.col("p") * F.col("n"), F.col("n") - ddof)
    return moments.select("clip_id", "ch", var.alias("variance"), F.sqrt(var).alias("std_dev"))


def variance(df: DataFrame, compat: bool = False) -> DataFrame:
    """Population variance of a clip; ``compat`` takes deviations from the mean over channels at each instant,
    divided by all samples and averaged over channels, as the original does for more than one channel."""
    if not compat:
        return df.groupBy("clip_id").agg(F.var_pop("v").alias("variance"))
    centre = F.avg("v").over(Window.partitionBy("clip_id", "idx"))
    d = df.select("clip_id", "ch", F.pow(F.col("v") - centre, F.lit(2.0)).alias("d"))
    one = d.groupBy("clip_id").agg(F.sum("d").alias("s"), F.count("*").alias("n"), (F.max("ch") + 1).alias("c"))
    return one.select("clip_id", (F.col("s") / F.col("n") / F.col("c")).alias("variance"))


def autocorrelation(df: DataFrame, max_lag: int, chunk: int = CHUNK) -> DataFrame:
    """Unbiased autocorrelation of the first channel: mean product at each lag up to min(max_lag, n - 1)."""
    if max_lag < 1:
        raise ValueError("at least one lag")
    first = df.where("ch = 0")
    return lag_sums(first, first, 0, max_lag, chunk=chunk).select("clip_id", "lag", (F.col("s") / F.col("n")).alias("r"))


def cross_correlation(a: DataFrame, b: DataFrame, max_lag: int, chunk: int = CHUNK) -> DataFrame:
    """Mean product of ``a[i]`` and ``b[i + lag]`` over their common samples, first channels, lags below both lengths."""
    if max_lag < 1:
        raise ValueError("at least one lag")
    a, b = a.where("ch = 0"), b.where("ch = 0")
    key = F.struct("clip_id").alias("key")
    shorter = a.groupBy(key).agg(F.count("*").alias("n_a")).join(b.groupBy(key).agg(F.count("*").alias("n_b")), "key")
    r = lag_sums(a, b, 0, max_lag, chunk=chunk).withColumn("key", F.struct("clip_id")).join(shorter, "key")
    return r.where(F.col("lag") < F.least("n_a", "n_b")).select("clip_id", "lag", (F.col("s") / F.col("n")).alias("r"))


def alignment_lag(reference: DataFrame, query: DataFrame, max_lag: int, chunk: int = CHUNK) -> DataFrame:
    """The lag within +-max_lag of greatest correlation sum; ties go to the smaller, then the positive lag."""
    sums = lag_sums(reference.where("ch = 0"), query.where("ch = 0"), -max_lag, max_lag, chunk=chunk)
    order = F.struct("s", -F.abs("lag"), "lag")
    return sums.groupBy("clip_id").agg(F.max_by("lag", order).cast("long").alias("lag"))


def feature_report(df: DataFrame) -> DataFrame:
    """Levels by channel, by clip and over all, in one rollup."""
    v = F.col("v")
    g = df.rollup("clip_id", "ch").agg(F.count("*").alias("n"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"))
    return g
