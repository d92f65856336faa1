"""Metrics of two signals: an equi-join on (clip, channel, index) and one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["clip_id", "ch", "idx"]


def _inf() -> Column:
    return F.lit(float("inf"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Samples ``a`` and ``b`` side by side; other shapes stop the query."""
    both = a.select(*KEYS, F.col("v").alias("a")).join(b.select(*KEYS, F.col("v").alias("b")), KEYS, "full")
    bad = F.col("a").isNull() | F.col("b").isNull()
    return both.withColumn("a", F.when(bad, F.raise_error(F.lit("signals differ in shape")).cast("double")).otherwise(F.col("a")))


def _ratio_db(signal: Column, noise: Column) -> Column:
    return F.when(noise == 0, _inf()).otherwise(10 * F.log10(F.try_divide(signal, noise)))


def correlation_by_channel(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson correlation of each channel; 0 if one is constant."""
    g = paired(a, b).groupBy("clip_id", "ch").agg(F.corr("a", "b").alias("r"))
    return g.select("clip_id", "ch", F.when(F.isnan("r") | F.col("r").isNull(), F.lit(0.0)).otherwise(F.col("r")).alias("correlation"))


def correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean over channels."""
    return correlation_by_channel(a, b).groupBy("clip_id").agg(F.avg("correlation").alias("correlation"))


def mse_by_channel(a: DataFrame, b: DataFrame) -> DataFrame:
    d = F.col("a") - F.col("b")
    return paired(a, b).groupBy("clip_id", "ch").agg(F.avg(d * d).alias("mse"))


def mse(a: DataFrame, b: DataFrame) -> DataFrame:
    d = F.col("a") - F.col("b")
    return paired(a, b).groupBy("clip_id").agg(F.avg(d * d).alias("mse"))


def snr_by_channel(signal: DataFrame, noise: DataFrame) -> DataFrame:
    g = paired(signal, noise).groupBy("clip_id", "ch").agg(F.sum(F.col("a") * F.col("a")).alias("s"), F.sum(F.col("b") * F.col("b")).alias("n"))
    return g.select("clip_id", "ch", _ratio_db(F.col("s"), F.col("n")).alias("snr"))


def snr(signal: DataFrame, noise: DataFrame) -> DataFrame:
    """Power ratio in dB; infinite without noise."""
    g = paired(signal, noise).groupBy("clip_id").agg(F.sum(F.col("a") * F.col("a")).alias("s"), F.sum(F.col("b") * F.col("b")).alias("n"))
    return g.select("clip_id", _ratio_db(F.col("s"), F.col("n")).alias("snr"))


def psnr(reference: DataFrame, test: DataFrame) -> DataFrame:
    """Peak of the reference over the root mean squared error, in dB; infinite if equal."""
    d = F.col("a") - F.col("b")
    g = paired(reference, test).groupBy("clip_id").agg(F.max(F.abs("a")).alias("p"), F.avg(d * d).alias("m"))
    return g.select("clip_id", F.when(F.col("m") == 0, _inf()).otherwise(20 * F.log10(F.col("p") / F.sqrt("m"))).alias("psnr"))


def segmental_snr(signal: DataFrame, noise: DataFrame, segment: int) -> DataFrame:
    """Mean over segments of the ratio held in [-10, 35] dB; a segment without noise counts 35, without both -10."""
    if segment < 1:
        raise ValueError("a segment needs samples")
    g = paired(signal, noise).groupBy("clip_id", "ch", F.floor(F.col("idx") / segment).alias("s")).agg(F.sum(F.col("a") * F.col("a")).alias("p"), F.sum(F.col("b") * F.col("b")).alias("q"))
    db = F.when(F.col("q") == 0, F.when(F.col("p") == 0, F.lit(-10.0)).otherwise(F.lit(35.0))).otherwise(
        F.when(F.col("p") == 0, F.lit(-10.0)).otherwise(F.greatest(F.least(10 * F.log10(F.nullif(F.col("p"), F.lit(0.0)) / F.nullif(F.col("q"), F.lit(0.0))), F.lit(35.0)), F.lit(-10.0)))
    )
    return g.select("clip_id", "ch", db.alias("db")).groupBy("clip_id").agg(F.avg("db").alias("segmental_snr"))


def align_signals(reference: DataFrame, signal: DataFrame, max_offset: int, compat: bool = False) -> DataFrame:
    """The offset in [0, max_offset) of greatest correlation, per clip, on the first channel.

    The signal is moved against the reference; ``compat`` drops the same number of samples from both, as the
    original does.
    """
    shift = F.explode(F.sequence(F.lit(0), F.lit(max_offset - 1))).alias("offset")
    ref = reference.where("ch = 0").select("clip_id", "idx", F.col("v").alias("a"))
    sig = signal.where("ch = 0").select("clip_id", "idx", F.col("v").alias("b"), shift)
    moved = sig.where("idx >= offset") if compat else sig.withColumn("idx", F.col("idx") + F.col("offset"))
    r = ref.join(moved, ["clip_id", "idx"]).groupBy("clip_id", "offset").agg(F.corr("a", "b").alias("r"), F.count("*").alias("n")).where("n > 1 and r is not null and not isnan(r)")
    return r.groupBy("clip_id").agg(F.max_by("offset", F.struct(F.round("r", 12), -F.col("offset"))).cast("long").alias("offset"))


def log_spectral_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Root mean squared difference of two power spectra in dB, over ``(clip_id, ch, bin, power)``."""
    eps = 1e-10
    both = a.select("clip_id", "ch", "bin", F.col("power").alias("p")).join(b.select("clip_id", "ch", "bin", F.col("power").alias("q")), ["clip_id", "ch", "bin"])
    d = 10 * F.log10(F.col("p") + eps) - 10 * F.log10(F.col("q") + eps)
    return both.groupBy("clip_id").agg(F.sqrt(F.avg(d * d)).alias("distance"))


def region_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Samples that both of two region tables cover, per clip: by a sweep over the ends, not by a join of ranges."""
    ends = None
    for k, r in enumerate((a, b)):
        for edge, d in (("start", 1), ("end", -1)):
            part = r.select("clip_id", F.col(edge).alias("at"), F.lit(d if k == 0 else 0).alias("x"), F.lit(d if k else 0).alias("y"))
            ends = part if ends is None else ends.unionByName(part)
    merged = ends.groupBy("clip_id", "at").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    w = Window.partitionBy("clip_id").orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    open_ = merged.select("clip_id", (F.lead("at").over(w) - F.col("at")).alias("n"), F.sum("x").over(run).alias("x"), F.sum("y").over(run).alias("y"))
    return open_.groupBy("clip_id").agg(F.coalesce(F.sum(F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("n"))), F.lit(0)).alias("overlap"))
