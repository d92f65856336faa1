"""Voice activity: frame features, a mask per frame, smoothing by windows, regions by islands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplefield.operators.frames import frames


def ORDER() -> Window:
    """Frames of a clip in order."""
    return Window.partitionBy("clip_id").orderBy("frame")


METHODS = ("energy", "zero_crossing", "combined")
POLICIES = ("average", "any", "all")


@dataclass(frozen=True)
class VadConfig:
    """Defaults of the detector; frames are counted in hops."""

    method: str = "energy"
    frame: int = 1024
    hop: int = 512
    pad_end: bool = True
    policy: str = "average"
    threshold_db: float = -40.0
    zcr_min: float = 0.02
    zcr_max: float = 0.3
    min_speech: int = 3
    min_silence: int = 5
    hangover: int = 2
    smooth: int = 5

    def __post_init__(self):
        if self.method not in METHODS or self.policy not in POLICIES:
            raise ValueError(f"method is one of {METHODS}, policy one of {POLICIES}")
        if not 0 < self.hop <= self.frame:
            raise ValueError("the hop lies in 1..frame")


def frame_features(df: DataFrame, c: VadConfig) -> DataFrame:
    """RMS and zero-crossing rate of each frame and channel; zeros keep the sign before them."""
    if c.policy == "average":
        df = df.groupBy("clip_id", "idx").agg(F.avg("v").alias("v")).select("clip_id", F.lit(0).alias("ch"), "idx", "v")
    cut = frames(df, c.frame, c.hop, "none" if c.pad_end else "skip")
    w = Window.partitionBy("clip_id", "ch", "frame").orderBy("pos")
    sign = F.when(F.col("v") != 0, F.signum("v"))
    last = F.last(sign, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    crossed = (sign != last).cast("int")
    g = cut.withColumn("x", F.coalesce(crossed, F.lit(0))).groupBy("clip_id", "ch", "frame").agg(F.sum(F.col("v") * F.col("v")).alias("e"), F.sum("x").alias("x"), F.count("*").alias("n"))
    size = F.lit(c.frame) if c.pad_end else F.col("n")
    return g.select("clip_id", "ch", "frame", F.sqrt(F.col("e") / size).alias("rms"), F.try_divide(F.col("x"), F.lit(c.frame - 1)).alias("zcr"))


def raw_mask(df: DataFrame, c: VadConfig) -> DataFrame:
    """``(clip_id, frame, speech)`` by the thresholds, before smoothing."""
    loud = F.col("rms") >= 10 ** (c.threshold_db / 20)
    voiced = F.col("zcr").between(c.zcr_min, c.zcr_max)
    rule = {"energy": loud, "zero_crossing": voiced, "combined": loud & voiced}[c.method]
    g = frame_features(df, c).groupBy("clip_id", "frame")
    return g.agg((F.bool_and(rule) if c.policy == "all" else F.bool_or(rule)).alias("speech"))


def majority(mask: DataFrame, window: int) -> DataFrame:
    """True where at least half of the trailing frames are."""
    w = ORDER().rowsBetween(-(window - 1), 0)
    return mask.withColumn("speech", 2 * F.sum(F.col("speech").cast("int")).over(w) >= F.count("*").over(w))


def hangover(mask: DataFrame, k: int) -> DataFrame:
    """Stays true for k frames after speech."""
    last = F.max(F.when(F.col("speech"), F.col("frame"))).over(ORDER().rowsBetween(Window.unboundedPreceding, 0))
    return mask.withColumn("speech", F.coalesce(F.col("frame") - last <= k, F.lit(False)))


def remove_short_runs(mask: DataFrame, value: bool, least: int) -> DataFrame:
    """Flip runs of ``value`` that are shorter than ``least`` frames."""
    run = F.col("frame") - F.row_number().over(Window.partitionBy("clip_id", "speech").orderBy("frame"))
    sized = mask.withColumn("g__", run).withColumn("k__", F.count("*").over(Window.partitionBy("clip_id", "speech", "g__")))
    flip = (F.col("speech") == F.lit(value)) & (F.col("k__") < least)
    return sized.withColumn("speech", F.when(flip, ~F.col("speech")).otherwise(F.col("speech"))).drop("g__", "k__")


def voice_activity_mask(df: DataFrame, c: VadConfig = VadConfig()) -> DataFrame:
    """The smoothed mask: majority, hangover, then short speech and short silences removed."""
    mask = hangover(majority(raw_mask(df, c), c.smooth), c.hangover)
    return remove_short_runs(remove_short_runs(mask, True, c.min_speech), False, c.min_silence)


def speech_regions(df: DataFrame, c: VadConfig = VadConfig()) -> DataFrame:
    """Sample ranges of speech; a region ends where the first frame without speech ends, and overlaps merge."""
    n = df.groupBy("clip_id").agg((F.max("idx") + 1).alias("n"))
    mask = voice_activity_mask(df, c)
    run = F.col("frame") - F.row_number().over(Window.partitionBy("clip_id", "speech").orderBy("frame"))
    runs = mask.withColumn("g", run).where("speech").groupBy("clip_id", "g").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    ends = runs.join(n, "clip_id").select("clip_id", (F.col("a") * c.hop).alias("start"), F.least((F.col("b") + 1) * c.hop + c.frame, F.col("n")).alias("end"))
    return merge_regions(ends)


def merge_regions(regions: DataFrame) -> DataFrame:
    """Unite overlapping ranges ``(clip_id, start, end)``."""
    order = Window.partitionBy("clip_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = regions.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    return marked.groupBy("clip_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def classify(rms: Column, zcr: Column, c: VadConfig) -> Column:
    """The threshold rule as an expression."""
    loud, voiced = rms >= 10 ** (c.threshold_db / 20), zcr.between(c.zcr_min, c.zcr_max)
    return {"energy": loud, "zero_crossing": voiced, "combined": loud & voiced}[c.method]
