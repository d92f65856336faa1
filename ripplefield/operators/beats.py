"""Tempo and beats from onset-strength series ``(clip_id, frame, x)``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplefield.operators.clipwise import with_clip
from ripplefield.operators.correlation import lag_sums
from ripplefield.operators.peaks import log_compress, moving_average


def strength_envelope(odf: DataFrame, half: int = 3, compression: float = 0.5) -> DataFrame:
    """Moving average over +-half frames, then ``ln(1 + c x)``."""
    return log_compress(moving_average(odf, 2 * half + 1), compression)


def tempo_scores(env: DataFrame, sample_rate: float, hop: int, low: float = 40.0, high: float = 240.0, centre: float = 120.0) -> DataFrame:
    """``(clip_id, lag, bpm, score)``: unbiased autocorrelation of the centred series times a log-normal prior of one octave."""
    fps = sample_rate / hop
    a, b = max(1, math.ceil(60 * fps / high)), int(60 * fps / low)
    c = with_clip(env, mean__=F.avg("x")).select("clip_id", F.lit(0).alias("ch"), F.col("frame").alias("idx"), (F.col("x") - F.col("mean__")).alias("v"))
    r = lag_sums(c, c, a, max(a, b)).select("clip_id", "lag", (F.col("s") / F.col("n")).alias("r"))
    bpm = 60 * fps / F.col("lag")
    octaves = F.log2(bpm / centre)
    return r.select("clip_id", F.col("lag").cast("long").alias("lag"), bpm.alias("bpm"), (F.col("r") * F.exp(-0.5 * octaves * octaves)).alias("score"))


def estimate_tempo(env: DataFrame, sample_rate: float, hop: int, **options) -> DataFrame:
    """The tempo of greatest score; ties go to the shorter lag."""
    s = tempo_scores(env, sample_rate, hop, **options)
    return s.groupBy("clip_id").agg(F.max_by("bpm", F.struct(F.round("score", 12), -F.col("lag"))).alias("tempo"))


def track_beats(env: DataFrame, tempo: DataFrame, sample_rate: float, hop: int, tolerance: float | None = None) -> DataFrame:
    """Beats from the strongest frame outwards, one beat interval after the other, each snapped to the local
    maximum within the tolerance (a tenth of an interval): ``(clip_id, beat, frame, seconds)`` in order."""
    fps = sample_rate / hop
    strongest = env.groupBy("clip_id").agg(F.max_by("frame", F.struct("x", -F.col("frame"))).alias("start"), (F.max("frame") + 1).alias("n"))
    step = strongest.join(tempo, "clip_id").withColumn("ibi", 60 * fps / F.col("tempo"))
    k = F.explode(F.sequence(F.ceil(-F.col("start") / F.col("ibi")), F.floor((F.col("n") - 1 - F.col("start")) / F.col("ibi")))).alias("k")
    centres = step.select("clip_id", "start", "ibi", "n", k).withColumn("centre", F.round(F.col("start") + F.col("k") * F.col("ibi")).cast("long"))
    tol = F.greatest(F.lit(1), F.floor((F.lit(tolerance * fps) if tolerance is not None else 0.1 * F.col("ibi")))).cast("long")
    near = centres.withColumn("frame", F.explode(F.sequence(F.greatest(F.col("centre") - tol, F.lit(0)), F.least(F.col("centre") + tol, F.col("n") - 1))))
    found = near.join(env, ["clip_id", "frame"]).groupBy("clip_id", "k").agg(F.max_by("frame", F.struct("x", -F.col("frame"))).alias("frame"))
    order = Window.partitionBy("clip_id").orderBy("k")
    return found.select("clip_id", (F.row_number().over(order) - 1).cast("long").alias("beat"), "frame", (F.col("frame") / fps).alias("seconds"))
