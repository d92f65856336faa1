"""Channel operators: projections, filters and one aggregate over the channels of an instant."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.operators.clipwise import with_clip


def _bad(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def to_mono(df: DataFrame, method: str = "average", weights: Sequence[float] | None = None) -> DataFrame:
    """One channel: ``average``, ``left``, ``right``, ``weighted`` (as given) or ``center`` (channel 2 of six or more, else the mean)."""
    if method in ("left", "right"):
        return extract_channel(df, 0 if method == "left" else 1)
    if method == "average":
        v = F.avg("v")
    elif method == "weighted":
        if not weights:
            raise ValueError("weights are needed")
        w = F.array(*(F.lit(float(x)) for x in weights))
        df = with_clip(df, c__=F.max("ch") + 1).withColumn("ch", F.when(F.col("c__") == len(weights), F.col("ch")).otherwise(_bad("one weight a channel", "int")))
        v = F.sum(F.col("v") * F.get(w, F.col("ch")))
    elif method == "center":
        v = F.coalesce(F.max(F.when((F.col("ch") == 2) & (F.col("c__") >= 6), F.col("v"))), F.avg("v"))
        df = with_clip(df, c__=F.max("ch") + 1)
    else:
        raise ValueError("method must be average, left, right, weighted or center")
    return df.groupBy("clip_id", "idx").agg(v.alias("v")).select("clip_id", F.lit(0).alias("ch"), "idx", "v")


def to_stereo(df: DataFrame, method: str = "duplicate", pan: float = 0.0) -> DataFrame:
    """Two channels from mono: ``duplicate``, or ``pan`` by constant power (-1 left .. 1 right).

    ``left`` and ``right`` extract that channel; clips of more channels pass ``duplicate`` and ``pan`` unchanged.
    """
    if method in ("left", "right"):
        return extract_channel(df, 0 if method == "left" else 1)
    if method not in ("duplicate", "pan"):
        raise ValueError("method must be duplicate, pan, left or right")
    if not -1 <= pan <= 1:
        raise ValueError("pan lies in [-1, 1]")
    angle = (pan + 1) * math.pi / 4
    gains = (1.0, 1.0) if method == "duplicate" else (math.cos(angle), math.sin(angle))
    sides = F.array(*(F.struct(F.lit(k).alias("c"), F.lit(g).alias("g")) for k, g in enumerate(gains)))
    own = F.array(F.struct(F.col("ch").alias("c"), F.lit(1.0).alias("g")))
    sized = with_clip(df, top__=F.max("ch"))
    return sized.withColumn("s__", F.explode(F.when(F.col("top__") == 0, sides).otherwise(own))).select("clip_id", F.col("s__.c").alias("ch"), "idx", (F.col("v") * F.col("s__.g")).alias("v"))


def duplicate_to_channels(df: DataFrame, n: int) -> DataFrame:
    """The first channel on ``n`` channels."""
    if n < 1:
        raise ValueError("at least one channel")
    return df.where("ch = 0").select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ch"), "idx", "v")


def extract_channel(df: DataFrame, channel: int) -> DataFrame:
    """One channel as mono; a clip without it stops the query."""
    v = F.when(F.col("top__") >= channel, F.col("v")).otherwise(_bad("no such channel", "double"))
    return with_clip(df, top__=F.max("ch")).withColumn("v", v).where((F.col("ch") == channel) | F.col("v").isNull()).select("clip_id", F.lit(0).alias("ch"), "idx", "v")


def swap_channels(df: DataFrame, a: int, b: int) -> DataFrame:
    return df.withColumn("ch", F.when(F.col("ch") == a, F.lit(b)).when(F.col("ch") == b, F.lit(a)).otherwise(F.col("ch")))


def pan(df: DataFrame, position: float) -> DataFrame:
    """Linear pan of stereo: left by 1 - p, right by 1 + p, p held in [-1, 1]."""
    p = max(-1.0, min(1.0, position))
    return df.withColumn("v", F.col("v") * F.when(F.col("ch") == 0, F.lit(1 - p)).when(F.col("ch") == 1, F.lit(1 + p)).otherwise(_bad("pan needs stereo", "double")))


balance = pan


def apply_to_channel(df: DataFrame, channel: int, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("v", F.when(F.col("ch") == channel, f(F.col("v"))).otherwise(F.col("v")))


def stack(sources: Sequence[DataFrame]) -> DataFrame:
    """Mono clips of one length as the channels of one clip."""
    if not sources:
        raise ValueError("nothing to stack")
    parts = [s.select("clip_id", F.lit(k).alias("ch"), "idx", "v") for k, s in enumerate(sources)]
    both = reduce(DataFrame.unionByName, parts)
    sized = with_clip(with_clip(both, ("clip_id", "ch"), per__=F.count("*")), all__=F.count("*"))
    even = F.col("all__") == F.col("per__") * len(sources)
    return sized.withColumn("v", F.when(even, F.col("v")).otherwise(_bad("channels differ in length", "double"))).drop("per__", "all__")


interleave_channels = stack


def deinterleave_channels(df: DataFrame) -> DataFrame:
    """Every channel as a mono clip of its own: ``(clip_id, part, idx, v)``."""
    return df.select("clip_id", F.col("ch").alias("part"), F.lit(0).alias("ch"), "idx", "v")


def mid_side(df: DataFrame) -> DataFrame:
    """Stereo to mid (channel 0) and side (channel 1): half the sum and half the difference."""
    return _rotate(df, 0.5)


def left_right(df: DataFrame) -> DataFrame:
    """Mid and side back to left and right."""
    return _rotate(df, 1.0)


def _rotate(df: DataFrame, gain: float) -> DataFrame:
    both = df.groupBy("clip_id", "idx").agg(*(F.sum(F.when(F.col("ch") == k, F.col("v"))).alias(n) for k, n in ((0, "a"), (1, "b"))))
    sides = F.array(F.struct(F.lit(0).alias("c"), ((F.col("a") + F.col("b")) * gain).alias("v")), F.struct(F.lit(1).alias("c"), ((F.col("a") - F.col("b")) * gain).alias("v")))
    return both.select("clip_id", "idx", F.explode(sides).alias("s")).select("clip_id", F.col("s.c").alias("ch"), "idx", F.col("s.v").alias("v"))
