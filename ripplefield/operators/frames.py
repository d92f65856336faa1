"""Frame assignment: which windows a sample belongs to, without a range join.

Sample i lies in the frames ceil((i - size + 1) / hop) .. floor(i / hop), so a narrow ``explode(sequence)``
deals it out; the join on a range would be a nested loop over all samples and frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.operators.clipwise import with_clip

PADDING = ("zero", "none", "skip")


def check(size: int, hop: int, padding: str = "zero") -> None:
    if size < 1 or hop < 1:
        raise ValueError("size and hop must be positive")
    if padding not in PADDING:
        raise ValueError(f"padding must be one of {PADDING}")


def frames(df: DataFrame, size: int, hop: int, padding: str = "zero") -> DataFrame:
    """``(clip_id, ch, frame, pos, v)``.

    ``zero`` keeps ceil(n / hop) frames and fills the last ones, ``none`` leaves them short, ``skip`` keeps
    full frames only.
    """
    check(size, hop, padding)
    rows = df.select("clip_id", "ch", "idx", "v")
    # a frame that holds a sample begins before the end, so only filling and skipping need the length
    with_n = rows.withColumn("n", F.lit(None).cast("long")) if padding == "none" else with_clip(rows, n=F.max("idx") + 1)
    low = F.greatest(F.ceil((F.col("idx") - size + 1) / hop), F.lit(0))
    dealt = with_n.select("clip_id", "ch", "n", "v", "idx", F.explode(F.sequence(low.cast("long"), F.floor(F.col("idx") / hop).cast("long"))).alias("frame")) if hop <= size else with_n.where(
        F.pmod("idx", F.lit(hop)) < size
    ).select("clip_id", "ch", "n", "v", "idx", F.floor(F.col("idx") / hop).cast("long").alias("frame"))
    out = dealt.withColumn("pos", F.col("idx") - F.col("frame") * hop)
    if padding == "skip":
        return out.where(F.col("frame") * hop + size <= F.col("n")).select("clip_id", "ch", "frame", "pos", "v")
    if padding == "zero":
        last = F.col("idx") == F.col("n") - 1  # lies in every frame that the end cuts short
        short = F.col("frame") * hop + size - F.col("n")
        holes = out.where(last & (short > 0)).select("clip_id", "ch", "frame", F.explode(F.sequence(size - short, F.lit(size - 1).cast("long"))).alias("pos"), F.lit(0.0).alias("v"))
        return out.select("clip_id", "ch", "frame", "pos", "v").unionByName(holes)
    return out.select("clip_id", "ch", "frame", "pos", "v")


def frame_arrays(df: DataFrame, size: int, hop: int, padding: str = "zero") -> DataFrame:
    """``(clip_id, ch, frame, w)`` with the samples of each frame in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])
    return frames(df, size, hop, padding).groupBy("clip_id", "ch", "frame").agg(ordered.alias("w"))


def frame_aggregate(df: DataFrame, size: int, hop: int, padding: str = "zero", **aggregates: Column) -> DataFrame:
    """Named aggregates over ``v`` of every frame."""
    return frames(df, size, hop, padding).groupBy("clip_id", "ch", "frame").agg(*(a.alias(k) for k, a in aggregates.items()))


def sample_frames(df: DataFrame) -> DataFrame:
    """One row per instant with the samples of all channels."""
    return df.groupBy("clip_id", "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("ch", "v"))), lambda x: x["v"]).alias("samples"))


def apply_to_frames(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """An expression over the array of all channels' samples at each instant."""
    return sample_frames(df).select("clip_id", "idx", F.posexplode(f(F.col("samples"))).alias("ch", "v")).select("clip_id", "ch", "idx", "v")


def apply_to_windows(df: DataFrame, size: int, hop: int, f: Callable) -> DataFrame:
    """``f(numpy array)`` over full windows in order; a later window sees what an earlier one wrote."""
    from ripplefield.operators.kernels import map_channel

    check(size, hop)

    def kernel(v):
        v = v.copy()
        for start in range(0, len(v) - size + 1, hop):
            v[start : start + size] = f(v[start : start + size])
        return v

    return map_channel(df, kernel)
