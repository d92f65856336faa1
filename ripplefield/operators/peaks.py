"""Peak picking over series ``(clip_id, frame, x)``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplefield.operators.chunks import Piece, map_pieces, settled
from ripplefield.operators.clipwise import with_clip
from ripplefield.operators.selection import order_statistics


def SERIES() -> Window:
    """All frames of a clip."""
    return Window.partitionBy("clip_id")


def ORDER() -> Window:
    """Frames of a clip in order."""
    return SERIES().orderBy("frame")


def centred(size: int) -> Window:
    """Frames around each, fewer at the ends."""
    return ORDER().rowsBetween(-(size // 2), size // 2)


def pre_emphasis(df: DataFrame, coefficient: float) -> DataFrame:
    """``x - c x'``; the first value stays."""
    prev = F.lag("x").over(ORDER())
    return df.withColumn("x", F.when(prev.isNull(), F.col("x")).otherwise(F.col("x") - coefficient * prev))


def median_filter(df: DataFrame, length: int) -> DataFrame:
    """Upper median of an odd neighbourhood, fewer values at the ends."""
    if length < 1 or length % 2 == 0:
        raise ValueError("the length must be odd")
    near = F.sort_array(F.collect_list("x").over(centred(length)))
    return df.withColumn("x__", near).withColumn("x", F.get("x__", F.floor(F.size("x__") / 2).cast("int"))).drop("x__")


def moving_average(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("x", F.avg("x").over(centred(size)))


def smooth(df: DataFrame, window: int, median: int) -> DataFrame:
    """Median, then moving average."""
    return moving_average(median_filter(df, median), window)


def rectify(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.greatest("x", F.lit(0.0)))


def log_compress(df: DataFrame, alpha: float) -> DataFrame:
    return df.withColumn("x", F.log1p(alpha * F.col("x")))


def normalize_strength(df: DataFrame, method: str = "peak") -> DataFrame:
    """Rescale a series by its peak, range, mean, true (upper) median or deviation."""
    x, found = F.col("x"), {}
    if method == "peak":
        found, top = {"a__": F.max(F.abs(x))}, F.col("a__")
        out = F.when(top > 0, x / F.nullif(top, F.lit(0.0))).otherwise(x)
    elif method == "minmax":
        found, a, b = {"a__": F.min(x), "b__": F.max(x)}, F.col("a__"), F.col("b__")
        out = F.coalesce(F.try_divide(x - a, b - a), F.lit(0.0))
    elif method == "zscore":
        found = {"a__": F.avg(x), "b__": F.stddev_pop(x)}
        out = F.coalesce(F.try_divide(x - F.col("a__"), F.col("b__")), F.lit(0.0))
    elif method == "mean":
        found, out = {"a__": F.avg(x)}, x - F.col("a__")
    elif method == "median":
        middle = order_statistics(df, x, a__=lambda n: F.floor(n / 2))
        return with_clip(df, source=middle, a__=F.max("a__")).withColumn("x", x - F.col("a__")).drop("a__")
    else:
        raise ValueError("unknown method")
    return with_clip(df, **found).withColumn("x", out).drop(*found)


@dataclass(frozen=True)
class Threshold:
    """Adaptive threshold: ``delta`` below the local maximum, a local percentile, or the greater of both."""

    method: str = "delta"
    delta: float = 0.05
    percentile: float = 0.9
    window: int = 1024
    low: float = 0.01
    high: float = 1.0


def adaptive_threshold(df: DataFrame, c: Threshold = Threshold()) -> DataFrame:
    """Adds ``threshold``."""
    near = centred(c.window)
    below = F.max("x").over(near) - c.delta
    share = F.percentile("x", F.lit(c.percentile)).over(near)
    rule = {"delta": below, "percentile": share, "combined": F.greatest(below, share)}
    if c.method not in rule:
        raise ValueError(f"method must be one of {sorted(rule)}")
    return df.withColumn("threshold", F.greatest(F.least(rule[c.method], F.lit(c.high)), F.lit(c.low)))


def local_maxima(df: DataFrame) -> Column:
    """Strictly above both neighbours; the ends never are."""
    return (F.col("x") > F.lag("x").over(ORDER())) & (F.col("x") > F.lead("x").over(ORDER()))


#: Frames of a tile of suppression, and how many separations beyond it a task looks.
TILE, REACH = 4096, 4


def _dominant(frame: np.ndarray, x: np.ndarray, kept: np.ndarray, apart: int, seen: tuple[float, float]) -> np.ndarray:
    """1 for candidates that the greedy choice keeps, 0 for those it drops, -1 for those that depend on what lies beyond ``seen``.

    Strongest first, ties to the earlier: a candidate next to a kept one is dropped; one that sees all its
    neighbours, none of them stronger and open, is kept.
    """
    state = np.where(kept, 1, -1)
    near, open_ = np.zeros(len(frame), bool), np.zeros(len(frame), bool)
    low, high = np.searchsorted(frame, frame - apart, "right"), np.searchsorted(frame, frame + apart, "left")
    for i in np.flatnonzero(kept):
        near[low[i] : high[i]] = True
    for i in np.lexsort((frame, -x)):
        if kept[i]:
            continue
        if near[i]:
            state[i] = 0
        elif frame[i] - apart + 1 >= seen[0] and frame[i] + apart - 1 <= seen[1] and not open_[low[i] : high[i]].any():
            state[i] = 1
            near[low[i] : high[i]] = True
        else:
            open_[i] = True
    return state


def _suppression_round(rows: DataFrame, tile: int) -> DataFrame:
    """``(key, idx, s, x, kept)`` without the candidates that tiles could drop, and with those marked that they could keep."""
    s, home = F.greatest("s", F.lit(1)), F.floor(F.col("idx") / tile)
    dealt = rows.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("idx") - REACH * s) / tile), F.floor((F.col("idx") + REACH * s) / tile))))
    dealt = dealt.withColumn("own", F.col("chunk") == home)
    met = dealt.groupBy("key", "chunk").agg(F.max("s").alias("s"), F.max("own").alias("any"), F.sort_array(F.collect_list(F.struct("idx", "x", "kept", "own"))).alias("z")).where("any")
    numbers = lambda c: F.transform("z", lambda e: e[c].cast("double"))
    met = met.select("key", F.col("chunk").cast("long").alias("chunk"), "s", *(numbers(c).alias(c) for c in ("idx", "x", "kept", "own")))

    def choose(p: Piece) -> dict:
        at, own, apart = p.arrays["idx"].astype(np.int64), p.arrays["own"] > 0, max(p.row["s"], 0)
        low, reach = p.row["chunk"] * tile, REACH * max(apart, 1)
        state = _dominant(at, p.arrays["x"], p.arrays["kept"] > 0, apart, (low - reach, low + tile - 1 + reach))
        left = own & (state != 0)
        return {"s": p.row["s"], "idx": at[left], "x": p.arrays["x"][left], "kept": state[left]}

    out = map_pieces(met, choose, "s long, idx array<double>, x array<double>, kept array<double>")
    out = out.select("key", "s", F.explode(F.arrays_zip("idx", "x", "kept")).alias("z"))
    return out.select("key", F.col("z.idx").cast("long").alias("idx"), "s", F.col("z.x").alias("x"), (F.col("z.kept") > 0).alias("kept"))


def keep_apart(df: DataFrame, separation: int | Column, tile: int = TILE) -> DataFrame:
    """Strongest first, keep candidates at least ``separation`` frames from all kept; equal ones: the earlier.

    Rounds of local dominance over tiles with a halo give the same choice as the greedy order: a tile decides all
    that doesn't depend on candidates beyond its halo, and what it leaves open meets what others have decided in the next
    round.  The strongest open candidate is decided in every round; a clip without any gap runs in many tasks.
    """
    apart = F.lit(separation) if isinstance(separation, int) else separation
    rows = df.select(F.struct("clip_id").alias("key"), F.col("frame").cast("long").alias("idx"), apart.cast("long").alias("s"), F.col("x").cast("double").alias("x"), F.lit(False).alias("kept"))
    while True:
        rows = settled(_suppression_round(rows, tile))
        if rows.where("not kept").isEmpty():
            return rows.select("key.clip_id", F.col("idx").alias("frame"), "x")


@dataclass(frozen=True)
class PeakConfig:
    """Defaults of the picker."""

    separation: int = 512
    pre_emphasis: float | None = 0.97
    median: int | None = 3
    normalization: str = "peak"
    threshold: Threshold = Threshold()


PRESETS = {
    "music": PeakConfig(1024, 0.95, 5, threshold=Threshold("combined", 0.03, 0.85, 2048)),
    "speech": PeakConfig(256, 0.98, 3, threshold=Threshold("delta", 0.07, window=1024)),
    "drums": PeakConfig(128, 0.93, None, threshold=Threshold("percentile", percentile=0.95, window=512)),
}


def pick_peaks(df: DataFrame, c: PeakConfig = PeakConfig()) -> DataFrame:
    """Frames of the picked peaks; a separation of half the series or more shrinks to a quarter of it."""
    if c.pre_emphasis is not None:
        df = pre_emphasis(df, c.pre_emphasis)
    if c.median is not None:
        df = median_filter(df, c.median)
    df = adaptive_threshold(normalize_strength(df, c.normalization), c.threshold)
    df, n = with_clip(df, n__=F.count("*")), F.col("n__")
    apart = F.when(F.lit(c.separation) >= n / 2, F.floor(n / 4)).otherwise(F.lit(c.separation))
    found = df.withColumns({"up__": local_maxima(df), "s__": apart}).where((F.col("up__")) & (F.col("x") > F.col("threshold")))

    return keep_apart(found, F.col("s__"))
