"""Overlap-add as an aggregation: blocks of frames become partial sums of sample blocks, which are added up.

A task holds a block of frames and the samples they cover; what overlaps the next block is one more partial sum.
Partial sums carry the squared windows too, so the division comes once, at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefield.operators.chunks import Piece, list_of, long_form, map_pieces, pieces

#: Samples of a block.
BLOCK = 1 << 16


def overlap_add(blocks: DataFrame, frames_of: Callable[[Piece], tuple[int, np.ndarray]], window: np.ndarray, hop: int, block: int = BLOCK) -> DataFrame:
    """``(key, chunk, first, y, w)``: sums of windowed frames and of squared windows, by blocks of samples.

    ``frames_of`` gives the number of a row's first frame and its frames, one a row of an array.
    """
    key = blocks.schema["key"].dataType.simpleString()
    size = len(window)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back, chunks, firsts, sums, weights = [], [], [], [], []
            for k, p in enumerate(pieces(b)):
                number, frames = frames_of(p)
                if not len(frames):
                    continue
                y, w = np.zeros((len(frames) - 1) * hop + size), np.zeros((len(frames) - 1) * hop + size)
                for j, f in enumerate(frames):
                    y[j * hop : j * hop + size] += f * window
                    w[j * hop : j * hop + size] += window**2
                start = number * hop
                for c in range(start // block, (start + len(y) - 1) // block + 1):
                    low, high = max(start, c * block), min(start + len(y), (c + 1) * block)
                    back.append(k)
                    chunks.append(c)
                    firsts.append(low)
                    sums.append(y[low - start : high - start])
                    weights.append(w[low - start : high - start])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(back, pa.int64())), pa.array(chunks, pa.int64()), pa.array(firsts, pa.int64()), list_of(sums), list_of(weights)], ["key", "chunk", "first", "y", "w"])

    parts = blocks.mapInArrow(partial, f"key {key}, chunk long, first long, y array<double>, w array<double>")
    # a block of samples has a few parts: one from each block of frames that reaches it
    met = parts.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("first", "y", "w"))).alias("s"))
    met = met.select("key", "chunk", F.transform("s", lambda x: x["first"].cast("double")).alias("firsts"), F.transform("s", lambda x: F.size(x["y"]).cast("double")).alias("sizes"), F.flatten(F.col("s.y")).alias("y"), F.flatten(F.col("s.w")).alias("w"))

    def add(p: Piece) -> dict:
        firsts, sizes = (p.arrays[n].astype(np.int64) for n in ("firsts", "sizes"))
        low, at = int(firsts.min()), 0
        y, w = np.zeros(int((firsts + sizes).max()) - low), np.zeros(int((firsts + sizes).max()) - low)
        for first, size in zip(firsts - low, sizes, strict=True):
            y[first : first + size] += p.arrays["y"][at : at + size]
            w[first : first + size] += p.arrays["w"][at : at + size]
            at += size
        return {"first": low, "y": y, "w": w}

    return map_pieces(met, add, "first long, y array<double>, w array<double>")


def synthesis(sums: DataFrame, least: float, skip: int, drop: int, floor: bool = False) -> DataFrame:
    """Samples of ``overlap_add``: sums over weights (1 below ``least``, or at least that if ``floor``), without ``skip`` at
    the start and ``drop`` at the end."""
    rows = long_form(sums, "y", "w")
    ends = sums.groupBy("key").agg(F.max(F.col("first") + F.size("y")).alias("end"))  # a row a block
    rows = rows.withColumn("key", F.struct("clip_id", "ch")).join(ends, "key") if drop else rows
    weight = F.greatest(F.col("w"), F.lit(least)) if floor else F.when(F.col("w") > least, F.col("w")).otherwise(F.lit(1.0))
    kept = rows.where(F.col("idx") >= skip)
    kept = kept.where(F.col("idx") < F.col("end") - drop) if drop else kept
    return kept.select("clip_id", "ch", (F.col("idx") - skip).alias("idx"), (F.col("y") / weight).alias("v"))


def frame_blocks(spec: DataFrame, hop: int, block: int = BLOCK) -> DataFrame:
    """``(key, chunk, first, re, im)``: the spectra of blocks of frames, one after the other."""
    per = max(1, block // hop)
    rows = spec.select(F.struct("clip_id", "ch").alias("key"), F.floor(F.col("frame") / per).alias("chunk"), "frame", "bin", "re", "im")
    met = rows.groupBy("key", "chunk").agg(F.min("frame").cast("long").alias("first"), F.sort_array(F.collect_list(F.struct("frame", "bin", "re", "im"))).alias("s"))
    return met.select("key", "chunk", "first", F.col("s.re").alias("re"), F.col("s.im").alias("im"))
