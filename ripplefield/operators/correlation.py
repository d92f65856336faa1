"""Correlation by blocks: sums of products at many lags for clips of any length.

Both signals are cut into chunks.  A chunk of the first meets the chunks of the second that some lag reaches (an
equi-join of chunk rows), their spectra are multiplied, and the wanted lags of the result are partial sums.  Partial
lag vectors are added up within a batch, then by an aggregation that combines on the map side.  So what is
shuffled is the samples once for each chunk reached, and a vector of lags for each batch, whatever the number of lags.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefield.operators.chunks import CHUNK, cut, pieces

#: Up to so many lags are summed directly, which is exact to the last product; more go through spectra.
FEW_LAGS = 64


def block_products(a: np.ndarray, b: np.ndarray, first: int, last: int) -> np.ndarray:
    """``sum_i a[i] b[i + m]`` for m from ``first`` to ``last``, where both exist."""
    if last - first < FEW_LAGS:
        out = np.zeros(last - first + 1)
        for m in range(max(first, 1 - len(a)), min(last, len(b) - 1) + 1):
            low, high = max(0, -m), min(len(a), len(b) - m)
            out[m - first] = a[low:high] @ b[low + m : high + m]
        return out
    size = 1 << (len(a) + len(b) - 1).bit_length()
    all_lags = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)
    m = np.arange(first, last + 1)
    return np.where((m > -len(a)) & (m < len(b)), all_lags[m % size], 0.0)


def block_differences(a: np.ndarray, b: np.ndarray, first: int, last: int) -> np.ndarray:
    """``sum_i (a[i] - b[i + m])^2``, directly: spectra would lose small differences."""
    out = np.zeros(last - first + 1)
    for m in range(max(first, 1 - len(a)), min(last, len(b) - 1) + 1):
        low, high = max(0, -m), min(len(a), len(b) - m)
        d = a[low:high] - b[low + m : high + m]
        out[m - first] = d @ d
    return out


KINDS = {"products": block_products, "differences": block_differences}


def lag_sums(a: DataFrame, b: DataFrame, low: int, high: int, kind: str = "products", trim: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``(clip_id, ch, lag, s, n)``: the sum over ``a[i]`` and ``b[i + lag]`` and the number of its terms, which is above 0.

    The last ``trim`` samples of each channel of ``a`` start no term.
    """
    if low > high or trim < 0:
        raise ValueError("lags must be ordered and trim no less than 0")
    block = KINDS[kind]
    left = cut(a, chunk, 0, 0)
    if trim:
        end = left.groupBy("key").agg(F.max(F.col("first") + F.col("own")).alias("end"))  # a row a chunk
        left = left.join(end, "key")
    else:
        left = left.withColumn("end", F.col("first") + F.col("own"))
    reach = F.sequence(F.floor((F.col("first") + low) / chunk), F.floor((F.col("first") + F.col("own") - 1 + high) / chunk))
    left = left.select("key", F.explode(reach).alias("chunk"), "first", F.col("v").alias("a"), "end")
    right = cut(b, chunk, 0, 0).select("key", "chunk", F.col("first").alias("first_b"), F.col("v").alias("b"))
    pairs = left.join(right, ["key", "chunk"]).select("key", "first", "end", "a", "first_b", "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sums, places = batch.column(0).to_pylist(), {}, {}
            for k, p in enumerate(pieces(batch)):
                x, y, shift = p.arrays["a"], p.arrays["b"], p.row["first_b"] - p.row["first"]
                x = x[: max(0, p.row["end"] - trim - p.row["first"])]
                first, last = max(low, shift - len(x) + 1), min(high, shift + len(y) - 1)
                if not len(x) or first > last:
                    continue
                m = np.arange(first - shift, last - shift + 1)
                name = tuple(keys[k].values())
                if name not in sums:
                    places[name] = k
                    sums[name] = (np.zeros(high - low + 1), np.zeros(high - low + 1, np.int64))
                sums[name][0][first - low : last - low + 1] += block(x, y, m[0], m[-1])
                sums[name][1][first - low : last - low + 1] += np.minimum(len(x), len(y) - m) - np.maximum(0, -m)
            for name, (s, n) in sums.items():
                lags = np.flatnonzero(n)
                back = pa.array(np.full(len(lags), places[name]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(back), pa.array(lags + low, pa.int32()), pa.array(s[lags], pa.float64()), pa.array(n[lags], pa.int64())], ["key", "lag", "s", "n"])

    parts = pairs.mapInArrow(each, f"key {pairs.schema['key'].dataType.simpleString()}, lag int, s double, n long")
    total = parts.groupBy("key", "lag").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return total.select("key.clip_id", "key.ch", "lag", "s", "n")
