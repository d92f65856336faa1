"""Per-channel kernels: a clip's channel as one ordered array, for what expressions can't say.

The JVM gathers and orders the samples of each channel into an array; Arrow batches of such rows go through
numpy and come back as arrays.  That costs a few dozen microseconds a channel, where a group of its own would
cost a millisecond, and a channel is still one task's work whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def channel_arrays(df: DataFrame) -> DataFrame:
    """``(clip_id, ch, w)`` with the samples of each channel in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", F.col("v").cast("double").alias("v")))), lambda x: x["v"])
    return df.groupBy("clip_id", "ch").agg(ordered.alias("w")).select(F.col("clip_id").cast("long").alias("clip_id"), "ch", "w")


def arrays_of(batch: pa.RecordBatch, column: int = 2) -> Iterator[np.ndarray]:
    """The lists of a column as arrays; nulls are NaN."""
    lists = batch.column(column)
    values, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(lists.value_lengths().to_pylist())])
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[a:b]


def map_channel(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply ``kernel`` to the ordered samples of every channel; the result is numbered anew."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.asarray(kernel(x), np.float64) for x in arrays_of(b)]
            offsets = np.cumsum([0, *map(len, out)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(out) if out else np.empty(0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["clip_id", "ch", "w"])

    done = channel_arrays(df).mapInArrow(each, "clip_id long, ch int, w array<double>")
    return done.select("clip_id", "ch", F.posexplode("w").alias("idx", "v")).select("clip_id", "ch", F.col("idx").cast("long").alias("idx"), "v")


def table_channel(df: DataFrame, kernel: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """Like ``map_channel``, for kernels that return columns; ``schema`` names them."""
    fields = [f.split() for f in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [kernel(x) for x in arrays_of(b)]
            sizes = [len(f[fields[0][0]]) for f in found]
            back = pa.array(np.repeat(np.arange(len(found)), sizes))
            cols = [pa.array([v for f in found for v in (f[n].tolist() if isinstance(f[n], np.ndarray) else f[n])], ARROW[kind]) for n, kind in fields]
            yield pa.RecordBatch.from_arrays([b.column(0).take(back), b.column(1).take(back), *cols], ["clip_id", "ch", *(n for n, _ in fields)])

    return channel_arrays(df).mapInArrow(each, f"clip_id long, ch int, {schema}")


def pair_channel(a: DataFrame, b: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """Kernels over the same channel of two signals; channels that only one has are left out."""
    fields = [f.split() for f in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kernel(x, y) for x, y in zip(arrays_of(batch, 2), arrays_of(batch, 3), strict=True)]
            if not found:
                continue
            back = pa.array(np.repeat(np.arange(len(found)), [len(f[fields[0][0]]) for f in found]))
            columns = [pa.array(np.concatenate([f[n] for f in found]), ARROW[kind], from_pandas=True) for n, kind in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(back), batch.column(1).take(back), *columns], ["clip_id", "ch", *(n for n, _ in fields)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        df = df.select(*(F.col(c).alias(c) for c in ("clip_id", "ch", "idx", "v")))  # one may derive from the other
        return channel_arrays(df).select(F.struct("clip_id", "ch").alias("key"), F.col("w").alias(name))  # structs are equal on nulls

    both = keyed(a, "x").join(keyed(b, "y"), "key").select("key.clip_id", "key.ch", "x", "y")
    return both.mapInArrow(each, f"clip_id long, ch int, {schema}")
