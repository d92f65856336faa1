"""PCM files: RIFF/WAVE read through Spark's own file source, so any store works that Spark reads."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

WAVE = "path string, sample_rate int, ch int, idx long, v double"


def parse_wave(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples (frames x channels), raw integers or floats."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, kind, rate, channels, bits, body = 12, 1, 0, 0, 0, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    width = bits // 8
    n = len(body) // max(width * channels, 1)
    raw = np.frombuffer(body, np.uint8, n * width * channels)
    if kind == 3:
        v = raw.view("<f4" if bits == 32 else "<f8").astype(float)
    elif bits == 8:
        v = raw.astype(float)
    elif bits == 24:
        b = raw.reshape(-1, 3).astype(np.int32)
        v = (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8).astype(float)
    else:
        v = raw.view({16: "<i2", 32: "<i4"}[bits]).astype(float)
    return rate, v.reshape(n, channels)


def read_wave(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sample_rate, ch, idx, v)`` of every file below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rate, v = parse_wave(r.content)
                for c in range(v.shape[1]):
                    yield pd.DataFrame({"path": r.path, "sample_rate": np.int32(rate), "ch": np.int32(c), "idx": np.arange(len(v)), "v": v[:, c]})

    return files.mapInPandas(each, WAVE)


def wave_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit file of (frames x channels) integers."""
    body = np.asarray(samples, "<i2")
    channels = body.shape[1]
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    raw = body.tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(raw)) + raw


def register_table_functions(spark: SparkSession) -> None:
    """SQL table functions: ``tone(frequency, rate, n)``, ``window_starts(n, size, hop)``, and over tables of samples
    ``clip_windows(TABLE (..), size, hop)`` and ``clip_splits(TABLE (..), size)``.

    The latter two take any table with ``clip_id``, ``idx`` and ``v``; they ask Spark themselves to part it by clip and to order it by
    index, pass the clip's own type on, and hold one window of samples.
    """
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
    from pyspark.sql.types import DoubleType, LongType, StructType

    class Tone:
        def eval(self, frequency: float, rate: int, n: int):
            for i in range(n):
                yield i, float(np.sin(2 * np.pi * frequency * i / rate))

    class WindowStarts:
        def eval(self, n: int, size: int, hop: int):
            for k, start in enumerate(range(0, n - size + 1, hop)):
                yield k, start

    def analysed(table: AnalyzeArgument, numbers: list, **columns) -> AnalyzeResult:
        """A result parted by clip and ordered by sample, with the clip's type carried over."""
        names = [] if table.dataType is None else table.dataType.names
        if not table.isTable or not {"clip_id", "idx", "v"} <= set(names):
            raise ValueError("a table with clip_id, idx and v is needed")
        if any(n.value is None or n.value < 1 for n in numbers):
            raise ValueError("sizes must be positive constants")
        schema = StructType().add("clip_id", table.dataType["clip_id"].dataType)
        for name, kind in columns.items():
            schema = schema.add(name, kind)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("clip_id")], orderBy=[OrderingColumn("idx")])

    class ClipWindows:
        """Full windows of a clip: number, start, mean and root mean square."""

        def __init__(self):
            self.near, self.n = [], 0

        @staticmethod
        def analyze(table, size, hop):
            return analysed(table, [size, hop], frame=LongType(), start=LongType(), mean=DoubleType(), rms=DoubleType())

        def eval(self, row, size: int, hop: int):
            self.near.append(row["v"])
            self.n += 1
            if len(self.near) > size:
                self.near.pop(0)
            start = self.n - size
            if start >= 0 and start % hop == 0:
                yield row["clip_id"], start // hop, start, sum(self.near) / size, (sum(v * v for v in self.near) / size) ** 0.5

    class ClipSplits:
        """Consecutive segments of a clip, the last one shorter: number, samples and peak."""

        def __init__(self):
            self.clip, self.number, self.count, self.peak = None, 0, 0, 0.0

        @staticmethod
        def analyze(table, size):
            return analysed(table, [size], segment=LongType(), samples=LongType(), peak=DoubleType())

        def eval(self, row, size: int):
            self.clip, self.count, self.peak = row["clip_id"], self.count + 1, max(self.peak, abs(row["v"]))
            if self.count == size:
                yield self.clip, self.number, self.count, self.peak
                self.number, self.count, self.peak = self.number + 1, 0, 0.0

        def terminate(self):
            if self.count:
                yield self.clip, self.number, self.count, self.peak

    spark.udtf.register("tone", udtf(Tone, returnType="idx int, v double"))
    spark.udtf.register("window_starts", udtf(WindowStarts, returnType="frame int, start int"))
    spark.udtf.register("clip_windows", udtf(ClipWindows))
    spark.udtf.register("clip_splits", udtf(ClipSplits))
