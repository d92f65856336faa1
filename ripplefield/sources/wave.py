"""A splittable WAVE data source: ``spark.read.format("ripple_wave").load(folder)`` and its writer.

A file of any length is read in ranges of frames, each a partition of its own, straight from its byte range: the
header alone is read on the driver.  Filters on channel and index are pushed down: other channels are not
decoded, and ranges of frames that can't match are no partitions.  The writer streams each clip of a task
into one file; tasks write beside the target and a commit renames, so a failed or repeated task leaves nothing behind.

The folder must be one that driver and executors can open as files.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

NAME = "ripple_wave"
SCHEMA = "path string, sample_rate int, ch int, idx long, v double"
#: Frames of a partition, and of a batch within it.
RANGE, BATCH = 1 << 22, 1 << 16
#: Short ranges share partitions so that a read has about this many, unless they would exceed ``RANGE`` frames.
PARTITIONS = 256
#: Sample types by (format tag, bits).
KINDS = {(1, 8): "u1", (1, 16): "<i2", (1, 24): "24", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}


@dataclass
class Header:
    """Where a file's samples lie and what they are."""

    rate: int
    channels: int
    kind: str
    start: int
    frames: int

    @property
    def width(self) -> int:
        """Bytes of a frame."""
        return self.channels * (3 if self.kind == "24" else np.dtype(self.kind).itemsize)


def header(path: str) -> Header:
    """The header of a file; its chunks are skipped over, not read."""
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        if (head := f.read(12))[:4] != b"RIFF" or head[8:] != b"WAVE":
            raise ValueError(f"{path} is no RIFF/WAVE file")
        rate = channels = tag = bits = 0
        while len(head := f.read(8)) == 8:
            name, length = head[:4], struct.unpack("<I", head[4:])[0]
            if name == b"fmt ":
                tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
                f.seek(length - 16 + length % 2, 1)
            elif name == b"data":
                if (tag, bits) not in KINDS or not channels:
                    raise ValueError(f"{path} has samples of an unknown kind")
                found = Header(rate, channels, KINDS[tag, bits], f.tell(), 0)
                found.frames = min(length, size - found.start) // found.width
                return found
            else:
                f.seek(length + length % 2, 1)
    raise ValueError(f"{path} has no samples")


@dataclass
class Range:
    """Frames ``[first, last)`` of a file."""

    path: str
    head: Header
    first: int
    last: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    parts: list[Range]


class WaveReader(DataSourceReader):
    """Plans ranges of frames and decodes them."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size
        self.channel, self.low, self.high = None, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take comparisons of ``ch`` and ``idx`` with numbers; give back the others."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("ch",) and isinstance(f, EqualTo) and self.channel in (None, f.value):
                self.channel = f.value
            elif name == ("idx",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        """Ranges of all files, cut to the wanted frames; short ones share a partition."""
        parts = []
        for path in sorted(glob.glob(os.path.join(self.folder, "**", "*.wav"), recursive=True)):
            head = header(path)
            end = head.frames if self.high is None else min(head.frames, self.high)
            parts += [Range(path, head, a, min(a + self.size, end)) for a in range(max(self.low, 0), end, self.size)]
        frames = [p.last - p.first for p in parts]
        most, out, size = max(self.size, min(RANGE, -(-sum(frames) // PARTITIONS))), [], 0
        for part, n in zip(parts, frames, strict=True):
            if not out or size + n > most:
                out.append(Ranges([]))
                size = 0
            out[-1].parts.append(part)
            size += n
        return out

    def read(self, ranges: Ranges) -> Iterator[pa.RecordBatch]:
        """The ranges of a partition, one after the other."""
        for part in ranges.parts:
            yield from self._decoded(part)

    def _decoded(self, part: Range) -> Iterator[pa.RecordBatch]:
        """The wanted channels of a range, in batches."""
        h = part.head
        channels = range(h.channels) if self.channel is None else [self.channel] if 0 <= self.channel < h.channels else []
        with open(part.path, "rb") as f:
            f.seek(h.start + part.first * h.width)
            for a in range(part.first, part.last, BATCH):
                n = min(BATCH, part.last - a)
                raw = np.frombuffer(f.read(n * h.width), np.uint8)
                if h.kind == "24":
                    b = raw.reshape(-1, 3).astype(np.int32)
                    v = (b[:, 2] << 24 | b[:, 1] << 16 | b[:, 0] << 8) >> 8
                else:
                    v = raw.view(h.kind)
                v = v.reshape(n, h.channels).astype(float)
                for c in channels:
                    columns = [pa.array([part.path] * n), pa.array(np.full(n, h.rate, np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(np.arange(a, a + n)), pa.array(v[:, c])]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "sample_rate", "ch", "idx", "v"])


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are, and where they go."""

    files: list[tuple[str, str]]


class WaveWriter(DataSourceArrowWriter):
    """Writes mono clips as 64-bit float files; rows of a clip follow each other in order within a task."""

    def __init__(self, folder: str, rate: int):
        self.folder, self.rate = folder, rate
        self.aside = os.path.join(folder, f".tmp-{uuid.uuid4().hex}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Stream the clips of a task into files aside."""
        os.makedirs(self.aside, exist_ok=True)
        files, f, now = [], None, None
        for b in batches:
            names = b.schema.names
            ids, v = b.column(names.index("clip_id")).to_pylist(), b.column(names.index("v")).to_numpy(zero_copy_only=False)
            edges = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
            for a, e in zip(edges[:-1], edges[1:], strict=True):
                if e > a and (f is None or ids[a] != now):
                    self._close(f)
                    now = ids[a]
                    path = os.path.join(self.aside, uuid.uuid4().hex)
                    files.append((path, os.path.join(self.folder, f"clip-{now}.wav")))
                    f = open(path, "w+b")
                    f.write(b"\0" * 44)
                if e > a:
                    f.write(np.asarray(v[a:e], "<f8").tobytes())
        self._close(f)
        return Written(files)

    def _close(self, f) -> None:
        if f is not None:
            size = f.tell() - 44
            if size >= 2**32 - 36:
                raise ValueError("a WAVE file holds less than 4 GB")
            f.seek(0)
            f.write(b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, self.rate, self.rate * 8, 8, 64) + b"data" + struct.pack("<I", size))
            f.close()

    def commit(self, messages: list[Written | None]) -> None:
        """Move the files of the tasks that counted into place."""
        for m in messages:
            for path, goal in m.files if m else []:
                os.replace(path, goal)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what is left aside."""
        for path in glob.glob(os.path.join(self.aside, "*")):
            os.remove(path)
        if os.path.isdir(self.aside):
            os.rmdir(self.aside)


class WaveSource(DataSource):
    """WAVE files below a folder; options: ``range`` (frames of a partition), ``rate`` (of what is written)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WaveReader:
        return WaveReader(self.options["path"].removeprefix("file://"), int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> WaveWriter:
        return WaveWriter(self.options["path"].removeprefix("file://"), int(self.options.get("rate", 44100)))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with its filters pushed down."""
    import ripplefield
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(ripplefield.sources.wave)  # executors need no copy of this package to plan or write
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WaveSource)


def write_clips(df: DataFrame, folder: str, rate: int) -> None:
    """One file for each clip of the first channel."""
    register(df.sparkSession)
    rows = df.where("ch = 0").repartition("clip_id").sortWithinPartitions("clip_id", "idx").select("clip_id", F.col("v").cast("double").alias("v"))
    rows.write.format(NAME).option("path", folder).option("rate", rate).mode("append").save()


def read_clips(spark: SparkSession, folder: str, size: int = RANGE) -> DataFrame:
    """``(path, sample_rate, ch, idx, v)`` of all files, in ranges of ``size`` frames."""
    register(spark)
    return spark.read.format(NAME).option("range", size).load(folder)
