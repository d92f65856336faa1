"""Columns of ISO base media containers, read from their boxes and sample tables only.

``describe`` walks the nested boxes of a container and decodes the sample tables of every track: codec,
timescale, duration, samples, and the byte ranges and presentation times of the sync (key) samples.  Payloads
are never decoded, and only offsets of ``mdat`` are used.  Supported: 32-bit, 64-bit and to-the-end box sizes,
versions 0 and 1 of the header boxes, ``stts`` and ``ctts``, ``stsz`` and compact ``stz2``, ``stco`` and ``co64``,
tracks without ``stss`` (all samples sync), and movie fragments (``moof``: ``trex`` defaults, ``tfhd``, ``tfdt``, any
number of ``trun``).

``wrap`` stores bytes losslessly as 8-bit samples of a one-track container, in access units of ``UNIT`` bytes
with every ``KEY``-th unit a sync sample; ``payload`` reads them back through the sample tables.

Defined cases: null containers and bytes that are no boxes give no tracks and an ``error``; torn boxes end
the walk with what was found, and so do tables that claim more samples than the container has bytes; null text
is the empty payload; equal payloads give equal containers (all times in headers are zero); repeated rows are
described each; a container is held whole by its task, so a very long text costs its own size; an empty table
gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes that hold boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"moof", b"traf", b"edts", b"mvex", b"dinf", b"udta"))

UNIT, KEY, RATE = 64, 16, 8000


def _empty() -> np.ndarray:
    return np.empty(0, np.int64)


@dataclass
class Track:
    """What the boxes say about one track."""

    number: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=_empty)
    offsets: np.ndarray = field(default_factory=_empty)
    deltas: np.ndarray = field(default_factory=_empty)  # decode duration of each sample
    shifts: np.ndarray = field(default_factory=_empty)  # presentation time less decode time
    starts: np.ndarray = field(default_factory=_empty)  # decode times that fragments state, by sample; else -1
    sync: np.ndarray | None = None

    @property
    def keys(self) -> np.ndarray:
        """Numbers of the sync samples, from 0."""
        return np.arange(len(self.sizes)) if self.sync is None else self.sync[(self.sync >= 0) & (self.sync < len(self.sizes))]

    def key_ranges(self) -> list[tuple[int, int]]:
        """(offset, length) of every sync sample."""
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist(), strict=True))

    def times(self) -> np.ndarray:
        """Presentation time of every sample, in units of the timescale."""
        n = len(self.sizes)
        delta, shift = _fitted(self.deltas, n, 0), _fitted(self.shifts, n, 0)
        decode = np.cumsum(delta) - delta
        stated = np.flatnonzero(_fitted(self.starts, n, -1) >= 0) if len(self.starts) else _empty()
        for at, end in zip(stated.tolist(), [*stated[1:].tolist(), n], strict=False):
            decode[at:end] += self.starts[at] - decode[at]
        return decode + shift


def _fitted(values: np.ndarray, n: int, other: int) -> np.ndarray:
    """The values cut or filled to n."""
    return np.r_[values[:n], np.full(max(0, n - len(values)), other, np.int64)]


def _runs(data: memoryview, at: int, most: int, kind: str) -> np.ndarray:
    """Values of a run-length table ``(count, value)``, at most ``most`` of them."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    counts = np.minimum(_ints(data, at + 8, 2 * n, ">u4")[::2], most)
    counts = np.diff(np.minimum(np.cumsum(counts), most), prepend=0)
    return np.repeat(_ints(data, at + 8, 2 * n, kind)[1::2], counts)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """Type, start, first byte of the content and end of each box; a torn one ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield bytes(kind), start, start + head, start + size
        start += size


#: Containers nested deeper than this are torn; real files nest about ten.
DEEPEST = 64
#: Offsets and times from here on are torn: sums with table values would leave 64 bits.
FARTHEST = 1 << 62


def tree(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """All boxes, outer before inner, with their paths, starts, first content bytes and ends."""
    open_: list[tuple[tuple[bytes, ...], Iterator]] = [((), boxes(data, 0, len(data)))]
    while open_:
        path, rest = open_[-1]
        box = next(rest, None)
        if box is None:
            open_.pop()
            continue
        kind, head, a, b = box
        yield (*path, kind), head, a, b
        if kind in CONTAINERS:
            if len(open_) >= DEEPEST:
                raise ValueError("nested too deeply")
            open_.append(((*path, kind), boxes(data, a, b)))


def _ints(data: memoryview, at: int, count: int, kind: str) -> np.ndarray:
    raw = np.frombuffer(data, kind, count, at)
    if kind.endswith("u8") and len(raw) and int(raw.max()) >= FARTHEST:
        raise ValueError("an offset too far")
    return raw.astype(np.int64)


def _bounded(value: int) -> int:
    """The value, if it leaves room for sums."""
    if value >= FARTHEST:
        raise ValueError("a value too large")
    return value


def _versioned(data: memoryview, at: int) -> tuple[int, int]:
    """Timescale and duration of a media header; a duration of all ones is unknown and reads as 0."""
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    unknown = duration == (1 << (64 if data[at] == 1 else 32)) - 1
    return scale, 0 if unknown else _bounded(duration)


def _place(track: Track, chunks: np.ndarray, runs: np.ndarray) -> None:
    """Offsets of the samples from chunk offsets and sample-to-chunk runs."""
    if not len(chunks) or not len(runs) or not len(track.sizes):
        return
    first, per = runs[:, 0] - 1, runs[:, 1]
    lasts = np.r_[first[1:], len(chunks)]
    in_chunk = np.repeat(per, np.maximum(lasts - first, 0))[: len(chunks)]
    of = np.repeat(np.arange(len(in_chunk)), in_chunk)[: len(track.sizes)]
    track.sizes = track.sizes[: len(of)]
    before = np.cumsum(track.sizes) - track.sizes
    head = np.r_[True, of[1:] != of[:-1]]
    base = np.maximum.accumulate(np.where(head, np.arange(len(of)), 0))
    track.offsets = chunks[of] + before - before[base]


@dataclass
class Fragment:
    """A track fragment while its boxes are read: where its data lie, defaults of its samples, its first time."""

    track: Track
    base: int
    at: int | None = None  # where the next run without an offset of its own begins
    delta: int = 0
    size: int = 0
    flags: int = 0
    time: int = -1

    def header(self, data: memoryview, at: int, moof: int, before: int | None) -> None:
        """``tfhd``: without a stated base, data count from the ``moof``, or go on after the fragment before."""
        flags, pos = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, at + 8
        if flags & 1:
            self.base = _bounded(struct.unpack_from(">Q", data, pos)[0])
            pos += 8
        else:
            self.base = moof if flags & 0x20000 or before is None else before
        pos += 4 * bool(flags & 2)
        for bit, name in ((8, "delta"), (0x10, "size"), (0x20, "flags")):
            if flags & bit:
                setattr(self, name, struct.unpack_from(">I", data, pos)[0])
                pos += 4

    def run(self, data: memoryview, at: int) -> None:
        """``trun``: append its samples; a run without an offset follows the one before it."""
        head, count = struct.unpack_from(">II", data, at)
        flags, pos, t = head & 0xFFFFFF, at + 8, self.track
        if flags & 1:
            self.at = self.base + struct.unpack_from(">i", data, pos)[0]
            pos += 4
        elif self.at is None:
            self.at = self.base
        first_flags = None
        if flags & 4:
            first_flags = struct.unpack_from(">I", data, pos)[0]
            pos += 4
        fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
        if not fields:
            count = min(count, len(data))
        signed = _ints(data, pos, count * len(fields), ">i4").reshape(count, len(fields)) if fields else np.zeros((count, 0), np.int64)
        col = lambda f, other: signed[:, fields.index(f)] & 0xFFFFFFFF if f in fields else np.full(count, other, np.int64)
        sizes, marks, deltas = col(0x200, self.size), col(0x400, self.flags).copy(), col(0x100, self.delta)
        shifts = signed[:, fields.index(0x800)] if 0x800 in fields else np.zeros(count, np.int64)
        if first_flags is not None and count:
            marks[0] = first_flags
        n = len(t.sizes)
        old = t.keys if n else _empty()
        starts = np.full(count, -1, np.int64)
        if count and self.time >= 0:
            starts[0], self.time = self.time, -1
        t.deltas, t.shifts, t.starts = (np.r_[_fitted(a, n, d), b] for a, d, b in ((t.deltas, 0, deltas), (t.shifts, 0, shifts), (t.starts, -1, starts)))
        t.offsets = np.r_[t.offsets, self.at + np.cumsum(sizes) - sizes]
        t.sizes = np.r_[t.sizes, sizes]
        t.sync = np.r_[old, n + np.flatnonzero(~(marks >> 16) & 1)]
        t.duration = _bounded(t.duration + int(deltas.sum()))
        self.at = _bounded(self.at + int(sizes.sum()))


def describe(data: bytes | None) -> tuple[list[Track], str]:
    """The tracks of a container and an error text (empty if none)."""
    if not data:
        return [], "empty"
    view, tracks, by_number = memoryview(data), [], {}
    chunks, runs, fragment, moof = _empty(), np.empty((0, 3), np.int64), None, 0
    defaults: dict[int, tuple[int, int, int]] = {}
    seen: set[bytes] = set()
    try:
        for path, head, a, b in tree(view):
            kind, t = path[-1], tracks[-1] if tracks else None
            seen.add(kind)
            if kind == b"trak":
                tracks.append(Track())
                chunks, runs = _empty(), np.empty((0, 3), np.int64)
            elif kind == b"trex":
                number, _, delta, size, flags = struct.unpack_from(">5I", view, a + 4)
                defaults[number] = delta, size, flags
            elif kind == b"moof":
                moof, fragment = head, None
            elif kind == b"tfhd":
                number, before = struct.unpack_from(">I", view, a + 4)[0], fragment.at if fragment else None
                delta, size, flags = defaults.get(number, (0, 0, 0))
                fragment = Fragment(by_number.get(number, Track()), moof, None, delta, size, flags)
                fragment.header(view, a, moof, before)
            elif kind == b"tfdt" and fragment:
                fragment.time = _bounded(struct.unpack_from(">Q" if view[a] == 1 else ">I", view, a + 4)[0])
            elif kind == b"trun" and fragment:
                fragment.run(view, a)
            elif t is None:
                continue
            elif kind == b"tkhd":
                t.number = struct.unpack_from(">I", view, a + (20 if view[a] == 1 else 12))[0]
                by_number[t.number] = t
            elif kind == b"mdhd":
                t.timescale, t.duration = _versioned(view, a)
            elif kind == b"hdlr" and path[-2] == b"mdia":
                t.handler = bytes(view[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd":
                t.codec = bytes(view[a + 12 : a + 16]).decode("latin-1")
            elif kind == b"stsz":
                size, n = struct.unpack_from(">II", view, a + 4)
                t.sizes = np.full(min(n, len(data)), size, np.int64) if size else _ints(view, a + 12, n, ">u4")
            elif kind == b"stts":
                t.deltas = _runs(view, a, len(data), ">u4")
            elif kind == b"ctts":
                t.shifts = _runs(view, a, len(data), ">i4")
            elif kind == b"stz2":
                bits, n = view[a + 7], struct.unpack_from(">I", view, a + 8)[0]
                if bits == 4:
                    raw = np.frombuffer(view, np.uint8, (n + 1) // 2, a + 12)
                    t.sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
                else:
                    t.sizes = _ints(view, a + 12, n, ">u1" if bits == 8 else ">u2")
            elif kind == b"stss":
                t.sync = _ints(view, a + 8, struct.unpack_from(">I", view, a + 4)[0], ">u4") - 1
            elif kind == b"stsc":
                runs = _ints(view, a + 8, 3 * struct.unpack_from(">I", view, a + 4)[0], ">u4").reshape(-1, 3)
            elif kind in (b"stco", b"co64"):
                chunks = _ints(view, a + 8, struct.unpack_from(">I", view, a + 4)[0], ">u4" if kind == b"stco" else ">u8")
            if t is not None and kind in (b"stco", b"co64", b"stsz", b"stz2", b"stsc"):
                _place(t, chunks, runs)
    except (struct.error, ValueError, IndexError) as e:
        return tracks, f"torn: {type(e).__name__}"
    return tracks, "" if seen & {b"moov", b"moof"} else "no movie box"


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *content: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *content)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def wrap(payload: bytes) -> bytes:
    """A container whose one track holds ``payload`` (a positive multiple of ``UNIT`` bytes) as 8-bit samples."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    keys = np.arange(1, units + 1, KEY, dtype=">u4")

    def movie(at: int) -> bytes:
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, units, UNIT)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">IIII", 1, 1, units, 1)),
            _full(b"stsz", struct.pack(">II", UNIT, units)),
            _full(b"stco", struct.pack(">II", 1, at)),
        )
        minf = _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
        head = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload), 0x55C4, 0))
        mdia = _box(b"mdia", head, _full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 13), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, len(payload)), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, b"\0" * 8, flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, len(payload), 0x10000, 0x100), b"\0" * 10, MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    front = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    size = len(payload) + 8
    mdat = struct.pack(">I4s", size, b"mdat") if size < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", size + 8)
    at = len(front) + len(movie(0)) + len(mdat)
    return b"".join((front, movie(at), mdat, payload))


def payload(data: bytes, track: Track) -> bytes:
    """The bytes of a track's samples in order; samples that lie together are copied together."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(np.r_[True, track.offsets[1:] != ends[:-1]])
    last = np.r_[cuts[1:] - 1, len(ends) - 1]
    return b"".join(data[a:b] for a, b in zip(track.offsets[cuts].tolist(), ends[last].tolist(), strict=True))


COLUMNS = "tracks array<struct<handler:string,codec:string,timescale:long,duration:long,seconds:double,samples:long,keyframes:array<struct<offset:long,length:long,time:long>>>>, error string"


def media_columns(df: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """Per container: the tracks with codec, duration and keyframe byte ranges, and an error text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(data_col).cast("binary").alias("data"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tracks, errors = [], []
            for d in b.column(1):
                found, error = describe(d.as_py())
                tracks.append([_row(t) for t in found])
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tracks, ARROW), pa.array(errors, pa.string())], ["id", "tracks", "error"])

    return rows.mapInArrow(each, f"id {dict(rows.dtypes)['id']}, {COLUMNS}")


ARROW = pa.list_(
    pa.struct(
        [
            ("handler", pa.string()),
            ("codec", pa.string()),
            ("timescale", pa.int64()),
            ("duration", pa.int64()),
            ("seconds", pa.float64()),
            ("samples", pa.int64()),
            ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("time", pa.int64())]))),
        ]
    )
)


def _row(t: Track) -> dict:
    seconds = t.duration / t.timescale if t.timescale else None
    keys = []
    if len(t.offsets) == len(t.sizes):
        keys = [{"offset": a, "length": n, "time": at} for (a, n), at in zip(t.key_ranges(), t.times()[t.keys].tolist(), strict=True)]
    return {"handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "seconds": seconds, "samples": len(t.sizes), "keyframes": keys}


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of a text, and its bytes with zeros up to a positive multiple of ``UNIT``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


def feature(track: Track) -> str:
    """Codec, duration and keyframes of a track in one line."""
    ranges = track.key_ranges()
    digest = zlib.crc32(np.array(ranges, ">u8").tobytes())
    first, last = ranges[0], ranges[-1]
    return f"{track.codec.strip()} {track.duration}/{track.timescale} samples={len(track.sizes)} keys={len(ranges)} first={first[0]}+{first[1]} last={last[0]}+{last[1]} crc={digest:08x}"


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a container, read it back through its tables, and describe what was stored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                n, raw = padded(t.as_py())
                stored = wrap(raw)
                tracks, error = describe(stored)
                if error or len(tracks) != 1:
                    raise ValueError(f"a stored container can't be read: {error}")
                back = payload(stored, tracks[0])
                out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(tracks[0])))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(each, schema)
