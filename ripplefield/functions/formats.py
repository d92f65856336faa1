"""Sample formats: conversions that respect full scale, raw casts that saturate, and interleaving.

ANSI casts raise on overflow, so every integer cast is clamped first; that is what saturation means here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format:
    """Range and storage of a sample format; ``centre`` is its silence."""

    name: str
    bits: int
    low: int
    high: int
    storage: str
    centre: int = 0

    @property
    def is_float(self) -> bool:
        return self.storage in ("float", "double")

    @property
    def byte_size(self) -> int:
        return self.bits // 8


FORMATS = {
    f.name: f
    for f in (
        Format("u8", 8, 0, 255, "smallint", 128),
        Format("i16", 16, -(1 << 15), (1 << 15) - 1, "smallint"),
        Format("i24", 24, -(1 << 23), (1 << 23) - 1, "int"),
        Format("i32", 32, -(1 << 31), (1 << 31) - 1, "int"),
        Format("f32", 32, -1, 1, "float"),
        Format("f64", 64, -1, 1, "double"),
    )
}


def sample_format(name: str) -> Format:
    """A format by name, in either case."""
    try:
        return FORMATS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown sample format {name!r}; known: {', '.join(FORMATS)}") from None


def _clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def to_float(v: Column, source: str) -> Column:
    """Full scale to -1..1: the negative and the positive side have their own divisors."""
    f, v = sample_format(source), v.cast("double")
    if f.is_float:
        return v
    if f.name == "u8":
        return F.when(v < 128, (v - 128) / 128.0).otherwise((v - 128) / 127.0)
    return F.when(v < 0, v / float(-f.low)).otherwise(v / float(f.high))


def from_float(v: Column, target: str) -> Column:
    """-1..1 to full scale: clamped; i16 and i32 truncate by the positive side, i24 and u8 round each side."""
    f, v = sample_format(target), v.cast("double")
    if f.is_float:
        return v.cast(f.storage)
    clamped = F.when(F.isnan(v), F.lit(-1.0)).otherwise(_clamp(v, -1.0, 1.0))
    if f.name == "u8":
        return (F.round(F.when(clamped < 0, clamped * 128.0).otherwise(clamped * 127.0)) + 128).cast(f.storage)
    if f.name == "i24":
        return F.round(F.when(clamped < 0, clamped * float(-f.low)).otherwise(clamped * float(f.high))).cast(f.storage)
    return _clamp(clamped * float(f.high), f.low, f.high).cast(f.storage)


def convert(v: Column, source: str, target: str) -> Column:
    """Conversion that respects full scale, between any two formats."""
    s, t = sample_format(source), sample_format(target)
    if s == t:
        return v
    if s.is_float:
        return from_float(v, target)
    if t.is_float:
        return to_float(v, source).cast(t.storage)
    if "u8" in (s.name, t.name):
        return from_float(to_float(v, source), target)
    shift = t.bits - s.bits
    wide = v.cast("long")
    moved = F.shiftleft(wide, shift) if shift > 0 else F.shiftright(wide, -shift)
    return _clamp(moved, t.low, t.high).cast(t.storage)


def raw_cast(v: Column, target: str) -> Column:
    """The number itself in another format: truncated toward zero and saturated; NaN is 0."""
    t = sample_format(target)
    if t.is_float:
        return v.cast(t.storage)
    d = v.cast("double")
    whole = F.when(F.isnan(d), F.lit(0.0)).otherwise(F.when(d < 0, F.ceil(_clamp(d, -4e9, 4e9))).otherwise(F.floor(_clamp(d, -4e9, 4e9))).cast("double"))
    if t.name == "i24":  # out of range is the lowest value here, not the nearest
        return F.when(whole.between(t.low, t.high), whole).otherwise(F.lit(float(t.low))).cast(t.storage)
    return _clamp(whole, t.low, t.high).cast(t.storage)


def as_format(df: DataFrame, source: str, target: str) -> DataFrame:
    """Convert the sample column of a long form."""
    return df.withColumn("v", convert(F.col("v"), source, target))


def cast_format(df: DataFrame, target: str) -> DataFrame:
    """Raw-cast the sample column of a long form."""
    return df.withColumn("v", raw_cast(F.col("v"), target))


def deinterleave(df: DataFrame, channels: int, pos: str = "idx") -> DataFrame:
    """Positions of an interleaved stream to ``(ch, idx)``; narrow."""
    _positive(channels)
    p = F.col(pos)
    return df.withColumns({"ch": F.pmod(p, F.lit(channels)).cast("int"), "idx": F.floor(p / channels).cast("long")})


def interleave(df: DataFrame, channels: int) -> DataFrame:
    """``(ch, idx)`` to positions of an interleaved stream (channel 0); narrow."""
    _positive(channels)
    return df.withColumns({"idx": F.col("idx") * channels + F.col("ch"), "ch": F.lit(0)})


def check_divides(df: DataFrame, channels: int) -> DataFrame:
    """Fail in the plan if a clip's samples aren't a multiple of the channels."""
    whole = df.groupBy("clip_id").agg(F.count("*").alias("n"))
    return whole.select("clip_id", F.when(F.col("n") % channels == 0, F.col("n")).otherwise(F.raise_error(F.lit("length is no multiple of the channels")).cast("long")).alias("n"))


def interleaved_bytes(df: DataFrame, fmt: str) -> DataFrame:
    """Each clip as raw little-endian bytes of its interleaved samples (JVM only, for integer formats)."""
    f = sample_format(fmt)
    if f.is_float:
        raise ValueError("bytes are given for integer formats")
    unsigned = F.pmod(F.col("v").cast("long"), F.lit(1 << f.bits))
    big = F.lpad(F.hex(unsigned), f.byte_size * 2, "0")
    little = F.concat(*(F.substring(big, f.byte_size * 2 - 1 - 2 * k, 2) for k in range(f.byte_size)))
    ordered = F.sort_array(F.collect_list(F.struct("idx", "ch", little.alias("h"))))
    return df.groupBy("clip_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), "")).alias("data"))


def _positive(channels: int) -> None:
    if channels < 1:
        raise ValueError("at least one channel")
