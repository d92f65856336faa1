"""Construction, shape, slicing, elementwise maps and arithmetic of clips in long form."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplefield.operators.clipwise import with_clip

from ripplefield.functions import formats

KEYS = ["clip_id", "ch", "idx"]


def fail(message: str, kind: str = "long") -> Column:
    """An expression that stops the query."""
    return F.raise_error(F.lit(message)).cast(kind)


def new_mono(spark: SparkSession, samples: Sequence[float], clip_id: int = 0) -> DataFrame:
    """A mono clip; no samples are an error."""
    return from_channels(spark, [samples], clip_id)


def from_channels(spark: SparkSession, channels: Sequence[Sequence[float]], clip_id: int = 0) -> DataFrame:
    """A clip from channels of one length; none, or empty ones, are an error."""
    if not channels or not len(channels[0]):
        raise ValueError("a clip needs samples")
    if len({len(c) for c in channels}) > 1:
        raise ValueError("channels must have one length")
    rows = [(clip_id, c, i, float(x)) for c, samples in enumerate(channels) for i, x in enumerate(samples)]
    return spark.createDataFrame(rows, "clip_id long, ch int, idx long, v double")


def from_planar(spark: SparkSession, samples: Sequence[float], channels: int, clip_id: int = 0) -> DataFrame:
    """A clip from one channel after the other."""
    if channels < 1 or len(samples) % channels:
        raise ValueError("the length must be a multiple of the channels")
    n = len(samples) // channels
    return from_channels(spark, [samples[c * n : (c + 1) * n] for c in range(channels)], clip_id)


def from_interleaved(spark: SparkSession, samples: Sequence[float], channels: int, clip_id: int = 0) -> DataFrame:
    """A clip from alternating samples of its channels."""
    if channels < 1 or len(samples) % channels:
        raise ValueError("the length must be a multiple of the channels")
    return from_channels(spark, [samples[c::channels] for c in range(channels)], clip_id)


def uniform(spark: SparkSession, n: int, value: float, channels: int = 1, clip_id: int = 0) -> DataFrame:
    """A clip of one value; made in parallel."""
    if n < 1 or channels < 1:
        raise ValueError("a clip needs samples")
    return spark.range(n * channels).select(
        F.lit(clip_id).cast("long").alias("clip_id"), F.floor(F.col("id") / n).cast("int").alias("ch"), F.pmod("id", F.lit(n)).alias("idx"), F.lit(float(value)).alias("v")
    )


def zeros(spark: SparkSession, n: int, channels: int = 1) -> DataFrame:
    return uniform(spark, n, 0.0, channels)


def ones(spark: SparkSession, n: int, channels: int = 1) -> DataFrame:
    return uniform(spark, n, 1.0, channels)


def require_channels(df: DataFrame, n: int) -> DataFrame:
    """Fail in the plan unless every clip has ``n`` channels."""
    checked = F.when(F.col("c__") == n, F.col("ch")).otherwise(fail(f"exactly {n} channels are needed", "int"))
    return with_clip(df, c__=F.max("ch") + 1).withColumn("ch", checked).drop("c__")


def info(df: DataFrame, sample_rate: int, fmt: str = "f64") -> DataFrame:
    """Channels, frames, samples, seconds, half the rate and bytes of each clip."""
    size = formats.sample_format(fmt).byte_size
    g = df.groupBy("clip_id").agg((F.max("ch") + 1).alias("channels"), (F.max("idx") + 1).alias("frames"), F.count("*").alias("samples"))
    return g.select(
        "clip_id", F.col("channels").cast("long").alias("channels"), "frames", "samples", (F.col("frames") / float(sample_rate)).alias("seconds"), F.lit(sample_rate / 2).alias("nyquist"), (F.col("samples") * size).alias("bytes")
    )


def slice_samples(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Samples ``[start, stop)``, numbered from 0; a range that leaves a clip is an error."""
    if not 0 <= start < stop:
        raise ValueError("an empty or negative range")
    checked = with_clip(df, n__=F.max("idx") + 1)
    idx = F.when(F.col("n__") >= stop, F.col("idx") - start).otherwise(fail("the range leaves the clip"))
    return checked.where(F.col("idx").between(start, stop - 1)).select("clip_id", "ch", idx.alias("idx"), "v")


def slice_channels(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Channels ``[start, stop)``, numbered from 0."""
    if not 0 <= start < stop:
        raise ValueError("an empty or negative range")
    ch = F.when(F.col("top__") >= stop, F.col("ch") - start).otherwise(fail("the range leaves the channels", "int"))
    return with_clip(df, top__=F.max("ch") + 1).withColumn("c__", ch).where(F.col("ch").between(start, stop - 1)).select("clip_id", F.col("c__").alias("ch"), "idx", "v")


def _signed(i: int, n: Column) -> Column:
    at = F.lit(i) if i >= 0 else n + i
    return F.least(F.greatest(at, F.lit(0)), n)


def slice_both(df: DataFrame, channels: tuple[int, int], samples: tuple[int, int]) -> DataFrame:
    """Channels and samples by signed ranges: negative counts from the end, ends are clamped."""
    have = with_clip(df, n__=F.max("idx") + 1, c__=F.max("ch") + 1)
    a, b = (_signed(i, F.col("n__")) for i in samples)
    c, d = (_signed(i, F.col("c__")) for i in channels)
    inside = (F.col("idx") >= a) & (F.col("idx") < b) & (F.col("ch") >= c) & (F.col("ch") < d)
    return have.where(inside).select("clip_id", (F.col("ch") - c).cast("int").alias("ch"), (F.col("idx") - a).cast("long").alias("idx"), "v")


def map_samples(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """An expression over every sample."""
    return df.withColumn("v", f(F.col("v")))


def map_with_index(df: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """An expression over every sample's index and value."""
    return df.withColumn("v", f(F.col("idx"), F.col("v")))


def map_channels(df: DataFrame, channels: Sequence[int], f: Callable[[Column], Column]) -> DataFrame:
    """An expression over the samples of some channels."""
    return df.withColumn("v", F.when(F.col("ch").isin(list(channels)), f(F.col("v"))).otherwise(F.col("v")))


def map_range(df: DataFrame, start: int, n: int, f: Callable[[Column], Column]) -> DataFrame:
    """An expression over the samples ``[start, start + n)`` of every channel."""
    return df.withColumn("v", F.when(F.col("idx").between(start, start + n - 1), f(F.col("v"))).otherwise(F.col("v")))


def power(df: DataFrame, exponent: float, modulo: float | None = None) -> DataFrame:
    """Samples to a power, and modulo a number if one is given."""
    v = F.pow("v", F.lit(float(exponent)))
    return df.withColumn("v", v if modulo is None else v % F.lit(float(modulo)))


def apply_windowed(df: DataFrame, size: int, hop: int, f: Callable[[Column, Column], Column]) -> DataFrame:
    """``f(window, previous window)`` over arrays of full windows; overlaps are averaged.

    The result has ``(windows - 1) * hop + size`` samples; clips shorter than a window stay as they are.
    The first window's predecessor is null.
    """
    from ripplefield.operators.frames import frames

    whole = frames(df, size, hop, "skip").groupBy("clip_id", "ch", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("w"))
    prev = F.lag("w").over(Window.partitionBy("clip_id", "ch").orderBy("frame"))
    mapped = whole.withColumn("p", prev).select("clip_id", "ch", "frame", F.posexplode(f(F.col("w"), F.col("p"))).alias("pos", "x"))
    added = mapped.groupBy("clip_id", "ch", (F.col("frame") * hop + F.col("pos")).alias("idx")).agg(F.avg("x").alias("v"))
    short = with_clip(df, n__=F.max("idx") + 1).where(F.col("n__") < size).drop("n__")
    return added.unionByName(short.select(added.columns))


OPS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)}


def arithmetic(a: DataFrame, b: DataFrame | float, op: str) -> DataFrame:
    """Samples of two clips, or of a clip and a number, added, subtracted, multiplied or divided.

    Two clips must have the same shape: a sample without a partner stops the query.
    """
    if op not in OPS:
        raise ValueError(f"op must be one of {sorted(OPS)}")
    if not isinstance(b, DataFrame):
        return a.withColumn("v", OPS[op](F.col("v"), F.lit(float(b))))
    right = b.select(*KEYS, F.col("v").alias("w"))
    v = F.when(F.col("v").isNull() | F.col("w").isNull(), fail("clips differ in shape", "double")).otherwise(OPS[op](F.col("v"), F.col("w")))
    return a.join(right, KEYS, "full").select(*KEYS, v.alias("v"))


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn("v", -F.col("v"))


def to_clips(df: DataFrame, sample_rate: int, fmt: str = "f64") -> DataFrame:
    """Clip form: one row per clip with nested channels."""
    one = df.groupBy("clip_id", "ch").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"]).alias("s"))
    clip = one.groupBy("clip_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ch", "s"))), lambda x: x["s"]).alias("samples"))
    return clip.select("clip_id", F.lit(sample_rate).alias("sample_rate"), F.size("samples").alias("n_channels"), F.size(F.col("samples")[0]).cast("long").alias("n_samples"), F.lit(fmt).alias("sample_type"), "samples")


def from_clips(clips: DataFrame) -> DataFrame:
    """Long form of the clip form; narrow."""
    one = clips.select("clip_id", F.posexplode("samples").alias("ch", "s"))
    return one.select("clip_id", "ch", F.posexplode("s").alias("idx", "v")).select("clip_id", "ch", F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v"))


def replace_samples(df: DataFrame, new: DataFrame) -> DataFrame:
    """The samples of ``new`` in place of a clip's; another number of channels stops the query."""
    have = df.groupBy("clip_id").agg((F.max("ch") + 1).alias("c__"))
    got = new.groupBy("clip_id").agg((F.max("ch") + 1).alias("k__"))
    same = have.join(got, "clip_id").select("clip_id", F.when(F.col("c__") == F.col("k__"), F.lit(True)).otherwise(F.raise_error(F.lit("another number of channels")).cast("boolean")).alias("ok__"))
    return new.join(same, "clip_id").where("ok__").select("clip_id", "ch", "idx", "v")


def replace_interleaved(df: DataFrame, samples: Sequence[float], channels: int, clip_id: int = 0) -> DataFrame:
    """Interleaved samples in place of one clip's; the channels must agree."""
    return replace_samples(df, from_interleaved(df.sparkSession, samples, channels, clip_id))


def left_right_columns(df: DataFrame) -> DataFrame:
    """Stereo with a row per instant: ``(clip_id, idx, left, right)``."""
    sides = (F.max(F.when(F.col("ch") == k, F.col("v"))).alias(n) for k, n in ((0, "left"), (1, "right")))
    return require_channels(df, 2).groupBy("clip_id", "idx").agg(*sides)


def with_stereo(df: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """An expression over left and right at each instant: ``(clip_id, idx, v)``."""
    return left_right_columns(df).select("clip_id", "idx", f(F.col("left"), F.col("right")).alias("v"))


def fixed_length(df: DataFrame, n: int) -> DataFrame:
    """Fail in the plan unless every clip has ``n`` samples a channel."""
    return with_clip(df, n__=F.max("idx") + 1).withColumn("idx", F.when(F.col("n__") == n, F.col("idx")).otherwise(fail(f"exactly {n} samples are needed"))).drop("n__")
