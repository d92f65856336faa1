"""Exact order statistics by radix selection: no sort, and no window, of a clip.

A double's bits, its sign folded in, order like the value.  Four partial aggregations count 16 bits each: the counts
of a prefix tell which longer prefix holds the wanted rank, and only samples of that prefix are counted next.  A
clip of any length gives each task at most 65,536 counts a round; the last round's prefix is the value itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 16


def ordered_bits(v: Column) -> Column:
    """A long that orders like the double: -0 equals 0, NaN is the greatest."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def _located(counts: Column, rank: Column) -> Column:
    """Of sorted ``(p, c, v)``: the entry that holds a rank, and the rank within it."""
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("v"))

    def step(a: Column, x: Column) -> Column:
        here = a["p"].isNull() & (rank < a["before"] + x["c"])
        pick = lambda n, new: F.when(here, new).otherwise(a[n]).alias(n)
        return F.struct((a["before"] + x["c"]).alias("before"), pick("p", x["p"]), pick("rank", rank - a["before"]), pick("v", x["v"]))

    return F.aggregate(counts, start, step)


def order_statistics(df: DataFrame, value: Column, by: tuple[str, ...] = ("clip_id",), **ranks: Callable[[Column], Column]) -> DataFrame:
    """``(*by, n, *ranks)``: the values at ranks from 0, each a function of the number of values; null beyond the ends.

    Null values are left out; null keys are a group.
    """
    rows = df.select(F.struct(*by).alias("key"), (value.cast("double") + F.lit(0.0)).alias("v")).where("v is not null").withColumn("u", ordered_bits(F.col("v")))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()))
    at = sizes.select("key", F.explode(wanted).alias("t")).select("key", "t.name", "t.rank").where("rank >= 0")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digits = rows.withColumn("p", F.shiftright("u", shift))
        if shift == 64 - DIGIT:
            counts = digits.groupBy("key", "p").agg(F.count("*").alias("c"), F.min("v").alias("v")).join(at, "key")
        else:
            counts = digits.withColumn("prefix", F.shiftright("p", DIGIT)).join(at, ["key", "prefix"]).groupBy("key", "name", "rank", "p").agg(F.count("*").alias("c"), F.min("v").alias("v"))
        found = counts.groupBy("key", "name", "rank").agg(F.sort_array(F.collect_list(F.struct("p", "c", "v"))).alias("s"))
        found = found.select("key", "name", _located(F.col("s"), F.col("rank")).alias("z")).where("z.p is not null")
        at = found.select("key", "name", F.col("z.p").alias("prefix"), F.col("z.rank").alias("rank"))
    best = found.select("key", "name", F.col("z.v").alias("v")).groupBy("key").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks))
    out = sizes.join(best, "key", "left")
    return out.select(*(F.col(f"key.{c}") for c in by), "n", *ranks)


def percentiles(df: DataFrame, value: Column, shares: dict[str, float], by: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """``(*by, n, *names)``: the value at rank ``floor(share (n - 1))`` of each share."""
    if not all(0 <= s <= 1 for s in shares.values()):
        raise ValueError("shares lie in [0, 1]")
    return order_statistics(df, value, by, **{name: (lambda n, s=s: F.floor((n - 1) * s)) for name, s in shares.items()})

