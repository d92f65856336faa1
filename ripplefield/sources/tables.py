"""Adapters from the driver's tables to the long form ``(clip_id, ch, idx, v)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_clips(spark: SparkSession, sf_dir: str, centre: float = 0.0) -> DataFrame:
    """Events as one clip per user, ordered by event id; ``centre`` is subtracted from the values."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    order = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(
        F.col("user_id").alias("clip_id"),
        F.lit(0).alias("ch"),
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        (F.col("value") - F.lit(centre)).alias("v"),
    )


def embedding_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors as short clips of 64 samples, in double precision."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.select(F.col("vec_id").alias("clip_id"), F.lit(0).alias("ch"), F.posexplode("embedding").alias("idx", "v")).select(
        "clip_id", "ch", F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v")
    )


def order_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as one clip per customer, ordered by date and key."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.col("o_custkey").cast("long").alias("clip_id"),
        F.lit(0).alias("ch"),
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        F.col("o_totalprice").cast("double").alias("v"),
    )


def stereo_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding vector split into two channels of 32 samples (even and odd positions)."""
    return embedding_clips(spark, sf_dir).select(
        "clip_id", F.pmod("idx", F.lit(2)).cast("int").alias("ch"), F.expr("idx div 2").alias("idx"), "v"
    )
