"""Numbers of a clip next to each of its rows, without a window over the clip.

An aggregation combines on the map side, so a clip of any length gives one row a task; its result is joined
back on the clip, which Spark broadcasts if there are few clips and splits if one clip is most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_clip(df: DataFrame, by: tuple[str, ...] = ("clip_id",), source: DataFrame | None = None, **aggregates: Column) -> DataFrame:
    """Adds aggregates over all rows of each clip (or of ``by``), of ``source`` if given; null ids are a clip too."""
    key = F.struct(*by)  # structs are equal on nulls
    found = (df if source is None else source).groupBy(key.alias("key__")).agg(*(a.alias(n) for n, a in aggregates.items()))
    return df.withColumn("key__", key).join(found, "key__").drop("key__")
