"""Queries over the statistics of clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplefield.operators import stats
from ripplefield.sources.tables import event_clips

#: The SQL form of ``event_clips``.
EVENT_CLIPS = """SELECT user_id AS clip_id, 0 AS ch, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, value - {centre} AS v FROM events"""


def clip_statistics(spark, sf_dir):
    """Levels and zero crossings of every user's centred event series."""
    s = stats.statistics(event_clips(spark, sf_dir, 50.0))
    return s.select("clip_id", "n", *(F.round(c, 6).alias(c) for c in ("rms", "peak", "mean", "std_dev")), "zero_crossings")


QUERIES = {"clip_statistics": clip_statistics}

ORACLES = {
    "clip_statistics": f"""WITH c AS ({EVENT_CLIPS.format(centre=50.0)}), p AS (SELECT *, lag(v) OVER (PARTITION BY clip_id, ch ORDER BY idx) AS p FROM c)
SELECT clip_id, count(*) AS n, round(sqrt(avg(v*v)),6) AS rms, round(max(abs(v)),6) AS peak, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std_dev,
CAST(sum(CASE WHEN (p > 0 AND v <= 0) OR (p <= 0 AND v > 0) THEN 1 ELSE 0 END) AS BIGINT) AS zero_crossings FROM p GROUP BY clip_id"""
}
