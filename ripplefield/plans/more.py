"""Queries over containers, prediction, lapped transforms and live streams."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from ripplefield.operators import codec, container, detect, editing, kernels, spectral
from ripplefield.plans.spectra import FOLLOW, LONG_CLIP, SP, _section_sql, spec
from ripplefield.plans.sqlforms import EMB, EV, ST, Registry, rounded
from ripplefield.sources.tables import embedding_clips, event_clips, stereo_embeddings
from ripplefield.streaming import stateful

R = Registry()


def add(name, query, sql=None, *cols):
    R.add(name, lambda s, d: rounded(query(s, d), *cols), sql)


add("clip_replace", lambda s, d: container.replace_samples(stereo_embeddings(s, d), editing.reverse(stereo_embeddings(s, d))), f"WITH {ST} SELECT clip_id, ch, 31 - idx AS idx, round(v, 6) + 0.0 AS v FROM st", "v")
add("clip_stereo_columns", lambda s, d: container.left_right_columns(stereo_embeddings(s, d)), f'WITH {ST} SELECT clip_id, idx, round(max(v) FILTER (WHERE ch = 0), 6) + 0.0 AS "left", round(max(v) FILTER (WHERE ch = 1), 6) + 0.0 AS "right" FROM st GROUP BY clip_id, idx', "left", "right")
add("clip_with_stereo", lambda s, d: container.with_stereo(stereo_embeddings(s, d), lambda a, b: a * b), f"WITH {ST} SELECT clip_id, idx, round(max(v) FILTER (WHERE ch = 0) * max(v) FILTER (WHERE ch = 1), 6) + 0.0 AS v FROM st GROUP BY clip_id, idx", "v")
add("clip_fixed_length", lambda s, d: container.fixed_length(embedding_clips(s, d), 64), f"WITH {EMB} SELECT clip_id, ch, idx, round(v, 6) + 0.0 AS v FROM emb", "v")
add(
    "detect_cutoff_rate",
    lambda s, d: detect.cutoff_rate(spec(s, d).select("clip_id", (F.col("freq_hz") * 1000).alias("freq_hz"), spectral.power().alias("power")), 32000.0),
    f"WITH {EMB}, {SP}, c AS (SELECT clip_id, r, coalesce(sum(p) FILTER (WHERE freq_hz * 1000 < r / 2.0), 0) AS b, coalesce(sum(p) FILTER (WHERE freq_hz * 1000 >= r / 2.0), 0) AS a FROM pw, (SELECT unnest({list(detect.COMMON_RATES)}) AS r) WHERE r / 2.0 < 32000 GROUP BY ALL) SELECT clip_id, CAST(min(r) FILTER (WHERE b > 2 * a) AS BIGINT) AS rate FROM c GROUP BY clip_id",
)
add("spec_hilbert", lambda s, d: spectral.hilbert_signal(embedding_clips(s, d)), f"WITH {EMB} SELECT a.clip_id, 0 AS ch, a.idx, round(coalesce(sum(b.v * 2.0 / 64 / tan(pi() * (a.idx - b.idx) / 64.0)) FILTER (WHERE (a.idx - b.idx) % 2 <> 0), 0), 6) + 0.0 AS v FROM emb a JOIN emb b ON a.clip_id = b.clip_id AND a.idx <> b.idx GROUP BY ALL", "v")
add("lpc_round_trip", lambda s, d: kernels.map_channel(embedding_clips(s, d), lambda x: codec.lpc_synthesis(codec.lpc_residual(x, a := codec.lpc_analysis(x, 8)), a)), f"WITH {EMB} SELECT clip_id, ch, idx, round(v, 6) + 0.0 AS v FROM emb", "v")
TAPS = [0.5, -0.25]
add("lpc_residual", lambda s, d: kernels.map_channel(embedding_clips(s, d), lambda x: codec.lpc_residual(x, np.array(TAPS))), f"WITH {EMB} SELECT clip_id, ch, idx, round(v - 0.5 * coalesce(lag(v) OVER w, 0) + 0.25 * coalesce(lag(v, 2) OVER w, 0), 6) + 0.0 AS v FROM emb WINDOW w AS (PARTITION BY clip_id ORDER BY idx)", "v")
HAM = ", w AS (SELECT clip_id, idx, v * (0.54 - 0.46 * cos(2 * pi() * idx / 63)) AS v FROM emb)"
add("lpc_autocorrelation", lambda s, d: kernels.table_channel(embedding_clips(s, d), lambda x: {"lag": np.arange(9), "r": codec.autocorrelation(x, 8)}, "lag long, r double"), f"WITH {EMB}{HAM} SELECT a.clip_id, 0 AS ch, b.idx - a.idx AS lag, round(sum(a.v * b.v), 6) + 0.0 AS r FROM w a JOIN w b ON a.clip_id = b.clip_id AND b.idx - a.idx BETWEEN 0 AND 8 GROUP BY ALL", "r")
add("lpc_long_term", lambda s, d: kernels.map_channel(embedding_clips(s, d), lambda x: codec.ltp_residual(x, 5, 0.5)), f"WITH {EMB} SELECT clip_id, ch, idx, round(v - 0.5 * coalesce(lag(v, 5) OVER (PARTITION BY clip_id ORDER BY idx), 0), 6) + 0.0 AS v FROM emb", "v")
add("codec_lapped_round_trip", lambda s, d: kernels.map_channel(embedding_clips(s, d), lambda x: codec.imdct(codec.mdct(x, 8), 8, len(x))), f"WITH {EMB} SELECT clip_id, ch, idx, round(v, 6) + 0.0 AS v FROM emb", "v")
add(
    "codec_lapped_transform",
    lambda s, d: kernels.table_channel(embedding_clips(s, d), lambda x: {"k": np.arange(8 * 9), "c": codec.mdct(x, 8).ravel()}, "k long, c double").select("clip_id", F.floor(F.col("k") / 8).alias("frame"), F.pmod("k", F.lit(8)).alias("bin"), "c"),
    f"WITH {EMB}, t AS (SELECT clip_id, f AS frame, k AS bin, sum(v * sin(pi() * (n + 0.5) / 16) * cos(pi() / 8 * (n + 4.5) * (k + 0.5))) * sqrt(0.25) AS c FROM emb, range(9) a(f), range(8) b(k), range(16) c(n) WHERE idx + 8 = f * 8 + n GROUP BY ALL) SELECT clip_id, frame, bin, round(c, 6) + 0.0 AS c FROM t",
    "c",
)
add(
    "codec_mode",
    lambda s, d: kernels.table_channel(embedding_clips(s, d), lambda x: {"mode": [codec.detect_mode(x)]}, "mode string"),
    f"WITH {EMB}, e AS (SELECT clip_id, idx // 8 AS b, sum(v*v) + 1e-10 AS e FROM emb GROUP BY ALL), f AS (SELECT clip_id, exp(avg(ln(e))) / avg(e) AS f FROM e GROUP BY clip_id) SELECT clip_id, 0 AS ch, CASE WHEN f > 0.8 THEN 'music' WHEN f < 0.4 THEN 'speech' ELSE 'hybrid' END AS mode FROM f",
)
add(
    "codec_crossover",
    lambda s, d: kernels.map_channel(embedding_clips(s, d), lambda x: sum(codec.crossover(x, 0.3))),
    f"WITH {EMB} SELECT clip_id, ch, idx, round(v, 6) + 0.0 AS v FROM emb",
    "v",
)


def _streamed(spark, sf_dir, operator):
    """Run a stream over the embedding table to its end and read what it wrote to the shared folder."""
    from ripplefield.streaming.run import drain

    path = f"{sf_dir}/embeddings.parquet"
    table = spark.read.parquet(path)
    one = table.select("_metadata.file_path").first()
    # a stream's source is a folder: the table's own, or the one that holds its only file
    source = path if one is None or "/embeddings.parquet/" in one[0] else sf_dir
    live = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet" if source == path else "embeddings.parquet").parquet(source)
    long = live.select(F.col("vec_id").alias("clip_id"), F.lit(0).alias("ch"), F.posexplode("embedding").alias("idx", "v")).select("clip_id", "ch", F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v"))
    return drain(operator(long))


add("stream_recursive_filter", lambda s, d: _streamed(s, d, lambda x: stateful.stream_sections(x, LONG_CLIP)), _section_sql(LONG_CLIP), "v")
add("stream_delay", lambda s, d: _streamed(s, d, lambda x: stateful.stream_delay(x, 3)), f"WITH {EMB} SELECT clip_id, ch, idx, round(coalesce(lag(v, 3) OVER (PARTITION BY clip_id ORDER BY idx), 0), 6) + 0.0 AS v FROM emb", "v")
add("stream_prediction_residual", lambda s, d: _streamed(s, d, lambda x: stateful.stream_prediction_residual(x, TAPS)), R.ORACLES["lpc_residual"], "v")
add("stream_prediction_synthesis", lambda s, d: _streamed(s, d, lambda x: stateful.stream_prediction_synthesis(x, TAPS)), _section_sql(np.array([[1.0, 0.0, 0.0, 1.0, -TAPS[0], -TAPS[1]]])), "v")
add("stream_envelope", lambda s, d: _streamed(s, d, lambda x: stateful.stream_envelope(x, 64.0, 20, 100)), f"{FOLLOW} SELECT clip_id, 0 AS ch, idx, round(e, 6) + 0.0 AS v FROM lv", "v")



def _live_envelope(spark, sf_dir):
    """The follower of every user's events as a stream; a day of silence ends a clip's state."""
    from ripplefield.streaming import timed
    from ripplefield.streaming.run import drain

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    one = "/events.parquet/" not in spark.read.parquet(path).select("_metadata.file_path").first()[0]
    # a stream's source is a folder: the table's own, or the one that holds its only file
    live = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if one else "*.parquet").parquet(sf_dir if one else path)
    long = live.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("idx"), "ts", (F.col("value") - 50).alias("v"))
    before = spark.conf.get(timed.PROVIDER[0])
    try:
        return drain(timed.live_envelope(long, 64.0, 20, 100, 86_400.0))
    finally:
        spark.conf.set(timed.PROVIDER[0], before)


_C = "CASE WHEN abs(s.v) > CASE WHEN fresh THEN 0 ELSE f.d END THEN exp(-1 / (20 / 1000.0 * 64)) ELSE exp(-1 / (100 / 1000.0 * 64)) END"
LIVE = (
    "WITH RECURSIVE s AS (SELECT user_id AS clip_id, event_id, value - 50 AS v, row_number() OVER w AS i, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "f AS (SELECT clip_id, 0::BIGINT AS i, -1::BIGINT AS event_id, 0::DOUBLE AS d, 0::DOUBLE AS e FROM s WHERE i = 1 UNION ALL "
    f"SELECT s.clip_id, s.i, s.event_id, abs(s.v), {_C} * CASE WHEN fresh THEN 0 ELSE f.e END + (1 - {_C}) * abs(s.v) FROM f JOIN s ON s.clip_id = f.clip_id AND s.i = f.i + 1) "
    "SELECT clip_id, event_id AS idx, round(e, 6) + 0.0 AS v FROM f WHERE i > 0"
)
add("stream_live_envelope", _live_envelope, LIVE, "v")


def _wave_round_trip(spark, sf_dir):
    """Every user's events written as a WAVE file and read back in ranges of up to 1,024 frames."""
    import os
    import uuid

    from ripplefield.sources import wave
    from ripplefield.streaming.run import shared_folder

    folder = os.path.join(shared_folder(spark).removeprefix("file://"), f"wave-{uuid.uuid4().hex}")
    os.makedirs(folder)
    wave.write_clips(event_clips(spark, sf_dir, 50.0), folder, 8000)
    rows = wave.read_clips(spark, folder, 1024)
    clip = F.regexp_extract("path", r"clip-(\d+)\.wav$", 1).cast("long")
    return rows.select(clip.alias("clip_id"), "sample_rate", "idx", "v")


add("source_wave_round_trip", _wave_round_trip, f"WITH {EV} SELECT clip_id, 8000 AS sample_rate, idx, round(v, 6) + 0.0 AS v FROM ev", "v")


def _table_function(view, make, sql):
    """A SQL statement over a clip table as a view."""

    def query(spark, sf_dir):
        from ripplefield.sources.files import register_table_functions

        register_table_functions(spark)
        make(spark, sf_dir).select("clip_id", "idx", "v").createOrReplaceTempView(view)
        return spark.sql(sql)

    return query


add(
    "sql_clip_windows",
    _table_function("rf_events", event_clips, "SELECT * FROM clip_windows(TABLE(SELECT * FROM rf_events), 16, 8)"),
    f"WITH {EV.replace('- 50.0 AS v', 'AS v')}, f AS (SELECT clip_id, idx // 8 - o AS f, v FROM ev, (SELECT unnest([0, 1]) AS o) WHERE idx // 8 >= o) SELECT clip_id, f AS frame, f * 8 AS start, round(avg(v), 6) + 0.0 AS mean, round(sqrt(avg(v * v)), 6) + 0.0 AS rms FROM f GROUP BY clip_id, f HAVING count(*) = 16",
    "mean",
    "rms",
)
add(
    "sql_clip_splits",
    _table_function("rf_embeddings", embedding_clips, "SELECT * FROM clip_splits(TABLE(SELECT * FROM rf_embeddings), 25)"),
    f"WITH {EMB} SELECT clip_id, idx // 25 AS segment, count(*) AS samples, round(max(abs(v)), 6) + 0.0 AS peak FROM emb GROUP BY clip_id, idx // 25",
    "peak",
)

QUERIES, ORACLES = R.QUERIES, R.ORACLES
