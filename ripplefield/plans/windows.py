"""Queries over frames, envelopes, voice activity, peaks, regions, two-signal metrics and tempo."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplefield.operators import beats, compare, detect, editing, envelopes, frames, peaks, psycho, selection, spectral, vad
from ripplefield.plans.sqlforms import EMB, EV, ST, Registry, r6, rounded
from ripplefield.sources.tables import embedding_clips, event_clips, stereo_embeddings

R = Registry()


def ev(s, d):
    return event_clips(s, d, 50.0)


SIZED = "n AS (SELECT *, max(idx) OVER (PARTITION BY clip_id) + 1 AS n FROM {f})"
#: Frames of 16 with a hop of 8 that start inside the clip, as a range join.
FRAMES = "fr AS (SELECT clip_id, ch, f.f AS frame, idx - f.f * 8 AS pos, v, n FROM n JOIN (SELECT unnest(range(CAST((SELECT (max(n) + 7) // 8 FROM n) AS BIGINT))) AS f) f ON idx BETWEEN f.f * 8 AND f.f * 8 + 15 AND f.f * 8 < n)"
EVF = f"WITH {EV}, {SIZED.format(f='ev')}, {FRAMES}"
EMF = f"WITH {EMB}, {SIZED.format(f='emb')}, {FRAMES}"


def add(name, query, sql=None, *cols):
    R.add(name, lambda s, d: rounded(query(s, d), *cols), sql)


# --- frames -----------------------------------------------------------------------------------------------

add("frame_skip", lambda s, d: frames.frames(ev(s, d), 16, 8, "skip"), f"{EVF} SELECT clip_id, ch, frame, pos, round(v, 6) + 0.0 AS v FROM fr WHERE frame * 8 + 16 <= n", "v")
add("frame_none", lambda s, d: frames.frames(ev(s, d), 16, 8, "none"), f"{EVF} SELECT clip_id, ch, frame, pos, round(v, 6) + 0.0 AS v FROM fr", "v")
add("frame_zero", lambda s, d: frames.frames(ev(s, d), 16, 8, "zero"), f"{EVF} SELECT clip_id, ch, frame, pos, round(v, 6) + 0.0 AS v FROM fr UNION ALL SELECT clip_id, 0, frame, p, 0.0 FROM (SELECT clip_id, frame, count(*) AS k FROM fr GROUP BY ALL), range(16) t(p) WHERE p >= k", "v")
add("frame_gaps", lambda s, d: frames.frames(embedding_clips(s, d), 4, 10, "skip"), f"WITH {EMB} SELECT clip_id, ch, idx // 10 AS frame, idx % 10 AS pos, round(v, 6) + 0.0 AS v FROM emb WHERE idx % 10 < 4 AND (idx // 10) * 10 + 4 <= 64", "v")
add("frame_instants", lambda s, d: frames.sample_frames(stereo_embeddings(s, d)).select("clip_id", "idx", r6(F.col("samples")[0] + 2 * F.col("samples")[1]).alias("y")), f"WITH {ST} SELECT clip_id, idx, round(sum(v * (ch + 1)), 6) + 0.0 AS y FROM st GROUP BY clip_id, idx")
add("frame_apply", lambda s, d: frames.apply_to_frames(stereo_embeddings(s, d), lambda a: F.reverse(a)), f"WITH {ST} SELECT clip_id, 1 - ch AS ch, idx, round(v, 6) + 0.0 AS v FROM st", "v")
add("frame_apply_windows", lambda s, d: frames.apply_to_windows(embedding_clips(s, d), 16, 16, lambda w: w * 2), f"WITH {EMB} SELECT clip_id, ch, idx, round(v * 2, 6) + 0.0 AS v FROM emb", "v")
add(
    "overlay_series",
    lambda s, d: spectral.windowed_series(embedding_clips(s, d), 16, 8, 1000),
    f"{EMF}, z AS (SELECT clip_id, frame, pos, v FROM fr UNION ALL SELECT clip_id, frame, p, 0.0 FROM (SELECT clip_id, frame, count(*) AS k FROM fr GROUP BY ALL), range(16) t(p) WHERE p >= k), q AS (SELECT *, lag(v) OVER (PARTITION BY clip_id, frame ORDER BY pos) AS p FROM z) SELECT clip_id, frame, (frame * 8 + 8) / 1000.0::DOUBLE AS seconds, round(sqrt(avg(v*v)), 6) + 0.0 AS rms, round(max(abs(v)), 6) + 0.0 AS peak, round(avg(v*v), 6) + 0.0 AS energy, round(count(*) FILTER (WHERE (p > 0 AND v <= 0) OR (p <= 0 AND v > 0)) * 1000.0 / 16, 6) + 0.0 AS zcr FROM q GROUP BY clip_id, frame",
    "seconds", "rms", "peak", "energy", "zcr",
)

# --- envelopes --------------------------------------------------------------------------------------------

add("env_amplitude", lambda s, d: envelopes.amplitude_envelope(ev(s, d)), f"WITH {EV} SELECT clip_id, ch, idx, round(abs(v), 6) + 0.0 AS v FROM ev", "v")
add("env_rms", lambda s, d: envelopes.rms_envelope(ev(s, d), 16, 8), f"{EVF} SELECT clip_id, ch, frame, round(sqrt(avg(v*v)), 6) + 0.0 AS v FROM fr GROUP BY ALL", "v")
add("env_moving_average", lambda s, d: envelopes.moving_average_envelope(ev(s, d), 16, 8), f"{EVF} SELECT clip_id, ch, frame, round(avg(abs(v)), 6) + 0.0 AS v FROM fr GROUP BY ALL", "v")
add("env_analytic", lambda s, d: envelopes.analytic_envelope(embedding_clips(s, d)), f"WITH {EMB}, h AS (SELECT a.clip_id, a.idx, a.v, coalesce(sum(b.v * 2.0 / 64 / tan(pi() * (a.idx - b.idx) / 64.0)) FILTER (WHERE (a.idx - b.idx) % 2 <> 0), 0) AS h FROM emb a JOIN emb b ON a.clip_id = b.clip_id AND a.idx <> b.idx GROUP BY ALL) SELECT clip_id, 0 AS ch, idx, round(sqrt(v * v + h * h), 6) + 0.0 AS v FROM h", "v")

# --- voice activity ---------------------------------------------------------------------------------------

VC = vad.VadConfig(frame=16, hop=8, threshold_db=24.0, zcr_min=0.1, zcr_max=0.6)
FEAT = f"{EVF}, sg AS (SELECT *, CASE WHEN v <> 0 THEN sign(v) END AS s FROM fr), l AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY clip_id, frame ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM sg), ft AS (SELECT clip_id, frame, sqrt(sum(v*v) / 16) AS rms, count(*) FILTER (WHERE s <> l) / 15.0::DOUBLE AS zcr FROM l GROUP BY ALL), m0 AS (SELECT clip_id, frame, rms >= 10 ** (24.0 / 20) AS s FROM ft)"
MASK = (
    FEAT
    + ", m1 AS (SELECT clip_id, frame, 2 * count(*) FILTER (WHERE s) OVER w >= count(*) OVER w AS s FROM m0 WINDOW w AS (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"
    + ", m2 AS (SELECT clip_id, frame, coalesce(frame - max(CASE WHEN s THEN frame END) OVER (PARTITION BY clip_id ORDER BY frame) <= 2, false) AS s FROM m1)"
    + "".join(
        f", g{k} AS (SELECT *, frame - row_number() OVER (PARTITION BY clip_id, s ORDER BY frame) AS g FROM m{k}), m{k + 1} AS (SELECT clip_id, frame, CASE WHEN s = {val} AND count(*) OVER (PARTITION BY clip_id, s, g) < {least} THEN NOT s ELSE s END AS s FROM g{k})"
        for k, val, least in ((2, "true", 3), (3, "false", 5))
    )
)
add("vad_features", lambda s, d: vad.frame_features(ev(s, d), VC).drop("ch"), f"{FEAT} SELECT clip_id, frame, round(rms, 6) + 0.0 AS rms, round(zcr, 6) + 0.0 AS zcr FROM ft", "rms", "zcr")
add("vad_raw_mask", lambda s, d: vad.raw_mask(ev(s, d), VC), f"{FEAT} SELECT clip_id, frame, s AS speech FROM m0")
add("vad_combined_mask", lambda s, d: vad.raw_mask(ev(s, d), vad.VadConfig("combined", 16, 8, threshold_db=24.0, zcr_min=0.1, zcr_max=0.6)), f"{FEAT} SELECT clip_id, frame, rms >= 10 ** (24.0 / 20) AND zcr BETWEEN 0.1 AND 0.6 AS speech FROM ft")
add("vad_majority", lambda s, d: vad.majority(vad.raw_mask(ev(s, d), VC), 5), f"{MASK} SELECT clip_id, frame, s AS speech FROM m1")
add("vad_hangover", lambda s, d: vad.hangover(vad.majority(vad.raw_mask(ev(s, d), VC), 5), 2), f"{MASK} SELECT clip_id, frame, s AS speech FROM m2")
add("vad_mask", lambda s, d: vad.voice_activity_mask(ev(s, d), VC), f"{MASK} SELECT clip_id, frame, s AS speech FROM m4")
REGION = f"{MASK}, gr AS (SELECT *, frame - row_number() OVER (PARTITION BY clip_id, s ORDER BY frame) AS g FROM m4), rg AS (SELECT clip_id, min(frame) * 8 AS a, least((max(frame) + 1) * 8 + 16, (SELECT max(n) FROM n WHERE n.clip_id = gr.clip_id)) AS b FROM gr WHERE s GROUP BY clip_id, g), rl AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY clip_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM rg), ri AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY a, b) AS i FROM rl)"
add("vad_regions", lambda s, d: vad.speech_regions(ev(s, d), VC), f'{REGION} SELECT clip_id, min(a) AS "start", max(b) AS "end" FROM ri GROUP BY clip_id, i')

# --- peaks ------------------------------------------------------------------------------------------------


def series(s, d):
    """The event values as a series of frames."""
    return event_clips(s, d).select("clip_id", F.col("idx").alias("frame"), F.col("v").alias("x"))


SER = EV.replace("- 50.0 AS v", "AS x").replace("AS idx", "AS frame").replace("0 AS ch, ", "")
W = "OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"


def peak(name, query, expr, extra=""):
    add(name, query, f"WITH {SER}{extra} SELECT clip_id, frame, round({expr}, 6) + 0.0 AS x FROM ev", "x")


peak("peak_pre_emphasis", lambda s, d: peaks.pre_emphasis(series(s, d), 0.97), "coalesce(x - 0.97 * lag(x) OVER (PARTITION BY clip_id ORDER BY frame), x)")
MEDIAN = "list_sort(list(x) {w})[len(list(x) {w}) // 2 + 1]"
peak("peak_median", lambda s, d: peaks.median_filter(series(s, d), 5), MEDIAN.format(w=W.format(k=2)))
peak("peak_moving_average", lambda s, d: peaks.moving_average(series(s, d), 7), f"avg(x) {W.format(k=3)}")
add("peak_smooth", lambda s, d: peaks.smooth(series(s, d), 5, 3), f"WITH {SER}, m AS (SELECT clip_id, frame, {MEDIAN.format(w=W.format(k=1))} AS x FROM ev) SELECT clip_id, frame, round(avg(x) {W.format(k=2)}, 6) + 0.0 AS x FROM m", "x")
peak("peak_rectify", lambda s, d: peaks.rectify(series(s, d).withColumn("x", F.col("x") - 50)), "greatest(x - 50, 0)")
peak("peak_log_compress", lambda s, d: peaks.log_compress(series(s, d), 10), "ln(1 + 10 * x)")
P = "OVER (PARTITION BY clip_id)"
peak("peak_norm_peak", lambda s, d: peaks.normalize_strength(series(s, d), "peak"), f"x / max(abs(x)) {P}")
peak("peak_norm_minmax", lambda s, d: peaks.normalize_strength(series(s, d), "minmax"), f"(x - min(x) {P}) / (max(x) {P} - min(x) {P})")
peak("peak_norm_zscore", lambda s, d: peaks.normalize_strength(series(s, d), "zscore"), f"(x - avg(x) {P}) / stddev_pop(x) {P}")
add("peak_norm_mean", lambda s, d: peaks.normalize_strength(embedding_clips(s, d).select("clip_id", F.col("idx").alias("frame"), F.col("v").alias("x")), "mean"), f"WITH {EMB} SELECT clip_id, idx AS frame, round(v - avg(v) {P}, 6) + 0.0 AS x FROM emb", "x")
peak("peak_norm_median", lambda s, d: peaks.normalize_strength(series(s, d), "median"), f"x - list_sort(list(x) {P})[len(list(x) {P}) // 2 + 1]")
for _m, _e in (("delta", "max(x) {w} - 0.2"), ("percentile", "quantile_cont(x, 0.8) {w}"), ("combined", "greatest(max(x) {w} - 0.2, quantile_cont(x, 0.8) {w})")):
    add(
        f"peak_threshold_{_m}",
        lambda s, d, m=_m: peaks.adaptive_threshold(peaks.normalize_strength(series(s, d)), peaks.Threshold(m, 0.2, 0.8, 10)).select("clip_id", "frame", "threshold"),
        f"WITH {SER}, nx AS (SELECT clip_id, frame, x / max(abs(x)) {P} AS x FROM ev) SELECT clip_id, frame, round(greatest(least({_e.format(w=W.format(k=5))}, 1.0), 0.01), 6) + 0.0 AS threshold FROM nx",
        "threshold",
    )
add("peak_local_maxima", lambda s, d: series(s, d).withColumn("up", peaks.local_maxima(series(s, d))).where("up").select("clip_id", "frame"), f"WITH {SER}, l AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM ev WINDOW w AS (PARTITION BY clip_id ORDER BY frame)) SELECT clip_id, frame FROM l WHERE x > a AND x > b")
#: The greedy choice as a fold over candidates, strongest first, ties to the earlier.
GREEDY = "or_ AS (SELECT clip_id, min(s) AS s, list(struct_pack(f := frame, x := x) ORDER BY x DESC, frame) AS c FROM {src} GROUP BY clip_id), kp AS (SELECT clip_id, unnest(list_reduce(list_transform(c, lambda e: [e]), lambda k, e: CASE WHEN len(list_filter(k, lambda o: abs(o.f - e[1].f) < s)) > 0 THEN k ELSE list_concat(k, e) END)) AS k FROM or_) SELECT clip_id, k.f AS frame, round(k.x, 6) + 0.0 AS x FROM kp"
PICK = (
    f"WITH {SER}, pe AS (SELECT clip_id, frame, coalesce(x - 0.97 * lag(x) OVER (PARTITION BY clip_id ORDER BY frame), x) AS x FROM ev), "
    f"md AS (SELECT clip_id, frame, {MEDIAN.format(w=W.format(k=1))} AS x FROM pe), nm AS (SELECT clip_id, frame, x / max(abs(x)) {P} AS x, count(*) {P} AS n FROM md), "
    f"th AS (SELECT *, greatest(least(max(x) {W.format(k=5)} - 0.3, 1.0), 0.01) AS t, lag(x) OVER o AS a, lead(x) OVER o AS b FROM nm WINDOW o AS (PARTITION BY clip_id ORDER BY frame)), "
    "cd AS (SELECT clip_id, frame, x, CASE WHEN 4 >= n / 2 THEN n // 4 ELSE 4 END AS s FROM th WHERE x > a AND x > b AND x > t), "
)
add("peak_pick", lambda s, d: peaks.pick_peaks(series(s, d), peaks.PeakConfig(4, threshold=peaks.Threshold("delta", 0.3, window=10))), PICK + GREEDY.format(src="cd"), "x")
add("peak_keep_apart", lambda s, d: peaks.keep_apart(series(s, d), 5), f"WITH {SER}, sv AS (SELECT *, 5 AS s FROM ev), {GREEDY.format(src='sv')}", "x")
add("long_keep_apart", lambda s, d: peaks.keep_apart(series(s, d), 5, tile=16), f"WITH {SER}, sv AS (SELECT *, 5 AS s FROM ev), {GREEDY.format(src='sv')}", "x")
add(
    "stat_percentiles",
    lambda s, d: selection.percentiles(ev(s, d), F.col("v"), {"p10": 0.1, "p50": 0.5, "p90": 0.9}),
    f"WITH {EV}, o AS (SELECT clip_id, list_sort(list(v)) AS l, count(*) AS n FROM ev GROUP BY clip_id) SELECT clip_id, n, " + ", ".join(f"round(l[CAST(floor((n - 1) * {q}::DOUBLE) AS BIGINT) + 1], 6) + 0.0 AS p{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM o",
    "p10",
    "p50",
    "p90",
)

# --- regions and levels -----------------------------------------------------------------------------------

RUN = "q AS (SELECT clip_id, idx, {c} AS q FROM ev GROUP BY clip_id, idx), g AS (SELECT *, idx - row_number() OVER (PARTITION BY clip_id ORDER BY idx) AS g FROM q WHERE q)"
REG = f'SELECT clip_id, min(idx) / 1000.0::DOUBLE AS "start", (max(idx) + 1) / 1000.0::DOUBLE AS "end" FROM g GROUP BY clip_id, g'
add("detect_silence", lambda s, d: detect.silence_regions(ev(s, d), 20.0, 1000), f"WITH {EV}, {RUN.format(c='max(abs(v)) < 20')} {REG}")
add("detect_clipping", lambda s, d: detect.clipping_regions(ev(s, d), 0.1, 1000, 500), f"WITH {EV}, {RUN.format(c='max(abs(v)) >= 50')} {REG}")
add("detect_dynamic_range", lambda s, d: detect.dynamic_range(ev(s, d)), f"WITH {EV} SELECT clip_id, round(max(abs(v)), 6) + 0.0 AS peak, round(sqrt(avg(v*v)), 6) + 0.0 AS rms, round(20 * log10(max(abs(v)) / sqrt(avg(v*v))), 6) + 0.0 AS dynamic_range_db FROM ev GROUP BY clip_id", "peak", "rms", "dynamic_range_db")
add("detect_noise_floor", lambda s, d: detect.noise_floor(ev(s, d)), f"WITH {EV}, r AS (SELECT clip_id, abs(v) AS a, row_number() OVER (PARTITION BY clip_id ORDER BY abs(v)) - 1 AS r, count(*) OVER (PARTITION BY clip_id) AS n FROM ev) SELECT clip_id, round(20 * log10(max(a) FILTER (WHERE r = n // 10 AND n >= 10 AND a > 0)), 6) + 0.0 AS noise_floor_db FROM r GROUP BY clip_id", "noise_floor_db")
add("detect_fundamental", lambda s, d: detect.fundamental(embedding_clips(s, d), 64, 4, 16), f"WITH {EMB}, c AS (SELECT a.clip_id, b.idx - a.idx AS lag, sum(a.v * b.v) AS s FROM emb a JOIN emb b ON a.clip_id = b.clip_id AND b.idx - a.idx BETWEEN 4 AND 16 GROUP BY ALL), e AS (SELECT clip_id, sum(v*v) AS e FROM emb GROUP BY clip_id), b AS (SELECT clip_id, arg_max(lag, s / e) AS lag, max(s / e) AS c FROM c JOIN e USING (clip_id) GROUP BY clip_id) SELECT clip_id, round(CASE WHEN c > 0.1 THEN 64.0 / lag END, 6) + 0.0 AS frequency FROM b", "frequency")
add("detect_transients", lambda s, d: psycho.transient_windows(ev(s, d), 16, 8, 1.5), f"{EVF}, e AS (SELECT clip_id, ch, frame, sum(v*v) AS e FROM fr GROUP BY ALL), l AS (SELECT *, lag(e) OVER (PARTITION BY clip_id ORDER BY frame) AS p FROM e) SELECT clip_id, ch, frame, coalesce(p > 1e-10 AND e > p * 1.5, false) AS transient FROM l")
add(
    "region_overlap",
    lambda s, d: compare.region_overlap(vad.speech_regions(ev(s, d), VC), editing.silence_runs(ev(s, d), 20.0, True)),
    f"{REGION}, sr AS (SELECT clip_id, min(a) AS a, max(b) AS b FROM ri GROUP BY clip_id, i), {RUN.format(c='max(abs(v)) < 20').replace('q AS (', 'qq AS (', 1).replace('FROM q ', 'FROM qq ').replace('g AS (SELECT', 'gg AS (SELECT')}, qr AS (SELECT clip_id, min(idx) AS a, max(idx) + 1 AS b FROM gg GROUP BY clip_id, g), ids AS (SELECT clip_id FROM sr UNION SELECT clip_id FROM qr), o AS (SELECT sr.clip_id, sum(least(sr.b, qr.b) - greatest(sr.a, qr.a)) AS o FROM sr JOIN qr ON sr.clip_id = qr.clip_id AND sr.a < qr.b AND qr.a < sr.b GROUP BY 1) SELECT ids.clip_id, CAST(coalesce(o, 0) AS BIGINT) AS overlap FROM ids LEFT JOIN o USING (clip_id)",
)

# --- two signals ------------------------------------------------------------------------------------------


def two(s, d):
    a = stereo_embeddings(s, d)
    return a, editing.reverse(a)


PAIR = f"WITH {ST}, p AS (SELECT a.clip_id, a.ch, a.idx, a.v AS a, b.v AS b FROM st a JOIN st b ON a.clip_id = b.clip_id AND a.ch = b.ch AND b.idx = 31 - a.idx)"
add("cmp_correlation", lambda s, d: compare.correlation(*two(s, d)), f"{PAIR}, c AS (SELECT clip_id, ch, corr(a, b) AS r FROM p GROUP BY ALL) SELECT clip_id, round(avg(r), 6) + 0.0 AS correlation FROM c GROUP BY clip_id", "correlation")
add("cmp_correlation_by_channel", lambda s, d: compare.correlation_by_channel(*two(s, d)), f"{PAIR} SELECT clip_id, ch, round(corr(a, b), 6) + 0.0 AS correlation FROM p GROUP BY ALL", "correlation")
add("cmp_mse", lambda s, d: compare.mse(*two(s, d)), f"{PAIR} SELECT clip_id, round(avg((a-b)*(a-b)), 6) + 0.0 AS mse FROM p GROUP BY clip_id", "mse")
add("cmp_mse_by_channel", lambda s, d: compare.mse_by_channel(*two(s, d)), f"{PAIR} SELECT clip_id, ch, round(avg((a-b)*(a-b)), 6) + 0.0 AS mse FROM p GROUP BY ALL", "mse")
DIFF = "10 * log10(sum(a*a) / sum(b*b))"
add("cmp_snr", lambda s, d: compare.snr(*two(s, d)), f"{PAIR.replace('b.v AS b', 'b.v * 0.5 AS b')} SELECT clip_id, round({DIFF}, 6) + 0.0 AS snr FROM p GROUP BY clip_id".replace("b.v * 0.5 AS b", "b.v AS b"), "snr")
add("cmp_snr_by_channel", lambda s, d: compare.snr_by_channel(*two(s, d)), f"{PAIR} SELECT clip_id, ch, round({DIFF}, 6) + 0.0 AS snr FROM p GROUP BY ALL", "snr")
add("cmp_psnr", lambda s, d: compare.psnr(*two(s, d)), f"{PAIR} SELECT clip_id, round(20 * log10(max(abs(a)) / sqrt(avg((a-b)*(a-b)))), 6) + 0.0 AS psnr FROM p GROUP BY clip_id", "psnr")
add("cmp_segmental_snr", lambda s, d: compare.segmental_snr(*two(s, d), 8), f"{PAIR}, g AS (SELECT clip_id, ch, idx // 8 AS s, greatest(least(10 * log10(sum(a*a) / sum(b*b)), 35), -10) AS db FROM p GROUP BY ALL) SELECT clip_id, round(avg(db), 6) + 0.0 AS segmental_snr FROM g GROUP BY clip_id", "segmental_snr")
add("cmp_align", lambda s, d: compare.align_signals(*two(s, d), 8), f"WITH {ST}, r AS (SELECT clip_id, idx, v FROM st WHERE ch = 0), c AS (SELECT a.clip_id, o.o, round(corr(a.v, b.v), 12) AS r, count(*) AS n FROM r a, range(8) o(o), r b WHERE a.clip_id = b.clip_id AND a.idx = 31 - b.idx + o.o GROUP BY ALL) SELECT clip_id, CAST(arg_max(o, struct_pack(r := r, o := -o)) AS BIGINT) AS \"offset\" FROM c WHERE n > 1 AND r IS NOT NULL GROUP BY clip_id")

# --- tempo ------------------------------------------------------------------------------------------------

FPS = 10.0
add("beat_envelope", lambda s, d: beats.strength_envelope(series(s, d)), f"WITH {SER}, m AS (SELECT clip_id, frame, avg(x) {W.format(k=3)} AS x FROM ev) SELECT clip_id, frame, round(ln(1 + 0.5 * x), 6) + 0.0 AS x FROM m", "x")
TEMPO = f"WITH {SER}, c AS (SELECT clip_id, frame, x - avg(x) {P} AS x FROM ev), r AS (SELECT a.clip_id, b.frame - a.frame AS lag, avg(a.x * b.x) AS r FROM c a JOIN c b ON a.clip_id = b.clip_id AND b.frame - a.frame BETWEEN 3 AND 15 GROUP BY ALL), sc AS (SELECT clip_id, lag, 600.0 / lag AS bpm, r * exp(-0.5 * log2(600.0 / lag / 120) ** 2) AS score FROM r)"
add("beat_tempo_scores", lambda s, d: beats.tempo_scores(series(s, d), 1000, 100), f"{TEMPO} SELECT clip_id, lag, round(bpm, 6) + 0.0 AS bpm, round(score, 6) + 0.0 AS score FROM sc", "bpm", "score")
add("beat_tempo", lambda s, d: beats.estimate_tempo(series(s, d), 1000, 100), f"{TEMPO} SELECT clip_id, round(arg_max(bpm, struct_pack(s := round(score, 12), l := -lag)), 6) + 0.0 AS tempo FROM sc GROUP BY clip_id", "tempo")
add("beat_track", lambda s, d: beats.track_beats(series(s, d), beats.estimate_tempo(series(s, d), 1000, 100), 1000, 100), None, "seconds")

QUERIES, ORACLES = R.QUERIES, R.ORACLES
