"""Queries over clips: statistics, slicing, arithmetic, amplitude, channels and editing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplefield.functions import draws
from ripplefield.operators import channels, container, editing, elementwise, stats
from ripplefield.plans.sqlforms import EMB, EV, ST, Registry, r6, rounded
from ripplefield.sources.tables import embedding_clips, event_clips, order_clips, stereo_embeddings, table

R = Registry()
FORMS = {
    "ev": (lambda s, d: event_clips(s, d, 50.0), EV),
    "emb": (embedding_clips, EMB),
    "st": (stereo_embeddings, ST),
}
V = "round({}, 6) + 0.0"


def add(name, form, query, sql, *round_cols):
    """A query over one form; ``sql`` follows its WITH clause."""
    make, cte = FORMS[form]
    R.add(name, lambda s, d: rounded(query(make(s, d)), *(round_cols or ("v",))), f"WITH {cte}{sql}" if sql and sql.startswith(",") else f"WITH {cte} {sql}" if sql else None)


def same(name, form, query, expr, where="", frm=None):
    """A query whose oracle is an expression over the samples."""
    add(name, form, query, f"SELECT clip_id, ch, idx, round({expr}, 6) + 0.0 AS v FROM {frm or form} {where}")


SIZED = ", n AS (SELECT *, max(idx) OVER (PARTITION BY clip_id) + 1 AS n FROM {f})"

# --- statistics -------------------------------------------------------------------------------------------

add("stat_levels", "ev", stats.levels, "SELECT clip_id, count(*) AS n, round(max(abs(v)),6)+0.0 AS peak, round(min(v),6)+0.0 AS min_sample, round(max(v),6)+0.0 AS max_sample, round(avg(v),6)+0.0 AS mean, round(sum(v),6)+0.0 AS total, round(sqrt(avg(v*v)),6)+0.0 AS rms, round(var_pop(v),6)+0.0 AS variance, round(stddev_pop(v),6)+0.0 AS std_dev FROM ev GROUP BY clip_id", "peak", "min_sample", "max_sample", "mean", "total", "rms", "variance", "std_dev")
CROSS = ", p AS (SELECT *, lag(v) OVER (PARTITION BY clip_id, ch ORDER BY idx) AS p FROM {f}), z AS (SELECT clip_id, CAST(sum(CASE WHEN (p > 0 AND v <= 0) OR (p <= 0 AND v > 0) THEN 1 ELSE 0 END) AS BIGINT) AS zero_crossings, max(idx) + 1 AS n FROM p GROUP BY clip_id)"
R.add("stat_zero_crossings", lambda s, d: stats.crossings(stereo_embeddings(s, d)), f"WITH {ST}{CROSS.format(f='st')} SELECT clip_id, zero_crossings FROM z")
add("stat_crossing_rate", "ev", lambda x: stats.crossing_rate(x, 1000), f"{CROSS.format(f='ev')} SELECT clip_id, round(zero_crossings * 1000.0::DOUBLE / n, 6) + 0.0 AS zcr FROM z", "zcr")
add("stat_midpoint", "ev", stats.midpoint_sample, f"{SIZED.format(f='ev')} SELECT clip_id, round(avg(v) FILTER (WHERE idx = n // 2 OR (n % 2 = 0 AND idx = n // 2 - 1)), 6) + 0.0 AS midpoint FROM n GROUP BY clip_id", "midpoint")
add("stat_mean_by_channel", "st", stats.mean_by_channel, "SELECT clip_id, ch, round(avg(v), 6) + 0.0 AS mean FROM st GROUP BY clip_id, ch", "mean")
add("stat_mean_by_instant", "st", stats.mean_by_instant, "SELECT clip_id, idx, round(avg(v), 6) + 0.0 AS mean FROM st GROUP BY clip_id, idx", "mean")
add("stat_variance_by_channel", "st", lambda x: stats.variance_by_channel(x, 1), "SELECT clip_id, ch, round(var_samp(v), 6) + 0.0 AS variance, round(stddev_samp(v), 6) + 0.0 AS std_dev FROM st GROUP BY clip_id, ch", "variance", "std_dev")
add("stat_variance", "st", stats.variance, "SELECT clip_id, round(var_pop(v), 6) + 0.0 AS variance FROM st GROUP BY clip_id", "variance")
add("stat_variance_compat", "st", lambda x: stats.variance(x, compat=True), ", d AS (SELECT clip_id, ch, (v - avg(v) OVER (PARTITION BY clip_id, idx)) ** 2 AS d FROM st) SELECT clip_id, round(sum(d) / count(*) / 2, 6) + 0.0 AS variance FROM d GROUP BY clip_id", "variance")
LAG = "SELECT a.clip_id, CAST(b.idx - a.idx AS INTEGER) AS lag, round(avg(a.v * b.v), 6) + 0.0 AS r FROM {a} a JOIN {b} b ON a.clip_id = b.clip_id AND b.idx - a.idx BETWEEN 0 AND {m} GROUP BY ALL"
add("stat_autocorrelation", "emb", lambda x: stats.autocorrelation(x, 8), LAG.format(a="emb", b="emb", m=8), "r")
R.add("stat_cross_correlation", lambda s, d: rounded(stats.cross_correlation(embedding_clips(s, d), editing.reverse(embedding_clips(s, d)), 8), "r"), f"WITH {EMB}, rev AS (SELECT clip_id, 63 - idx AS idx, v FROM emb) {LAG.format(a='emb', b='rev', m=8)}")
R.add(
    "stat_alignment_lag",
    lambda s, d: stats.alignment_lag(embedding_clips(s, d), editing.reverse(embedding_clips(s, d)), 10),
    f"WITH {EMB}, rev AS (SELECT clip_id, 63 - idx AS idx, v FROM emb), c AS (SELECT a.clip_id, b.idx - a.idx AS lag, sum(a.v * b.v) AS s FROM emb a JOIN rev b ON a.clip_id = b.clip_id AND abs(b.idx - a.idx) <= 10 GROUP BY ALL) SELECT clip_id, CAST(arg_max(lag, struct_pack(s := s, a := -abs(lag), l := lag)) AS BIGINT) AS lag FROM c GROUP BY clip_id",
)
add("stat_feature_report", "st", stats.feature_report, "SELECT clip_id, ch, count(*) AS n, round(sqrt(avg(v*v)), 6) + 0.0 AS rms, round(max(abs(v)), 6) + 0.0 AS peak FROM st GROUP BY ROLLUP (clip_id, ch)", "rms", "peak")
R.add("stat_order_clips", lambda s, d: rounded(stats.statistics(order_clips(s, d)).select("clip_id", "n", "rms"), "rms"), "SELECT CAST(o_custkey AS BIGINT) AS clip_id, count(*) AS n, round(sqrt(avg(o_totalprice * o_totalprice)), 6) + 0.0 AS rms FROM orders GROUP BY 1")

# --- container --------------------------------------------------------------------------------------------

add("clip_info", "st", lambda x: container.info(x, 64, "i16"), "SELECT clip_id, max(ch) + 1::BIGINT AS channels, max(idx) + 1 AS frames, count(*) AS samples, (max(idx) + 1) / 64.0::DOUBLE AS seconds, 32.0::DOUBLE AS nyquist, count(*) * 2 AS bytes FROM st GROUP BY clip_id", "seconds")
same("clip_slice_samples", "emb", lambda x: container.slice_samples(x, 10, 20), "v", "WHERE idx BETWEEN 0 AND 9", "(SELECT clip_id, ch, idx - 10 AS idx, v FROM emb)")
same("clip_slice_channels", "st", lambda x: container.slice_channels(x, 1, 2), "v", "", "(SELECT clip_id, ch - 1 AS ch, idx, v FROM st WHERE ch = 1)")
same("clip_slice_both", "st", lambda x: container.slice_both(x, (-1, 99), (-5, -1)), "v", "", "(SELECT clip_id, ch - 1 AS ch, idx - 27 AS idx, v FROM st WHERE ch = 1 AND idx BETWEEN 27 AND 30)")
same("clip_map", "emb", lambda x: container.map_samples(x, lambda v: F.sin(v) * 2), "sin(v) * 2")
same("clip_map_with_index", "emb", lambda x: container.map_with_index(x, lambda i, v: v * i), "v * idx")
same("clip_map_channels", "st", lambda x: container.map_channels(x, [1], lambda v: -v), "CASE WHEN ch = 1 THEN -v ELSE v END")
same("clip_map_range", "emb", lambda x: container.map_range(x, 5, 3, lambda v: v * 0), "CASE WHEN idx BETWEEN 5 AND 7 THEN 0 ELSE v END")
same("clip_power", "emb", lambda x: container.power(x, 2, 0.05), "(v * v) % 0.05::DOUBLE")
add("clip_fill", "emb", lambda x: container.map_samples(x, lambda v: F.lit(0.25)), "SELECT clip_id, ch, idx, 0.25::DOUBLE AS v FROM emb")
add("clip_sum_fold", "emb", lambda x: elementwise.fold(x, F.lit(0.0), lambda a, v: a * 0.5 + v), "SELECT clip_id, 0 AS ch, round(sum(v * 0.5 ** (63 - idx)), 6) + 0.0 AS folded FROM emb GROUP BY clip_id", "folded")
for _op, _sql in (("+", "v + w"), ("-", "v - w"), ("*", "v * w")):
    R.add(f"clip_arithmetic_{dict(zip('+-*', ('add', 'subtract', 'multiply')))[_op]}", lambda s, d, op=_op: rounded(container.arithmetic(embedding_clips(s, d), editing.reverse(embedding_clips(s, d)), op), "v"), f"WITH {EMB}, two AS (SELECT a.clip_id, a.ch, a.idx, a.v, b.v AS w FROM emb a JOIN emb b ON a.clip_id = b.clip_id AND a.idx = 63 - b.idx) SELECT clip_id, ch, idx, round({_sql}, 6) + 0.0 AS v FROM two")
R.add("clip_arithmetic_scalar", lambda s, d: rounded(container.arithmetic(embedding_clips(s, d), 3.0, "/"), "v"), f"WITH {EMB} SELECT clip_id, ch, idx, round(v / 3, 6) + 0.0 AS v FROM emb")
same("clip_negate", "emb", container.negate, "-v")
add("clip_apply_windowed", "emb", lambda x: container.apply_windowed(x, 16, 8, lambda w, p: F.transform(w, lambda v: v * 2)), ", x AS (SELECT clip_id, ch, idx, v FROM emb WHERE idx < 64) SELECT clip_id, ch, idx, round(v * 2, 6) + 0.0 AS v FROM x")
add("clip_nested_form", "st", lambda x: container.from_clips(container.to_clips(x, 64)), "SELECT clip_id, ch, idx, round(v, 6) + 0.0 AS v FROM st")
R.add("clip_uniform", lambda s, d: container.uniform(s, 5, 0.5, 2).select("clip_id", "ch", "idx", "v"), "SELECT 0::BIGINT AS clip_id, c::INTEGER AS ch, i AS idx, 0.5::DOUBLE AS v FROM range(2) a(c), range(5) b(i)")
R.add("clip_from_interleaved", lambda s, d: container.from_interleaved(s, [1, 2, 3, 4, 5, 6], 2), "SELECT 0::BIGINT AS clip_id, (i % 2)::INTEGER AS ch, i // 2 AS idx, (i + 1)::DOUBLE AS v FROM range(6) t(i)")
R.add("clip_from_planar", lambda s, d: container.from_planar(s, [1, 2, 3, 4, 5, 6], 2), "SELECT 0::BIGINT AS clip_id, (i // 3)::INTEGER AS ch, i % 3 AS idx, (i + 1)::DOUBLE AS v FROM range(6) t(i)")

# --- amplitude --------------------------------------------------------------------------------------------

OVER = "OVER (PARTITION BY clip_id)"
same("amp_normalize_peak", "emb", lambda x: elementwise.normalize(x, "peak", target=0.9), f"v * 0.9 / max(abs(v)) {OVER}")
same("amp_normalize_minmax", "emb", lambda x: elementwise.normalize(x, "minmax", -1, 2), f"-1 + (v - min(v) {OVER}) * 3 / (max(v) {OVER} - min(v) {OVER})")
same("amp_normalize_mean", "emb", lambda x: elementwise.normalize(x, "mean"), f"v - avg(v) {OVER}")
add("amp_normalize_median", "emb", lambda x: elementwise.normalize(x, "median"), ", m AS (SELECT clip_id, avg(v) AS m FROM emb WHERE idx IN (31, 32) GROUP BY clip_id) SELECT clip_id, ch, idx, round(v - m, 6) + 0.0 AS v FROM emb JOIN m USING (clip_id)")
same("amp_normalize_zscore", "emb", lambda x: elementwise.normalize(x, "zscore"), f"(v - avg(v) {OVER}) / stddev_pop(v) {OVER}")
same("amp_scale", "emb", lambda x: elementwise.scale(x, 0.5), "v * 0.5")
same("amp_clip", "emb", lambda x: elementwise.clip(x, -0.1, 0.1), "greatest(least(v, 0.1::DOUBLE), -0.1::DOUBLE)")
same("amp_remove_dc", "emb", elementwise.remove_dc_offset, f"v - avg(v) {OVER}")
same("amp_apply_window", "emb", lambda x: elementwise.apply_window(x, elementwise.window_function(None, "hann", 64)), "v * (0.5 - 0.5 * cos(2 * pi() * idx / 63))")
add("amp_fir", "emb", lambda x: elementwise.apply_filter(x, [0.25, 0.5, 0.25]), "SELECT a.clip_id, a.ch, a.idx, round(0.25 * a.v + 0.5 * b.v + 0.25 * c.v, 6) + 0.0 AS v FROM emb a JOIN emb b ON a.clip_id = b.clip_id AND b.idx = a.idx + 1 JOIN emb c ON a.clip_id = c.clip_id AND c.idx = a.idx + 2")
same("amp_mu_compress", "emb", elementwise.mu_compress, "CASE WHEN v < 0 THEN -1 ELSE 1 END * ln(1 + 255 * abs(v)) / ln(256)")
same("amp_mu_compress_compat", "emb", lambda x: elementwise.mu_compress(x, compat=True), "CASE WHEN v < 0 THEN -1 ELSE 1 END * ln(ln(256) + 255 * abs(v)) / ln(256)")
same("amp_mu_expand", "emb", elementwise.mu_expand, "CASE WHEN v < 0 THEN -1 ELSE 1 END * (256 ** abs(v) - 1) / 255")
FOLD = "list_reduce(list_prepend(NULL, s), lambda y, x: {step})"


def _recursive(name, query, first, step, sr=64.0):
    """A one-pole recurrence; its oracle is a recursive query over the index."""
    sql = f"""WITH RECURSIVE {EMB}, r AS (SELECT clip_id, 0::BIGINT AS idx, v AS x, {first}::DOUBLE AS y FROM emb WHERE idx = 0 UNION ALL
SELECT r.clip_id, r.idx + 1, e.v, {step} FROM r JOIN emb e ON e.clip_id = r.clip_id AND e.idx = r.idx + 1) SELECT clip_id, 0 AS ch, idx, round(y, 6) + 0.0 AS v FROM r"""
    R.add(name, lambda s, d: rounded(query(embedding_clips(s, d)), "v"), sql)


A = "(2 * pi() * 5 / 64.0)"
H = "((1 / (2 * pi() * 5)) / (1 / (2 * pi() * 5) + 1 / 64.0))"
_recursive("amp_low_pass", lambda x: elementwise.low_pass(x, 5, 64), "v", f"{A} * e.v + (1 - {A}) * r.y")
_recursive("amp_high_pass", lambda x: elementwise.high_pass(x, 5, 64), "0", f"{H} * (r.y + e.v - r.x)")
# y = a (y' + x - x') from 0, then z = b y + (1 - b) z' from y[0].
BAND_PASS = f"WITH RECURSIVE {EMB}, c AS (SELECT 1 / (2 * pi() * 5) / (1 / (2 * pi() * 5) + 1 / 64.0::DOUBLE) AS a, 2 * pi() * 10 / 64 AS b), f AS (SELECT clip_id, idx, v AS x, 0::DOUBLE AS y, 0::DOUBLE AS z FROM emb WHERE idx = 0 UNION ALL SELECT f.clip_id, e.idx, e.v, a * (f.y + e.v - f.x), b * a * (f.y + e.v - f.x) + (1 - b) * f.z FROM f JOIN emb e ON e.clip_id = f.clip_id AND e.idx = f.idx + 1, c) SELECT clip_id, 0 AS ch, idx, round(z, 6) + 0.0 AS v FROM f"
R.add("amp_band_pass", lambda s, d: rounded(elementwise.band_pass(embedding_clips(s, d), 5, 10, 64), "v"), BAND_PASS)
same("amp_checked_map", "emb", lambda x: elementwise.checked_map(x, lambda v: v + 1, lambda v: F.isnan(v), "not a number"), "v + 1")

# --- channels ---------------------------------------------------------------------------------------------

MONO = "SELECT clip_id, 0 AS ch, idx, round({}, 6) + 0.0 AS v FROM st GROUP BY clip_id, idx"
add("chan_mono_average", "st", lambda x: channels.to_mono(x), MONO.format("avg(v)"))
add("chan_mono_weighted", "st", lambda x: channels.to_mono(x, "weighted", [0.25, 0.75]), MONO.format("sum(v * CASE WHEN ch = 0 THEN 0.25 ELSE 0.75 END)"))
add("chan_mono_center", "st", lambda x: channels.to_mono(x, "center"), MONO.format("avg(v)"))
for _k, _side in enumerate(("left", "right")):
    add(f"chan_mono_{_side}", "st", lambda x, m=_side: channels.to_mono(x, m), f"SELECT clip_id, 0 AS ch, idx, round(v, 6) + 0.0 AS v FROM st WHERE ch = {_k}")
TWO = "SELECT clip_id, c AS ch, idx, round(v * CASE c WHEN 0 THEN {} ELSE {} END, 6) + 0.0 AS v FROM emb, (SELECT 0 AS c UNION ALL SELECT 1)"
add("chan_stereo_duplicate", "emb", lambda x: channels.to_stereo(x), TWO.format(1, 1))
add("chan_stereo_pan", "emb", lambda x: channels.to_stereo(x, "pan", 0.5), TWO.format("cos(1.5 * pi() / 4)", "sin(1.5 * pi() / 4)"))
add("chan_duplicate", "st", lambda x: channels.duplicate_to_channels(x, 3), "SELECT clip_id, c::INTEGER AS ch, idx, round(v, 6) + 0.0 AS v FROM st, range(3) t(c) WHERE ch = 0")
add("chan_extract", "st", lambda x: channels.extract_channel(x, 1), "SELECT clip_id, 0 AS ch, idx, round(v, 6) + 0.0 AS v FROM st WHERE ch = 1")
add("chan_swap", "st", lambda x: channels.swap_channels(x, 0, 1), "SELECT clip_id, 1 - ch AS ch, idx, round(v, 6) + 0.0 AS v FROM st")
same("chan_pan", "st", lambda x: channels.pan(x, 0.3), "v * CASE WHEN ch = 0 THEN 0.7 ELSE 1.3 END")
same("chan_balance", "st", lambda x: channels.balance(x, -0.3), "v * CASE WHEN ch = 0 THEN 1.3 ELSE 0.7 END")
same("chan_apply_to_one", "st", lambda x: channels.apply_to_channel(x, 0, lambda v: v * v), "CASE WHEN ch = 0 THEN v * v ELSE v END")
R.add("chan_stack", lambda s, d: rounded(channels.stack([embedding_clips(s, d), editing.reverse(embedding_clips(s, d))]), "v"), f"WITH {EMB} SELECT clip_id, 0 AS ch, idx, round(v, 6) + 0.0 AS v FROM emb UNION ALL SELECT clip_id, 1, 63 - idx, round(v, 6) + 0.0 FROM emb")
add("chan_deinterleave", "st", channels.deinterleave_channels, "SELECT clip_id, ch AS part, 0 AS ch, idx, round(v, 6) + 0.0 AS v FROM st")
PAIR = ", p AS (SELECT a.clip_id, a.idx, a.v AS l, b.v AS r FROM st a JOIN st b ON a.clip_id = b.clip_id AND a.idx = b.idx AND a.ch = 0 AND b.ch = 1)"
add("chan_mid_side", "st", channels.mid_side, f"{PAIR} SELECT clip_id, 0 AS ch, idx, round((l + r) / 2, 6) + 0.0 AS v FROM p UNION ALL SELECT clip_id, 1, idx, round((l - r) / 2, 6) + 0.0 FROM p")
same("chan_mid_side_inverse", "st", lambda x: channels.left_right(channels.mid_side(x)), "v")

# --- editing ----------------------------------------------------------------------------------------------

same("edit_reverse", "ev", editing.reverse, "v", "", f"(SELECT clip_id, ch, max(idx) {OVER} - idx AS idx, v FROM ev)")
same("edit_trim", "emb", lambda x: editing.trim(x, 0.25, 0.75, 64), "v", "", "(SELECT clip_id, ch, idx - 16 AS idx, v FROM emb WHERE idx BETWEEN 16 AND 47)")
add("edit_pad", "emb", lambda x: editing.pad(x, 0.05, 0.1, 64, 0.5), "SELECT clip_id, ch, idx + 3 AS idx, round(v, 6) + 0.0 AS v FROM emb UNION ALL SELECT clip_id, 0, i, 0.5 FROM (SELECT DISTINCT clip_id FROM emb), range(3) t(i) UNION ALL SELECT clip_id, 0, 67 + i, 0.5 FROM (SELECT DISTINCT clip_id FROM emb), range(6) t(i)")
add("edit_pad_right", "emb", lambda x: editing.pad_samples_right(x, 70), "SELECT clip_id, ch, idx, round(v, 6) + 0.0 AS v FROM emb UNION ALL SELECT clip_id, 0, 64 + i, 0.0 FROM (SELECT DISTINCT clip_id FROM emb), range(6) t(i)")
add("edit_pad_to_duration_left", "emb", lambda x: editing.pad_to_duration(x, 1.25, 64, side="left"), "SELECT clip_id, ch, idx + 16 AS idx, round(v, 6) + 0.0 AS v FROM emb UNION ALL SELECT clip_id, 0, i, 0.0 FROM (SELECT DISTINCT clip_id FROM emb), range(16) t(i)")
add("edit_split", "emb", lambda x: editing.split(x, 0.4, 64), "SELECT clip_id, ch, idx // 25 AS segment, idx % 25 AS idx, round(v, 6) + 0.0 AS v FROM emb")
R.add("edit_concatenate", lambda s, d: rounded(editing.concatenate([embedding_clips(s, d), editing.reverse(embedding_clips(s, d))]), "v"), f"WITH {EMB} SELECT clip_id, ch, idx, round(v, 6) + 0.0 AS v FROM emb UNION ALL SELECT clip_id, ch, 127 - idx, round(v, 6) + 0.0 FROM emb")
R.add("edit_mix", lambda s, d: rounded(editing.mix([embedding_clips(s, d), editing.reverse(embedding_clips(s, d))], [0.3, 0.7]), "v"), f"WITH {EMB} SELECT a.clip_id, a.ch, a.idx, round(0.3 * a.v + 0.7 * b.v, 6) + 0.0 AS v FROM emb a JOIN emb b ON a.clip_id = b.clip_id AND b.idx = 63 - a.idx")
CURVE = {"linear": "p", "exponential": "p * p", "logarithmic": "ln(1 + p) / ln(2)", "smoothstep": "p * p * (3 - 2 * p)"}
for _c, _e in CURVE.items():
    add(f"edit_fade_in_{_c}", "emb", lambda x, c=_c: editing.fade_in(x, 0.5, 64, c), f", p AS (SELECT *, idx / 32.0::DOUBLE AS p FROM emb) SELECT clip_id, ch, idx, round(CASE WHEN idx < 32 THEN v * {_e} ELSE v END, 6) + 0.0 AS v FROM p")
    add(f"edit_fade_out_{_c}", "emb", lambda x, c=_c: editing.fade_out(x, 0.5, 64, c), f", p AS (SELECT *, 1 - (idx - 32) / 32.0::DOUBLE AS p FROM emb) SELECT clip_id, ch, idx, round(CASE WHEN idx >= 32 THEN v * {_e.replace('ln(1 + p)', 'ln(greatest(1 + p, 1e-9))')} ELSE v END, 6) + 0.0 AS v FROM p")
add("edit_repeat", "emb", lambda x: editing.repeat(x, 3), "SELECT clip_id, ch, idx + 64 * i AS idx, round(v, 6) + 0.0 AS v FROM emb, range(3) t(i)")
THR = "10 ** (-20.0 / 20)"
add("edit_trim_silence", "emb", lambda x: editing.trim_silence(x, -20), f", b AS (SELECT clip_id, min(idx) FILTER (WHERE abs(v) > {THR}) AS a, max(idx) FILTER (WHERE abs(v) > {THR}) AS b FROM emb GROUP BY clip_id) SELECT clip_id, ch, idx - coalesce(a, 0) AS idx, round(CASE WHEN a IS NULL THEN 0 ELSE v END, 6) + 0.0 AS v FROM emb JOIN b USING (clip_id) WHERE a IS NULL OR idx BETWEEN a AND b")
RUNS = ", q AS (SELECT *, abs(v) <= " + THR + " AS quiet FROM emb), g AS (SELECT *, idx - row_number() OVER (PARTITION BY clip_id, quiet ORDER BY idx) AS g FROM q), k AS (SELECT *, count(*) OVER (PARTITION BY clip_id, quiet, g) AS k FROM g)"
add("edit_trim_all_silence", "emb", lambda x: editing.trim_all_silence(x, -20, 0.05, 64), f"{RUNS} SELECT clip_id, ch, row_number() OVER (PARTITION BY clip_id ORDER BY idx) - 1 AS idx, round(v, 6) + 0.0 AS v FROM k WHERE NOT quiet OR k < 3")
R.add("edit_perturb_noise", lambda s, d: editing.perturb(embedding_clips(s, d), "noise", snr_db=20.0, seed=3).agg(F.count("*").alias("n")), f"WITH {EMB} SELECT count(*) AS n FROM emb")
R.add("edit_perturb_gain", lambda s, d: editing.perturb(embedding_clips(s, d), "gain", low_db=-6.0, high_db=6.0).agg(F.count("*").alias("n")), f"WITH {EMB} SELECT count(*) AS n FROM emb")
R.add("edit_perturb_pitch", lambda s, d: editing.perturb(embedding_clips(s, d), "pitch_shift", semitones=2.0, n_fft=32, hop=8).agg(F.count("*").alias("n")), f"WITH {EMB} SELECT count(*) AS n FROM emb")
# The samples themselves: no column of theirs can be pruned.
same("edit_perturb_noise_samples", "emb", lambda x: editing.perturb(x, "noise", snr_db=20.0, seed=3), f"v + sqrt(avg(v * v) OVER (PARTITION BY clip_id)) * 0.1 * {draws.gaussian_sql('3, clip_id, ch, idx')}")
same("edit_perturb_gain_samples", "emb", lambda x: editing.perturb(x, "gain", low_db=-6.0, high_db=6.0), f"v * 10 ** ((-6 + 12 * {draws.uniform_sql('0, clip_id')}) / 20)")
# Two semitones up: Hann frames of 32 with a hop of 8, phases by bin from a running sum of steps, overlap-add.
HANN32, UP2 = "(0.5 - 0.5 * cos(2 * pi() * {n} / 32))", "pow(2, 2 / 12.0)"
PITCH = (
    f", st AS (SELECT clip_id, f, k, sum(v * {HANN32.format(n='(idx + 16 - 8 * f)')} * cos(2 * pi() * k * (idx + 16 - 8 * f) / 32)) AS re, sum(CASE WHEN k = 0 THEN 0.0 ELSE -v * {HANN32.format(n='(idx + 16 - 8 * f)')} * sin(2 * pi() * k * (idx + 16 - 8 * f) / 32) END) AS im FROM emb JOIN range(10) a(f) ON idx + 16 - 8 * f BETWEEN 0 AND 31, range(17) b(k) GROUP BY ALL), "
    "ph AS (SELECT clip_id, f, k, sqrt(re * re + im * im) AS m, atan2(im, re) AS p FROM st), "
    "dr AS (SELECT *, p - lag(p) OVER (PARTITION BY clip_id, k ORDER BY f) - 2 * pi() * 8 * k / 32 AS d FROM ph), "
    f"mv AS (SELECT clip_id, f, CAST(round(k * {UP2}) AS BIGINT) AS k, m, (2 * pi() * 8 * k / 32 + atan2(sin(d), cos(d))) * {UP2} AS w FROM dr WHERE round(k * {UP2}) < 17), "
    "mm AS (SELECT ph.clip_id, ph.f, ph.k, coalesce(mv.m, 0) AS m, sum(CASE WHEN ph.f = 0 THEN p ELSE coalesce(w, 0) END) OVER (PARTITION BY ph.clip_id, ph.k ORDER BY ph.f) AS t FROM ph LEFT JOIN mv ON mv.clip_id = ph.clip_id AND mv.f = ph.f AND mv.k = ph.k), "
    "fr AS (SELECT clip_id, f, n, sum(CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END * m * (cos(t) * cos(2 * pi() * k * n / 32) - CASE WHEN k IN (0, 16) THEN 0 ELSE sin(t) * sin(2 * pi() * k * n / 32) END)) / 32 AS y FROM mm, range(32) r(n) GROUP BY ALL) "
    f"SELECT clip_id, 0 AS ch, 8 * f + n - 16 AS idx, round(sum(y * {HANN32.format(n='n')}) / greatest(sum({HANN32.format(n='n')} ** 2), 1e-9), 6) + 0.0 AS v FROM fr WHERE 8 * f + n BETWEEN 16 AND 79 GROUP BY clip_id, 8 * f + n"
)
add("edit_perturb_pitch_samples", "emb", lambda x: editing.perturb(x, "pitch_shift", semitones=2.0, n_fft=32, hop=8), PITCH, "v")
R.add("region_semi_join", lambda s, d: table(s, d, "events").join(table(s, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left_semi").groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id) GROUP BY event_type")

QUERIES, ORACLES = R.QUERIES, R.ORACLES
_ = r6
