"""Queries over spectra, filterbanks, pitch, onsets, resampling, recursive filters, dynamics and codecs.

Transforms are compared with sums of sines over the 64-sample embedding clips; recurrences and codecs have no
plain SQL and are covered by tests against loops, identities and signal-to-noise ratios.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ripplefield import sinks
from ripplefield.operators import chunks, codec, compare, dynamics, editing, envelopes, eq, filterbanks, hpss, iir, onsets, pitch, psycho, quantise, resampling, spectral
from ripplefield.plans.sqlforms import EMB, EV, ST, Registry, r6, rounded
from ripplefield.sources import generate
from ripplefield.sources.tables import embedding_clips, event_clips, stereo_embeddings

R = Registry()
SP = "sp AS (SELECT clip_id, b AS bin, b * 1.0::DOUBLE AS freq_hz, sum(v * cos(2 * pi() * (b * idx % 64) / 64)) AS re, -sum(v * sin(2 * pi() * (b * idx % 64) / 64)) AS im FROM emb, range(33) t(b) GROUP BY clip_id, b), pw AS (SELECT *, re*re + im*im AS p, sqrt(re*re + im*im) AS m FROM sp)"
W = f"WITH {EMB}, {SP}"


def add(name, query, sql=None, *cols):
    R.add(name, lambda s, d: rounded(query(s, d), *cols), sql)


def spec(s, d):
    """One-sided spectrum of every embedding clip."""
    return spectral.fft(embedding_clips(s, d), 64, 64.0)


RI = "SELECT clip_id, 0 AS ch, 0::BIGINT AS frame, CAST(bin AS INTEGER) AS bin, freq_hz, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM sp"
add("spec_fft", spec, f"{W} {RI}", "re", "im")
add("spec_dft_join", lambda s, d: spectral.dft(embedding_clips(s, d), 64, 64.0), f"{W} {RI}", "re", "im")
add("spec_rfft", lambda s, d: spectral.rfft(embedding_clips(s, d), 64, 64.0).select("clip_id", "bin", "magnitude"), f"{W} SELECT clip_id, CAST(bin AS INTEGER) AS bin, round(m, 6) + 0.0 AS magnitude FROM pw", "magnitude")
FEATURES = ("centroid", "bandwidth", "rolloff", "flatness", "crest", "slope")
add(
    "spec_features",
    lambda s, d: spectral.features(spec(s, d)).select("clip_id", *FEATURES),
    f"{W}, x AS (SELECT *, sum(p) OVER (PARTITION BY clip_id ORDER BY bin) AS run, sum(p) OVER (PARTITION BY clip_id) AS tot, sum(freq_hz * m) OVER (PARTITION BY clip_id) / sum(m) OVER (PARTITION BY clip_id) AS mid FROM pw) SELECT clip_id, round(sum(freq_hz*p)/sum(p), 6) + 0.0 AS centroid, round(sqrt(sum((freq_hz-mid)**2*m)/sum(m)), 6) + 0.0 AS bandwidth, round(min(freq_hz) FILTER (WHERE run >= 0.85*tot), 6) + 0.0 AS rolloff, round(exp(avg(ln(p+1e-10)))/avg(p), 6) + 0.0 AS flatness, round(max(m)/avg(m), 6) + 0.0 AS crest, round(regr_slope(m, freq_hz), 6) + 0.0 AS slope FROM x GROUP BY clip_id",
    *FEATURES,
)
EDGES = spectral.contrast_edges(33, 4)
BAND = "CASE " + " ".join(f"WHEN bin BETWEEN {a} AND {b - 1} THEN {k}" for k, (a, b) in enumerate(EDGES)) + " END"
add(
    "spec_contrast",
    lambda s, d: spectral.contrast(spec(s, d), 4, 33).select("clip_id", "band", "contrast"),
    f"{W}, c AS (SELECT clip_id, bin, {BAND} AS band, 10 * log10(m + 1e-10) AS db FROM pw), r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY db, bin) AS u, row_number() OVER (w ORDER BY db DESC, bin) AS dn FROM c WHERE band IS NOT NULL WINDOW w AS (PARTITION BY clip_id, band)) SELECT clip_id, band, round(avg(db) FILTER (WHERE dn <= least(greatest(round(n * 0.02), 1), n)) - avg(db) FILTER (WHERE u <= least(greatest(round(n * 0.02), 1), n)), 6) + 0.0 AS contrast FROM r GROUP BY clip_id, band",
    "contrast",
)
add("spec_magphase", lambda s, d: spectral.magphase(spec(s, d), 2).select("clip_id", "bin", "magnitude", "phase_re", "phase_im"), f"{W} SELECT clip_id, CAST(bin AS INTEGER) AS bin, round(m ** 2, 6) + 0.0 AS magnitude, round(re / m, 6) + 0.0 AS phase_re, round(im / m, 6) + 0.0 AS phase_im FROM pw", "magnitude", "phase_re", "phase_im")
#: Hann frames of 16 with a hop of 8, and their sums of sines.
FR = "hw AS (SELECT clip_id, f, idx - f * 8 AS pos, v * (0.5 - 0.5 * cos(2 * pi() * (idx - f * 8) / {m})) AS v FROM emb JOIN range(0, 7) t(f) ON idx BETWEEN f * 8 AND f * 8 + 15), fs AS (SELECT clip_id, f AS frame, b AS bin, sum(v * cos(2 * pi() * b * pos / 16)) AS re, -sum(v * sin(2 * pi() * b * pos / 16)) AS im FROM hw, range(9) u(b) GROUP BY ALL)"
STFT = f"WITH {EMB}, {FR.format(m=16)}"


def stft(s, d):
    """Short transforms of every embedding clip."""
    return spectral.stft(embedding_clips(s, d), 16, 8, 64.0, centre=False)


add("spec_stft", lambda s, d: stft(s, d).select("clip_id", "frame", "bin", "re", "im"), f"{STFT} SELECT clip_id, frame, CAST(bin AS INTEGER) AS bin, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM fs", "re", "im")
add("spec_istft", lambda s, d: spectral.istft(spectral.stft(embedding_clips(s, d), 16, 8, 64.0), 16, 8, length=64), f"WITH {EMB} SELECT clip_id, ch, idx, round(v, 6) + 0.0 AS v FROM emb", "v")
for _scale, _e in (("power", "re*re + im*im"), ("magnitude", "sqrt(re*re + im*im)"), ("db", "greatest(10 * log10(greatest(re*re + im*im, 1e-300)), -80)")):
    _digits = 4 if _scale == "db" else 6
    R.add(
        f"spec_linear_{_scale}",
        lambda s, d, sc=_scale, k=_digits: spectral.linear_spectrogram(embedding_clips(s, d), 16, 8, 64.0, sc, centre=False).select("clip_id", "frame", "bin", (F.round("value", k) + F.lit(0.0)).alias("value")),
        f"{STFT} SELECT clip_id, frame, CAST(bin AS INTEGER) AS bin, round({_e}, {_digits}) + 0.0 AS value FROM fs",
    )
add("spec_psd", lambda s, d: spectral.power_spectral_density(embedding_clips(s, d), 16, 0.5, 64.0).select("clip_id", "bin", "density"), f"WITH {EMB}, {FR.format(m=15)} SELECT clip_id, CAST(bin AS INTEGER) AS bin, round(avg(re*re + im*im) / 4, 6) + 0.0 AS density FROM fs GROUP BY clip_id, bin", "density")
CONV = "SELECT a.clip_id, 0 AS ch, a.idx + b.idx AS idx, round(sum(a.v * b.v), 6) + 0.0 AS v FROM emb a JOIN emb b USING (clip_id) GROUP BY ALL"
add("spec_convolve", lambda s, d: spectral.convolve(embedding_clips(s, d), embedding_clips(s, d)), f"WITH {EMB} {CONV}", "v")
add("spec_convolve_taps", lambda s, d: spectral.convolve_taps(embedding_clips(s, d), [0.5, 0.25]), f"WITH {EMB} SELECT clip_id, ch, idx, round(sum(v), 6) + 0.0 AS v FROM (SELECT clip_id, ch, idx, 0.5 * v AS v FROM emb UNION ALL SELECT clip_id, ch, idx + 1, 0.25 * v FROM emb) GROUP BY ALL", "v")
add("spec_deconvolve", lambda s, d: spectral.deconvolve(spectral.convolve(embedding_clips(s, d), editing.trim(embedding_clips(s, d), 0, 0.25, 64)), editing.trim(embedding_clips(s, d), 0, 0.25, 64), 1e-12).withColumn("v", F.round("v", 3)), None)
add("spec_windowed_features", lambda s, d: spectral.windowed_features(event_clips(s, d, 50.0), 32, 16, 1000.0), None, "centroid", "rolloff")

# --- filterbanks ------------------------------------------------------------------------------------------


def _bank_sql(bank: np.ndarray, name: str) -> str:
    """A bank as a VALUES table."""
    band, at = np.nonzero(bank)
    rows = ", ".join(f"({b}, {k}, {bank[b, k]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::") for b, k in zip(band.tolist(), at.tolist(), strict=True))
    return f"{name}(band, bin, w) AS (VALUES {rows})"


BANKED = "SELECT clip_id, frame, band, round({e}, {k}) + 0.0 AS value FROM (SELECT clip_id, frame, band, sum((re*re + im*im) * w) AS x FROM fs JOIN bk USING (bin) GROUP BY ALL)"
SCALES = {"power": ("x", 6), "magnitude": ("sqrt(x)", 6), "db": ("greatest(10 * log10(greatest(x, 1e-300)), -80)", 4)}


def _bank_queries(kind, make, bank):
    for scale, (e, k) in SCALES.items():
        R.add(
            f"bank_{kind}_{scale}",
            lambda s, d, sc=scale, k=k: make(embedding_clips(s, d), sc).select("clip_id", "frame", "band", (F.round("value", k) + F.lit(0.0)).alias("value")),
            f"{STFT}, {_bank_sql(bank, 'bk')} {BANKED.format(e=e, k=k)}",
        )


_bank_queries("mel", lambda x, sc: filterbanks.mel_spectrogram(x, 4, 16, 8, 64.0, sc, centre=False), filterbanks.mel_bank(4, 16, 64.0))
_bank_queries("loghz", lambda x, sc: filterbanks.loghz_spectrogram(x, 3, 16, 8, 64.0, sc, low=4.0, centre=False), filterbanks.log_bank(3, 16, 64.0, 4.0))
_bank_queries("gammatone", lambda x, sc: filterbanks.gammatone_spectrogram(x, 3, 16, 8, 64.0, sc, low=4.0, centre=False), filterbanks.gammatone_bank(3, 16, 64.0, 4.0))
CHROMA = filterbanks.chroma_bank(16, 64.0, 1.0)
add("bank_chromagram", lambda s, d: _chroma(s, d).select("clip_id", "frame", "band", "value"), f"{STFT}, {_bank_sql(CHROMA, 'bk')}, c AS (SELECT clip_id, frame, band, sum((re*re + im*im) * w) AS x FROM fs JOIN bk USING (bin) GROUP BY ALL) SELECT clip_id, frame, band, round(x / max(x) OVER (PARTITION BY clip_id, frame), 6) + 0.0 AS value FROM c", "value")


def _chroma(s, d):
    c = filterbanks.banked(embedding_clips(s, d), CHROMA, 16, 8, 64.0, "power", centre=False)
    return c.withColumn("value", F.try_divide(F.col("value"), F.max("value").over(spectral.GROUP())))


add("bank_mfcc", lambda s, d: filterbanks.mfcc(embedding_clips(s, d), 3, 4, 16, 8, 64.0).withColumn("value", F.round("value", 4)), None)
for _scale in ("power", "magnitude", "db"):
    add(f"bank_cqt_{_scale}", lambda s, d, sc=_scale: filterbanks.cqt_spectrogram(embedding_clips(s, d), 4.0, 18, 8, 64.0, sc).withColumn("value", F.round("value", 4)), None)
add("bank_constant_q", lambda s, d: filterbanks.constant_q(embedding_clips(s, d), 4.0, 18, 8, 64.0), None, "freq_hz", "re", "im")

# --- pitch and harmony ------------------------------------------------------------------------------------

add("pitch_difference", lambda s, d: pitch.difference_function(embedding_clips(s, d), 4, 16), f"WITH {EMB} SELECT a.clip_id, CAST(b.idx - a.idx AS INTEGER) AS lag, round(sum((a.v - b.v) ** 2), 6) + 0.0 AS d FROM emb a JOIN emb b ON a.clip_id = b.clip_id AND b.idx - a.idx BETWEEN 4 AND 16 AND a.idx < 48 GROUP BY ALL", "d")
#: The normalised difference over lags of a series, and the least of it near the first lag under a threshold.
YIN = "r AS (SELECT *, sum(d) OVER (PARTITION BY {k} ORDER BY lag) AS run FROM d), m AS (SELECT {k}, lag, CASE WHEN run > 0 THEN d * lag / run ELSE 1 END AS norm FROM r), u AS (SELECT {k}, min(lag) FILTER (WHERE norm < {t}) AS low FROM m GROUP BY {k}), y AS (SELECT {k}, arg_min(lag, struct_pack(n := norm, l := lag)) AS lag FROM m JOIN u USING ({k}) WHERE abs(lag - low) <= 5 GROUP BY {k})"
#: Frames of 32 with a hop of 16, the last ones shorter, down to half a frame.
PF = f"WITH {EV}, fa AS (SELECT clip_id, idx // 16 - o AS f, idx - (idx // 16 - o) * 16 AS p, v FROM ev, (SELECT unnest([0, 1]) AS o) WHERE idx // 16 >= o), fr AS (SELECT *, count(*) OVER (PARTITION BY clip_id, f) AS n FROM fa QUALIFY n >= 16)"
add("pitch_yin", lambda s, d: pitch.detect_pitch(embedding_clips(s, d), 64.0, "yin", 0.9, 4, 16), f"WITH {EMB}, d AS (SELECT a.clip_id, b.idx - a.idx AS lag, sum((a.v - b.v) ** 2) AS d FROM emb a JOIN emb b ON a.clip_id = b.clip_id AND b.idx - a.idx BETWEEN 4 AND 16 WHERE a.idx < 48 GROUP BY ALL), {YIN.format(k='clip_id', t=0.9)} SELECT clip_id, 0 AS ch, round(64.0::DOUBLE / lag, 6) + 0.0 AS frequency FROM (SELECT DISTINCT clip_id FROM emb) LEFT JOIN y USING (clip_id)", "frequency")
add("pitch_autocorrelation", lambda s, d: pitch.detect_pitch(embedding_clips(s, d), 64.0, "autocorrelation", low=4, high=16), f"WITH {EMB}, c AS (SELECT a.clip_id, b.idx - a.idx AS lag, sum(a.v * b.v) AS s FROM emb a JOIN emb b ON a.clip_id = b.clip_id AND b.idx - a.idx BETWEEN 4 AND 16 GROUP BY ALL) SELECT clip_id, 0 AS ch, round(CASE WHEN max(s) > 0 THEN 64.0 / arg_max(lag, s) END, 6) + 0.0 AS frequency FROM c GROUP BY clip_id", "frequency")
TRACK = f"{PF}, c AS (SELECT a.clip_id, a.f, b.p - a.p AS lag, sum(a.v * b.v) AS s FROM fr a JOIN fr b ON a.clip_id = b.clip_id AND a.f = b.f AND b.p - a.p BETWEEN 4 AND 20 GROUP BY ALL) SELECT clip_id, 0 AS ch, f AS frame, f * 16 / 1000.0::DOUBLE AS seconds, round(CASE WHEN max(s) > 0 THEN 1000.0::DOUBLE / arg_max(lag, struct_pack(s := s, l := -lag)) END, 6) + 0.0 AS frequency FROM c GROUP BY clip_id, f"
add("pitch_track", lambda s, d: pitch.track_pitch(event_clips(s, d, 50.0), 32, 16, 1000.0, "autocorrelation", low=50, high=250), TRACK, "frequency")
MEAN_PITCH = f"{PF}, d AS (SELECT a.clip_id, a.f, b.p - a.p AS lag, sum((a.v - b.v) ** 2) AS d FROM fr a JOIN fr b ON a.clip_id = b.clip_id AND a.f = b.f AND b.p - a.p BETWEEN 4 AND 12 WHERE a.n > 24 AND a.p < a.n - 12 GROUP BY ALL), {YIN.format(k='clip_id, f', t=0.8)} SELECT clip_id, 0 AS ch, round(avg(1000.0::DOUBLE / lag), 6) + 0.0 AS mean_pitch FROM (SELECT DISTINCT clip_id FROM fr) LEFT JOIN y USING (clip_id) GROUP BY clip_id"
add("pitch_mean", lambda s, d: pitch.mean_pitch(pitch.track_pitch(event_clips(s, d, 50.0), 32, 16, 1000.0, "yin", 0.8, 80, 250)), MEAN_PITCH, "mean_pitch")
VOICED = f"{PF}, d AS (SELECT a.clip_id, a.f, b.p - a.p AS lag, sum((a.v - b.v) ** 2) AS d FROM fr a JOIN fr b ON a.clip_id = b.clip_id AND a.f = b.f AND b.p - a.p BETWEEN 4 AND 12 WHERE a.n > 24 AND a.p < a.n - 12 GROUP BY ALL), {YIN.format(k='clip_id, f', t=0.8)} SELECT clip_id, 0 AS ch, f AS frame, f * 16 / 1000.0::DOUBLE AS seconds, round(1000.0::DOUBLE / lag, 6) + 0.0 AS frequency FROM y"
add("pitch_voiced_frames", lambda s, d: pitch.voiced_frames(pitch.track_pitch(event_clips(s, d, 50.0), 32, 16, 1000.0, "yin", 0.8, 80, 250)), VOICED, "frequency")
add("pitch_harmonics", lambda s, d: pitch.harmonic_analysis(spec(s, d), 6.0, 4, 0.1).select("clip_id", "harmonic", "level"), f"{W}, h AS (SELECT clip_id, k, max(p) AS p FROM pw, range(1, 5) t(k) WHERE abs(freq_hz - k * 6) <= 0.1 * k * 6 + 1e-12 GROUP BY ALL) SELECT clip_id, CAST(k AS INTEGER) AS harmonic, round(p / max(p) FILTER (WHERE k = 1) OVER (PARTITION BY clip_id), 6) + 0.0 AS level FROM h", "level")
add("pitch_hnr", lambda s, d: pitch.harmonic_to_noise(spec(s, d), 6.0, 4, 1.0).select("clip_id", "hnr_db"), f"{W}, h AS (SELECT clip_id, sum(p) FILTER (WHERE round(freq_hz / 6) BETWEEN 1 AND 4 AND abs(freq_hz - round(freq_hz / 6) * 6) <= 1) AS h, sum(p) AS t FROM pw GROUP BY clip_id) SELECT clip_id, round(10 * log10(h / (t - h)), 6) + 0.0 AS hnr_db FROM h", "hnr_db")
KEYS = ", ".join(f"({t}, '{m}', {(pc)}, {prof[(pc - t) % 12]}::DOUBLE)" for m, prof in (("major", pitch.MAJOR), ("minor", pitch.MINOR)) for t in range(12) for pc in range(12))
add(
    "pitch_key",
    lambda s, d: pitch.estimate_key(_chroma(s, d)),
    f"{STFT}, {_bank_sql(CHROMA, 'bk')}, c0 AS (SELECT clip_id, frame, band, sum((re*re + im*im) * w) AS x FROM fs JOIN bk USING (bin) GROUP BY ALL), c AS (SELECT clip_id, band, avg(y) AS x FROM (SELECT *, x / max(x) OVER (PARTITION BY clip_id, frame) AS y FROM c0) GROUP BY ALL), kp(t, mode, band, w) AS (VALUES {KEYS}), r AS (SELECT clip_id, t, mode, corr(x, w) AS r FROM c JOIN kp USING (band) GROUP BY ALL), n AS (SELECT *, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][t + 1] AS tonic FROM r), b AS (SELECT clip_id, arg_max(struct_pack(tonic := tonic, mode := mode, r := r), struct_pack(r := round(r, 12), m := mode, t := tonic)) AS k FROM n GROUP BY clip_id) SELECT clip_id, k.tonic AS tonic, k.mode AS mode, round((k.r + 1) / 2, 6) + 0.0 AS confidence FROM b",
    "confidence",
)

# --- onsets -----------------------------------------------------------------------------------------------

LAGGED = f"{STFT}, l AS (SELECT *, lag(re) OVER w AS pre, lag(im) OVER w AS pim FROM fs WINDOW w AS (PARTITION BY clip_id, bin ORDER BY frame))"
M, PM = "sqrt(re*re+im*im)", "sqrt(pre*pre+pim*pim)"
for _m, _e in (("energy", f"greatest({M} - {PM}, 0)"), ("magnitude", f"abs({M} - {PM})"), ("complex", "sqrt((re-pre)**2 + (im-pim)**2)")):
    add(f"onset_flux_{_m}", lambda s, d, m=_m: onsets.flux(stft(s, d), m), f"{LAGGED} SELECT clip_id, frame, round(sum(coalesce({_e}, 0)), 6) + 0.0 AS x FROM l GROUP BY ALL", "x")
add("onset_magnitude_difference", lambda s, d: onsets.magnitude_difference(stft(s, d)).select("clip_id", "frame", "bin", "d"), f"{LAGGED} SELECT clip_id, frame, CAST(bin AS INTEGER) AS bin, round(coalesce({M} - {PM}, 0), 6) + 0.0 AS d FROM l", "d")
add("onset_phase_deviation", lambda s, d: onsets.phase_deviation(stft(s, d).where("bin between 1 and 7"), 8, 64.0).groupBy("clip_id", "frame").agg((F.max("p") <= 3.1416).alias("within"), F.count("*").alias("n")), f"{STFT} SELECT clip_id, frame, true AS within, count(*) AS n FROM fs WHERE bin BETWEEN 1 AND 7 GROUP BY ALL")
STEP = "(atan2(im, re) - atan2(pim, pre) - pi() * bin + pi())"  # a bin's frequency times hop over rate is bin / 2
add(
    "onset_phase_deviation_bins",  # of bins whose phase is not a sign alone
    lambda s, d: onsets.phase_deviation(stft(s, d), 8, 64.0).where("bin between 1 and 7").select("clip_id", "frame", "bin", F.round("p", 4).alias("p")),
    f"{LAGGED} SELECT clip_id, frame, CAST(bin AS INTEGER) AS bin, round(coalesce(abs({STEP} - 2 * pi() * floor({STEP} / (2 * pi())) - pi()), 0), 4) + 0.0 AS p FROM l WHERE bin BETWEEN 1 AND 7",
)
add("onset_adaptive_zero", lambda s, d: onsets.adaptive_zero(onsets.flux(stft(s, d)), 3, 1.1), None, "x")
OC = onsets.OnsetConfig(8, 3, 1.1, 4.0, 18, onsets.peaks.PeakConfig(2, None, None, threshold=onsets.peaks.Threshold("delta", 0.5, window=4)))
add("onset_detection_function", lambda s, d: onsets.onset_detection_function(embedding_clips(s, d), 64.0, OC), None, "x")
add("onset_detect", lambda s, d: onsets.detect_onsets(embedding_clips(s, d), 64.0, OC), None, "seconds")
add("onset_detect_flux", lambda s, d: onsets.detect_onsets_flux(embedding_clips(s, d), 64.0, c=OC), None, "seconds")
add("onset_detect_complex", lambda s, d: onsets.detect_onsets_complex(embedding_clips(s, d), 64.0, OC), None, "seconds")
add("onset_complex_odf", lambda s, d: onsets.complex_odf(stft(s, d), 8, 64.0).withColumn("x", F.round("x", 4)), None)

# --- resampling -------------------------------------------------------------------------------------------

LIN = "SELECT a.clip_id, 0 AS ch, CAST(o AS BIGINT) AS idx, round(a.v + (coalesce(b.v, a.v) - a.v) * (o * {s}.0 / {t} - a.idx), 6) + 0.0 AS v FROM range({n}) r(o) JOIN emb a ON a.idx = o * {s} // {t} LEFT JOIN emb b ON b.clip_id = a.clip_id AND b.idx = a.idx + 1"
add("resample_linear_down", lambda s, d: resampling.resample(embedding_clips(s, d), 44100, 16000, "fast"), f"WITH {EMB} {LIN.format(s=441, t=160, n=24)}", "v")
add("resample_linear_up", lambda s, d: resampling.resample(embedding_clips(s, d), 64, 96, "fast"), f"WITH {EMB} {LIN.format(s=64, t=96, n=96)}", "v")
add("resample_decimate", lambda s, d: resampling.resample(embedding_clips(s, d), 64, 16, "fast"), f"WITH {EMB} SELECT clip_id, ch, idx // 4 AS idx, round(v, 6) + 0.0 AS v FROM emb WHERE idx % 4 = 0", "v")
# Taps and windows as the qualities are defined.
SINCS = {"medium": (128, "0.5 - 0.5 * cos(2 * pi() * u)"), "high": (256, "0.42 - 0.5 * cos(2 * pi() * u) + 0.08 * cos(4 * pi() * u)")}


def _sinc_sql(source, target, n, taps, window):
    """The windowed sum over source samples for every output, cut off at 0.95 of the lower rate."""
    half, scale = -(-taps * max(source, target) // (2 * target)), f"(0.95 * least(1.0, {target} / {source}.0))"
    return f"""WITH {EMB}, p AS (SELECT clip_id, o, v, o * {source}.0::DOUBLE / {target} - idx AS d FROM range({n}) r(o) JOIN emb ON idx BETWEEN o * {source} // {target} - {half - 1} AND o * {source} // {target} + {half}),
w AS (SELECT *, 0.5 + d / {2 * half} AS u, pi() * {scale} * d AS a FROM p)
SELECT clip_id, 0 AS ch, CAST(o AS BIGINT) AS idx, round(sum(v * {scale} * CASE WHEN a = 0 THEN 1 ELSE sin(a) / a END * ({window})), 6) + 0.0 AS v FROM w GROUP BY clip_id, o"""


for _q in ("medium", "high"):
    add(f"resample_{_q}", lambda s, d, q=_q: resampling.resample(embedding_clips(s, d), 64, 48, q), _sinc_sql(64, 48, 48, *SINCS[_q]), "v")
add("resample_by_ratio", lambda s, d: resampling.resample_by_ratio(embedding_clips(s, d), 64, 0.5, "fast"), f"WITH {EMB} SELECT clip_id, ch, idx // 2 AS idx, round(v, 6) + 0.0 AS v FROM emb WHERE idx % 2 = 0", "v")

# --- recursive filters ------------------------------------------------------------------------------------


def _section_sql(sections: np.ndarray) -> str:
    """Second-order sections as nested recursive queries over the index."""
    parts, src = [EMB], "emb"
    for k, s in enumerate(sections):
        b0, b1, b2, a1, a2 = (f"({float(x)!r}::DOUBLE)" for x in (*(s[:3] / s[3]), *(s[4:] / s[3])))
        parts.append(
            f"f{k} AS (SELECT clip_id, 0::BIGINT AS idx, {b0} * v AS v, {b1} * v - {a1} * {b0} * v AS z1, {b2} * v - {a2} * {b0} * v AS z2 FROM {src} WHERE idx = 0 UNION ALL "
            f"SELECT r.clip_id, r.idx + 1, {b0} * e.v + r.z1, {b1} * e.v - {a1} * ({b0} * e.v + r.z1) + r.z2, {b2} * e.v - {a2} * ({b0} * e.v + r.z1) FROM f{k} r JOIN {src} e ON e.clip_id = r.clip_id AND e.idx = r.idx + 1)"
        )
        src = f"f{k}"
    return f"WITH RECURSIVE {', '.join(parts)} SELECT clip_id, 0 AS ch, idx, round(v, 6) + 0.0 AS v FROM {src}"


for _family in iir.FAMILIES:
    for _response, _corner in (("lowpass", 8.0), ("highpass", 8.0), ("bandpass", (5.0, 12.0)), ("bandstop", (5.0, 12.0))):
        _order = 3 if _response in ("lowpass", "highpass") else 2
        add(
            f"iir_{_family}_{_response}",
            lambda s, d, f=_family, r=_response, c=_corner, o=_order: iir.apply_iir_filter(embedding_clips(s, d), f, r, o, c, 64.0),
            _section_sql(iir.design(_family, _response, _order, _corner, 64.0)),
            "v",
        )
LONG_CLIP = iir.design("butterworth", "lowpass", 3, 8.0, 64.0)
add("long_recursive_filter", lambda s, d: chunks.recursive_filter(embedding_clips(s, d), LONG_CLIP, 10), _section_sql(LONG_CLIP), "v")
add("long_fir", lambda s, d: chunks.fir(embedding_clips(s, d), [0.25, 0.5, 0.25], 10), f"WITH {EMB} SELECT a.clip_id, a.ch, a.idx, round(0.25 * a.v + 0.5 * b.v + 0.25 * c.v, 6) + 0.0 AS v FROM emb a JOIN emb b ON a.clip_id = b.clip_id AND b.idx = a.idx + 1 JOIN emb c ON a.clip_id = c.clip_id AND c.idx = a.idx + 2", "v")
R.add("long_crossings", lambda s, d: chunks.crossings(stereo_embeddings(s, d), 7), f"WITH {ST}, p AS (SELECT *, lag(v) OVER (PARTITION BY clip_id, ch ORDER BY idx) AS p FROM st) SELECT clip_id, CAST(sum(CASE WHEN (p > 0 AND v <= 0) OR (p <= 0 AND v > 0) THEN 1 ELSE 0 END) AS BIGINT) AS zero_crossings FROM p GROUP BY clip_id")
# Second-order Butterworth low pass by the bilinear transform: k = tan(pi fc / sr), Q = 1 / sqrt 2.
LOW_2 = "kk AS (SELECT tan(pi() * 8 / 64) AS k), co AS (SELECT k * k / (1 + sqrt(2) * k + k * k) AS b, 2 * (k * k - 1) / (1 + sqrt(2) * k + k * k) AS a1, (1 - sqrt(2) * k + k * k) / (1 + sqrt(2) * k + k * k) AS a2 FROM kk)"


def _low_2(name, src):
    """That filter from rest, in direct form I, as a recursive query over ``src``."""
    return (
        f"{name} AS (SELECT clip_id, 0::BIGINT AS idx, v AS x1, 0::DOUBLE AS x2, b * v AS v, 0::DOUBLE AS y1 FROM {src}, co WHERE idx = 0 UNION ALL "
        f"SELECT r.clip_id, r.idx + 1, e.v, r.x1, b * (e.v + 2 * r.x1 + r.x2) - a1 * r.v - a2 * r.y1, r.v FROM {name} r JOIN {src} e ON e.clip_id = r.clip_id AND e.idx = r.idx + 1, co)"
    )


ODD = "ex AS (SELECT clip_id, idx + 6 AS idx, v FROM emb UNION ALL SELECT clip_id, 6 - e.idx, 2 * f.v - e.v FROM emb e JOIN emb f USING (clip_id) WHERE f.idx = 0 AND e.idx BETWEEN 1 AND 6 UNION ALL SELECT clip_id, 132 - e.idx, 2 * f.v - e.v FROM emb e JOIN emb f USING (clip_id) WHERE f.idx = 63 AND e.idx BETWEEN 57 AND 62)"
FILTFILT = f"WITH RECURSIVE {EMB}, {LOW_2}, {ODD}, {_low_2('fw', 'ex')}, tu AS (SELECT clip_id, 75 - idx AS idx, v FROM fw), {_low_2('bw', 'tu')} SELECT clip_id, 0 AS ch, 69 - idx AS idx, round(v, 6) + 0.0 AS v FROM bw WHERE idx BETWEEN 6 AND 69"
add("iir_filtfilt", lambda s, d: iir.filtfilt(embedding_clips(s, d), "butterworth", "lowpass", 2, 8.0, 64.0), FILTFILT, "v")
add("long_zero_phase", lambda s, d: chunks.zero_phase(embedding_clips(s, d), iir.design("butterworth", "lowpass", 2, 8.0, 64.0), 6, 10), FILTFILT, "v")
BANDS = {
    "peak": eq.Band("peak", 8.0, 6.0, 1.0),
    "low_shelf": eq.Band("low_shelf", 6.0, 4.0),
    "high_shelf": eq.Band("high_shelf", 12.0, -4.0),
    "low_pass": eq.Band("low_pass", 10.0),
    "high_pass": eq.Band("high_pass", 4.0),
    "band_pass": eq.Band("band_pass", 8.0),
    "band_stop": eq.Band("band_stop", 8.0),
}
for _k, _b in BANDS.items():
    add(f"eq_{_k}", lambda s, d, b=_b: eq.apply_eq_band(embedding_clips(s, d), b, 64.0), _section_sql(eq.section(_b, 64.0)[None]), "v")
THREE = eq.three_band((4.0, 3.0), (10.0, -2.0, 1.0), (20.0, 1.0))
add("eq_three_band", lambda s, d: eq.apply_parametric_eq(embedding_clips(s, d), THREE, 64.0), _section_sql(np.array([eq.section(b, 64.0) for b in THREE])), "v")

# --- dynamics ---------------------------------------------------------------------------------------------

DY = dynamics.Dynamics(-20, 4, 20, 100, 2, "soft", 4, "peak")
UP, DOWN = (f"exp(-1 / ({t} / 1000.0 * 64))" for t in (20, 100))
FOLLOW = f"WITH RECURSIVE {EMB}, fl AS (SELECT clip_id, idx, v, abs(v) AS d, (1 - CASE WHEN abs(v) > 0 THEN {UP} ELSE {DOWN} END) * abs(v) AS e FROM emb WHERE idx = 0 UNION ALL SELECT r.clip_id, r.idx + 1, e.v, abs(e.v), CASE WHEN abs(e.v) > r.d THEN {UP} ELSE {DOWN} END * r.e + (1 - CASE WHEN abs(e.v) > r.d THEN {UP} ELSE {DOWN} END) * abs(e.v) FROM fl r JOIN emb e ON e.clip_id = r.clip_id AND e.idx = r.idx + 1), lv AS (SELECT *, 20 * log10(greatest(e, 1e-10)) AS lv FROM fl)"
add("dyn_envelope", lambda s, d: dynamics.envelope(embedding_clips(s, d), 64.0, 20, 100), f"{FOLLOW} SELECT clip_id, 0 AS ch, idx, round(e, 6) + 0.0 AS v FROM lv", "v")
SOFT = "CASE WHEN o <= 0 THEN 0 WHEN o <= 2 THEN o - o / (1 + 3 * (o / 2) ** 2) ELSE 2 - 2 / 4.0 + (o - 2) - (o - 2) / 4.0 END"
add("dyn_compressor", lambda s, d: dynamics.apply_compressor(embedding_clips(s, d), DY, 64.0), f"{FOLLOW}, g AS (SELECT *, lv + 20 AS o FROM lv) SELECT clip_id, 0 AS ch, idx, round(v * 10 ** ((2 - {SOFT}) / 20), 6) + 0.0 AS v FROM g", "v")
add("dyn_gain_reduction", lambda s, d: dynamics.gain_reduction(embedding_clips(s, d), DY, 64.0), f"{FOLLOW}, g AS (SELECT *, lv + 20 AS o FROM lv) SELECT clip_id, 0 AS ch, idx, round({SOFT}, 6) + 0.0 AS v FROM g", "v")
LIMIT = dynamics.Dynamics(-20, 1, 20, 100, 0, "hard", 0.5, "peak")
add("dyn_limiter", lambda s, d: dynamics.apply_limiter(embedding_clips(s, d), LIMIT, 64.0), f"{FOLLOW} SELECT clip_id, 0 AS ch, idx, round(v * 10 ** (-greatest(lv + 20, 0) / 20), 6) + 0.0 AS v FROM lv", "v")
GATE = dynamics.Dynamics(-20, 10, 20, 100, detection="peak")
add("dyn_gate", lambda s, d: dynamics.apply_gate(embedding_clips(s, d), GATE, 64.0), f"{FOLLOW} SELECT clip_id, 0 AS ch, idx, round(v * 10 ** (-greatest(-20 - lv, 0) * 9 / 10 / 20), 6) + 0.0 AS v FROM lv", "v")
add("dyn_expander", lambda s, d: dynamics.apply_expander(embedding_clips(s, d), dynamics.Dynamics(-20, 2, 20, 100, detection="peak"), 64.0), f"{FOLLOW} SELECT clip_id, 0 AS ch, idx, round(v * 10 ** (-greatest(-20 - lv, 0) / 20), 6) + 0.0 AS v FROM lv", "v")
# The follower of the reversed clips, next to the clips themselves.
SIDE = FOLLOW.replace(", fl AS (", ", rv AS (SELECT clip_id, 63 - idx AS idx, v FROM emb), fl AS (").replace("FROM emb WHERE idx = 0", "FROM rv WHERE idx = 0").replace("JOIN emb e", "JOIN rv e")
SIDE += ", g AS (SELECT clip_id, idx, emb.v, lv + 20 AS o FROM lv JOIN emb USING (clip_id, idx))"
add("dyn_compressor_sidechain", lambda s, d: dynamics.apply_compressor(embedding_clips(s, d), DY, 64.0, editing.reverse(embedding_clips(s, d))), f"{SIDE} SELECT clip_id, 0 AS ch, idx, round(v * 10 ** ((2 - {SOFT}) / 20), 6) + 0.0 AS v FROM g", "v")
add("dyn_limiter_sidechain", lambda s, d: dynamics.apply_limiter(embedding_clips(s, d), LIMIT, 64.0, editing.reverse(embedding_clips(s, d))), f"{SIDE} SELECT clip_id, 0 AS ch, idx, round(v * 10 ** (-greatest(o, 0) / 20), 6) + 0.0 AS v FROM g", "v")
add("long_envelope", lambda s, d: dynamics.envelope(embedding_clips(s, d), 64.0, 20, 100, chunk=7), f"{FOLLOW} SELECT clip_id, 0 AS ch, idx, round(e, 6) + 0.0 AS v FROM lv", "v")
LATCH = f"{FOLLOW}, up AS (SELECT clip_id, idx, e, e > coalesce(lag(e) OVER (PARTITION BY clip_id ORDER BY idx), 0) AS up FROM fl)"
ATTACK_DECAY = f"{LATCH} SELECT clip_id, 0 AS ch, idx, round(coalesce(last_value(CASE WHEN up THEN e END IGNORE NULLS) OVER w, 0), 6) + 0.0 AS attack, round(coalesce(last_value(CASE WHEN NOT up THEN e END IGNORE NULLS) OVER w, 0), 6) + 0.0 AS decay FROM up WINDOW w AS (PARTITION BY clip_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
add("env_attack_decay", lambda s, d: envelopes.attack_decay_envelope(embedding_clips(s, d), 64, 20, 100), ATTACK_DECAY, "attack", "decay")
add("dyn_curve", lambda s, d: dynamics.compression_curve(embedding_clips(s, d).select("clip_id", "idx", (F.col("v") * 100 - 20).alias("level_db")), DY).select("clip_id", "idx", "out_db"), f"WITH {EMB}, g AS (SELECT clip_id, idx, v * 100 - 20 AS l, v * 100 - 20 + 20 AS o FROM emb) SELECT clip_id, idx, round(l - {SOFT} + 2, 6) + 0.0 AS out_db FROM g", "out_db")

# --- separation, psychoacoustics and codecs ---------------------------------------------------------------

HP = hpss.HpssConfig(16, 4, 5, 5, 0.3)
# Hann frames of 16 with a hop of 4 over the clip padded by 8; medians of five reflected neighbours; masks; overlap-add.
HANN16 = "(0.5 - 0.5 * cos(2 * pi() * {n} / 16))"
HPSS = (
    f"WITH {EMB}, st AS (SELECT clip_id, f, k, sum(v * {HANN16.format(n='(idx + 8 - 4 * f)')} * cos(2 * pi() * k * (idx + 8 - 4 * f) / 16)) AS re, -sum(v * {HANN16.format(n='(idx + 8 - 4 * f)')} * sin(2 * pi() * k * (idx + 8 - 4 * f) / 16)) AS im FROM emb JOIN range(17) a(f) ON idx + 8 - 4 * f BETWEEN 0 AND 15, range(9) b(k) GROUP BY ALL), "
    "mg AS (SELECT *, sqrt(re * re + im * im) AS m FROM st), o AS (SELECT unnest(range(-2, 3)) AS o), "
    "hm AS (SELECT a.clip_id, a.f, a.k, median(b.m) AS h FROM mg a, o JOIN mg b ON b.clip_id = a.clip_id AND b.k = a.k AND b.f = 16 - abs(16 - abs(a.f + o.o)) GROUP BY ALL), "
    "pm AS (SELECT a.clip_id, a.f, a.k, median(b.m) AS p FROM mg a, o JOIN mg b ON b.clip_id = a.clip_id AND b.f = a.f AND b.k = 8 - abs(8 - abs(a.k + o.o)) GROUP BY ALL), "
    "ma AS (SELECT *, 0.3 * {a} / (h + p + 1e-10) + 0.7 * CASE WHEN {c} THEN 1 ELSE 0 END AS g FROM mg JOIN hm USING (clip_id, f, k) JOIN pm USING (clip_id, f, k)), "
    "fr AS (SELECT clip_id, f, n, sum(CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END * g * (re * cos(2 * pi() * k * n / 16) - im * sin(2 * pi() * k * n / 16))) / 16 AS y FROM ma, range(16) t(n) GROUP BY ALL) "
    f"SELECT clip_id, 0 AS ch, 4 * f + n - 8 AS idx, round(sum(y * {HANN16.format(n='n')}) / sum({HANN16.format(n='n')} ** 2), 6) + 0.0 AS v FROM fr WHERE 4 * f + n BETWEEN 8 AND 71 GROUP BY clip_id, 4 * f + n"
)
for _part, _name, _a, _c in ((0, "harmonic", "h", "h >= p"), (1, "percussive", "p", "p > h")):
    add(f"hpss_{_name}", lambda s, d, k=_part: hpss.hpss(embedding_clips(s, d), 64.0, HP)[k], HPSS.replace("{a}", _a).replace("{c}", _c), "v")
LAYOUT = psycho.band_layout("bark", 6, 8000.0, 33)


def _power(s, d):
    return spec(s, d).select("clip_id", "frame", "bin", spectral.power().alias("power"))


LV = ", ".join(f"({k}, {a}, {b}, {c!r}::DOUBLE)" for k, a, b, c, _ in LAYOUT)
BE = f"{W}, ly(band, s, e, c) AS (VALUES {LV}), be AS (SELECT clip_id, band, c, 10 * log10(sum(p) / max(e - s) + 1e-10) AS energy FROM pw JOIN ly ON bin >= s AND bin < e GROUP BY clip_id, band, c), tn AS (SELECT *, energy - coalesce((lag(energy) OVER w + lead(energy) OVER w) / 2, lag(energy) OVER w, lead(energy) OVER w) >= 7 AS tonal, greatest(26.81 * c / (1960 + c) - 0.53, 0) AS z FROM be WINDOW w AS (PARTITION BY clip_id ORDER BY band))"
add("psycho_band_energies", lambda s, d: psycho.band_energies(_power(s, d), LAYOUT).select("clip_id", "band", "energy_db"), f"{BE} SELECT clip_id, band, round(energy, 6) + 0.0 AS energy_db FROM be", "energy_db")
add("psycho_tonal", lambda s, d: psycho.tonal_bands(psycho.band_energies(_power(s, d), LAYOUT)).select("clip_id", "band", "tonal"), f"{BE} SELECT clip_id, band, tonal FROM tn")
ATH = "greatest(least(3.64 * (c / 1000) ** -0.8 - 6.5 * exp(-0.6 * (c / 1000 - 3.3) ** 2) + 1e-3 * (c / 1000) ** 4, 60), -20)"
METRICS = f"{BE}, th AS (SELECT j.clip_id, j.band, j.energy, greatest(max(i.energy - CASE WHEN i.band = j.band THEN 0.5 ELSE CASE WHEN i.tonal THEN 14.5 ELSE 5.5 END + CASE WHEN j.z >= i.z THEN 25 * (j.z - i.z) ELSE 6 * (i.z - j.z) END END), max({ATH.replace('c /', 'j.c /')})) AS thr FROM tn j JOIN tn i USING (clip_id) GROUP BY ALL)"
add("psycho_metrics", lambda s, d: psycho.band_metrics(_power(s, d), LAYOUT).drop("frame"), f"{METRICS} SELECT clip_id, band, round(energy, 6) + 0.0 AS energy_db, round(thr, 6) + 0.0 AS threshold_db, round(energy - thr, 6) + 0.0 AS smr_db, round(greatest(energy - thr, 0), 6) + 0.0 AS importance FROM th", "energy_db", "threshold_db", "smr_db", "importance")
add("psycho_temporal_masking", lambda s, d: psycho.temporal_masking(psycho.band_metrics(stft(s, d).select("clip_id", "frame", "bin", spectral.power().alias("power")), psycho.band_layout("bark", 3, 8000.0, 9)), 10.0, 0.1, 0.5, 6), None, "energy_db", "threshold_db", "smr_db", "importance")
add("psycho_hearing_threshold", lambda s, d: embedding_clips(s, d).select("clip_id", "idx", psycho.hearing_threshold(F.col("idx") * 200.0).alias("y")), f"WITH {EMB}, x AS (SELECT clip_id, idx, idx * 200.0::DOUBLE AS c FROM emb) SELECT clip_id, idx, round(CASE WHEN c <= 0 THEN 60 ELSE {ATH.replace('(c / 1000) ** -0.8', '(greatest(c, 1) / 1000) ** -0.8')} END, 6) + 0.0 AS y FROM x", "y")


def _layouts(s, d):
    rows = [(kind, *b) for kind in ("bark", "mel", "erb", "celt") for b in psycho.band_layout(kind, 8, 44100.0, 513)]
    return s.createDataFrame(rows, "kind string, band int, start_bin int, end_bin int, centre_hz double, position double")


add("psycho_layouts", _layouts, None, "centre_hz", "position")
add("quant_allocate", lambda s, d: quantise.allocate_bits(psycho.band_metrics(_power(s, d), LAYOUT), 600, 2).select("clip_id", "band", "bits", "step"), f"{METRICS}, w AS (SELECT *, 10 ** (energy / 10) * (1 + greatest(energy - thr, 0)) AS w FROM th) SELECT clip_id, band, CAST(2 + round(w / sum(w) OVER (PARTITION BY clip_id) * (600 - 12)) AS BIGINT) AS bits, round(greatest(10 ** (thr / 20) * sqrt(12), 1e-6), 6) + 0.0 AS step FROM w", "step")
add("quant_round_trip", lambda s, d: embedding_clips(s, d).withColumn("q", quantise.quantize(F.col("v"), F.lit(0.01), F.lit(6))).select("clip_id", "idx", "q", quantise.dequantize(F.col("q"), F.lit(0.01)).alias("v")), f"WITH {EMB}, q AS (SELECT clip_id, idx, CAST(greatest(least(round(v / 0.01), 31), -31) AS BIGINT) AS q FROM emb) SELECT clip_id, idx, q, round(q * 0.01::DOUBLE, 6) + 0.0 AS v FROM q", "v")


def _refined(s, d):
    c = embedding_clips(s, d).select("clip_id", F.floor(F.col("idx") / 16).cast("int").alias("band"), F.col("v").alias("value"))
    return quantise.refine_steps(c, c.select("clip_id", "band").distinct().withColumn("bits", F.lit(80) - F.col("band") * 10))


add("quant_refine", _refined, f"WITH {EMB}, s AS (SELECT clip_id, CAST(idx // 16 AS INTEGER) AS band, max(abs(v)) AS pk, avg(v*v) AS var, count(*) AS n FROM emb GROUP BY ALL), w AS (SELECT *, greatest(least(sum(80 - band * 10) OVER c * 1.0::DOUBLE / sum(n) OVER c + 0.5 * (log2(var) - avg(log2(var)) OVER c), 24), 0) AS w FROM s WINDOW c AS (PARTITION BY clip_id)) SELECT clip_id, band, round(greatest(2 * pk / CASE WHEN w < 0.5 THEN 1 ELSE 2 ** w END, 1e-6), 6) + 0.0 AS step, CAST(CASE WHEN w < 0.5 THEN 1 ELSE least(ceil(w) + 1, 25) END AS BIGINT) AS word FROM w", "step")


def _tone(s, rate=8000, seconds=0.5):
    return generate.compound_tone(s, [(440, 0.5), (1250, 0.2)], seconds, rate)


def _snr_query(make):
    """Round-trip quality of a codec on a tone: finite, and above 20 dB."""

    def query(s, d):
        return codec.round_trip_snr(_tone(s), make()).select("clip_id", (F.col("snr") > 20).alias("good"))

    return query


GOOD = "SELECT 0::BIGINT AS clip_id, true AS good"
add("codec_perceptual", _snr_query(lambda: codec.PerceptualCodec(8000, 64_000, 128, segment=2000)), GOOD)
for _mode in ("speech", "music", "hybrid"):
    add(f"codec_frames_{_mode}", _snr_query(lambda m=_mode: codec.FrameCodec(8000, 96_000, mode=m)), GOOD)
add("codec_frames_auto", _snr_query(lambda: codec.FrameCodec(8000, 96_000)), GOOD)


def _clip_snr(make):
    """Round-trip quality of a codec on every event clip."""
    return lambda s, d: codec.round_trip_snr(event_clips(s, d, 50.0), make()).select("clip_id", F.round("snr", 3).alias("snr"))


R.add("codec_perceptual_clips", _clip_snr(lambda: codec.PerceptualCodec(1000, 8_000, 16, segment=40)))
R.add("codec_frames_auto_clips", _clip_snr(lambda: codec.FrameCodec(1000, 12_000)))


def _stereo(s, d):
    two = generate.on_channels(_tone(s), 2)
    c = codec.PerceptualCodec(8000, 64_000, 128)
    from ripplefield.operators.container import arithmetic

    return compare.snr(two, arithmetic(two, codec.stereo_decode(codec.stereo_encode(two, c), c), "-")).select("clip_id", (F.col("snr") > 20).alias("good"))


add("codec_stereo", _stereo, GOOD)

# --- plots ------------------------------------------------------------------------------------------------

add("plot_waveform", lambda s, d: sinks.waveform(event_clips(s, d, 50.0), 10, 1000), f"WITH {EV}, n AS (SELECT *, CAST(ceil((max(idx) OVER (PARTITION BY clip_id) + 1) / 10.0) AS BIGINT) AS k FROM ev) SELECT clip_id, ch, idx // k AS point, min(idx) / 1000.0::DOUBLE AS seconds, round(min(v), 6) + 0.0 AS low, round(max(v), 6) + 0.0 AS high FROM n GROUP BY clip_id, ch, idx // k", "low", "high")
add("plot_lissajous", lambda s, d: sinks.lissajous(stereo_embeddings(s, d), 10), f"WITH {ST} SELECT clip_id, idx, round(max(v) FILTER (WHERE ch = 0), 6) + 0.0 AS x, round(max(v) FILTER (WHERE ch = 1), 6) + 0.0 AS y FROM st WHERE idx % 4 = 0 GROUP BY clip_id, idx", "x", "y")
add("plot_magnitude_spectrum", lambda s, d: sinks.magnitude_spectrum(spec(s, d)).select("clip_id", "bin", "magnitude"), f"{W} SELECT clip_id, CAST(bin AS INTEGER) AS bin, round(m, 6) + 0.0 AS magnitude FROM pw", "magnitude")
add("plot_phase_spectrum", lambda s, d: sinks.phase_spectrum(spec(s, d)).where("bin between 1 and 31").select("clip_id", "bin", "phase"), f"{W} SELECT clip_id, CAST(bin AS INTEGER) AS bin, round(atan2(im, re), 6) + 0.0 AS phase FROM pw WHERE bin BETWEEN 1 AND 31", "phase")
add("detect_frequency_range", lambda s, d: _range(s, d), f"{W}, t AS (SELECT *, max(p) OVER (PARTITION BY clip_id) AS t FROM pw) SELECT clip_id, min(freq_hz) AS low_hz, max(freq_hz) AS high_hz FROM t WHERE p > 0.01 * t GROUP BY clip_id")


def _range(s, d):
    from ripplefield.operators.detect import frequency_range

    return frequency_range(spec(s, d).select("clip_id", "freq_hz", spectral.power().alias("power")))


def _distance(s, d):
    p = lambda x: spectral.fft(x, 64, 64.0).select("clip_id", "ch", "bin", spectral.power().alias("power"))
    return compare.log_spectral_distance(p(embedding_clips(s, d)), p(embedding_clips(s, d).withColumn("v", F.col("v") * 2)))


add("cmp_log_spectral_distance", _distance, f"{W} SELECT clip_id, round(sqrt(avg((10 * log10(p + 1e-10) - 10 * log10(4 * p + 1e-10)) ** 2)), 6) + 0.0 AS distance FROM pw GROUP BY clip_id", "distance")

QUERIES, ORACLES = R.QUERIES, R.ORACLES
_ = r6
