"""Queries over scalar functions, sample formats and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplefield.functions import draws, formats, scales
from ripplefield.plans.sqlforms import EMB, EV, Registry, r6, rounded
from ripplefield.sources import generate
from ripplefield.sources.tables import embedding_clips, event_clips, table

R = Registry()


def _scalar(name, f, sql, over="o_totalprice", source="orders", key="o_orderkey"):
    """A function of one column, by key."""
    R.add(
        f"fn_{name}",
        lambda s, d: table(s, d, source).select(F.col(key).cast("long").alias("k"), r6(f(F.col(over))).alias("y")),
        f"SELECT CAST({key} AS BIGINT) AS k, round({sql}, 6) + 0.0 AS y FROM (SELECT {key}, {over} AS x FROM {source})",
    )


_scalar("hz_to_mel", scales.hz_to_mel, "2595 * log10(1 + x / 700)")
_scalar("mel_to_hz", lambda x: scales.mel_to_hz(x / 100), "700 * (10 ** (x / 100 / 2595) - 1)")
_scalar("hz_to_midi", scales.hz_to_midi, "12 * log2(x / 440) + 69")
_scalar("midi_to_hz", lambda x: scales.midi_to_hz(x / 10000), "440 * 2 ** ((x / 10000 - 69) / 12)")
_scalar("amplitude_to_db", lambda x: scales.amplitude_to_db(x - 50000), "CASE WHEN x - 50000 <= 0 THEN -80.0 ELSE 20 * log10(greatest(x - 50000, 1e-300)) END")
_scalar("db_to_amplitude", lambda x: scales.db_to_amplitude(x / 10000), "10 ** (x / 10000 / 20)")
_scalar("power_to_db", lambda x: scales.power_to_db(x - 50000), "CASE WHEN x - 50000 <= 0 THEN -80.0 ELSE 10 * log10(greatest(x - 50000, 1e-300)) END")
_scalar("db_to_power", lambda x: scales.db_to_power(x / 10000), "10 ** (x / 10000 / 10)")
_scalar("cents_to_ratio", lambda x: scales.cents_to_ratio(x / 100), "2 ** (x / 100 / 1200)")
_scalar("ratio_to_cents", scales.ratio_to_cents, "1200 * log2(x)")
_scalar("hz_to_bark", scales.hz_to_bark, "greatest(26.81 * x / (1960 + x) - 0.53, 0)")
_scalar("bark_to_hz", lambda x: scales.bark_to_hz(x / 20000), "1960 * (x / 20000 + 0.53) / (26.28 - x / 20000)")
_scalar("hz_to_erb", lambda x: scales.hz_to_erb(x / 7), "24.7 * (4.37 * (x / 7) / 1000 + 1)")
_scalar("erb_to_hz", lambda x: scales.erb_to_hz(x / 7), "(x / 7 / 24.7 - 1) * 1000 / 4.37")
_scalar("frames_to_time", lambda x: scales.frames_to_time(F.floor(x), 44100, 512), "floor(x) * 512 / 44100")
_scalar("time_to_frames", lambda x: scales.time_to_frames(x, 44100, 512).cast("double"), "round(x * 44100 / 512)")
_scalar("samples_to_time", lambda x: scales.samples_to_time(F.floor(x), 44100), "floor(x) / 44100")
_scalar("seconds_to_samples", lambda x: scales.seconds_to_samples(x, 44100).cast("double"), "round(x * 44100)")
_scalar("ms_to_samples", lambda x: scales.ms_to_samples(x, 44100).cast("double"), "round(x * 0.001 * 44100)")


def _notes(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.pmod(F.col("o_orderkey"), F.lit(108)).cast("int").alias("m"))
    name = scales.midi_to_note(F.col("m") + 12)
    return o.select("k", name.alias("note"), scales.note_to_midi(name).cast("long").alias("midi"), r6(scales.note_to_frequency(name)).alias("hz"))


NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"
R.add(
    "fn_note_names",
    _notes,
    f"SELECT CAST(o_orderkey AS BIGINT) AS k, {NAMES}[m % 12 + 1] || CAST(m // 12 - 1 AS VARCHAR) AS note, CAST(m AS BIGINT) AS midi, round(440 * 2 ** ((m - 69) / 12.0), 6) + 0.0 AS hz FROM (SELECT o_orderkey, CAST(o_orderkey % 108 + 12 AS INTEGER) AS m FROM orders)",
)


def _nearest_note(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), scales.frequency_to_note(F.col("o_totalprice") / 100 + 20).alias("n"))
    return o.select("k", F.col("n.note").alias("note"), r6("n.cents").alias("cents"))


R.add(
    "fn_frequency_to_note",
    _nearest_note,
    f"SELECT k, {NAMES}[CAST(round(m) AS INTEGER) % 12 + 1] || CAST(CAST(round(m) AS INTEGER) // 12 - 1 AS VARCHAR) AS note, round((m - round(m)) * 100, 6) + 0.0 AS cents FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, 12 * log2((o_totalprice / 100 + 20) / 440) + 69 AS m FROM orders)",
)


def _grids(s, d):
    one = table(s, d, "region").where("r_regionkey = 0")
    arrays = {"linspace": scales.linspace(0, 10, 7), "fft": scales.fft_frequencies(16, 44100), "mel": scales.mel_frequencies(9, 0, 8000)}
    parts = [one.select(F.lit(k).alias("grid"), F.posexplode(a).alias("i", "y")) for k, a in arrays.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("grid", F.col("i").cast("long").alias("i"), r6("y").alias("y"))


R.add(
    "fn_frequency_grids",
    _grids,
    "SELECT 'linspace' AS grid, i, round(i * 10.0 / 6, 6) + 0.0 AS y FROM range(7) t(i) UNION ALL SELECT 'fft', i, round(i * 44100.0 / 16, 6) + 0.0 FROM range(9) t(i) UNION ALL SELECT 'mel', i, round(700 * (10 ** (i * (2595 * log10(1 + 8000 / 700.0)) / 8 / 2595) - 1), 6) + 0.0 FROM range(9) t(i)",
)


# --- formats ----------------------------------------------------------------------------------------------

TO = {
    "u8": "CAST(round(CASE WHEN c < 0 THEN c * 128 ELSE c * 127 END) + 128 AS BIGINT)",
    "i16": "CAST(trunc(c * 32767) AS BIGINT)",
    "i24": "CAST(round(CASE WHEN c < 0 THEN c * 8388608 ELSE c * 8388607 END) AS BIGINT)",
    "i32": "CAST(trunc(c * 2147483647) AS BIGINT)",
}
BACK = {
    "u8": "CASE WHEN q < 128 THEN (q - 128) / 128.0::DOUBLE ELSE (q - 128) / 127.0::DOUBLE END",
    "i16": "CASE WHEN q < 0 THEN q / 32768.0::DOUBLE ELSE q / 32767.0::DOUBLE END",
    "i24": "CASE WHEN q < 0 THEN q / 8388608.0::DOUBLE ELSE q / 8388607.0::DOUBLE END",
    "i32": "CASE WHEN q < 0 THEN q / 2147483648.0::DOUBLE ELSE q / 2147483647.0::DOUBLE END",
}


def _format(name):
    def query(s, d):
        e = embedding_clips(s, d).select("clip_id", "idx", formats.convert(F.col("v") * 2.5, "f64", name).alias("q"))
        return e.select("clip_id", "idx", F.col("q").cast("long").alias("q"), r6(formats.convert(F.col("q"), name, "f64")).alias("v"))

    return query


for _name in TO:
    R.add(f"format_{_name}", _format(_name), f"WITH {EMB}, c AS (SELECT clip_id, idx, least(greatest(v * 2.5, -1), 1) AS c FROM emb), q AS (SELECT clip_id, idx, {TO[_name]} AS q FROM c) SELECT clip_id, idx, q, round({BACK[_name]}, 6) + 0.0 AS v FROM q")

R.add(
    "format_f32",
    lambda s, d: embedding_clips(s, d).select("clip_id", "idx", r6(formats.convert(F.col("v") / 3, "f64", "f32").cast("double")).alias("v")),
    f"WITH {EMB} SELECT clip_id, idx, round(CAST(CAST(v / 3 AS FLOAT) AS DOUBLE), 6) + 0.0 AS v FROM emb",
)


def _int_to_int(s, d):
    e = embedding_clips(s, d).select("clip_id", "idx", formats.convert(F.col("v"), "f64", "i16").alias("a"))
    up = formats.convert(F.col("a"), "i16", "i32")
    return e.select("clip_id", "idx", F.col("a").cast("long").alias("i16"), up.cast("long").alias("i32"), formats.convert(up, "i32", "i24").cast("long").alias("i24"))


R.add("format_int_shift", _int_to_int, f"WITH {EMB}, a AS (SELECT clip_id, idx, CAST(trunc(v * 32767) AS BIGINT) AS i16 FROM emb) SELECT clip_id, idx, i16, i16 * 65536 AS i32, i16 * 256 AS i24 FROM a")
R.add(
    "format_raw_cast",
    lambda s, d: event_clips(s, d).select("clip_id", "idx", *(formats.raw_cast((F.col("v") - 50) * 300, t).cast("long").alias(t) for t in ("u8", "i16", "i24", "i32"))),
    f"WITH {EV.replace('- 50.0', '- 0.0')}, x AS (SELECT clip_id, idx, trunc((v - 50) * 300) AS x FROM ev) SELECT clip_id, idx, CAST(least(greatest(x, 0), 255) AS BIGINT) AS u8, CAST(least(greatest(x, -32768), 32767) AS BIGINT) AS i16, CAST(CASE WHEN x BETWEEN -8388608 AND 8388607 THEN x ELSE -8388608 END AS BIGINT) AS i24, CAST(least(greatest(x, -2147483648), 2147483647) AS BIGINT) AS i32 FROM x",
)
R.add("layout_deinterleave", lambda s, d: rounded(formats.deinterleave(embedding_clips(s, d), 4), "v"), f"WITH {EMB} SELECT clip_id, CAST(idx % 4 AS INTEGER) AS ch, idx // 4 AS idx, round(v, 6) + 0.0 AS v FROM emb")
R.add("layout_interleave", lambda s, d: rounded(formats.interleave(formats.deinterleave(embedding_clips(s, d), 2), 2), "v"), f"WITH {EMB} SELECT clip_id, 0 AS ch, idx, round(v, 6) + 0.0 AS v FROM emb")
R.add(
    "layout_bytes",
    lambda s, d: formats.interleaved_bytes(formats.as_format(embedding_clips(s, d), "f64", "i16"), "i16").select("clip_id", F.hex("data").alias("hex")),
    f"WITH {EMB}, q AS (SELECT clip_id, idx, CAST(trunc(v * 32767) AS BIGINT) & 65535 AS q FROM emb) SELECT clip_id, string_agg(printf('%02X%02X', q & 255, q >> 8), '' ORDER BY idx) AS hex FROM q GROUP BY clip_id",
)

# --- generators -------------------------------------------------------------------------------------------

GEN = "SELECT 0::BIGINT AS clip_id, 0 AS ch, i AS idx, round(({v})::DOUBLE, 6) + 0.0 AS v FROM (SELECT i, i / 8000.0::DOUBLE AS t FROM range({n}) r(i))"
TAU = "2 * pi()"


def _generator(name, make, v, n=800):
    R.add(f"gen_{name}", lambda s, d: rounded(make(s), "v"), GEN.format(v=v, n=n))


_generator("sine_wave", lambda s: generate.sine_wave(s, 440, 0.1, 8000, 0.5), f"0.5 * sin({TAU} * 440 * t)")
_generator("cosine_wave", lambda s: generate.cosine_wave(s, 440, 0.1, 8000, 0.5), f"0.5 * cos({TAU} * 440 * t)")
_generator("square_wave", lambda s: generate.square_wave(s, 123, 0.1, 8000, 0.5), f"CASE WHEN sin({TAU} * 123 * t) >= 0 THEN 0.5 ELSE -0.5 END")
_generator("sawtooth_wave", lambda s: generate.sawtooth_wave(s, 437.3, 0.1, 8000, 0.5), "0.5 * (2 * ((437.3 * t - 1) - floor(437.3 * t - 1)) - 1)")
_generator("triangle_wave", lambda s: generate.triangle_wave(s, 437.3, 0.1, 8000, 0.5), "0.5 * CASE WHEN i * (437.3 / 8000) - floor(i * (437.3 / 8000)) < 0.5 THEN 4 * (i * (437.3 / 8000) - floor(i * (437.3 / 8000))) - 1 ELSE 3 - 4 * (i * (437.3 / 8000) - floor(i * (437.3 / 8000))) END")
_generator("chirp", lambda s: generate.chirp(s, 100, 900, 0.1, 8000), f"sin({TAU} * (100 * t + 8000 * t * t / 2))")
_generator("exponential_chirp", lambda s: generate.exponential_chirp(s, 100, 900, 0.1, 8000), f"sin({TAU} * 100 * (power(power(9.0::DOUBLE, 10), t) - 1) / ln(power(9.0::DOUBLE, 10)))")
_generator("fm_signal", lambda s: generate.fm_signal(s, 440, 5, 2, 0.1, 8000), f"sin({TAU} * 440 * t + 2 * sin({TAU} * 5 * t))")
_generator("am_signal", lambda s: generate.am_signal(s, 440, 5, 0.4, 0.1, 8000), f"((1 - 0.4) + 0.4 * sin({TAU} * 5 * t)) * sin({TAU} * 440 * t)")
_generator("impulse", lambda s: generate.impulse(s, 0.1, 8000, 0.7, 0.05), "CASE WHEN i = 400 THEN 0.7 ELSE 0 END")
_generator("compound_tone", lambda s: generate.compound_tone(s, [(440, 0.5), (880, 0.25)], 0.1, 8000), f"0.5 * sin({TAU} * 440 * t) + 0.25 * sin({TAU} * 880 * t)")
_generator("silence", lambda s: generate.silence(s, 0.1, 8000), "0.0")
_HARMONIC = "list_sum(list_transform(range(1, {top}, {step}), lambda k: {term}))"
_generator("square_bandlimited", lambda s: generate.square_wave_bandlimited(s, 437.3, 0.1, 8000), "4 / pi() * " + _HARMONIC.format(top=10, step=2, term=f"sin({TAU} * 437.3 * t * k) / k"))
_generator("sawtooth_bandlimited", lambda s: generate.sawtooth_wave_bandlimited(s, 437.3, 0.1, 8000), "2 / pi() * " + _HARMONIC.format(top=10, step=1, term=f"CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * sin({TAU} * 437.3 * t * k) / k"))
_generator("triangle_bandlimited", lambda s: generate.triangle_wave_bandlimited(s, 437.3, 0.1, 8000), "8 / (pi() * pi()) * " + _HARMONIC.format(top=10, step=2, term=f"CASE WHEN (k - 1) % 4 = 0 THEN 1 ELSE -1 END * sin({TAU} * 437.3 * t * k) / (k * k)"))


def _two(name, make, v):
    R.add(f"gen_{name}", lambda s, d: rounded(make(s), "v"), f"SELECT clip_id, c AS ch, idx, v FROM ({GEN.format(v=v, n=800)}), (SELECT 0 AS c UNION ALL SELECT 1)")


_two("stereo_sine_wave", lambda s: generate.stereo_sine_wave(s, 440, 0.1, 8000), f"sin({TAU} * 440 * t)")
_two("stereo_chirp", lambda s: generate.stereo_chirp(s, 100, 900, 0.1, 8000), f"sin({TAU} * (100 * t + 8000 * t * t / 2))")
_two("stereo_silence", lambda s: generate.stereo_silence(s, 0.1, 8000), "0.0")
_two("multichannel_compound_tone", lambda s: generate.multichannel_compound_tone(s, [(440, 0.5), (880, 0.25)], 0.1, 8000, 2), f"0.5 * sin({TAU} * 440 * t) + 0.25 * sin({TAU} * 880 * t)")


def _noise(make, bound):
    """Noise has no oracle by sample; its count and range have."""

    def query(s, d):
        return make(s).agg(F.count("*").alias("n"), (F.max(F.abs("v")) <= bound).alias("within"), (F.stddev_pop("v") > 0).alias("moves"))

    return query


for _name, _make, _bound in (
    ("white_noise", lambda s: generate.white_noise(s, 0.5, 8000, 0.5, 7), 0.5),
    ("pink_noise", lambda s: generate.pink_noise(s, 0.5, 8000, 0.5, 7), 1.0),
    ("brown_noise", lambda s: generate.brown_noise(s, 0.5, 8000, 0.02, 0.5, 7), 0.5),
    ("exponential_bursts", lambda s: generate.exponential_bursts(s, 10, 3, 0.5, 8000, 0.5, 7), 0.5),
):
    R.add(f"gen_{_name}", _noise(_make, _bound), "SELECT CAST(4000 AS BIGINT) AS n, true AS within, true AS moves")

U = draws.uniform_sql("7, i")
WHITE = f"(2 * {U} - 1)"
SAMPLE = "0::BIGINT AS clip_id, 0 AS ch, i AS idx"
R.add("gen_white_noise_samples", lambda s, d: rounded(generate.white_noise(s, 0.5, 8000, 0.5, 7), "v"), f"SELECT {SAMPLE}, round(0.5 * {WHITE}, 6) + 0.0 AS v FROM range(4000) r(i)")
R.add(
    "gen_exponential_bursts_samples",
    lambda s, d: rounded(generate.exponential_bursts(s, 10, 3, 0.5, 8000, 0.5, 7), "v"),
    f"WITH t AS (SELECT i, i / 8000.0::DOUBLE AS t, 10 * (i / 8000.0::DOUBLE) - floor(10 * (i / 8000.0::DOUBLE)) AS p FROM range(4000) r(i)) SELECT {SAMPLE}, round(CASE WHEN p < 0.1 THEN 0.5 * exp(-3 * p / 10) * (0.7 * {WHITE} + 0.3 * sin({TAU} * 200 * t)) ELSE 0 END, 6) + 0.0 AS v FROM t",
)
_POLES = list(zip(generate.PINK_POLES, generate.PINK_GAINS, strict=True))
R.add(
    "gen_pink_noise_samples",
    lambda s, d: rounded(generate.pink_noise(s, 0.05, 8000, 0.5, 7), "v"),
    f"WITH RECURSIVE x AS (SELECT CAST(i AS BIGINT) AS i, {WHITE} AS x FROM range(400) r(i)), p AS (SELECT i, x, 0.0::DOUBLE AS last, {', '.join(f'{g} * x AS b{k}' for k, (_, g) in enumerate(_POLES))} FROM x WHERE i = 0"
    f" UNION ALL SELECT x.i, x.x, p.x, {', '.join(f'{a} * b{k} + {g} * x.x' for k, (a, g) in enumerate(_POLES))} FROM p JOIN x ON x.i = p.i + 1)"
    f" SELECT {SAMPLE}, round(0.5 * {generate.PINK_SCALE} * ({generate.PINK_DIRECT} * x + {' + '.join(f'b{k}' for k in range(len(_POLES)))} + {generate.PINK_LAST} * last), 6) + 0.0 AS v FROM p",
)
R.add(
    "gen_brown_noise_samples",
    lambda s, d: rounded(generate.brown_noise(s, 0.05, 8000, 0.3, 0.5, 7), "v"),
    f"WITH RECURSIVE x AS (SELECT CAST(i AS BIGINT) AS i, {WHITE} AS x FROM range(400) r(i)), p AS (SELECT i, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 0.3 * x)) AS y FROM x WHERE i = 0"
    f" UNION ALL SELECT x.i, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, y + 0.3 * x.x)) FROM p JOIN x ON x.i = p.i + 1) SELECT {SAMPLE}, round(0.5 * y, 6) + 0.0 AS v FROM p",
)

R.add(
    "gen_builder",
    lambda s, d: rounded(generate.SampleBuilder(s, 8000).add(generate.sine_wave, 440, duration=0.01).add(generate.silence, duration=0.01).build(), "v"),
    f"SELECT 0::BIGINT AS clip_id, 0 AS ch, i AS idx, round(CASE WHEN i < 80 THEN sin({TAU} * 440 * (i / 8000.0::DOUBLE)) ELSE 0 END, 6) + 0.0 AS v FROM range(160) r(i)",
)

QUERIES, ORACLES = R.QUERIES, R.ORACLES
