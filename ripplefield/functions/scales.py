"""Scalar conversions between units, as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def col(x: Number) -> Column:
    """A number as a double column."""
    return x if isinstance(x, Column) else F.lit(float(x))


# Names of the twelve pitch classes, from C.
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
# Semitones of the natural notes above C.
NATURALS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
#: Level given to zero or negative amplitudes and powers.
SILENCE_DB = -80.0


def hz_to_mel(f: Number) -> Column:
    return F.lit(2595.0) * F.log10(1 + col(f) / 700.0)


def mel_to_hz(m: Number) -> Column:
    return F.lit(700.0) * (F.pow(F.lit(10.0), col(m) / 2595.0) - 1)


def hz_to_midi(f: Number) -> Column:
    return F.lit(12.0) * F.log2(col(f) / 440.0) + 69.0


def midi_to_hz(m: Number) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (col(m) - 69.0) / 12.0)


def amplitude_to_db(a: Number) -> Column:
    """20 log10 of an amplitude; ``SILENCE_DB`` at or below zero, and no other floor."""
    return F.when(col(a) <= 0, F.lit(SILENCE_DB)).otherwise(20 * F.log10(F.when(col(a) > 0, col(a))))


def db_to_amplitude(db: Number) -> Column:
    return F.pow(F.lit(10.0), col(db) / 20.0)


def power_to_db(p: Number) -> Column:
    """10 log10 of a power; ``SILENCE_DB`` at or below zero, and no other floor."""
    return F.when(col(p) <= 0, F.lit(SILENCE_DB)).otherwise(10 * F.log10(F.when(col(p) > 0, col(p))))


def db_to_power(db: Number) -> Column:
    return F.pow(F.lit(10.0), col(db) / 10.0)


def frames_to_time(frames: Number, sample_rate: Number, hop: Number) -> Column:
    return col(frames) * col(hop) / col(sample_rate)


def time_to_frames(t: Number, sample_rate: Number, hop: Number) -> Column:
    return F.round(col(t) * col(sample_rate) / col(hop)).cast("long")


def samples_to_time(n: Number, sample_rate: Number) -> Column:
    return col(n) / col(sample_rate)


def seconds_to_samples(t: Number, sample_rate: Number) -> Column:
    """Nearest sample, halves away from zero (editing truncates instead)."""
    return F.round(col(t) * col(sample_rate)).cast("long")


def ms_to_samples(ms: Number, sample_rate: Number) -> Column:
    return F.round(col(ms) * 0.001 * col(sample_rate)).cast("long")


def cents_to_ratio(c: Number) -> Column:
    return F.pow(F.lit(2.0), col(c) / 1200.0)


def ratio_to_cents(r: Number) -> Column:
    return F.lit(1200.0) * F.log2(col(r))


def note_to_midi(name: Column) -> Column:
    """MIDI number of a name such as ``A4``, ``C#3`` or ``Bb2``; others are an error (so ``C-1`` is)."""
    letter = F.regexp_extract(name, r"^([A-G])([#b]?)(\d)$", 1)
    accidental = F.regexp_extract(name, r"^([A-G])([#b]?)(\d)$", 2)
    octave = F.regexp_extract(name, r"^([A-G])([#b]?)(\d)$", 3)
    table = F.create_map(*(F.lit(x) for kv in NATURALS.items() for x in kv))
    shift = F.when(accidental == "#", 1).when(accidental == "b", -1).otherwise(0)
    midi = (octave.cast("int") + 1) * 12 + F.element_at(table, letter) + shift
    bad = F.raise_error(F.concat(F.lit("not a note: "), F.coalesce(name, F.lit("null")))).cast("int")
    return F.when((letter == "") | letter.isNull(), bad).otherwise(F.when(midi.between(0, 127), midi).otherwise(bad))


def midi_to_note(midi: Column) -> Column:
    """Sharp name and octave of a MIDI number 0..127."""
    names = F.array(*(F.lit(n) for n in NOTES))
    octave = F.floor(midi / 12) - 1
    bad = F.raise_error(F.lit("MIDI numbers are 0..127")).cast("string")
    return F.when(midi.between(0, 127), F.concat(F.get(names, F.pmod(midi.cast("int"), F.lit(12))), octave.cast("string"))).otherwise(bad)


def note_to_frequency(name: Column) -> Column:
    return midi_to_hz(note_to_midi(name).cast("double"))


def frequency_to_note(f: Column) -> Column:
    """Struct of the nearest note and the distance from it in cents."""
    midi = hz_to_midi(f)
    near = F.round(midi)
    return F.struct(midi_to_note(near.cast("int")).alias("note"), ((midi - near) * 100).alias("cents"))


def linspace(start: Number, stop: Number, num: int) -> Column:
    """Array of ``num`` evenly spaced numbers, both ends included; one number is the start."""
    if num < 1:
        raise ValueError("at least one number")
    step = (col(stop) - col(start)) / max(num - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda i: col(start) + i * step)


def fft_frequencies(n_fft: int, sample_rate: Number) -> Column:
    """Bin centres of a one-sided spectrum."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_fft // 2)), lambda i: i * col(sample_rate) / F.lit(float(n_fft)))


def mel_frequencies(n_mels: int, fmin: Number, fmax: Number) -> Column:
    """Frequencies that are evenly spaced in mel, both ends included."""
    return F.transform(linspace(hz_to_mel(fmin), hz_to_mel(fmax), n_mels), mel_to_hz)


mel_scale = mel_frequencies


# The rational Bark scale and its inverse, and the equivalent rectangular bandwidth.
def hz_to_bark(f: Number) -> Column:
    return F.greatest(26.81 * col(f) / (1960.0 + col(f)) - 0.53, F.lit(0.0))


def bark_to_hz(b: Number) -> Column:
    return 1960.0 * (col(b) + 0.53) / (26.28 - col(b))


def hz_to_erb(f: Number) -> Column:
    return 24.7 * (4.37 * col(f) / 1000.0 + 1.0)


def erb_to_hz(e: Number) -> Column:
    return (col(e) / 24.7 - 1.0) * 1000.0 / 4.37
