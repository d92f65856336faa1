"""Psychoacoustics: band layouts as small tables, thresholds and masking as expressions over bands."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Edges in Hz of the 21 bands of the low-delay layout.
LOW_DELAY_EDGES = (0, 200, 400, 600, 800, 1000, 1200, 1400, 1600, 2000, 2400, 2800, 3200, 4000, 4800, 5600, 6800, 8000, 9600, 12000, 15600, 20000)
# dB by which a band masks itself, and the prominence that makes a band tonal.
SELF_MASKING_DB, TONAL_DB = 0.5, 7.0


@dataclass(frozen=True)
class Masking:
    """Gains and slopes of the spreading function, in dB and dB per Bark."""

    floor_db: float = -60.0
    tonal_gain: float = 14.5
    noise_gain: float = 5.5
    up: float = 25.0
    down: float = 6.0
    eps: float = 1e-10


PRESETS = {"mpeg1": Masking(), "conservative": Masking(-80, 10, 3, 20, 4), "aggressive": Masking(-40, 18, 7, 30, 8)}

_SCALES = {
    "bark": (lambda f: np.maximum(26.81 * f / (1960 + f) - 0.53, 0), lambda b: 1960 * (b + 0.53) / (26.28 - b)),
    "mel": (lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)),
    "erb": (lambda f: 24.7 * (4.37 * f / 1000 + 1), lambda e: (e / 24.7 - 1) * 1000 / 4.37),
}


def _bin(f, sample_rate: float, n_bins: int):
    return np.clip(np.floor(np.asarray(f) / (sample_rate / 2) * (n_bins - 1) + 0.5).astype(int), 0, n_bins - 1)


def band_layout(kind: str, n_bands: int, sample_rate: float, n_bins: int) -> list[tuple[int, int, int, float, float]]:
    """(band, first bin, past-the-last bin, centre in Hz, position in 0..1) of each band; bands are never empty."""
    if kind == "celt":
        edges = np.array([e for e in LOW_DELAY_EDGES if e < sample_rate / 2] + [sample_rate / 2])[: len(LOW_DELAY_EDGES)].astype(float)
        edges = np.minimum(edges, sample_rate / 2)
        lo, hi = edges[:-1], edges[1:]
        centres, place = (lo + hi) / 2, np.arange(len(lo)) / (len(LOW_DELAY_EDGES) - 2)
    elif kind in _SCALES:
        fwd, inv = _SCALES[kind]
        a, b = fwd(np.float64(0)), fwd(np.float64(sample_rate / 2))
        grid = np.linspace(a, b, n_bands + 1)
        lo, hi, mid = inv(grid[:-1]), inv(grid[1:]), (grid[:-1] + grid[1:]) / 2
        centres, place = inv(mid), mid / b
    else:
        raise ValueError("layout must be bark, mel, erb or celt")
    start = _bin(lo, sample_rate, n_bins)
    end = np.minimum(np.maximum(_bin(hi, sample_rate, n_bins), start + 1), n_bins)
    return [(k, int(s), int(e), float(c), float(p)) for k, (s, e, c, p) in enumerate(zip(start, end, centres, place, strict=True))]


def layout_table(spark, layout) -> DataFrame:
    return spark.createDataFrame(layout, "band int, start_bin int, end_bin int, centre_hz double, position double")


def scale_layout(layout, from_bins: int, to_bins: int):
    """The same bands over another number of bins."""
    out = []
    for k, s, e, c, p in layout:
        a = min(int(s * to_bins / from_bins), to_bins - 1)
        out.append((k, a, min(max(round(e * to_bins / from_bins), a + 1), to_bins), c, p))
    return out


def hearing_threshold(f: Column) -> Column:
    """Threshold of hearing in quiet in dB, held in [-20, 60]."""
    k = f / 1000.0
    t = 3.64 * F.pow(F.when(f > 0, k), F.lit(-0.8)) - 6.5 * F.exp(-0.6 * (k - 3.3) * (k - 3.3)) + 1e-3 * F.pow(k, F.lit(4.0))
    return F.when(f <= 0, F.lit(60.0)).otherwise(F.greatest(F.least(t, F.lit(60.0)), F.lit(-20.0)))


def spreading(masker: Column, maskee: Column, tonal: Column, c: Masking) -> Column:
    """Attenuation in dB from one Bark place to another."""
    dz = maskee - masker
    return F.when(tonal, F.lit(c.tonal_gain)).otherwise(F.lit(c.noise_gain)) + F.when(dz >= 0, c.up * dz).otherwise(-c.down * dz)


def signal_to_mask(energy_db: Column, threshold_db: Column) -> Column:
    return energy_db - threshold_db


def band_energies(power: DataFrame, layout, c: Masking = Masking()) -> DataFrame:
    """``(clip_id, frame, band, centre_hz, energy_db)``: mean bin power of each band in dB, over ``(clip_id, frame, bin, power)``."""
    table = layout_table(power.sparkSession, layout)  # a few dozen rows
    bins = table.withColumn("bin", F.explode(F.sequence("start_bin", F.col("end_bin") - 1)))
    g = power.join(F.broadcast(bins), "bin").groupBy("clip_id", "frame", "band", "centre_hz").agg(F.sum("power").alias("p"), F.max(F.col("end_bin") - F.col("start_bin")).alias("w"))
    return g.select("clip_id", "frame", "band", "centre_hz", (10 * F.log10(F.col("p") / F.col("w") + c.eps)).alias("energy_db"))


def tonal_bands(energies: DataFrame) -> DataFrame:
    """Adds ``tonal``: the band stands out of its neighbours' mean."""
    w = Window.partitionBy("clip_id", "frame").orderBy("band")
    left, right = F.lag("energy_db").over(w), F.lead("energy_db").over(w)
    near = F.coalesce((left + right) / 2, left, right, F.col("energy_db"))
    return energies.withColumn("tonal", F.col("energy_db") - near >= TONAL_DB)


def band_metrics(power: DataFrame, layout, c: Masking = Masking()) -> DataFrame:
    """Energy, masking threshold, signal-to-mask ratio and importance of each band of each frame.

    Bands of a frame meet as one array, so the masking is a maximum over a few dozen entries in the row.
    """
    from ripplefield.functions.scales import hz_to_bark

    e = tonal_bands(band_energies(power, layout, c)).withColumn("z", hz_to_bark(F.col("centre_hz")))
    rows = e.groupBy("clip_id", "frame").agg(F.sort_array(F.collect_list(F.struct("band", "centre_hz", "energy_db", "tonal", "z"))).alias("b"))
    one = rows.select("clip_id", "frame", "b", F.explode("b").alias("j"))

    def from_band(i: Column) -> Column:
        own = i["band"] == F.col("j.band")
        return i["energy_db"] - F.when(own, F.lit(SELF_MASKING_DB)).otherwise(spreading(i["z"], F.col("j.z"), i["tonal"], c))

    threshold = F.greatest(F.array_max(F.transform("b", from_band)), hearing_threshold(F.col("j.centre_hz")))
    out = one.select("clip_id", "frame", F.col("j.band").alias("band"), F.col("j.energy_db").alias("energy_db"), threshold.alias("threshold_db"))
    smr = signal_to_mask(F.col("energy_db"), F.col("threshold_db"))
    return out.select("*", smr.alias("smr_db"), F.greatest(smr, F.lit(0.0)).alias("importance"))


def temporal_masking(metrics: DataFrame, hop_ms: float, post_db_per_ms: float, pre_db_per_ms: float, reach: int = 16) -> DataFrame:
    """Thresholds raised by earlier and later frames, decaying with their distance, within ``reach`` frames."""
    w = Window.partitionBy("clip_id", "band").orderBy("frame")
    at = F.col("threshold_db")
    terms = [at] + [F.lag("threshold_db", k).over(w) - post_db_per_ms * k * hop_ms for k in range(1, reach + 1)] + [F.lead("threshold_db", k).over(w) - pre_db_per_ms * k * hop_ms for k in range(1, reach + 1)]
    raised = metrics.withColumn("threshold_db", F.greatest(*terms))
    smr = signal_to_mask(F.col("energy_db"), F.col("threshold_db"))
    return raised.withColumns({"smr_db": smr, "importance": F.greatest(smr, F.lit(0.0))})


def transient_windows(df: DataFrame, size: int, hop: int, ratio: float) -> DataFrame:
    """Frames whose energy exceeds the one before by a ratio (and that one is not silent)."""
    from ripplefield.operators.frames import frame_aggregate

    e = frame_aggregate(df, size, hop, "none", energy=F.sum(F.col("v") * F.col("v")))
    prev = F.lag("energy").over(Window.partitionBy("clip_id", "ch").orderBy("frame"))
    return e.select("clip_id", "ch", "frame", F.coalesce((prev > 1e-10) & (F.col("energy") > prev * ratio), F.lit(False)).alias("transient"))
