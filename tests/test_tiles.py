"""Tiles of spectrograms, overlapped frames, suppression and vocoding against plain numpy, for tiles of any size."""

import numpy as np
import pytest

from ripplefield.operators import editing, hpss, peaks, spectral
from tests.test_chunks import check, clips, signals  # noqa: F401


def frames_of(x, n_fft, hop):
    padded = np.pad(x, n_fft // 2)
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    count = max(0, (len(padded) - n_fft) // hop + 1)
    return np.array([np.fft.rfft(padded[k * hop : k * hop + n_fft] * win) for k in range(count)]).reshape(count, n_fft // 2 + 1), win


def overlapped(s, win, hop):
    n_fft = len(win)
    out, weight = np.zeros((len(s) - 1) * hop + n_fft), np.zeros((len(s) - 1) * hop + n_fft)
    for k, f in enumerate(np.fft.irfft(s, n_fft, axis=1) * win):
        out[k * hop : k * hop + n_fft] += f
        weight[k * hop : k * hop + n_fft] += win**2
    return (out / np.where(weight > 1e-10, weight, 1))[n_fft // 2 : len(out) - n_fft // 2]


@pytest.mark.parametrize("block", [8, 20, 1 << 16])
def test_istft(clips, signals, block):  # noqa: F811
    spec = spectral.stft(clips, 16, 4, 64.0)
    check(spectral.istft(spec, 16, 4, block=block), {k: overlapped(*frames_of(x, 16, 4), 4) for k, x in signals.items()})


@pytest.mark.parametrize("tile", [1, 3, 1000])
@pytest.mark.parametrize("size", [5, 17])
def test_medians_of_tiles(clips, signals, tile, size):  # noqa: F811
    config = hpss.HpssConfig(16, 4, size, 4, 0.3)
    got = {(r.clip_id, r.frame, r.bin): (r.h, r.p) for r in hpss.separated(clips, config, 64.0, tile).collect()}
    for k, x in signals.items():
        m = np.abs(frames_of(x, 16, 4)[0])
        n = len(m)
        pad = (size // 2, size - 1 - size // 2)
        mode = "reflect" if n > max(pad) else "symmetric" if n > max(pad) - 1 else "edge"
        rows, columns = np.pad(m, (pad, (0, 0)), mode=mode), np.pad(m, ((0, 0), (2, 1)), mode="reflect")
        for f in range(n):
            for b in range(9):
                h, p = got.pop((k, f, b))
                assert abs(h - np.median(rows[f : f + size, b])) < 1e-9 and abs(p - np.median(columns[f, b : b + 4])) < 1e-9
    assert not got


def greedy(frames, strengths, apart):
    kept = []
    for i in np.lexsort((frames, -strengths)):
        if all(abs(frames[i] - frames[j]) >= apart for j in kept):
            kept.append(i)
    return sorted((int(frames[i]), float(strengths[i])) for i in kept)


@pytest.mark.parametrize("apart,tile", [(5, 4096), (5, 7), (40, 16), (1, 3), (0, 10)])
def test_suppression_equals_the_greedy_choice(spark, apart, tile):
    rng = np.random.default_rng(apart)
    series = {"rising": np.arange(300.0), "ties": np.ones(200), None: rng.integers(0, 9, 400).astype(float), "noise": rng.normal(size=500)}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "clip_id string, frame long, x double").repartition(4)
    got = {}
    for r in peaks.keep_apart(df, apart, tile).collect():
        got.setdefault(r.clip_id, []).append((r.frame, r.x))
    assert {k: sorted(v) for k, v in got.items()} == {k: greedy(np.arange(len(x)), x, apart) for k, x in series.items()}


def vocoder(x, ratio, n_fft, hop, formants):
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    padded = np.pad(x, (n_fft // 2, n_fft))
    bins = np.arange(n_fft // 2 + 1)
    expected = 2 * np.pi * hop * bins / n_fft
    target = np.round(bins * ratio).astype(int)
    inside = target < len(bins)
    last, total = np.zeros(len(bins)), np.zeros(len(bins))
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    for k in range(1 + (len(padded) - n_fft) // hop):
        s = np.fft.rfft(padded[k * hop : k * hop + n_fft] * win)
        mag, phase = np.abs(s), np.angle(s)
        drift = np.angle(np.exp(1j * (phase - last - expected)))
        last = phase
        moved, speed = np.zeros(len(bins)), np.zeros(len(bins))
        np.add.at(moved, target[inside], mag[inside])
        speed[target[inside]] = ((expected + drift) * ratio)[inside]
        if formants:
            moved = moved * editing.envelope_of(mag) / np.maximum(editing.envelope_of(moved), 1e-12)
        total = phase if k == 0 else total + speed
        out[k * hop : k * hop + n_fft] += np.fft.irfft(moved * np.exp(1j * total), n_fft) * win
        weight[k * hop : k * hop + n_fft] += win**2
    return (out / np.maximum(weight, 1e-9))[n_fft // 2 : n_fft // 2 + len(x)]


@pytest.mark.parametrize("semitones,formants,frames", [(2.0, False, 1), (-3.0, False, 9), (5.0, True, 300)])
def test_vocoder_over_chunks(clips, signals, semitones, formants, frames):  # noqa: F811
    want = {k: vocoder(x, 2 ** (semitones / 12), 32, 8, formants) for k, x in signals.items()}
    check(editing.pitch_shift(clips, semitones, 32, 8, formants, frames), want, tol=1e-6)
