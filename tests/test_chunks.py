"""Operators over chunks against one pass over the whole channel, for chunks of any size."""

import numpy as np
import pytest

from ripplefield.operators import chunks, dynamics, elementwise, envelopes, iir, resampling
from ripplefield.operators.recurrence import cascade

LENGTHS = {"a": 1, "b": 7, None: 20, "d": 64, "e": 233}
SECTIONS = iir.design("butterworth", "lowpass", 3, 10.0, 64.0)


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(5)
    return {k: rng.normal(size=n) for k, n in LENGTHS.items()}


@pytest.fixture(scope="module")
def clips(spark, signals):
    rows = [(k, 0, i, float(v), "extra") for k, x in signals.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "clip_id string, ch int, idx long, v double, note string").repartition(5).cache()


def by_clip(df, *cols):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.idx):
        out.setdefault(r.clip_id, []).append(tuple(r[c] for c in ("idx", *cols)))
    return out


def check(df, want, tol=1e-9, cols=("v",)):
    got = by_clip(df, *cols)
    assert set(got) == {k for k, x in want.items() if len(x)}
    for k, rows in got.items():
        expected = np.reshape(np.array(want[k], float).T if len(cols) > 1 else want[k], (len(rows), len(cols)))
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert np.allclose([r[1:] for r in rows], expected, atol=tol)


@pytest.mark.parametrize("chunk", [1, 7, 10, 1000])
def test_recursive_filter(clips, signals, chunk):
    check(chunks.recursive_filter(clips, SECTIONS, chunk), {k: cascade(x, SECTIONS)[0] for k, x in signals.items()})


def filtfilt(x, sections):
    n = min(6 * len(sections), len(x) - 1)
    if n > 0:
        x = np.r_[2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]
    y = cascade(cascade(x, sections)[0][::-1], sections)[0][::-1]
    return y[n : len(y) - n]


@pytest.mark.parametrize("chunk", [3, 7, 10, 1000])
def test_zero_phase(clips, signals, chunk):
    check(chunks.zero_phase(clips, SECTIONS, 6 * len(SECTIONS), chunk), {k: filtfilt(x, SECTIONS) for k, x in signals.items()})


@pytest.mark.parametrize("method", dynamics.DETECTORS)
@pytest.mark.parametrize("chunk", [1, 7, 10, 1000])
def test_follower(clips, signals, chunk, method):
    rate = 1200.0  # an RMS window of 12 samples
    want = {}
    for k, x in signals.items():
        d = [np.sqrt(np.mean(x[max(0, i - 11) : i + 1] ** 2)) for i in range(len(x))] if method != "peak" else np.abs(x)
        d = np.maximum(d, np.abs(x)) if method == "hybrid" else d
        e, last, out = 0.0, 0.0, []
        for v in d:
            c = np.exp(-1 / ((2 if v > last else 9) / 1000 * rate))
            e, last = c * e + (1 - c) * v, v
            out.append(e)
        want[k] = out
    check(dynamics.envelope(clips, rate, 2, 9, method, chunk), want)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_attack_decay(clips, signals, chunk):
    want = {}
    for k, x in signals.items():
        e = dynamics.follow(x, 64.0, 20, 100)
        attack, decay, out = 0.0, 0.0, []
        for before, v in zip(np.r_[0.0, e], e):
            attack, decay = (v, decay) if v > before else (attack, v)
            out.append((attack, decay))
        want[k] = np.array(out).T
    check(envelopes.attack_decay_envelope(clips, 64.0, 20, 100, chunk=chunk), want, cols=("attack", "decay"))


def test_one_pole_filters(clips, signals):
    low, high = {}, {}
    a, r = 2 * np.pi * 5 / 64, (1 / (2 * np.pi * 5)) / (1 / (2 * np.pi * 5) + 1 / 64)
    for k, x in signals.items():
        y, z = [x[0]], [0.0]
        for i in range(1, len(x)):
            y.append(a * x[i] + (1 - a) * y[-1])
            z.append(r * (z[-1] + x[i] - x[i - 1]))
        low[k], high[k] = y, z
    check(elementwise.low_pass(clips, 5, 64), low)
    check(elementwise.high_pass(clips, 5, 64), high)


@pytest.mark.parametrize("fan", [1, 3, 100])
def test_maps_compose_in_a_tree(spark, fan):
    rng = np.random.default_rng(1)
    maps = {k: rng.normal(size=(n, 6)) for k, n in (("x", 1), ("y", 11))}
    rows = [((k, 0), j + 4, m.tolist()) for k, x in maps.items() for j, m in enumerate(x)]
    df = spark.createDataFrame(rows, "key struct<clip_id:string,ch:int>, chunk long, m array<double>")
    got = {(r.key.clip_id, r.chunk): r.z for r in chunks.prefix_states(df, 2, fan).collect()}
    assert len(got) == 12
    for k, x in maps.items():
        z = np.zeros(2)
        for j, m in enumerate(x):
            z = m[:4].reshape(2, 2) @ z + m[4:]
            assert np.allclose(got[k, j + 5], z)


def test_no_list_by_channel(clips):
    for df in (dynamics.envelope(clips, 64.0, 20, 100), elementwise.low_pass(clips, 5, 64), chunks.zero_phase(clips, SECTIONS, 12)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        gathers = [line for line in plan.splitlines() if "Aggregate [" in line and "collect_list" in line]
        assert gathers and all("chunk" in g.split("]")[0] or "m#" in g for g in gathers)  # samples by chunk; by channel only maps


@pytest.mark.parametrize("chunk", [7, 40, 1000])
@pytest.mark.parametrize("source,target,quality", [(64, 48, "medium"), (44100, 48000, "high"), (3, 1, "medium")])
def test_sinc_resampling(clips, signals, chunk, source, target, quality):
    q, want = resampling.QUALITIES[quality], {}
    half = int(np.ceil(q.taps / 2 / min(1, target / source)))
    scale = min(1, target / source) * q.cutoff
    for k, x in signals.items():
        out = []
        for i in range(-(-len(x) * target // source)):
            base, total = i * source // target, 0.0
            for j in range(max(0, base - half + 1), min(len(x), base + half + 1)):
                d = i * source / target - j
                u = 0.5 + d / (2 * half)
                w = 0.5 - 0.5 * np.cos(2 * np.pi * u) if q.window == "hann" else 0.42 - 0.5 * np.cos(2 * np.pi * u) + 0.08 * np.cos(4 * np.pi * u)
                total += x[j] * scale * np.sinc(scale * d) * w
            out.append(total)
        want[k] = out
    check(resampling.resample_sinc(clips, source, target, q, chunk), want)
