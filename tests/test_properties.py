"""Properties of the numpy kernels, on arbitrary signals."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplefield.operators import codec, dynamics, envelopes, iir, pitch, recurrence

signals = st.lists(st.floats(-1, 1, allow_nan=False, width=32), min_size=1, max_size=300).map(np.array)
FAST = settings(max_examples=40, deadline=None)


@FAST
@given(signals, st.integers(1, 64))
def test_lapped_transform_is_invertible(x, half):
    assert np.allclose(codec.imdct(codec.mdct(x, half), half, len(x)), x, atol=1e-9)


@FAST
@given(signals, st.integers(1, 4), st.floats(100, 3000))
def test_filters_are_stable_and_linear(x, order, corner):
    s = iir.design("butterworth", "lowpass", order, corner, 8000)
    y = recurrence.cascade(x, s)[0]
    assert np.isfinite(y).all() and np.abs(y).max() < 20
    assert np.allclose(recurrence.cascade(2 * x, s)[0], 2 * y, atol=1e-9)


@FAST
@given(signals, st.integers(0, 300))
def test_blocks_equal_the_whole(x, cut):
    s = iir.design("chebyshev1", "highpass", 3, 500.0, 8000)
    whole = recurrence.cascade(x, s)[0]
    head, state = recurrence.cascade(x[:cut], s)
    tail, _ = recurrence.cascade(x[cut:], s, state)
    assert np.allclose(np.r_[head, tail], whole, atol=1e-9)


@FAST
@given(signals)
def test_prediction_is_invertible(x):
    a = codec.lpc_analysis(x, 8)
    assert np.allclose(codec.lpc_synthesis(codec.lpc_residual(x, a), a), x, atol=1e-6)


@FAST
@given(signals)
def test_followers_stay_within_the_peak(x):
    e = dynamics.follow(x, 8000, 1, 20)
    assert (e >= 0).all() and e.max() <= np.abs(x).max() + 1e-12


@FAST
@given(signals)
def test_quadrature_of_the_quadrature(x):
    centred = x - x.mean()
    if len(x) % 2 == 0:
        centred = centred - (centred * (-1.0) ** np.arange(len(x))).mean() * (-1.0) ** np.arange(len(x))
    assert np.allclose(envelopes.hilbert(envelopes.hilbert(centred)), -centred, atol=1e-9)


@FAST
@given(st.integers(10, 60))
def test_periods_are_found(period):
    x = np.sin(2 * np.pi * np.arange(1200) / period)
    assert pitch.yin(x, 8, 100, 0.1) % period in (0, 1, period - 1)
