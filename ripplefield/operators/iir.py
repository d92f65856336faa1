"""Recursive filters: analog prototypes, transforms and sections on the driver, block kernels on the executors.

Designs are tiny and become literals of the kernel; only they live on the driver.  The high-pass corner is
the one asked for (the original mirrors it for most orders), and odd orders keep a first-order section.
"""

from __future__ import annotations

import cmath
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from ripplefield.operators import chunks
from ripplefield.operators.recurrence import cascade

FAMILIES = ("butterworth", "chebyshev1", "chebyshev2", "bessel", "elliptic")
RESPONSES = ("lowpass", "highpass", "bandpass", "bandstop")
MAX_ORDER = 12


def butterworth_prototype(order: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the low-pass with corner 1."""
    k = np.arange(order)
    return np.empty(0), np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)), 1.0


def chebyshev1_prototype(order: int, ripple_db: float):
    """Equal ripple in the pass band; even orders start at the foot of the ripple."""
    eps = math.sqrt(10 ** (ripple_db / 10) - 1)
    mu = math.asinh(1 / eps) / order
    theta = np.pi * (2 * np.arange(order) + 1) / (2 * order)
    poles = -np.sin(theta) * math.sinh(mu) + 1j * np.cos(theta) * math.cosh(mu)
    gain = np.prod(-poles).real
    return np.empty(0), poles, gain / math.sqrt(1 + eps * eps) if order % 2 == 0 else gain


def chebyshev2_prototype(order: int, stop_db: float):
    """Equal ripple in the stop band, which begins at 1."""
    eps = 1 / math.sqrt(10 ** (stop_db / 10) - 1)
    mu = math.asinh(1 / eps) / order
    theta = np.pi * (2 * np.arange(order) + 1) / (2 * order)
    poles = 1 / (-np.sin(theta) * math.sinh(mu) + 1j * np.cos(theta) * math.cosh(mu))
    zeros = np.array([1j / math.cos(t) for t in theta if abs(math.cos(t)) > 1e-12])
    return zeros, poles, (np.prod(-poles) / np.prod(-zeros)).real


def bessel_prototype(order: int):
    """Maximally flat delay, scaled to -3 dB at 1: roots of the reverse Bessel polynomial."""
    c = [math.factorial(2 * order - k) / (2 ** (order - k) * math.factorial(k) * math.factorial(order - k)) for k in range(order + 1)]
    poles = np.roots(c[::-1])

    def level(w: float) -> float:
        return abs(np.prod(-poles) / np.prod(1j * w - poles))

    a, b = 0.0, 10.0 * order
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if level(m) > math.sqrt(0.5) else (a, m)
    poles = poles / a
    return np.empty(0), poles, np.prod(-poles).real


def _landen(k: float) -> list[float]:
    """Descending moduli of the Landen transformation."""
    out = []
    while k > 1e-15 and len(out) < 12:
        k = (k / (1 + math.sqrt(1 - k * k))) ** 2
        out.append(k)
    return out


def _cd(u: complex, moduli: list[float]) -> complex:
    w = cmath.cos(u * math.pi / 2)
    for v in reversed(moduli):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _sn(u: complex, moduli: list[float]) -> complex:
    w = cmath.sin(u * math.pi / 2)
    for v in reversed(moduli):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _asn(w: complex, k: float, moduli: list[float]) -> complex:
    v = k
    for nxt in moduli:
        w = 2 * w / ((1 + nxt) * (1 + cmath.sqrt(1 - (v * w) ** 2)))
        v = nxt
    return 2 / math.pi * cmath.asin(w)


def elliptic_prototype(order: int, ripple_db: float, stop_db: float):
    """Equal ripple in both bands, by Landen's transformation of Jacobi's functions."""
    ep, es = math.sqrt(10 ** (ripple_db / 10) - 1), math.sqrt(10 ** (stop_db / 10) - 1)
    if order == 1:
        p = np.array([-1 / ep + 0j])
        return np.empty(0), p, 1 / ep
    k1 = ep / es
    k1c = math.sqrt(1 - k1 * k1)
    half = order // 2
    u = [(2 * i - 1) / order for i in range(1, half + 1)]
    down = _landen(k1c)
    kc = k1c**order * np.prod([_sn(x, down).real for x in u]) ** 4
    k = math.sqrt(1 - kc * kc)
    moduli = _landen(k)
    zeros = np.array([1j / (k * _cd(x, moduli).real) for x in u])
    v0 = -1j * _asn(1j / ep, k1, _landen(k1)) / order
    poles = [1j * _cd(x - 1j * v0, moduli) for x in u]
    poles = np.r_[poles, np.conj(poles)]
    if order % 2:
        poles = np.r_[poles, 1j * _sn(1j * v0, moduli)]
    zeros = np.r_[zeros, np.conj(zeros)]
    gain = (np.prod(-poles) / np.prod(-zeros)).real
    return zeros, poles, gain if order % 2 else gain / math.sqrt(1 + ep * ep)


def prewarp(f: float, sample_rate: float) -> float:
    """Analog frequency that the bilinear transform maps to ``f``."""
    return 2 * sample_rate * math.tan(math.pi * f / sample_rate)


def lp_to_lp(zpk, w: float):
    z, p, k = zpk
    return z * w, p * w, k * w ** (len(p) - len(z))


def lp_to_hp(zpk, w: float):
    z, p, k = zpk
    gain = (np.prod(-z) / np.prod(-p)).real if len(z) else (1 / np.prod(-p)).real
    return np.r_[w / z, np.zeros(len(p) - len(z))], w / p, k * gain


def lp_to_bp(zpk, w: float, width: float):
    z, p, k = zpk
    both = lambda r: np.r_[(h := r * width / 2 + 0j) + np.sqrt(h * h - w * w), h - np.sqrt(h * h - w * w)]
    return np.r_[both(z), np.zeros(len(p) - len(z))], both(p), k * width ** (len(p) - len(z))


def lp_to_bs(zpk, w: float, width: float):
    z, p, k = zpk
    both = lambda r: np.r_[(h := width / 2 / (r + 0j)) + np.sqrt(h * h - w * w), h - np.sqrt(h * h - w * w)]
    more = len(p) - len(z)
    gain = (np.prod(-z) / np.prod(-p)).real if len(z) else (1 / np.prod(-p)).real
    return np.r_[both(z), np.full(more, 1j * w), np.full(more, -1j * w)], both(p), k * gain


def bilinear(zpk, sample_rate: float):
    """To the z-plane; missing zeros go to the highest frequency."""
    z, p, k = zpk
    c = 2 * sample_rate
    move = lambda r: (c + r) / (c - r)
    gain = (np.prod(c - z) / np.prod(c - p)).real
    return np.r_[move(z), -np.ones(len(p) - len(z))], move(p), k * gain


def _pairs(roots: np.ndarray) -> list[tuple[complex, ...]]:
    """Conjugates together, then reals two by two, nearest to the unit circle first."""
    roots = np.asarray(roots, complex)
    upper = [r for r in roots if r.imag > 1e-9 * max(1, abs(r))]
    reals = sorted((r.real for r in roots if abs(r.imag) <= 1e-9 * max(1, abs(r))), key=lambda r: -abs(r))
    out = [(r, r.conjugate()) for r in sorted(upper, key=lambda r: -abs(r))]
    return out + [tuple(complex(r) for r in reals[i : i + 2]) for i in range(0, len(reals), 2)]


def to_sections(zpk) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a0, a1, a2); each pole pair takes the nearest zeros."""
    z, p, k = zpk
    zeros, out = _pairs(z), []
    for pair in _pairs(p):
        near = min(zeros, key=lambda q: abs(q[0] - pair[0]) + 10 * (len(q) != len(pair))) if zeros else ()
        if zeros:
            zeros.remove(near)
        b, a = (np.poly(near).real if near else np.ones(1)), np.poly(pair).real
        out.append(np.r_[b, np.zeros(3 - len(b)), a, np.zeros(3 - len(a))])
    sections = np.array(out[::-1])
    sections[0, :3] *= k
    return sections


def design(family: str, response: str, order: int, corner: float | tuple[float, float], sample_rate: float, ripple_db: float = 1.0, stop_db: float = 40.0) -> np.ndarray:
    """Sections of a filter.

    ``corner`` is a frequency, or two for band responses.  Orders are 1..12, ripple (0, 5] dB, stop band
    (0, 200] dB; corners of the rippled families lie below 0.95 of half the rate.
    """
    if family not in FAMILIES or response not in RESPONSES:
        raise ValueError(f"family is one of {FAMILIES}, response one of {RESPONSES}")
    if not 1 <= order <= MAX_ORDER:
        raise ValueError(f"orders are 1..{MAX_ORDER}")
    edges = (corner,) if isinstance(corner, (int, float)) else tuple(corner)
    top = sample_rate / 2 * (1.0 if family in ("butterworth", "bessel") else 0.95)
    if len(edges) != (2 if response.startswith("band") else 1) or not all(0 < f < top for f in edges) or (len(edges) == 2 and edges[0] >= edges[1]):
        raise ValueError("corners must be ordered and lie below half the rate")
    if family in ("chebyshev1", "elliptic") and not 0 < ripple_db <= 5:
        raise ValueError("the ripple lies in (0, 5] dB")
    if family in ("chebyshev2", "elliptic") and not 0 < stop_db <= 200:
        raise ValueError("the stop band lies in (0, 200] dB")
    zpk = {
        "butterworth": lambda: butterworth_prototype(order),
        "chebyshev1": lambda: chebyshev1_prototype(order, ripple_db),
        "chebyshev2": lambda: chebyshev2_prototype(order, stop_db),
        "bessel": lambda: bessel_prototype(order),
        "elliptic": lambda: elliptic_prototype(order, ripple_db, stop_db),
    }[family]()
    w = [prewarp(f, sample_rate) for f in edges]
    if response == "lowpass":
        zpk = lp_to_lp(zpk, w[0])
    elif response == "highpass":
        zpk = lp_to_hp(zpk, w[0])
    else:
        zpk = (lp_to_bp if response == "bandpass" else lp_to_bs)(zpk, math.sqrt(w[0] * w[1]), w[1] - w[0])
    return to_sections(bilinear(zpk, sample_rate))


def frequency_response(sections: np.ndarray, frequencies: Sequence[float], sample_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude and phase of sections at frequencies."""
    z = np.exp(-2j * np.pi * np.asarray(frequencies, float) / sample_rate)
    h = np.ones(len(z), complex)
    for s in sections:
        h *= (s[0] + s[1] * z + s[2] * z * z) / (s[3] + s[4] * z + s[5] * z * z)
    return np.abs(h), np.angle(h)


def apply_sections(df: DataFrame, sections: np.ndarray) -> DataFrame:
    """Filter every channel from rest, over chunks."""
    return chunks.recursive_filter(df, sections)


def apply_iir_filter(df: DataFrame, family: str, response: str, order: int, corner, sample_rate: float, **options) -> DataFrame:
    return apply_sections(df, design(family, response, order, corner, sample_rate, **options))


def filtfilt(df: DataFrame, family: str, response: str, order: int, corner, sample_rate: float, **options) -> DataFrame:
    """Zero-phase filter of every channel: forward and backward from rest over an odd extension of six samples a section."""
    sections = design(family, response, order, corner, sample_rate, **options)
    return chunks.zero_phase(df, sections, 6 * len(sections))


def butterworth_lowpass(df, order, corner, sample_rate):
    return apply_iir_filter(df, "butterworth", "lowpass", order, corner, sample_rate)


def butterworth_highpass(df, order, corner, sample_rate):
    return apply_iir_filter(df, "butterworth", "highpass", order, corner, sample_rate)


def butterworth_bandpass(df, order, low, high, sample_rate):
    return apply_iir_filter(df, "butterworth", "bandpass", order, (low, high), sample_rate)


def chebyshev_i(df, order, corner, ripple_db, response, sample_rate):
    return apply_iir_filter(df, "chebyshev1", response, order, corner, sample_rate, ripple_db=ripple_db)


class BlockFilter:
    """Sections with state, for blocks in order."""

    def __init__(self, sections: np.ndarray):
        self.sections, self.states = np.asarray(sections, float), None

    def process(self, block: np.ndarray) -> np.ndarray:
        """Filter the next block."""
        y, self.states = cascade(np.asarray(block, float), self.sections, self.states)
        return y

    def reset(self) -> None:
        self.states = None
