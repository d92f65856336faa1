"""Numpy kernels of linear recurrences, evaluated in blocks.

A second-order section is an affine map from (state, block) to (block, state).  Its matrices for a block
of ``BLOCK`` samples are made once; per block only a 2-vector is carried in order, the rest is one matrix
product over all blocks.
"""

from __future__ import annotations

import functools

import numpy as np

BLOCK = 64


@functools.lru_cache(maxsize=256)
def _matrices(b: tuple[float, float, float], a: tuple[float, float, float]):
    """Block response, response to the state, state from the block, and the state's own step."""
    b0, b1, b2 = (x / a[0] for x in b)
    a1, a2 = a[1] / a[0], a[2] / a[0]
    step = np.array([[-a1, 1.0], [-a2, 0.0]])  # transposed direct form II
    gain = np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    impulse = np.array([b0] + [(powers[k] @ gain)[0] for k in range(BLOCK - 1)])
    index = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    response = np.where(index >= 0, impulse[np.maximum(index, 0)], 0.0)
    from_state = np.array([powers[k][0] for k in range(BLOCK)])
    to_state = np.array([powers[BLOCK - 1 - k] @ gain for k in range(BLOCK)]).T
    return response, from_state, to_state, powers[BLOCK], step, gain, b0


def biquad(x: np.ndarray, b: tuple, a: tuple, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filter by one section; returns the output and the state after it, so that blocks can follow."""
    response, from_state, to_state, jump, step, gain, b0 = _matrices(tuple(map(float, b)), tuple(map(float, a)))
    z = np.zeros(2) if state is None else np.array(state, float)
    whole = len(x) // BLOCK * BLOCK
    out = np.empty(len(x))
    if whole:
        blocks = np.asarray(x[:whole], float).reshape(-1, BLOCK)
        drive = blocks @ to_state.T
        states = np.empty((len(blocks), 2))
        for k, d in enumerate(drive):
            states[k] = z
            z = jump @ z + d
        out[:whole] = (blocks @ response.T + states @ from_state.T).ravel()
    if whole < len(x):  # plain numbers: small matrix products cost more than their arithmetic
        (s00, s01), (s10, s11) = step.tolist()
        (z0, z1), (g0, g1) = z.tolist(), gain.tolist()
        rest = []
        for v in np.asarray(x[whole:], float).tolist():
            rest.append(b0 * v + z0)
            z0, z1 = s00 * z0 + s01 * z1 + g0 * v, s10 * z0 + s11 * z1 + g1 * v
        out[whole:] = rest
        z = np.array([z0, z1])
    return out, z


def cascade(x: np.ndarray, sections: np.ndarray, states: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filter by sections (b0, b1, b2, a0, a1, a2) one after the other."""
    after = np.zeros((len(sections), 2))
    for k, s in enumerate(sections):
        x, after[k] = biquad(x, tuple(s[:3]), tuple(s[3:]), None if states is None else states[k])
    return np.asarray(x, float), after


def one_pole(x: np.ndarray, pole: float) -> np.ndarray:
    """y[n] = x[n] + pole * y[n-1]."""
    return biquad(x, (1.0, 0.0, 0.0), (1.0, -pole, 0.0))[0]


def varying_one_pole(c: np.ndarray, b: np.ndarray, start: float = 0.0) -> np.ndarray:
    """``y[i] = c[i] y[i-1] + b[i]`` for coefficients that vary by sample.

    Blocks of about the root of the length run side by side from rest, next to the products of their
    coefficients; then only the block ends are carried in order.
    """
    n = len(b)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width) if n else 0
    cc, bb = np.ones(rows * width), np.zeros(rows * width)
    cc[:n], bb[:n] = c, b
    cc, bb = cc.reshape(rows, width), bb.reshape(rows, width)
    rest, gain = np.empty_like(bb), np.empty_like(cc)
    y, p = np.zeros(rows), np.ones(rows)
    for k in range(width if rows else 0):
        y, p = cc[:, k] * y + bb[:, k], p * cc[:, k]
        rest[:, k], gain[:, k] = y, p
    ends = np.empty(rows)
    for r in range(rows):
        ends[r], start = start, gain[r, -1] * start + rest[r, -1]
    return (rest + gain * ends[:, None]).ravel()[:n]
