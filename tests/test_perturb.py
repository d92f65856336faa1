"""The samples of the perturbation queries against numpy."""

import numpy as np

from ripplefield.plans import registry
from ripplefield.sources.tables import embedding_clips
from tests.test_tiles import vocoder


def arrays(df):
    rows = sorted((r.clip_id, r.idx, r.v) for r in df.select("clip_id", "idx", "v").collect())
    return np.array([r[2] for r in rows]).reshape(-1, 64)


def test_perturbed_samples(spark, sf):
    x = arrays(embedding_clips(spark, sf))
    noise, gain, pitch = (arrays(registry.queries()[f"edit_perturb_{k}_samples"](spark, sf)) for k in ("noise", "gain", "pitch"))
    level = np.sqrt((x**2).mean(axis=1, keepdims=True)) / 10
    drawn = (noise - x) / level
    assert abs(drawn.mean()) < 0.05 and abs(drawn.std() - 1) < 0.05
    g = (gain * x).sum(axis=1) / (x * x).sum(axis=1)
    assert np.allclose(gain, g[:, None] * x, atol=2e-6) and len(set(g.round(3))) > 10
    assert 10 ** (-6 / 20) - 1e-4 <= g.min() and g.max() <= 10 ** (6 / 20) + 1e-4
    assert np.allclose(pitch, [vocoder(c, 2 ** (2 / 12), 32, 8, False) for c in x], atol=2e-6)
