from fractions import Fraction

import numpy as np
import pytest

from ripplefield.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, x int"


def brute(vectors, most=16):
    """The contract in exact integers and one dense eigendecomposition."""
    xs = [tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for x in xs])
    return n, deviation, centred @ axes / np.sqrt(values), values / np.trace(np.cov(np.array(fit).T, bias=True))


def test_equals_exact_integers(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [(rng.normal(size=24) * np.linspace(0.2, 3, 24)).astype(np.float32).tolist() for _ in range(300)]
    rows = [(k, v, "clash", 1) for k, v in enumerate(good)]
    rows += [(7, good[5], "", 1), (7, good[5], "", 1), (None, good[9], "", 1)] + [(1000 + k, good[0], "hot", 1) for k in range(400)]
    bad = [(-1, None, "", 1), (-2, [], "", 1), (-3, [*good[0][:-1], None], "", 1), (-4, [*good[0][:-1], float("nan")], "", 1), (-5, [*good[0][:-1], float("inf")], "", 1), (-6, [1.0] * 5, "", 1), (-7, [1e38] * 24, "", 1)]
    spark.createDataFrame(rows + bad, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_embedding_whitening(spark, str(tmp_path)).toPandas()
    n, deviation, white, explained = brute([r[1] for r in rows])
    assert len(got) == 16 * len(rows) and set(got.n) == {n} == {300}
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    by = {(None if np.isnan(i) else int(i), int(c)): (d, w, e) for i, c, d, w, e in zip(got.vec_id, got.component, got.deviation, got.whitened, got.explained, strict=True)}
    signs = np.sign([by[0, c + 1][1] * white[0, c] for c in range(16)])
    for k, r in enumerate(rows):
        for c in range(16):
            d, w, e = by[r[0], c + 1]
            if r[0] != 7:
                assert d == deviation[k] and abs(w - signs[c] * white[k, c]) < 1e-8
            assert abs(e / explained[c] - 1) < 1e-9


@pytest.mark.parametrize("vectors,usable", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 5, 0), ([[1.0, 2.0], [3.0, 2.0], [2.0, 2.0]], 1)])
def test_degenerate_tables(spark, vectors, usable):
    df = spark.createDataFrame([(k, v, "", 1) for k, v in enumerate(vectors)], SCHEMA)
    rows = whitening.integer_rows(df)
    got = whitening.whiten(rows, whitening.fit(rows)).collect()
    assert len(got) == 2 * len(vectors)
    assert sum(r.whitened is not None for r in got) == usable * len(vectors)
    assert all((r.identity_error is not None) == bool(usable) for r in got)
    if usable:
        assert {r.explained for r in got if r.component == 1} == {1.0}


def test_deviations_stay_exact_beyond_doubles():
    model = whitening.Model(3, [10, 20], np.eye(2), np.ones(2), 2.0, np.ones(2, bool), 0.0)
    x = np.array([[2**29, 1], [2**31 + 7, 5]], np.int64)
    assert whitening._deviation(x, model) == [(3 * 2**29 - 10) ** 2 + 17**2, None]


def test_real_vectors(spark, sf):
    import pyarrow.parquet as pq

    vectors = pq.read_table(f"{sf}/embeddings.parquet").column("embedding").to_pylist()
    got = queries.op12_embedding_whitening(spark, sf).toPandas()
    n, deviation, white, explained = brute(vectors)
    assert (got[got.component == 1].sort_values("vec_id").deviation.to_numpy() == deviation).all()
    for c in range(16):
        w = got[got.component == c + 1].sort_values("vec_id").whitened.to_numpy()
        assert min(np.abs(w - white[:, c]).max(), np.abs(w + white[:, c]).max()) < 1e-7
