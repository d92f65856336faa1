"""Kernels over many short clips: no group of its own for each, and the same numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplefield.operators import filterbanks, onsets, peaks, spectral
from ripplefield.plans.registry import queries
from ripplefield.sources.tables import embedding_clips


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["onset_detection_function", "bank_cqt_db", "spec_deconvolve", "spec_convolve"])
def test_no_group_for_each_clip(spark, sf, name):
    assert "GroupsInPandas" not in plan_of(queries()[name](spark, sf))


def test_blocks_of_frames_equal_one_pass():
    x = np.random.default_rng(0).normal(size=(3, 101))
    kernels = filterbanks.cqt_kernels(64.0, 4.0, 18, 12, 64)
    whole = filterbanks.tones(x, kernels, 8, 0, 13)
    parts = [filterbanks.tones(x, kernels, 8, a, min(a + 4, 13)) for a in range(0, 13, 4)]
    np.testing.assert_allclose(np.concatenate(parts, axis=1), whole, atol=1e-12)
    padded = np.pad(x, ((0, 0), (64, 64)))
    for b, (_, k) in enumerate(kernels):
        for f in range(13):
            at = 64 + f * 8 - len(k) // 2
            np.testing.assert_allclose(whole[:, f, b], padded[:, at : at + len(k)] @ k, atol=1e-12)


def series(df):
    return {(r.clip_id, r.frame): r.x for r in df.collect()}


def uneven(spark, sf):
    """Two channels, lengths that differ, one clip without an id."""
    df = embedding_clips(spark, sf).where("clip_id < 12 and idx < 10 + 4 * clip_id").withColumn("ch", F.pmod("idx", F.lit(2)).cast("int"))
    return df.select(F.when(F.col("clip_id") != 3, F.col("clip_id")).alias("clip_id"), "ch", F.expr("idx div 2").alias("idx"), "v")


@pytest.mark.parametrize("method", onsets.METHODS)
def test_flux_in_the_transform_equals_flux_of_the_spectrum(spark, sf, method):
    c = onsets.OnsetConfig(4, 3, 1.1, 4.0, 18)
    df = uneven(spark, sf)
    spec = filterbanks.constant_q(df, 4.0, 18, 4, 64.0, longest=onsets.effective_window(64.0, 4.0))
    got, want = series(onsets._over_frames(df, 64.0, c, onsets._flux_terms(method))), series(onsets.flux(spec, method))
    assert got == pytest.approx(want, abs=1e-9) and len(got) > 50


def test_complex_function_in_the_transform_equals_that_of_the_spectrum(spark, sf):
    c = onsets.OnsetConfig(4, 3, 1.1, 4.0, 18)
    df = uneven(spark, sf).where("clip_id is not null")
    spec = filterbanks.constant_q(df, 4.0, 18, 4, 64.0, longest=onsets.effective_window(64.0, 4.0))
    got = series(peaks.log_compress(onsets._over_frames(df, 64.0, c, onsets._complex_terms(4, 64.0)), 100.0))
    assert got == pytest.approx(series(onsets.complex_odf(spec, 4, 64.0)), abs=1e-6)


def test_pairs_keep_clips_without_an_id(spark, sf):
    df = uneven(spark, sf).where("ch = 0")
    got = spectral.convolve(df, df).where("clip_id is null").orderBy("idx").collect()
    x = np.array([r.v for r in df.where("clip_id is null").orderBy("idx").collect()])
    np.testing.assert_allclose([r.v for r in got], np.convolve(x, x), atol=1e-12)


@pytest.mark.parametrize("name", ["codec_perceptual_clips", "codec_frames_auto_clips"])
def test_codecs_have_no_group_for_each_clip(spark, sf, name):
    assert "GroupsInPandas" not in plan_of(queries()[name](spark, sf))
