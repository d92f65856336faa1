"""Recurrences over live streams: state per (clip, channel), one output a sample, in index order.

Late rows can't repair a recurrence: a row whose index isn't beyond the last one seen is dropped.  The same
kernels run in batch, so a stream's output equals the batch operator's on the same samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "clip_id long, ch int, idx long, v double"
STATE = "last long, numbers array<double>"


def stateful(stream: DataFrame, step: Callable[[np.ndarray, list[float]], tuple[np.ndarray, list[float]]], initial: list[float]) -> DataFrame:
    """``step(block, state)`` over each key's samples in order; the state is kept between micro-batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, numbers = state.get if state.exists else (-1, list(initial))
        pdf = pd.concat(list(frames)).sort_values("idx")
        pdf = pdf[pdf["idx"] > last].drop_duplicates("idx")
        if not len(pdf):
            return
        v, numbers = step(pdf["v"].to_numpy(np.float64), list(numbers))
        state.update((int(pdf["idx"].iloc[-1]), [float(x) for x in numbers]))
        yield pd.DataFrame({"clip_id": key[0], "ch": np.int32(key[1]), "idx": pdf["idx"].to_numpy(), "v": v})

    return stream.select("clip_id", "ch", "idx", "v").groupBy("clip_id", "ch").applyInPandasWithState(each, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_sections(stream: DataFrame, sections: np.ndarray) -> DataFrame:
    """Second-order sections over a stream."""
    from ripplefield.operators.recurrence import cascade

    n = len(sections)

    def step(x, state):
        y, z = cascade(x, sections, np.array(state).reshape(n, 2))
        return y, z.ravel().tolist()

    return stateful(stream, step, [0.0] * (2 * n))


def stream_envelope(stream: DataFrame, sample_rate: float, attack_ms: float, release_ms: float, method: str = "peak") -> DataFrame:
    """Peak, RMS or hybrid follower over a stream; the detector's trailing samples are state too."""
    from ripplefield.operators.dynamics import detector, follow_detector, rms_samples

    behind = 0 if method == "peak" else rms_samples(sample_rate) - 1

    def step(x, state):
        level, past = state[:2], np.array(state[2:])
        both = np.r_[past, x]
        y = follow_detector(detector(both, sample_rate, method)[len(past) :], sample_rate, attack_ms, release_ms, level)
        return y, level + both[len(both) - min(behind, len(both)) :].tolist()

    return stateful(stream, step, [0.0, 0.0])


def stream_delay(stream: DataFrame, n: int) -> DataFrame:
    """A delay of ``n`` samples over a stream."""

    def step(x, state):
        both = np.r_[state, x]
        return both[: len(both) - n], both[len(both) - n :].tolist()

    return stateful(stream, step, [0.0] * n)


def stream_prediction_residual(stream: DataFrame, predictor: list[float]) -> DataFrame:
    """Linear-prediction residual over a stream, with the history carried on."""
    from ripplefield.operators.codec import lpc_residual

    a = np.asarray(predictor)

    def step(x, state):
        return lpc_residual(x, a, np.array(state)), np.r_[state, x][-len(a) :].tolist()

    return stateful(stream, step, [0.0] * len(a))


def stream_prediction_synthesis(stream: DataFrame, predictor: list[float]) -> DataFrame:
    """Linear-prediction synthesis of a streamed residual, with the output's history carried on."""
    from ripplefield.operators.codec import lpc_synthesis

    a = np.asarray(predictor)

    def step(x, state):
        y = lpc_synthesis(x, a, np.array(state))
        return y, np.r_[state, y][-len(a) :].tolist()

    return stateful(stream, step, [0.0] * len(a))


def windowed_levels(stream: DataFrame, size: str, slide: str, lateness: str) -> DataFrame:
    """RMS, peak and count of a key's values in event-time windows; rows later than the watermark are dropped."""
    g = stream.withWatermark("ts", lateness).groupBy(F.window("ts", size, slide), "clip_id")
    return g.agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.max(F.abs("v")).alias("peak"), F.count("*").alias("n"))


def activity_sessions(stream: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Sessions of a key separated by gaps, with their counts and totals."""
    g = stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "clip_id")
    return g.agg(F.count("*").alias("n"), F.sum("v").alias("total"))
