"""Stateful operators with timers and lifetimes: state that leaves when its clip falls silent.

The follower of a live clip keeps one value state, its last detector value, its level and the time of its last sample.  Every
batch sets an event-time timer to the end of the clip's lifetime; when the watermark passes it, the state is
removed, so what is kept grows with the clips that are alive and not with all that ever were.  A sample that comes more than a lifetime
after the one before it starts afresh whether the timer has fired yet or not, so results don't depend on
how the stream is cut into batches.

Samples of a batch are taken in order of time, then of index.  A sample older than the last one of its clip, or than the watermark, is late:
it gives no row and changes nothing.  Samples without a time are left out; null clips are a clip.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LiveFollower(StatefulProcessor):
    """Envelope of the absolute value, with attack and release by sample, and a lifetime."""

    def __init__(self, up: float, down: float, lifetime_ms: int):
        self.up, self.down, self.lifetime = up, down, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        """One value state and its timer."""
        self.handle = handle
        self.state = handle.getValueState("level", "detector double, level double, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """The samples of a clip in a batch."""
        batch = pd.concat(rows).sort_values(["at", "idx"], kind="stable")
        last, level, before = self.state.get() if self.state.exists() else (0.0, 0.0, None)
        out = []
        for at, idx, v in zip(batch["at"], batch["idx"], batch["v"], strict=True):
            if before is not None and at < before:
                continue
            if before is not None and at - before > self.lifetime:
                last, level = 0.0, 0.0
            d = abs(v)
            c = self.up if d > last else self.down
            last, level, before = d, c * level + (1 - c) * d, int(at)
            out.append((idx, level))
        if out:
            self.state.update((last, level, before))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(before // 1000 + self.lifetime // 1000 + 1)
            yield pd.DataFrame({"clip_id": [key[0]] * len(out), "idx": [i for i, _ in out], "v": [e for _, e in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The clip's lifetime is over: its state goes."""
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def live_envelope(df: DataFrame, sample_rate: float, attack_ms: float, release_ms: float, lifetime: float, delay: str = "10 seconds") -> DataFrame:
    """``(clip_id, idx, v)`` of a stream ``(clip_id, idx, ts, v)``; ``lifetime`` in seconds, times to the microsecond."""
    up, down = (math.exp(-1 / (t / 1000 * sample_rate)) for t in (attack_ms, release_ms))
    df.sparkSession.conf.set(*PROVIDER)
    kind = df.schema["clip_id"].dataType.simpleString()
    rows = df.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay).select("clip_id", "ts", "at", "idx", "v")
    return rows.groupBy("clip_id").transformWithStateInPandas(
        statefulProcessor=LiveFollower(up, down, int(lifetime * 1_000_000)), outputStructType=f"clip_id {kind}, idx long, v double", outputMode="Append", timeMode="EventTime"
    )
