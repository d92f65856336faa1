"""Clips of any length: chunks with a halo for neighbourhood operators, and prefix scans for recurrences.

A window or a list over ``(clip_id, ch)`` puts a clip's channel into one task.  Here a channel is cut into
chunks; a row near a border is dealt to the neighbouring chunks too, as halo, so that windows over
``(clip_id, ch, chunk)`` see all the neighbours they need.

A recurrence is affine in its state, even if its coefficients vary by sample.  So each chunk is summarised by one
affine map (matrix, offset) from the state before it to the state after it; maps compose in a tree of two
levels, which gives every chunk its true starting state; and a second parallel pass runs the chunks from there.
What is gathered by channel is one small map a ``FAN`` chunks.  Clips of one chunk need no maps at all.

The key is a struct of clip and channel: equal on nulls, and of any type of id.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplefield.operators.recurrence import cascade

#: Samples of a chunk: some MB, so that a chunk is a task's work and its summary negligible.
CHUNK = 1 << 18
#: Chunks whose maps are composed in one go.
FAN = 1024


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and cut off from its lineage."""
    from ripplefield.streaming.run import shared_folder

    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def with_halo(df: DataFrame, chunk: int, before: int, after: int) -> DataFrame:
    """Adds ``chunk`` and ``own``: rows within ``before`` of a chunk's start or ``after`` of its end come again, not owned."""
    if chunk < 1 or before < 0 or after < 0:
        raise ValueError("a chunk has samples, and a halo no fewer than none")
    home = F.floor(F.col("idx") / chunk)
    if not before and not after:
        return df.withColumn("chunk", home).withColumn("own", F.lit(True))
    first = F.greatest(F.floor((F.col("idx") - after) / chunk), F.least(home, F.lit(0)))
    last = F.floor((F.col("idx") + before) / chunk)
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("own", F.col("chunk") == home)


def windowed(df: DataFrame, value: Callable[[Window], Column], before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """``v`` replaced by an expression over an ordered window of each chunk and its halo; null results are dropped."""
    w = Window.partitionBy("clip_id", "ch", "chunk").orderBy("idx")
    out = with_halo(df, chunk, before, after).withColumn("v", value(w))
    return out.where("own and v is not null").select("clip_id", "ch", "idx", "v")


def crossings(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Sign changes per clip, as the plain operator counts them."""

    def crossed(w: Window) -> Column:
        prev, v = F.lag("v").over(w), F.col("v")
        return F.coalesce(((prev > 0) & (v <= 0)) | ((prev <= 0) & (v > 0)), F.lit(False)).cast("double")

    return windowed(df, crossed, 1, 0, chunk).groupBy("clip_id").agg(F.sum("v").cast("long").alias("zero_crossings"))


def fir(df: DataFrame, taps: list[float], chunk: int = CHUNK) -> DataFrame:
    """Valid part of ``y[i] = sum_k x[i + k] taps[k]``."""
    return windowed(df, lambda w: sum((F.lead("v", k).over(w) * F.lit(float(t)) for k, t in enumerate(taps)), F.lit(0.0)), 0, len(taps) - 1, chunk)


def step_matrix(sections: np.ndarray) -> np.ndarray:
    """What one zero sample does to the state of all sections."""
    n = 2 * len(sections)
    out = np.empty((n, n))
    for k in range(n):
        state = np.zeros(n)
        state[k] = 1
        out[:, k] = cascade(np.zeros(1), sections, state.reshape(-1, 2))[1].ravel()
    return out


@functools.lru_cache(maxsize=1024)
def power_of(step: bytes, n: int) -> np.ndarray:
    """A power of a square matrix, given as its bytes; most chunks are of one length."""
    m = np.frombuffer(step)
    return np.linalg.matrix_power(m.reshape(math.isqrt(len(m)), -1), n)


def cut(df: DataFrame, chunk: int, before: int = 0, after: int = 1, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """``(key, chunk, first, skip, own, *values)``: the ordered samples of each chunk with its halo, as arrays.

    ``first`` is the index of the first own sample, which comes after ``skip`` of the halo; ``own`` counts own samples.
    """
    rows = with_halo(df.select(F.struct("clip_id", "ch").alias("key"), "idx", *(F.col(c).cast("double").alias(c) for c in values)), chunk, before, after)
    rows = rows.groupBy("key", "chunk").agg(
        F.min(F.when(F.col("own"), F.col("idx"))).alias("first"),
        F.sum((F.col("idx") < F.col("chunk") * chunk).cast("long")).alias("skip"),
        F.sum(F.col("own").cast("long")).alias("own"),
        F.sort_array(F.collect_list(F.struct("idx", *values))).alias("s"),
    )
    rows = rows.where("own > 0").withColumns({c: F.col(f"s.{c}") for c in values})
    return rows.select("key", F.col("chunk").cast("long").alias("chunk"), F.col("first").cast("long").alias("first"), "skip", "own", *values)


class Piece(NamedTuple):
    """A chunk in a task: its row's numbers, and its arrays with halo."""

    row: dict[str, Any]
    arrays: dict[str, np.ndarray]

    def own(self, name: str = "v") -> np.ndarray:
        """The own samples."""
        start = self.row["skip"]
        return self.arrays[name][start : start + self.row["own"]]

    @property
    def more(self) -> bool:
        """Whether samples follow (``after`` must be 1 or more)."""
        return len(next(iter(self.arrays.values()))) > self.row["skip"] + self.row["own"]


def pieces(batch: pa.RecordBatch) -> Iterator[Piece]:
    """The rows of a batch; lists of numbers as arrays, the key left out."""
    plain, lists = {}, {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if pa.types.is_list(column.type):
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            lists[name] = (column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)], column.is_null().to_pylist())
        elif name != "key":
            plain[name] = column.to_pylist()
    for k in range(batch.num_rows):
        arrays = {n: (None if null[k] else v[at[k] : at[k + 1]]) for n, (v, at, null) in lists.items()}
        yield Piece({n: v[k] for n, v in plain.items()}, arrays)


def list_of(arrays: list[np.ndarray]) -> pa.Array:
    """A list column; its offsets must fit 31 bits, and a batch that large is refused rather than wrapped."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
    if ends[-1] >= 2**31:
        raise ValueError("too many samples in one batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(ends.astype(np.int32), np.concatenate(arrays) if arrays else np.empty(0))


def map_pieces(arrays: DataFrame, kernel: Callable[[Piece], dict], outputs: str) -> DataFrame:
    """``(key, chunk, *outputs)`` by a kernel that returns a dict of arrays and numbers for each chunk."""
    fields = [f.split() for f in outputs.split(", ")]
    types = {"array<double>": pa.list_(pa.float64()), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [kernel(p) for p in pieces(b)]
            columns = [list_of([np.asarray(f[n], float) for f in found]) if kind == "array<double>" else pa.array([f[n] for f in found], types[kind]) for n, kind in fields]
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([b.column(names.index("key")), b.column(names.index("chunk")), *columns], ["key", "chunk", *(n for n, _ in fields)])

    return arrays.mapInArrow(each, f"key {arrays.schema['key'].dataType.simpleString()}, chunk long, {outputs}")


def long_form(arrays: DataFrame, *values: str) -> DataFrame:
    """``(clip_id, ch, idx, *values)`` of the array columns; ``first`` numbers the first sample of each row."""
    out = arrays.select("key", "first", F.posexplode(F.arrays_zip(*values)).alias("pos", "z"))
    return out.select("key.clip_id", "key.ch", (F.col("first") + F.col("pos")).alias("idx"), *(F.col("z")[c].alias(c) for c in values))


def _compose(maps: list, dim: int, state: np.ndarray | None = None) -> tuple[np.ndarray, list[list[float]]]:
    """The composition of maps in order, and the states before each from ``state``."""
    whole, before = np.r_[np.eye(dim).ravel(), np.zeros(dim)], []
    for m in maps:
        m = np.asarray(m, float)
        step, offset = m[: dim * dim].reshape(dim, dim), m[dim * dim :]
        if state is None:
            whole = np.r_[(step @ whole[: dim * dim].reshape(dim, dim)).ravel(), step @ whole[dim * dim :] + offset]
        else:
            before.append(state.tolist())
            state = step @ state + offset
    return whole, before


def prefix_states(maps: DataFrame, dim: int, fan: int = FAN) -> DataFrame:
    """``(key, chunk, z)``: the state after each chunk of ``(key, chunk, m)``, as start of the next one.

    ``m`` is a matrix by rows, then an offset.  Groups of ``fan`` chunks are composed, the groups' maps are chained by
    channel, and each group hands its start down to its chunks.
    """
    key = maps.schema["key"].dataType.simpleString()
    grouped = lambda df, by, name: df.groupBy("key", *by).agg(F.sort_array(F.collect_list(F.struct(name, "m"))).alias("s"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_compose([x["m"] for x in s], dim)[0] for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), list_of(found)], ["key", "g", "m"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_pylist()
            states = [z for s in rows for z in _compose([x["m"] for x in s], dim, np.zeros(dim))[1]]
            back = pa.array(np.repeat(np.arange(len(rows)), [len(s) for s in rows]), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(back), pa.array([x["g"] for s in rows for x in s], pa.int64()), pa.array(states, pa.list_(pa.float64()))], ["key", "g", "z"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts = b.column(1).to_pylist(), b.column(2).to_pylist()
            states = []
            for s, z in zip(rows, starts, strict=True):
                before = _compose([x["m"] for x in s], dim, np.asarray(z, float))[1]
                last = np.asarray(s[-1]["m"], float)
                states += [*before[1:], (last[: dim * dim].reshape(dim, dim) @ before[-1] + last[dim * dim :]).tolist()]
            back = pa.array(np.repeat(np.arange(len(rows)), [len(s) for s in rows]), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(back), pa.array([x["chunk"] + 1 for s in rows for x in s], pa.int64()), pa.array(states, pa.list_(pa.float64()))], ["key", "chunk", "z"])

    groups = grouped(maps.withColumn("g", F.floor(F.col("chunk") / fan).cast("long")), ["g"], "chunk")
    tops = groups.select("key", "g", "s").mapInArrow(whole, f"key {key}, g long, m array<double>")
    starts = grouped(tops, [], "g").mapInArrow(chain, f"key {key}, g long, z array<double>")
    return groups.join(starts, ["key", "g"]).select("key", "s", "z").mapInArrow(down, f"key {key}, chunk long, z array<double>")


class Recurrence(NamedTuple):
    """``drive`` gives a chunk's (matrix, offset); ``run`` its outputs from a state, which is None at the first chunk."""

    dim: int
    drive: Callable[[Piece], tuple[np.ndarray, np.ndarray]]
    run: Callable[[Piece, np.ndarray | None], dict]


def scan(arrays: DataFrame, rule: Recurrence, outputs: str, last: Column) -> DataFrame:
    """``(key, chunk, *outputs)`` of a recurrence over chunks in rising order; ``last`` marks chunks that none follows."""

    def summary(p: Piece) -> dict:
        step, offset = rule.drive(p)
        return {"m": np.r_[np.asarray(step, float).ravel(), np.asarray(offset, float).ravel()]}

    starts = prefix_states(map_pieces(arrays.where(~last), summary, "m array<double>"), rule.dim)
    return map_pieces(arrays.join(starts, ["key", "chunk"], "left"), lambda p: rule.run(p, p.arrays["z"]), outputs)


def _is_last() -> Column:
    return F.size("v") <= F.col("skip") + F.col("own")


def filter_rule(sections: np.ndarray, start: Callable[[float], np.ndarray] | None = None) -> Recurrence:
    """Second-order sections as a recurrence; ``start`` makes the first state from the first sample."""
    dim, step = 2 * len(sections), step_matrix(sections)

    def begin(p: Piece, z: np.ndarray | None) -> np.ndarray:
        if z is not None:
            return z.reshape(-1, 2)
        return start(p.own()[0]).reshape(-1, 2) if start and p.row["skip"] == 0 else np.zeros((dim // 2, 2))

    def drive(p: Piece) -> tuple[np.ndarray, np.ndarray]:
        return power_of(step.tobytes(), p.row["own"]), cascade(p.own(), sections, begin(p, None))[1]

    return Recurrence(dim, drive, lambda p, z: {"v": cascade(p.own(), sections, begin(p, z))[0], "first": p.row["first"]})


def recursive_filter(df: DataFrame, sections: np.ndarray, chunk: int = CHUNK, start: Callable[[float], np.ndarray] | None = None) -> DataFrame:
    """Second-order sections over chunks in parallel; equal to one pass over the whole channel."""
    done = scan(cut(df, chunk, 1, 1), filter_rule(np.asarray(sections, float), start), "v array<double>, first long", _is_last())
    return long_form(done, "v")


def zero_phase(df: DataFrame, sections: np.ndarray, reach: int, chunk: int = CHUNK) -> DataFrame:
    """Forward and backward from rest over an odd extension of ``reach`` samples, fewer if the clip is shorter.

    The first and the last chunk carry the extensions; the backward pass is a second scan, over falling chunks.
    """
    sections = np.asarray(sections, float)
    dim, step = 2 * len(sections), step_matrix(sections)
    states = lambda z: np.zeros((dim // 2, 2)) if z is None else z.reshape(-1, 2)

    def extended(p: Piece) -> tuple[np.ndarray, int, int]:
        x, skip, own = p.arrays["v"], p.row["skip"], p.row["own"]
        left = min(reach, len(x) - 1) if skip == 0 else 0
        right = min(reach, len(x) - 1) if len(x) == skip + own else 0
        mine = x[skip : skip + own]
        return np.r_[2 * x[0] - x[left:0:-1] if left else x[:0], mine, 2 * x[-1] - x[-2 : -right - 2 : -1] if right else x[:0]], left, right

    def drive(p: Piece):
        x = extended(p)[0]
        return power_of(step.tobytes(), len(x)), cascade(x, sections)[1]

    def forward(p: Piece, z) -> dict:
        x, left, right = extended(p)
        return {"y": cascade(x, sections, states(z))[0], "first": p.row["first"], "left": left, "right": right, "begins": p.row["skip"] == 0}

    def drive_back(p: Piece):
        y = p.arrays["y"]
        return power_of(step.tobytes(), len(y)), cascade(y[::-1], sections)[1]

    def backward(p: Piece, z) -> dict:
        y = cascade(p.arrays["y"][::-1], sections, states(z))[0][::-1]
        return {"v": y[p.row["left"] : len(y) - p.row["right"]], "first": p.row["first"]}

    there = settled(scan(cut(df, chunk, reach, reach + 1), Recurrence(dim, drive, forward), "y array<double>, first long, left long, right long, begins boolean", _is_last()))  # the way back reads it twice
    back = there.withColumn("chunk", -F.col("chunk"))
    return long_form(scan(back, Recurrence(dim, drive_back, backward), "v array<double>, first long", F.col("begins")), "v")


def latest(df: DataFrame, chunk: int = CHUNK, **values: Column) -> DataFrame:
    """Adds columns with the latest value that wasn't null, up to each sample; null before the first.

    The last value of every chunk is carried on over the chunks (one row each), then filled in within them.
    """
    named = df.withColumns({f"{n}__": v for n, v in values.items()} | {"chunk": F.floor(F.col("idx") / chunk)}).withColumn("key", F.struct("clip_id", "ch"))
    last = lambda n: F.max(F.when(F.col(f"{n}__").isNotNull(), F.struct("idx", f"{n}__")))[f"{n}__"]
    ends = named.groupBy("key", "chunk").agg(*(last(n).alias(n) for n in values))
    so_far = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "chunk", *(F.last(n, ignorenulls=True).over(so_far).alias(f"{n}_before__") for n in values))
    inside = Window.partitionBy("key", "chunk").orderBy("idx")
    filled = {n: F.coalesce(F.last(f"{n}__", ignorenulls=True).over(inside), F.col(f"{n}_before__")) for n in values}
    return named.join(carried, ["key", "chunk"]).withColumns(filled).select(*df.columns, *values)
