"""Embedding whitening: exact integer statistics, MLlib's Gramian, a local eigendecomposition, broadcast projection.

Entries become integers ``x = floor(scale * c) + offset``, so counts, sums and deviations are exact.  The fit list
holds each distinct vector once (a partial aggregation first, so a vector that fills a third of the table is one
row a task).  Rows ``(n * x - S) / n`` are centred by exact integers, divided once, and given to
``RowMatrix.computeGramianMatrix``; its result over ``n`` is the covariance.  What reaches the driver is one
dimension x dimension matrix; what is broadcast is dimension x components.

Defined cases: rows whose vector is null, empty, or holds null, non-finite or out-of-range entries (beyond 2^46,
where the integers would not fit) are left out; if lengths differ, the most frequent length among the distinct
vectors counts (the longer on ties) and others are left out; repeated rows and repeated or null ids give a result
each; other columns are not read; components whose eigenvalue is zero to double precision have a null
``whitened`` and don't enter ``identity_error``, which is null if there is none; ``explained`` is null where the trace is
zero; a deviation beyond a long is null; without usable rows there are no results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.llm.common import written

SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0**46


class Model(NamedTuple):
    """A fitted whitening: ``vectors`` are unit eigenvectors in columns, ``values`` their eigenvalues, falling."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    usable: np.ndarray
    identity_error: float | None


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    fits = lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False))  # noqa: E731  NaN is larger than all
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, fits)


def lattice(vector: Column) -> Column:
    """The integer vector."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(OFFSET).cast("long"))


def integer_rows(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``(id, x)`` of the usable rows."""
    return df.where(usable(F.col(vector))).select(F.col(id_col).alias("id"), lattice(F.col(vector)).alias("x"))


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension: one row a task and dimension is shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                wide = [int(v) for v in (x >> 32).sum(axis=0)], [int(v) for v in (x & 0xFFFFFFFF).sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(wide[0], pa.int64()), pa.array(wide[1], pa.int64()), pa.array([batch.num_rows] * dim, pa.int64())], ["i", "high", "low", "n"])

    parts = fit.select("x").mapInArrow(partial, "i int, high long, low long, n long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts.groupBy("i").agg(exact("high"), exact("low"), F.sum("n").alias("n")).orderBy("i").collect()  # one row a dimension
    return (rows[0].n, [(int(r.high) << 32) + int(r.low) for r in rows]) if rows else (0, [])


def _gramian(rows: DataFrame) -> np.ndarray:
    """Sum of outer products of the array column ``v``."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _eigen(gram: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 / n)
    order = np.argsort(values)[::-1][:most]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return vectors * np.where(signs == 0, 1, signs), values[order], float(np.trace(gram) / n)


def _project(x: np.ndarray, model: Model) -> np.ndarray:
    """Whitened components of integer vectors; the centring is exact up to its one division."""
    centred = (x * model.n - np.array(model.sums, np.int64)) / model.n
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.usable, centred @ model.vectors / np.sqrt(np.maximum(model.values, 0)), np.nan)


def fit(rows: DataFrame, components: int = 16) -> Model | None:
    """Fit on the distinct integer vectors of ``rows``; None if there are none."""
    distinct = written(rows.select("x").distinct())
    sizes = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    dim = sizes.d
    distinct = distinct.where(F.size("x") == dim)
    n, sums = _sums(distinct, dim)
    centre = F.lit(sums).cast("array<bigint>")
    gram = _gramian(distinct.select(F.zip_with("x", centre, lambda a, s: (a * F.lit(n).cast("long") - s) / F.lit(float(n))).alias("v")))
    vectors, values, trace = _eigen(gram, n, components)
    some = values > max(values[0], 0) * dim * 8 * np.finfo(float).eps
    model = Model(n, sums, vectors, values, trace, some, None)
    return model._replace(identity_error=_identity_error(distinct, model) if some.any() else None)


def _identity_error(distinct: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured over all of it."""
    shared, k = distinct.sparkSession.sparkContext.broadcast(model), int(model.usable.sum())

    def whiten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"v": list(_project(np.stack(frame["x"]), shared.value)[:, shared.value.usable])})

    white = distinct.select("x").mapInPandas(whiten, "v array<double>")
    means = white.agg(*(F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(k))).first()
    centred = white.select(F.zip_with("v", F.lit([float(m) for m in means]), lambda a, m: a - m).alias("v"))
    return float(np.abs(_gramian(centred) / model.n - np.eye(k)).max())


def _deviation(x: np.ndarray, model: Model) -> list[int | None]:
    """Sums of squared ``n * x - S``, exact; null beyond a long."""
    y = x * model.n - np.array(model.sums, np.int64)
    if y.size and int(np.abs(y).max()) ** 2 * y.shape[1] < 2**63:
        return (y * y).sum(axis=1).tolist()
    exact = (sum(int(v) ** 2 for v in row) for row in y)
    return [v if v < 2**63 else None for v in exact]


def whiten(rows: DataFrame, model: Model | None, id_name: str = "vec_id") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``, a row for each vector and component."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = "id string, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        out = rows.sparkSession.createDataFrame([], schema)
        return out.select(F.col("id").cast(kind).alias(id_name), *out.columns[1:])
    shared, dim = rows.sparkSession.sparkContext.broadcast(model), len(model.sums)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        k = len(m.values)
        share = np.maximum(m.values, 0) / m.trace if m.trace > 0 else np.full(k, np.nan)
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"])
            yield pd.DataFrame(  # NaN arrives as null
                {
                    "id": frame["id"].repeat(k).to_numpy(),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                    "n": np.full(len(x) * k, m.n, np.int64),
                    "deviation": pd.array(_deviation(x, m), "Int64").repeat(k),
                    "whitened": _project(x, m).ravel(),
                    "explained": np.tile(share, len(x)),
                    "identity_error": np.full(len(x) * k, np.nan if m.identity_error is None else m.identity_error),
                }
            )

    same = rows.where(F.size("x") == dim).select(F.col("id").cast("string").alias("id"), "x")  # as text a null id stays one
    out = same.mapInPandas(project, schema)
    return out.select(F.col("id").cast(kind).alias(id_name), *out.columns[1:])
