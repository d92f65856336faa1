"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score:
``P(grade <= k) = sigmoid(threshold_k - score)``.  The expected grade ranks documents, the tail probability
``P(grade >= k)`` selects them.  Features are the shares of a text's words (hashed, A-Z lower-cased) and of
their shapes (letter case, digits and symbols, runs collapsed), and hashed tokens for the classes of its
length, its share of distinct words and its share of repeated lines; none grows with the text.

Fitting uses at most ``most_labelled`` rated documents, taken by the MD5 of their id (a bound whatever the
corpus; their sparse features, not their texts, reach the driver).  Scoring reads all texts where they lie.

Defined cases: null and empty texts have no features and score by the thresholds alone; unrated documents
are scored all the same; ratings of missing documents are ignored; without any rating all weights are 0 and
the thresholds 0, 1, ..; with one grade only, that grade is likely for all; repeated rows are scored each; very long texts are read in slices; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.llm.common import crc_bucket, slices

SIZE = 1 << 18
#: Entries of the worker's word cache before it starts anew.
CACHE = 400_000

#: Bytes by class: letters and all beyond ASCII, capitals, digits; symbols stand for themselves.
_CLASSES = bytes(97 if chr(c).islower() or c > 127 else 65 if chr(c).isupper() else 48 if chr(c).isdigit() else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)

_cache: dict[bytes, tuple[int, int]] = {}


def _places(word: bytes) -> tuple[int, int]:
    """Feature numbers of a word and of its shape; even numbers are words, odd ones shapes."""
    got = _cache.get(word)
    if got is None:
        if len(_cache) >= CACHE:
            _cache.clear()
        shape = _RUN.sub(rb"\1\1", word[:256].translate(_CLASSES))
        half = SIZE // 2
        got = _cache[word] = (xxhash.xxh64_intdigest(word.lower()) % half * 2, xxhash.xxh64_intdigest(shape[:12]) % half * 2 + 1)
    return got


def _summary(text: bytes, words: int, distinct: int) -> list[int]:
    """Feature numbers of the classes of length, distinct words and repeated lines."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    classes = (words.bit_length(), 10 * distinct // words, 10 * (len(lines) - len(set(lines))) // max(len(lines), 1))
    return [xxhash.xxh64_intdigest(b"class %d %d" % (k, c)) % (SIZE // 2) * 2 + 1 for k, c in enumerate(classes)]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (repeats allowed) and shares of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts: Counter[bytes] = Counter()
    for piece in slices(raw):
        counts.update(piece.split())
    if not counts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    at = np.array([_places(w) for w in counts], np.int32)
    share = np.fromiter(counts.values(), np.float32, len(counts)) / sum(counts.values())
    shapes = np.bincount(at[:, 1] // 2, weights=share, minlength=1)
    some = np.flatnonzero(shapes)
    total = _summary(raw, sum(counts.values()), len(counts))
    return np.r_[at[:, 0], some.astype(np.int32) * 2 + 1, np.array(total, np.int32)], np.r_[share, shapes[some].astype(np.float32), np.full(len(total), 0.5, np.float32)]


@dataclass(frozen=True)
class Model:
    """Weights and ordered thresholds; K thresholds part K + 1 grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None) -> float:
        at, x = features(text)
        return float(self.weights[at] @ x)

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score, k = 0..K."""
        below = np.c_[_sigmoid(self.thresholds[None, :] - score[:, None]), np.ones(len(score))]
        return np.diff(below, axis=1, prepend=0.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, top: int, steps: int = 150, rate: float = 0.3, ridge: float = 3e-4, least_rows: int = 3) -> Model:
    """Maximum penalised likelihood by full-batch adaptive gradient steps; the same rows give the same model.

    Features of fewer than ``least_rows`` rows have no weight.
    """
    if not rows:
        return Model(np.zeros(SIZE, np.float32), np.arange(top, dtype=float))
    n, sizes = len(rows), np.array([len(a) for a, _ in rows], np.int64)
    doc = np.repeat(np.arange(n), sizes)
    at, x = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    often = np.bincount(at, minlength=SIZE)[at] >= least_rows
    doc, at, x = doc[often], at[often], x[often]
    used, col = np.unique(at, return_inverse=True)
    spread = np.maximum(np.bincount(col, weights=x * x, minlength=len(used)) / n, 1e-8)
    x = x / np.sqrt(spread)[col] ** 0.5  # rare features count, common ones don't drown them
    share = np.array([(grades <= k).mean() for k in range(top)]).clip(0.01, 0.99)
    theta = np.log(share / (1 - share))
    first, gaps = theta[0], np.log(np.maximum(np.diff(theta), 0.05))
    w = np.zeros(len(used))
    params = [w, np.array([first]), gaps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        w, (first,), gaps = params
        cut = first + np.r_[0, np.cumsum(np.exp(gaps))]
        s = np.bincount(doc, weights=w[col] * x, minlength=n)
        below = np.c_[np.zeros(n), _sigmoid(cut[None, :] - s[:, None]), np.ones(n)]
        slope = below * (1 - below)
        i = np.arange(n)
        p = np.maximum(below[i, grades + 1] - below[i, grades], 1e-9)
        up, low = slope[i, grades + 1] / p, slope[i, grades] / p
        ds = (up - low) / n  # of the negative log-likelihood by the score
        dcut = np.array([-(up[grades == k]).sum() + low[grades == k + 1].sum() for k in range(top)]) / n
        grads = [np.bincount(col, weights=ds[doc] * x, minlength=len(used)) + ridge * w, np.array([dcut.sum()]), np.array([dcut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(top - 1)])]
        for k, (g, (m, v)) in enumerate(zip(grads, moments, strict=True)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params[k] = params[k] - rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    w, (first,), gaps = params
    weights = np.zeros(SIZE, np.float32)
    weights[used] = w / np.sqrt(spread) ** 0.5
    return Model(weights, first + np.r_[0, np.cumsum(np.exp(gaps))])


def rated_sample(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, most_labelled: int) -> DataFrame:
    """Texts and grades of at most ``most_labelled`` rated documents, by MD5 of the id; of a repeated id the least text."""
    order = F.md5(F.col("rated_id").cast("string").cast("binary"))
    chosen = ratings.select(F.col(id_col).alias("rated_id"), F.col("grade").alias("rated_grade")).where("rated_grade is not null and rated_id is not null")
    chosen = chosen.groupBy("rated_id").agg(F.max("rated_grade").alias("rated_grade")).orderBy(order).limit(most_labelled)
    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("text"))
    met = texts.join(F.broadcast(chosen), F.col("own_id") == F.col("rated_id"))
    return met.groupBy(F.col("rated_id").alias("id"), F.col("rated_grade").alias("grade")).agg(F.min("text").alias("text"))


def train(docs: DataFrame, ratings: DataFrame, top: int, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = 6000) -> Model:
    """Fit on rated documents; ``ratings`` has the id and ``grade`` (0..top)."""
    sample = rated_sample(docs, ratings, id_col, text_col, most_labelled)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.string()), b.column(1).cast(pa.int32()), pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in got], pa.binary())],
                ["id", "grade", "at", "x"],
            )

    found = sorted(sample.mapInArrow(each, "id string, grade int, at binary, x binary").collect(), key=lambda r: (r.id, r.grade, bytes(r.at)))
    rows = [(np.frombuffer(r.at, "<i4"), np.frombuffer(r.x, "<f4")) for r in found]
    return fit(rows, np.array([r.grade for r in found], np.int64).clip(0, top), top)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, ``extra`` columns, expected grade and the tail probabilities P(grade >= k), k = 1..K."""
    extra = extra or {}
    rows = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in extra.items()), F.col(text_col).cast("string").alias("text"))
    kept, shared = len(extra) + 1, docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the corpus

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p = m.grades(np.array([m.score(t.as_py()) for t in b.column(kept)], np.float64))
            tails = np.cumsum(p[:, ::-1], axis=1)[:, ::-1][:, 1:].clip(0, 1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:kept], pa.array(tails.sum(axis=1)), pa.array(list(map(list, tails)), pa.list_(pa.float64()))], [*b.schema.names[:kept], "expected_grade", "tails"]
            )

    kinds = dict(rows.dtypes)
    front = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns[:kept])
    return rows.mapInArrow(each, f"{front}, expected_grade double, tails array<double>")


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: 0 poor, 1 good but toxic, 2 good."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).cast("int").alias("grade"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no fit sees: crc32 of the id, modulo 5, is 0."""
    return crc_bucket(id_col, 5) == 0
