"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained on labelled text: one on windows of ordinary documents; one that holds the same
content and, nearest to the window, what was trained on toxic text.  Both therefore treat ordinary words
alike, and a window's distance, its compressed length under the ordinary dictionary minus that under the
toxic one, grows with what only toxic text repeats.

Documents are labelled as wholes although most of their words are ordinary, so the toxic training text is
what is typical of the class: the stretches of toxic documents, in their order, that hold a byte gram whose
document frequencies differ between the classes with a z-score of ``least_z`` or more.  A logistic calibration
on the distances of a document's windows turns them into a score; 0.5 is its threshold.  (Dictionaries trained
on whole toxic windows, chosen over again by their gain in compression, find few toxic documents; the README
has the figures.)

Fitting uses at most ``most_toxic`` and ``most_ordinary`` labelled documents that aren't held out, by the MD5
of their id (a documented bound: one row an id, the least text, and they reach the driver).  Scoring covers every window of every text where it lies; a model is two
dictionaries of some KB and a handful of numbers.

Defined cases: null and empty texts have distance 0 and get the calibrated score of that; without labels of
both kinds every score is the share of toxic labels (0 if none); without typical words the toxic dictionary adds
nothing and the calibration says the same for all windows; repeated rows are scored each; very long texts are
read window by window, words beyond 256 bytes in stretches; an empty table gives no rows; language, source, id
and labels are no inputs of a score; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.llm.common import crc_bucket

#: Words of a window.
WINDOW = 8
#: The most telling windows, whose distances are features and which are compressed together once more.
TOP, JOINED = 4, 8
#: Bytes that a window must save to count as telling.
TELLING = 3
LEVEL = 3
#: Longest stretch of a word that enters a window whole; longer words are cut into such stretches.
LONGEST = 256
#: Lengths of the byte grams whose class frequencies are compared.
GRAMS = (6, 8)
#: Where the content of a trained dictionary begins: after its last header field, the three repeat offsets.
CONTENT = (1).to_bytes(4, "little") + (4).to_bytes(4, "little") + (8).to_bytes(4, "little")


def lower_words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; longer ones in stretches of ``LONGEST`` bytes."""
    w = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if any(len(x) > LONGEST for x in w):
        w = [x[i : i + LONGEST] for x in w for i in range(0, len(x), LONGEST)]
    return w


def windows(text: str | None) -> list[bytes]:
    """The text's words, eight at a time, over the whole text."""
    w = lower_words(text)
    return [b" " + b" ".join(w[i : i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)]


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a dictionary trained on samples; of so few that training fails, the samples themselves."""
    if not samples:
        return b""
    try:
        trained = zstandard.train_dictionary(size, samples, k=segment, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    return trained[trained.index(CONTENT) + len(CONTENT) :]


def word_grams(word: bytes) -> set[bytes]:
    """Byte grams of a word between blanks."""
    w = b" " + word + b" "
    return {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)}


def typical_grams(toxic: list[str], ordinary: list[str], least_z: float) -> set[bytes]:
    """Grams that more toxic than ordinary documents hold, by a two-proportion z-score."""
    counts = []
    for texts in (toxic, ordinary):
        c: Counter[bytes] = Counter()
        for t in texts:
            c.update(set().union(*map(word_grams, set(lower_words(t)))))
        counts.append(c)
    a, b = counts
    n1, n0 = len(toxic), len(ordinary)
    out = set()
    for g, k in a.items():
        q = (k + b[g]) / (n1 + n0)
        if k / n1 - b[g] / n0 >= least_z * np.sqrt(q * (1 - q) * (1 / n1 + 1 / n0)) > 0:
            out.add(g)
    return out


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; without dictionaries the score is ``prior``."""

    toxic: bytes = b""
    ordinary: bytes = b""
    weights: tuple[float, ...] = ()
    prior: float = 0.0
    _cached: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_cached": {}}

    def _compressors(self) -> tuple:
        if not self._cached:
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            for name, raw in (("t", self.ordinary + self.toxic), ("o", self.ordinary)):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                self._cached[name] = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress
        return self._cached["t"], self._cached["o"]

    def distances(self, wins: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        toxic, ordinary = self._compressors()
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in wins], np.float64)

    def features(self, text: str | None) -> np.ndarray:
        """Constant, greatest distances, distance of the most telling windows together, telling windows, all windows, mean."""
        wins = windows(text)
        d = self.distances(wins)
        best = np.argsort(-d, kind="stable")
        top = np.zeros(TOP)
        top[: len(best)] = d[best[:TOP]]
        joined = self.distances([b"".join(wins[i] for i in np.sort(best[:JOINED]))])[0] if wins else 0.0
        telling = d >= TELLING
        many = len(d) or 1
        return np.r_[1.0, top, joined, np.log1p(telling.sum()), 10 * telling.sum() / many, np.log1p(len(d)), min(d.sum() / many, 5.0)]

    def score(self, text: str | None) -> float:
        """Probability that the text is toxic."""
        if not self.weights:
            return self.prior
        z = float(np.clip(self.features(text) @ np.array(self.weights), -30, 30))
        return float(1 / (1 + np.exp(-z)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the rarer class weighs more, by the root of the odds."""
    w = np.zeros(x.shape[1])
    odds = max(1 - y.mean(), 1e-9) / max(y.mean(), 1e-9)
    mass = np.where(y == 1, np.sqrt(odds), 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (mass * (p - y)) + ridge * w
        h = (x * (mass * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def telling_stretches(toxic: list[str], ordinary: list[str], least_z: float) -> list[bytes]:
    """The telling words of each toxic document, in order, four at a time."""
    typical = typical_grams(toxic, ordinary, least_z)
    out = []
    for t in toxic:
        told = [w for w in lower_words(t) if word_grams(w) & typical]
        out += [b" " + b" ".join(told[i : i + 4]) + b" " for i in range(0, len(told), 4)]
    return out


def calibrated(model: Model, toxic: list[str], ordinary: list[str]) -> tuple[float, Model]:
    """The model with weights fitted to documents of both kinds, after its log-loss (mean of each kind, added)."""
    x = np.array([model.features(t) for t in toxic + ordinary])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    w = logistic(x, y)
    margin = np.where(y == 1, 1, -1) * (x @ w)
    loss = np.logaddexp(0, -margin)
    return float(loss[y == 1].mean() + loss[y == 0].mean()), Model(model.toxic, model.ordinary, tuple(w.tolist()))


def fit(toxic: list[str], ordinary: list[str], base: int = 32768, own: int = 1024, least_z: tuple[float, ...] = (4.0, 7.0), orders: int = 4, tried: int = 600, seed: int = 11) -> Model:
    """Train the dictionaries (``base`` and ``own`` bytes) and calibrate on the same documents.

    Training a dictionary depends on the order of its samples.  So one is trained for every ``least_z`` and each of
    ``orders`` random orders, and that of least log-loss on ``tried`` documents of each kind is taken.
    """
    total = len(toxic) + len(ordinary)
    if not toxic or not ordinary:
        return Model(prior=len(toxic) / total if total else 0.0)
    plain = dictionary([w for t in ordinary for w in windows(t)], base, 32)
    rng, found = np.random.default_rng(seed), []
    for z in least_z:
        samples = telling_stretches(toxic, ordinary, z)
        for _ in range(orders):
            content = dictionary([samples[i] for i in rng.permutation(len(samples))], own, 64)
            found.append(calibrated(Model(content, plain), toxic[:tried], ordinary[:tried]))
    return calibrated(min(found, key=lambda f: f[0])[1], toxic, ordinary)[1]


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_toxic: int, most_ordinary: int) -> tuple[list[str], list[str]]:
    """Texts of labelled documents that aren't held out, toxic and ordinary, in the order of their ids' MD5; one an id."""
    order = F.md5(F.col("label_id").cast("string").cast("binary"))
    marks = labels.select(F.col(id_col).alias("label_id"), F.col("toxic").alias("mark"))
    known = marks.where(F.col("mark").isNotNull() & F.col("label_id").isNotNull() & ~held_out("label_id")).groupBy("label_id").agg(F.max("mark").alias("mark"))
    chosen = [known.where(F.col("mark") == k).orderBy(order).limit(n) for k, n in ((1, most_toxic), (0, most_ordinary))]
    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("text"))
    met = texts.join(F.broadcast(chosen[0].union(chosen[1])), F.col("own_id") == F.col("label_id"))
    rows = met.groupBy("label_id", "mark").agg(F.min("text").alias("text")).collect()  # at most most_toxic + most_ordinary rows
    rows = sorted(rows, key=lambda r: hashlib.md5(str(r.label_id).encode()).hexdigest())
    return [r.text or "" for r in rows if r.mark == 1], [r.text or "" for r in rows if r.mark != 1]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_toxic: int = 2000, most_ordinary: int = 3000) -> Model:
    """Fit on a bounded sample of labelled documents."""
    return fit(*sample(docs, labels, id_col, text_col, most_toxic, most_ordinary))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Rows that no fit sees: crc32 of the id, modulo 5, is 0."""
    return crc_bucket(id_col, 5) == 0


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few KB, whatever the corpus

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = np.array([m.score(t.as_py()) for t in b.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], ["doc_id", "score"])

    return rows.mapInArrow(each, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
