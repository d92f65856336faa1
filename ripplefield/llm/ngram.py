"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the scorers.

Counting
    Every task hashes its words to 64 bits, counts a batch with numpy and ships sorted, delta-coded blobs
    dealt to shards, so what is shuffled has been combined before and no row is a single token.
    Word shards are ranges of the hash; a word's id is its rank among all sorted hashes.  Bigrams are exact
    keys ``left * (V + 2) + right``, dealt by left word and, salted, by right word, so that a left word that
    holds a third of all tokens spreads over a sixteenth of the shards, ``SALT`` at least.  From the bigram types follow, in the same
    pass, the statistics of left words (total, N1, N2, N3+) and the continuation counts of right words.

Model
    Sorted hash arrays in files of the shared folder: word shards (hash, count), bigram shards (key, count)
    and dense statistics by word id; counts beyond 32 bits widen their file.  Scorers map files as they need them,
    ``MOST_MAPS`` at a time, and search sorted queries in them, so the resident memory and the maps of a worker
    don't grow with the model.

Scores are sums of log10 probabilities over words and the end of each text.  Discounts are those of the
modified scheme, from counts of counts; where these are degenerate, a fixed absolute discount is taken.
Unknown words share the uniform part of the unigram distribution, so probabilities add up to one over the
vocabulary and the unknown word.

Defined cases: null and empty texts are scored for their end alone; an empty training set gives uniform
probabilities over nothing known (probability 1 for the unknown class); repeated rows are counted and
scored each; very long texts are read in slices; an empty table gives no rows; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import functools
import mmap
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.llm.common import cut, shared_path, slices

#: Hash of the end token and of the start context; with their spaces they are no words.
END = xxhash.xxh64_intdigest(b" end")
#: Sub-shards of one left word, at least.
SALT = 8
#: Files that a worker maps at a time, and tasks that merge shards, at most.
MOST_MAPS, MOST_TASKS = 4096, 20_000
#: In the header of a file: its 32-bit arrays are stored with 64 bits.
WIDE = 1 << 63
#: Tokens counted at a time.
CHUNK = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words with A-Z lower-cased; bytes.split() parts exactly at the six ASCII white spaces."""
    digest, out = xxhash.xxh64_intdigest, []
    for piece in slices(text.encode("utf-8", "surrogatepass").lower()) if text else ():
        w = piece.split()
        out.append(np.fromiter(map(digest, w), np.uint64, len(w)))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint64)


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text closed by the end token, and the tokens of each text."""
    out, sizes = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = word_hashes(t)
        h = np.empty(len(w) + 1, np.uint64)
        h[:-1], h[-1] = w, END
        out.append(h)
        sizes[i] = len(h)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), sizes


def text_chunks(batches: Iterator[pa.RecordBatch], column: int, most_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of batches with their texts, of about ``most_chars`` characters each (at least one text)."""
    for b in batches:
        start, texts, size = 0, [], 0
        for i, t in enumerate(b.column(column)):
            texts.append(t.as_py())
            size += len(texts[-1] or "")
            if size >= most_chars:
                yield b.slice(start, i + 1 - start), texts
                start, texts, size = i + 1, [], 0
        if texts:
            yield b.slice(start), texts


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys as deltas, with parallel counts, byte planes compressed."""
    planes = [np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()]
    planes += [v.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for v in values]
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(1).compress(b"".join(planes))


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    """Inverse of ``pack``: keys and ``columns - 1`` counts."""
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=max(1, 8 * n * columns)), np.uint8)
    cols = [np.ascontiguousarray(raw[k * 8 * n : (k + 1) * 8 * n].reshape(8, n).T).view("<u8").ravel() for k in range(columns)]
    return [np.cumsum(cols[0], dtype=np.uint64), *cols[1:]]


def merged(blobs: Iterator[bytes], columns: int) -> list[np.ndarray]:
    """Sum the counts of equal keys over blobs; sorted."""
    parts = [unpack(b, columns) for b in blobs]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return [keys[first]] + [np.add.reduceat(np.concatenate([p[k] for p in parts])[order], first) if len(first) else keys for k in range(1, columns)]


def shard_rows(shard: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """One row a shard: its number and packed keys; keys come sorted."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(shard)].astype(np.int64)
    blobs = [pack(keys[order[a:b]], *(v[order[a:b]] for v in values)) for a, b in zip(cuts, ends, strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(shard[cuts].astype(np.int64)), pa.array(blobs, pa.binary())], ["shard", "blob"])


class Mapped:
    """A file of an unsigned header count and parallel arrays, mapped read-only."""

    def __init__(self, path: str, kinds: tuple[str, ...]):
        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            if n & WIDE:
                n, kinds = n - WIDE, tuple(k.replace("u4", "u8") for k in kinds)
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
        at, self.arrays = 8, []
        for kind in kinds:
            self.arrays.append(np.frombuffer(self.map, kind, n, at))
            at += n * np.dtype(kind).itemsize
            at += -at % 8


def write_arrays(path: str, *arrays: np.ndarray, narrow: bool = False) -> None:
    """Write for ``Mapped``; renamed when complete, so a repeated task can't leave a torn file.

    ``narrow``: all arrays after the first are stored with 32 bits, or if some value needs more, with 64.
    """
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    wide = narrow and any(len(a) and int(a.max()) >> 32 for a in arrays[1:])
    if narrow:
        arrays = (arrays[0], *(a.astype("<u8" if wide else "<u4") for a in arrays[1:]))
    with open(part, "wb") as f:
        f.write((len(arrays[0]) + WIDE * wide).to_bytes(8, "little"))
        at = 8
        for a in arrays:
            f.write(np.ascontiguousarray(a).data if len(a) else b"")
            at += a.nbytes
            f.write(b"\0" * (-at % 8))
            at += -at % 8
    os.replace(part, path)


@dataclass(frozen=True)
class Model:
    """Where a model lies, its sizes, and its discounts; small, so it travels in closures."""

    path: str
    word_shards: int
    starts: tuple[int, ...]  # id of the first word of each shard, and the vocabulary size
    tokens: int
    bigram_shards: int
    salt: int
    stat_range: int
    discounts: tuple[float, float, float]
    unigram_discounts: tuple[float, float, float]
    types: int
    uniform: float  # unigram mass left to the uniform distribution

    @property
    def vocabulary(self) -> int:
        return self.starts[-1]


@functools.lru_cache(maxsize=MOST_MAPS)
def mapped(path: str, kinds: tuple[str, ...]) -> Mapped:
    """The file, mapped while it is among those used last."""
    return Mapped(path, kinds)


class Vocabulary:
    """Mapped word shards."""

    def __init__(self, path: str, shards: int, starts: tuple[int, ...]):
        self.path, self.shards, self.starts = path, shards, starts

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bounds = np.searchsorted(shard_of_hash(hashes, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(bounds[:-1] < bounds[1:]).tolist():
            a, b = bounds[s], bounds[s + 1]
            held, count = mapped(f"{self.path}/words-{s}", ("<u8", "<u8")).arrays
            if not len(held):
                continue
            at = np.minimum(np.searchsorted(held, hashes[a:b]), len(held) - 1)
            hit = held[at] == hashes[a:b]
            ids[a:b] = np.where(hit, at + self.starts[s], -1)
            counts[a:b] = np.where(hit, count[at], 0)
        return ids, counts


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, shards: int, starts: tuple[int, ...]) -> Vocabulary:
    """The mapped vocabulary of this process."""
    return Vocabulary(path, shards, starts)


def shard_of_hash(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash: monotone, so that shards in order are sorted over all."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def shard_of_bigram(left: np.ndarray, right: np.ndarray, shards: int, salt: int) -> np.ndarray:
    """By left word, salted by right word."""
    part = ((right.astype(np.uint64) * MIX) >> np.uint64(40)) % np.uint64(salt)
    return (((left.astype(np.uint64) * np.uint64(salt) + part) * MIX) >> np.uint64(24)) % np.uint64(shards)


def look_up(vocab: Vocabulary, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of hashes in any order, repeats included."""
    distinct, back = np.unique(hashes, return_inverse=True)
    ids, counts = vocab.find(distinct)
    return ids[back], counts[back]


def left_of(ids: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The word before each token; the start context before the first of a text."""
    left = np.empty_like(ids)
    left[1:] = ids[:-1]
    left[np.cumsum(sizes) - sizes] = start
    return left


def train(docs: DataFrame, text_col: str = "text", tokens_per_shard: int = 2_000_000) -> Model:
    """Count a corpus and write the model to the shared folder."""
    spark = docs.sparkSession
    path = shared_path(spark, "ngram")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    word_shards = max(8, -(-chars // (32 * tokens_per_shard)))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return shard_rows(shard_of_hash(keys, word_shards), keys, counts)

        for _, chunk in text_chunks(batches, 0):
            held.append(token_hashes(chunk)[0])
            if sum(map(len, held)) >= CHUNK:
                yield flush()
        if held:
            yield flush()

    def write_words(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["shard"].iloc[0])
        keys, counts = merged(pdf["blob"], 2)
        write_arrays(f"{path}/words-{s}", keys, counts)
        return pd.DataFrame({"shard": [s], "n": [len(keys)], "tokens": [int(counts.sum())]})

    found = texts.mapInArrow(count_words, "shard long, blob binary").repartition(min(word_shards, MOST_TASKS), "shard").groupBy("shard").applyInPandas(write_words, "shard long, n long, tokens long").collect()
    sizes = np.zeros(word_shards, np.int64)
    for r in found:
        sizes[r.shard] = r.n
    for s in np.flatnonzero(sizes == 0):
        write_arrays(f"{path}/words-{s}", np.empty(0, "<u8"), np.empty(0, "<u8"))
    starts = tuple(np.r_[0, np.cumsum(sizes)].tolist())
    tokens, v = sum(r.tokens for r in found), int(sizes.sum())
    shards = max(8, -(-tokens // tokens_per_shard))
    salt = max(SALT, shards // 16)
    stat_range = max(1, -(-(v + 1) // max(1, shards // 2)))

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, held = vocabulary(path, word_shards, starts), []

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            left, right = keys // np.uint64(v + 2), keys % np.uint64(v + 2)
            return shard_rows(shard_of_bigram(left, right, shards, salt), keys, counts)

        for _, chunk in text_chunks(batches, 0):
            hashes, lengths = token_hashes(chunk)
            ids, _ = look_up(vocab, hashes)
            held.append(left_of(ids, lengths, v).astype(np.uint64) * np.uint64(v + 2) + ids.astype(np.uint64))
            if sum(map(len, held)) >= CHUNK:
                yield flush()
        if held:
            yield flush()

    def write_bigrams(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["shard"].iloc[0])
        keys, counts = merged(pdf["blob"], 2)
        write_arrays(f"{path}/bigrams-{s}", keys, counts, narrow=True)
        left, right = keys // np.uint64(v + 2), keys % np.uint64(v + 2)
        first = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
        one, two = counts == 1, counts == 2
        per_left = [np.add.reduceat(x.astype(np.uint64), first) for x in (counts, one, two, counts > 2)]
        words_right, types = np.unique(right, return_counts=True)
        of_counts = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        rows = [(-1, -1, b"", len(keys), *of_counts)]
        for kind, ids, values in ((0, left[first], per_left), (1, words_right, [types])):
            batch = shard_rows(ids // np.uint64(stat_range), ids, *values)
            rows += [(k, kind, b, 0, 0, 0, 0, 0) for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        return pd.DataFrame(rows, columns=["range", "kind", "blob", "types", "n1", "n2", "n3", "n4"])

    schema = "range long, kind int, blob binary, types long, n1 long, n2 long, n3 long, n4 long"
    counted = texts.mapInArrow(count_bigrams, "shard long, blob binary").repartition(min(shards, MOST_TASKS), "shard")
    stats = cut(counted.groupBy("shard").applyInPandas(write_bigrams, schema))
    total = stats.where("range < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "n1", "n2", "n3", "n4"))).first()

    def write_stats(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["range"].iloc[0])
        dense = [np.zeros(stat_range, "<u8") for _ in range(5)]
        lefts = pdf["blob"][pdf["kind"] == 0]
        if len(lefts):
            ids, *values = merged(lefts, 5)
            for d, x in zip(dense, values, strict=False):
                d[ids.astype(np.int64) - r * stat_range] = x
        rights = pdf["blob"][pdf["kind"] == 1]
        if len(rights):
            ids, types = merged(rights, 2)
            dense[4][ids.astype(np.int64) - r * stat_range] = types
        write_arrays(f"{path}/stats-{r}", *dense, narrow=True)
        return pd.DataFrame([(r, *(int((dense[4] == k).sum()) for k in (1, 2, 3, 4)), int((dense[4] > 2).sum()))], columns=["range", "m1", "m2", "m3", "m4", "more"])

    ranges = stats.where("range >= 0").groupBy("range").applyInPandas(write_stats, "range long, m1 long, m2 long, m3 long, m4 long, more long").collect()
    m = [sum(r[k] for r in ranges) for k in range(1, 6)]
    discounts, below = estimate(total.n1, total.n2, total.n3, total.n4), estimate(*m[:4])
    types = int(total.types)
    free = (below[0] * m[0] + below[1] * m[1] + below[2] * m[4]) / types if types else 1.0
    missing = set(range(shards)) - {int(f.split("-")[1]) for f in os.listdir(path) if f.startswith("bigrams-") and "." not in f}
    for s in missing:
        write_arrays(f"{path}/bigrams-{s}", np.empty(0, "<u8"), np.empty(0, "<u4"))
    return Model(path, word_shards, starts, tokens, shards, salt, stat_range, discounts, below, types, free)


def estimate(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of the modified scheme from counts of counts; 0.5 each where undefined."""
    if min(n1, n2, n3) == 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(float(min(max(d, 0.05), k)) for k, d in zip((0.95, 1.95, 2.95), raw, strict=True))


class Scorer:
    """Looks up probabilities in a mapped model."""

    def __init__(self, model: Model):
        self.m = model
        self.vocab = vocabulary(model.path, model.word_shards, model.starts)
        self.ranges = -(-(model.vocabulary + 1) // model.stat_range)

    def statistics(self, ids: np.ndarray) -> list[np.ndarray]:
        """Left total, N1, N2, N3+ and continuation count of sorted ids; zeros for -1."""
        out = [np.zeros(len(ids)) for _ in range(5)]
        r = self.m.stat_range
        bounds = np.searchsorted(ids, np.arange(self.ranges + 1) * r)
        for k in np.flatnonzero(bounds[:-1] < bounds[1:]).tolist():
            a, b, path = bounds[k], bounds[k + 1], f"{self.m.path}/stats-{k}"
            if os.path.exists(path):  # a range that no word of a bigram falls into has no file
                for o, x in zip(out, mapped(path, ("<u8", "<u4", "<u4", "<u4", "<u4")).arrays, strict=True):
                    o[a:b] = x[ids[a:b] - k * r]
        return out

    def counts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Counts of distinct bigrams given as ids (-1: unknown)."""
        out = np.zeros(len(left), np.int64)
        known = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[known].astype(np.uint64) * np.uint64(self.m.vocabulary + 2) + right[known].astype(np.uint64)
        shard = shard_of_bigram(left[known], right[known], self.m.bigram_shards, self.m.salt)
        order = np.lexsort((key, shard))
        bounds = np.searchsorted(shard[order], np.arange(self.m.bigram_shards + 1))
        for s in np.flatnonzero(bounds[:-1] < bounds[1:]).tolist():
            pick = order[bounds[s] : bounds[s + 1]]
            held, count = mapped(f"{self.m.path}/bigrams-{s}", ("<u8", "<u4")).arrays
            if len(held):
                at = np.minimum(np.searchsorted(held, key[pick]), len(held) - 1)
                out[known[pick]] = np.where(held[at] == key[pick], count[at], 0)
        return out

    def discount(self, c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.select([c <= 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2])

    def log10(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of every token in its context."""
        m, v = self.m, self.m.vocabulary
        left = left_of(ids, sizes, v)
        distinct, back = np.unique(np.concatenate([ids, left]), return_inverse=True)
        total, n1, n2, n3, cont = self.statistics(distinct)
        base = m.uniform / (v + 1) + np.maximum(cont - self.discount(cont, m.unigram_discounts), 0) / max(m.types, 1)
        d = m.discounts
        with np.errstate(divide="ignore", invalid="ignore"):
            free = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / total, 1.0)
        i, j = back[: len(ids)], back[len(ids) :]
        pair = j.astype(np.int64) * len(distinct) + i
        pairs, where = np.unique(pair, return_inverse=True)
        pl, pr = pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)
        c = self.counts(distinct[pl], distinct[pr])
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.where(total[pl] > 0, (c - self.discount(c, d)) / total[pl], 0.0)
        return np.log10(np.maximum(seen, 0) + free[pl] * base[pr])[where]


@functools.lru_cache(maxsize=2)
def scorer(model: Model) -> Scorer:
    """The mapped model of this process."""
    return Scorer(model)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, tokens, known tokens, additive-smoothing base score and the model's log10 probability.

    ``extra`` columns are carried along.  Perplexity is ``10 ** (-score / n_tokens)``.
    """
    extra = extra or {}
    rows = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in extra.items()), F.col(text_col).cast("string").alias("text"))
    kept = len(extra) + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(model)
        floor = np.log10(model.tokens + 0.5 * (model.vocabulary + 1))
        for b, chunk in text_chunks(batches, kept):
            hashes, sizes = token_hashes(chunk)
            ids, counts = look_up(s.vocab, hashes)
            first = np.cumsum(sizes) - sizes
            per = lambda x: np.add.reduceat(x, first)  # noqa: B023,E731
            out = [sizes, per((counts > 0).astype(np.int64)), per(np.log10(counts + 0.5) - floor), per(s.log10(ids, sizes))]
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *map(pa.array, out)], [*b.schema.names[:kept], "n_tokens", "n_known", "base_score", "score"])

    kinds = dict(rows.dtypes)
    front = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns[:kept])
    return rows.mapInArrow(each, f"{front}, n_tokens long, n_known long, base_score double, score double")
