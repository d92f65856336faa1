"""The exact rest of SimHash near-dedup: pairs of word-shingle sets at or above a Jaccard similarity.

Fingerprints within a few bits can't reach all pairs of similarity 0.8 (see the README for figures), so the
operator of ``simhash`` that works by similarity verifies its candidates here and adds, by a set-similarity
join on prefixes, the pairs that no fingerprint leads to.  With the shingles of every set in one common order,
two sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of each, and the smaller
one has its first shared shingle among n - ceil(2t / (1 + t) n) + 1 already.  Only these prefixes are shuffled,
once.  Any common order gives the same result; frequent shingles are put last, so that common passages seldom
lead to candidates.  The frequency is that of one of ``CELLS`` cells that all shingles of all texts are counted
into: a table of fixed size, summed in slices of it by tasks that stream their parts.

Sets that share a prefix shingle form a bucket.  Every member is first verified against the bucket's leader (of
the earliest place, so rather an original than its edited copies); after that only pairs across components are
left, and these are formed and verified in full.  Within a token they meet by bands of size, so that a frequent
shingle is split by the lengths of its sets.  Pairs are dropped unverified only if their sizes, the positions of
the shared shingle or their sketches rule the threshold out.  A sketch counts a set's shingles in one byte a
bucket, four to eight shingles each; the sum of the lesser counts bounds the number of shared shingles from above.

Defined cases: null and empty texts have the empty set and equal each other; texts with fewer words than a
shingle have their whole word sequence as the one shingle; equal sets share a key and need no pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.llm.common import cut, slices
from ripplefield.llm.components import components

#: Cells of the table of frequencies, and cells of one slice of it.
CELLS, SLICE = 1 << 22, 1 << 12


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles (ASCII case and white space only)."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    digest = xxhash.xxh64_intdigest
    words = np.fromiter((digest(w, 42) for s in slices(raw) for w in s.split()), np.uint64)
    if not len(words):
        return words
    width = min(width, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def key_of(shingles: np.ndarray) -> int:
    """A signed long that stands for the whole set."""
    value = xxhash.xxh3_64_intdigest(shingles.astype("<u8").tobytes(), 7)
    return value - (1 << 64) if value >= 1 << 63 else value


def sketch(shingles: np.ndarray) -> bytes:
    """Shingles in each of a power of two of buckets, as bytes; 255 stands for any number from there on."""
    buckets = 1 << (max(len(shingles) - 1, 0) // 8).bit_length()
    at = (shingles >> np.uint64(32)) & np.uint64(buckets - 1)
    return np.minimum(np.bincount(at.astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def most_shared(one: bytes, other: bytes) -> int:
    """A number that two sets' shared shingles can't exceed; the finer sketch is folded to the coarser one."""
    u, v = (np.frombuffer(z, np.uint8).astype(np.int64) for z in (one, other))
    n = min(len(u), len(v))
    u, v = (np.where(z == 255, 1 << 40, z).reshape(-1, n).sum(axis=0) for z in (u, v))
    return int(np.minimum(u, v).sum())


def _ceil(share: Fraction, n: int) -> int:
    return -(-share.numerator * n // share.denominator)


def prefix(shingles: np.ndarray, threshold: Fraction, classes: np.ndarray) -> np.ndarray:
    """The first shingles of a set by (class of frequency, hash), as many as a similar set has to share one of."""
    size = len(shingles) - _ceil(threshold, len(shingles)) + 1 if len(shingles) else 0
    return shingles[np.argsort(classes[cell_of(shingles, len(classes))], kind="stable")[:size]]


def cell_of(shingles: np.ndarray, cells: int) -> np.ndarray:
    """The cell that each shingle is counted in; ``cells`` is a power of two."""
    return (shingles & np.uint64(cells - 1)).astype(np.int64)


def frequency_classes(texts: DataFrame, width: int, cells: int = CELLS) -> np.ndarray:
    """Bits of the number of shingles in each cell, over all texts; a table of fixed size, which reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(cells, np.uint32)
        for b in batches:
            for t in b.column(0):
                held[cell_of(shingle_set(t.as_py(), width), cells)] += 1  # a cell twice in one set counts once
        slices = held.reshape(-1, SLICE)
        some = np.flatnonzero(slices.any(axis=1))
        deflate = zstandard.ZstdCompressor(1).compress
        blobs = [deflate(slices[k].view(np.uint8).reshape(-1, 4).T.tobytes()) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], ["slice", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        inflate = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                planes = np.frombuffer(inflate(blob.as_py()), np.uint8).reshape(4, SLICE)
                sums[k] = sums.get(k, 0) + np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        bits = [np.ceil(np.log2(c + 1)).astype(np.uint8).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], ["slice", "bits"])

    out = np.zeros((cells // SLICE, SLICE), np.uint8)
    for r in texts.mapInArrow(count, "slice int, counts binary").repartition("slice").mapInArrow(total, "slice int, bits binary").collect():
        out[r.slice] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _prefixes(texts: DataFrame, width: int, threshold: Fraction, classes: np.ndarray) -> DataFrame:
    """``(token, key, place)`` of the prefix of every text, place holding size and position; equal sets of a batch once."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)  # a fixed size, whatever the corpus

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done: set[int] = set()
            for at in range(0, b.num_rows, 256):
                cols = [[np.empty(0, np.int64)] for _ in range(3)]
                for t in b.column(0).slice(at, 256):
                    s = shingle_set(t.as_py(), width)
                    key = key_of(s)
                    if key in done:
                        continue
                    done.add(key)
                    p = prefix(s, threshold, shared.value)
                    for c, x in zip(cols, (p.view(np.int64), np.full(len(p), key), (len(s) << 32) + np.arange(len(p))), strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["token", "key", "place"])

    return texts.mapInArrow(each, "token long, key long, place long")


def keys(docs: DataFrame, text_col: str = "text", width: int = 5, name: str = "key") -> DataFrame:
    """``docs`` with the key of every row's shingle set."""

    @F.pandas_udf("long")
    def key(texts):
        return texts.map(lambda t: key_of(shingle_set(t, width)))

    return docs.withColumn(name, key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def _possible(x: Column, y: Column, t: Fraction) -> Column:
    """Whether sizes and positions of a first shared shingle allow the threshold."""
    p, q = t.numerator, t.denominator
    most = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    return _sizes(x, y, t) & ((p + q) * most >= p * (x["n"] + y["n"]))


def _sizes(x: Column, y: Column, t: Fraction) -> Column:
    return (t.denominator * F.least(x["n"], y["n"])) >= t.numerator * F.greatest(x["n"], y["n"])


def _candidates(met: DataFrame, x: Column, y: Column, t: Fraction) -> DataFrame:
    """Pairs ``(a, b)`` of the rows' two members that share enough prefix shingles here, once each."""
    p, q = t.numerator, t.denominator
    first = x["key"] < y["key"]
    pick = lambda u, v, c: F.when(first, u[c]).otherwise(v[c])
    rows = met.where(_sizes(x, y, t)).select(
        pick(x, y, "key").alias("a"), pick(y, x, "key").alias("b"), (x["n"] + y["n"]).alias("both"), F.greatest(x["n"], y["n"]).alias("most"), _possible(x, y, t).alias("possible")
    )
    rows = rows.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("both").alias("both"), F.max("most").alias("most"), F.max("possible").alias("possible"))
    suffix = F.ceil(F.lit(p) * F.col("most") / F.lit(q)).cast("long")  # one more than the suffix, to be safe against rounding
    return rows.where(F.col("possible") & ((p + q) * (F.col("c") + suffix) >= p * F.col("both"))).select("a", "b")


def screened(pairs: DataFrame, sketches: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs ``(a, b)`` of keys whose sketches ``(key, n, sketch)`` leave the threshold possible."""
    p, q = threshold.numerator, threshold.denominator
    left, right = (sketches.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)
            keep = [(p + q) * most_shared(u, v) >= p * (m + n) for m, n, u, v in rows]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
    return joined.mapInArrow(each, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs ``(a, b)`` of keys whose sets ``(key, shingles)`` reach the threshold."""
    p, q = threshold.numerator, threshold.denominator
    left, right = (sets.select(F.col("key").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(q * both >= p * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(each, "a long, b long")


def ends(pairs: DataFrame) -> DataFrame:
    """The distinct keys of pairs."""
    return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def links(
    texts: DataFrame,
    sets: Callable[[DataFrame], DataFrame],
    guessed: DataFrame | None = None,
    sketches: DataFrame | None = None,
    width: int = 5,
    threshold: Fraction = Fraction(4, 5),
    cells: int = CELLS,
) -> DataFrame:
    """Edges ``(a, b)`` between keys; they connect all sets whose similarity reaches the threshold.

    ``texts`` has the column ``text``; ``sets`` gives ``(key, shingles)`` of the keys in a frame; ``guessed`` are
    candidates ``(a, b)`` found by other means; ``sketches`` has ``(key, n, sketch)`` of all sets, and spares most of
    the unlike pairs the verification.
    """
    held = _prefixes(texts, width, threshold, frequency_classes(texts, width, cells)).repartition("token")  # the one exchange of prefixes
    p, q = threshold.numerator, threshold.denominator
    screen = lambda pairs: pairs if sketches is None else screened(pairs, sketches, threshold)
    rows = held.select("token", "key", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"))
    item = F.struct("key", "n", "pos")
    stats = rows.groupBy("token").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.min_by(item, F.struct("pos", "key")).alias("lead"))
    met = cut(rows.join(stats.where("first != last").select("token", "lead"), "token").distinct())
    stars = _candidates(met.where("key != lead.key").select(item.alias("x"), F.col("lead").alias("y")), F.col("x"), F.col("y"), threshold)
    if guessed is not None:
        stars = stars.union(guessed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b"))
    stars = cut(stars.distinct())
    likely = cut(screen(stars))
    found = cut(verified(likely, sets(ends(likely)), threshold))

    roots = components(found).withColumnRenamed("node", "key")
    parts = met.join(roots, "key", "left").select("token", F.coalesce("root", "key").alias("root"), item.alias("x"))
    several = parts.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("token")
    parts = cut(parts.join(several, "token"))
    # the smaller set of a pair has its first shared shingle at pos <= n - 2t / (1 + t) n
    early = (p + q) * (F.col("x.n") - F.col("x.pos")) >= 2 * p * F.col("x.n")
    # a little wider than the threshold, so that rounding leaves the larger set in the band of the smaller or the next
    band = F.floor(F.log(F.greatest(F.col("x.n"), F.lit(1))) / float(np.log(1.001 / float(threshold)))).cast("int")
    x = parts.where(early).select("token", F.col("root").alias("root_x"), "x", F.explode(F.array(band, band + 1)).alias("band"))
    y = parts.select("token", F.col("root").alias("root_y"), F.col("x").alias("y"), band.alias("band"))
    fits = (F.col("root_x") != F.col("root_y")) & (F.col("x.n") <= F.col("y.n")) & _possible(F.col("x"), F.col("y"), threshold)
    across = x.join(y, ["token", "band"]).where(fits).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    across = cut(screen(cut(across.join(stars, ["a", "b"], "left_anti"))))
    return found.union(verified(across, sets(ends(across)), threshold))


def near_duplicates(docs: DataFrame, text_col: str = "text", width: int = 5, threshold: Fraction = Fraction(4, 5), cells: int = CELLS) -> DataFrame:
    """``(node, root)`` of every key that is linked to another; keys are those of ``keys``."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def sets(wanted: DataFrame) -> DataFrame:
        rows = keys(texts, "text", width).join(wanted, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
        return cut(rows.select("key", packed(width)("text").alias("shingles")))

    return components(links(texts, sets, None, None, width, threshold, cells))


def packed(width: int):
    """A text's shingle set as bytes."""

    @F.pandas_udf("binary")
    def one(found):
        return found.map(lambda t: shingle_set(t, width).astype("<u8").tobytes())

    return one
