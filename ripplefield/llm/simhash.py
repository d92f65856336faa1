"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints (64 bits) link if they differ in ``radius`` bits or fewer.  With the bits dealt into m
parts, two linked fingerprints agree within t_i bits on some part i whenever the thresholds add up to
``radius - m + 1`` (a threshold of -1 leaves its part out).  The plan is made from statistics of all
distinct fingerprints:

* correlated bits are grouped (64 x 64 co-occurrence counts, a fixed size whatever the corpus);
* for every m a dynamic program over the parts finds the thresholds of least estimated cost, that is
  probe rows plus candidate pairs; the estimate follows the chance that a pair agrees along a chain of
  bits, so correlation counts; the cheapest m wins.

Each distinct fingerprint then probes its part values within t_i bits, and candidates that meet in a
bucket are verified.  Exact copies and equal fingerprints meet before that in one aggregation.  Buckets
beyond ``bucket`` fingerprints are not paired: their members go to an exact path that is linear in
them.  Each emits its 65 keys at distance 0 or 1; for a radius of 2 two fingerprints link exactly if
they share such a key, and a key has at most 65 distinct fingerprints.  No link is lost either way.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts with fewer words
than a shingle use their whole word sequence; repeated rows share a component; a component of null ids
only has a null id; very long texts are hashed in slices; an empty table gives no rows; other columns are not read.

``one_of_each`` works by similarity instead of bits: texts whose sets of 5-word shingles reach a Jaccard
similarity of 0.8 are linked.  Candidates are probed as above over fingerprints of the sets and verified by
their sets; ``jaccard`` adds exactly what fingerprints within the radius don't reach.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.llm import jaccard
from ripplefield.llm.common import content_hash, cut, fresh, slices
from ripplefield.llm.components import components

BITS = 64
#: Shingles hashed at a time, so that a very long text stays in bounded memory.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text: a bit is set if it is set in over half of the shingles' hashes."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: ASCII case and white space only
    words = itertools.chain.from_iterable(s.split() for s in slices(raw))
    head = list(itertools.islice(words, width))
    if not head:
        return 0
    runs = itertools.tee(itertools.chain(head, words), width)
    for k, run in enumerate(runs):
        next(itertools.islice(run, k, k), None)
    shingles = map(b" ".join, zip(*runs, strict=False)) if len(head) == width else iter([b" ".join(head)])
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, 42) for s in itertools.islice(shingles, CHUNK)], "<u8") for _ in itertools.count())


def majority(chunks: Iterator[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes; the first empty chunk ends them."""
    ones, n = np.zeros(BITS, np.int64), 0
    for chunk in chunks:
        if not len(chunk):
            break
        n += len(chunk)
        bits = np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of every row as a signed long; one pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(each, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


@dataclass(frozen=True)
class Plan:
    """Bits of each part and the threshold of each (-1: the part is not probed)."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both of each pair of bits; 4,097 rows reach the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                x = b.column(0).slice(at, CHUNK).to_numpy(zero_copy_only=False).astype("<i8")
                bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(x)
        if n:
            counts = np.append(both.ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts)], ["k", "c"])

    rows = fps.select("fp").mapInArrow(each, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(BITS * BITS + 1)
    for r in rows:
        counts[r.k] = r.c
    return int(counts[-1]), counts[:-1].reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, m: int) -> tuple[tuple[int, ...], ...]:
    """Deal the bits into m parts of nearly equal width, correlated bits together."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, parts = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        part = [max(left, key=lambda i: (corr[i, left].max(), -i))]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda i: (corr[i, part].mean(), -i)))  # noqa: B023
            left.remove(part[-1])
        parts.append(tuple(part))
    return tuple(parts)


def agreement(part: tuple[int, ...], both: np.ndarray, n: int, most: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most t bits of a part, for t = 0..most."""
    share = both / max(n, 1)

    def joint(i: int, j: int) -> np.ndarray:
        x, a, b = share[i, j], share[i, i], share[j, j]
        q = np.array([max(1 - a - b + x, 0), max(b - x, 0), max(a - x, 0), x])
        return q**2, q

    a = lambda i: share[i, i] ** 2 + (1 - share[i, i]) ** 2
    chance = np.zeros(most + 1)
    first = a(part[0])
    chance[0] = first
    if most:
        chance[1] = 1 - first
    for i, j in itertools.pairwise(part):
        given = min(1.0, max(1e-9, joint(i, j)[0].sum() / max(a(i), 1e-9)))
        chance = chance * given + np.append(0, chance[:-1]) * (1 - given)
    return np.cumsum(chance).tolist()


def best_thresholds(costs: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Least cost over thresholds t_i >= -1 that add up to ``total``; ``costs[i][t + 1]``."""
    table = {0: (0.0, ())}
    for cost in costs:
        nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
        for s, (c, ts) in table.items():
            for t in range(-1, len(cost) - 1):
                if s + t not in nxt or c + cost[t + 1] < nxt[s + t][0]:
                    nxt[s + t] = (c + cost[t + 1], (*ts, t))
        table = nxt
    return table.get(total, (float("inf"), ()))


def make_plan(both: np.ndarray, n: int, radius: int = 2, most_parts: int = 5) -> Plan:
    """The parts and thresholds of least estimated cost."""
    best = (float("inf"), None)
    pairs = n * (n - 1) / 2
    for m in range(1, most_parts + 1):
        parts = group_bits(both, n, m)
        costs = []
        for part in parts:
            chance = agreement(part, both, n, radius)
            probes = np.cumsum([float(len(list(itertools.combinations(range(len(part)), t)))) for t in range(radius + 1)])
            costs.append([0.0] + [probes[t] * n + pairs * chance[t] for t in range(radius + 1)])
        cost, ts = best_thresholds(costs, radius - m + 1)
        if cost < best[0]:
            best = (cost, Plan(parts, ts))
    return best[1]


def _mask(bits: tuple[int, ...]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _probes(plan: Plan) -> Column:
    """Array of (part, value, own) for one fingerprint: its own part values and those within the threshold."""
    fp, out = F.col("fp"), []
    for i, (part, t) in enumerate(zip(plan.parts, plan.thresholds, strict=True)):
        if t < 0:
            continue
        flips = [_mask(c) for k in range(t + 1) for c in itertools.combinations(part, k)]
        masked = fp.bitwiseAND(F.lit(_mask(part)))
        out.append(F.array(*(F.struct(F.lit(i).alias("part"), masked.bitwiseXOR(F.lit(x)).alias("value"), F.lit(x == 0).alias("own")) for x in flips)))
    return F.concat(*out)


def links(fps: DataFrame, plan: Plan, radius: int = 2, bucket: int = 32) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints within ``radius`` bits (radius at most 2)."""
    if radius > 2:
        raise ValueError("the exact path for large buckets holds for a radius of at most 2")
    probes = fps.select("fp", F.explode(_probes(plan)).alias("p")).select("fp", "p.part", "p.value", "p.own")
    sizes = probes.groupBy("part", "value").agg(F.count("*").alias("size"), F.max("own").alias("held"))
    sizes = cut(sizes.where((F.col("size") > 1) & F.col("held")))
    met = probes.join(sizes, ["part", "value"])
    cold = met.where(F.col("size") <= bucket).groupBy("part", "value").agg(F.sort_array(F.collect_set("fp")).alias("s"))
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    pairs = F.flatten(
        F.transform("s", lambda x, i: F.transform(F.filter(F.slice("s", i + 2, F.size("s")), lambda y: close(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    near = cold.select(F.explode(pairs).alias("e")).select("e.a", "e.b")
    hot = met.where(F.col("size") > bucket).select("fp").distinct()
    return near.union(star_links(hot, radius))


def star_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """The same edges without pairing: distinct fingerprints meet at the points half-way between them.

    Two points at distance 2 or less share a point within distance 1 of both, and points that share one
    are at distance 2 or less.  For a radius of 1 the meeting edges are verified.
    """
    flips = F.array(*(F.lit(_mask((b,))).cast("long") for b in range(BITS)), F.lit(0).cast("long"))
    keys = fps.select("fp", F.explode(flips).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("z"))
    met = keys.groupBy("z").agg(F.collect_set("fp").alias("s")).where(F.size("s") > 1)
    if radius == 2:
        ends = met.select(F.array_min("s").alias("a"), F.explode("s").alias("b"))
        return ends.where("a != b").select("a", "b").distinct()
    near = met.select(F.explode("s").alias("a"), "z", "s").where(F.array_contains("s", F.col("z"))).select("a", F.col("z").alias("b"))
    return near.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, bucket: int = 32) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; the component's id is the least document id in it."""
    fps = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n, both = bit_counts(distinct)
    if n == 0:
        return fps.select("doc_id", "fp", F.col("doc_id").alias("component_id"))
    roots = components(links(distinct, make_plan(both, n, radius), radius, bucket))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = cut(joined)
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


#: A side of a join of more rows than this is not broadcast.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """Written once; marked for broadcast if its counted rows are few."""
    rows = cut(df)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def set_prints(docs: DataFrame, id_col: str, text_col: str, row_hash: Column, width: int) -> DataFrame:
    """``(doc_id, row, key, fp, n, sketch)`` of every row: hash of the row; key, fingerprint, size and sketch of its shingle set."""
    rows = docs.select(F.col(id_col).alias("doc_id"), row_hash.alias("row"), F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, fps = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.uint64)
            size, sketches = np.empty(b.num_rows, np.int64), []
            for i, t in enumerate(b.column(2)):
                s = jaccard.shingle_set(t.as_py(), width)
                keys[i], fps[i] = jaccard.key_of(s), majority(s[k : k + CHUNK] for k in range(0, len(s), CHUNK))
                size[i] = len(s)
                sketches.append(jaccard.sketch(s))
            cols = [b.column(0), b.column(1), pa.array(keys), pa.array(fps.view(np.int64)), pa.array(size), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "key", "fp", "n", "sketch"])

    return rows.mapInArrow(each, f"doc_id {dict(rows.dtypes)['doc_id']}, row long, key long, fp long, n long, sketch binary")


def probed(sets: DataFrame, radius: int = 2, bucket: int = 32) -> DataFrame:
    """Candidates ``(a, b)`` among sets ``(key, fp)``: equal fingerprints, and those within ``radius`` bits."""
    distinct = cut(sets.groupBy("fp").agg(F.min("key").alias("least")))
    n, both = bit_counts(distinct)
    equal = sets.join(distinct, "fp").select(F.col("least").alias("a"), F.col("key").alias("b")).where("a != b")
    if n == 0:
        return equal
    ends = links(distinct, make_plan(both, n, radius), radius, bucket)
    x, y = (distinct.select(F.col("fp").alias(c), F.col("least").alias(f"key_{c}")) for c in "ab")
    return equal.union(ends.join(x, "a").join(y, "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: Fraction = Fraction(4, 5),
    radius: int = 2,
    bucket: int = 32,
) -> DataFrame:
    """One row of every near-duplicate component, whole: the one of least id, then of least row hash.

    Rows are told apart by a hash of all their columns, never by their id alone: different texts of one id are
    documents of their own, and rows without an id join components like any other (an id goes before none).
    Of rows that are equal in every column one stays.  Texts move only if more than ``BROADCAST_ROWS`` rows go.
    """
    mark = fresh(docs, "row_hash")
    named = docs.withColumn(mark, content_hash(docs))
    prints = cut(set_prints(named, id_col, text_col, F.col(mark), width))
    copies = cut(prints.groupBy("doc_id", "row", "key", "fp").agg(F.count("*").alias("times")))
    one = cut(copies.groupBy("key", "fp").agg(F.min_by(F.struct("doc_id", "row"), "row").alias("at")))
    sketches = cut(prints.groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    def sets(wanted: DataFrame) -> DataFrame:
        spot = _small(one.join(wanted, "key").select(F.col("key").alias("set_key"), F.col("at.doc_id").alias("doc_id"), F.col("at.row").alias("row"))).alias("spot")
        slim = named.select(F.col(f"`{id_col}`").alias("at_id"), F.col(mark).alias("at_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
        met = slim.join(spot, F.col("at_row").eqNullSafe(F.col("spot.row")) & F.col("at_id").eqNullSafe(F.col("spot.doc_id")))
        rows = met.select(F.col("set_key").alias("key"), jaccard.packed(width)("text").alias("shingles"))
        return rows.groupBy("key").agg(F.first("shingles").alias("shingles"))

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    roots = components(jaccard.links(texts, sets, probed(one, radius, bucket), sketches, width, threshold)).withColumnRenamed("node", "key")
    rows = cut(copies.join(roots, "key", "left").select("doc_id", "row", "times", F.coalesce("root", "key").alias("root")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = rows.groupBy("root").agg(F.min(order).alias("best")).select(F.col("root").alias("best_root"), F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row"))
    # joined by the row as well as by its component, so that a large component is many keys
    won = (F.col("root") == F.col("best_root")) & F.col("row").eqNullSafe(F.col("best_row")) & F.col("doc_id").eqNullSafe(F.col("best_id"))
    judged = rows.join(best, won, "left").withColumn("stays", F.col("best_root").isNotNull())
    row, own, stays = (fresh(named, c) for c in ("judged_row", "judged_id", "judged_stays"))
    judged = _small(judged.where("not stays or times > 1").select(F.col("row").alias(row), F.col("doc_id").alias(own), F.col("stays").alias(stays)))
    same = F.col(mark).eqNullSafe(F.col(row)) & F.col(f"`{id_col}`").eqNullSafe(F.col(own))
    kept = named.join(judged, same, "left_anti")
    repeated = judged.where(stays)
    if not repeated.isEmpty():
        kept = kept.unionByName(named.join(repeated, same, "left_semi").dropDuplicates([mark, id_col]))
    return kept.select(*docs.columns)
