"""Ranked lexical search by variable-block-max WAND, exact.

Index: every task cuts its documents into shards and writes each as one row: sorted terms, and for every term a
posting list (document numbers within the shard, occurrences).  With the corpus statistics known, a second narrow
pass gives each posting list its blocks: dynamic programming chooses the boundaries that minimise the bound error
(the sum over postings of block maximum minus own score) plus a price for each block.  Nothing is shuffled, and a
term that every document holds is spread over all shards.

Search: shards are independent.  For a query, the block maxima of its terms are summed between all block
boundaries; a range of documents whose bound is below the current k-th score is never looked into: only blocks that overlap a
range that passes are decoded and scored.  Ranges are taken by falling bound in rounds, so the k-th score rises early, and it is carried from
shard to shard of a task.  Ranges that tie with the k-th score are looked into, so ties go to the least id exactly.
Every task gives at most k rows a query, which are written; a ranked window merges them.

A shard is one row of some megabytes, so row groups of the tables hold one shard and Arrow batches a few megabytes: a task's
memory doesn't grow with the shards that it writes or reads.

Score (64-bit integers, ``div`` rounding down): a term's weight is ``floor(1000 ln((2N+2)/(2df+1)))``, its impact in a
document ``10^9 tf div (1000 tf + 12 m)`` with ``m = 75 + 25 n N div L``.

Defined cases: null and empty texts hold no terms and don't count for N; repeated rows and ids are documents of
their own; null ids come first among ties; queries without terms or hits have no rows; repeated query ids are queries of their own; texts
of any length are tokenised in slices; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplefield.llm.common import slices, small_batches, text_of, written

#: Separators become blanks, A-Z lower case; bytes of characters beyond ASCII are parts of terms.
FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()

#: A shard is closed at so many documents or bytes of text; a block holds at most so many postings.
SHARD_DOCS, SHARD_BYTES, LONGEST_BLOCK = 8192, 4_000_000, 96
#: Price of a block, as a share of the list's largest impact.
BLOCK_PRICE = 3.0
#: A block whose documents lie further apart than this on average is sparse.
SPARSE = 4
#: So many queries are searched in one go; further ones in further goes.
QUERIES_AT_ONCE = 20_000
#: So many terms of queries are joined by broadcast, more by shuffle.
BROADCAST_TERMS = 500_000


def terms_of(text: str | None, size: int | None = None) -> Iterator[list[bytes]]:
    """Terms of a text in order, a list for each slice of it."""
    for part in slices((text or "").encode("utf-8", "surrogatepass"), size):
        yield part.translate(FOLD).split()


class _Shard:
    """Postings of a few thousand documents while they are gathered."""

    def __init__(self):
        self.ids, self.lengths, self.codes, self.docs, self.counts, self.size = [], [], [], [], [], 0
        self.vocabulary: dict[bytes, int] = {}

    def add(self, doc_id, text: str | None) -> None:
        """Add one document, if it holds a term."""
        counts: Counter[bytes] = Counter()
        for part in terms_of(text):
            counts.update(part)
        if counts:
            place = self.vocabulary.setdefault
            self.codes.append(np.fromiter((place(t, len(self.vocabulary)) for t in counts), np.int32, len(counts)))
            self.counts.append(np.fromiter(counts.values(), np.int32, len(counts)))
            self.docs.append(np.full(len(counts), len(self.ids), np.int32))
            self.ids.append(doc_id)
            self.lengths.append(counts.total())
            self.size += len(text)

    def row(self) -> dict:
        """The shard as one row; lists lie one after the other, by term."""
        codes, docs, tfs = (np.concatenate(x) for x in (self.codes, self.docs, self.counts))
        terms = sorted(self.vocabulary)
        rank = np.empty(len(terms), np.int32)
        rank[[self.vocabulary[t] for t in terms]] = np.arange(len(terms))
        order = np.argsort(rank[codes], kind="stable")  # documents were added in order
        return {
            "ids": self.ids,
            "lengths": self.lengths,
            "terms": terms,
            "sizes": np.bincount(rank[codes], minlength=len(terms)).tolist(),
            "docs": docs[order].astype("<i4").tobytes(),
            "tfs": tfs[order].astype("<i4").tobytes(),
        }


def _postings(docs: DataFrame, id_col: str, text_col: str, most: int, most_bytes: int) -> DataFrame:
    """Shards without blocks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, schema = _Shard(), None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("ids", pa.list_(batch.schema.field(0).type)), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("docs", pa.binary()), ("tfs", pa.binary())])
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(doc_id.as_py(), text.as_py())
                if len(shard.ids) >= most or shard.size >= most_bytes:
                    yield pa.RecordBatch.from_pylist([shard.row()], schema)
                    shard = _Shard()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], schema)

    rows = docs.select(F.col(id_col).alias("i"), text_of(text_col).alias("t"))
    return rows.mapInArrow(gather, f"ids array<{kind}>, lengths array<long>, terms array<binary>, sizes array<int>, docs binary, tfs binary")


def norms(lengths: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """``m`` of each document."""
    if not len(lengths) or 25 * int(lengths.max()) * documents < 2**63:
        return 75 + (25 * lengths * documents) // tokens
    return np.array([75 + 25 * int(n) * documents // tokens for n in lengths], np.int64)


def impacts(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of postings before the term's weight."""
    tfs = tfs.astype(np.int64)
    return 1_000_000_000 * tfs // (1000 * tfs + 12 * m)


def block_ends(scores: list[np.ndarray], longest: int = LONGEST_BLOCK, price: float = BLOCK_PRICE) -> list[np.ndarray]:
    """Ends (exclusive) of the blocks of several posting lists, of least bound error plus price.

    Dynamic programming over all lists at once: ``best[j]`` is the least cost of the first j postings; step j tries all
    last blocks of up to ``longest`` postings, whose maxima are kept up to date.
    """
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    lengths = np.array([len(scores[k]) for k in order])
    top = int(lengths[0]) if len(order) else 0
    padded = np.zeros((len(order), top))
    for row, k in enumerate(order):
        padded[row, : len(scores[k])] = scores[k]
    fee = price * padded.max(axis=1, initial=0)
    best = np.zeros((len(order), top + 1))
    came = np.zeros((len(order), top + 1), np.int32)
    maxima = np.zeros((len(order), longest))  # of the block of w + 1 postings that ends here
    sums = np.zeros((len(order), longest))
    widths = np.arange(1, longest + 1)
    alive = len(order)
    for j in range(1, top + 1):
        while lengths[alive - 1] < j:
            alive -= 1
        s, w = padded[:alive, j - 1 : j], min(j, longest)
        maxima[:alive, 1:w] = np.maximum(maxima[:alive, : w - 1], s)
        maxima[:alive, 0] = s[:, 0]
        sums[:alive, 1:w] = sums[:alive, : w - 1] + s
        sums[:alive, 0] = s[:, 0]
        cost = maxima[:alive, :w] * widths[:w] - sums[:alive, :w] + best[:alive, j - w : j][:, ::-1]
        choice = cost.argmin(axis=1)
        best[:alive, j] = cost[np.arange(alive), choice] + fee[:alive]
        came[:alive, j] = j - 1 - choice
    ends: list[np.ndarray] = [np.zeros(0, np.int32)] * len(order)
    for row, k in enumerate(order):
        found, j = [], int(lengths[row])
        while j > 0:
            found.append(j)
            j = int(came[row, j])
        ends[k] = np.array(found[::-1], np.int32)
    return ends


def _blocks(sizes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of all lists of a shard: past-the-end postings, and how many blocks each list has."""
    starts = np.r_[0, np.cumsum(sizes)]
    last = np.zeros(len(scores), bool)
    last[starts[1:] - 1] = True
    # a list of n postings can't save more than n - 1 maxima by more blocks: a price of that or more leaves it whole
    rest = np.flatnonzero((sizes - 1 > BLOCK_PRICE) | (sizes > LONGEST_BLOCK))
    rest = rest[np.argsort(sizes[rest], kind="stable")]
    at = 0
    while at < len(rest):  # lists of like lengths together, so that padding stays small
        least, past = sizes[rest[at]], at + 1
        while past < len(rest) and sizes[rest[past]] <= max(16, 2 * least) and (past - at + 1) * int(sizes[rest[past]]) <= 400_000:
            past += 1
        group = rest[at:past]
        for k, e in zip(group, block_ends([scores[starts[k] : starts[k + 1]] for k in group]), strict=True):
            last[starts[k] + e - 1] = True
        at = past
    return np.flatnonzero(last) + 1, np.add.reduceat(last.astype(np.int32), starts[:-1])


class Index(NamedTuple):
    """A written index: shards with blocks, the number of documents with terms, and of all terms."""

    shards: DataFrame
    documents: int
    tokens: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> Index:
    """Index of all rows; both tables go to the shared folder."""
    with small_batches(docs.sparkSession):
        raw = written(_postings(docs, id_col, text_col, shard_docs, shard_bytes), group_rows=1)
    total = raw.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    documents, tokens = total[0] or 0, total[1] or 0

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                sizes, lengths, doc, tf = _arrays(row, "sizes", "lengths", "docs", "tfs")
                scores = impacts(tf, norms(lengths, documents, tokens)[doc])
                ends, counts = _blocks(sizes, scores)
                first = np.r_[0, ends[:-1]]
                extra = [counts.astype("<i4"), ends.astype("<i4"), np.maximum.reduceat(scores, first).astype("<i8")]
                columns = [*row.columns, *(pa.array([x.tobytes()], pa.binary()) for x in extra)]
                yield pa.RecordBatch.from_arrays(columns, [*row.schema.names, "blocks", "ends", "maxima"])

    schema = ", ".join(f"{n} {t}" for n, t in raw.dtypes) + ", blocks binary, ends binary, maxima binary"
    with small_batches(docs.sparkSession):
        return Index(written(raw.mapInArrow(block, schema), group_rows=1), documents, tokens)


_KINDS = {"docs": "<i4", "tfs": "<i4", "blocks": "<i4", "ends": "<i4", "maxima": "<i8"}


def _arrays(row: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns of a one-row batch as numbers."""
    found = []
    for n in names:
        c = row.column(row.schema.get_field_index(n))
        found.append(np.frombuffer(c[0].as_buffer(), _KINDS[n]) if n in _KINDS else c.flatten().to_numpy(zero_copy_only=False))
    return found


def frequencies(index: Index, vocabulary: list[bytes]) -> DataFrame:
    """``(term, df)`` of the given distinct terms: one row a task and term is shuffled."""
    terms = index.shards.sparkSession.createDataFrame([(bytearray(t),) for t in vocabulary], "term binary")
    terms = F.broadcast(terms) if len(vocabulary) <= BROADCAST_TERMS else terms
    lists = index.shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.sizes").alias("size"))
    return lists.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("size").alias("df"))


def weight(documents: int, df: int) -> int:
    """Weight of a term that ``df`` documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class _Top:
    """The k best of a query so far: by score, then by id, null first."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def offer(self, scores: np.ndarray, ids: list, docs: np.ndarray) -> None:
        """Take documents of a score above 0 that are among the best."""
        chosen = np.flatnonzero(scores >= self.least)
        if not len(chosen):
            return
        if len(chosen) > self.k:  # what ties with the k-th score stays
            chosen = chosen[scores[chosen] >= np.partition(scores[chosen], -self.k)[-self.k]]
        found = [(int(scores[c]), ids[docs[c]]) for c in chosen]
        self.rows = heapq.nsmallest(self.k, self.rows + found, key=lambda r: (-r[0], r[1] is not None, r[1] if r[1] is not None else 0))
        if len(self.rows) == self.k:
            self.least = max(1, self.rows[-1][0])


class _Lists:
    """A shard as read: for the terms asked, the blocks of their lists."""

    def __init__(self, row: pa.RecordBatch, index_documents: int, tokens: int, wanted: pa.Array):
        self.docs, self.tfs, self.ends, self.maxima, counts, self.lengths = _arrays(row, "docs", "tfs", "ends", "maxima", "blocks", "lengths")
        self.m = norms(self.lengths, index_documents, tokens)
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int32)
        self.first, self.last = self.docs[self.starts], self.docs[self.ends - 1]
        terms = row.column(row.schema.get_field_index("terms")).flatten()
        places = pc.index_in(wanted, value_set=terms).to_numpy(zero_copy_only=False)
        border = np.r_[0, np.cumsum(counts)]
        self.lists = {t: (int(border[int(p)]), int(border[int(p) + 1])) for t, p in zip(wanted.to_pylist(), places, strict=True) if p == p and p is not None}
        self.ids = row.column(row.schema.get_field_index("ids"))[0].as_py()


def bounds_of(shard: _Lists, block: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Upper bound of every document's score: the block maxima of the lists it may be in.

    A dense block counts for all documents between its ends, without being decoded; of a sparse one the document numbers are
    read, so that a rare term's block doesn't raise the bounds of the gaps inside it.
    """
    first, past = shard.first[block], shard.last[block] + 1
    size = shard.ends[block] - shard.starts[block]
    bound, dense = shard.maxima[block] * factor, past - first <= SPARSE * size
    steps = np.zeros(len(shard.lengths) + 1, np.int64)
    np.add.at(steps, first[dense], bound[dense])
    np.subtract.at(steps, past[dense], bound[dense])
    found = np.cumsum(steps)[:-1]
    at, by = _within(shard, block[~dense])
    np.add.at(found, shard.docs[at], bound[~dense][by])
    return found


def _within(shard: _Lists, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the postings of some blocks, and which of the blocks each is in."""
    n = shard.ends[block] - shard.starts[block]
    by = np.repeat(np.arange(len(block)), n)
    return np.arange(n.sum()) - (np.cumsum(n) - n)[by] + shard.starts[block][by], by


def search_shard(shard: _Lists, query: list[tuple[bytes, int]], top: _Top) -> int:
    """Offer a shard's best documents for ``(term, weight)`` to ``top``; the number of postings that were scored."""
    lists = [(*shard.lists[t], w) for t, w in query if t in shard.lists and w > 0]
    if not lists:
        return 0
    block = np.concatenate([np.arange(b, e) for b, e, _ in lists])
    factor = np.repeat([w for *_, w in lists], [e - b for b, e, _ in lists])
    begin, end = shard.first[block], shard.last[block] + 1
    bounds = bounds_of(shard, block, factor)
    rest, most, scored = np.flatnonzero(bounds >= top.least), 4 * top.k, 0
    while len(rest):
        chosen, left = np.ones(len(rest), bool), np.zeros(0, np.int64)
        if len(rest) > most:
            chosen[np.argpartition(bounds[rest], -most)[:-most]] = False
            left = rest[~chosen]
        live = np.zeros(len(bounds), bool)
        live[rest[chosen]] = True
        upto = np.r_[0, np.cumsum(live)]
        hit = np.flatnonzero(upto[end] > upto[begin])  # blocks with a live document between their ends
        at, by = _within(shard, block[hit])
        keep = live[shard.docs[at]]
        at, by = at[keep], by[keep]
        docs = shard.docs[at]
        scores = np.zeros(len(bounds), np.int64)
        np.add.at(scores, docs, factor[hit][by] * impacts(shard.tfs[at], shard.m[docs]))
        top.offer(scores[rest[chosen]], shard.ids, rest[chosen])
        scored, most = scored + len(at), 4 * most
        rest = left[bounds[left] >= top.least]
    return scored


def search(index: Index, queries: DataFrame, k: int = 20, item: str = "item_id", text: str = "text", id_name: str = "doc_id") -> DataFrame:
    """``(item, rank, doc_id, score)`` of each query's k best documents."""
    spark, at = queries.sparkSession, Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    asked = written(queries.select(F.col(item).alias("item"), text_of(text).alias("t")).withColumn("q", F.monotonically_increasing_id()))
    kind, id_kind = index.shards.schema["ids"].dataType.elementType.simpleString(), asked.schema["item"].dataType.simpleString()
    found, size = [], asked.count()
    if size and index.documents:
        groups = -(-size // QUERIES_AT_ONCE)
        for g in range(groups):
            rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == g).select("q", "t").collect()  # some 20,000 queries at most
            found.append(_search_once(index, rows, k, kind))
    if not found:
        return spark.createDataFrame([], f"{item} {id_kind}, rank int, {id_name} {kind}, score long")
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    ranked = best.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item"), "q").select(F.col("item").alias(item), "rank", F.col("doc").alias(id_name), "score")


def _search_once(index: Index, rows: list, k: int, kind: str) -> DataFrame:
    """``(q, doc, score)``: each task's best of some queries."""
    spark, n, tokens = index.shards.sparkSession, index.documents, index.tokens
    counted = {}
    for r in rows:
        counts: Counter[bytes] = Counter()
        for part in terms_of(r.t):
            counts.update(part)
        if counts:
            counted[r.q] = counts
    vocabulary = sorted({t for c in counted.values() for t in c})
    df = {bytes(r.term): r.df for r in frequencies(index, vocabulary).collect()}  # bounded by the queries' terms
    plans = {q: [(t, c * weight(n, df[t])) for t, c in counts.items() if t in df] for q, counts in counted.items()}
    shared = spark.sparkContext.broadcast((plans, sorted(df)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted = shared.value
        wanted = pa.array(wanted, pa.binary())
        best = {q: _Top(k) for q in queries}
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for j in range(batch.num_rows):
                shard = _Lists(batch.slice(j, 1), n, tokens, wanted)
                for q, plan in queries.items():
                    search_shard(shard, plan, best[q])
        out = [(q, i, s) for q, top in best.items() for s, i in top.rows]
        if out:
            q, i, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, id_type), pa.array(s, pa.int64())], ["q", "doc", "score"])

    with small_batches(spark):
        return written(index.shards.mapInArrow(run, f"q long, doc {kind}, score long"))
