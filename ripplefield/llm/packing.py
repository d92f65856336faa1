"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

1. Documents are encoded where they lie; only ``(doc_id, piece, start, length, crc)`` moves on.  Longer
   documents than a sequence are cut; all pieces but the first are full.
2. Full pieces are sequences already.  The others are dealt at random into blocks of about ``block``
   pieces, so no source or group of copies can make a hot block, and the waste of the last, partly filled
   sequence of a block is shared by thousands.
3. Each block is evolved by several islands, one row ``(block, island)`` each, on any executor.  A genome is
   a grouping of pieces into sequences.  Crossover injects whole well-filled sequences of one parent into
   the other, removes the sequences that hold duplicates of the injected pieces, and best-fits the
   displaced ones.  Between epochs the elite of every island migrates to the next island of its block; blocks
   with a grouping at the lower bound take no part in further epochs.
4. The best grouping of a block's islands places its pieces.

Randomness is seeded by block, island and epoch, and the pieces are written to the shared folder first, so
that a lost executor's work is redone alike.

Defined cases: null and empty texts pack as the separator alone; repeated rows are packed each; null ids are
carried; very long texts are encoded in slices; an empty table gives no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefield.llm.common import cut
from ripplefield.llm.encoding import default_paths, encoder


@dataclass(frozen=True)
class Evolution:
    """Sizes of the search."""

    block: int = 8192
    islands: int = 3
    population: int = 5
    epochs: int = 2
    generations: int = 4
    children: int = 2
    seed: int = 17


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, separator: int, paths: tuple[str, str] | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document."""
    paths = paths or default_paths()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*paths)
        for b in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for row, t in enumerate(b.column(1)):
                ids = np.append(enc.array(t.as_py()), np.uint32(separator)).astype("<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for k, s in enumerate(starts):
                    part = ids[s : (starts[k + 1] if k + 1 < len(starts) else len(ids))]
                    out.append((row, k, s, len(part), zlib.crc32(part.tobytes())))
            cols = [np.array(c, np.int64) for c in zip(*out, strict=True)] if out else [np.array([], np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(each, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(items: np.ndarray, lengths: np.ndarray, group: np.ndarray, room: list[int], capacity: int) -> None:
    """Put each item into the open group with the least room that takes it, else open one; in place.

    Groups of equal room are kept in one list; the rooms in use are bits of one integer, so the best fit is
    the lowest set bit at or above an item's length.
    """
    by_room: dict[int, list[int]] = {}
    used = 0
    for g, r in enumerate(room):
        if r > 0:
            by_room.setdefault(r, []).append(g)
            used |= 1 << r
    for i, n in zip(items.tolist(), lengths[items].tolist(), strict=True):
        fit = used >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            g = by_room[r].pop()
            if not by_room[r]:
                used &= ~(1 << r)
        else:
            g, r = len(room), capacity
            room.append(r)
        group[i] = g
        room[g] = left = r - n
        if left:
            by_room.setdefault(left, []).append(g)
            used |= 1 << left


class Search:
    """Operators of the grouping genetic algorithm over one block of piece lengths."""

    def __init__(self, lengths: np.ndarray, capacity: int, rng: np.random.Generator):
        self.lengths, self.capacity, self.rng = lengths, capacity, rng
        big = int((lengths > capacity // 2).sum())
        self.bound = max(big, -(-int(lengths.sum()) // capacity))

    def compact(self, group: np.ndarray) -> np.ndarray:
        """Number the groups in use from 0."""
        return np.unique(group, return_inverse=True)[1].astype(np.int32)

    def fill(self, group: np.ndarray) -> np.ndarray:
        return np.bincount(group, weights=self.lengths).astype(np.int64)

    def spare(self, people: list[np.ndarray]) -> int:
        """Groups of the best that are beyond the lower bound."""
        return -self.fitness(people[0])[0] - self.bound if people else 0

    def fitness(self, group: np.ndarray) -> tuple[int, float]:
        """Fewer groups first, then fuller ones: larger is better."""
        fill = self.fill(group)
        return -len(fill), float(((fill / self.capacity) ** 2).sum())

    def built(self, order: np.ndarray) -> np.ndarray:
        group = np.zeros(len(self.lengths), np.int32)
        best_fit(order, self.lengths, group, [], self.capacity)
        return group

    def start(self, size: int) -> list[np.ndarray]:
        """Best-fit decreasing, and the same over orders disturbed at random."""
        n = len(self.lengths)
        orders = [np.argsort(-self.lengths, kind="stable")]
        for k in range(1, size):
            noisy = self.lengths * (1 + self.rng.uniform(-0.05 * k, 0.05 * k, n))
            orders.append(np.argsort(-noisy, kind="stable"))
        return [self.built(o) for o in orders]

    def cross(self, giver: np.ndarray, taker: np.ndarray) -> np.ndarray:
        """Inject well-filled groups of one parent into the other and repair."""
        fill = self.fill(giver)
        good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        chosen = np.zeros(len(fill), bool)
        chosen[self.rng.choice(good, max(1, len(good) // 4), replace=False)] = True
        injected = chosen[giver]
        hit = np.zeros(int(taker.max()) + 1, bool)
        hit[taker[injected]] = True
        displaced = hit[taker] & ~injected
        child = taker.copy()
        child[injected] = giver[injected] + len(hit)
        child[~displaced] = self.compact(child[~displaced])
        return self.repaired(child, displaced)

    def mutate(self, group: np.ndarray) -> np.ndarray:
        """Empty some of the least filled groups and best-fit their pieces."""
        fill = self.fill(group)
        worst = np.argsort(fill, kind="stable")[: max(2, len(fill) // 50)]
        gone = np.zeros(len(fill), bool)
        gone[worst] = True
        gone[self.rng.integers(0, len(fill), max(1, len(fill) // 50))] = True
        displaced = gone[group]
        child = group.copy()
        child[~displaced] = self.compact(group[~displaced])
        return self.repaired(child, displaced)

    def repaired(self, child: np.ndarray, displaced: np.ndarray) -> np.ndarray:
        kept = ~displaced
        count = int(child[kept].max()) + 1 if kept.any() else 0
        room = (self.capacity - np.bincount(child[kept], weights=self.lengths[kept], minlength=count)).astype(np.int64).tolist()
        items = np.flatnonzero(displaced)
        best_fit(items[np.argsort(-self.lengths[items], kind="stable")], self.lengths, child, room, self.capacity)
        return self.compact(child)

    def evolve(self, people: list[np.ndarray], generations: int, children: int) -> list[np.ndarray]:
        """Generations of crossover and mutation; the best of parents and children stay."""
        size = len(people)
        ranked = sorted(people, key=self.fitness, reverse=True)
        for _ in range(generations):
            if -self.fitness(ranked[0])[0] <= self.bound:
                break
            born = []
            for _ in range(children):
                a, b = self.rng.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
                child = self.cross(ranked[a], ranked[b])
                born.append(self.mutate(child) if self.rng.random() < 0.5 else child)
            ranked = sorted([*ranked, *born], key=self.fitness, reverse=True)[:size]
        return ranked


def _pack(arrays: list[np.ndarray]) -> bytes:
    return np.stack(arrays).astype("<i4").tobytes() if arrays else b""


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    return list(np.frombuffer(blob, "<i4").reshape(-1, n).copy()) if n else []


STATE = "block long, island int, lengths binary, people binary, elite binary, spare int"
COLUMNS = ["block", "island", "lengths", "people", "elite", "spare"]
#: Tasks that start islands, at most; each takes one block after the other.
MOST_TASKS = 20_000


def islands(dealt: DataFrame, blocks: int, capacity: int, ev: Evolution) -> DataFrame:
    """One row ``(block, island)`` each with the lengths in canonical order, its population and its spare groups."""

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = np.sort(pdf["length"].to_numpy())[::-1].copy()
        rows = []
        for k in range(ev.islands):
            search = Search(lengths, capacity, np.random.default_rng([ev.seed, int(pdf["block"].iloc[0]), k]))
            people = sorted(search.start(ev.population), key=search.fitness, reverse=True)
            rows.append((int(pdf["block"].iloc[0]), k, lengths.astype("<i4").tobytes(), _pack(people), _pack(people[:1]), search.spare(people)))
        return pd.DataFrame(rows, columns=COLUMNS)

    tasks = min(MOST_TASKS, -(-blocks // 2))  # a stated number, else small rows of all blocks are merged into one task
    return dealt.select("block", "length").repartition(tasks, "block").groupBy("block").applyInPandas(start, STATE)


def epoch(state: DataFrame, capacity: int, ev: Evolution, number: int) -> DataFrame:
    """Every island takes its neighbour's elite in and evolves."""
    moved = state.select("block", F.pmod(F.col("island") + 1, F.lit(ev.islands)).alias("island"), F.col("elite").alias("guest"))
    met = state.drop("elite").join(moved.hint("shuffle_hash"), ["block", "island"])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                lengths = np.frombuffer(r.lengths, "<i4").astype(np.int64)
                search = Search(lengths, capacity, np.random.default_rng([ev.seed, r.block, r.island, number]))
                people = _unpack(r.people, len(lengths)) + _unpack(r.guest, len(lengths))
                people = search.evolve(people, ev.generations, ev.children)[: ev.population]
                rows.append((r.block, r.island, r.lengths, _pack(people), _pack(people[:1]), search.spare(people)))
            yield pd.DataFrame(rows, columns=COLUMNS)

    return met.mapInPandas(each, STATE)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    separator: int = 0,
    evolution: Evolution = Evolution(),
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    ev = evolution
    cutted = cut(pieces(docs, id_col, text_col, capacity, separator, paths))
    numbered = cutted.withColumn("rid", F.monotonically_increasing_id())  # stable: over written rows
    full = numbered.where(F.col("length") == capacity)
    part = numbered.where(F.col("length") < capacity)
    blocks = max(1, -(-part.count() // ev.block))
    dealt = part.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
    state = cut(islands(dealt, blocks, capacity, ev))
    for k in range(ev.epochs):
        unsettled = state.groupBy("block").agg(F.min("spare").alias("least")).where("least > 0").select("block")
        if unsettled.isEmpty():  # every block has a grouping at its lower bound
            break
        state = cut(state.join(unsettled, "block", "left_anti").unionByName(epoch(state.join(unsettled, "block"), capacity, ev, k)))
    best = state.select("block", "elite")
    kind = dict(cutted.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(items: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "rid"], ascending=[False, True], kind="stable")
        lengths = items["length"].to_numpy()
        search = Search(lengths, capacity, np.random.default_rng(0))
        group = max((g for e in won["elite"] for g in _unpack(e, len(lengths))), key=search.fitness)
        order = np.argsort(group, kind="stable")
        at = np.cumsum(lengths[order]) - lengths[order]
        first = np.r_[True, group[order][1:] != group[order][:-1]]
        offset = np.empty(len(lengths), np.int64)
        offset[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        items["sequence_id"] = ((items["block"].to_numpy() << 24) + group) * 2
        items["offset"] = offset
        return items[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    packed = dealt.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, schema)
    whole = full.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
