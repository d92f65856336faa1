"""Near duplicates of the pipeline against brute-force Jaccard pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from ripplefield.llm import jaccard
from tests.llm.fixtures import SCHEMA, real_rows


def shingles(text, width=5):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar(x, y):
    both = len(x & y)
    return x == y or 5 * both >= 4 * (len(x) + len(y) - both)


def components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if find(i) != find(j) and similar(sets[i], sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def edited_rows():
    """Short and middle-length texts with copies of a few edited words; one passage in many texts; one large group."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(4000)}"
    passage, texts = [word() for _ in range(60)], []
    for k in range(60):
        base = [word() for _ in range(r.choice([3, 8, 40, 90, 300]))]
        texts.append(base)
        for edits in (1, 2, 3, 5):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            texts.append(copy)
    texts += [passage + [word() for _ in range(k % 40)] for k in range(80)]
    group = [word() for _ in range(200)]
    for _ in range(120):
        copy = list(group)
        for _ in range(r.randrange(6)):
            copy[r.randrange(200)] = word()
        texts.append(copy)
    texts += [[], [], ["one"], ["One"]]
    return [(i, " ".join(t), "en", "web", len(" ".join(t))) for i, t in enumerate(texts)]


@pytest.mark.parametrize("cells", [1 << 12, 1 << 22])
def test_components_are_those_of_all_jaccard_pairs(spark, cells):
    rows = edited_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    root = {r.node: r.root for r in jaccard.near_duplicates(docs, cells=cells).collect()}
    mine = [jaccard.key_of(jaccard.shingle_set(t)) for _, t, *_ in rows]
    got, want = {}, {}
    for (i, *_), k, c in zip(rows, mine, components([shingles(r[1]) for r in rows])):
        got.setdefault(root.get(k, k), set()).add(i)
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("kind", ["edited", "real"])
def test_stage_keeps_the_least_id_of_each_component(spark, sf, kind):
    rows = edited_rows() if kind == "edited" else list({r[0]: r for r in real_rows(sf) if r[0] is not None}.values())
    rows.sort()
    want = {rows[c][0] for c in components([shingles(r[1]) for r in rows])}
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_sketches_bound_shared_shingles_from_above():
    r = np.random.default_rng(3)
    for size, shared, other in [(0, 0, 0), (0, 0, 9), (1, 1, 1), (8, 3, 9), (64, 60, 70), (65, 65, 64), (900, 800, 1100), (5000, 10, 4000), (40000, 39000, 39500)]:
        pool = np.unique(r.integers(0, 1 << 63, size + other + 9).astype(np.uint64))
        r.shuffle(pool)
        u, v = pool[:size], pool[max(0, size - shared) : max(0, size - shared) + other]
        both = len(np.intersect1d(u, v))
        assert both <= jaccard.most_shared(jaccard.sketch(u), jaccard.sketch(v)) <= min(len(u), len(v))
    crowd = np.arange(300, dtype=np.uint64)  # one bucket holds more than a byte can count
    assert len(jaccard.sketch(crowd)) == 64
    assert jaccard.most_shared(jaccard.sketch(crowd), jaccard.sketch(crowd)) >= 300


def test_sketches_rule_unlike_sets_out():
    r = np.random.default_rng(4)
    sets = [r.integers(0, 1 << 63, n).astype(np.uint64) for n in (300, 310, 2000, 2100)]
    for u, v in ((sets[0], sets[1]), (sets[2], sets[3])):
        assert 9 * jaccard.most_shared(jaccard.sketch(u), jaccard.sketch(v)) < 4 * (len(u) + len(v))


def test_texts_of_shared_passages_and_sizes_at_the_border(spark, sf):
    """Every shingle inside a passage is frequent; besides, pairs whose sizes differ by the threshold itself."""
    r = random.Random(8)
    word = lambda: f"p{r.randrange(9000)}"
    passages = [[word() for _ in range(20)] for _ in range(12)]
    texts = [[w for p in r.sample(passages, 5) for w in p] for _ in range(150)]
    for n in (5, 10, 16, 25, 100, 400):  # n and 5n/4 shingles, all of the smaller set shared, in either order
        base = [word() for _ in range(5 * n // 4 + 4)]
        texts += [base, base[: n + 4], base[: n + 3]]
    rows = [(i, " ".join(t), "en", "web", len(" ".join(t))) for i, t in enumerate(texts)]
    want = set(components([shingles(t) for _, t, *_ in rows]))
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), sf)
    assert sorted(x.doc_id for x in got.collect()) == sorted(want)
