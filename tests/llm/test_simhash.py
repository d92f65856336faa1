import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from ripplefield.llm import queries, simhash
from ripplefield.llm.components import components
from tests.llm.fixtures import AWKWARD, WORD, real_rows, write_tables


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def near(fps, radius=2):
    return [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]


@pytest.mark.parametrize("data", ["awkward", "real"])
def test_whole_query(spark, sf, tmp_path, data):
    rows = AWKWARD if data == "awkward" else real_rows(sf)
    got = queries.op10_simhash_near_dedup(spark, write_tables(spark, str(tmp_path), rows)).collect()
    fp = [brute_fingerprint(t) for _, t, *_ in rows]
    comp = groups(set(fp), near(sorted(set(fp))))
    least = {}
    for (i, *_), f in zip(rows, fp):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = sorted((str(i), f"{f:016x}", least.get(comp[f])) for (i, *_), f in zip(rows, fp))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert len({x[2] for x in want}) < len(want)


def test_empty(spark, tmp_path):
    assert queries.op10_simhash_near_dedup(spark, write_tables(spark, str(tmp_path), [])).collect() == []


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("bucket", [2, 1000])
@pytest.mark.parametrize("parts", [1, 2, 3, 4])
def test_no_link_is_lost(spark, parts, bucket):
    rnd = random.Random(parts)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    fps = {signed(c ^ sum(1 << rnd.randrange(64) for _ in range(k % 4))) for c in centres for k in range(14)} | {signed(rnd.getrandbits(64)) for _ in range(100)}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    n, both = simhash.bit_counts(frame)
    assert n == len(fps)
    bits = np.array([[f >> b & 1 for b in range(64)] for f in fps])
    assert (both == bits.T @ bits).all()
    split = simhash.group_bits(both, n, parts)
    assert sorted(itertools.chain(*split)) == list(range(64))
    costs = [[0.0] + [float(t + 1) * (i + 1) for t in range(3)] for i in range(parts)]
    plan = simhash.Plan(split, simhash.best_thresholds(costs, 2 - parts + 1)[1])
    assert sum(plan.thresholds) == 3 - parts
    found = {tuple(sorted(r)) for r in simhash.links(frame, plan, 2, bucket).collect()}
    true = {tuple(sorted(e)) for e in near(sorted(fps))}
    assert found <= true
    assert groups(fps, found) == groups(fps, true)


def test_star_links_for_radius_one(spark):
    fps = [0, 1, 3, 7, 1 << 40, (1 << 40) | 2, -1]
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {tuple(sorted(r)) for r in simhash.star_links(frame, 1).collect()}
    assert found == {tuple(sorted(e)) for e in near(fps, 1)}


def test_thresholds_are_optimal():
    rnd = random.Random(3)
    for m in range(1, 6):
        costs = [[0.0, *sorted(rnd.random() for _ in range(3))] for _ in range(m)]
        best = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in itertools.product(range(-1, 3), repeat=m) if sum(ts) == 3 - m)
        assert abs(simhash.best_thresholds(costs, 3 - m)[0] - best) < 1e-12


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)] + [(2000, 1999), (1999, 2000)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200)) and got[2000] == got[1999] == 1999
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
