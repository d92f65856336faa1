import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplefield.llm import lexical, queries
from tests.llm.fixtures import AWKWARD, SCHEMA, real_rows, write_tables

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(0, "The quick BROWN fox the naïve"), (1, None), (2, "..., !"), (2, "word1 word2 word3 the of 日本"), (3, "absent words only"), (None, "one two null id a b c")]


def brute(docs, items, k=20):
    """The contract's formula over all documents and terms."""
    held = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n, total = len(held), sum(x for *_, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(UPPER))
        scores = []
        for i, c, length in held:
            m = 100 - 25 + 25 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            scores += [(s, i)] if s > 0 else []
        scores.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs,k", [(1, 3), (4, 20), (1000, 5)])
def test_equals_brute_force(spark, sf, shard_docs, k):
    rows = AWKWARD + [(i + 100, *r) for i, *r in real_rows(sf)[:120]] * 2  # every text twice: ties
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = lexical.build(docs, shard_docs=shard_docs, shard_bytes=50_000)
    items = ITEMS + [(10 + i, t[:200]) for i, t, *_ in real_rows(sf)[:30]]
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k=k)
    assert sorted(map(tuple, got.collect()), key=str) == brute([(i, t) for i, t, *_ in rows], items, k)


@pytest.mark.parametrize("rows", [[], [(1, None, "", "", 0), (2, "?!", "", "", 0)]])
def test_no_terms_no_rows(spark, tmp_path, rows):
    folder = write_tables(spark, str(tmp_path), rows)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert queries.op13_lexical_search(spark, folder).collect() == []


def test_no_items(spark, tmp_path):
    folder = write_tables(spark, str(tmp_path))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert queries.op13_lexical_search(spark, folder).collect() == []


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()["op13_lexical_search"]).fetchall()
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in queries.op13_lexical_search(spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) > 700


def cost(scores, ends, price):
    total, at = 0, 0
    for e in ends:
        total += max(scores[at:e]) * (e - at) - sum(scores[at:e]) + price * max(scores)
        at = e
    return total


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(1, 50), min_size=1, max_size=9), min_size=1, max_size=4), st.integers(2, 9))
def test_blocks_have_the_least_cost(lists, longest):
    got = lexical.block_ends([np.array(x) for x in lists], longest, 0.4)
    for scores, ends in zip(lists, got, strict=True):
        n = len(scores)
        assert ends[-1] == n and np.diff(np.r_[0, ends]).max() <= longest
        splits = ([j + 1 for j in range(n - 1) if bits >> j & 1] + [n] for bits in range(1 << (n - 1)))
        least = min(cost(scores, s, 0.4) for s in splits if np.diff(np.r_[0, s]).max() <= longest)
        assert cost(scores, ends.tolist(), 0.4) == pytest.approx(least)


def test_blocks_are_skipped():
    rng = np.random.default_rng(0)
    shard, n = lexical._Shard(), 3000
    for i in range(n):
        words = [f"w{w}" for w in rng.zipf(1.3, 60) if w < 5000]
        shard.add(i, " ".join(words + ["needle"] * (i % 150 == 0)))
    row = shard.row()
    doc, tf = (np.frombuffer(row[c], "<i4") for c in ("docs", "tfs"))
    tokens, m = sum(row["lengths"]), None
    m = lexical.norms(np.array(row["lengths"]), n, tokens)
    scores = lexical.impacts(tf, m[doc])
    ends, counts = lexical._blocks(np.array(row["sizes"]), scores)
    maxima = np.maximum.reduceat(scores, np.r_[0, ends[:-1]])
    import pyarrow as pa

    columns = {c: pa.array([row[c]], t) for c, t in (("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("docs", pa.binary()), ("tfs", pa.binary()))}
    columns |= {c: pa.array([x.astype(k).tobytes()], pa.binary()) for c, x, k in (("blocks", counts, "<i4"), ("ends", ends, "<i4"), ("maxima", maxima, "<i8"))}
    query = [(t, lexical.weight(n, int(s))) for t, s in zip(row["terms"], row["sizes"], strict=True) if t in (b"needle", b"w1", b"w2", b"w3", b"w40")]
    lists = lexical._Lists(pa.RecordBatch.from_pydict(columns), n, tokens, pa.array([t for t, _ in query], pa.binary()))
    top = lexical._Top(10)
    scored = lexical.search_shard(lists, query, top)
    sizes = dict(zip(row["terms"], row["sizes"], strict=True))
    assert len(top.rows) == 10 and scored < 0.2 * sum(sizes[t] for t, _ in query)


def test_shards_are_written_and_read_one_by_one(spark, sf):
    import pyarrow.parquet as pq

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame(real_rows(sf)[:40], SCHEMA).coalesce(1)
    index = lexical.build(docs, shard_docs=4)
    files = [pq.ParquetFile(f.removeprefix("file:").replace("//", "/")) for f in index.shards.inputFiles()]
    groups = [f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert sum(groups) > 5 and max(groups) == 1
    assert spark.conf.get(name) == before
