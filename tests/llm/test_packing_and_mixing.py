import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ripplefield.llm import encoding, mixing, packing, queries
from tests.llm.fixtures import AWKWARD, SCHEMA, WORD, awkward, real_rows, write_tables


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_reference_library(exact, sf):
    enc = encoding.encoder(*encoding.default_paths())
    texts = [t or "" for _, t, *_ in AWKWARD] + [t for _, t, *_ in real_rows(sf)]
    texts += [" " * 9000 + "x", "\n" * 9000, "a\t" * 50, "１２ ½ ٣", "é" * 5000, "   x", "it's I'LL we've", "\x00\x01"]
    for t in texts:
        assert enc.ids(t) == exact.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("data", ["awkward", "real"])
def test_packing(spark, sf, tmp_path, exact, data):
    rows = AWKWARD if data == "awkward" else real_rows(sf)
    got = queries.op4_best_fit_packing(spark, write_tables(spark, str(tmp_path), rows)).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [0]
        starts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = np.array([r.length for r in got])
    bound = max(-(-lengths.sum() // 2048), (lengths > 1024).sum())
    assert len(by) <= bound * 1.03 + 1


def test_empty(spark, tmp_path):
    d = write_tables(spark, str(tmp_path), [])
    assert queries.op4_best_fit_packing(spark, d).collect() == []
    assert queries.op9_source_mixing(spark, d).collect() == []


def test_search_keeps_groups_valid_and_never_worsens():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 1500, 700))[::-1].copy()
    search = packing.Search(lengths, 2048, rng)
    people = search.start(5)
    first = max(map(search.fitness, people))
    for people in (search.evolve(people, 5, 3),):
        for g in people:
            assert search.fill(g).max() <= 2048 and set(g) == set(range(g.max() + 1))
    assert max(map(search.fitness, people)) >= first
    child = search.cross(people[0], people[1])
    assert search.fill(child).max() <= 2048 and len(child) == len(lengths)


def test_probabilities_follow_targets(spark, tmp_path):
    rows = [(i, "w " * (i % 7 + 1) + (" | x" if i % 11 < 5 else ""), "en" if i % 13 else "fr", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(3000)]
    d = write_tables(spark, str(tmp_path), rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    share = spark.createDataFrame([("hot", 0.5)] + [(f"s{k}", 0.1) for k in range(5)], "value string, share double")
    out, n = mixing.mix(docs, targets={"source": share, "lang": 1.0, "topic": 1.0}, keep=0.3, iterations=20)
    got = out.groupBy("source").agg(mixing.F.sum(mixing.F.col(n["tokens"]) * mixing.F.col(n["probability"])).alias("w"))
    w = {r.source: r.w for r in got.collect()}
    total = sum(len(WORD.findall(t)) for _, t, *_ in rows)
    assert abs(sum(w.values()) / total - 0.3) < 1e-3
    assert all(abs(w[s] / sum(w.values()) - (0.5 if s == "hot" else 0.1)) < 1e-3 for s in w)
    picked = out.where(n["sampled"]).agg(mixing.F.sum(n["tokens"])).first()[0]
    assert abs(picked / total - 0.3) < 0.03


def test_awkward_rows(spark):
    rows = awkward(spark).withColumn("topic", mixing.F.lit("own")).withColumn("tokens", mixing.F.lit(1))
    out, n = mixing.mix(rows)
    assert out.count() == len(AWKWARD) and set(rows.columns) <= set(out.columns)
    for r in out.collect():
        assert r[n["tokens"]] == len(WORD.findall(r.text or "")) and 0 <= r[n["probability"]] <= 1


@pytest.mark.parametrize("n,seed", [(60, 25), (60, 30), (120, 0), (120, 2)])
def test_crossover_reaches_the_bound_where_best_fit_misses_it(n, seed):
    lengths = np.sort(np.random.default_rng(seed).integers(20, 101, n))[::-1].copy()
    search = packing.Search(lengths, 150, np.random.default_rng(1))
    people = search.start(5)
    assert max(map(search.fitness, people))[0] == -search.bound - 1
    people = search.evolve(people, 40, 4)
    assert search.spare(people) == 0


def test_marginal_errors_tell_what_raking_reached(spark):
    rows = [(i, "w " * (i % 7 + 1), "en" if i % 3 else "fr", f"s{i % 5}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    share = spark.createDataFrame([(f"s{k}", 0.2) for k in range(5)], "value string, share double")
    found = mixing.marginal_errors(mixing.fit(docs, targets={"source": share, "lang": 1.0, "topic": 1.0}, keep=0.3)).collect()
    assert {r.dim for r in found} == {"source", "lang", "topic"} and all(abs(r.target - r.reached) < 1e-3 for r in found)


def test_a_topic_column_and_clashing_names(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "s", "ab"[i % 2]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    for c in ("cell_source", "cell_source__", "key__", "have__", "n", "w", "total", "n_tokens", "t_source"):
        docs = docs.withColumn(c, mixing.F.lit("own"))
    out, names = mixing.mix(docs, topic=mixing.F.col("topic"))
    assert out.count() == 100 and {r[0] for r in out.select(names["topic"]).distinct().collect()} == {"a", "b"}
    assert set(docs.columns) <= set(out.columns)


def test_targets_that_cannot_be_meant(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "ab"[i % 2], 5) for i in range(20)], SCHEMA)
    twice = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("a", 0.25)], "value string, share double")
    with pytest.raises(ValueError):
        mixing.mix(docs, targets={"source": twice})
    with pytest.raises(ValueError):
        mixing.mix(docs, targets={"colour": 0.5})


def test_some_dimensions_alone(spark):
    docs = spark.createDataFrame([(i, "a b c", "en" if i % 4 else "fr", "a" if i % 5 else "b", 5) for i in range(400)], SCHEMA)
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double")
    cells = mixing.fit(docs, targets={"source": shares}, keep=0.2)
    reached = {(r.dim, r.value): (r.target, r.reached) for r in mixing.marginal_errors(cells).collect()}
    assert set(reached) == {("source", "a"), ("source", "b")} and all(abs(t - x) < 1e-9 for t, x in reached.values())
    rows, names = mixing.mix(docs, targets={"source": shares}, keep=0.2)
    assert rows.count() == 400 and 20 < rows.where(names["sampled"]).count() < 150
