"""The pipeline, stage by stage and as a whole, against a plain-Python version."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ripplefield.llm import mixing, secrets
from tests.llm.fixtures import AWKWARD, SCHEMA, WORD, real_rows, write_tables
from tests.llm.test_jaccard import components, edited_rows, shingles
from tests.llm.test_quality_and_secrets import brute_quality, brute_spans


def kept(row):
    t = row[1] or ""
    n, chars, symbols, dup, repeat = brute_quality(t)
    lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
    letters = sum(c.isalpha() for c in t)
    upper = sum(c.isupper() for c in t)
    return not (n < 50 or 100 * repeat > 50 * n or 100 * symbols > 100 * n or 100 * dup > 60 * lines or chars < 2 * n or chars > 25 * n or 100 * letters < 50 * chars or 100 * upper > 60 * letters)


def dedup(rows):
    """One row of each component of equal sets and 5-word Jaccard pairs of 0.8: the row of least id."""
    best = {}
    for r, c in zip(rows, components([shingles(r[1]) for r in rows])):
        rank = lambda x: (x[0] is None, x[0])
        if c not in best or rank(r) < rank(best[c]):
            best[c] = r
    return list(best.values())


def redact(row):
    t, out, at = row[1] or "", "", 0
    found = brute_spans(t, secrets.RULES)
    for a, _, b in found:
        if a >= at:
            out += t[at:a] + "[SECRET]"
        at = max(at, b)
    out += t[at:]
    return (row[0], out if found else row[1], row[2], row[3], len(out) if found else row[4])


def mix(rows, keep=0.7, power=0.7, iterations=8):
    topic = lambda t: next((n for n, m in mixing.TOPIC_MARKERS if m in t), "prose")
    keys = [(r[3], r[2], topic(r[1] or "")) for r in rows]
    cells = Counter()
    for k, r in zip(keys, rows):
        cells[k] += len(WORD.findall(r[1] or ""))
    n, names = np.array([float(v) for v in cells.values()]), list(cells)
    w = n * keep
    dims = [np.array([str(c[d]) for c in names]) for d in range(3)]
    for _ in range(iterations):
        for vals in dims:
            totals = {v: n[vals == v].sum() for v in vals}
            norm = sum(t**power for t in totals.values())
            have = {v: w[vals == v].sum() for v in vals}
            w = np.minimum(w * np.array([totals[v] ** power / norm * keep * n.sum() / have[v] for v in vals]), n)
    p = dict(zip(names, w / n))
    u = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    return [r for k, r in zip(keys, rows) if u(r[0]) < p[k]]


def read(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=str)


def test_stages_on_real_rows(spark, sf):
    rows = real_rows(sf)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for (name, stage), model in zip(corpus_pipeline.STAGES[:4], (lambda x: [r for r in x if kept(r)], dedup, lambda x: list(map(redact, x)), mix)):
        docs, before = stage(spark, docs, sf), len(rows)
        rows = model(rows)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert read(docs) == sorted(rows, key=str), name
        assert 0 < len(rows) <= before
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check_packed(corpus_pipeline.STAGES[4][1](spark, docs, sf).collect(), rows)
    check_packed(corpus_pipeline.run(spark, sf).collect(), rows)


def check_packed(got, rows):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, *_ in rows:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [0]
        starts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) * 1.05 + 1


def test_awkward_rows_and_clashing_columns(spark, sf):
    docs = spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)
    for c in ("ledger", "spans", "postings", "topic", "tokens", "probability", "sampled", "fp", "row_hash", "row", "key", "root", "text_", "at_id", "cell_source", "key__", "have__", "n", "w", "total", "judged_id"):
        docs = docs.withColumn(c, mixing.F.lit("own"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "best-fit packing" or out.columns == docs.columns
        out.collect()


def test_near_dedup_tells_rows_apart_by_content_not_by_id(spark, sf):
    """Repeated ids with different texts, copies across ids and without ids, rows equal in every column."""
    words = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(1, words("a")), (1, words("b")), (1, words("c")), (2, words("b") + " end"), (5, words("a")), (None, words("d")), (None, words("d") + "\n"), (7, words("d")), (None, words("e")), (None, words("e") + " "), (8, words("f")), (8, words("f"))]
    rows = [(i, t, "en", "web", len(t)) for i, t in rows]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    assert sorted((str(r.doc_id), r.text.split()[0]) for r in got) == [("1", "aw0"), ("1", "bw0"), ("1", "cw0"), ("7", "dw0"), ("8", "fw0"), ("None", "ew0")]


def test_rows_with_shifted_nulls_are_different_rows(spark, sf):
    """The same value in another column makes another row, though an id occurs twice."""
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(0, None, "en", None, None), (1, text, None, None, None), (1, None, text, None, None), (2, "another text", "en", None, None), (3, None, None, "en", None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text) == [(1, text), (2, "another text")]
    assert [r.doc_id for r in got if not r.text] == [0]


def test_near_dedup_shuffled_and_broadcast_alike(spark, sf, monkeypatch):
    docs = spark.createDataFrame([(i // 2, *r[1:]) for i, r in enumerate(edited_rows())], SCHEMA).repartition(4)
    want = read(corpus_pipeline.near_dedup(spark, docs, sf))
    monkeypatch.setattr("ripplefield.llm.simhash.BROADCAST_ROWS", 0)
    assert read(corpus_pipeline.near_dedup(spark, docs.repartition(7), sf)) == want


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, write_tables(spark, str(tmp_path), [])).collect() == []


def test_secrets_are_gone(spark, sf):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    for r in corpus_pipeline.redact_secrets(spark, docs, sf).collect():
        assert not any(re.search(p, r.text or "") for p in ("hunter2", "AKIAABC", "deadbeef", "ghp_a1"))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_no_rows(spark, sf, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0
