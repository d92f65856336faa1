import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ripplefield.llm import ngram, ordinal, queries, toxicity
from tests.llm.fixtures import AWKWARD, WORD, real_rows, write_tables


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def tokens(text):
    low = (text or "").translate({ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    return [*WORD.findall(low), "END "]


class Brute:
    """Interpolated modified Kneser-Ney over dictionaries."""

    def __init__(self, texts):
        self.c1, self.c2 = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.c1.update(w)
            self.c2.update(zip(["START ", *w], w))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.cont = Counter(w for _, w in self.c2)
        self.left, self.kinds = Counter(), defaultdict(Counter)
        for (u, w), c in self.c2.items():
            self.left[u] += c
            self.kinds[u][min(c, 3)] += 1
        of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        self.d2, self.d1 = ngram.estimate(*of(self.c2)), ngram.estimate(*of(self.cont))

    def p1(self, w):
        cut = lambda c: 0 if c == 0 else self.d1[min(c, 3) - 1]
        types = len(self.c2)
        if not types:
            return 1.0
        free = sum(cut(c) for c in self.cont.values()) / types
        return (self.cont[w] - cut(self.cont[w])) / types + free / (self.v + 1)

    def p(self, u, w):
        if not self.left[u]:
            return self.p1(w)
        c = self.c2[u, w]
        free = sum(self.d2[k - 1] * n for k, n in self.kinds[u].items()) / self.left[u]
        return (max(c - (self.d2[min(c, 3) - 1] if c else 0), 0)) / self.left[u] + free * self.p1(w)


@pytest.mark.parametrize("data", ["awkward", "real"])
def test_language_model(spark, sf, tmp_path, data):
    rows = AWKWARD if data == "awkward" else real_rows(sf)
    got = queries.op5_lm_scoring(spark, write_tables(spark, str(tmp_path), rows)).collect()
    m = Brute([t for i, t, *_ in rows if crc(i) % 5 != 1])
    want = []
    for i, t, *_ in rows:
        w = tokens(t)
        base = sum(math.log10((m.c1[x] + 0.5) / (m.n + 0.5 * (m.v + 1))) for x in w)
        score = sum(math.log10(m.p(u, x)) for u, x in zip(["START ", *w], w))
        want.append((str(i), crc(i) % 5 == 1, len(w), sum(m.c1[x] > 0 for x in w), m.n, base, score))
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_probabilities_add_up():
    m = Brute(["a b a b c", "b c a", "a a a d", "e"])
    for u in ["START ", "a", "b", "zzz"]:
        assert sum(m.p(u, w) for w in [*m.c1, "unknown"]) == pytest.approx(1)


def test_language_model_without_training_text(spark, tmp_path):
    model = ngram.train(spark.createDataFrame([], "text string"))
    got = ngram.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), model).collect()
    assert [(r.n_tokens, r.n_known) for r in sorted(got)] == [(3, 0), (1, 0)] and all(r.score == 0 for r in got)


def test_blobs_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    counts = rng.integers(1, 9, len(keys)).astype(np.uint64)
    for n in (0, 1, len(keys)):
        k, c = ngram.unpack(ngram.pack(keys[:n], counts[:n]), 2)
        assert (k == keys[:n]).all() and (c == counts[:n]).all()
    k, c = ngram.merged([ngram.pack(keys[:300], counts[:300]), ngram.pack(keys[200:], counts[200:])], 2)
    assert (k == keys).all() and c.sum() == counts[:300].sum() + counts[200:].sum()


LEX = ["grumblefish", "snotwaffle", "dirtclod", "fiendrot"]


def labelled(n=900):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = [vocab[k] for k in rng.integers(0, 500, rng.integers(30, 120))]
        toxic = int(i % 5 == 2)
        if toxic:
            for k in rng.integers(0, len(w), 4):
                w[k] = LEX[rng.integers(0, 4)]
        poor = i % 7 == 3
        if poor:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(not poor), toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, tmp_path):
    rows, labels = labelled()
    d = write_tables(spark, str(tmp_path), rows + AWKWARD[:3], labels=labels)
    toxic = {i: t for i, _, t in labels}
    got = [r for r in queries.op2_toxicity(spark, d).collect()]
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)
    judged = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id > 3]
    assert sum(a == b for a, b in judged) / len(judged) > 0.93


def test_toxicity_of_real_rows_and_without_labels(spark, sf, tmp_path):
    assert queries.op2_toxicity(spark, sf).count() == len(real_rows(sf))
    d = write_tables(spark, str(tmp_path), AWKWARD)
    assert {r.score for r in queries.op2_toxicity(spark, d).collect()} == {0.0}
    assert toxicity.Model(prior=0.25).score("x") == 0.25


def test_windows_cover_the_whole_text():
    t = "a " * 21 + "b" * 1000
    wins = toxicity.windows(t)
    assert b"".join(wins).replace(b" ", b"") == t.replace(" ", "").encode()
    assert toxicity.windows(None) == toxicity.windows(" ") == []


def test_ordinal_grades_on_held_out_rows(spark, tmp_path):
    rows, labels = labelled()
    d = write_tables(spark, str(tmp_path), rows + AWKWARD[:4], labels=labels)
    quality = {i: q for i, q, _ in labels}
    got = queries.op7_ordinal_quality(spark, d).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        assert 0 <= r.tail_probability <= 1 and r.tail_probability <= r.expected_grade + 1e-9 <= 2 + 1e-6 and r.kept == (r.tail_probability >= 0.5)
    judged = [(r.kept, quality[r.doc_id]) for r in got if r.held_out and r.doc_id > 4]
    assert sum(a == bool(b) for a, b in judged) / len(judged) > 0.95


def test_ordinal_probabilities():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(300):
        g = int(rng.integers(0, 4))
        rows.append((np.array([2 * g, 100], np.int32), np.array([0.5, 0.5], np.float32)))
        grades.append(g)
    m = ordinal.fit(rows, np.array(grades), 3)
    assert (np.diff(m.thresholds) > 0).all()
    p = m.grades(np.array([float(m.weights[a] @ x) for a, x in rows]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert (p.argmax(axis=1) == np.array(grades)).mean() > 0.9
    assert ordinal.fit([], np.array([], np.int64), 2).score("x y") == 0
    assert ordinal.features(None)[0].size == 0


def test_ordinal_on_real_rows(spark, sf):
    assert queries.op7_ordinal_quality(spark, sf).count() == len(real_rows(sf))


CLASHES = ("toxic", "mark", "label_id", "own_id", "grade", "rated_id", "rated_grade", "score", "tails", "expected_grade", "id", "held_out")


def test_models_with_clashing_columns(spark, tmp_path):
    rows, labels = labelled(300)
    d = write_tables(spark, str(tmp_path), rows, labels=labels)
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = docs.select("*", *(ordinal.F.lit("own").alias(c) for c in CLASHES))
    plain, same = (toxicity.train(x, marks) for x in (docs, odd))
    assert plain.toxic == same.toxic and plain.weights == same.weights
    assert toxicity.score(odd, same).count() == len(rows)
    grades = ordinal.graded(marks).withColumn("rated_grade", ordinal.F.lit(7)).withColumn("own_id", ordinal.F.lit(7))
    a, b = (ordinal.train(x, grades, top=2) for x in (docs, odd))
    assert (a.weights == b.weights).all() and ordinal.score(odd, a).count() == len(rows)


def test_samples_are_bounded_by_ids_whatever_repeats(spark):
    docs = spark.range(20_000).selectExpr("case when id % 2 = 0 then 1 else id end as doc_id", "concat('text ', id % 3) as text")
    marks = spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic", "cast(id % 3 as int) as grade")
    toxic, ordinary = toxicity.sample(docs, marks, "doc_id", "text", 10, 10)
    assert len(toxic) <= 10 and len(ordinary) <= 10
    assert ordinal.rated_sample(docs, marks, "doc_id", "text", 25).count() <= 25


def test_toxicity_scores_are_those_of_the_lengths(spark, tmp_path):
    """Scores from the model's two dictionaries by plain compression, window by window."""
    import zstandard

    rows, labels = labelled(300)
    d = write_tables(spark, str(tmp_path), rows + AWKWARD, labels=labels)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(raw, content):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(raw))

    def saved(raw):
        return length(raw, model.ordinary) - length(raw, model.ordinary + model.toxic)

    def want(text):
        w = [x[i : i + 256] for x in (text or "").lower().encode().split() for i in range(0, len(x), 256)]
        wins = [b" " + b" ".join(w[i : i + 8]) + b" " for i in range(0, len(w), 8)]
        gain = [saved(x) for x in wins]
        best = sorted(range(len(wins)), key=lambda i: (-gain[i], i))
        top = [gain[i] for i in best[:4]] + [0] * 4
        joined = saved(b"".join(wins[i] for i in sorted(best[:8]))) if wins else 0
        told, n = sum(g >= 3 for g in gain), len(wins) or 1
        x = [1, *top[:4], joined, math.log1p(told), 10 * told / n, math.log1p(len(wins)), min(sum(gain) / n, 5)]
        return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=True))))))

    some = {r[0]: r[1] for r in rows[:20] + AWKWARD[:4]}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect() if r.doc_id in some}
    for i, t in some.items():
        if i is not None and i > 13:
            assert got[i] == pytest.approx(want(t), rel=1e-9)


def test_ordinal_scores_are_those_of_the_weights(spark, tmp_path):
    """Grades from the model's weights by a plain walk over words and shapes."""
    import re

    import xxhash

    rows, labels = labelled(300)
    d = write_tables(spark, str(tmp_path), rows, labels=labels)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = ordinal.train(docs, ordinal.graded(spark.read.parquet(f"{d}/labels.parquet")), top=2)
    half = ordinal.SIZE // 2

    def want(text):
        w, s = text.encode().split(), 0.0
        for x in w:
            shape = re.sub(rb"(.)\1+", rb"\1\1", re.sub(rb"[a-z]", b"a", re.sub(rb"[A-Z]", b"\x00", x)).replace(b"\x00", b"A"))[:12]
            s += (model.weights[xxhash.xxh64_intdigest(x.lower()) % half * 2] + model.weights[xxhash.xxh64_intdigest(shape) % half * 2 + 1]) / len(w)
        classes = (len(w).bit_length(), 10 * len(set(w)) // len(w), 0)
        s += sum(0.5 * model.weights[xxhash.xxh64_intdigest(b"class %d %d" % kc) % half * 2 + 1] for kc in enumerate(classes))
        tails = [1 - 1 / (1 + math.exp(s - t)) for t in model.thresholds]
        return sum(tails)

    got = {r.doc_id: r.expected_grade for r in ordinal.score(docs, model).collect()}
    for i, t, *_ in rows[:60]:
        assert got[i] == pytest.approx(want(t), rel=1e-4, abs=1e-5)
