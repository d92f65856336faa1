import hashlib
import re
from collections import Counter

import pytest

from ripplefield.llm import queries, quality_rules, secrets
from tests.llm.fixtures import AWKWARD, WORD, awkward, collected, real_rows, write_tables


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    inside = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@pytest.mark.parametrize("data", ["awkward", "real"])
def test_measurements(spark, sf, tmp_path, data):
    rows = AWKWARD if data == "awkward" else real_rows(sf)
    got = queries.op1_quality_rules(spark, write_tables(spark, str(tmp_path), rows)).collect()
    key = lambda r: (str(r[0]), *r[1:6])
    want = [(i, *brute_quality(t)) for i, t, *_ in rows]
    assert sorted(key([r.doc_id, *(r[f] for f in FIELDS)]) for r in got) == sorted(map(key, want))
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.failure_bits == 0) and not (r.kept and r.base_failed)


def test_policies_and_ablation(spark):
    rows, name = quality_rules.ledger(awkward(spark).withColumn("ledger", quality_rules.F.lit(1)))
    assert name != "ledger" and set(rows.columns) > {"ledger", name}
    bits = rows[name]["failure_bits"]
    masks = [r[0] for r in rows.select(bits).collect()]
    for version, mask in quality_rules.POLICIES.items():
        assert rows.where(quality_rules.apply_policy(bits, version)).count() == sum(m & mask == 0 for m in masks)
    for r in quality_rules.ablation(rows, bits, "v2").collect():
        b = quality_rules.BIT[r.rule]
        assert (r.failed, r.failed_alone) == (sum(m & b != 0 for m in masks), sum(m == b for m in masks))
        assert r.kept_without_rule == sum(m & ~b == 0 for m in masks)


def test_empty_tables(spark, tmp_path):
    d = write_tables(spark, str(tmp_path), [])
    assert queries.op1_quality_rules(spark, d).collect() == [] and queries.op8_secret_scan(spark, d).collect() == []


def brute_spans(text, rules):
    out = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("data", ["awkward", "real"])
def test_spans(spark, sf, tmp_path, data):
    rows = AWKWARD if data == "awkward" else real_rows(sf)
    got = {(str(r.doc_id), r.spans): r for r in queries.op8_secret_scan(spark, write_tables(spark, str(tmp_path), rows)).collect()}
    for i, t, *_ in rows:
        found = brute_spans(t, secrets.RULES)
        name = lambda s: ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in s)
        r = got[str(i), name(found)]
        base = [s for s in found if s[1] < 3]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()


def test_queries_from_regexes():
    ask = lambda p: None if (q := secrets.required(p)) is None else {"|".join(sorted(a)) for a in q}
    assert ask(r"[0-9a-f]+") is None
    assert ask(r"AKIA[A-Z0-9]+") == {"aki|kia"}
    assert ask(r"foo|ba") is None
    assert {"ell|hel|llo"} <= ask(r"(abc|xyz)?hello")
    assert ask(r"(?i)api_?key") == {"api|ike|key|pik", "_ke|api|i_k|key|pi_"}
    assert ask(secrets.BASE_RULES[0].pattern) is not None


@pytest.mark.parametrize("pattern", [r"AKIA[A-Z0-9]+", secrets.BASE_RULES[0].pattern, r"(ab|cd)ef{2}g", r"x?yz+abc", r"abc(de)*fgh", r"(foo|bar|bazz)\d+end"])
def test_no_match_is_lost(pattern):
    import random

    query, rnd = secrets.required(pattern), random.Random(1)
    pieces = ["password", "=", "abcdefg", "AKIA", "AB12", "ab", "cd", "eff", "g", "x", "y", "z", "abc", "de", "fgh", "foo1end", "bazz22end", " "]
    for _ in range(3000):
        t = "".join(rnd.choice(pieces) for _ in range(6))
        if re.search(pattern, t):
            low = t.lower()
            assert query is None or any(all(g in low for g in alt) for alt in query), t


def test_postings_and_redaction(spark):
    rows = awkward(spark)
    low = {i: (t or "").lower() for i, t, *_ in AWKWARD}
    want = {(g, i) for g in secrets.vocabulary(secrets.RULES) for i in low if g in low[i]}
    assert {tuple(r) for r in secrets.inverted(rows, "doc_id", "text").collect()} == want
    found, name = secrets.spans(rows)
    for r in found.select("text", name, secrets.redact(secrets.text_of("text"), found[name]).alias("clean")).collect():
        t, out, at = r.text or "", "", 0
        for a, _, b in sorted((s.start, s.ord, s.end) for s in r[name]):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.clean == out + t[at:]
