"""Properties of the corpus operators' kernels, on arbitrary texts."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplefield.llm import attribution, common, encoding, media, ngram, ordinal, packing, secrets, simhash, toxicity
from tests.llm.test_simhash import brute_fingerprint

texts = st.text(max_size=300)
FAST = settings(max_examples=60, deadline=None)


@FAST
@given(texts)
def test_media_round_trip(t):
    n, raw = media.padded(t)
    (track,), error = media.describe(media.wrap(raw))
    assert error == "" and media.payload(media.wrap(raw), track)[:n] == t.encode()
    assert sum(length for _, length in track.key_ranges()) == 64 * len(range(0, len(raw) // 64, media.KEY))


@FAST
@given(st.binary(max_size=400))
def test_any_bytes_are_described(data):
    media.describe(data)
    media.describe(b"\0\0\0\x08moov" + data)


@FAST
@given(texts)
def test_spans_cover_every_character(t):
    enc = encoding.encoder(*encoding.default_paths())
    first, past = attribution.token_spans(t, enc)
    assert (first < past).all() and (not t or (first[0] == 0 and past[-1] == len(t)))
    starts, ends = attribution.line_sections(t)
    assert "".join(t[a:b] for a, b in zip(starts, ends)) == t
    for rule in attribution.RULES:
        counts, _, outside = attribution.allocate(first, past, starts, ends, rule)
        assert abs(counts.sum() + outside - len(first)) < 1e-9


@FAST
@given(st.text(alphabet="aAbB \n\té", max_size=200))
def test_fingerprints(t):
    assert simhash.fingerprint(t) == brute_fingerprint(t)


@FAST
@given(st.text(alphabet="ab cD\n.é<1", max_size=200), st.integers(1, 20))
def test_slices_change_nothing(t, size):
    enc = encoding.encoder(*encoding.default_paths())
    assert enc.array(t, size).tolist() == enc.ids(t)
    raw = t.encode()
    assert b"".join(common.slices(raw, size)) == raw
    assert [w for s in common.slices(raw, size) for w in s.split()] == raw.split()


def test_long_texts_in_slices(monkeypatch):
    t = "The quick brown fox jumps, over 13 lazy dogs.\nAnd on " * 50
    want = simhash.fingerprint(t), ngram.token_hashes([t, None, ""]), ordinal.features(t)
    monkeypatch.setattr(common, "LONG", 100)
    got = simhash.fingerprint(t), ngram.token_hashes([t, None, ""]), ordinal.features(t)
    assert want[0] == got[0] == brute_fingerprint(t)
    assert all((a == b).all() for a, b in zip(want[1] + want[2], got[1] + got[2]))


@FAST
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80), st.randoms(use_true_random=False))
def test_every_search_step_is_a_packing(lengths, rnd):
    lengths = np.sort(np.array(lengths))[::-1].copy()
    s = packing.Search(lengths, 100, np.random.default_rng(rnd.randrange(1 << 30)))
    people = s.start(3)
    for g in (*people, s.cross(people[0], people[1]), s.mutate(people[2])):
        assert s.fill(g).max() <= 100 and len(np.unique(g)) == g.max() + 1 >= s.bound


@FAST
@given(texts)
def test_windows_hold_all_words(t):
    assert b"".join(toxicity.windows(t)).replace(b" ", b"") == b"".join(t.lower().encode().split())


@FAST
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=60))
def test_packed_keys(keys):
    k = np.unique(np.array(keys, np.uint64))
    assert (ngram.unpack(ngram.pack(k, np.arange(len(k))), 2)[0] == k).all()


@FAST
@given(st.from_regex(secrets.BASE_RULES[0].pattern, fullmatch=True) | st.from_regex(r"AKIA[A-Z0-9]{16,20}", fullmatch=True), texts)
def test_queries_hold_for_matches(hit, around):
    for rule in secrets.BASE_RULES[:2]:
        t = around + hit
        if re.search(rule.pattern, t, re.ASCII):
            low = t.lower()
            assert any(all(g in low for g in alt) for alt in secrets.required(rule.pattern))
