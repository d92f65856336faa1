import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ripplefield.llm import attribution, encoding, media, queries
from tests.llm.fixtures import AWKWARD, awkward, real_rows, write_tables


@pytest.mark.parametrize("data", ["awkward", "real"])
def test_round_trip(spark, sf, tmp_path, data):
    rows = AWKWARD if data == "awkward" else real_rows(sf)
    got = queries.op3_media_columns(spark, write_tables(spark, str(tmp_path), rows)).collect()
    want = Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))
        want[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    for r in got:
        assert r.media_bytes > r.payload_bytes and f"samples={r.payload_bytes // 64} " in r.feature


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, *parts, version=0, flags=0):
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def movie(sizes, per_chunk, chunks, sync=None, wide=False, compact=False):
    runs = [(k + 1, n, 1) for k, n in enumerate(per_chunk) if k == 0 or per_chunk[k - 1] != n]
    stbl = [
        full(b"stsd", struct.pack(">I", 1), box(b"avc1", b"\0" * 70)),
        full(b"stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes)) if not compact else full(b"stz2", b"\0\0\0\x08", struct.pack(">I", len(sizes)), bytes(sizes)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"co64" if wide else b"stco", struct.pack(">I", len(chunks)), *(struct.pack(">Q" if wide else ">I", c) for c in chunks)),
    ]
    if sync is not None:
        stbl.append(full(b"stss", struct.pack(">I", len(sync)), *(struct.pack(">I", s + 1) for s in sync)))
    mdhd = full(b"mdhd", struct.pack(">QQIQ", 0, 0, 600, 1800), b"\0" * 4, version=1) if wide else full(b"mdhd", struct.pack(">IIII", 0, 0, 600, 1800), b"\0" * 4)
    trak = box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7), b"\0" * 68), box(b"mdia", mdhd, full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 13), box(b"minf", box(b"stbl", *stbl))))
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", full(b"mvhd", b"\0" * 96), trak)


@pytest.mark.parametrize("wide,compact", [(False, False), (True, False), (True, True)])
def test_sample_tables(wide, compact):
    sizes, per_chunk, chunks = [10, 20, 30, 40, 50, 60, 70], [2, 2, 3], [1000, 5000, 9000]
    tracks, error = media.describe(movie(sizes, per_chunk, chunks, [0, 3, 4], wide, compact))
    assert error == "" and len(tracks) == 1
    t = tracks[0]
    assert (t.codec, t.handler, t.timescale, t.duration) == ("avc1", "vide", 600, 1800)
    assert t.offsets.tolist() == [1000, 1010, 5000, 5030, 9000, 9050, 9110]
    assert t.key_ranges() == [(1000, 10), (5030, 40), (9000, 50)]
    assert len(media.describe(movie(sizes, per_chunk, chunks))[0][0].key_ranges()) == 7


def test_fragments_and_big_boxes():
    moov = movie([], [], [], [])
    trun = full(b"trun", struct.pack(">IiI", 3, 100, 0x02000000), struct.pack(">III", 11, 12, 13), flags=0x205)
    traf = box(b"traf", full(b"tfhd", struct.pack(">II", 7, 0x01010000), flags=0x20), trun)
    at = len(moov)
    data = moov + box(b"moof", full(b"mfhd", struct.pack(">I", 1)), traf) + struct.pack(">I4sQ", 1, b"mdat", 16 + 5) + b"12345"
    (t,), error = media.describe(data)
    assert error == "" and t.sizes.tolist() == [11, 12, 13] and t.offsets.tolist() == [at + 100, at + 111, at + 123]
    assert t.key_ranges() == [(at + 100, 11)]


def test_fragment_runs_defaults_and_times():
    """Two runs of one fragment, defaults of the movie, a second fragment that goes on, a 64-bit ``moof``, stated times."""
    trex = box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 50, 30, 0x01010000)))
    moov = movie([], [], [], [])
    moov = moov[: moov.index(b"moov") - 4] + box(b"moov", moov[moov.index(b"moov") + 4 :], trex)
    key = struct.pack(">I", 0x02000000)
    first = box(
        b"traf",
        full(b"tfhd", struct.pack(">I", 7)),
        full(b"tfdt", struct.pack(">Q", 900), version=1),
        full(b"trun", struct.pack(">Ii", 4, 100), key, flags=0x5),  # sizes and durations by the movie's defaults
        full(b"trun", struct.pack(">I", 2), struct.pack(">IIi", 10, 21, 5), struct.pack(">IIi", 20, 22, -3), version=1, flags=0xB00),
    )
    second = box(b"traf", full(b"tfhd", struct.pack(">I", 7)), full(b"trun", struct.pack(">I", 1), key, flags=0x4))
    body = full(b"mfhd", struct.pack(">I", 1)) + first + second
    data = moov + struct.pack(">I4sQ", 1, b"moof", len(body) + 16) + body
    (t,), error = media.describe(data)
    at = len(moov) + 100
    assert error == "" and t.sizes.tolist() == [30] * 4 + [21, 22, 30]
    assert t.offsets.tolist() == [at, at + 30, at + 60, at + 90, at + 120, at + 141, at + 163]
    assert t.key_ranges() == [(at, 30), (at + 163, 30)]
    assert t.times().tolist() == [900, 950, 1000, 1050, 1105, 1107, 1130]


def test_sample_times_from_tables():
    plain = movie([10] * 6, [6], [1000], [0, 3])
    stts = full(b"stts", struct.pack(">5I", 2, 4, 100, 2, 50))
    ctts = full(b"ctts", struct.pack(">IIiIi", 2, 3, 7, 3, -7), version=1)
    cut = plain.index(b"stbl") - 4
    size = struct.unpack_from(">I", plain, cut)[0]
    stbl = box(b"stbl", plain[cut + 8 : cut + size], stts, ctts)
    grown = len(stbl) - size
    data = bytearray(plain[:cut] + stbl + plain[cut + size :])
    for outer in (b"moov", b"trak", b"mdia", b"minf"):
        k = data.index(outer) - 4
        struct.pack_into(">I", data, k, struct.unpack_from(">I", data, k)[0] + grown)
    (t,), error = media.describe(bytes(data))
    assert error == "" and t.times().tolist() == [7, 107, 207, 293, 393, 443]
    assert media.describe(media.wrap(b"x" * 256))[0][0].times().tolist() == [0, 64, 128, 192]


def test_tables_that_claim_too_much_stay_small():
    huge = full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF))
    stts = full(b"stts", struct.pack(">III", 1, 0xFFFFFFFF, 1))
    data = box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", huge, stts)))))
    (t,), _ = media.describe(data)
    assert len(t.sizes) <= len(data) and len(t.deltas) <= len(data)


def test_broken_bytes(spark):
    good = media.wrap(b"\1" * 640)
    for cut in range(0, len(good), 37):
        media.describe(good[:cut])
    assert media.describe(None) == ([], "empty") and media.describe(b"not boxes at all")[1]
    frame = spark.createDataFrame([(1, good), (2, None), (3, b"xx"), (4, good[:200])], "id long, data binary")
    got = {r.id: r for r in media.media_columns(frame, "id", "data").collect()}
    (t,) = got[1].tracks
    assert (t.codec, t.samples, t.seconds, got[1].error) == ("raw ", 10, 0.08, "") and [tuple(k) for k in t.keyframes] == [(len(good) - 640, 64, 0)]
    assert got[2].error and got[3].error
    with pytest.raises(ValueError):
        media.wrap(b"short")


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("data", ["awkward", "real"])
def test_lines(spark, sf, tmp_path, exact, data):
    rows = AWKWARD if data == "awkward" else real_rows(sf)
    got = queries.op6_token_counts(spark, write_tables(spark, str(tmp_path), rows)).collect()
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        lines = t.split("\n")
        ends = np.cumsum([len(x) + 1 for x in lines])
        ends[-1] -= 1
        spans = [(a, b) for a, b in zip([0, *ends[:-1]], ends)]
        if len(spans) > 1 and spans[-1][0] == spans[-1][1]:
            spans.pop()
        found = [[0, 0] for _ in spans]
        for a, b in exact.encode(t, add_special_tokens=False).offsets:
            over = [k for k, (s, e) in enumerate(spans) if a < e and b > s]
            found[over[0]][0] += 1
            if len(over) > 1:
                for k in over:
                    found[k][1] += 1
        for k, ((s, e), (n, x)) in enumerate(zip(spans, found)):
            want[i, k, int(s), int(e), n, x] += 1
    assert Counter((r.doc_id, r.section, r.start, r.end, r.tokens, r.crossing) for r in got) == want


def test_rules_and_gaps():
    first, past = np.array([0, 2, 4, 9]), np.array([2, 4, 9, 12])
    starts, ends = np.array([0, 3, 10]), np.array([3, 8, 12])
    start = attribution.allocate(first, past, starts, ends, "start")
    assert start[0].tolist() == [2, 1, 0] and start[2] == 1
    major = attribution.allocate(first, past, starts, ends, "majority")
    assert major[0].tolist() == [2, 1, 1] and major[1].tolist() == [1, 2, 1]
    split = attribution.allocate(first, past, starts, ends, "split")
    assert split[0].tolist() == pytest.approx([1.5, 0.5 + 4 / 5, 2 / 3])
    for counts, _, outside in (start, major, split):
        assert counts.sum() + outside == pytest.approx(4)
    with pytest.raises(ValueError):
        attribution.allocate(first, past, starts[::-1], ends, "start")


def test_own_sections(spark):
    rows = awkward(spark).withColumn("parts", queries.F.expr("array(struct(0 as a, 5 as b), struct(7 as a, 9 as b))")).withColumn("section", queries.F.lit(1))
    enc = encoding.encoder(*encoding.default_paths())
    for rule in attribution.RULES:
        got = attribution.attribute(rows, sections_col="parts", rule=rule).groupBy("doc_id").agg(queries.F.sum("tokens").alias("n")).collect()
        n = Counter()
        for i, t, *_ in AWKWARD:
            n[i] += len(enc.ids(t))
        assert {r.doc_id: pytest.approx(r.n) for r in got} == {i: k for i, k in n.items()} or all(abs(n[r.doc_id] - r.n) < 1e-6 for r in got)


def test_empty(spark, tmp_path):
    d = write_tables(spark, str(tmp_path), [])
    for q in ("op2_toxicity", "op3_media_columns", "op5_lm_scoring", "op6_token_counts", "op7_ordinal_quality"):
        assert queries.queries()[q](spark, d).collect() == []


def nested(kind, depth):
    raw = b""
    for _ in range(depth):
        raw = box(kind, raw)
    return raw


TORN = {
    "deep": nested(b"moov", 1200),
    "duration": box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">QQIQ", 0, 0, 600, 2**63), b"\0" * 4, version=1)))),
    "base": box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">IQ", 1, 2**64 - 5), flags=1), full(b"trun", struct.pack(">I", 3)))),
    "time": box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 1)), full(b"tfdt", struct.pack(">Q", 2**63), version=1))),
    "chunk": box(b"moov", box(b"trak", full(b"co64", struct.pack(">IQ", 1, 2**64 - 1)))),
}


@pytest.mark.parametrize("name", TORN)
def test_values_that_leave_64_bits_are_torn(spark, name):
    assert media.describe(TORN[name])[1] == "torn: ValueError"


def test_unknown_durations_and_deep_files(spark):
    header = full(b"mdhd", struct.pack(">QQIQ", 0, 0, 600, 2**64 - 1), b"\0" * 4, version=1)
    tracks, error = media.describe(box(b"moov", box(b"trak", box(b"mdia", header))))
    assert error == "" and (tracks[0].timescale, tracks[0].duration) == (600, 0)
    assert media.describe(nested(b"moov", 40))[1] == ""
