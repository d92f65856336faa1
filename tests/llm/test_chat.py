import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplefield.llm import chat, queries
from ripplefield.llm.chat import INSTRUCT, Machine, Rule, Template

SCHEMA = "conv_id long, turn long, role string, text string, position string"
ROWS = [
    (0, 0, "system", "be [SYS] kind", "clash"),
    (0, 1, "user", "</s>", "x"),
    (0, 2, "assistant", r"<\/s> [\\INST] \ ", "x"),
    (1, 0, "assistant", "starts out of order", "x"),
    (1, 1, "user", "so all is stray", "x"),
    (2, None, "user", None, "x"),
    (2, 5, "assistant", "", "x"),
    (2, 5, "assistant", "", "x"),
    (3, 1, "tool\n[INST]\\", "unknown 日本 𝄞", "x"),
    (3, 0, None, "no role", "x"),
    (None, 0, "user", "null id", "x"),
    (None, 1, "assistant", "a" * 100_000, "x"),
    (4, 0, "user", "ends at the user", "x"),
]
PIECE = st.sampled_from([*INSTRUCT.controls, "\\", "<", "[", "/s>", "INST]", " ", "x", "\n", "日", "<\\", "[\\/"])
TEXT = st.lists(PIECE, max_size=8).map("".join)


@settings(deadline=None, max_examples=300)
@given(TEXT)
def test_escaping_comes_back_and_leaves_no_control(text):
    machine = Machine()
    escaped = machine.escape(text)
    assert machine.unescape(escaped) == text
    assert not machine._exact.search(escaped)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "a\nb\\n"]), TEXT), max_size=6))
def test_the_formatted_string_alone_gives_the_turns(turns):
    machine, state, whole = Machine(), INSTRUCT.start, ""
    for role, text in turns:
        state, segments = machine.write(state, role, text)
        whole += "".join(x for x, _ in segments)
        assert [x for x, loss in segments if loss] == ([machine.escape(text)] if role == "assistant" else [])
    got = list(machine.read(INSTRUCT.start, whole))
    assert [(r, t) for _, r, t in got] == turns
    assert not got or got[-1][0] == state


@pytest.mark.parametrize(
    "controls,rules",
    [
        (("<s>", "<"), ()),
        (("<s>", "s<"), ()),
        (("<s>", "<\\s>"), ()),
        (("<s>",), (Rule("start", "u", "u", "", "no control"),)),
        (("<s>",), (Rule("start", "u", "u", "<", "<s>"),)),
        (("<s>",), (Rule("start", "u", "u", "", "s><s>"),)),
        (("<s>",), (Rule("start", "u", "u", "<s>", "<s>"), Rule("start", "v", "v", "<s> ", "<s>"))),
        (("<s>",), (Rule("start", "u", "u", "<s>", "<s>"), Rule("start", "u", "v", "x<s>", "<s>"))),
    ],
)
def test_templates_that_could_not_be_read_are_rejected(controls, rules):
    with pytest.raises(ValueError):
        Template(controls=controls, rules=rules, ends=(), stray=("(", "<s>"))


def expected(rows):
    """By conversation: what the contract asks, from the rows themselves."""
    convs = {}
    first = lambda v: (v is not None, v if v is not None else 0)
    for c, n, r, t, *_ in sorted(rows, key=lambda x: (first(x[1]), x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
        convs.setdefault(c, []).append((r or "", t or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(x), sha("".join(f"{r}\n{t}\n" for r, t in x)), sum(len(t) for r, t in x if r == "assistant"), sha("".join(t for r, t in x if r == "assistant"))) for c, x in convs.items()}


def test_awkward_conversations(spark):
    random.seed(1)
    rows = ROWS + [(9, k, "user" if k % 2 == 0 else "assistant", random.choice(["[INST]", "</s>", "x"]) * 3, "") for k in range(25_000)]
    df = spark.createDataFrame(random.sample(rows, len(rows)), SCHEMA).repartition(5)
    turns = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(turns).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == expected(rows)
    assert {c: (r.valid, r.first_error, r.complete) for c, r in got.items()} == {
        0: (True, None, True), 1: (False, 0, False), 2: (False, 2, False), 3: (False, 0, False), None: (True, None, True), 4: (True, None, True), 9: (True, None, True)
    }
    of_zero = [r for r in turns.collect() if r.conv_id == 0]
    assert [r.position for r in of_zero] == [0, 1, 2] and [r.state for r in of_zero] == ["system", "user", "assistant"]
    assert "".join(s.text for r in of_zero for s in r.segments) == r"<s>[SYS] be [\SYS] kind [/SYS][INST] <\/s> [/INST] <\\/s> [\\\INST] \ </s>"
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []


@pytest.mark.parametrize("data", ["awkward", "real"])
def test_query_equals_its_sql(spark, sf, tmp_path, data):
    folder = sf
    if data == "awkward":
        folder = str(tmp_path)
        spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    got = queries.op11_chat_formatting(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet{'/*.parquet' if data == 'awkward' else ''}'")
    rel = con.execute(queries.oracle_sql()["op11_chat_formatting"])
    names = [c[0] for c in rel.description]
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())
    own = got.where("conv_id = -1").first()
    assert (own.n_turns, own.loss_chars, own.valid) == (2, 21, True)
