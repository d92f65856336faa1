"""Chat formatting by a finite-state machine over roles and a declarative template.

A template is data: control strings, and one rule for each (state, role) that may occur, with the state that
follows, the literals before and after the text, and whether the text is learned.  The machine walks over a
conversation in turn order.  Every turn becomes segments ``(text, loss)``: literals are never learned, the text
is if its rule says so.  A turn that no rule allows is *stray*: it and all later ones of its conversation are
written in a form that names the role, and the conversation is reported as invalid; nothing is dropped.

Control strings inside texts are escaped reversibly: a backslash goes in after the first character of
``first \\* rest``, so that texts which hold escaped forms already come back as they were.  A template is checked
when it is made (``ValueError``): no control string can arise across the border of a text and a literal, and the
literals tell the rules of a state apart.  So the formatted string alone, without its segments, can be read back.

Rows are dealt by conversation and sorted by turn; one task streams through them and holds one Arrow batch, the
machine's state and running digests, so a conversation of any length takes bounded memory.  It is one task's
work, because a digest over all turns is sequential; other conversations don't wait for it.

Defined cases: null texts and null roles read as empty; null conversation ids are one conversation; rows of one
turn number follow each other by role, then text, repeated rows stay, null turn numbers come first; an unknown
or empty role is stray; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRAY = "stray"


@dataclass(frozen=True)
class Rule:
    """In ``state`` a turn of ``role`` is allowed; it is written between two literals and leads to ``next``."""

    state: str
    role: str
    next: str
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Rules of a chat format; ``ends`` are the states in which a conversation is complete."""

    controls: tuple[str, ...]
    rules: tuple[Rule, ...]
    ends: tuple[str, ...]
    start: str = "start"
    stray: tuple[str, str] = ("[TURN] ", " [/TURN]")
    table: dict = field(init=False, repr=False, compare=False)
    learned: frozenset = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "table", {(r.state, r.role): r for r in self.rules})
        object.__setattr__(self, "learned", frozenset(r.role for r in self.rules if r.loss))
        firsts = {c[:1] for c in self.controls}
        rests = set("".join(c[1:] for c in self.controls))
        if not self.controls or any(len(c) < 2 or "\\" in c for c in self.controls) or firsts & rests:
            raise ValueError("a control string has two characters or more, no backslash, and its first character inside no control string")
        if len(self.table) < len(self.rules) or any(STRAY in (r.state, r.next) for r in self.rules):
            raise ValueError(f"one rule for each state and role, and none for the state {STRAY}")
        exact = re.compile("|".join(map(re.escape, self.controls)))
        for before, after in [(r.before, r.after) for r in self.rules] + [self.stray]:
            if any(before.endswith(c[:k]) for c in self.controls for k in range(1, len(c))):
                raise ValueError(f"{before!r} ends with the beginning of a control string")
            if not exact.search(after) or not exact.match(after) and after[0] in rests:
                raise ValueError(f"{after!r} must hold a control string, and none may end in it")
        for state in {r.state for r in self.rules}:
            openings = [r.before for r in self.rules if r.state == state] + [self.stray[0]]
            if any(a is not b and b.startswith(a) for a in openings for b in openings):
                raise ValueError(f"the literals before texts don't tell the rules of state {state!r} apart")


#: Instructions in brackets; the assistant's texts are learned.
INSTRUCT = Template(
    controls=("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]"),
    rules=(
        Rule("start", "system", "system", "<s>[SYS] ", " [/SYS]"),
        Rule("start", "user", "user", "<s>[INST] ", " [/INST]"),
        Rule("system", "user", "user", "[INST] ", " [/INST]"),
        Rule("user", "assistant", "assistant", " ", "</s>", loss=True),
        Rule("assistant", "user", "user", "<s>[INST] ", " [/INST]"),
    ),
    ends=("user", "assistant"),
)


class Machine:
    """A template compiled for formatting and reading."""

    def __init__(self, template: Template = INSTRUCT):
        self.template = t = template
        self._exact = re.compile("|".join(map(re.escape, t.controls)))
        some = lambda times: re.compile("|".join(re.escape(c[0]) + r"\\" + times + re.escape(c[1:]) for c in t.controls))
        self._bare, self._escaped = some("*"), some("+")

    def escape(self, text: str) -> str:
        """The text with a backslash more in every control string and every escaped one."""
        return self._bare.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        """Inverse of ``escape``."""
        return self._escaped.sub(lambda m: m[0][0] + m[0][2:], text)

    def write(self, state: str, role: str, text: str) -> tuple[str, list[tuple[str, bool]]]:
        """The next state and the segments of one turn."""
        rule = self.template.table.get((state, role))
        if rule:
            return rule.next, [(rule.before, False), (self.escape(text), rule.loss), (rule.after, False)]
        name = self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
        opening, closing = self.template.stray
        return STRAY, [(f"{opening}{name}\n", False), (self.escape(text), role in self.template.learned), (closing, False)]

    def _text(self, formatted: str, at: int, after: str) -> tuple[str, int]:
        """The text that begins at ``at`` and ends before ``after``, and where the next turn begins."""
        found = self._exact.search(formatted, at)
        end = found.start() - self._exact.search(after).start() if found else -1
        if end < at or not formatted.startswith(after, end):
            raise ValueError(f"no {after!r} ends the text at {at}")
        return self.unescape(formatted[at:end]), end + len(after)

    def read(self, state: str, formatted: str) -> Iterator[tuple[str, str, str]]:
        """Turns of a formatted string, from the string alone: (state after it, role, text)."""
        at, (opening, closing) = 0, self.template.stray
        rules = {}
        for r in self.template.rules:
            rules.setdefault(r.state, []).append(r)
        while at < len(formatted):
            if formatted.startswith(opening, at):
                line = formatted.index("\n", at)
                name = self.unescape(formatted[at + len(opening) : line])
                role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name)
                text, at = self._text(formatted, line + 1, closing)
                state = STRAY
            else:
                rule = next((r for r in rules.get(state, ()) if formatted.startswith(r.before, at)), None)
                if rule is None:
                    raise ValueError(f"no rule of state {state!r} fits at {at}")
                text, at = self._text(formatted, at + len(rule.before), rule.after)
                state, role = rule.next, rule.role
            yield state, role, text


SEGMENTS = "array<struct<text:string,loss:boolean>>"


def format_turns(df: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, position, role, state, valid, segments)``, one row a turn, in order within each partition.

    ``position`` counts a conversation's turns from 0, ``state`` is the machine's after the turn, ``valid`` says
    that all turns so far were allowed.
    """
    kind = df.schema[conv].dataType.simpleString()
    rows = df.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.col(role).cast("string").alias("r"), F.col(text).cast("string").alias("t"))
    rows = rows.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", F.coalesce("r", F.lit("")).alias("r"), F.coalesce("t", F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, state, position = Machine(template), object(), template.start, 0
        for batch in batches:
            places, states, parts = [], [], []
            for c, r, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if position == 0 or c != now:
                    now, state, position = c, template.start, 0
                state, segments = machine.write(state, r, t)
                places.append(position)
                states.append(state)
                parts.append([{"text": x, "loss": y} for x, y in segments])
                position += 1
            segment = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            columns = [batch.column(0), pa.array(places, pa.int64()), batch.column(1), pa.array(states, pa.string()), pa.array([s != STRAY for s in states], pa.bool_()), pa.array(parts, segment)]
            yield pa.RecordBatch.from_arrays(columns, ["c", "position", "role", "state", "valid", "segments"])

    out = rows.mapInArrow(run, f"c {kind}, position long, role string, state string, valid boolean, segments {SEGMENTS}")
    return out.withColumnRenamed("c", conv)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv, start: str):
        self.conv, self.state = conv, start
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.error = None

    def row(self, ends: tuple[str, ...]) -> tuple:
        return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.error is None, self.error, self.state in ends)


def read_back(turns: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id") -> DataFrame:
    """One row a conversation, read from the formatted strings of ``format_turns``: number of turns, digest of
    roles and texts, characters and digest of what the loss mask covers (unescaped), formatted characters, and
    whether the roles were in order, the first position out of order, and whether the end is one.

    ``turns`` must still be in the order in which ``format_turns`` gives its rows.
    """
    kind = turns.schema[conv].dataType
    rows = turns.select(F.col(conv).alias("c"), "position", "segments")
    schema = T.StructType(
        [T.StructField(conv, kind)]
        + [T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("valid", T.BooleanType()), ("first_error", T.LongType()), ("complete", T.BooleanType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, id_type = Machine(template), None, None

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), types, strict=True)], schema.names)

        for batch in batches:
            done, id_type = [], batch.schema.field(0).type
            for c, position, segments in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if position == 0:
                    if now:
                        done.append(now.row(template.ends))
                    now = _Digest(c, template.start)
                formatted = "".join(s["text"] for s in segments)
                now.chars += len(formatted)
                for state, role, text in machine.read(now.state, formatted):
                    if state == STRAY and now.error is None:
                        now.error = now.n
                    now.state, now.n = state, now.n + 1
                    now.turns.update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        learned = machine.unescape(s["text"])
                        now.loss_chars += len(learned)
                        now.loss.update(learned.encode())
            if done:
                yield batch_of(done)
        if now:
            yield batch_of([now.row(template.ends)])

    return rows.mapInArrow(run, schema)


def oracle() -> str:
    """DuckDB SQL of the query: this template's machine depends on the last role alone, so a lag stands for it."""
    escape = lambda x: f"regexp_replace(regexp_replace({x}, '(<)(\\\\*/?s>)', '\\1\\\\\\2', 'g'), '(\\[)(\\\\*/?(?:INST|SYS|TURN)\\])', '\\1\\\\\\2', 'g')"
    whens = "\n".join(f"WHEN role = '{r.role}' AND prev IS NOT DISTINCT FROM {'NULL' if r.state == 'start' else repr(r.state)} THEN ['{r.before}', '{r.after}']" for r in INSTRUCT.rules)
    name = escape("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS prev FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS (SELECT *, CASE {whens} END AS rule FROM o),
s AS (SELECT *, max(rule IS NULL) OVER (PARTITION BY conv_id ORDER BY i) AS stray FROM r),
f AS (SELECT *, {escape('text')} AS e, {name} AS name FROM s),
g AS (SELECT *, CASE WHEN stray THEN '[TURN] ' || name || chr(10) || e || ' [/TURN]' ELSE rule[1] || e || rule[2] END AS formatted FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i)) AS loss_sha256,
CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars, NOT bool_or(stray) AS valid, CAST(min(CASE WHEN stray THEN i - 1 END) AS BIGINT) AS first_error,
NOT bool_or(stray) AND max_by(role, i) IN ('user', 'assistant') AS complete FROM g GROUP BY conv_id"""
