"""Secret scans through a trigram index.

``required`` derives a Boolean trigram query from a regex (after the published code-search technique): a
query is ``None`` (no mandatory trigram: scan fully) or a set of alternatives, each a set of trigrams
that must all occur.  ``with_postings`` builds the index over the trigrams that the rules ask for.  It is
partitioned by document: the posting list of trigram k is bit k of every row's ``bits``, so intersecting
postings is a bitwise AND over rows, needs no shuffle of texts and has no hot list.  Only candidates are
verified by the regex itself; ``inverted`` gives the same index trigram by trigram.

Spans are code-point offsets (end exclusive).  They come from the pieces between matches, so one regex
pass yields text and place of each match.  Everything is DataFrame expressions on the JVM.

Defined cases: null text is empty and has no spans; repeated rows are scanned row by row; other columns
pass through.  Matches are leftmost and non-overlapping per kind; spans of two kinds may overlap.
An empty table gives no rows; a very long text is matched whole, its spans found in linear memory.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.llm.common import fresh, let, scan, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex (Java and Python syntax alike), and the least length of a group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in listed order.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

#: Published formats of other keys.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)

RULES = BASE_RULES + MORE_RULES

#: Sets of alternatives larger than this are cut to their trigrams.
MOST = 64

Query = frozenset | None


def _grams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _both(a: Query, b: Query) -> Query:
    """Both must hold."""
    if a is None or b is None:
        return a if b is None else b
    joined = frozenset(x | y for x in a for y in b)
    return joined if len(joined) <= MOST else a


def _either(a: Query, b: Query) -> Query:
    return None if a is None or b is None else a | b


def _of_set(exact: frozenset) -> Query:
    """What a set of alternatives demands; a member under three characters demands nothing."""
    return None if not exact or any(len(x) < 3 for x in exact) else frozenset(_grams(x) for x in exact)


def _letters(items: list) -> frozenset | None:
    """The characters of a class, lower-cased, or None if they are too many."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _walk(tree) -> tuple[frozenset | None, Query]:
    """Of a parsed sequence: the set of texts that it matches (None: many), and what it demands."""
    run: frozenset | None = frozenset([""])  # the exact texts since the last unknown part
    whole, need = True, None
    for op, arg in tree:
        exact, demand = None, None
        if op is C.LITERAL:
            exact = frozenset([chr(arg).lower()])
        elif op is C.IN:
            exact = _letters(arg)
        elif op is C.SUBPATTERN:
            exact, demand = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = frozenset().union(*(e for e, _ in parts))
            demand = reduce(_either, (_both(d, _of_set(e)) if e is not None else d for e, d in parts))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, inner_need = _walk(body)
            if (low, high) == (0, 1) and inner is not None:
                exact = inner | {""}
            elif low > 0:
                demand = _both(inner_need, _of_set(inner) if inner is not None else None)
                if inner is not None and low == high and len(inner) ** low <= MOST:
                    exact = reduce(lambda a, b: frozenset(x + y for x in a for y in b), [inner] * low)
        elif op is C.AT:
            exact = frozenset([""])
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(x + y for x in run for y in exact)
            continue
        need = _both(_both(need, _of_set(run)), _both(demand, _of_set(exact) if exact is not None else None))
        run, whole = frozenset([""]), False
    return (run, need) if whole else (None, _both(need, _of_set(run)))


def required(pattern: str) -> Query:
    """The Boolean trigram query of a regex over lower-cased text; None if it has no mandatory trigram."""
    exact, need = _walk(_parser.parse(pattern))
    return _both(need, _of_set(exact)) if exact is not None else need


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries ask for, in order: bit k belongs to the k-th."""
    return sorted({g for r in rules for alt in (required(r.pattern) or ()) for g in alt})


def posting_bits(text: Column, grams: list[str]) -> list[Column]:
    """Which of ``grams`` a text holds, as 60-bit words."""
    low = F.lower(text)

    def word(chunk: list[str]):
        flag = lambda t, i, g: F.when(F.contains(t, F.lit(g)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        return lambda t: reduce(lambda a, b: a.bitwiseOR(b), (flag(t, i, g) for i, g in enumerate(chunk)))

    return [let(low, word(grams[i : i + 60])) for i in range(0, len(grams), 60)]


def with_postings(docs: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> tuple[DataFrame, str]:
    """``docs`` with the index column (array of 60-bit words over ``vocabulary(rules)``), and its name."""
    grams, name = vocabulary(rules), fresh(docs, "postings")
    bits = posting_bits(text_of(F.col(f"`{text_col}`")), grams)
    return docs.withColumn(name, F.array(*bits) if bits else F.array().cast("array<bigint>")), name


def inverted(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index read by trigram: ``(trigram, doc_id)``, one row a posting."""
    grams = vocabulary(rules)
    indexed, name = with_postings(docs, text_col, rules)
    held = F.array(
        *(F.when(F.get(F.col(name), i // 60).bitwiseAND(F.lit(1 << i % 60)) != 0, F.lit(g)) for i, g in enumerate(grams))
    )
    return indexed.select(F.explode(F.array_compact(held)).alias("trigram"), F.col(id_col).alias("doc_id"))


def candidate(query: Query, bits: Column, grams: list[str]) -> Column:
    """Intersection of the postings that a query asks for, united over its alternatives."""
    if query is None:
        return F.lit(True)

    def all_of(alt: frozenset) -> Column:
        masks: dict[int, int] = {}
        for g in alt:
            masks[grams.index(g) // 60] = masks.get(grams.index(g) // 60, 0) | 1 << grams.index(g) % 60
        return reduce(lambda a, b: a & b, (F.get(bits, w).bitwiseAND(F.lit(m)) == F.lit(m) for w, m in sorted(masks.items())))

    return reduce(lambda a, b: a | b, (all_of(a) for a in sorted(query, key=sorted)))


def _found(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule: array of (start, ord, end)."""

    def place(t: Column) -> Column:
        gaps = F.transform(F.split(t, rule.pattern, -1), lambda p: F.length(p))
        hits = F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(0))
        sized = F.transform(
            hits,
            lambda m: F.struct(
                F.length(m).alias("n"),
                F.length(m if rule.group == 0 else F.regexp_extract(m, rule.pattern, rule.group)).alias("g"),
            ),
        )

        def walk(both: Column) -> Column:
            steps = F.transform(both["hits"], lambda m, i: m["n"] + F.get(both["gaps"], i))
            ends = lambda e: F.transform(
                both["hits"],
                lambda m, i: F.struct((F.get(e, i) - m["n"]).alias("start"), F.lit(order).alias("ord"), F.get(e, i).alias("end"), m["g"].alias("g")),
            )
            found = let(let(steps, lambda s: scan(s, lambda x, y: x + y)), ends)
            kept = F.filter(found, lambda s: s["g"] >= rule.least)
            return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))

        return let(F.struct(gaps.alias("gaps"), sized.alias("hits")), walk)

    return let(text, place)


def spans(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """``docs`` with one array column of ``(start, ord, end)``, sorted by start, then rule; and its name."""
    grams = vocabulary(rules)
    indexed, bits = with_postings(docs, text_col, rules)
    text, none = text_of(F.col(f"`{text_col}`")), F.array().cast("array<struct<start:int,ord:int,end:int>>")
    found = []
    for order, rule in enumerate(rules):
        likely = candidate(required(rule.pattern), F.col(bits), grams)
        if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+"):  # no match at all is the usual case
            tail = rule.pattern[rule.pattern.rindex("[") : -1]
            head = rule.pattern[: rule.pattern.rindex("[")]
            if re.fullmatch(r"\w*", head):
                likely = likely & text.rlike(f"{head}{tail}{{{rule.least - len(head)}}}")
        found.append(F.when(likely, _found(text, rule, order)).otherwise(none))
    name = fresh(docs, "spans")
    return indexed.withColumn(name, F.sort_array(F.concat(*found))).drop(bits), name


def as_string(spans_col: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    one = lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans_col, one), ",")


def redact(text: Column, spans_col: Column, mark: str = "[SECRET]") -> Column:
    """The text with the union of its spans replaced by ``mark``.

    The text is cut as UTF-32, where a place is found at once; all is linear but for a logarithm of the spans.
    """
    wide = lambda t: F.encode(t, "UTF-32")
    cut = lambda w, a, n: F.decode(F.substring(w, a * 4 + 1, n * 4), "UTF-32")

    def by_reach(w: Column, reach: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
        pieces = F.transform(
            spans_col,
            lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(w, before(i), s["start"] - before(i)), F.lit(mark))).otherwise(F.lit("")),
        )
        last = F.element_at(reach, -1)
        return F.concat(F.array_join(pieces, ""), cut(w, last, F.length(w)))

    reach = scan(F.transform(spans_col, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    both = F.struct(wide(text).alias("w"), reach.alias("r"))
    return F.when(F.size(spans_col) == 0, text).otherwise(let(both, lambda b: by_reach(b["w"], b["r"])))
