"""DuckDB SQL for the operators that SQL can express exactly; the others are tested against brute force."""

from __future__ import annotations

from ripplefield.llm import chat, mixing, quality_rules, secrets

SPACE = r"[\x20\x09-\x0D]"


def quality() -> str:
    """The rule ledger under policy v2."""
    x = quality_rules.Limits()
    some = "n_words > 0"
    fails = (
        f"n_words < {x.min_words}",
        f"100 * n_repeat_words > {x.max_repeat_percent} * n_words",
        f"100 * n_symbols > {x.max_symbols_per_100_words} * n_words",
        f"100 * n_dup_lines > {x.max_dup_line_percent} * n_lines",
        f"{some} AND (word_chars < {x.min_word_length} * n_words OR word_chars > {x.max_word_length} * n_words)",
        f"{some} AND 100 * n_letters < {x.min_letter_percent} * word_chars",
        f"100 * n_upper > {x.max_upper_percent} * n_letters",
    )
    bits = " + ".join(f"CASE WHEN {f} THEN {1 << i} ELSE 0 END" for i, f in enumerate(fails))
    drop = lambda c: f"CAST(length(regexp_replace(t, '{c}', '', 'g')) AS BIGINT)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM g),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, range(3) t(k) WHERE c > 1 GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, {drop(SPACE + '+')} AS word_chars, {drop('[^#*$%&|<>]+')} AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, {drop('[^\\p{L}]+')} AS n_letters, {drop('[^\\p{Lu}]+')} AS n_upper FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits FROM b"""


def secret_spans() -> str:
    """Spans of every rule, from the pieces between matches."""
    parts, lists = [], []
    for k, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"regexp_split_to_array(t, '{p}') AS p{k}, regexp_extract_all(t, '{p}', 0) AS h{k}, regexp_extract_all(t, '{p}', {r.group}) AS g{k}")
        at = f"CAST(list_sum(list_transform(p{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h{k}[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
        lists.append(f"list_transform(list_filter(range(1, len(h{k}) + 1), lambda i: length(g{k}[i]) >= {r.least}), lambda i: struct_pack(a := {at}, o := {k}, b := {at} + length(h{k}[i])))")
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"
    text = lambda s: f"coalesce(array_to_string(list_transform({s}, lambda x: {kinds}[x.o + 1] || ':' || x.a || ':' || x.b), ','), '')"
    base = "list_filter(s, lambda x: x.o < 3)"
    count = ", ".join(f"CAST(len(list_filter(s, lambda x: x.o = {k})) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(secrets.BASE_RULES))
    return f"""WITH m AS (SELECT doc_id, {', '.join(parts)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
s AS (SELECT doc_id, list_sort(flatten([{', '.join(lists)}])) AS s FROM m)
SELECT doc_id, {count}, sha256({text(base)}) AS base_sha256, {text('s')} AS spans FROM s"""


def lexical_search() -> str:
    """Scores of all documents for every item, without an index."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {terms} AS t FROM documents),
s AS (SELECT rid, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
c AS (SELECT count(*) AS docs, sum(n) AS tokens FROM s),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
m AS (SELECT rid, doc_id, 75 + (25 * n * docs) // tokens AS m FROM s, c),
q AS (SELECT row_number() OVER () AS q, item_id, {terms} AS t FROM benchmark),
a AS (SELECT q, item_id, term, count(*) AS k FROM (SELECT q, item_id, unnest(t) AS term FROM q) GROUP BY q, item_id, term),
r AS (SELECT q, item_id, doc_id, rid, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS score FROM a JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY q, item_id, doc_id, rid),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 20"""


ORACLES = {"op1_quality_rules": quality(), "op8_secret_scan": secret_spans(), "op9_source_mixing": mixing.oracle(), "op11_chat_formatting": chat.oracle(), "op13_lexical_search": lexical_search()}
