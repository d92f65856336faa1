"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements and one failure bit a
rule.  A *policy* is a versioned mask over those bits, so applying, changing or ablating a policy never
reads a text again: ``apply_policy`` is a bitwise AND and ``ablation`` works on the histogram of
failure masks, which has at most 2**rules rows whatever the corpus size.

The work on a text stays inside its row (array functions, no explode, no shuffle), so neither a hot
source nor a group of copies can skew it; memory is a small multiple of the longest text.

Defined cases: null and empty texts count as zero words and fail ``few_words``; repeated rows are
judged row by row; ids may be null; other columns pass through (``ledger`` adds one struct column under
a name that is still free).  Three-word windows are compared by 64-bit hashes.  An empty table gives no rows; the
words of one text are held at a time, so a very long text costs memory in proportion to its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.llm.common import SPACE, fresh, let, text_of, words_of


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules; the first two belong to the base policy."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_100_words: int = 100
    max_dup_line_percent: int = 60
    min_word_length: float = 2.0
    max_word_length: float = 25.0
    min_letter_percent: int = 50
    max_upper_percent: int = 60


#: Rule names in bit order.
RULES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "few_letters", "shouting")

BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Policies by version: the mask of the rules that reject a document.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_windows"],
    "v1": BIT["few_words"] | BIT["repeated_windows"] | BIT["symbols"] | BIT["duplicate_lines"],
    "v2": (1 << len(RULES)) - 1,
}

BASE = POLICIES["base"]


def _repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more.

    The windows' hashes are sorted with their positions; equal neighbours are repeated windows, and the
    union of their three-word spans is summed from the gaps between sorted positions: O(n log n).
    """
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spans(s: Column) -> Column:
            last = F.size(s) - 1
            twin = F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])),
            )
            start = F.sort_array(F.transform(twin, lambda x: x["i"]))
            total = lambda p: F.aggregate(
                p,
                F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
                lambda a, x: F.struct((a["sum"] + F.least(x - a["last"], F.lit(3))).alias("sum"), x.alias("last")),
                lambda a: a["sum"],
            )
            return let(start, total)

        plain = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(plain, F.lit(0)).otherwise(let(pairs, spans))

    windows = F.transform(F.slice(words, 1, n - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 4, F.lit(0)).otherwise(let(windows, covered))


def measurements(text: Column) -> Column:
    """All measurements of one text as a struct of longs."""
    count = lambda t, drop: F.length(F.regexp_replace(t, drop, ""))

    def by_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        by_words = lambda w: F.struct(F.size(w).alias("n_words"), _repeated_words(w).alias("n_repeat_words"))
        by_lines = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
        w, x = let(words_of(t), by_words), let(lines, by_lines)
        return F.struct(
            w.alias("w"),
            x.alias("x"),
            count(t, SPACE).alias("word_chars"),
            count(t, r"[^#*$%&|<>]+").alias("n_symbols"),
            count(t, r"[^\p{L}]+").alias("n_letters"),
            count(t, r"[^\p{Lu}]+").alias("n_upper"),
        )

    flat = lambda s: F.struct(
        *(s["w"][c].cast("long").alias(c) for c in ("n_words", "n_repeat_words")),
        *(s["x"][c].cast("long").alias(c) for c in ("n_lines", "n_dup_lines")),
        *(s[c].cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_letters", "n_upper")),
    )
    return let(let(text, by_text), flat)


def failure_bits(m: Column, limits: Limits) -> Column:
    """The rules that a struct of measurements fails, as a mask."""
    some = m["n_words"] > 0
    fails = {
        "few_words": m["n_words"] < limits.min_words,
        "repeated_windows": 100 * m["n_repeat_words"] > limits.max_repeat_percent * m["n_words"],
        "symbols": 100 * m["n_symbols"] > limits.max_symbols_per_100_words * m["n_words"],
        "duplicate_lines": 100 * m["n_dup_lines"] > limits.max_dup_line_percent * m["n_lines"],
        "word_length": some & ((m["word_chars"] < limits.min_word_length * m["n_words"]) | (m["word_chars"] > limits.max_word_length * m["n_words"])),
        "few_letters": some & (100 * m["n_letters"] < limits.min_letter_percent * m["word_chars"]),
        "shouting": 100 * m["n_upper"] > limits.max_upper_percent * m["n_letters"],
    }
    mask = F.lit(0)
    for name in RULES:
        mask = mask.bitwiseOR(F.when(fails[name], F.lit(BIT[name])).otherwise(F.lit(0)))
    return mask


def ledger(docs: DataFrame, text_col: str = "text", limits: Limits = Limits(), name: str = "ledger") -> tuple[DataFrame, str]:
    """``docs`` with one more struct column: the measurements and ``failure_bits``; returns its name too."""
    name = fresh(docs, name)
    raw = fresh(docs, f"{name}_raw")
    measured = docs.withColumn(raw, measurements(text_of(F.col(f"`{text_col}`"))))
    fields = [c for c in measured.schema[raw].dataType.names]
    entry = F.struct(*(F.col(raw)[c].alias(c) for c in fields), failure_bits(F.col(raw), limits).alias("failure_bits"))
    return measured.withColumn(name, entry).drop(raw), name


def apply_policy(bits: Column, policy: str = "v2") -> Column:
    """True where a policy keeps the document."""
    return bits.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, bits: Column, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that dropping it would keep.

    One aggregation to the histogram of masks (bounded by the rules), then bitwise arithmetic on it.
    """
    mask = POLICIES[policy]
    hist = rows.groupBy(bits.bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("docs"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in RULES if BIT[r] & mask)))
    x = hist.select("bits", "docs", rules.alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    count = lambda c: F.sum(F.when(c, F.col("docs")).otherwise(F.lit(0)))
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        count(hit).alias("failed"),
        count(alone).alias("failed_alone"),
        count(F.col("bits") == 0).alias("kept"),
        count((F.col("bits") == 0) | alone).alias("kept_without_rule"),
    )
