"""Token counts attributed to sections through offsets.

A whole document is encoded once; the byte widths of its tokens give character spans, which are joined with
the sections' character intervals by binary search over the sorted starts (an interval join inside the row:
no token ever becomes a row of its own, so nothing is shuffled).  A token that lies across a boundary is
allocated by an explicit rule:

``start``     to the section of its first character;
``majority``  to the section with most of its characters, the earlier one on ties;
``split``     to every section it touches, by the share of its characters there.

Counts of a document add up to its tokens under every rule; tokens in no section count for section -1.

Defined cases: null and empty texts have one empty section 0 without tokens; lines are closed by their
``\\n``, which belongs to the line before it; repeated rows give repeated results; characters are code
points, and a token that holds a part of a character touches that character; other columns are not read;
very long texts are encoded in slices; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefield.llm.encoding import Encoder, default_paths, encoder

RULES = ("start", "majority", "split")


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines of a text, each with its line feed; they tile the text."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    starts = np.r_[0, ends[:-1]]
    if len(ends) > 1 and starts[-1] == ends[-1]:  # a final line feed opens no section
        starts, ends = starts[:-1], ends[:-1]
    return starts, ends


def token_spans(text: str, enc: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each token of a text."""
    widths = enc.widths[enc.array(text)]
    ends = np.cumsum(widths)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(ends) and ends[-1] != len(raw):
        raise ValueError("tokens don't cover the text")
    if len(raw) == len(text):
        return ends - widths, ends
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[ends - widths], char[ends - 1] + 1


def allocate(first: np.ndarray, past: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section, tokens that cross one of its ends, and tokens in no section.

    Sections are sorted and disjoint; gaps are allowed.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if (starts > ends).any() or (starts[1:] < ends[:-1]).any():
        raise ValueError("sections must be sorted and disjoint")
    n = len(starts)
    a = np.searchsorted(starts, first, "right") - 1  # the last section that starts at or before the token
    b = np.searchsorted(starts, past - 1, "right") - 1
    inside = (a >= 0) & (a == b) & (past <= ends[np.maximum(a, 0)])
    counts = np.bincount(a[inside], minlength=n).astype(np.float64)
    crossing, outside = np.zeros(n, np.int64), 0.0
    for k in np.flatnonzero(~inside):  # few: tokens over a boundary or in a gap
        s = np.arange(max(a[k], 0), b[k] + 1)
        shared = np.minimum(ends[s], past[k]) - np.maximum(starts[s], first[k])
        s, shared = s[shared > 0], shared[shared > 0]
        crossing[s] += 1
        width = past[k] - first[k]
        if rule == "split":
            counts[s] += shared / width
            outside += 1 - shared.sum() / width
        elif rule == "majority" and len(s) and shared.max() >= width - shared.sum():
            counts[s[shared.argmax()]] += 1
        elif rule == "start" and len(s) and starts[s[0]] <= first[k]:
            counts[s[0]] += 1
        else:
            outside += 1
    return counts, crossing, outside


def attribute(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
    rule: str = "start",
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """``(doc_id, section, start, end, tokens, crossing)``, one row a section.

    ``sections_col`` names an array of ``(start, end)``, sorted and disjoint; by default sections are lines.
    Section -1 appears only if some token lies in no section.
    """
    paths = paths or default_paths()
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    own, given_sections = [], sections_col is not None
    if given_sections:
        start, end = docs.schema[sections_col].dataType.elementType.names[:2]
        own.append(F.transform(F.col(sections_col), lambda s: F.struct(s[start].cast("long").alias("s"), s[end].cast("long").alias("e"))).alias("sections"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *own)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*paths)
        for b in batches:
            rows_of, out = [], [[], [], [], [], []]
            for i, t in enumerate(b.column(1)):
                text = t.as_py() or ""
                if given_sections:
                    given = b.column(2)[i].as_py() or []
                    starts, ends = np.array([s["s"] for s in given], np.int64), np.array([s["e"] for s in given], np.int64)
                else:
                    starts, ends = line_sections(text)
                counts, crossing, outside = allocate(*token_spans(text, enc), starts, ends, rule)
                number = np.arange(len(starts))
                if outside:
                    number, starts, ends, counts, crossing = (np.append(x, y) for x, y in ((number, -1), (starts, 0), (ends, 0), (counts, outside), (crossing, 0)))
                rows_of.append(np.full(len(number), i))
                for o, x in zip(out, (number, starts, ends, counts, crossing), strict=True):
                    o.append(x)
            if not rows_of:
                continue
            number, starts, ends, counts, crossing = map(np.concatenate, out)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.concatenate(rows_of))), pa.array(number.astype(np.int32)), pa.array(starts.astype(np.int64)), pa.array(ends.astype(np.int64)), pa.array(counts.astype(np.float64)), pa.array(crossing.astype(np.int64))],
                ["doc_id", "section", "start", "end", "tokens", "crossing"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(each, f"doc_id {kind}, section int, start long, end long, tokens double, crossing long")
