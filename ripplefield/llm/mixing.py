"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) with one partial/final aggregation, so a hot
source costs no more than a cold one.  ``rake`` then scales the cells' token weights to the target
marginal of one dimension after the other, never above the tokens that a cell has.  A document is
sampled with probability weight / tokens of its cell, by a uniform number derived from its id alone, so
that a lost executor or a second run takes the same decisions.

Only the cells iterate: their number is bounded by the combinations of dimension values, and their sums are
aggregations by one dimension at a time.  Everything is DataFrame expressions on the JVM.  The iterations are a
fixed number; ``marginal_errors`` of ``fit`` tells how far each share is from its target after them.

Defined cases: null dimension values form cells of their own; null or empty texts have no tokens; a cell
without tokens has probability 0; repeated rows share their id's decision; null ids count as the empty
id; other columns pass through, whatever their names; an empty table gives no rows; a very long text is only
counted, in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefield.llm.common import WORD, cut, fresh, text_of, written

#: Topic by the first marker that a text holds; else ``prose``.
TOPIC_MARKERS = (("licence", "icensed under"), ("table", " | "), ("contact", "@"))

DIMENSIONS = ("source", "lang", "topic")

#: A join side of more rows than this is not broadcast.
BROADCAST_ROWS = 50_000


def topic_of(text: Column) -> Column:
    """Topic of a text by ``TOPIC_MARKERS``."""
    topic = F.lit("prose")
    for name, marker in reversed(TOPIC_MARKERS):
        topic = F.when(F.contains(text, F.lit(marker)), F.lit(name)).otherwise(topic)
    return topic


def uniform(id_col: Column, salt: str = "") -> Column:
    """A number in [0, 1) that depends on the id only: 32 bits of an MD5."""
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(salt))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def count_cells(docs: DataFrame, dims: tuple[str, ...], tokens: str) -> DataFrame:
    """Tokens of each combination of dimension values."""
    return docs.groupBy(*dims).agg(F.sum(tokens).cast("double").alias("n"))


def _beside(cells: DataFrame, table: DataFrame, d: str) -> DataFrame:
    """Cells with the columns of a table ``(key__, ..)`` of one dimension's values; nulls match nulls."""
    return cells.join(table, F.col(d).eqNullSafe(F.col("key__")), "left").drop("key__")


def with_targets(cells: DataFrame, targets: Mapping[str, float | DataFrame]) -> DataFrame:
    """Cells with a target share per dimension: a table ``(value, share)``, or a power of the present share.

    The share of a table's value that no cell has can't be met and stays unfilled; a table that names a value twice raises
    ``ValueError``.
    """
    total = float(cells.agg(F.sum("n")).first()[0] or 0.0)
    for d, a in targets.items():
        if isinstance(a, DataFrame):
            table = a.select(F.col("value").alias("key__"), F.col("share").cast("double").alias(f"t_{d}"))
            if not table.groupBy("key__").count().where("count > 1").isEmpty():
                raise ValueError(f"a target for {d} names a value more than once")
        else:
            sums = cells.groupBy(F.col(d).alias("key__")).agg(F.sum("n").alias("have"))
            power = F.when(F.col("have") > 0, F.pow("have", F.lit(float(a)))).otherwise(F.lit(0.0))
            norm = float(sums.agg(F.sum(power)).first()[0] or 1.0)
            table = sums.select("key__", (power / F.lit(norm)).alias(f"t_{d}"))
        cells = _beside(cells, table, d).fillna(0.0, [f"t_{d}"])
    return cells.withColumn("total", F.lit(total))


def rake(cells: DataFrame, dims: tuple[str, ...], keep: float, iterations: int) -> DataFrame:
    """Fit the weights ``w`` to the shares ``t_<dim>`` of ``keep * total`` tokens, each capped by ``n``.

    Each marginal is a partial and final aggregation that is joined back, so that no task holds all cells of a
    frequent value; every iteration is cut off its lineage.
    """
    cells = written(cells.withColumn("w", F.col("n") * F.lit(keep)))
    few = cells.count() <= BROADCAST_ROWS  # then one partition needs no exchange
    for _ in range(iterations):
        cells = cells.coalesce(1) if few else cells
        for d in dims:
            sums = cells.groupBy(F.col(d).alias("key__")).agg(F.sum("w").alias("have__"))
            scale = F.try_divide(F.col(f"t_{d}") * F.lit(keep) * F.col("total"), F.col("have__"))
            cells = _beside(cells, sums, d).withColumn("w", F.least(F.col("w") * F.coalesce(scale, F.lit(0.0)), F.col("n"))).drop("have__")
        cells = written(cells)
    return cells


def marginal_errors(cells: DataFrame) -> DataFrame:
    """Per raked dimension and value: target share and share reached after raking; their difference tells convergence."""
    total = float(cells.agg(F.sum("w")).first()[0] or 0.0)
    one = lambda d: cells.groupBy(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")).agg(F.max(f"t_{d}").alias("target"), F.sum("w").alias("w"))
    out = reduce(DataFrame.unionByName, (one(d) for d in DIMENSIONS if f"t_{d}" in cells.columns))
    return out.select("dim", "value", "target", F.try_divide(F.col("w"), F.lit(total)).alias("reached"))


def fit(
    docs: DataFrame,
    text_col: str = "text",
    targets: Mapping[str, float | DataFrame] | None = None,
    keep: float = 0.7,
    iterations: int = 8,
    topic: Column | None = None,
) -> DataFrame:
    """The raked cells ``(source, lang, topic, n, w)`` with their target shares, for ``marginal_errors`` too."""
    targets = targets or {"source": 0.7, "lang": 0.7, "topic": 0.7}
    if not set(targets) <= set(DIMENSIONS):
        raise ValueError(f"targets are for {DIMENSIONS}")
    named = tuple(d for d in DIMENSIONS if d in targets)
    text = text_of(F.col(f"`{text_col}`"))
    slim = docs.select("source", "lang", (topic_of(text) if topic is None else topic).alias("topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))
    return rake(with_targets(cut(count_cells(slim, DIMENSIONS, "n_tokens")), targets), named, keep, iterations)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    targets: Mapping[str, float | DataFrame] | None = None,
    keep: float = 0.7,
    iterations: int = 8,
    salt: str = "",
    topic: Column | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with topic, tokens, inclusion probability and the sampling decision.

    ``targets`` names, for ``source``, ``lang`` and ``topic`` or some of them, a table of shares or a power of the
    present share (below 1: flatter); a dimension without a target is not raked; ``keep`` is the share of all tokens wanted; ``topic`` is a column that says the
    topic (by default ``topic_of`` the text).  Returns the frame and the names of the added columns.
    """
    names = {c: fresh(docs, c) for c in ("topic", "tokens", "probability", "sampled")}
    text = text_of(F.col(f"`{text_col}`"))
    keyed = docs.withColumn(names["topic"], topic_of(text) if topic is None else topic)
    fitted = fit(docs, text_col, targets, keep, iterations, topic)
    cell = {d: fresh(keyed, f"cell_{d}") for d in DIMENSIONS}
    p = F.coalesce(F.try_divide(F.col("w"), F.col("n")), F.lit(0.0)).alias(names["probability"])
    rates = cut(fitted.select(*(F.col(d).alias(cell[d]) for d in DIMENSIONS), p))
    small = rates.count() <= BROADCAST_ROWS
    match = reduce(lambda a, b: a & b, (F.col(names.get(d, d)).eqNullSafe(F.col(cell[d])) for d in DIMENSIONS))
    out = keyed.join(F.broadcast(rates) if small else rates, match, "left").drop(*cell.values())
    out = out.withColumn(names["tokens"], F.regexp_count(text, F.lit(WORD)).cast("long"))
    return out.withColumn(names["sampled"], uniform(F.col(id_col), salt) < F.col(names["probability"])), names


def oracle(keep: float = 0.7, power: float = 0.7, iterations: int = 8) -> str:
    """DuckDB SQL for ``mix`` over ``documents`` with one power for all dimensions."""
    topic = "CASE " + " ".join(f"WHEN contains(t, '{m}') THEN '{n}'" for n, m in TOPIC_MARKERS) + " ELSE 'prose' END"
    parts = [
        f"d AS (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS n FROM d GROUP BY ALL)",
        "m AS (SELECT *, sum(n) OVER (PARTITION BY source) AS n_source, sum(n) OVER (PARTITION BY lang) AS n_lang, sum(n) OVER (PARTITION BY topic) AS n_topic, sum(n) OVER () AS total FROM c)",
        "s0 AS (SELECT *, " + ", ".join(f"CASE WHEN n_{d} > 0 THEN n_{d} ^ {power} / sum(CASE WHEN n_{d} > 0 THEN n * n_{d} ^ ({power} - 1) END) OVER () ELSE 0 END AS t_{d}" for d in DIMENSIONS) + f", n * {keep} AS w FROM m)",
    ]
    k = 0
    for _ in range(iterations):
        for d in DIMENSIONS:
            parts.append(
                f"s{k + 1} AS (SELECT * EXCLUDE (w), least(w * coalesce(t_{d} * {keep} * total / nullif(sum(w) OVER (PARTITION BY {d}), 0), 0), n) AS w FROM s{k})"
            )
            k += 1
    u = "CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS UBIGINT) / 4294967296.0"
    p = "coalesce(w / nullif(n, 0), 0)"
    return (
        "WITH " + ", ".join(parts) + f" SELECT doc_id, d.topic, CAST(tokens AS BIGINT) AS tokens, round({p}, 6) AS probability, {u} < {p} AS sampled"
        f" FROM d JOIN s{k} s ON d.source IS NOT DISTINCT FROM s.source AND d.lang IS NOT DISTINCT FROM s.lang AND d.topic IS NOT DISTINCT FROM s.topic"
    )
