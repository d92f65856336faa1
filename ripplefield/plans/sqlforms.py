"""SQL forms of the table adapters, and helpers that queries and oracles share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EV = "ev AS (SELECT user_id AS clip_id, 0 AS ch, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, value - 50.0 AS v FROM events)"
EMB = "emb AS (SELECT vec_id AS clip_id, 0 AS ch, CAST(unnest(range(64)) AS BIGINT) AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
ST = f"{EMB}, st AS (SELECT clip_id, CAST(idx % 2 AS INTEGER) AS ch, idx // 2 AS idx, v FROM emb)"


def r6(c: Column | str) -> Column:
    """Six digits, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with some columns at six digits."""
    return df.withColumns({c: r6(c) for c in cols})


class Registry:
    """Queries and their oracles, as they are defined."""

    def __init__(self):
        self.QUERIES, self.ORACLES = {}, {}

    def add(self, name: str, query, sql: str | None = None) -> None:
        """Register a query; ``sql`` is its oracle."""
        if name in self.QUERIES:
            raise ValueError(f"{name} is taken")
        self.QUERIES[name] = query
        if sql:
            self.ORACLES[name] = sql
