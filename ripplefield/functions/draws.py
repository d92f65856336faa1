"""Random numbers that depend on keys alone, so that a repeated task, another partitioning or SQL draws the same."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296.0


def _word(keys: tuple, part: int) -> Column:
    """32 bits of the MD5 of the keys, joined by colons; ``part`` is 0 to 3."""
    digest = F.md5(F.concat_ws(":", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys)).cast("binary"))
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("double")


def uniform(*keys, part: int = 0) -> Column:
    """A number in [0, 1)."""
    return _word(keys, part) / F.lit(SPAN)


def gaussian(*keys) -> Column:
    """A standard normal number, from two uniform ones of the same keys."""
    radius = F.sqrt(-2 * F.ln((_word(keys, 0) + 0.5) / F.lit(SPAN)))
    return radius * F.cos(2 * math.pi * uniform(*keys, part=1))


def uniform_sql(keys: str, part: int = 0) -> str:
    """The same in DuckDB's SQL; ``keys`` are the arguments of ``concat_ws``."""
    return f"(CAST(('0x' || substr(md5(concat_ws(':', {keys})), {1 + 8 * part}, 8)) AS UBIGINT) / {SPAN})"


def gaussian_sql(keys: str) -> str:
    """The same in DuckDB's SQL."""
    return f"(sqrt(-2 * ln({uniform_sql(keys)} + 0.5 / {SPAN})) * cos(2 * pi() * {uniform_sql(keys, 1)}))"
