"""Name -> query and name -> SQL oracle, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplefield.plans import basics, more, scalars, signals, spectra, windows

MODULES = [basics, scalars, signals, windows, spectra, more]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered signal queries."""
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL oracles of the signal queries that SQL can express."""
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
