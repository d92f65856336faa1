"""Every signal query against its SQL oracle in DuckDB, and the independence of the corpus part."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from ripplefield.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(found):
    key = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)
    return sorted([key(v) for v in r] for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.sql(registry.oracle_sql()[name])
    assert cols == sorted(rel.columns)
    assert rows(df.select(*cols).collect()) == rows(rel.select(*(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_imports_without_the_corpus_part(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q); assert len(q) > 200 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
