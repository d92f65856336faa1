"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Texts beyond this size are worked on in slices, so that a worker's memory doesn't grow with their words.
LONG = 4_000_000
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def slices(raw: bytes, size: int | None = None) -> Iterator[bytes]:
    """A text's bytes in slices of about ``size``, cut at white space, so that no word is parted."""
    size, start = size or LONG, 0
    while start < len(raw):
        gap = _BLANK.search(raw, start + size)
        end = gap.start() if gap else len(raw)
        yield raw[start:end]
        start = end


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside one expression, so that it is evaluated once however often used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative operation over an array, by doubling: O(n log n), no growing copies."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))

    def double(a: Column, k: Column) -> Column:
        back = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(a, lambda x, i: F.when(i >= back, op(x, F.get(a, i - back))).otherwise(x))

    return F.aggregate(rounds, values, double)


def text_of(col: str | Column) -> Column:
    """The text as a string; null reads as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order, repeats included."""
    return F.array_remove(F.split(text, SPACE), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_bucket(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: of the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"{base}_{uuid.uuid4().hex[:6]}"
    return name


def content_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row and of which are null (the hash itself skips nulls); nested values as JSON."""
    value = lambda c, kind: F.to_json(c, {"ignoreNullFields": "false"}) if "<" in kind else c
    return F.xxhash64(*(x for c, kind in df.dtypes for x in (F.isnull(F.col(f"`{c}`")), value(F.col(f"`{c}`"), kind))))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only where none is set (tests), a local one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "ripplefield-checkpoint"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Cut the lineage by a table in the shared folder.

    Unlike a checkpoint, a table read again knows no constraints of the plan that made it; in loops that derive a
    column from itself these would grow without end.  ``group_rows`` is for rows of megabytes: the writer looks at its
    memory every hundred rows only and the reader takes a row group as one, so groups of fewer rows bound both.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.options(**({"parquet.block.row.count.limit": str(group_rows)} if group_rows else {})).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of about ``most`` bytes, for eager work on rows of megabytes; what was set before comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one, as a path that drivers and executors can open as files.

    Raises ``ValueError`` if the shared folder is in a store without file access (mount it, or name a
    mounted ``spark.checkpoint.dir``).
    """
    url = urlparse(checkpoint_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted shared folder; {url.scheme}:// is none")
    path = os.path.join(url.path, f"{kind}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path
