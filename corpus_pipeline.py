"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and lets its decisions
take effect; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplefield.llm import mixing, packing, quality_rules, secrets, simhash
from ripplefield.llm.common import checkpoint_dir, fresh


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v2 of the quality rules keeps."""
    rows, name = quality_rules.ledger(docs)
    return rows.where(quality_rules.apply_policy(F.col(name)["failure_bits"], "v2")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: texts whose sets of 5-word shingles have a Jaccard similarity of
    0.8 or more are linked; the row of least id stays.  Different texts of one id are documents of their own."""
    return simhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and ``n_chars`` counted anew where one was."""
    rows, name = secrets.spans(docs)
    clean = fresh(rows, "clean")
    rows = rows.withColumn(clean, secrets.redact(secrets.text_of("text"), F.col(name)))
    some = F.size(name) > 0
    changed = {"text": F.when(some, F.col(clean)).otherwise(F.col("text")), "n_chars": F.when(some, F.length(clean).cast("long")).otherwise(F.col("n_chars"))}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities that are calibrated to flatter source, language and topic shares."""
    rows, names = mixing.mix(docs)
    return rows.where(names["sampled"]).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, placed in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: SQL has no XXH64 fingerprints and no tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    return docs
