"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplefield.llm import attribution, chat, lexical, media, mixing, ngram, oracles, ordinal, packing, quality_rules, secrets, simhash, toxicity, whitening
from ripplefield.llm.common import crc_bucket


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark, sf_dir):
    """Rule ledger of every document under policy v2, which holds the base policy."""
    rows, name = quality_rules.ledger(_docs(spark, sf_dir).select("doc_id", "text"))
    m = F.col(name)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base = m["failure_bits"].bitwiseAND(F.lit(quality_rules.BASE)) != 0
    return rows.select(
        "doc_id",
        *(m[c].alias(c) for c in fields),
        base.alias("base_failed"),
        quality_rules.apply_policy(m["failure_bits"], "v2").alias("kept"),
        m["failure_bits"].cast("long").alias("failure_bits"),
    )


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_toxicity(spark, sf_dir):
    """Compression-distance score of every document; fitted on labelled rows that aren't held out."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, _labels(spark, sf_dir).select("doc_id", "toxic"))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_media_columns(spark, sf_dir):
    """Every text stored as an ISO media container, read back through its boxes and described."""
    return media.round_trip(_docs(spark, sf_dir))


def op5_lm_scoring(spark, sf_dir):
    """Kneser-Ney score of every document by a model of the documents that aren't held out."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    out = crc_bucket("doc_id", 5) == 1
    model = ngram.train(docs.where(~out))
    rows = ngram.score(docs, model)
    return rows.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_token_counts(spark, sf_dir):
    """Tokens of every line of every document; boundary tokens go to the line of their first character."""
    rows = attribution.attribute(_docs(spark, sf_dir))
    return rows.select("doc_id", "section", "start", "end", F.col("tokens").cast("long").alias("tokens"), "crossing")


def op7_ordinal_quality(spark, sf_dir):
    """Expected grade and tail probability of every document; documents likely of grade 1 at least are kept."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    ratings = ordinal.graded(_labels(spark, sf_dir)).where(~ordinal.held_out())
    rows = ordinal.score(docs, ordinal.train(docs, ratings, top=2))
    tail = F.col("tails")[0]
    return rows.select("doc_id", ordinal.held_out().alias("held_out"), "expected_grade", tail.alias("tail_probability"), (tail >= 0.5).alias("kept"))


def op8_secret_scan(spark, sf_dir):
    """Spans of every rule in every document, with the base rules' counts and digest."""
    rows, name = secrets.spans(_docs(spark, sf_dir).select("doc_id", "text"))
    s = F.col(name)
    base = F.filter(s, lambda x: x["ord"] < len(secrets.BASE_RULES))
    count = lambda k: F.size(F.filter(s, lambda x: x["ord"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE_RULES)),
        F.sha2(secrets.as_string(base).cast("binary"), 256).alias("base_sha256"),
        secrets.as_string(s).alias("spans"),
    )


def op9_source_mixing(spark, sf_dir):
    """Sampling decision of every document after raking sources, languages and topics."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang", "source")
    rows, names = mixing.mix(docs)
    return rows.select(
        "doc_id", names["topic"], names["tokens"], F.round(names["probability"], 6).alias("probability"), names["sampled"]
    )


def op4_best_fit_packing(spark, sf_dir):
    """Every document packed into sequences of 2048 tokens."""
    return packing.pack(_docs(spark, sf_dir))


def op10_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    rows = simhash.near_duplicates(_docs(spark, sf_dir))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_chat_formatting(spark, sf_dir):
    """Every conversation, and one that is made of control strings, formatted and read back."""
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.read_back(chat.format_turns(convs.union(own)))


def op12_embedding_whitening(spark, sf_dir):
    """The first 16 whitened components of every vector."""
    rows = whitening.integer_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whitening.whiten(rows, whitening.fit(rows, components=16))


def op13_lexical_search(spark, sf_dir):
    """The 20 best documents of every benchmark item."""
    index = lexical.build(_docs(spark, sf_dir))
    return lexical.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_media_columns": op3_media_columns,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_counts": op6_token_counts,
    "op7_ordinal_quality": op7_ordinal_quality,
    "op8_secret_scan": op8_secret_scan,
    "op9_source_mixing": op9_source_mixing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = dict(oracles.ORACLES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL oracles by name."""
    return dict(ORACLES)
