"""The corpus pipeline: documents through quality rules, near duplicates, decontamination, secrets, tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretrail.llm import byte_bpe, decontaminate, jaccard, perplexity, secrets
from faretrail.llm.common import fresh_name, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return perplexity.quality(docs).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row stays: that with the smallest id.

    Rows are told apart by a key of their own. Rows of one id in a component
    are chosen between by their text's hash, then by that key; a null id comes
    after all others. Rows without words are similar to nothing and all stay.
    """
    row = fresh_name(docs, "row")
    docs = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    found = jaccard.join(docs, row).select(F.col("doc_id").alias(row), "component_id")
    own = docs.select(row, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), row).alias("rank"))
    stay = found.join(own, row).groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col(f"rank.{row}").alias(row))
    return docs.join(stay, row, "left_semi").drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; a changed document's ``n_chars`` follows."""
    masked = secrets.redact(docs.withColumn("__given", F.col("text")))
    changed = F.col("text") != F.col("__given")
    masked = masked.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, and the digest of the text decoded from them."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = byte_bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs
