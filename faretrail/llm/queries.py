"""The registered queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretrail.llm import (byte_bpe, decontaminate, fill_middle, jaccard, line_dedup, paragraphs, perplexity, pivot_codes, reshard, secrets,
                           token_counts, token_files, warc)
from faretrail.llm.common import scratch_path, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE]
    counts = [F.expr(f"bigint(size(filter(secrets, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in base]
    of_base = F.filter("secrets", lambda s: s["kind"].isin(base))
    return out.select("doc_id", *counts, F.sha2(secrets.written(of_base).cast("binary"), 256).alias("base_sha256"),
                      secrets.written(F.col("secrets")).alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).drop("payload")


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 hash shards to 40 of equal bytes."""
    path, moved = scratch_path(spark, "shards"), scratch_path(spark, "moved")
    schema = reshard.write_layout(table(spark, sf_dir, "documents"), path, 32)
    shards = reshard.reshard(spark, path, moved, 40, schema).shards
    return shards.select("doc_id", "size", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
                         F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = perplexity.quality(docs, keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 512)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    token_files.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.read_ids(spark, path)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_pivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_codes.codes(table(spark, sf_dir, "embeddings")).drop("label")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_middle.fill_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.keep_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(line_dedup.kept_text().cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_reshard": op4_reshard,
    "op5_perplexity": op5_perplexity,
    "op6_paragraphs": op6_paragraphs,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_token_files": op9_token_files,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_pivot_codes": op11_pivot_codes,
    "op12_fill_middle": op12_fill_middle,
    "op13_line_dedup": op13_line_dedup,
}
