"""Operator 8: token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrail.llm.chunks import encoder
from faretrail.llm.common import on_workers


def count_tokens(df: DataFrame, tokenizer: str, limit: int, text: str = "text") -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` (long) and ``over_limit`` (more than ``limit`` tokens) to each row.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library, on every
    executor under the same path. Arrow batches go to the tasks; there, texts
    are grouped by size, a long one is cut at safe boundaries (white space
    after something else), and only the counts come back. Null text counts as
    empty: 0 bytes, 0 tokens. Rows are kept one to one, repeated ones too, and
    an empty table gives an empty result; columns of these names are replaced.
    """

    on_workers(df.sparkSession)

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(tokenizer)
        for texts in batches:
            yield pd.Series([len(ids) // enc.dtype.itemsize for ids in enc.encode_many(texts)], dtype="int64")

    return (df.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
            .withColumn("n_tokens", lengths(F.col(text)))
            .withColumn("over_limit", F.col("n_tokens") > limit))
