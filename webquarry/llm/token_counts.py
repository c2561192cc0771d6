"""Token counts of whole texts, by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .session import tune


def n_tokens(vocabulary: str):
    """A pandas UDF that counts the tokens of a text; null counts as the empty text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = bpe.counter(vocabulary)
        for texts in batches:
            yield pd.Series([tokens(x) if x else 0 for x in texts], dtype="int64")

    return count


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Row by row, without a shuffle.  Null and empty texts have no bytes and no tokens; repeated rows give repeated
    rows; an empty table gives an empty result; other columns, whatever their names, are not looked at.  Equals the
    count of the tokenizer library for the file, without begin, end or added tokens.
    """
    tune(docs.sparkSession)
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(vocabulary)(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
