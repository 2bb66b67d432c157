"""Token counts by heap-and-linked-list byte-pair merging; no identifier is emitted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumiveil.llm.common import read_table, row_sums, slices, words_of
from sumiveil.llm.word_bpe import default_path, loaded


def token_count(text: Column | str, vocabulary: str | None = None) -> Column:
    """Number of tokens of a text, as a column; a null text counts as empty (0 tokens)."""
    path = vocabulary or default_path()

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        bpe = loaded(path)
        out = np.zeros(len(texts), np.int64)
        for at, some in slices(texts):
            codes, offsets, words = words_of(some)
            each = np.array(bpe.lookup(words, bpe.count_word), np.int64)
            out[at : at + len(some)] = row_sums(each[codes], offsets)
        return pa.array(out)

    return count(text)


def count_tokens(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table
    gives no rows; other columns are not looked at.  Special tokens' strings inside a text count as
    one token each, as the library's default has it.
    """
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), token_count(F.col(text), vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
