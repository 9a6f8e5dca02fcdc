"""Token counts by rank-synchronous array merging.

Each task takes the pre-tokens of a batch of texts, merges the ones that it has not met before all together in ragged
numpy arrays (`wordpieces.merged_counts`) and adds up the counts. No shuffle; memory is bounded by the batch and by
`MEMO_WORDS`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordpieces import Memo, merge_table, merged_counts, vocabulary_path


def counter(path: str) -> Memo:
    """Tokens of texts; None counts as empty."""
    return Memo(path, lambda words: merged_counts(words, merge_table(path)).tolist(), sum, lambda _: 1)


def token_counts(docs: DataFrame, text: str = "text", limit: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); other columns stay, but for those three names.

    Null and empty texts have 0 bytes and tokens. Repeated rows each get their counts; an empty table gives an empty one.
    A very long text is merged whole. The row order doesn't matter.
    """
    path = vocabulary or vocabulary_path()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = counter(path).values  # its memory ends with the task
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series([n for i in range(0, len(texts), 256) for n in counts(texts[i : i + 256])], dtype="int64")

    added = ("n_bytes", "n_tokens", "over_limit")
    return (
        docs.drop(*(c for c in docs.columns if c.lower() in added))
        .withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", count(F.col(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
