"""Sizes and terms of texts in the tokens of a public tokenizer, given by the path of its file."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sentencepiece model with byte fallback; any other may be given.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@cache
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def with_size(df: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """`df` with `n_tokens`; null for a null text."""

    @F.pandas_udf("int")
    def size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            ids = _model(path).encode([t or "" for t in batch], num_threads=1)
            yield pd.Series([None if t is None else len(x) for t, x in zip(batch, ids, strict=True)], dtype="Int32")

    return df.withColumn("n_tokens", size(F.col(text)))


def with_terms(df: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """`df` with `tok`: the number of tokens, the distinct tokens and how often each occurs."""

    @F.pandas_udf("struct<n int, terms array<int>, tfs array<int>>")
    def terms(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            ids = _model(path).encode([t or "" for t in batch], num_threads=1)
            found = [np.unique(np.array(x, np.int32), return_counts=True) for x in ids]
            yield pd.DataFrame({"n": [len(x) for x in ids], "terms": [a for a, _ in found], "tfs": [b.astype(np.int32) for _, b in found]})

    return df.withColumn("tok", terms(F.col(text)))
