"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary file, byte pairs with their ranks. Any file of that form will do; it must be there on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How such a tokenizer cuts text before it joins pairs.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> int:
    """Tokens of one whole text; 0 for null and ''. Strings that look like special tokens are ordinary text."""
    return len(_encoding(vocabulary, pattern).encode_ordinary(text)) if text else 0


def token_count(text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """``count_tokens`` of a column, over Arrow batches."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: count_tokens(t, vocabulary, pattern)).astype("int64")

    return tokens(text)
