"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file stays outside the repository."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Byte-level BPE ranks; any file of that form can be given instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, once a process."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text column; 0 where null or empty.  Whole texts are encoded."""

    def count(s: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return F.pandas_udf(count, T.LongType())(text)
