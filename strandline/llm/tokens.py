"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType

#: The folder of the tokenizers' files and the vocabulary used unless told otherwise.
TOKENIZERS = os.environ.get("STRANDLINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut before merging (fixed value, belongs to the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once per Python worker."""
    import tiktoken

    if (folder, vocabulary) not in _LOADED:
        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[folder, vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[folder, vocabulary]


def with_tokens(documents: DataFrame, keep: list[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns with tokens bigint; null and empty texts have 0."""
    schema = documents.select(*keep).schema.add("tokens", LongType())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, vocabulary)
        for p in parts:
            out = p[keep].copy()
            out["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in p["text"]]
            yield out

    return documents.select(*dict.fromkeys([*keep, "text"])).mapInPandas(run, schema)
