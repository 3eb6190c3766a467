"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on every machine.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this byte-level vocabulary's published tokenizer cuts text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, text: str, keep: list[str], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``tokens`` of every row; a null or empty text has 0 tokens. Whole texts are read."""
    path = f"{folder}/{vocabulary}"
    kinds = dict(docs.dtypes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(path)
        for b in batches:
            # a lone surrogate can't be encoded; it counts as the character that replaces it
            b["tokens"] = [len(encoding.encode_ordinary(x)) if isinstance(x, str) and x else 0 for x in b.pop("_text")]
            yield b

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens bigint"
    return docs.select(*keep, F.col(text).alias("_text")).mapInPandas(count, schema)
