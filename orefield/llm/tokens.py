"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Default vocabulary file: byte-level BPE as ranks. The path is a parameter of every operator that uses it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts a text into pieces before byte pairs are merged.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a vocabulary file; loaded once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _shipped(path: str) -> str:
    """Give the executors the vocabulary with the job, once per context, so that they need not have it at ``path``; returns its name."""
    sc = SparkSession.active().sparkContext
    shipped = sc.__dict__.setdefault("_orefield_vocabularies", set())
    if path not in shipped and Path(path).exists():
        sc.addFile(path)
        shipped.add(path)
    return Path(path).name


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts."""
    name = _shipped(path)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        here = SparkFiles.get(name)
        encode = encoder(here if Path(here).exists() else path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)
