"""Tokens, as TESTDATA.md defines them in place of a public tokenizer, and the tokenizers of /opt/tokenizers."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of one token.
TOKEN = r"[A-Za-z0-9\u00c0-\u024f\u0400-\u04ff]{1,6}|[^A-Za-z0-9\u00c0-\u024f\u0400-\u04ff\u0009-\u000d\u0020\u00a0\u3000]"
TOKEN_RE = re.compile(TOKEN)


def token_count(text: Column) -> Column:
    """Tokens of a text, inside the JVM: null is null, blank is 0."""
    return F.regexp_count(text, F.lit(TOKEN))


@lru_cache(maxsize=4)
def _counter(path: str) -> Callable[[str], int]:
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def vocabulary_token_count(text: Column, path: str) -> Column:
    """Tokens under a vocabulary file (.json, .tiktoken or .model) that every worker can read at path."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else counter(t)).astype("Int32")

    return count(text)
