"""Token counts by a pinned vocabulary. Nothing falls back silently: an absent or altered file raises."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillon.functions import text as X


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def available(path: str, sha256: str | None = None) -> bool:
    """Whether the file is there; one with another hash raises even here."""
    try:
        found = file_sha256(path)
    except FileNotFoundError:
        return False
    if sha256 and found != sha256:
        raise ValueError(f"{path}: sha256 {found}, not {sha256}")
    return True


@lru_cache(maxsize=4)
def _load(path: str, sha256: str | None):  # noqa: ANN202
    if not available(path, sha256):
        raise FileNotFoundError(path)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def counter(path: str, sha256: str | None = None) -> Callable[[Column], Column]:
    """A Column function that counts tokens, loading the file once in each worker; null counts 0."""

    @F.pandas_udf(IntegerType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _load(path, sha256)
        for part in parts:
            done = tokenizer.encode_batch(part.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([len(e.ids) for e in done], index=part.index)

    return count


def in_slot(size: Callable[[Column], Column], prefix: str) -> Callable[[Column], Column]:
    """The count that a text adds behind a prefix, which can differ from its own."""
    return lambda c: size(F.concat(F.lit(prefix), c)) - size(F.lit(prefix))


#: Words, where words are what is asked for; never in the place of tokens.
words: Callable[[Column], Column] = X.word_count
