"""N-gram leakage: which rows share content n-grams with a forbidden collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import text as X


def grams(
    df: DataFrame, id_col: str, text_col: str, sizes: Sequence[int], *, stop: Sequence[str] = L.STOPWORDS
) -> DataFrame:
    """``(id_col, n, gram)``: the distinct content n-grams of each row, for each n of ``sizes``."""
    df = df.select(id_col, X.content_tokens(text_col, stop).alias("w"))
    made = F.array(*(F.struct(F.lit(n).alias("n"), X.ngrams("w", n).alias("grams")) for n in sizes))
    df = df.select(id_col, F.explode_outer(made).alias("s"))
    return df.select(id_col, "s.n", F.explode("s.grams").alias("gram"))


def forbidden_grams(
    sources: DataFrame, id_col: str, text_col: str, *, low: int = L.LEAK_FLOOR, high: int = L.LEAK_N,
    stop: Sequence[str] = L.STOPWORDS,
) -> DataFrame:
    """``(id_col, n, gram)`` of the sources from ``low`` to ``high`` words; sources with fewer than
    ``low`` content words give none."""
    return grams(sources, id_col, text_col, range(low, high + 1), stop=stop)


def leaks(rows: DataFrame, forbidden: DataFrame, id_col: str, owner_col: str) -> DataFrame:
    """``(id_col, n, gram, owner_col)`` for each n-gram of a row that is forbidden. An equi-join on
    the n-gram: Spark broadcasts the forbidden side if it is small enough and splits hot n-grams
    if not."""
    return rows.join(forbidden.select("n", "gram", owner_col), ["n", "gram"]).select(id_col, "n", "gram", owner_col)


def exempt(found: DataFrame, declared: DataFrame, keys: Sequence[str] = ("n", "gram")) -> DataFrame:
    """Leaks without those that were declared."""
    return found.join(declared.select(*keys).distinct(), list(keys), "left_anti")


def longest_shared(rows: DataFrame, forbidden: DataFrame, id_col: str, owner_col: str) -> DataFrame:
    """``(id_col, longest)``: the most words of a forbidden n-gram that a row has."""
    return leaks(rows, forbidden, id_col, owner_col).groupBy(id_col).agg(F.max("n").alias("longest"))
