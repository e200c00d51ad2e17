"""Markers of a violation, aware of negation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import text as X


def _run(words: str, i: Column, needle: Sequence[str]) -> Column:
    hit = F.lit(True)
    for j, w in enumerate(needle):
        hit = hit & F.coalesce(F.get(words, i + j) == w, F.lit(False))
    return hit


def violates(words: str, marker: str, *, window: int = L.NEGATION_WINDOW) -> Column:
    """Whether array column ``words`` (by name) has the marker without a negator in the words before it;
    a marker that begins with a denial is violated by its presence."""
    needle = X.normalize_python(marker).split()
    if not needle:
        return F.lit(False)
    size = F.size(words)
    starts = F.when(size >= len(needle), F.sequence(F.lit(0), F.greatest(size - len(needle), F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def negated(i: Column) -> Column:
        found = F.lit(False)
        for back in range(1, window + 1):
            found = found | F.coalesce(F.get(words, i - back).isin(*L.NEGATORS), F.lit(False))
            for a, b in L.NEGATOR_PAIRS:
                if back > 1:
                    pair = (F.get(words, i - back) == a) & (F.get(words, i - back + 1) == b)
                    found = found | F.coalesce(pair, F.lit(False))
        return found

    if needle[0] in L.DENIALS:
        return F.exists(starts, lambda i: _run(words, i, needle))
    return F.exists(starts, lambda i: _run(words, i, needle) & ~negated(i))


def consistency(df: DataFrame, invariants: dict[str, Sequence[str]], text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the share of invariants that a text doesn't violate (1 without any) and the violated ones."""
    df = df.withColumn("__w", X.tokens(text_col))
    flags = []
    for name, markers in invariants.items():
        bad = F.lit(False)
        for m in markers:
            bad = bad | violates("__w", m)
        flags.append(F.when(bad, F.lit(name)))
    violated = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    df = df.withColumn("violated", violated)
    return df.withColumn(out, 1 - F.size("violated") / F.lit(float(max(1, len(invariants))))).drop("__w")


def substring_violations(c: Column | str, invariants: dict[str, Sequence[str]]) -> Column:
    """The older ruler: markers as substrings of the match key, negated or not."""
    key = X.normalize(c)
    flags = [F.when(F.greatest(*(F.contains(key, F.lit(X.normalize_python(m))) for m in markers), F.lit(False)), F.lit(name)) for name, markers in invariants.items()]
    return F.array_compact(F.array(*flags))
