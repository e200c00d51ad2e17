"""Text measures as Column builders: one row in, one value out, all inside the JVM.

Python's ``\\b``, ``\\w`` and ``\\s`` know all of Unicode and Java's don't, hence ``(?U)``. An array
that a lambda looks into must be a plain column, as Spark computes any other expression anew for
each element; builders that need one say so.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions import lexicons as L


def _accents() -> tuple[str, str]:
    """Letters that decompose to one letter and marks, and that letter."""
    plain = {}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]
        if len(parts) == 1 and parts[0] != chr(c):
            plain[chr(c)] = parts[0]
    return "".join(plain), "".join(plain.values())


ACCENTED, PLAIN = _accents()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_accents(c: Column | str) -> Column:
    """Lower case without accents; punctuation stays."""
    return F.translate(F.lower(col(c)), ACCENTED, PLAIN)


def normalize(c: Column | str) -> Column:
    """The match key: lower case, no accents, all but letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(fold_accents(c), r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(StringType())
def normalize_any(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As :func:`normalize` for all of Unicode, ligatures and superscripts included."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        s = unicodedata.normalize("NFKD", s.lower())
        s = "".join(" " if not x.isalnum() else x for x in s if not unicodedata.combining(x))
        return " ".join(s.split())

    for part in parts:
        yield part.map(one, na_action="ignore")


def strip_tokens(c: Column | str) -> Column:
    """The words between white space, as an array; none for null."""
    parts = F.split(F.coalesce(col(c), F.lit("")), r"(?U)\s+")
    return F.array_remove(parts, "")


def tokens(c: Column | str) -> Column:
    """The words of the match key."""
    return F.array_remove(F.split(F.coalesce(normalize(c), F.lit("")), " "), "")


def content_tokens(c: Column | str, stop: Sequence[str] = L.STOPWORDS) -> Column:
    """The words of the match key without function words; repeats stay."""
    bad = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    return F.filter(tokens(c), lambda t: ~F.array_contains(bad, t))


def ngrams(words: str, n: int) -> Column:
    """The distinct n-grams of array column ``words`` (by name), each joined by spaces."""
    size = F.size(words)
    starts = F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(F.col(words), i, n), " ")))


def word_count(c: Column | str) -> Column:
    return F.size(strip_tokens(c))


def occurrences(c: Column | str, part: str) -> Column:
    """How often ``part`` occurs without overlaps, as Python's ``str.count``."""
    c = F.coalesce(col(c), F.lit(""))
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def digit_share(c: Column | str) -> Column:
    """Digits by characters; 1 for an empty text."""
    c = F.coalesce(col(c), F.lit(""))
    digits = F.length(c) - F.length(F.regexp_replace(c, r"\p{Nd}", ""))
    return F.when(F.length(c) == 0, 1.0).otherwise(digits / F.greatest(F.length(c), F.lit(1)))


def register(c: Column | str) -> Column:
    """``dialogico`` from two question marks, else ``argumentativo``."""
    return F.when(occurrences(c, "?") >= 2, "dialogico").otherwise("argumentativo")


def is_noise(c: Column | str, pattern: str = L.NOISE) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(pattern)


def whole_word_pattern(terms: Sequence[str], stems: Sequence[str] = ()) -> str:
    """An alternation of whole words; a stem is bounded on the left only."""
    if not terms:
        return r"(?!)"
    parts = [re.escape(t) + ("" if t in stems else r"(?![\p{L}\p{N}_])") for t in terms]
    return r"(?<![\p{L}\p{N}_])(?:" + "|".join(parts) + ")"


def mentions(c: Column | str, terms: Sequence[str], stems: Sequence[str] = ()) -> Column:
    """Whether the match key has any of the terms, which are normalised too."""
    keys = [normalize_python(t) if t not in stems else t for t in terms]
    return F.coalesce(normalize(c), F.lit("")).rlike(whole_word_pattern(keys, stems))


def normalize_python(s: str) -> str:
    """:func:`normalize` of a constant, for terms known on the driver."""
    s = unicodedata.normalize("NFKD", s.lower())
    s = "".join(x if x.isalnum() else " " for x in s if not unicodedata.combining(x))
    return " ".join(s.split())


def has_intensifier(c: Column | str, terms: Sequence[str] = L.INTENSIFIERS) -> Column:
    return mentions(c, terms)


def negations(c: Column | str, terms: Sequence[str] = L.NEGATIONS) -> Column:
    bad = F.array(*map(F.lit, terms))
    return F.size(F.filter(tokens(c), lambda t: F.array_contains(bad, t)))


def mould(c: Column | str, n: int = 3) -> Column:
    """The first words of the match key: what a template shares."""
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def raw_mould(c: Column | str, n: int = 3) -> Column:
    """The first words of the lower-cased text, accents kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_join(F.slice(found, 1, n), " ")


def suspects(c: Column | str, words: Sequence[str] = L.UNACCENTED) -> Column:
    """Words that lack their accent, then apostrophes that stand for one; identifiers are spared."""
    c = F.coalesce(col(c), F.lit(""))
    found = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_']+)"), F.lit(1))
    bad = F.array(*map(F.lit, words))
    plain = F.filter(
        F.transform(found, lambda t: F.lower(t)),
        lambda t: F.array_contains(bad, t) & ~F.contains(t, F.lit("_")),
    )
    at = r"(?<![\p{L}\p{N}_])(" + "|".join(L.APOSTROPHE_WORDS) + r")'(?=\s|$|[.,;:!?)\]])"
    marks = F.transform(F.regexp_extract_all(c, F.lit(at), F.lit(1)), lambda t: F.concat(t, F.lit("'")))
    return F.concat(plain, marks)


def lacks_accents(c: Column | str, floor: int = L.MIN_WORDS_WITHOUT_ACCENT) -> Column:
    """A text long enough to need an accent that has none."""
    worded = F.size(F.filter(strip_tokens(c), lambda t: t.rlike(r"\p{L}")))
    return (worded >= floor) & ~F.coalesce(col(c), F.lit("")).rlike("[À-ÖØ-öø-ÿ]")


def quantities(c: Column | str) -> Column:
    """The distinct quantities named (a number and a unit), sorted."""
    pattern = (
        r"(?<![\p{L}\p{N}_])(?:" + "|".join(L.NUMBER_WORDS) + r"|\d{1,4})(?:\s+(?:da|de|do|em)?\s*)?(?:"
        + "|".join(L.UNITS) + r")(?![\p{L}\p{N}_])"
    )
    return F.array_sort(F.array_distinct(F.regexp_extract_all(normalize(c), F.lit(pattern), F.lit(0))))


def parse_choice(c: Column | str) -> Column:
    """``1`` or ``2`` if exactly one of them is named in the first eight words, else null."""
    head = F.array_join(F.slice(strip_tokens(c), 1, 8), " ")
    named = F.array_distinct(F.regexp_extract_all(head, F.lit(r"(?U)\b([12])\b"), F.lit(1)))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def holds_word(hay: Column | str, needle: Column | str) -> Column:
    """Whether space-separated ``needle`` stands in ``hay`` between spaces or ends."""
    pad = lambda c: F.concat(F.lit(" "), col(c), F.lit(" "))
    return F.contains(pad(hay), pad(needle))


def replace_first(c: Column | str, word: str, by: str) -> Column:
    """The text with its first whole-word occurrence of ``word`` replaced; else unchanged."""
    c = col(c)
    parts = F.split(c, r"(?U)\b" + re.escape(word) + r"\b", 2)
    return F.when(F.size(parts) == 2, F.concat(F.get(parts, F.lit(0)), F.lit(by), F.get(parts, F.lit(1)))).otherwise(c)


def scrub(c: Column | str, names: Sequence[str], mask: str = "[X]") -> Column:
    """The text with whole-word names masked, whatever their case."""
    if not names:
        return col(c)
    alternatives = "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    return F.regexp_replace(col(c), rf"(?iU)\b(?:{alternatives})\b", re.sub(r"([\\$])", r"\\\1", mask))


def names_pattern(names: Sequence[str]) -> str:
    """What :func:`scrub` looks for; never matches without names."""
    return rf"(?iU)\b(?:{'|'.join(map(re.escape, names))})\b" if names else r"(?!)"


def cut_turn(c: Column | str, limit: int = L.TURN_CUT) -> Column:
    """Struct of the text cut to ``limit``, where it was cut (else null) and its size then."""
    c = col(c)
    long = F.length(c) > limit
    return F.struct(
        F.substring(c, 1, limit).alias("text"),
        F.when(long, F.lit(limit)).alias("cut_at"),
        F.when(long, F.length(c)).alias("full_size"),
    )


def pair_state(first: Column, second: Column) -> Column:
    """CONS, VIOL or POS from the choices under both orders of presentation."""
    return (
        F.when((first == "1") & (second == "2"), "CONS")
        .when((first == "2") & (second == "1"), "VIOL")
        .otherwise("POS")
    )


def front_matter(c: Column | str) -> Column:
    """Struct of ``meta`` (a map) and ``body``. A text that starts with ``---`` has a header up to the
    next ``---``; its lines are split at the first colon. Later keys win; else meta is empty."""
    c = F.coalesce(col(c), F.lit(""))
    lead = F.ltrim(c)
    parts = F.split(lead, "---", 3)
    has = F.startswith(lead, F.lit("---")) & (F.size(parts) == 3)
    lines = F.filter(F.split(F.get(parts, F.lit(1)), "\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.split(x, ":", 2)[0]).alias("key"), F.trim(F.split(x, ":", 2)[1]).alias("value")
        ),
    )
    empty = F.array().cast("array<struct<key:string,value:string>>")
    newest = F.reverse(entries)
    keys = F.array_distinct(F.transform(newest, lambda e: e["key"]))
    values = F.transform(keys, lambda k: F.get(F.filter(newest, lambda e: e["key"] == k), F.lit(0))["value"])
    meta = F.when(has, F.map_from_arrays(keys, values)).otherwise(F.map_from_entries(empty))
    body = F.when(has, F.regexp_replace(F.get(parts, F.lit(2)), r"(?U)^\s+", "")).otherwise(c)
    return F.struct(meta.alias("meta"), body.alias("body"))


def strip_envelope(c: Column | str) -> Column:
    """Struct of ``header`` and ``body``: what precedes a ``*** START ... ***`` line, and what lies
    between it and ``*** END ... ***``; without a start the header is the first 3000 characters
    and the body the whole text."""
    c = F.coalesce(col(c), F.lit(""))
    start, end = r"(?s)^(.*?)\*\*\*\s*START[^\n]*?\*\*\*(.*)$", r"(?s)^(.*?)\*\*\*\s*END[^\n]*?\*\*\*"
    has = c.rlike(start)
    after = F.regexp_extract(c, start, 2)
    inner = F.when(after.rlike(end), F.regexp_extract(after, end, 1)).otherwise(after)
    return F.struct(
        F.when(has, F.regexp_extract(c, start, 1)).otherwise(F.substring(c, 1, 3000)).alias("header"),
        F.when(has, inner).otherwise(c).alias("body"),
    )


def decode(content: Column | str) -> Column:
    """Bytes as UTF-8, or as Latin-1 if they aren't."""
    c = col(content)
    return F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, "ISO-8859-1"))
