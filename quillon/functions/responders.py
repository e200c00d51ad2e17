"""Blind responders: rules that answer a forced choice from its surface.

Each takes (context, first, second) as Columns and gives the text that it would answer; they are
registered in order, and the first of equals wins a comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import text as X

Responder = Callable[[Column, Column, Column], Column]

#: Answers that name no label, as a model gone astray would give them.
MUTE, NOISE, REFUSAL = "", "Ruido sem rotulo algum.", "Prefiro não escolher nenhuma delas."
REPEATED, CURT, AGREEABLE = "não " * 40, "Ok.", "Você tem toda a razão. 2"


def fixed(answer: str) -> Responder:
    return lambda ctx, a, b: F.lit(answer)


def prefer_first(test: Column) -> Column:
    return F.when(test, "1").otherwise("2")


def coin(ctx: Column, a: Column, b: Column) -> Column:
    """The same label under both orders, by a hash of the context."""
    return prefer_first(F.xxhash64(ctx).bitwiseAND(F.lit(1)) == 0)


def lexical(ctx: Column, a: Column, b: Column) -> Column:
    """The option without an intensifier; the first if both or neither has one."""
    return prefer_first(~(X.has_intensifier(a) & ~X.has_intensifier(b)))


def shorter(ctx: Column, a: Column, b: Column) -> Column:
    return prefer_first(F.length(a) <= F.length(b))


def less_echo(ctx: Column, a: Column, b: Column) -> Column:
    """The option that shares fewer distinct raw words with the context."""
    words = lambda c: X.strip_tokens(F.lower(c))
    shared = lambda c: F.size(F.array_intersect(words(ctx), words(c)))
    return prefer_first(shared(a) <= shared(b))


def negating(ctx: Column, a: Column, b: Column) -> Column:
    """The option with more occurrences of the accented negation."""
    count = lambda c: X.occurrences(F.lower(c), "não")
    return prefer_first(count(a) >= count(b))


def _holds_any(c: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(c, F.lit(p))
    return found


def _holds_count(c: Column, parts: Sequence[str]) -> Column:
    return sum((F.contains(c, F.lit(p)).cast("int") for p in parts), F.lit(0))


def live_warrant(ctx: Column, a: Column, b: Column) -> Column:
    """The option that names a warrant and doesn't cancel it."""

    def live(c: Column) -> Column:
        n = X.normalize(c)
        return _holds_any(n, L.WARRANTS) & ~_holds_any(n, L.WARRANT_CANCELS)

    return prefer_first(~(live(b) & ~live(a)))


def _letters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def erudite(ctx: Column, a: Column, b: Column) -> Column:
    """More words of seven letters or more, then less inner punctuation."""
    long = lambda c: F.size(F.filter(_letters(c), lambda w: F.length(w) >= 7))
    marks = lambda c: F.length(c) - F.length(F.translate(c, ",;:", ""))
    return F.when(long(a) != long(b), prefer_first(long(a) > long(b))).otherwise(prefer_first(marks(a) <= marks(b)))


def manner(ctx: Column, a: Column, b: Column) -> Column:
    """A noun of manner, then longer words on average."""
    has = lambda c: F.arrays_overlap(X.tokens(c), F.array(*map(F.lit, L.MANNERS)))
    mean = lambda c: F.length(F.array_join(_letters(c), "")) / F.greatest(F.size(_letters(c)), F.lit(1))
    return F.when(has(a) != has(b), prefer_first(has(a))).otherwise(prefer_first(mean(a) >= mean(b)))


def unfeeling(ctx: Column, a: Column, b: Column) -> Column:
    """Fewer distinct roots of experience, then more marks of refusal."""
    felt = lambda c: _holds_count(X.normalize(c), L.EXPERIENCE)
    refused = lambda c: _holds_count(X.normalize(c), L.REFUSALS)
    return F.when(felt(a) != felt(b), prefer_first(felt(a) < felt(b))).otherwise(prefer_first(refused(a) >= refused(b)))


RESPONDERS: dict[str, Responder] = {
    "mudo": fixed(MUTE),
    "salada": fixed(NOISE),
    "recusa": fixed(REFUSAL),
    "loop": fixed(REPEATED),
    "ultracurto": fixed(CURT),
    "sicofanta": fixed(AGREEABLE),
    "posicao_primeira": fixed("1"),
    "posicao_segunda": fixed("2"),
    "moeda": coin,
    "lexico": lexical,
    "curto": shorter,
    "antieco": less_echo,
    "negativista": negating,
    "garantia_viva": live_warrant,
    "eruditismo": erudite,
    "maneira_densidade": manner,
    "afeto_recusa": unfeeling,
}
