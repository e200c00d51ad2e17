"""Forced choice: presentation in both orders, criterion of consistency, blind responders."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import text as X
from quillon.functions.responders import RESPONDERS, Responder

#: Functionals of a whole bank, beside the responders that answer item by item.
BANK_FUNCTIONALS: dict[str, Callable[..., DataFrame]] = {}


def present(items: DataFrame) -> DataFrame:
    """Both orders of each item: ``shown`` 0 and 1, ``first``, ``second`` and the consistent ``label``."""
    df = items.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("shown"))
    straight = F.col("shown") == 0
    return df.select(
        "*", F.when(straight, F.col("op_consistente")).otherwise(F.col("op_violadora")).alias("first"),
        F.when(straight, F.col("op_violadora")).otherwise(F.col("op_consistente")).alias("second"),
        F.when(straight, "1").otherwise("2").alias("label"),
    )


def consistent(answers: DataFrame, keys: Sequence[str], *, choice: str = "choice", label: str = "label") -> DataFrame:
    """``(keys, correct)``: the label was chosen in every order; a missing choice is wrong."""
    right = F.bool_and(F.coalesce(F.col(choice) == F.col(label), F.lit(False)))
    return answers.groupBy(*keys).agg(right.alias("correct"))


def blind_answers(items: DataFrame, responders: Mapping[str, Responder] = RESPONDERS) -> DataFrame:
    """``(item_id, stratum, responder, correct)``: all rules answer where the item is, so an item is one
    row until the two orders are brought together inside it; there is no shuffle."""

    def right(f: Responder) -> Column:
        ctx, a, b = F.col("contexto"), F.col("op_consistente"), F.col("op_violadora")
        straight, turned = X.parse_choice(f(ctx, a, b)), X.parse_choice(f(ctx, b, a))
        return F.coalesce((straight == "1") & (turned == "2"), F.lit(False))

    each = F.array(*(
        F.struct(F.lit(i).alias("pos"), F.lit(name).alias("responder"), right(f).alias("correct"))
        for i, (name, f) in enumerate(responders.items())
    ))
    df = items.select("item_id", F.col("invariante").alias("stratum"), F.explode(each).alias("r"))
    return df.select("item_id", "stratum", "r.pos", "r.responder", "r.correct")


def rates(answers: DataFrame) -> DataFrame:
    """``(stratum, responder, n, rate)`` for each stratum and, with a null stratum, for all."""
    by = answers.select("stratum", "pos", "responder", "correct").groupBy("pos", "responder")
    strata = answers.groupBy("stratum", "pos", "responder").agg(F.count("*").alias("n"), F.count_if("correct").alias("k"))
    whole = by.agg(F.count("*").alias("n"), F.count_if("correct").alias("k")).select(F.lit(None).cast("string").alias("stratum"), "pos", "responder", "n", "k")
    return strata.unionByName(whole).select("stratum", "pos", "responder", "n", (F.col("k") / F.col("n")).alias("rate"))


def best_responder(rated: DataFrame) -> DataFrame:
    """``(stratum, responder, rate)`` of the best rule of each stratum; the first registered wins ties."""
    best = rated.groupBy("stratum").agg(F.max_by(F.struct("responder", "rate"), F.struct(F.col("rate"), -F.col("pos"))).alias("b"))
    return best.select("stratum", "b.responder", "b.rate")


def length_supremum(items: DataFrame, size: Callable[[Column], Column] = F.length) -> DataFrame:
    """``(stratum, n, rate)`` of the best rule of length in closed form: of each absolute difference the
    more frequent sign is right, and ties never are. The null stratum is all."""
    d = (size(F.col("op_consistente")) - size(F.col("op_violadora"))).alias("d")
    df = items.select(F.explode(F.array("invariante", F.lit(None).cast("string"))).alias("stratum"), d)
    by = df.groupBy("stratum", F.abs("d").alias("m")).agg(F.count_if(F.col("d") > 0).alias("p"), F.count_if(F.col("d") < 0).alias("q"), F.count("*").alias("k"))
    hits = F.sum(F.when(F.col("m") > 0, F.greatest("p", "q")).otherwise(0))
    return by.groupBy("stratum").agg(F.sum("k").alias("n"), (hits / F.sum("k")).alias("rate"))


BANK_FUNCTIONALS["sup_comprimento"] = length_supremum


def shortcuts(items: DataFrame, *, soluble: float = L.SOLUBLE) -> DataFrame:
    """``(stratum, rule, rate)`` of all rules that solve the bank or a stratum of it; the whole always
    counts, strata only if there is more than one."""
    found = rates(blind_answers(items)).select("stratum", F.col("responder").alias("rule"), "rate")
    for name, f in BANK_FUNCTIONALS.items():
        found = found.unionByName(f(items).select("stratum", F.lit(name).alias("rule"), "rate"))
    strata = items.agg(F.countDistinct("invariante").alias("strata"))
    found = found.where(F.col("rate") >= soluble).join(F.broadcast(strata))
    return found.where("stratum is null or strata > 1").drop("strata")


def diagnosis(items: DataFrame) -> DataFrame:
    """A portrait of each stratum: length differences as a map, share of ties, the supremum of length
    rules, the best responder, and a verdict of four levels."""
    d = (F.length("op_consistente") - F.length("op_violadora")).alias("d")
    by = items.select(F.col("invariante").alias("stratum"), d).groupBy("stratum", "d").agg(F.count("*").alias("k"))
    shape = by.groupBy("stratum").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", "k")))).alias("deltas"),
        (F.sum(F.when(F.col("d") == 0, F.col("k")).otherwise(0)) / F.sum("k")).alias("ties"),
    )
    sup = length_supremum(items).select("stratum", F.col("rate").alias("supremum"))
    best = best_responder(rates(blind_answers(items)))
    out = shape.join(sup, "stratum").join(best, "stratum")
    verdict = (
        F.when(F.col("rate") >= L.SOLUBLE, "SOLUVEL").when(F.col("supremum") >= L.SOLUBLE, "SOLUVEL_POR_COMPRIMENTO")
        .when(F.greatest("rate", "supremum") > 0.5, "ENVIESADO").otherwise("LIMPO")
    )
    return out.withColumn("verdict", verdict)


def non_choice_rate(answers: DataFrame, choice: str = "choice") -> DataFrame:
    """Share of presentations without a choice."""
    return answers.agg(F.count("*").alias("n"), (F.count_if(F.col(choice).isNull()) / F.count("*")).alias("rate"))


def declaration_gaps(found: DataFrame, declared: DataFrame) -> DataFrame:
    """``(stratum, rule, problem)``: shortcuts found and not declared, declared and not found, or declared
    without a reason. Nulls match nulls."""
    f = found.select("stratum", "rule", F.lit(True).alias("f"))
    d = declared.select(F.col("stratum").alias("s"), F.col("rule").alias("r"), "reason", F.lit(True).alias("d"))
    both = f.join(d, f.stratum.eqNullSafe(d.s) & (f.rule == d.r), "full_outer")
    blank = F.trim(F.coalesce("reason", F.lit(""))) == ""
    problem = F.when(F.col("d").isNull(), "undeclared").when(F.col("f").isNull(), "not_found").when(blank, "no_reason")
    return both.select(F.coalesce("stratum", "s").alias("stratum"), F.coalesce("rule", "r").alias("rule"), problem.alias("problem")).where("problem is not null")


def poles(texts: DataFrame, measure: Callable[[Column], Column], *, pole: str = "pole", positive: str = "positive") -> DataFrame:
    """``(pole, mean, passes)``: a measure must score the positive pole strictly above each other one."""
    by = texts.groupBy(pole).agg(F.avg(measure(F.col("text"))).alias("mean"))
    top = by.where(F.col(pole) == positive).select(F.col("mean").alias("top"))
    return by.join(F.broadcast(top)).select(pole, "mean", ((F.col(pole) == positive) | (F.col("mean") < F.col("top"))).alias("passes"))
