"""Search for edits that make the two options of a pair equal in tokens."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import text as X
from quillon.operators import eventlog

Size = Callable[[Column], Column]


def measure(pairs: DataFrame, size: Size, slots: Sequence[Size]) -> DataFrame:
    """``pairs`` with token and character differences, alone and in both slots under both orders, and
    ``conforms``: equal alone though not in every slot."""
    a, b = F.col("op_consistente"), F.col("op_violadora")
    one, two = slots
    df = pairs.withColumns({"delta_tokens": size(a) - size(b), "delta_e0": one(a) - two(b), "delta_e1": one(b) - two(a), "delta_chars": F.length(a) - F.length(b)})
    differs = (F.col("delta_e0") != 0) | (F.col("delta_e1") != 0)
    return df.withColumn("conforms", (F.col("delta_tokens") == 0) & differs)


def designate(pairs: DataFrame, seed: int) -> DataFrame:
    """``pairs`` with ``edit``: which option may be changed, in turn within a stratum by a hash's order."""
    out = eventlog.alternate(pairs, "invariante", "item_id", seed)
    return out.withColumn("edit", F.when(F.col("side") == 0, "consistente").otherwise("violadora")).drop("side")


def forms(spark, classes: Mapping[str, Sequence[str]], size: Size, slots: Sequence[Size]) -> DataFrame:  # noqa: ANN001
    """``(class_id, form, tokens, slot1, slot2, chars)``: the costs of exchangeable forms."""
    df = spark.createDataFrame([(c, f) for c, fs in classes.items() for f in fs], "class_id string, form string")
    f = F.col("form")
    return df.select("class_id", "form", size(f).alias("tokens"), slots[0](f).alias("slot1"), slots[1](f).alias("slot2"), F.length(f).alias("chars"))


def lexicon_faults(lexicon: DataFrame, leaked: DataFrame | None = None) -> DataFrame:
    """``(rule, class_id, form)``: L1 a form has an intensifier, L2 forms of a class differ in negations, L3 a
    form has a word of a forbidden source (``leaked(word)``), L4 no class has two forms that are equal in
    tokens everywhere and differ in characters."""
    none = F.lit(None).cast("string")
    l1 = lexicon.where(X.has_intensifier("form")).select(F.lit("L1").alias("rule"), "class_id", "form")
    by = lexicon.groupBy("class_id").agg(F.countDistinct(X.negations("form")).alias("k"))
    l2 = by.where("k > 1").select(F.lit("L2").alias("rule"), "class_id", none.alias("form"))
    out = l1.unionByName(l2)
    if leaked is not None:
        words = lexicon.select("class_id", "form", F.explode(X.tokens("form")).alias("word"))
        l3 = words.join(leaked.select("word").distinct(), "word", "left_semi").select(F.lit("L3").alias("rule"), "class_id", "form").distinct()
        out = out.unionByName(l3)
    neutral = lexicon.groupBy("class_id", "tokens", "slot1", "slot2").agg(F.countDistinct("chars").alias("k"))
    l4 = neutral.agg(F.coalesce(F.max("k"), F.lit(0)).alias("k")).where("k < 2").select(F.lit("L4").alias("rule"), none.alias("class_id"), none.alias("form"))
    return out.unionByName(l4)


def has_form(c: Column, form: Column) -> Column:
    """Whether ``form`` stands in the text as a whole word."""
    return F.rlike(c, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), form, F.lit(r"\E(?![\p{L}\p{N}_])")))


def swap_first(c: Column, form: Column, by: Column) -> Column:
    """The text with the first whole-word ``form`` exchanged."""
    edge = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), form, F.lit(r"\E(?![\p{L}\p{N}_])"))
    at = F.regexp_instr(c, edge)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), by, F.substring(c, at + F.length(form), F.length(c)))).otherwise(c)


def propose(pairs: DataFrame, lexicon: DataFrame, size: Size, slots: Sequence[Size], *, k: int = 5) -> DataFrame:
    """Up to ``k`` proposals of one or two exchanges for each pair with an ``edit`` side, all of which make the
    options equal in tokens: ``(item_id, proposal_id, operations, text, delta_chars, delta_e0, delta_e1, rank)``.
    Order: least difference in characters, then in the slots, fewest exchanges, then the id, which means
    nothing. Candidates come from a join of texts with forms, the two of a proposal from a join by pair."""
    swaps = lexicon.select("class_id", F.col("form").alias("a")).join(lexicon.select("class_id", F.col("form").alias("b")), "class_id").where("a <> b")
    swaps = swaps.where(~X.has_intensifier("a") & ~X.has_intensifier("b") & (X.negations("a") == X.negations("b")))
    own = F.when(F.col("edit") == "consistente", F.col("op_consistente")).otherwise(F.col("op_violadora"))
    base = pairs.select("*", own.alias("old"))
    hits = base.join(F.broadcast(swaps), has_form(F.col("old"), F.col("a")))
    op = F.struct("edit", "class_id", "a", "b")
    one = hits.select(*pairs.columns, "old", F.array(op).alias("ops"))
    second = hits.select("item_id", op.alias("op2"))
    two = one.join(second, "item_id").where((F.col("ops")[0] < F.col("op2")) & (F.col("ops")[0]["a"] != F.col("op2.a")))
    two = two.select(*pairs.columns, "old", F.array(F.col("ops")[0], F.col("op2")).alias("ops"))

    def swapped(df: DataFrame) -> DataFrame:
        df = df.withColumn("new", swap_first(F.col("old"), F.col("ops")[0]["a"], F.col("ops")[0]["b"]))
        both = F.size("ops") == 2
        second = F.get("ops", F.lit(1))
        ok = ~both | has_form(F.col("new"), F.coalesce(second["a"], F.lit("")))
        return df.where(ok).withColumn("new", F.when(both, swap_first(F.col("new"), second["a"], second["b"])).otherwise(F.col("new")))

    made = swapped(one.unionByName(two)).where("new <> old")
    cons = F.col("edit") == "consistente"
    made = made.withColumns({"op_consistente": F.when(cons, F.col("new")).otherwise(F.col("op_consistente")), "op_violadora": F.when(cons, F.col("op_violadora")).otherwise(F.col("new"))})
    made = measure(made, size, slots).where("delta_tokens = 0")
    ident = F.substring(F.sha2(F.concat_ws("|", F.col("item_id").cast("string"), F.to_json("ops")), 256), 1, 12)
    made = made.withColumn("proposal_id", ident)
    order = Window.partitionBy("item_id").orderBy(F.abs("delta_chars"), F.abs("delta_e0") + F.abs("delta_e1"), F.size("ops"), "proposal_id")
    ranked = made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "proposal_id", F.col("ops").alias("operations"), F.col("new").alias("text"), "delta_chars", "delta_e0", "delta_e1", "rank")


def apply(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``pairs`` with the texts of the chosen proposals; others as they are."""
    c = chosen.select("item_id", F.col("text").alias("__new"), F.col("operations")[0]["edit"].alias("__edit"))
    df = pairs.join(c, "item_id", "left")
    pick = lambda side, col: F.when(F.col("__edit") == side, F.col("__new")).otherwise(F.col(col))
    return df.select(*[pick("consistente", c).alias(c) if c == "op_consistente" else pick("violadora", c).alias(c) if c == "op_violadora" else c for c in pairs.columns])


def set_faults(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(rule, key, n)``: what the accepted set marks though no item does. SIGN: a stratum whose longer
    options fall on one side; WORD: a form brought in twice or more, always on the same side."""
    d = F.length("op_consistente") - F.length("op_violadora")
    by = pairs.groupBy("invariante").agg(F.count_if(d > 0).alias("p"), F.count_if(d < 0).alias("q"))
    sign = by.where((F.col("p") + F.col("q") >= 2) & (F.abs(F.col("p") - F.col("q")) > 1)).select(F.lit("SIGN").alias("rule"), F.col("invariante").alias("key"), F.abs(F.col("p") - F.col("q")).alias("n"))
    ops = chosen.select(F.explode("operations").alias("o")).select("o.*")
    word = ops.groupBy("b").agg(F.count("*").alias("n"), F.countDistinct("edit").alias("sides")).where("n >= 2 and sides = 1")
    return sign.unionByName(word.select(F.lit("WORD").alias("rule"), F.col("b").alias("key"), "n"))


def reachable(n: Column, alpha: float = 0.05, threshold: float = L.WINRATE_FLOOR) -> Column:
    """Whether an interval gate can pass at all at this n: whether it does with n of n."""
    return F.pow(F.lit(alpha / 2), 1 / n) > threshold
