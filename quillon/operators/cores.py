"""Nested persona documents as tables: their texts, markers, faults and seals; and the checks of specs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import text as X

CORE = (
    "schema_version int, persona_id string, nome string, idioma string, natureza_substrato string, frase_ancora string, "
    "superficie_postura map<string,string>, invariantes_sob_pressao array<struct<id:string,descricao:string,viola_se:array<string>>>, "
    "valores_tracos array<struct<id:string,nome:string,descricao:string,pontuado:boolean>>, movimentos array<string>, "
    "ancoras_afirmacao array<string>, ancoras_dissolucao array<string>, personas_contraste struct<nomes:array<string>>, core_hash string"
)
VERSION = 1


def preamble() -> Column:
    """A core's introduction: name and nature, anchor and posture if there are any (posture by key), values."""
    posture = F.col("superficie_postura")
    keys = F.array_sort(F.map_keys(F.coalesce(posture, F.create_map().cast("map<string,string>"))))
    stance = F.concat_ws(" ", F.transform(keys, lambda k: F.element_at("superficie_postura", k)))
    values = F.concat_ws("; ", F.transform("valores_tracos", lambda v: v["nome"]))
    anchor = F.when(F.coalesce("frase_ancora", F.lit("")) != "", F.concat(F.lit('Uma frase que te ancora: "'), "frase_ancora", F.lit('".')))
    return F.concat_ws(
        " ", F.concat(F.lit("Você é "), "nome", F.lit(". "), "natureza_substrato"), anchor,
        F.when(F.size(keys) > 0, F.concat(F.lit("Sua postura: "), stance)), F.concat(F.lit("Seus valores: "), values, F.lit(".")),
    )


def sources(cores: DataFrame) -> DataFrame:
    """``(owner, text)``: all that an item of the persona must not repeat."""
    none = F.array().cast("array<string>")
    marks = F.flatten(F.transform(F.coalesce("invariantes_sob_pressao", F.array().cast("array<struct<id:string,descricao:string,viola_se:array<string>>>")), lambda i: i["viola_se"]))
    each = F.concat(F.array(preamble()), F.coalesce("ancoras_afirmacao", none), F.coalesce("ancoras_dissolucao", none), marks)
    return cores.select(F.col("persona_id").alias("owner"), F.explode(each).alias("text"))


def marker_table(cores: DataFrame) -> DataFrame:
    """``(persona_id, invariant, marker)``."""
    df = cores.select("persona_id", F.explode("invariantes_sob_pressao").alias("i"))
    return df.select("persona_id", F.col("i.id").alias("invariant"), F.explode("i.viola_se").alias("marker"))


def faults(cores: DataFrame) -> DataFrame:
    """``(persona_id, fault)``: what makes a core unfit: a missing field, another version, a name or id out
    of form, repeated ids, markers that the match key can never have, movements shared with another."""
    need = ("persona_id", "nome", "natureza_substrato", "invariantes_sob_pressao", "valores_tracos", "movimentos")
    ids = lambda c: F.transform(c, lambda x: x["id"])
    dead = F.filter(F.flatten(F.transform("invariantes_sob_pressao", lambda i: i["viola_se"])), lambda m: X.normalize(m) != m)
    repeated = lambda c: F.size(F.array_distinct(ids(c))) < F.size(c)
    tests = [(F.col(c).isNull(), f"missing:{c}") for c in need] + [
        (F.coalesce("schema_version", F.lit(-1)) != VERSION, "schema_version"), (~F.col("persona_id").rlike("^[a-z][a-z0-9_]*$"), "persona_id"),
        (~F.col("nome").rlike(r"^(?=.*\S)[\x00-\x7F]+$"), "nome"), (repeated("invariantes_sob_pressao"), "repeated:invariantes_sob_pressao"),
        (repeated("valores_tracos"), "repeated:valores_tracos"), (F.size(dead) > 0, "dead_marker"),
    ]
    made = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for t, name in tests)))
    own = cores.select("persona_id", F.explode(made).alias("fault"))
    moves = cores.select("persona_id", F.explode("movimentos").alias("m"))
    shared = moves.groupBy("m").agg(F.collect_set("persona_id").alias("p")).where("size(p) > 1")
    return own.unionByName(shared.select(F.explode("p").alias("persona_id"), F.lit("shared_movement").alias("fault")).distinct())


def seal(core: Mapping) -> str:
    """SHA-256 of a document's canonical JSON without its own hash; documents are few, this runs on the driver."""
    body = {k: v for k, v in core.items() if k != "core_hash"}
    return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def spec_differences(bank: DataFrame, spec: DataFrame) -> DataFrame:
    """``(cluster_id, problem)`` of ``bank(cluster_id, ...)`` against ``spec(cluster_id, m)``: clusters of one side
    only, or of another number of paraphrases."""
    own = bank.groupBy("cluster_id").agg(F.count("*").alias("n"))
    both = own.join(spec.select("cluster_id", "m"), "cluster_id", "full_outer")
    problem = F.when(F.col("m").isNull(), "only_in_bank").when(F.col("n").isNull(), "only_in_spec").when(F.col("n") != F.col("m"), "other_size")
    return both.select("cluster_id", problem.alias("problem")).where("problem is not null")


def fill_families(bank: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``bank`` with empty families filled from ``families(cluster_id, familia)``, and ``(cluster_id, problem)``
    of clusters that the map lacks or contradicts: what is declared is never replaced."""
    df = bank.join(families.select("cluster_id", F.col("familia").alias("__f")), "cluster_id", "left")
    own = F.trim(F.coalesce("familia_de_cenario", F.lit("")))
    problem = F.when(F.col("__f").isNull(), "missing").when((own != "") & (own != F.col("__f")), "conflict")
    bad = df.select("cluster_id", problem.alias("problem")).where("problem is not null").distinct()
    filled = df.withColumn("familia_de_cenario", F.when(own == "", F.col("__f")).otherwise(F.col("familia_de_cenario")))
    return filled.select(*bank.columns), bad


def consistency_terms(core: Mapping) -> list[str]:
    """The forbidden terms of a core, with the uncited influences."""
    from quillon.operators.traps import derived_terms

    return [*derived_terms(core), *L.UNCITED_INFLUENCES]
