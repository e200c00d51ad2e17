"""A training-corpus pipeline over ``documents``, each stage one operator of ``quillon.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import gam, hyperdim, packing, simhash, winnowing
from quillon.llm.common import materialize, table
from quillon.llm.tokencounts import with_length

#: Cosine with the nearest language below which a text is taken for none.
MIN_LANGUAGE = 0.1

#: SQL can't express the fitted models; the stages are tested against plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. Null and empty texts are scored like
    any other; null ids aren't learned from but are kept or dropped by score."""
    model = gam.fit(docs, table(spark, sf_dir, "labels"))
    scored = gam.with_score(docs, model, out="__score")
    return scored.where(F.col("__score") >= gam.THRESHOLD).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that resemble one of the languages learned from ``lang``. Where no
    language can be learned nothing is rejected."""
    protos = hyperdim.fit(docs)
    if not protos:
        return docs
    judged = hyperdim.with_language(docs, protos, out="__lang", score="__cos")
    known = (F.col("__lang") != hyperdim.UNKNOWN) & (F.col("__cos") >= MIN_LANGUAGE)
    return judged.where(known).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): that with the
    smallest id, then the smallest text hash. Rows with a null id have no name to be told apart by and
    all stay. Rows of one id with different texts are told apart by their texts."""
    found = simhash.similar_documents(docs).where("doc_id is not null")
    rows = found.groupBy("component", "doc_id", "k").agg(F.count("*").alias("rows"))
    first = F.min(F.struct("doc_id", "k", "rows")).alias("r")
    keep = materialize(rows.groupBy("component").agg(first).select("r.doc_id", "r.k", "r.rows"), "kept")
    named = docs.withColumn("__k", F.xxhash64("text"))
    on = lambda df: (named.doc_id == df.doc_id) & (F.col("__k") == df.k)
    once, again = keep.where("rows = 1"), keep.where("rows > 1")
    stay = named.join(once, on(once), "left_semi").drop("__k")
    repeated = named.join(again, on(again), "left_semi").dropDuplicates(["doc_id", "__k"]).drop("__k")
    return stay.unionByName(repeated).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark. Of two rows of one id both go if one is hit."""
    found = winnowing.find_hits(docs, table(spark, sf_dir, "benchmark"))
    dirty = materialize(found.where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(dirty, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in bins, by its encoded length: ``bin_id, doc_id, piece, start, n_tokens``."""
    return packing.pack(with_length(docs.select("doc_id", "text", "source"), out="__n"), length_col="__n")


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
