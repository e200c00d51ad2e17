"""Conflict-constrained best-fit packing."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import field, materialize, table
from quillon.llm.tokencounts import with_length

#: Tokens (encoded ones and a separator for each document) of a bin.
CAPACITY = 2048
#: Documents that one packing task takes, on average.
SHARD = 4096


def best_fit(sizes: list[int], sources: list[object], clusters: list[object], capacity: int) -> list[int]:
    """The bin of each item. Items come longest first; each goes to the bin with the smallest
    residual that holds it and has neither its source nor its cluster, else to a new bin.

    Bins stand in order of residual (then age), each with a bitmap of its sources and one of its
    clusters. The search begins at the successor of the item's size and goes on until a bin is
    compatible, so it never settles for a looser one. Full bins leave the order. A null source
    or cluster conflicts with nothing."""
    source_bit: dict[object, int] = {}
    cluster_bit: dict[object, int] = {}
    bit = lambda seen, x: 0 if x is None else 1 << seen.setdefault(x, len(seen))
    seen: set[object] = set()
    repeated = {c for c in clusters if c is not None and (c in seen or seen.add(c))}
    order: list[tuple[int, int]] = []
    has: list[tuple[int, int]] = []
    out = [0] * len(sizes)
    smallest = min(sizes, default=0)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        need = sizes[i]
        s = bit(source_bit, sources[i])
        c = bit(cluster_bit, clusters[i]) if clusters[i] in repeated else 0
        at = bisect_left(order, (need, -1))
        while at < len(order) and (has[order[at][1]][0] & s or has[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(has)
            has.append((0, 0))
        has[b] = has[b][0] | s, has[b][1] | c
        out[i] = b
        if residual - need >= smallest:
            insort(order, (residual - need, b))
    return out


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    cluster_col: str | None = None, length_col: str | None = None, capacity: int = CAPACITY, shard: int = SHARD,
) -> DataFrame:
    """``(bin_id, id_col, piece, start, n_tokens)``: every document, in pieces of ``capacity`` at most.

    A document has as many tokens as ``length_col`` says (null: none), without it its words between ASCII
    white space, and one separator. A longer one is cut: full pieces are bins of their own, the rest is
    packed like a document; ``start`` is the piece's first token. In one bin no two documents share a
    source or a duplicate cluster (equal texts, unless ``cluster_col`` gives them). Documents are dealt to
    packing tasks by a hash of id, text and row, into shards of bounded size, so neither a source nor
    copies of a row, of whatever share, gather in one task, and texts never travel: only ids, lengths and
    two keys do. Null and empty texts have the separator alone; null sources conflict with nothing;
    repeated rows are packed as often as they come, in bins apart; ties go by id, then by length. No
    documents give no rows.
    """
    cluster = F.col(cluster_col) if cluster_col else F.xxhash64(text_col)
    blank = r"[\x20\x09-\x0D]+"
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.coalesce(F.col(length_col), F.lit(0)) if length_col else F.size(F.array_remove(F.split(text, blank), ""))
    d = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.when(F.col(text_col).isNotNull(), cluster).alias("cluster"),
        F.xxhash64(F.col(id_col), text).alias("deal"), (words + 1).cast("long").alias("n"),
    )
    d = materialize(d, "lengths")
    shards = -(-d.count() // shard) or 1
    # Copies of a row have one hash; the row's place in the written table parts them.
    d = d.withColumn("shard", F.pmod(F.xxhash64("deal", F.monotonically_increasing_id()), F.lit(shards)))
    full = d.select("*", F.explode(F.expr(f"sequence(0L, n div {capacity} - 1)")).alias("piece")).where(f"n >= {capacity}")
    whole = full.select(
        F.concat_ws("-", F.lit("f"), F.hex("deal"), F.hex("piece"), F.monotonically_increasing_id()).alias("bin_id"),
        "id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_tokens"),
    )
    rest = d.where(f"n % {capacity} > 0").select(
        "id", "source", "cluster", "shard", F.expr(f"n div {capacity}").alias("piece"), F.expr(f"n % {capacity}").alias("n")
    )

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece", "n"], kind="stable", na_position="last")
        null = lambda c: [None if x is pd.NA or x != x else x for x in pdf[c].tolist()]
        bins = best_fit(pdf["n"].tolist(), null("source"), null("cluster"), capacity)
        return pd.DataFrame({
            "bin_id": [f"s-{s:x}-{b:x}" for s, b in zip(pdf["shard"].tolist(), bins, strict=True)],
            "id": pdf["id"], "piece": pdf["piece"], "start": pdf["piece"] * capacity, "n_tokens": pdf["n"],
        })

    schema = T.StructType([
        T.StructField("bin_id", T.StringType()), field(docs, id_col, "id"), T.StructField("piece", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
    ])
    made = rest.groupBy("shard").applyInPandas(packed, schema).unionByName(whole)
    return made.withColumnRenamed("id", id_col)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, by their encoded lengths, in bins of CAPACITY tokens; duplicate clusters are
    equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pack(with_length(docs), length_col="n_tokens")
