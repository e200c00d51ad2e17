"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """Links ``(u, v)`` to ``(node, root)``, with root the smallest node of each component.

    Rounds of hooking and contraction: every vertex hooks to its smallest neighbour if that is
    smaller than itself, parents are followed twice, and the links are rewritten between parents.
    Links inside a tree vanish and parallel ones merge, so the table shrinks in every round and a
    star or a clique needs two. Each round is written to the shared folder; no component is ever
    gathered in one task, because all steps are joins and partial aggregates. Empty links give an
    empty table; self links add their node; repeated links count once.
    """
    edges = materialize(links.select("u", "v").distinct(), "links")
    labels = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    labels = labels.select("node", F.col("node").alias("root"))
    while not edges.where("u <> v").isEmpty():
        open_ = edges.where("u <> v")
        both = open_.union(open_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        hooked = parent = materialize(hooked, "parents")
        for _ in range(2):
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("u", F.col("pp").alias("p"))
        parent = materialize(parent, "parents")
        to_root = parent.select(F.col("u").alias("root"), F.col("p").alias("next"))
        new_labels = labels.join(to_root, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root")
        )
        new_labels = materialize(new_labels, "labels")
        left = parent.select("u", F.col("p").alias("pu"))
        right = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        new_edges = open_.join(left, "u").join(right, "v").where("pu <> pv")
        new_edges = new_edges.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
        new_edges = materialize(new_edges.distinct(), "links")
        discard(labels, edges, hooked, parent)
        labels, edges = new_labels, new_edges
    return labels
