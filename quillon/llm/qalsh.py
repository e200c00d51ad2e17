"""Approximate nearest neighbours by collision counting over query-centred windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.common import materialize, table

#: Single projections, and the share of them in which a vector must collide to be verified.
PROJECTIONS, THRESHOLD = 48, 0.8
#: First half-width of a window on unit vectors, and its growth from one rehashing to the next.
START, GROWTH = 0.6, 1.2
#: A query is done when it has verified this many vectors of a shard, plus this share of it.
ENOUGH, SHARE = 64, 0.2
SEED = 5
#: Vectors of a shard and queries of a block, on average. Both bound the memory of a task.
SHARD, BLOCK = 8192, 2048


def projections(dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, PROJECTIONS))


def search_shard(unit: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the indices of verified vectors, the ``k`` best by cosine at least.

    Every projection has one sorted array. A window around the query's own value counts a
    collision for each vector in it; while too few vectors have collided often enough, the windows
    grow (virtual rehashing: the same arrays, wider) and only what they gain is counted. The last
    window holds the whole shard, so a search always ends with all vectors or enough of them."""
    n, a = len(unit), projections(unit.shape[1])
    values, centre = unit @ a, queries @ a
    order = np.argsort(values, axis=0, kind="stable")
    rows = np.take_along_axis(values, order, axis=0).T.copy()
    order = order.T.astype(np.int32).copy()
    need = int(np.ceil(THRESHOLD * PROJECTIONS))
    enough = min(n, ENOUGH + k + int(SHARE * n))
    count = np.zeros((len(queries), n), np.int16)
    low = np.array([np.searchsorted(r, c) for r, c in zip(rows, centre.T, strict=True)])
    high = low.copy()
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
    active = np.arange(len(queries))
    half = START
    while len(active):
        left = np.array([np.searchsorted(r, c, "left") for r, c in zip(rows, centre.T[:, active] - half, strict=True)])
        right = np.array([np.searchsorted(r, c, "right") for r, c in zip(rows, centre.T[:, active] + half, strict=True)])
        left, right = np.minimum(left, low[:, active]), np.maximum(right, high[:, active])
        still = []
        for i, q in enumerate(active):
            seen = [order[j, left[j, i] : low[j, q]] for j in range(PROJECTIONS)]
            seen += [order[j, high[j, q] : right[j, i]] for j in range(PROJECTIONS)]
            count[q] += np.bincount(np.concatenate(seen), minlength=n).astype(np.int16)
            hits = np.flatnonzero(count[q] >= need)
            if len(hits) >= enough or (right[:, i] - left[:, i] >= n).all():
                found[q] = hits
            else:
                still.append(q)
        low[:, active], high[:, active] = left, right
        active = np.array(still, np.int64)
        half *= GROWTH
    return found


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows by the power of two below their largest component: exact, and no square overflows or vanishes."""
    return np.ldexp(v, 1 - np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def nearest(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5
) -> DataFrame:
    """``(query_id, rank, id_col, score)``: the ``k`` nearest found of each row of ``queries`` among
    the rows of ``vectors`` with another id, by cosine in double precision, ties to smaller ids.

    Equal vectors are one entry of the index with their ``k + 1`` smallest ids, so that copies are
    neither compared nor shuffled again. The index is cut into shards by a hash, each with its own
    sorted arrays; a block of queries visits every shard, and a task keeps only the best ``k`` of
    each query over the shards that it gets. Rows whose id or vector is null, whose vector is zero
    or has null or non-finite components take no part; a vector of another length than a query
    isn't its candidate. Repeated ids count once per distinct vector. Fewer candidates than ``k``
    give them all; no queries or no vectors give no rows.
    """
    ok = F.expr(
        f"{id_col} is not null and exists({vec_col}, x -> x <> 0) and "
        f"forall({vec_col}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)  # singles travel as such, at half the size, and become doubles where they are compared
        v = v if df.schema[vec_col].dataType == T.ArrayType(T.FloatType()) else v.cast("array<double>")
        return df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    # Spark prunes to the first ids of each vector before it shuffles, so copies don't gather.
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entry = clean(vectors).distinct().withColumn("nth", first).where(f"nth <= {k + 1}")
    entry = entry.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entry = materialize(entry.select("v", "ids", F.size("v").alias("dims")), "vectors")
    asked = materialize(clean(queries).distinct().withColumn("dims", F.size("v")), "queries")
    n, q = entry.count(), asked.count()
    shards, blocks = -(-n // SHARD) or 1, -(-q // BLOCK) or 1
    packed = lambda df, cols: df.agg(*(F.collect_list(c).alias(c) for c in cols))
    shard = F.pmod(F.xxhash64("v", F.lit(SEED)), F.lit(shards)).alias("shard")
    block = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(blocks)).alias("block")
    left = packed(entry.groupBy(shard, "dims"), ["ids", "v"])
    right = packed(asked.select("*", block).groupBy("block", "dims"), ["id", "v"])
    right = right.select(
        "block", "dims", "id", F.col("v").alias("qv"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    )
    # By exchange: Spark's estimate knows one copy of the queries, so it may broadcast one for each shard by the driver.
    met = left.join(right.hint("merge"), ["shard", "dims"]).select("block", "ids", "v", "id", "qv")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for _, ids, v, asked_ids, qv in zip(*(c for c in b.columns), strict=True):
                members = ids.as_py()
                v, qv = (scaled(np.array(x.as_py(), np.float64)) for x in (v, qv))
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                q_unit = qv / np.linalg.norm(qv, axis=1, keepdims=True)
                for i, (name, hits) in enumerate(zip(asked_ids.as_py(), search_shard(unit, q_unit, k), strict=True)):
                    cos = v[hits] @ qv[i] / (np.linalg.norm(v[hits], axis=1) * np.linalg.norm(qv[i]))
                    cos = np.clip(cos, -1.0, 1.0)
                    top = np.lexsort((hits, -cos))[: k + 1]
                    flat = [(m, s) for h, s in zip(hits[top], cos[top], strict=True) for m in members[h] if m != name]
                    new_ids = np.array([m for m, _ in flat], np.int64)
                    scores = np.array([s for _, s in flat], np.float64)
                    if name in best:
                        new_ids, scores = np.concatenate([best[name][0], new_ids]), np.concatenate([best[name][1], scores])
                    keep = _best(new_ids, scores, k)
                    best[name] = new_ids[keep], scores[keep]
        for name, (found, scores) in best.items():
            cols = [pa.array([name] * len(found), pa.int64()), pa.array(found), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "id", "score"])

    found = met.mapInArrow(searched, "query_id long, id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.select("*", F.row_number().over(by).alias("rank")).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest ``embeddings`` of every row whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0")).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
