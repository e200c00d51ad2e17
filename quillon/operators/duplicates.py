"""Exact duplicates, prefix duplicates, set-similarity joins and nearest neighbours."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import text as X
from quillon.sources.tables import shared_dir

#: Bits of a word's hash by which its frequency is counted: a table of as many bytes for each task.
LEVEL_BITS = 20
#: Pairs up to which the ids in them are broadcast.
WANTED = 500_000
#: When all rows are compared: rows of a block, on average; and blocks at least, of FEW rows or more, to keep cores busy.
BLOCK, BLOCKS, FEW = 16384, 8, 512


def duplicates_of(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """Rows that aren't the first of their key, with ``first_id``: an aggregate with map-side minima
    and a join, so that one key with a third of the rows doesn't gather in a window."""
    df = df.withColumn("__key", key)
    first = df.groupBy("__key").agg(F.min(order_col).alias("first_id"), F.count("*").alias("__n"))
    first = first.where("__n > 1").drop("__n")
    return df.join(first, "__key").where(F.col(order_col) > F.col("first_id")).drop("__key")


def shared_keys(a: DataFrame, b: DataFrame, key: Column, how: str = "left_semi") -> DataFrame:
    """Rows of ``a`` whose key occurs in ``b`` (``left_anti``: doesn't)."""
    return a.withColumn("__key", key).join(b.select(key.alias("__key")).distinct(), "__key", how).drop("__key")


def first_by_prefix(df: DataFrame, source_col: str, text_col: str, order_col: str, size: int = 80) -> DataFrame:
    """The first row of each normalised prefix within a source. The minimum by (source, prefix) is
    taken before the shuffle; texts don't travel."""
    key = F.substring(X.normalize(text_col), 1, size)
    keyed = df.select(F.col(source_col).alias("__s"), key.alias("__k"), F.col(order_col))
    kept = keyed.groupBy("__s", "__k").agg(F.min(order_col).alias(order_col)).select(order_col).distinct()
    return df.join(kept, order_col, "left_semi")


def _sets(df: DataFrame, id_col: str, text_col: str, group_col: str) -> DataFrame:
    words = F.array_distinct(X.content_tokens(text_col))
    # As a structure, null groups are equal in joins too.
    return df.select(F.col(id_col).alias("id"), F.struct(F.col(group_col)).alias("g"), words.alias("w"))


def similar_pairs(
    df: DataFrame, *, id_col: str, text_col: str, group_col: str, threshold: float = 0.8
) -> DataFrame:
    """``(a, b, similarity)``, a < b: rows of a group whose content words have this Jaccard similarity.

    Equal sets are one class and only classes are compared (membership by :func:`set_classes`).
    Prefix filter: sets this similar share one of the first ``size - ceil(t size) + 1`` words of
    each in any one order of all words, so only those are joined. The order is by a rough frequency, of
    2 ** LEVEL_BITS buckets of word hashes, then by hash; words never travel. How many words of both
    prefixes a pair shares bounds what it can share at all, and the exact similarity decides about
    the rest. Complete for any threshold > 0. Sets are written to the shared folder once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-sets-{uuid.uuid4().hex}"
    made = _sets(df, id_col, text_col, group_col).where((F.size("w") > 0) & F.col("id").isNotNull())
    made.withColumn("k", F.xxhash64(F.array_sort("w"))).write.parquet(path)
    sets = spark.read.schema(made.schema.add("k", "long")).parquet(path)  # read by all that follows, so texts are taken apart once
    first = sets.groupBy("g", "k").agg(F.min("id").alias("id"))
    hashes = sets.select("g", "id", "k", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    bucket = F.shiftrightunsigned("h", 64 - LEVEL_BITS).cast("int").alias("b")
    common = hashes.select(F.explode("h").alias("h")).select(bucket).groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
    levels = np.zeros(1 << LEVEL_BITS, np.uint8)
    found = common.select("b", F.least(F.round(8 * F.log2("n")), F.lit(255)).cast("short").alias("level")).toArrow()
    levels[found.column("b").to_numpy()] = found.column("level").to_numpy()
    held = spark.sparkContext.broadcast(levels.tobytes())

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(held.value, np.uint8)
        for b in batches:
            h, n = b.column(3).flatten().to_numpy().view(np.uint64), pa.compute.list_value_length(b.column(3)).to_numpy()
            ends = np.cumsum(np.r_[0, n - np.ceil(n * threshold).astype(np.int64) + 1])
            row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            level = table[h >> np.uint64(64 - LEVEL_BITS)]
            order = np.lexsort((h, level, row))
            keep = np.diff(ends)
            chosen = order[np.arange(len(h)) - start[row] < keep[row]]
            end = order[start + keep - 1]  # the last of each prefix, in the order of all words
            last = pa.StructArray.from_arrays([pa.array(level[end].astype(np.int16)), pa.array((h[end] ^ np.uint64(1 << 63)).view(np.int64))], names=["level", "h"])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[chosen].view(np.int64)))
            cols = [*b.columns[:3], last, pa.array(n.astype(np.int32)), pa.array((n - keep).astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["g", "id", "k", "last", "size", "rest", "t"])

    last = T.StructType([T.StructField("level", T.ShortType()), T.StructField("h", T.LongType())])
    fields = [T.StructField(x, hashes.schema[x].dataType) for x in ("g", "id", "k")]
    fields += [T.StructField("last", last), T.StructField("size", T.IntegerType()), T.StructField("rest", T.IntegerType()), T.StructField("t", T.ArrayType(T.LongType()))]
    prefix = hashes.mapInArrow(prefixes, T.StructType(fields)).join(first, ["g", "k", "id"], "left_semi")
    prefix = prefix.select("g", "id", "last", "size", "rest", F.explode("t").alias("t"))
    prefix = prefix.repartition("g", "t")  # one exchange, which both sides of the join read
    side = lambda x: prefix.select("g", "t", *(F.col(y).alias(f"{y}_{x}") for y in ("id", "last", "size", "rest")))
    near = (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(threshold)) & (F.col("id_a") < F.col("id_b"))
    met = side("a").join(side("b").hint("merge"), ["g", "t"]).where(near)
    # Words that both share lie in both prefixes, or behind the prefix that ends first.
    rest = F.when(F.col("last_a") < F.col("last_b"), F.col("rest_a")).when(F.col("last_a") > F.col("last_b"), F.col("rest_b")).otherwise(F.greatest("rest_a", "rest_b"))
    need = (F.col("size_a") + F.col("size_b")) * (threshold / (1 + threshold)) - 1e-6
    pairs = met.select("g", F.col("id_a").alias("a"), F.col("id_b").alias("b"), (need - rest).alias("need"))
    pairs = pairs.groupBy("g", "a", "b").agg(F.count("*").alias("met"), F.min("need").alias("need")).where("met >= need").select("g", "a", "b")
    pairs.write.parquet(f"{path}-pairs")
    pairs = spark.read.schema(pairs.schema).parquet(f"{path}-pairs")
    wanted = pairs.select("g", F.col("a").alias("id")).union(pairs.select("g", "b")).distinct()
    wanted = F.broadcast(wanted) if pairs.count() <= WANTED else wanted  # so that only words of these travel
    words = sets.select("g", "id", "w").join(wanted, ["g", "id"], "left_semi")
    scored = pairs.join(words.select("g", F.col("id").alias("a"), F.col("w").alias("wa")), ["g", "a"])
    scored = scored.join(words.select("g", F.col("id").alias("b"), F.col("w").alias("wb")), ["g", "b"])
    scored = scored.select("a", "b", X.jaccard(F.col("wa"), F.col("wb")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def set_classes(df: DataFrame, *, id_col: str, text_col: str, group_col: str) -> DataFrame:
    """``(id_col, class_id)``: rows of a group with equal content words have the smallest id."""
    sets = _sets(df, id_col, text_col, group_col).where(F.size("w") > 0)
    keyed = sets.select("id", "g", F.xxhash64(F.array_sort("w")).alias("k"))
    first = keyed.groupBy("g", "k").agg(F.min("id").alias("class_id"))
    return keyed.join(first, ["g", "k"]).select(F.col("id").alias(id_col), "class_id")


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of both, equal for equal ones."""
    both = pa.concat_arrays([a, b])
    if pa.types.is_nested(both.type):  # which Arrow can't number
        both = pa.array([repr(x) for x in both.to_pylist()])
    both = both.dictionary_encode().indices.to_numpy()
    return both[: len(a)], both[len(a) :]


def _best(ids, c, w, n, ids2, c2, w2, n2) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block the largest similarity to a row of the other block with another id: of its
    own cluster, and of another; 0 if there is none."""
    (ids, ids2), (c, c2), (w, w2) = _codes(ids, ids2), _codes(c, c2), _codes(w, w2)
    n, n2 = n.to_numpy(), n2.to_numpy()
    order = np.argsort(w2, kind="stable")
    rows = np.repeat(np.arange(len(n2)), n2)[order]
    edges = np.searchsorted(w2[order], np.arange(max(w.max(), w2.max()) + 2))
    same, away = np.zeros(len(n)), np.zeros(len(n))
    for i, (at, size) in enumerate(zip(np.cumsum(n) - n, n, strict=True)):
        shared = np.bincount(np.concatenate([rows[edges[t] : edges[t + 1]] for t in w[at : at + size]]), minlength=len(n2))
        hit = np.flatnonzero(shared)
        hit = hit[ids2[hit] != ids[i]]
        sim = shared[hit] / (size + n2[hit] - shared[hit])
        own = c2[hit] == c[i]
        same[i], away[i] = sim.max(where=own, initial=0.0), sim.max(where=~own, initial=0.0)
    return same, away


def neighbours(df: DataFrame, *, id_col: str, text_col: str, cluster_col: str, scope_col: str | None = None) -> DataFrame:
    """``(id_col, best_same, best_other, accused)``: the largest Jaccard similarity to a row of the
    same cluster and to one of another, over content words. Rows that share no word have similarity 0
    where there is such a row at all, and -1 where there is none. A row is accused if another cluster
    comes closer than its own; ties favour its own.

    Every row is held against every other of its scope, but no pair becomes a row: blocks of some
    BLOCK rows meet, and only a row's largest values leave a task. Work grows with the square of
    the table, what is shuffled with its square over BLOCK."""
    scope = F.col(scope_col) if scope_col else F.lit(0)
    sets = df.select(
        F.col(id_col).alias("id"), F.col(cluster_col).alias("c"), scope.alias("s"),
        F.array_distinct(X.content_tokens(text_col)).alias("w"),
    )
    some = sets.where((F.size("w") > 0) & F.col("id").isNotNull() & F.col("c").isNotNull() & F.col("s").isNotNull())
    n = some.count()
    blocks = max(-(-n // BLOCK), min(BLOCKS, -(-n // FEW)), 1)
    block = F.pmod(F.xxhash64("id", "c"), F.lit(blocks).cast("long")).cast("int").alias("block")
    packed = some.groupBy("s", block).agg(F.collect_list(F.struct("id", "c", "w")).alias("r"))
    packed = packed.select("s", "block", F.col("r.id").alias("id"), F.col("r.c").alias("c"), F.flatten("r.w").alias("w"), F.transform("r.w", lambda w: F.size(w)).alias("n"))
    other = packed.select(F.col("s").alias("s2"), F.col("block").alias("block2"), *(F.col(x).alias(f"{x}2") for x in ("id", "c", "w", "n")))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block2")
    met = packed.select("s", "id", "c", "w", "n", every)
    met = met.join(other.hint("merge"), (met.s == other.s2) & (met.block2 == other.block2))
    met = met.select("id", "c", "w", "n", "id2", "c2", "w2", "n2")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, *x = (b.column(j).slice(i, 1).flatten() for j in range(8))
                same, away = _best(ids, *x)
                yield pa.RecordBatch.from_arrays([ids, pa.array(same), pa.array(away)], names=["id", "same", "other"])

    kind = df.schema[id_col].dataType.simpleString()
    best = met.mapInArrow(compared, f"id {kind}, same double, other double").groupBy("id").agg(F.max("same").alias("same"), F.max("other").alias("other"))
    best = best.select("id", *(F.when(F.col(x) > 0, F.col(x)).alias(x) for x in ("same", "other")))
    in_scope = sets.groupBy("s").agg(F.count("*").alias("all"))
    in_cluster = sets.groupBy("s", "c").agg(F.count("*").alias("own"))
    out = sets.select("id", "c", "s").join(in_scope, "s").join(in_cluster, ["s", "c"]).join(best, "id", "left")
    floor = lambda ok: F.when(ok, 0.0).otherwise(-1.0)
    same = F.coalesce("same", floor(F.col("own") > 1))
    away = F.coalesce("other", floor(F.col("all") > F.col("own")))
    return out.select(F.col("id").alias(id_col), same.alias("best_same"), away.alias("best_other"), (away > same).alias("accused"))


def copied_pairs(df: DataFrame, *, cluster_col: str, order_col: str, text_col: str, n: int = 6) -> DataFrame:
    """``(cluster_col, a, b, n_shared)``, a < b: rows of a cluster that share content n-grams. Meant
    for clusters of a few rows, as pairs are its result."""
    df = df.select(F.col(cluster_col).alias("c"), F.col(order_col).alias("o"), X.content_tokens(text_col).alias("w"))
    g = df.select("c", "o", F.explode(X.ngrams("w", n)).alias("gram"))
    a, b = g.select("c", "gram", F.col("o").alias("a")), g.select("c", "gram", F.col("o").alias("b"))
    pairs = a.join(b, ["c", "gram"]).where("a < b").groupBy("c", "a", "b").agg(F.count("*").alias("n_shared"))
    return pairs.withColumnRenamed("c", cluster_col)
