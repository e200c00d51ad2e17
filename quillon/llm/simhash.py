"""SimHash near-duplicate detection with pigeonhole blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.common import discard, field, materialize, table
from quillon.llm.graph import connected_components

BITS = 64
SEED = 42
#: Shingles hashed at once; bounds the memory of one very long text.
CHUNK = 1 << 16


def simhash(text: bytes | None, width: int) -> int:
    """Fingerprint of one text: lower-case A-Z, words split at ASCII white space, shingles of
    ``width`` words (all words if there are fewer); a bit is set if over half the shingle hashes
    have it. No words, or null: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        grams = [b" ".join(words)]
    else:
        grams = zip(*(words[i:] for i in range(width)), strict=False)
        grams = map(b" ".join, grams)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=n)
    set_bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3
) -> DataFrame:
    """``(id_col, fp)``, a row for each row of ``docs``, ids unchanged (null too)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            fps = pa.array((simhash(t.as_py(), width) for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=[id_col, "fp"])

    schema = T.StructType([field(docs, id_col), T.StructField("fp", T.LongType())])
    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(hashed, schema)


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of ``blocks - max_bits`` blocks: two fingerprints
    that differ in ``max_bits`` bits at most agree on at least one of them."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def close_pairs(fps: DataFrame, *, max_bits: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs ``(u, v)``, u < v, of the distinct ``fp`` values that differ in ``max_bits`` bits
    at most. With 6 blocks there are 20 keys of about 32 bits to a fingerprint, so unrelated ones
    seldom meet even among billions; the Hamming test is part of the join, so that no other pair
    leaves it. Both sides are plain exchanges, which lets Spark split a key that many share."""
    masks = [F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(max_bits, blocks)]
    keyed = fps.select("fp", F.posexplode(F.array(*masks)).alias("t", "key"))
    a, b = keyed.select("t", "key", F.col("fp").alias("u")), keyed.select("t", "key", F.col("fp").alias("v"))
    on = (a.t == b.t) & (a.key == b.key) & (a.u < b.v)
    on = on & (F.bit_count(a.u.bitwiseXOR(b.v)) <= max_bits)
    return a.join(b.hint("merge"), on).select("u", "v").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    max_bits: int = 3,
) -> DataFrame:
    """``(id_col, fp, component_id)``, a row for each row of ``docs``.

    Texts of the same fingerprint are one class and only classes are compared, so copies cost
    nothing beyond their fingerprint. ``component_id`` is the smallest id reachable over links.
    Null or wordless texts have fingerprint 0 and are linked like any other. Null ids keep their
    row and are never a ``component_id`` unless the whole component has no other. Repeated rows
    stay repeated. An empty table gives an empty result; further columns are not looked at.
    """
    found = materialize(
        fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints"
    )
    classes = materialize(found.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    roots = connected_components(close_pairs(classes.select("fp"), max_bits=max_bits))
    linked = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    first = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(first, "root").select("fp", "component_id")
    classes = classes.join(linked, "fp", "left")
    classes = classes.select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return found.join(materialize(classes, "classes"), "fp").select(id_col, "fp", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` by 3-word SimHash at Hamming distance 3 or less."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


# --- near copies by similarity ---------------------------------------------------------------------

#: Bits of the long fingerprint, as 64-bit words.
WORDS = 24
#: Share of pairs right at the similarity that agree on a block at least; the number of blocks follows.
SHARED = 0.97
#: Bits of a block: SPARE more than it takes to number all classes, so that of the strangers a class meets
#: less than one in 16 blocks at any size of the table.
SPARE, WIDEST = 4, 48
#: Standard deviations by which the distance of a pair may exceed that expected at the similarity, of whole
#: fingerprints, of their first words and of either where a set is below SURE; and by which it must fall
#: short to be believed without comparing the sets.
FAR, FAR_WORD, FAR_SMALL, CLEAR, SURE = 2.5, 4.0, 6.0, 5.0, 64
#: Rounds in which every class is held against so many others at most, before all that is left.
ROUNDS, PIVOTS = 4, 8
_LANES = np.uint64(0x0101010101010101)
_STEPS = np.array([0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF for j in range(WORDS)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """For each row of 64-bit values how many have each bit; eight bits are summed at once in the
    bytes of a word, over runs too short to overflow one."""
    out = np.empty((len(h), BITS), np.int64)
    at = np.arange(0, h.shape[1], 255)
    for b in range(8):
        lanes = np.add.reduceat((h >> np.uint64(b)) & _LANES, at, axis=1)
        out[:, b::8] = lanes.view(np.uint8).reshape(len(h), -1, 8).sum(axis=1, dtype=np.int64)
    return out


def long_simhash(h: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words, each a SimHash over its own mix of the shingle hashes; zeros if there are none."""
    n = len(h)
    counts = np.zeros((WORDS, BITS), np.int64)
    step = CHUNK // 16
    for at in range(0, n, step):
        x = h[None, at : at + step] + _STEPS[:, None]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        counts += bit_counts(x ^ (x >> np.uint64(31)))
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<i8").ravel()


def most_bits(similarity: float) -> int:
    """Differing bits of the long fingerprint at this Jaccard similarity of shingles: sets of one size
    have cosine 2s / (1 + s), and a bit differs with the angle over pi."""
    cosine = 2 * similarity / (1 + similarity)
    return int(WORDS * BITS * np.arccos(cosine) / np.pi)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The distinct hashes of ``width``-word shingles (all words if there are fewer), in order."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    n, digest = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if n > 1 else (b" ".join(words),)
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64, count=n))


def set_class(h: np.ndarray) -> int:
    """One signed number for a set of shingles."""
    c = xxhash.xxh64_intdigest(h.tobytes(), SEED)
    return c - (1 << BITS) if c >> (BITS - 1) else c


def block_plan(classes: int, similarity: float) -> np.ndarray:
    """The bits of each block, a row a block: as many blocks as it takes for a pair at this similarity to
    agree on one with chance SHARED. Blocks part a shuffle of all bits, then of another shuffle, and so on."""
    width = min(WIDEST, math.ceil(math.log2(max(2, classes))) + SPARE)
    agree = (1 - most_bits(similarity) / (WORDS * BITS)) ** width
    blocks = math.ceil(math.log(1 - SHARED) / math.log(1 - agree))
    each = WORDS * BITS // width
    rng = np.random.default_rng(SEED)
    rounds = [rng.permutation(WORDS * BITS)[: each * width].reshape(each, width) for _ in range(-(-blocks // each))]
    return np.concatenate(rounds)[:blocks]


def block_keys(classes: DataFrame, plan: np.ndarray) -> DataFrame:
    """``(key, c)`` for every class ``c`` with long fingerprint ``fp`` and every block of the plan: the
    number of the block, then its bits."""
    blocks, width = plan.shape

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                fps = np.ascontiguousarray(part.column(1).flatten().to_numpy()).view(np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(fps, axis=1, bitorder="little")[:, plan]
                packed = np.zeros((part.num_rows, blocks, 8), np.uint8)
                packed[:, :, : -(-width // 8)] = np.packbits(bits, axis=2, bitorder="little")
                keys = packed.view("<i8")[:, :, 0] | (np.arange(blocks, dtype=np.int64) << WIDEST)
                cols = [pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), blocks))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "c"])

    return classes.select("c", "fp").mapInArrow(keyed, "key long, c long")


def distances(similarity: float) -> tuple[Column, Column, Column]:
    """For a pair with sizes ``n, m`` and fingerprints ``x, y``: whether it may be this similar by sizes and
    the first words, the bits in which it differs, and the share of bits expected at the similarity."""
    cosine = F.expr(f"least(1D, {similarity} / (1D + {similarity}) * (n + m) / greatest(1D, sqrt(cast(n as double) * m)))")
    apart = F.acos(cosine) / math.pi
    spread = F.sqrt(apart * (1 - apart))
    far = lambda usual: F.when(F.least("n", "m") < SURE, FAR_SMALL).otherwise(usual)
    first = F.bit_count(F.col("x")[0].bitwiseXOR(F.col("y")[0]))
    may = (F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-6) & (first <= BITS * apart + far(FAR_WORD) * math.sqrt(BITS) * spread)
    bits = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, b: a + b)
    total = WORDS * BITS
    return may & (bits <= total * apart + far(FAR) * math.sqrt(total) * spread), bits, total * apart - CLEAR * math.sqrt(total) * spread


def near_pairs(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the distinct ``(c, d)`` whose sets of shingles have this Jaccard similarity or more.

    Sizes and the first word of the fingerprints rule out strangers, then whole fingerprints are held
    against the distance expected at the similarity, given both sizes. Pairs far beyond it go, pairs
    clearly below it stay, and for all others the sets are made again from the texts and compared."""
    of = lambda df, names: df.select(*(F.col(x).alias(y) for x, y in names.items()))
    may, bits, clear = distances(similarity)
    whole = classes.select("c", "n", F.col("fp").alias("x"))
    pairs = pairs.join(whole, "c").join(of(whole, {"c": "d", "n": "m", "x": "y"}), "d")
    met = pairs.where(may).select("c", "d", "n", "m", ((F.least("n", "m") >= SURE) & (bits <= clear)).alias("clear"))
    met = materialize(met, "met")
    open_ = met.where("not clear")
    wanted = open_.select("c").union(open_.select("d")).distinct()
    ids = classes.join(wanted, "c", "left_semi").select(F.col("first").alias("wanted_id")).distinct()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(0)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            cols = [pa.array([set_class(h) for h in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(cols, names=["c", "h"])

    sets = texts.join(ids, F.expr("id <=> wanted_id"), "left_semi").select("t").mapInArrow(again, "c long, h array<long>")
    sets = materialize(sets.join(wanted, "c", "left_semi").groupBy("c").agg(F.first("h").alias("x")), "sets")
    both = open_.join(sets, "c").join(of(sets, {"c": "d", "x": "y"}), "d")
    shared = F.size(F.array_intersect("x", "y"))
    near = both.where(shared * (1 + similarity) >= (F.col("n") + F.col("m")) * similarity - 1e-6).select("c", "d")
    out = materialize(near.unionByName(met.where("clear").select("c", "d")), "near")
    discard(met, sets)
    return out


def linked_classes(
    keyed: DataFrame, near: Callable[[DataFrame], DataFrame], facts: DataFrame | None = None, may: Column | None = None
) -> DataFrame:
    """``(node, root)`` of the classes ``c`` that hang together by the pairs of one ``key`` that ``near``
    confirms, a filter of distinct pairs ``(c, d)``.

    First come rounds in which every class is held against PIVOTS others at most: each key names a class of its
    largest component, the first by an order that is another in every round, and of those named a class
    meets those that most keys name, as close classes share more keys than strangers do. Who isn't near
    the pivots of one round meets others in the next. So a large group of close classes becomes one component at a few comparisons a
    member. Then, in keys whose classes still lie in several components, all that aren't of the key's
    largest are compared with all that are of another component than theirs: no pair is left out but those
    that can't change a component. ``may``: a condition on the columns of ``facts`` that is true of every
    near pair (``n, x`` of one class, ``m, y`` of the other); it is part of that join."""
    keyed = keyed.repartition("key")  # one exchange, which both sides of the join read
    ends = keyed.groupBy("key").agg(F.min("c").alias("d"), F.max("c").alias("last"))
    shared = materialize(keyed.join(ends.where("d <> last").select("key"), "key", "left_semi").distinct(), "shared")
    links = lambda df: df.select(F.least("c", "d").alias("u"), F.greatest("c", "d").alias("v"))
    rows = shared.select("key", "c", F.col("c").alias("root"))
    found: DataFrame | None = None
    tables = [shared]
    for nth_round in range(ROUNDS + 1):
        last = nth_round == ROUNDS
        order = F.struct(F.xxhash64("c", F.lit(nth_round)), "c") if nth_round else F.col("c")
        sizes = rows.groupBy("key", "root").agg(F.count("*").alias("size"), F.min(F.struct(order.alias("order"), "c"))["c"].alias("d"))
        largest = F.max(F.struct("size", (-F.col("d")).alias("order"), "root", "d")).alias("m")
        sizes = sizes.groupBy("key").agg(largest, F.count("*").alias("roots")).where("roots > 1")
        rows = materialize(rows.drop("d", "largest").join(sizes.select("key", F.col("m.root").alias("largest"), "m.d"), "key"), "open")
        tables.append(rows)
        others = rows.where("root <> largest")
        if not last:
            often = others.groupBy("c", "d").agg(F.count("*").alias("keys")).where("keys > 1")
            nth = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("keys"), "d"))
            pairs = often.select("c", "d", nth.alias("nth")).where(F.col("nth") <= PIVOTS).select("c", "d")
        else:
            a, b = others, rows
            if facts is not None:
                a, b = a.join(facts, "c"), b.join(facts, "c").withColumnsRenamed({"n": "m", "x": "y"})
            b = b.withColumnsRenamed({"c": "d2", "root": "root2"}).drop("d", "largest")
            met = a.join(b.hint("merge"), "key").where(F.col("root") != F.col("root2"))
            met = met if may is None else met.where(may)
            pairs = met.select(F.least("c", "d2").alias("c"), F.greatest("c", "d2").alias("d")).distinct()
        new = near(materialize(pairs, "pairs"))
        found = new if found is None else found.unionByName(new)
        roots = connected_components(links(found))
        if not last:
            rows = rows.select("key", "c").join(roots.withColumnRenamed("node", "c"), "c", "left")
            rows = rows.withColumn("root", F.coalesce("root", "c"))
    discard(*tables)
    return roots


def similar_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``(id_col, k, c, component_id, component)``, a row for each row of ``docs``: documents whose sets of
    ``width``-word shingles have this Jaccard similarity or more, and all that hang together by them.

    SimHash with more bits: at this similarity two fingerprints differ in some 15 % of them, so blocks
    can't be sure to agree on one; instead there are as many as it takes for SHARED of the pairs right
    at the similarity, and nearly all pairs above it (:func:`block_plan`). Those that share a block are
    candidates (:func:`linked_classes`), and Hamming distance, then the sets themselves decide
    (:func:`near_pairs`). Equal sets are one class ``c``, and only classes are compared. ``k`` is a hash
    of the text, ``component`` the smallest class and ``component_id`` the smallest id reachable. Null and
    wordless texts are one class; null ids and repeats as in :func:`near_duplicates`.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[tuple[int, int, np.ndarray]] = []
            for t in b.column(2):
                h = shingles(t.as_py(), width)
                made.append((set_class(h), len(h), long_simhash(h)))
            ends = np.arange(0, WORDS * (len(made) + 1), WORDS, dtype=np.int32)
            flat = np.concatenate([f for _, _, f in made]) if made else np.empty(0, np.int64)
            cols = [pa.array([c for c, _, _ in made], pa.int64()), pa.array([n for _, n, _ in made], pa.int32())]
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["id", "k", "c", "n", "fp"])

    spec = [T.StructField("k", T.LongType()), T.StructField("c", T.LongType()), T.StructField("n", T.IntegerType())]
    spec = T.StructType([field(docs, id_col, "id"), *spec, T.StructField("fp", T.ArrayType(T.LongType()))])
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.col(text_col).cast("binary").alias("t"))
    found = materialize(texts.mapInArrow(hashed, spec), "fingerprints")
    classes = found.groupBy("c").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.min("id").alias("first"))
    classes = materialize(classes, "classes")
    plan = block_plan(classes.count(), similarity)
    near = lambda pairs: near_pairs(pairs, classes, texts, width, similarity)
    facts = classes.select("c", "n", F.col("fp").alias("x"))
    roots = linked_classes(block_keys(classes, plan), near, facts, distances(similarity)[0])
    linked = classes.select("c", "first").join(roots.select(F.col("node").alias("c"), "root"), "c", "left")
    linked = linked.withColumn("component", F.coalesce("root", "c"))
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(linked.join(least, "component").select("c", "component_id", "component"), "named")
    out = found.select("id", "k", "c").join(named, "c")
    return out.select(F.col("id").alias(id_col), "k", "c", "component_id", "component")
