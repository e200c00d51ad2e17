"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table

#: What lies between words: all ASCII but digits and letters. A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a k-gram, and k-grams of a window: spans of GRAM + WINDOW - 1 words are guaranteed.
GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: Words kept on either side of a matched k-gram, for extending it.
REACH = WINDOW - 1
#: Benchmark fingerprints up to this many (some 200 bytes each) are broadcast; beyond, documents are
#: first cut down to those that share a fingerprint.
BROADCAST_ROWS = 200_000
#: Letters that lower() may change beside A-Z; code points that Java doesn't know count too.
OTHER_UPPER = r"[\P{ASCII}&&[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}]]"


def word_hashes(text: Column) -> Column:
    """The 64-bit hashes of a text's words, in order; none for null. A-Z are lower-cased in the whole
    text at once: by lower() where that changes nothing else, which is faster than translate()."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike(OTHER_UPPER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.transform(F.array_remove(F.split(low, GAP), ""), lambda w: F.xxhash64(w))


def _grams(words: int, *salt: Column) -> Column:
    """The hash of the run of ``words`` words that begins at each word; cut short at the end."""
    return F.transform("h", lambda x, i: F.xxhash64(*salt, x, *(F.get("h", i + j) for j in range(1, words))))


def _fingerprints(df: DataFrame, keys: list[str], short: list[int]) -> DataFrame:
    """``df(*keys, h)``, h the word hashes, to ``(*keys, h, g, n, i, len, p, fp)``: for each row a head
    row with i = -1, then one for each window, with the smallest k-gram hash in it (len 0), then one
    for each run of ``len`` words that begins at p, for every ``len`` of ``short``.

    Every word and k-gram is hashed once, into the arrays h and g; windows are exploded as numbers
    beside them, and the minimum over a window is a few reads in generated code, small enough to be
    compiled. Nothing copies an array to a row unless the row is kept."""
    runs = F.concat(*(_grams(m, F.lit(m)) for m in short)) if short else F.lit(None).cast("array<bigint>")
    df = df.select(*keys, "h", _grams(GRAM).alias("g"), runs.alias("r"), F.size("h").alias("n"))
    df = df.withColumn("last", F.greatest(F.col("n") - SPAN, F.lit(-1)))
    df = df.select("*", F.explode(F.sequence(F.lit(-1), F.col("last") + F.col("n") * len(short))).alias("i"))
    i, window = F.col("i"), F.col("i") <= F.col("last")
    at = i - F.col("last") - 1
    fp = F.when(window, F.when(i >= 0, F.least(*(F.get("g", i + j) for j in range(WINDOW)))))
    size, p = F.lit(0), F.lit(0)
    if short:
        fp = fp.otherwise(F.get("r", at))
        size = F.when(window, 0).otherwise(F.get(F.array(*map(F.lit, short)), F.floor(at / F.col("n")).cast("int")))
        p = F.when(window, 0).otherwise(at % F.col("n"))
    df = df.select(*keys, "h", "g", "n", "i", size.alias("len"), p.alias("p"), fp.alias("fp"))
    return df.where("p + len <= n or i < 0") if short else df


def _placed(df: DataFrame) -> DataFrame:
    """Windows with the place p of their smallest k-gram, and ctx, the word hashes from REACH words
    before it to as many behind it."""
    window = (F.col("i") >= 0) & (F.col("len") == 0)
    p = F.col("i") + F.array_position(F.slice("g", F.col("i") + 1, WINDOW), F.col("fp")).cast("int") - 1
    df = df.withColumn("p", F.when(window, p).otherwise(F.col("p")))
    steps = F.sequence(F.lit(-REACH), F.lit(GRAM + REACH - 1))
    around = F.transform(steps, lambda j: F.get("h", F.col("p") + j))
    return df.withColumn("ctx", F.when(window, around)).drop("h", "g")


def _run(same: Column, size: int) -> Column:
    """How many of these ``size`` hold before the first that doesn't."""
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.lit(size)).cast("int")


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(id_col, n_words, n_hit, items, contaminated)``, a row for each row of ``docs``.

    A window is ten consecutive words of an item, or the whole of a shorter one; a document word
    inside an occurrence of a window is hit, and ``items`` has the ids, as sorted strings, of the
    items with such windows. Both sides keep the smallest 5-gram hash of every 6 in a row, so any
    ten words that they share give a common fingerprint; these are joined, and each match is
    extended word by word to either side. Items under ten words are matched whole. Documents are
    tokenised once and only fingerprints travel; the one shuffle is of matches and a row for each
    document. Null and empty texts have no words and are clean, items without words match nothing,
    repeated document rows each get their row, repeated item ids count once, null item ids never.
    Of two rows of one id with different texts each has its own result.
    """
    i = items.where(F.col(item_col).isNotNull())
    i = i.select(F.col(item_col).cast("string").alias("item"), word_hashes(F.col(item_text_col)).alias("h"))
    i = materialize(i.distinct(), "items")
    sizes = i.where(F.size("h").between(1, SPAN - 1)).select(F.size("h").alias("n")).distinct()
    short = sorted(r.n for r in sizes.collect())
    marks = _fingerprints(i, ["item"], short).where("i >= 0 and (len = 0 or len = n)")
    marks = _placed(marks).select("item", F.col("len").alias("ilen"), F.col("fp").alias("ifp"), F.col("ctx").alias("ictx"))
    marks = materialize(marks.distinct(), "item-fingerprints")

    keys = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k")]
    words = docs.select(*keys, word_hashes(F.col(text_col)).alias("h"))
    d = _fingerprints(words, ["id", "k"], short)
    match = F.col("fp") == F.col("ifp")
    if marks.count() <= BROADCAST_ROWS:
        d = _placed(d.join(F.broadcast(marks), match, "left"))
    else:
        known = marks.select(F.col("ifp").alias("fp")).distinct()
        some = d.select("id", "k", "fp").join(known, "fp", "left_semi").select(F.col("id").alias("cid"), F.col("k").alias("ck"))
        some = materialize(some.distinct(), "candidates")
        full = words.join(some, F.expr("id <=> cid and k <=> ck"), "left_semi")
        kept = _placed(_fingerprints(full, ["id", "k"], short).where("i >= 0")).join(marks, match)
        head = words.select("id", "k", F.size("h").alias("n"), F.lit(-1).alias("i"), F.lit(0).alias("len"))
        d = kept.unionByName(head, allowMissingColumns=True)
    d = d.where("i < 0 or (item is not null and len = ilen)")
    same = F.zip_with("ctx", "ictx", lambda x, y: F.coalesce(x == y, F.lit(False)))
    d = d.select("id", "k", "n", "i", "len", "p", "item", same.alias("same"))
    left = _run(F.reverse(F.slice("same", 1, REACH)), REACH)
    right = _run(F.slice("same", REACH + 1, GRAM + REACH), GRAM + REACH)
    hit = F.when(F.col("i") < 0, F.lit(None)).when(
        F.col("len") > 0, F.struct(F.col("p").alias("at"), F.col("len").alias("size"))
    ).when(
        (right >= GRAM) & (left + right >= SPAN),
        F.struct((F.col("p") - left).alias("at"), (left + right).alias("size")),
    )
    d = d.select("id", "k", "n", (F.col("i") < 0).cast("long").alias("head"), "item", hit.alias("hit"))
    # No filter by hit: it would be pushed below, onto every window, and be evaluated there.
    d = d.groupBy("id", "k").agg(
        F.max("n").cast("long").alias("n_words"),
        F.sum("head").cast("int").alias("copies"),
        F.collect_set("hit").alias("hits"),
        F.array_sort(F.collect_set(F.when(F.col("hit").isNotNull(), F.col("item")))).alias("items"),
    )
    spans = F.transform("hits", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))
    return d.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"),
        "items",
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).select(id_col, "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of ``benchmark`` windows in all ``documents``."""
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []::VARCHAR[]) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM b, range(1, len(w) - least(len(w), 10) + 2) r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM d, sizes, range(1, greatest(len(w) - size + 2, 1)) r(i)),
hit AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, gram)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, range(i, i + size) s(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
        string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots ON spots.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id
"""
