"""Append-only logs: tolerant reading, seals, running order, replay, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stage(spark: SparkSession, path: str, schema: T.StructType, *, text: str | None = None, seal: str | None = None) -> DataFrame:
    """Lines of JSON files as ``(file, line, status, r)``: status is ``ok``, ``invalid`` (not of the schema),
    ``truncated`` (invalid, and the last of its file) or ``tampered`` (the SHA-256 of ``text`` isn't
    ``seal``). Blank lines are skipped but numbered. A file is one row until it is split, so lines keep
    their numbers; files of a log are bounded by its rotation."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\n")).alias("line", "value")).where("trim(value) <> ''")
    parsed = F.from_json("value", schema.add("__bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    lines = lines.select("file", (F.col("line") + 1).alias("line"), parsed.alias("r"))
    last = lines.groupBy("file").agg(F.max("line").alias("last"))
    lines = lines.join(last, "file")
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    status = F.when(bad & (F.col("line") == F.col("last")), "truncated").when(bad, "invalid")
    if text and seal:
        status = status.when(sealed(F.col(f"r.{text}")) != F.col(f"r.{seal}"), "tampered")
    return lines.select("file", "line", status.otherwise("ok").alias("status"), F.col("r").dropFields("__bad").alias("r"))


def read_known(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with the columns of the schema; unknown fields are dropped, blank lines skipped."""
    return spark.read.schema(schema).json(path)


def unknown_fields(spark: SparkSession, path: str, allowed: Sequence[str]) -> DataFrame:
    """``(file, line_text, fields)`` of lines with fields that aren't allowed: none means a strict read passes."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.input_file_name().alias("file"), "value")
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    odd = F.array_except(keys, F.array(*map(F.lit, allowed)))
    return lines.select("file", F.col("value").alias("line_text"), odd.alias("fields")).where("size(fields) > 0")


def stages(spark: SparkSession, path: str) -> DataFrame:
    """Names of the log files of a folder, in order."""
    name = F.regexp_extract(F.col("path"), r"([^/]+?)(?:\.jsonl?)?$", 1)
    return spark.read.format("binaryFile").load(path).select(name.alias("stage")).distinct().orderBy("stage")


def case_collisions(names: DataFrame, col: str = "stage") -> DataFrame:
    """Names that differ in case only."""
    by = names.groupBy(F.lower(col).alias("key")).agg(F.array_sort(F.collect_set(col)).alias("names"))
    return by.where("size(names) > 1")


def sealed(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_hash(c: Column) -> Column:
    """SHA-256 of a struct's JSON, nulls left out; sort the fields before for a canonical form."""
    return F.sha2(F.to_json(c), 256)


def continued(new: DataFrame, last: int, stage: str, order: str) -> DataFrame:
    """``new`` with the running ``ordem`` after ``last`` and a default ``id``. Rows of one append are numbered
    in order; an append is what one run adds, not the log."""
    n = F.row_number().over(Window.orderBy(order)) + F.lit(last)
    return new.withColumn("ordem", n).withColumn("id", F.format_string("%s-%05d", F.lit(stage), n))


def replay(events: DataFrame, keys: Sequence[str], order: str, discarded: Column) -> DataFrame:
    """The live state of an event-sourced ledger: the last event of each key, unless it discards. An
    aggregate with map-side maxima; no key's history gathers anywhere."""
    others = [c for c in events.columns if c not in keys]
    last = events.withColumn("__gone", discarded).groupBy(*keys).agg(F.max_by(F.struct(*others, "__gone"), F.col(order)).alias("e"))
    return last.where(~F.col("e.__gone")).select(*keys, *(F.col(f"e.{c}").alias(c) for c in others))


def admit(live: DataFrame, new: DataFrame, keys: Sequence[str], order: str, *, batch: bool = True) -> DataFrame:
    """Rows of ``new`` with ``admitted``: none whose key is live or came earlier in ``new``; a batch stops
    at its first collision and keeps what came before."""
    first = Window.partitionBy(*keys).orderBy(order)
    hit = live.select(*keys).distinct().withColumn("__live", F.lit(True))
    rows = new.withColumn("__nth", F.row_number().over(first)).join(hit, list(keys), "left")
    rows = rows.withColumn("__bad", F.coalesce("__live", F.lit(False)) | (F.col("__nth") > 1))
    if batch:
        stop = rows.where("__bad").agg(F.min(order).alias("__stop"))
        rows = rows.join(F.broadcast(stop)).withColumn("admitted", F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop")
    else:
        rows = rows.withColumn("admitted", ~F.col("__bad"))
    return rows.drop("__nth", "__live", "__bad")


def only_new(index: DataFrame, entries: DataFrame, keys: Sequence[str] = ("exp", "stamp")) -> DataFrame:
    """Entries whose key isn't indexed, each once: what an idempotent index appends."""
    return entries.dropDuplicates(list(keys)).join(index.select(*keys), list(keys), "left_anti")


def sessions(turns: DataFrame, group: str, order: str, role: Column, text: str) -> DataFrame:
    """``(group, session, prompt, reply, n_prompts)``: what is said until the next reply belongs to it.
    Prompts without a later reply have none. A conversation is one task's window, and of bounded size."""
    w = Window.partitionBy(group).orderBy(order)
    reply = role == "assistant"
    before = F.coalesce(F.sum(reply.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = turns.select(group, F.col(order).alias("__o"), before.alias("session"), reply.alias("__r"), F.col(text).alias("__t"))
    by = rows.groupBy(group, "session").agg(
        F.array_sort(F.collect_list(F.when(~F.col("__r"), F.struct("__o", "__t")))).alias("p"), F.max(F.when(F.col("__r"), F.col("__t"))).alias("reply")
    )
    prompt = F.array_join(F.transform("p", lambda x: x["__t"]), "\n\n")
    return by.select(group, "session", prompt.alias("prompt"), "reply", F.size("p").cast("long").alias("n_prompts"))


def stage_summary(log: DataFrame, groups: Sequence[str], text: str, truncated: Column) -> DataFrame:
    """Rows, characters, and cut or unknown ends of each group."""
    return log.groupBy(*groups).agg(
        F.count("*").alias("n"), F.sum(F.length(F.coalesce(text, F.lit("")))).alias("chars"),
        F.count_if(F.coalesce(truncated, F.lit(False))).alias("n_truncated"), F.count_if(truncated.isNull()).alias("n_unknown"),
    )


def alternate(df: DataFrame, stratum: str, unit: str, seed: int) -> DataFrame:
    """``df`` with ``side`` 0 and 1 in turn within a stratum, in the order of a hash of (seed, stratum, unit)."""
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(stratum).cast("string"), F.col(unit).cast("string")), 256)
    return df.withColumn("side", F.pmod(F.row_number().over(Window.partitionBy(stratum).orderBy(key)) - 1, F.lit(2)))


def trials(personas: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every persona with every context: the product is the result, and both sides are a design's."""
    return personas.crossJoin(contexts)


def holdout(df: DataFrame, stratum: str, unit: str, share: float, seed: int) -> DataFrame:
    """``df`` with ``split``: of each stratum's units the first ``share`` (rounded half to even) in the order
    of a hash are held out; all rows of a unit fall on one side."""
    units = df.select(stratum, unit).distinct()
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(unit).cast("string")), 256)
    w = Window.partitionBy(stratum)
    units = units.select(stratum, unit, F.row_number().over(w.orderBy(key)).alias("__r"), F.count("*").over(w).alias("__n"))
    held = F.col("__r") <= F.bround(F.col("__n") * F.lit(share), 0)
    return df.join(units, [stratum, unit]).withColumn("split", F.when(held, "holdout").otherwise("train")).drop("__r", "__n")
