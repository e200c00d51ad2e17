"""Readers and writers of the engine's file formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Text files with front matter: ``(locator, meta, body, sha256)``, a file a row. Bytes that aren't
    UTF-8 are read as Latin-1."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    df = raw.select(name.alias("locator"), F.sha2("content", 256).alias("sha256"), X.front_matter(X.decode("content")).alias("m"))
    return df.select("locator", "m.meta", "m.body", "sha256")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One nested JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_lines(df: DataFrame, path: str, *, columns: Sequence[str] | None = None, once: bool = False) -> None:
    """Rows as JSON lines, nulls left out; ``once`` refuses to replace what is there. A writer for each
    partition, so the result is as parallel as the frame."""
    out = df.select(*(columns or df.columns))
    out.write.mode("errorifexists" if once else "overwrite").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def archive(df: DataFrame, live: str, durable: str, *, keys: Sequence[str] = ("stamp", "exp"), smoke: bool = False) -> None:
    """The live copy, replaced; and a durable one by key, unless this is a smoke run."""
    df.write.mode("overwrite").json(live)
    if not smoke:
        df.write.mode("append").partitionBy(*keys).json(durable)


def payload(df: DataFrame, counts: Sequence[str]) -> DataFrame:
    """One row: the rows' JSON in order of all columns and the counts of some, with its hash. For designs,
    whose rows are few by construction."""
    body = F.array_sort(F.collect_list(F.to_json(F.struct(*sorted(df.columns)))))
    out = df.agg(body.alias("rows"), F.count("*").alias("n"), *(F.countDistinct(c).alias(f"n_{c}") for c in counts))
    return out.withColumn("sha256", F.sha2(F.array_join("rows", "\n"), 256))
