"""Queries that run as streams over all that is there; the SQL is that of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.tables import table
from quillon.streaming import logs


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream; a pattern, as Spark takes a plain path for a folder."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")


def stream_append(spark: SparkSession, d: str) -> DataFrame:
    rows = logs.checked(_events(spark, d).withColumn("seal", F.sha2(F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.col("props")), 256)), "props", "seal")
    return logs.drain(rows.select("event_id", "tampered"))


def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    return logs.drain(logs.claims(_events(spark, d).select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error"))


def batch_windows(spark: SparkSession, d: str) -> DataFrame:
    out = logs.truncation_rate(table(spark, d, "events"), "ts", "event_type", F.col("value") > 50)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "k")


QUERIES = {f.__name__: f for f in (stream_append, stream_ledger, batch_windows)}
ORACLE_SQL = {
    "stream_append": "SELECT event_id, event_id % 7 = 0 AND props <> '' AS tampered FROM events",
    "stream_ledger": """WITH s AS (SELECT user_id, event_id, event_type = 'error' AS gone, coalesce(sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY event_id) AS n FROM s)
SELECT user_id, event_id, CASE WHEN gone THEN CASE WHEN n > 1 THEN 'DISCARD' ELSE 'IGNORED' END WHEN n = 1 THEN 'ACCEPTED' ELSE 'COLLISION' END AS outcome FROM r""",
    "batch_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS k FROM events GROUP BY ALL",
}
