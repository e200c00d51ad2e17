"""Queries of logs, ledgers, sessions and designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import eventlog
from quillon.sources.tables import table


def sessionise_turns(spark: SparkSession, d: str) -> DataFrame:
    out = eventlog.sessions(table(spark, d, "conversations"), "conv_id", "turn", F.col("role"), "text")
    return out.select("conv_id", F.col("session").cast("long").alias("session"), F.md5("prompt").alias("prompt_md5"), F.md5("reply").alias("reply_md5"), "n_prompts")


def multi_turn_concat(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")
    return by.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.md5(text).alias("text_md5"))


def ledger_replay(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    out = eventlog.replay(e, ["user_id"], "event_id", F.col("event_type") == "error")
    return out.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


def ledger_admission(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    out = eventlog.admit(e.where("event_id < 20"), e.where("event_id >= 20"), ["user_id", "event_type"], "event_id")
    return out.select("event_id", "admitted")


def ledger_single_admission(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    out = eventlog.admit(e.where("event_id < 20"), e.where("event_id >= 20"), ["user_id", "event_type"], "event_id", batch=False)
    return out.select("event_id", "admitted")


def log_seal_check(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    stored = eventlog.sealed(F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return c.select("conv_id", "turn", (eventlog.sealed(F.col("text")) != stored).alias("tampered"), eventlog.sealed(F.col("text")).alias("seal"))


def running_ids(spark: SparkSession, d: str) -> DataFrame:
    out = eventlog.continued(table(spark, d, "benchmark").select("item_id"), 7, "stage", "item_id")
    return out.select("item_id", F.col("ordem").cast("long").alias("ordem"), "id")


def index_append(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("exp"), F.pmod("user_id", F.lit(40)).alias("stamp"))
    return eventlog.only_new(e.where("stamp < 10"), e)


def alternate_assignment(spark: SparkSession, d: str) -> DataFrame:
    out = eventlog.alternate(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 4004)
    return out.select("doc_id", "lang", F.col("side").cast("long").alias("side"))


def trial_cross(spark: SparkSession, d: str) -> DataFrame:
    r, n = table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name", "n_regionkey")
    out = eventlog.holdout(eventlog.trials(r, n), "n_regionkey", "n_name", 0.34, 4004)
    return out.select("r_name", "n_name", "split")


def stage_summary(spark: SparkSession, d: str) -> DataFrame:
    cut = F.when(F.col("turn") > 0, F.length("text") > 200)
    return eventlog.stage_summary(table(spark, d, "conversations"), ["role"], "text", cut)


def cut_turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", X.cut_turn("text", 100).alias("t"))
    return c.select("conv_id", "turn", F.length("t.text").cast("long").alias("n"), F.col("t.cut_at").cast("long").alias("cut_at"), F.col("t.full_size").cast("long").alias("full_size"))


def drift_quarters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", "value")
    q = e.withColumn("q", F.ntile(4).over(Window.partitionBy("event_type").orderBy("event_id")))
    by = q.where("q in (1, 4)").groupBy("event_type").pivot("q", [1, 4]).agg(F.avg("value"))
    return by.select("event_type", F.round(F.col("4") - F.col("1"), 6).alias("drift"))


QUERIES = {
    f.__name__: f
    for f in (
        sessionise_turns, multi_turn_concat, ledger_replay, ledger_admission, ledger_single_admission, log_seal_check, running_ids, index_append,
        alternate_assignment, trial_cross, stage_summary, cut_turns, drift_quarters,
    )
}
_ADMIT = """h AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 OR EXISTS (SELECT 1 FROM events l WHERE l.event_id < 20 AND l.user_id = e.user_id AND l.event_type = e.event_type) AS bad FROM events e WHERE event_id >= 20)"""
ORACLE_SQL = {
    "sessionise_turns": r"""WITH s AS (SELECT *, coalesce(sum(CAST(role = 'assistant' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM conversations)
SELECT conv_id, CAST(session AS BIGINT) AS session, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role <> 'assistant'), '')) AS prompt_md5, md5(max(text) FILTER (WHERE role = 'assistant')) AS reply_md5,
  count(*) FILTER (WHERE role <> 'assistant') AS n_prompts FROM s GROUP BY ALL""",
    "multi_turn_concat": "SELECT conv_id, count(*) AS n_turns, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1",
    "ledger_replay": "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'",
    "ledger_admission": f"WITH {_ADMIT} SELECT event_id, coalesce(event_id < (SELECT min(event_id) FROM h WHERE bad), TRUE) AS admitted FROM h",
    "ledger_single_admission": f"WITH {_ADMIT} SELECT event_id, NOT bad AS admitted FROM h",
    "log_seal_check": "SELECT conv_id, turn, turn % 3 = 0 AS tampered, sha256(text) AS seal FROM conversations",
    "running_ids": "SELECT item_id, row_number() OVER (ORDER BY item_id) + 7 AS ordem, printf('stage-%05d', row_number() OVER (ORDER BY item_id) + 7) AS id FROM benchmark",
    "index_append": "SELECT DISTINCT event_type AS exp, user_id % 40 AS stamp FROM events WHERE user_id % 40 >= 10",
    "alternate_assignment": "SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY sha256('4004|' || lang || '|' || doc_id)) - 1) % 2 AS side FROM documents",
    "trial_cross": """WITH u AS (SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY sha256('4004|' || n_name)) AS r, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)
SELECT r_name, n_name, CASE WHEN r <= round_even(n * 0.34, 0) THEN 'holdout' ELSE 'train' END AS split FROM region, u""",
    "stage_summary": "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE turn > 0 AND length(text) > 200) AS n_truncated, count(*) FILTER (WHERE turn = 0) AS n_unknown FROM conversations GROUP BY role",
    "cut_turns": "SELECT conv_id, turn, CAST(least(length(text), 100) AS BIGINT) AS n, CAST(CASE WHEN length(text) > 100 THEN 100 END AS BIGINT) AS cut_at, CAST(CASE WHEN length(text) > 100 THEN length(text) END AS BIGINT) AS full_size FROM conversations",
    "drift_quarters": "WITH q AS (SELECT *, ntile(4) OVER (PARTITION BY event_type ORDER BY event_id) AS q FROM events) SELECT event_type, round(avg(value) FILTER (WHERE q = 4) - avg(value) FILTER (WHERE q = 1), 6) AS drift FROM q GROUP BY 1",
}
