"""Import of agents' logs, and reports of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lexicons as L

#: A line of an agent's log: a role and content that is text or a list of parts.
CONTENT = "array<struct<type:string,text:string,name:string,input:string,content:string>>"


def parts(content: Column) -> Column:
    """Content, text or list, as a list of parts."""
    listed = F.from_json(content, CONTENT)
    text = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("name", "input", "content"))))
    return F.when(F.ltrim(content).startswith("["), listed).otherwise(text.cast(CONTENT))


def turns(content: Column, limit: int = L.TURN_CUT) -> Column:
    """Parts as ``(kind, name, text, cut_at, full_size)``; a long text is cut and marked as such."""

    def one(p: Column) -> Column:
        text = F.coalesce(p["text"], p["input"], p["content"], F.lit(""))
        long = F.length(text) > limit
        return F.struct(
            p["type"].alias("kind"), p["name"].alias("name"), F.substring(text, 1, limit).alias("text"),
            F.when(long, F.lit(limit)).alias("cut_at"), F.when(long, F.length(text)).alias("full_size"),
        )

    return F.transform(parts(content), one)


def plain(content: Column) -> Column:
    """The text parts of content, joined by line breaks."""
    only = F.filter(parts(content), lambda p: (p["type"] == "text") & (F.trim(F.coalesce(p["text"], F.lit(""))) != ""))
    return F.array_join(F.transform(only, lambda p: p["text"]), "\n")


def records(lines: DataFrame, *, session: str = "session", order: str = "line") -> DataFrame:
    """``(session, record, prompt, reply, turns)`` of log lines ``(session, line, role, content)``: each reply
    with text takes what was said since the one before; messages of tools alone go to its turns."""
    df = lines.where(F.col("role").isin("user", "assistant"))
    df = df.select(session, order, "role", plain(F.col("content")).alias("text"), turns(F.col("content")).alias("t"))
    reply = (F.col("role") == "assistant") & (F.col("text") != "")
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("record", F.coalesce(F.sum(reply.cast("int")).over(w), F.lit(0))).withColumn("__r", reply)
    by = df.groupBy(session, "record").agg(
        F.array_sort(F.collect_list(F.when((F.col("role") == "user") & (F.col("text") != ""), F.struct(order, "text")))).alias("p"),
        F.max(F.when(F.col("__r"), F.col("text"))).alias("reply"), F.array_sort(F.collect_list(F.struct(order, "t"))).alias("t"),
    )
    return by.where("reply is not null").select(
        session, "record", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("prompt"), "reply", F.flatten(F.transform("t", lambda x: x["t"])).alias("turns")
    )


def ignored(lines: DataFrame) -> DataFrame:
    """How many lines are no message, by role."""
    return lines.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).groupBy("role").agg(F.count("*").alias("n"))


def html_page(rows: DataFrame, title: str, columns: list[str], *, limit: int) -> str:
    """A page with the first ``limit`` rows, escaped, without references to any network: a report for
    people, whose size is bounded by ``limit``."""
    from html import escape

    show = lambda x: "—" if x is None else ("sim" if x else "não") if isinstance(x, bool) else escape(str(x))
    body = "".join("<tr>" + "".join(f"<td>{show(r[c])}</td>" for c in columns) + "</tr>" for r in rows.select(*columns).limit(limit).collect())
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    page = f"<!DOCTYPE html><meta charset='utf-8'><title>{escape(title)}</title><table><tr>{head}</tr>{body}</table>"
    return page
