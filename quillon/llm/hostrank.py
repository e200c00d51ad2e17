"""URL filters: rules, then trust and distrust propagated over the host graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize, table

#: (verdict, rule): a rule is a host and the start of a path.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
DAMPING = 0.85
TOLERANCE = 1e-6
#: Rounds between two written tables.
STRIDE = 4
#: A host that no rule decides is blocked if its distrust exceeds its trust by this much.
MARGIN = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and protocol-relative links of a page; a relative link stays on its host.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'<>\s]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then
    up to ``?``, ``#`` or the end. Both empty for null and where there is no ``://``."""
    part = lambda n: F.coalesce(
        F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit("")
    )
    return F.translate(part(1), UPPER, LOWER), part(2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct ``(verdict, rule)`` of the longest rule that fits, or null. The rules are a list of
    the program's, so one expression tests them where the row is."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(host, score)`` of personalised PageRank: ``edges(src, dst, w)``, ``seeds(host, seed)`` with
    seeds in 0 to 1. A host that nothing links to has its seed as its score.

    score = seed + DAMPING * what comes in, where a host passes its score on in proportion to its
    links: PageRank by 1 - DAMPING, so that a host's own seed counts in full. A round is a join and a
    partial aggregate by host, and every STRIDE rounds are written to the shared folder, so neither a
    hub nor a lost executor hurts. Goes on until no score moves by TOLERANCE, which it comes to on any
    graph, because all that still moves shrinks by DAMPING in every round."""
    total = edges.groupBy("src").agg(F.sum("w").alias("all"))
    flow = edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("p"))
    flow = materialize(flow, "flow")
    rank = seeds.select("host", F.col("seed").alias("score"))
    while True:
        new = rank
        for _ in range(STRIDE):
            moved = flow.join(new.select("host", "score"), F.col("src") == F.col("host"))
            moved = moved.groupBy("dst").agg(F.sum(F.col("p") * F.col("score")).alias("into"))
            old = new.select("host", F.col("score").alias("old"))
            new = seeds.join(moved, F.col("host") == F.col("dst"), "left").join(old, "host").select(
                "host", (F.col("seed") + DAMPING * F.coalesce("into", F.lit(0.0))).alias("score"), "old"
            )
        new = materialize(new, "rank")
        change = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        discard(rank)
        rank = new
        if change is None or change < TOLERANCE:
            discard(flow)
            return rank.select("host", "score")


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """``(id_col, host, path, rule, verdict)``, a row for each row of ``pages``.

    A page that a rule fits has its verdict. Others have their host's: a host is a seed of trust
    (of distrust) to the extent that rules allow (block) its pages; trust follows links, distrust
    goes against them, and a host is blocked whose distrust exceeds its trust by MARGIN. Hosts
    are linked by the absolute links of their pages, one edge a pair of hosts, weighted by the
    pages that have it; hosts that are only linked to have the verdict of a rule for the whole host
    as their seed, and pass scores on. Null html has no links; a
    null url, or one without ``://``, has an empty host, which is judged like any other. Repeated
    pages stay repeated and weigh more. Empty pages give an empty result.
    """
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    split = split.withColumn("m", matching_rule(F.col("host"), F.col("path"), rules))
    by_host = split.groupBy("host").agg(
        F.avg(F.coalesce((F.col("m.verdict") == "allow").cast("double"), F.lit(0.0))).alias("good"),
        F.avg(F.coalesce((F.col("m.verdict") == "block").cast("double"), F.lit(0.0))).alias("bad"),
    )
    links = F.array_distinct(F.regexp_extract_all(F.translate("html", UPPER, LOWER), F.lit(LINK), F.lit(1)))
    edges = split.where(F.contains("html", F.lit("//"))).select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    edges = edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    edges = materialize(edges, "host-links")
    outside = edges.select(F.col("dst").alias("host")).distinct().join(by_host, "host", "left_anti")
    root = F.coalesce(matching_rule(F.col("host"), F.lit("/"), rules)["verdict"], F.lit(""))
    outside = outside.select("host", *((root == v).cast("double").alias(n) for n, v in (("good", "allow"), ("bad", "block"))))
    hosts = materialize(by_host.unionByName(outside), "hosts")
    trust = propagate(edges, hosts.select("host", F.col("good").alias("seed")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = propagate(back, hosts.select("host", F.col("bad").alias("seed")))
    verdicts = trust.join(distrust.select("host", F.col("score").alias("bad")), "host")
    verdicts = verdicts.select("host", (F.col("bad") - F.col("score") >= MARGIN).alias("blocked"))
    judged = split.drop("html").join(verdicts, "host")
    own = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("id").alias(id_col), "host", "path",
        F.col("m.rule").alias("rule"), F.coalesce("m.verdict", own).alias("verdict"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every url of ``pages``."""
    return judge(table(spark, sf_dir, "pages"))


#: Rounds of the SQL: 0.85 to this power is far below TOLERANCE.
_ROUNDS = 120
_FITS = " ".join(
    f"WHEN (host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}') THEN '{verdict} {rule}'"
    for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
)


def _rank(name: str, seed: str, src: str, dst: str) -> str:
    return f"""{name} AS (
  SELECT 0 AS i, host, {seed} AS score FROM hosts
  UNION ALL
  SELECT any_value(r.i) + 1, h.host, any_value(h.{seed}) + {DAMPING} * coalesce(sum(e.w / t.w * r.score) FILTER (WHERE e.{dst} = h.host), 0)
  FROM {name} r LEFT JOIN edges e ON e.{src} = r.host LEFT JOIN total_{src} t ON t.host = r.host, hosts h WHERE r.i < {_ROUNDS} GROUP BY h.host)"""


ORACLE_SQL = rf"""
WITH RECURSIVE s AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, translate(coalesce(html, ''), '{UPPER}', '{LOWER}') AS html FROM pages),
m AS (SELECT *, CASE {_FITS} END AS m FROM s),
links AS (SELECT DISTINCT page_id, host AS src, unnest(regexp_extract_all(html, '\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''<>\s]+)', 1)) AS dst FROM m),
edges AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM links WHERE src <> dst GROUP BY ALL),
total_src AS (SELECT src AS host, sum(w) AS w FROM edges GROUP BY 1),
total_dst AS (SELECT dst AS host, sum(w) AS w FROM edges GROUP BY 1),
own AS (SELECT host, avg(CAST(coalesce(starts_with(m, 'allow'), FALSE) AS INT)) AS good, avg(CAST(coalesce(starts_with(m, 'block'), FALSE) AS INT)) AS bad FROM m GROUP BY host),
outside AS (SELECT host, CASE {_FITS} END AS m FROM (SELECT DISTINCT dst AS host, '/' AS path FROM edges WHERE dst NOT IN (SELECT host FROM own))),
hosts AS (SELECT * FROM own UNION ALL SELECT host, CAST(coalesce(starts_with(m, 'allow'), FALSE) AS INT), CAST(coalesce(starts_with(m, 'block'), FALSE) AS INT) FROM outside),
{_rank("trust", "good", "src", "dst")},
{_rank("distrust", "bad", "dst", "src")},
v AS (SELECT t.host, d.score - t.score >= {MARGIN} AS blocked FROM trust t JOIN distrust d ON t.host = d.host AND t.i = {_ROUNDS} AND d.i = {_ROUNDS})
SELECT page_id, m.host, path, split_part(m, ' ', 2) AS rule, CASE WHEN m IS NOT NULL THEN split_part(m, ' ', 1) WHEN blocked THEN 'block' ELSE 'allow' END AS verdict FROM m JOIN v USING (host)
"""
