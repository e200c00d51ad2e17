"""Queries of forced choice and markers. Pairs are consecutive labelled documents of a language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import responders as R
from quillon.operators import choice, markers
from quillon.plans.text_plans import norm
from quillon.sources.tables import table

#: Rules that SQL repeats; all others are tested on fixtures.
RULES = {"posicao_primeira": R.RESPONDERS["posicao_primeira"], "lexico": R.RESPONDERS["lexico"], "curto": R.RESPONDERS["curto"], "antieco": R.RESPONDERS["antieco"], "negativista": R.RESPONDERS["negativista"], "sicofanta": R.RESPONDERS["sicofanta"]}
#: Markers over the driver's words.
INVARIANTS = {"tone": ("of the", "is the"), "claim": ("the and", "nao of"), "rest": ("inn", "es de la")}


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Items from conversations: a user turn is the context, its reply and the reply's successor the options."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("contexto"))
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("op_consistente"))
    v = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("op_violadora"))
    return u.join(a, ["conv_id", "turn"]).join(v, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.pmod("conv_id", F.lit(3)).cast("string").alias("invariante"), "contexto", "op_consistente", "op_violadora"
    )


def blind_subjects(spark: SparkSession, d: str) -> DataFrame:
    found = choice.rates(choice.blind_answers(pairs(spark, d), RULES))
    return found.select("stratum", "responder", "n", F.round("rate", 6).alias("rate"))


def best_blind_rule(spark: SparkSession, d: str) -> DataFrame:
    found = choice.best_responder(choice.rates(choice.blind_answers(pairs(spark, d), RULES)))
    return found.select("stratum", "responder", F.round("rate", 6).alias("rate"))


def all_blind_subjects(spark: SparkSession, d: str) -> DataFrame:
    return choice.rates(choice.blind_answers(pairs(spark, d)))


def length_supremum(spark: SparkSession, d: str) -> DataFrame:
    return choice.length_supremum(pairs(spark, d)).select("stratum", "n", F.round("rate", 6).alias("rate"))


def bank_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    out = choice.diagnosis(pairs(spark, d))
    return out.select("stratum", F.size("deltas").alias("n_deltas"), F.round("ties", 6).alias("ties"), F.round("supremum", 6).alias("supremum"), "responder", "rate", "verdict")


def marker_violation_negation(spark: SparkSession, d: str) -> DataFrame:
    out = markers.consistency(table(spark, d, "conversations").select("conv_id", "turn", "text"), INVARIANTS)
    return out.select("conv_id", "turn", F.round("score", 6).alias("score"), F.array_join("violated", ",").alias("violated"))


def marker_substrings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(markers.substring_violations("text", INVARIANTS), ",").alias("violated"))


QUERIES = {f.__name__: f for f in (blind_subjects, best_blind_rule, all_blind_subjects, length_supremum, bank_diagnosis, marker_violation_negation, marker_substrings)}

_PAIRS = """p AS (SELECT u.conv_id * 1000 + u.turn AS item_id, CAST(u.conv_id % 3 AS VARCHAR) AS stratum, u.text AS ctx, a.text AS a, b.text AS b
  FROM conversations u JOIN conversations a ON u.role = 'user' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1 JOIN conversations b ON b.conv_id = u.conv_id AND b.turn = u.turn + 2)"""
_INT = "regexp_matches({c}, '(^| )(" + "|".join(("apenas", "somente", "mero", "mera", "so", "no fundo", "em ultima analise", "nada alem", "nao passo de", "afinal")) + ")($| )')"
_ECHO = r"len(list_intersect(list_distinct(regexp_extract_all(lower(ctx), '\S+')), list_distinct(regexp_extract_all(lower({c}), '\S+'))))"
_NEG = "(length({c}) - length(replace(lower({c}), 'não', ''))) // 3"
_ANSWERS = f"""{_PAIRS},
r AS (SELECT item_id, stratum, unnest([{{'pos': 0, 'name': 'posicao_primeira', 'ok': FALSE}},
  {{'pos': 1, 'name': 'lexico', 'ok': {_INT.format(c=norm('b'))} AND NOT {_INT.format(c=norm('a'))}}},
  {{'pos': 2, 'name': 'curto', 'ok': length(a) < length(b)}}, {{'pos': 3, 'name': 'antieco', 'ok': {_ECHO.format(c='a')} < {_ECHO.format(c='b')}}},
  {{'pos': 4, 'name': 'negativista', 'ok': {_NEG.format(c='a')} > {_NEG.format(c='b')}}}, {{'pos': 5, 'name': 'sicofanta', 'ok': FALSE}}]) AS x FROM p),
g AS (SELECT stratum, x.pos AS pos, x.name AS responder, count(*) AS n, avg(CAST(x.ok AS INT)) AS rate FROM r GROUP BY GROUPING SETS ((stratum, x.pos, x.name), (x.pos, x.name)))"""


def _marker_sql(marker: str) -> str:
    words = marker.split()
    n = len(words)
    hit = " AND ".join(f"w[i + {j}] = '{w}'" for j, w in enumerate(words))
    if words[0] not in L.DENIALS:
        names = ", ".join(f"'{w}'" for w in L.NEGATORS)
        near = " OR ".join([f"(i > {k} AND w[i - {k}] IN ({names}))" for k in (1, 2, 3)] + [f"(i > {k} AND w[i - {k}] = 'longe' AND w[i - {k - 1}] = 'de')" for k in (2, 3)])
        hit += f" AND NOT ({near})"
    return f"len(list_filter(range(1, len(w) - {n - 2}), lambda i: {hit})) > 0"


_MARKERS = "[" + ", ".join(f"CASE WHEN {' OR '.join(_marker_sql(m) for m in ms)} THEN '{k}' END" for k, ms in INVARIANTS.items()) + "]"
ORACLE_SQL = {
    "blind_subjects": f"WITH {_ANSWERS} SELECT stratum, responder, n, round(rate, 6) AS rate FROM g",
    "best_blind_rule": f"WITH {_ANSWERS} SELECT stratum, responder, round(rate, 6) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY rate DESC, pos) AS k FROM g) WHERE k = 1",
    "length_supremum": f"""WITH {_PAIRS}, d AS (SELECT unnest([stratum, NULL]) AS stratum, length(a) - length(b) AS d FROM p),
m AS (SELECT stratum, abs(d) AS m, count(*) FILTER (WHERE d > 0) AS x, count(*) FILTER (WHERE d < 0) AS y, count(*) AS k FROM d GROUP BY ALL)
SELECT stratum, CAST(sum(k) AS BIGINT) AS n, round(sum(CASE WHEN m > 0 THEN greatest(x, y) ELSE 0 END) / sum(k), 6) AS rate FROM m GROUP BY stratum""",
    "marker_violation_negation": f"""WITH t AS (SELECT conv_id, turn, list_filter(string_split({norm('text')}, ' '), lambda t: t <> '') AS w FROM conversations),
v AS (SELECT conv_id, turn, list_filter({_MARKERS}, lambda x: x IS NOT NULL) AS v FROM t)
SELECT conv_id, turn, round(1 - len(v) / 3.0, 6)::DOUBLE AS score, array_to_string(v, ',') AS violated FROM v""",
    "marker_substrings": f"""SELECT conv_id, turn, array_to_string(list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'''contains({norm('text')}, '{m}')''' for m in ms)} THEN '{k}' END" for k, ms in INVARIANTS.items())}], lambda x: x IS NOT NULL), ',') AS violated FROM conversations""",
}
