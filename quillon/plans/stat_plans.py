"""Queries of exact statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import stats as S
from quillon.functions import text as X
from quillon.operators import gates
from quillon.sources.tables import table


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    return table(spark, d, "labels").join(docs, "doc_id")


def winrate_gate(spark: SparkSession, d: str) -> DataFrame:
    out = gates.winrate(_labelled(spark, d), ["lang"], F.col("quality") == 1, rollup=True)
    return _rounded(out, "rate", "lo", "hi")


def mcnemar_quality_toxic(spark: SparkSession, d: str) -> DataFrame:
    out = gates.paired(_labelled(spark, d), ["lang"], F.col("quality") == 1, F.col("toxic") == 0)
    return _rounded(out, "acc_on", "acc_off", "drop", "mcnemar_p")


def transition_gate(spark: SparkSession, d: str) -> DataFrame:
    q, t, n = F.col("quality"), F.col("toxic"), X.word_count("text")
    adapted = F.when((q == 1) & (t == 0), "CONS").when(q == 0, "VIOL").otherwise("POS")
    base = F.when(n > 400, "CONS").when(n < 100, "VIOL").otherwise("POS")
    df = _labelled(spark, d).select("lang", adapted.alias("adapted"), base.alias("base"))
    return _rounded(gates.transitions(df, ["lang"], "adapted", "base"), "p_direction", "p_mcnemar")


def tost_coincidence(spark: SparkSession, d: str) -> DataFrame:
    df = _labelled(spark, d).select("lang", "doc_id", (F.col("quality") - (1 - F.col("toxic"))).alias("delta"))
    out = gates.coincidence(gates.bootstrap_native(df, ["lang"], "delta", "doc_id", draws=200))
    return _rounded(out, "lo", "hi")


def non_inferiority_seeded(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "labels").select((F.col("toxic") * 1).alias("arm"), "doc_id", (1.0 - F.col("quality")).alias("delta"))
    out = gates.bootstrap_seeded(df, "arm", "delta", "doc_id", draws=500)
    return _rounded(gates.non_inferiority(out), "mean", "lo", "hi")


def majority_vote_user(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(
        S.majority(F.col("value") > 50).alias("majority"), F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k")
    )


def categorical_inversion(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("on"), F.avg((F.col("o_totalprice") > 20000).cast("double")).alias("off")
    )
    out = by.withColumn("inverted", gates.inversion(F.col("on"), F.col("off")))
    return _rounded(out, "on", "off").select(F.col("o_orderpriority").alias("category"), "on", "off", "inverted")


def power_table(spark: SparkSession, d: str) -> DataFrame:
    n = spark.range(5, 125, 5).select(F.col("id").cast("int").alias("n"))
    p = spark.createDataFrame([(x,) for x in (0.70, 0.75, 0.80, 0.85, 0.90, 0.95)], "p double")
    a = spark.createDataFrame([(0.70, 0.05), (0.70, 0.0125), (0.5, 0.05)], "threshold double, alpha double")
    return _rounded(gates.power(n.join(p).join(a)), "power").select("n", "p", "threshold", "alpha", F.col("k").cast("long").alias("k"), "power")


def mcnemar_power(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.createDataFrame([(n, a, b, 0.05) for n in (20, 40, 60) for a, b in ((0.05, 0.2), (0.1, 0.3), (0.0, 0.15))], "n int, p01 double, p10 double, alpha double")
    return _rounded(gates.mcnemar_power(grid), "power")


def holm_alphas(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(1, 11).select(F.col("id").alias("m"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("id"))).alias("rank"))
    return grid.select("m", "rank", F.round(S.holm_alpha(F.lit(0.05), F.col("m"), F.col("rank")), 8).alias("alpha"))


def n_effective(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("m"))
    each = by.select("conv_id", "m", F.explode(F.array(F.lit(0.0), F.lit(0.3), F.lit(0.5), F.lit(1.0))).alias("icc"))
    return each.select("conv_id", "m", "icc", F.round(S.effective_n(F.col("m"), F.col("m"), F.col("icc")), 6).alias("n_effective"))


def rater_kappa(spark: SparkSession, d: str) -> DataFrame:
    df = _labelled(spark, d).select(F.col("quality").alias("a"), (X.word_count("text") > 60).cast("int").alias("b"))
    return _rounded(gates.kappa(df, "a", "b"), "po", "pe", "kappa")


def length_rule_supremum(spark: SparkSession, d: str) -> DataFrame:
    """The best of all rules that choose by length difference, by conversation's first word."""
    turns = table(spark, d, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.length("text").alias("u"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("a"))
    df = user.join(reply, ["conv_id", "turn"]).select(F.pmod("conv_id", F.lit(4)).alias("stratum"), (F.col("u") - F.col("a")).alias("d"))
    by = df.groupBy("stratum", F.abs("d").alias("m")).agg(F.count_if(F.col("d") > 0).alias("p"), F.count_if(F.col("d") < 0).alias("q"), F.count("*").alias("k"))
    best = by.groupBy("stratum").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("m") > 0, F.greatest("p", "q")).otherwise(0)).alias("hits"))
    return best.select("stratum", "n", F.round(F.col("hits") / F.col("n"), 6).alias("supremum"))


FEATURES = {
    "n_words": ("form", X.word_count),
    "n_sentences": ("form", lambda c: F.length(c) - F.length(F.regexp_replace(c, "[.!?]", ""))),
    "has_question": ("form", lambda c: F.contains(c, F.lit("?")).cast("int")),
    "ends_in_question": ("form", lambda c: F.rtrim(c).endswith("?").cast("int")),
    "n_commas": ("form", lambda c: X.occurrences(c, ",")),
    "n_digits": ("form", lambda c: F.length(c) - F.length(F.regexp_replace(c, r"\p{Nd}", ""))),
    "n_the": ("content", lambda c: X.occurrences(F.lower(c), "the")),
    "n_marks": ("form", lambda c: X.occurrences(c, "$$$")),
}


def _features(spark: SparkSession, d: str) -> DataFrame:
    """One row for each text and rule, unpivoted where the text is."""
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), f(F.col("text")).cast("long").alias("value")) for n, (_, f) in FEATURES.items()))
    df = _labelled(spark, d).select("lang", (F.col("quality") == 1).alias("target"), F.explode(rules).alias("r"))
    return df.select("lang", "target", "r.rule", "r.value")


def best_cut(spark: SparkSession, d: str) -> DataFrame:
    out = gates.best_cut(_features(spark, d), "rule", "value", F.col("target"), groups=["lang"])
    return _rounded(out, "accuracy")


def cut_transfer(spark: SparkSession, d: str) -> DataFrame:
    df = _features(spark, d)
    cuts = gates.best_cut(df.where("lang = 'en'"), "rule", "value", F.col("target"))
    out = gates.apply_cut(df.where("lang <> 'en'").select("rule", "value", "target"), cuts, "rule", "value", F.col("target"))
    return _rounded(out, "transfer")


def group_direction(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive turns of a conversation as two phrasings: which is longer, and by what ratio."""
    by = table(spark, d, "conversations").select("conv_id", "turn", X.word_count("text").alias("w"))
    p = by.where("turn in (0, 1)").groupBy("conv_id").pivot("turn", [0, 1]).agg(F.first("w"))
    p = p.where("`0` is not null and `1` is not null").select(F.pmod("conv_id", F.lit(5)).alias("stratum"), F.col("0").alias("a"), F.col("1").alias("b"))
    ratio = F.greatest("a", "b") / F.greatest(F.least("a", "b"), F.lit(1))
    return p.groupBy("stratum").agg(
        F.count_if(F.col("a") > F.col("b")).alias("b"), F.count_if(F.col("a") < F.col("b")).alias("c"), F.count_if(F.col("a") == F.col("b")).alias("ties"),
        F.count_if(ratio > 1.30 + 1e-9).alias("over_ratio"), (F.abs(F.count_if(F.col("a") > F.col("b")) - F.count_if(F.col("a") < F.col("b"))) > 1).alias("unbalanced"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        winrate_gate, mcnemar_quality_toxic, transition_gate, tost_coincidence, non_inferiority_seeded, majority_vote_user, categorical_inversion,
        power_table, mcnemar_power, holm_alphas, n_effective, rater_kappa, length_rule_supremum, best_cut, cut_transfer, group_direction,
    )
}

_LC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
_TERM = "exp(" + _LC + " + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"
_L = "labelled AS (SELECT * FROM labels JOIN documents USING (doc_id))"
_CP = """
kn AS (SELECT DISTINCT k, n FROM g),
bi AS (
  SELECT k, n, 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2 FROM kn
  UNION ALL
  SELECT k, n, i + 1, CASE WHEN s1 < 0.025 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN s1 < 0.025 THEN hi ELSE (lo + hi) / 2 END,
    CASE WHEN 1 - s2 > 0.025 THEN (lo2 + hi2) / 2 ELSE lo2 END, CASE WHEN 1 - s2 > 0.025 THEN hi2 ELSE (lo2 + hi2) / 2 END
  FROM (SELECT *, list_sum(list_transform(range(greatest(k, 1), n + 1), lambda j: """ + _TERM.format(n="n", k="j", p="((lo + hi) / 2)") + """)) AS s1,
    coalesce(list_sum(list_transform(range(k + 1, n + 1), lambda j: """ + _TERM.format(n="n", k="j", p="((lo2 + hi2) / 2)") + """)), 0) AS s2 FROM bi) WHERE i < 40),
ci AS (SELECT k, n, CASE WHEN k = 0 THEN 0.0 ELSE (lo + hi) / 2 END AS lo, CASE WHEN k = n THEN 1.0 ELSE (lo2 + hi2) / 2 END AS hi FROM bi WHERE i = 40)"""
_TAIL = "coalesce(list_sum(list_transform(range({k}, {n} + 1), lambda j: " + _LC.format(n="({n})", k="j").join(("exp(", " + ({n}) * ln(0.5))")) + ")), 0.0)"
_FEATURES = r"""
f AS (SELECT lang, quality = 1 AS target, r.rule, CAST(r.value AS BIGINT) AS value FROM (SELECT lang, quality, unnest([
  {'rule': 'n_words', 'value': len(regexp_extract_all(text, '\S+'))}, {'rule': 'n_sentences', 'value': len(regexp_extract_all(text, '[.!?]'))},
  {'rule': 'has_question', 'value': CAST(contains(text, '?') AS BIGINT)}, {'rule': 'ends_in_question', 'value': CAST(ends_with(rtrim(text), '?') AS BIGINT)},
  {'rule': 'n_commas', 'value': len(regexp_extract_all(text, ','))}, {'rule': 'n_digits', 'value': len(regexp_extract_all(text, '\p{Nd}'))},
  {'rule': 'n_the', 'value': (length(text) - length(replace(lower(text), 'the', ''))) // 3}, {'rule': 'n_marks', 'value': (length(text) - length(replace(text, '$$$', ''))) // 3}]) AS r FROM labelled))"""
_CUTS = """
v AS (SELECT {g} rule, value, count(*) FILTER (WHERE target) AS a, count(*) FILTER (WHERE NOT target) AS b FROM {src} GROUP BY ALL),
c AS (SELECT *, lead(value) OVER w AS nxt, sum(a) OVER p AS aa, sum(b) OVER p AS bb, sum(a) OVER w AS la, sum(b) OVER w AS lb, row_number() OVER w AS r FROM v
  WINDOW p AS (PARTITION BY {g} rule), w AS (PARTITION BY {g} rule ORDER BY value)),
o AS (SELECT {g} rule, value - 1.0 AS cut, aa AS hits, aa + bb AS n FROM c WHERE r = 1 UNION ALL SELECT {g} rule, (value + nxt) / 2.0, aa - la + lb, aa + bb FROM c WHERE nxt IS NOT NULL),
e AS (SELECT {g} rule, hits / n AS accuracy, cut, 'a>c' AS direction FROM o UNION ALL SELECT {g} rule, (n - hits) / n, cut, 'a<=c' FROM o),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g} rule ORDER BY round(accuracy, 12) DESC, cut, direction DESC) AS r FROM e) WHERE r = 1)"""
ORACLE_SQL = {
    "winrate_gate": f"""WITH RECURSIVE {_L}, g AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS k FROM labelled GROUP BY ROLLUP (lang)), {_CP}
SELECT lang, g.n, g.k, round(g.k / g.n, 6) AS rate, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0.5 AS beats_null, lo >= 0.7 AS strong, g.k / g.n > 0.8 AS ceiling FROM g JOIN ci ON g.k = ci.k AND g.n = ci.n""",
    "mcnemar_quality_toxic": f"""WITH {_L}, g AS (SELECT lang, count(*) AS n, avg(CAST(quality = 1 AS INT)) AS acc_on, avg(CAST(toxic = 0 AS INT)) AS acc_off,
  count(*) FILTER (WHERE toxic = 0 AND quality <> 1) AS b, count(*) FILTER (WHERE toxic <> 0 AND quality = 1) AS c FROM labelled GROUP BY lang)
SELECT lang, n, round(acc_on, 6) AS acc_on, round(acc_off, 6) AS acc_off, round(acc_off - acc_on, 6) AS drop, b, c,
  round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * {_TAIL.format(k='greatest(b, c)', n='b + c')}) END, 6) AS mcnemar_p FROM g""",
    "transition_gate": rf"""WITH {_L}, s AS (SELECT lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'CONS' WHEN quality = 0 THEN 'VIOL' ELSE 'POS' END AS a,
  CASE WHEN len(regexp_extract_all(text, '\S+')) > 400 THEN 'CONS' WHEN len(regexp_extract_all(text, '\S+')) < 100 THEN 'VIOL' ELSE 'POS' END AS b FROM labelled),
g AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE a = 'CONS' AND b <> 'CONS') AS pro, count(*) FILTER (WHERE a = 'VIOL' AND b <> 'VIOL') AS contra, count(*) FILTER (WHERE a <> 'CONS' AND b = 'CONS') AS c FROM s GROUP BY lang),
p AS (SELECT *, pro AS b, CASE WHEN pro + contra = 0 THEN 1.0 ELSE {_TAIL.format(k='pro', n='pro + contra')} END AS p1, CASE WHEN pro + c = 0 THEN 1.0 ELSE {_TAIL.format(k='pro', n='pro + c')} END AS p2 FROM g)
SELECT lang, n, pro, contra, c, b, round(p1, 6) AS p_direction, round(p2, 6) AS p_mcnemar, p1 <= 0.05 AND p2 <= 0.05 AS gate FROM p""",
    "majority_vote_user": "SELECT user_id, coalesce(2 * count(*) FILTER (WHERE value > 50) > count(value), FALSE) AS majority, count(*) AS n, count(*) FILTER (WHERE value > 50) AS k FROM events GROUP BY user_id",
    "categorical_inversion": """SELECT o_orderpriority AS category, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS "on", round(avg(CAST(o_totalprice > 20000 AS INT)), 6) AS off,
  avg(CAST(o_totalprice > 20000 AS INT)) >= 0.8 AND avg(CAST(o_orderstatus = 'F' AS INT)) <= 0.5 AS inverted FROM orders GROUP BY 1""",
    "power_table": f"""WITH grid AS (SELECT CAST(n AS INTEGER) AS n, p, threshold, alpha FROM range(5, 125, 5) r(n), (VALUES (0.70::DOUBLE), (0.75::DOUBLE), (0.80::DOUBLE), (0.85::DOUBLE), (0.90::DOUBLE), (0.95::DOUBLE)) q(p), (VALUES (0.70::DOUBLE, 0.05::DOUBLE), (0.70::DOUBLE, 0.0125::DOUBLE), (0.5::DOUBLE, 0.05::DOUBLE)) a(threshold, alpha)),
c AS (SELECT n, threshold, alpha, min(k) AS k FROM (SELECT DISTINCT n, threshold, alpha FROM grid) g, range(1, n + 1) r(k)
  WHERE list_sum(list_transform(range(k, n + 1), lambda j: {_TERM.format(n='n', k='j', p='threshold')})) < alpha / 2 GROUP BY ALL)
SELECT grid.n, p, grid.threshold, grid.alpha, k, round(CASE WHEN k IS NULL THEN 0.0 ELSE list_sum(list_transform(range(k, grid.n + 1), lambda j: {_TERM.format(n='grid.n', k='j', p='p')})) END, 6) AS power
FROM grid LEFT JOIN c ON c.n = grid.n AND c.threshold = grid.threshold AND c.alpha = grid.alpha""",
    "mcnemar_power": f"""WITH grid AS (SELECT CAST(n AS INTEGER) AS n, p01, p10, 0.05::DOUBLE AS alpha FROM (VALUES (20), (40), (60)) r(n), (VALUES (0.05::DOUBLE, 0.2::DOUBLE), (0.1::DOUBLE, 0.3::DOUBLE), (0.0::DOUBLE, 0.15::DOUBLE)) p(p01, p10)),
t AS (SELECT n, p01, p10, alpha, d, b, {_TERM.format(n='n', k='d', p='(p01 + p10)')} AS pr,
  CASE WHEN p01 = 0 THEN CAST(b = d AS DOUBLE) ELSE {_TERM.format(n='d', k='b', p='(p10 / (p01 + p10))')} END AS pb, least(1.0, 2 * {_TAIL.format(k='greatest(b, d - b)', n='d')}) AS pv
  FROM grid, range(1, n + 1) r(d), range(0, d + 1) s(b))
SELECT n, p01, p10, alpha, round(coalesce(sum(pr * pb) FILTER (WHERE pr >= 1e-12 AND pv <= alpha), 0), 6) AS power FROM t GROUP BY ALL""",
    "holm_alphas": "SELECT m, rank, round(0.05 / (m - rank + 1), 8) AS alpha FROM range(1, 11) a(m), range(1, m + 1) b(rank)",
    "n_effective": "SELECT conv_id, m, icc, round(m / (1 + (m - 1) * icc), 6) AS n_effective FROM (SELECT conv_id, count(*) AS m FROM conversations GROUP BY 1), (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(icc)",
    "rater_kappa": rf"""WITH {_L}, r AS (SELECT quality AS a, CAST(len(regexp_extract_all(text, '\S+')) > 60 AS INT) AS b FROM labelled),
k AS (SELECT count(*) AS n, avg(CAST(a = b AS INT)) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM r)
SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM k""",
    "length_rule_supremum": """WITH d AS (SELECT u.conv_id % 4 AS stratum, length(u.text) - length(a.text) AS d FROM conversations u JOIN conversations a ON u.role = 'user' AND a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1),
m AS (SELECT stratum, abs(d) AS m, count(*) FILTER (WHERE d > 0) AS p, count(*) FILTER (WHERE d < 0) AS q, count(*) AS k FROM d GROUP BY ALL)
SELECT stratum, CAST(sum(k) AS BIGINT) AS n, round(sum(CASE WHEN m > 0 THEN greatest(p, q) ELSE 0 END) / sum(k), 6) AS supremum FROM m GROUP BY stratum""",
    "best_cut": f"WITH {_L}, {_FEATURES}, {_CUTS.format(g='lang,', src='f')} SELECT lang, rule, round(accuracy, 6) AS accuracy, CAST(cut AS DOUBLE) AS cut, direction FROM best",
    "cut_transfer": f"""WITH {_L}, {_FEATURES}, {_CUTS.format(g='', src="(SELECT * FROM f WHERE lang = 'en')")}
SELECT f.rule, round(avg(CAST(CASE WHEN direction = 'a>c' THEN (value > cut) = target ELSE (value > cut) <> target END AS INT)), 6) AS transfer FROM f JOIN best USING (rule) WHERE lang <> 'en' GROUP BY f.rule""",
    "group_direction": r"""WITH w AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS w FROM conversations),
p AS (SELECT a.conv_id % 5 AS stratum, a.w AS a, b.w AS b FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1)
SELECT stratum, count(*) FILTER (WHERE a > b) AS b, count(*) FILTER (WHERE a < b) AS c, count(*) FILTER (WHERE a = b) AS ties,
  count(*) FILTER (WHERE greatest(a, b) / greatest(least(a, b), 1) > 1.3 + 1e-9) AS over_ratio, abs(count(*) FILTER (WHERE a > b) - count(*) FILTER (WHERE a < b)) > 1 AS unbalanced FROM p GROUP BY stratum""",
}
