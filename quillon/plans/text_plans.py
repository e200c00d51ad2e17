"""Queries over texts: measures, leakage, duplicates, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import text as X
from quillon.operators import duplicates, leakage
from quillon.sources.tables import table

#: Function words of the driver's languages, left out of content n-grams.
STOP = ("the", "of", "and", "to", "in", "a", "is", "de", "la", "le", "que", "der", "die", "und", "en", "el")

NORM = r"trim(regexp_replace(strip_accents(lower({c})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
CONTENT = (
    "list_filter(string_split(" + NORM + ", ' '), lambda t: t <> '' AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in STOP) + "], t))"
)


def norm(c: str) -> str:
    return NORM.format(c=c)


def content(c: str) -> str:
    return CONTENT.format(c=c)


def sql_grams(name: str, table_name: str, ident: str, sizes: tuple[int, ...], where: str = "TRUE") -> str:
    """SQL of ``grams``: distinct content n-grams of a table's rows."""
    values = ", ".join(f"({n})" for n in sizes)
    return f"""{name}_w AS (SELECT {ident} AS id, {content("text")} AS w FROM {table_name} WHERE {where}),
{name} AS (SELECT DISTINCT id, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM {name}_w, (VALUES {values}) v(n), range(1, greatest(len(w) - n + 2, 1)) r(i))"""


def norm_text(spark: SparkSession, d: str) -> DataFrame:
    key = X.normalize("text")
    return table(spark, d, "documents").select("doc_id", F.length(key).cast("long").alias("n_norm"), F.md5(key).alias("norm_md5"))


def text_measures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id",
        X.word_count("text").cast("long").alias("n_words"),
        F.round(X.digit_share("text"), 6).alias("digit_share"),
        X.register("text").alias("register"),
        X.occurrences("text", "the").cast("long").alias("n_the"),
        X.lacks_accents("text").alias("lacks_accents"),
        F.size(X.suspects("text", ("the", "de"))).cast("long").alias("n_suspects"),
        X.raw_mould("text").alias("raw_mould"),
        X.holds_word(X.normalize("text"), F.lit("of the")).alias("holds_of_the"),
    )


def parse_choice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", X.parse_choice("text").alias("choice"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    docs = leakage.grams(table(spark, d, "documents"), "doc_id", "text", (3, 4), stop=STOP)
    items = leakage.forbidden_grams(table(spark, d, "benchmark"), "item_id", "text", stop=STOP)
    return leakage.leaks(docs, items, "doc_id", "item_id")


def leak_ngram_hits(spark: SparkSession, d: str) -> DataFrame:
    found = _leaks(spark, d).groupBy("doc_id", "n")
    return found.agg(F.countDistinct("gram").alias("n_grams"), F.countDistinct("item_id").alias("n_items"))


_LEAK_SQL = f"WITH {sql_grams('dg', 'documents', 'doc_id', (3, 4))}, {sql_grams('bg', 'benchmark', 'item_id', (3, 4))}"


def leak_by_source_rollup(spark: SparkSession, d: str) -> DataFrame:
    leaky = _leaks(spark, d).select("doc_id").distinct().withColumn("leak", F.lit(1))
    docs = table(spark, d, "documents").select("doc_id", "lang", "source").join(leaky, "doc_id", "left")
    return docs.rollup("lang", "source").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("leak", F.lit(0))).alias("n_leaky"),
        F.round(F.avg(F.coalesce("leak", F.lit(0)).cast("double")), 6).alias("rate"),
    )


def declared_window_exempt(spark: SparkSession, d: str) -> DataFrame:
    declared = leakage.grams(
        table(spark, d, "conversations").where("role = 'system'").select(F.col("conv_id").alias("id"), "text"), "id", "text", (3, 4), stop=STOP
    )
    left = leakage.exempt(_leaks(spark, d), declared)
    return left.groupBy("doc_id").agg(F.countDistinct("n", "gram").alias("n_grams"))


def longest_leak(spark: SparkSession, d: str) -> DataFrame:
    docs = leakage.grams(table(spark, d, "documents"), "doc_id", "text", (3, 4, 6, 8, 13), stop=STOP)
    items = leakage.grams(table(spark, d, "benchmark"), "item_id", "text", (3, 4, 6, 8, 13), stop=STOP)
    return leakage.longest_shared(docs, items, "doc_id", "item_id")


def dup_exact_norm(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return duplicates.duplicates_of(docs, F.sha2(X.normalize("text"), 256), "doc_id").select("doc_id", "first_id")


def dup_cross_table(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    a, b = turns.where("role = 'user'"), turns.where("role = 'system'")
    return duplicates.shared_keys(a, b, X.normalize("text"), "left_anti").select("conv_id", "turn")


def dup_across_roles(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return duplicates.duplicates_of(turns.withColumn("at", F.col("conv_id") * 1000 + F.col("turn")), X.normalize("text"), "at").select("at", "first_id")


def prefix80_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return duplicates.first_by_prefix(docs, "source", "text", "doc_id").select("doc_id", "source")


def jaccard_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    found = duplicates.similar_pairs(docs, id_col="doc_id", text_col="text", group_col="source")
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


def jaccard_set_classes(spark: SparkSession, d: str) -> DataFrame:
    """The membership beside :func:`jaccard_near_pairs`: each document and the one that stands for its set."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return duplicates.set_classes(docs, id_col="doc_id", text_col="text", group_col="source")


def nearest_neighbour_jaccard(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'user'")
    turns = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "text")
    found = duplicates.neighbours(turns, id_col="id", text_col="text", cluster_col="conv_id")
    return found.select("id", F.round("best_same", 6).alias("best_same"), F.round("best_other", 6).alias("best_other"), "accused")


def copy_6gram_pairs(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.copied_pairs(table(spark, d, "conversations"), cluster_col="conv_id", order_col="turn", text_col="text")


def template_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", X.mould("text").alias("mould"))
    by = docs.groupBy("lang", "mould").agg(F.count("*").alias("n"))
    out = by.groupBy("lang").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("moulds"))
    top, distinct = F.col("top") / F.col("n"), F.col("moulds") / F.col("n")
    return out.select(
        "lang", "n", "top", "moulds", F.round(top, 6).alias("top_share"),
        (top > L.MOULD_FRACTION + 1e-9).alias("over_fraction"), (F.col("top") > L.MOULD_CLUSTERS).alias("over_count"),
        (distinct < L.MOULD_DISTINCT - 1e-9).alias("under_distinct"),
    )


def name_scrub(spark: SparkSession, d: str) -> DataFrame:
    names = ("the", "Und", "señor", "Thnt")
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.col("text").rlike(X.names_pattern(names)).alias("named"), F.md5(X.scrub("text", names)).alias("masked_md5"))


def html_network_refs(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace("html", r"(?is)<pre\b.*?</pre>", "")
    return table(spark, d, "pages").select(
        "page_id",
        bare.rlike(r"(?i)(?:src|href)\s*=\s*[\"']?(?:https?:)?//").alias("links_out"),
        bare.rlike(r"(?i)<script\b").alias("has_script"),
        F.size(F.regexp_extract_all(bare, F.lit(r"(?i)(href\s*=)"), F.lit(1))).cast("long").alias("n_hrefs"),
    )


def front_matter_map(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("---\nurl: "), "url", F.lit("\npage: "), F.col("page_id").cast("string"), F.lit("\nurl: last:"), F.col("page_id").cast("string"), F.lit("\nplain\n---\n\nBody "), F.col("page_id").cast("string"))
    pages = table(spark, d, "pages").select("page_id", X.front_matter(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(head)).alias("m"))
    return pages.select("page_id", F.col("m.meta")["url"].alias("url"), F.col("m.meta")["page"].alias("page"), F.size("m.meta").cast("long").alias("n_keys"), "m.body")


def envelope_strip(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit("Title\n*** START OF X ***"), "text", F.lit("*** END OF X *** licence"))
    docs = table(spark, d, "documents").select("doc_id", "text", X.strip_envelope(F.when(F.col("doc_id") % 2 == 0, wrapped).otherwise(F.col("text"))).alias("e"))
    return docs.select("doc_id", F.length("e.header").cast("long").alias("n_header"), (F.col("e.body") == F.col("text")).alias("same_body"))


def cited_quantities(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("Há "), (F.col("turn") % 12).cast("string"), F.lit(" anos e três da manhã, vinte e dois dias. "), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.quantities(made), "|").alias("quantities"))


_JACCARD_SQL = f"""
WITH s AS (SELECT doc_id AS id, source AS g, list_sort(list_distinct({content('text')})) AS w FROM documents),
c AS (SELECT g, w, min(id) AS id FROM s WHERE len(w) > 0 GROUP BY g, w),
t AS (SELECT g, id, len(w) AS n, unnest(w) AS t FROM c),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM t a JOIN t b ON a.g = b.g AND a.t = b.t AND a.id < b.id GROUP BY ALL)
SELECT a, b, round(i / (na + nb - i), 6) AS similarity FROM p WHERE i / (na + nb - i) >= 0.8"""

QUERIES = {
    f.__name__: f
    for f in (
        norm_text, text_measures, parse_choice, leak_ngram_hits, leak_by_source_rollup, declared_window_exempt, longest_leak,
        dup_exact_norm, dup_cross_table, dup_across_roles, prefix80_dedup, jaccard_near_pairs, jaccard_set_classes, nearest_neighbour_jaccard,
        copy_6gram_pairs, template_share, name_scrub, html_network_refs, front_matter_map, envelope_strip, cited_quantities,
    )
}

_ALL_CONTENT = "list_filter(string_split(" + norm("text") + ", ' '), lambda t: t <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in L.STOPWORDS) + "], t))"

ORACLE_SQL = {
    "norm_text": f"SELECT doc_id, CAST(length({norm('text')}) AS BIGINT) AS n_norm, md5({norm('text')}) AS norm_md5 FROM documents",
    "text_measures": rf"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words,
  round(CASE WHEN length(text) = 0 THEN 1.0 ELSE len(regexp_extract_all(text, '\p{{Nd}}')) / length(text) END, 6) AS digit_share,
  CASE WHEN len(regexp_extract_all(text, '\?')) >= 2 THEN 'dialogico' ELSE 'argumentativo' END AS register,
  CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n_the,
  len(list_filter(regexp_extract_all(text, '\S+'), lambda t: regexp_matches(t, '\p{{L}}'))) >= 15 AND NOT regexp_matches(text, '[À-ÖØ-öø-ÿ]') AS lacks_accents,
  CAST(len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_'']+'), lambda t: lower(t) IN ('the', 'de')))
   + len(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])(?:{"|".join(L.APOSTROPHE_WORDS)})''(?:\s|$|[.,;:!?)\]])')) AS BIGINT) AS n_suspects,
  array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')[1:3], ' ') AS raw_mould,
  contains(' ' || {norm('text')} || ' ', ' of the ') AS holds_of_the
FROM documents""",
    "parse_choice": r"""
WITH h AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(array_to_string(regexp_extract_all(text, '\S+')[1:8], ' '), '\b([12])\b', 1)) AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN len(c) = 1 THEN c[1] END AS choice FROM h""",
    "leak_ngram_hits": f"{_LEAK_SQL} SELECT dg.id AS doc_id, CAST(n AS INTEGER) AS n, count(DISTINCT gram) AS n_grams, count(DISTINCT bg.id) AS n_items FROM dg JOIN bg USING (n, gram) GROUP BY dg.id, n",
    "leak_by_source_rollup": f"""{_LEAK_SQL}, l AS (SELECT DISTINCT dg.id FROM dg JOIN bg USING (n, gram))
SELECT lang, source, count(*) AS n, CAST(count(l.id) AS BIGINT) AS n_leaky, round(count(l.id) / count(*), 6) AS rate
FROM documents LEFT JOIN l ON l.id = doc_id GROUP BY ROLLUP (lang, source)""",
    "declared_window_exempt": f"""{_LEAK_SQL}, {sql_grams('cg', 'conversations', 'conv_id', (3, 4), "role = 'system'")}
SELECT dg.id AS doc_id, count(DISTINCT (n, gram)) AS n_grams FROM dg JOIN bg USING (n, gram)
WHERE NOT EXISTS (SELECT 1 FROM cg WHERE cg.n = dg.n AND cg.gram = dg.gram) GROUP BY dg.id""",
    "longest_leak": f"WITH {sql_grams('dg', 'documents', 'doc_id', (3, 4, 6, 8, 13))}, {sql_grams('bg', 'benchmark', 'item_id', (3, 4, 6, 8, 13))} SELECT dg.id AS doc_id, CAST(max(n) AS INTEGER) AS longest FROM dg JOIN bg USING (n, gram) GROUP BY dg.id",
    "dup_exact_norm": f"""SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {norm('text')}) AS first_id FROM documents) WHERE doc_id > first_id""",
    "dup_cross_table": f"""SELECT conv_id, turn FROM conversations WHERE role = 'user' AND {norm('text')} NOT IN (SELECT {norm('text')} FROM conversations WHERE role = 'system')""",
    "dup_across_roles": f"""SELECT "at", first_id FROM (SELECT conv_id * 1000 + turn AS "at", min(conv_id * 1000 + turn) OVER (PARTITION BY {norm('text')}) AS first_id FROM conversations) WHERE "at" > first_id""",
    "prefix80_dedup": f"""SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, substr({norm('text')}, 1, 80)""",
    "jaccard_near_pairs": _JACCARD_SQL.replace(content("text"), _ALL_CONTENT),
    "nearest_neighbour_jaccard": f"""
WITH s AS (SELECT conv_id * 1000 + turn AS id, conv_id AS c, list_distinct({_ALL_CONTENT}) AS w FROM conversations WHERE role = 'user'),
p AS (SELECT a.id, a.c = b.c AS own, CASE WHEN len(a.w) + len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END AS sim FROM s a JOIN s b ON a.id <> b.id),
m AS (SELECT id, coalesce(max(sim) FILTER (WHERE own), -1.0) AS same, coalesce(max(sim) FILTER (WHERE NOT own), -1.0) AS other FROM p GROUP BY id)
SELECT s.id, round(coalesce(same, -1.0), 6) AS best_same, round(coalesce(other, -1.0), 6) AS best_other, coalesce(other, -1.0) > coalesce(same, -1.0) AS accused FROM s LEFT JOIN m USING (id)""",
    "copy_6gram_pairs": f"""
WITH w AS (SELECT conv_id, turn, {_ALL_CONTENT} AS w FROM conversations),
g AS (SELECT DISTINCT conv_id, turn, array_to_string(w[i : i + 5], ' ') AS gram FROM w, range(1, greatest(len(w) - 4, 1)) r(i))
SELECT a.conv_id, a.turn AS a, b.turn AS b, count(*) AS n_shared FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.gram = b.gram AND a.turn < b.turn GROUP BY ALL""",
    "template_share": f"""
WITH m AS (SELECT lang, array_to_string(list_filter(string_split({norm('text')}, ' '), lambda t: t <> '')[1:3], ' ') AS mould FROM documents),
c AS (SELECT lang, mould, count(*) AS n FROM m GROUP BY ALL)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, max(n) AS top, count(*) AS moulds, round(max(n) / sum(n), 6) AS top_share,
  max(n) / sum(n) > 0.15 + 1e-9 AS over_fraction, max(n) > 7 AS over_count, count(*) / sum(n) < 0.6 - 1e-9 AS under_distinct FROM c GROUP BY lang""",
    "name_scrub": r"""
SELECT doc_id, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(the|und|señor|thnt)($|[^\p{L}\p{N}_])') AS named,
  md5(array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda t: CASE WHEN lower(t) IN ('the', 'und', 'señor', 'thnt') THEN '[X]' ELSE t END), '')) AS masked_md5
FROM documents""",
    "html_network_refs": r"""
WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<pre\b.*?</pre>', '', 'g') AS h FROM pages)
SELECT page_id, regexp_matches(h, '(?i)(?:src|href)\s*=\s*["'']?(?:https?:)?//') AS links_out, regexp_matches(h, '(?i)<script\b') AS has_script,
  CAST(len(regexp_extract_all(h, '(?i)href\s*=')) AS BIGINT) AS n_hrefs FROM b""",
    "front_matter_map": """
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'last:' || page_id END AS url, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id AS VARCHAR) END AS page,
  CAST(CASE WHEN page_id % 3 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS n_keys, CASE WHEN page_id % 3 <> 0 THEN 'Body ' || page_id ELSE url END AS body FROM pages""",
    "envelope_strip": "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 6 ELSE least(3000, length(text)) END AS BIGINT) AS n_header, TRUE AS same_body FROM documents",
    "cited_quantities": rf"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(trim(regexp_replace(strip_accents(lower('Há ' || CAST(turn % 12 AS VARCHAR) || ' anos e três da manhã, vinte e dois dias. ' || text)), '[^\p{{L}}\p{{N}}]+', ' ', 'g')),
 '(?:^| )((?:{"|".join(L.NUMBER_WORDS)}|\d{{1,4}})(?:\s+(?:da|de|do|em)?\s*)?(?:{"|".join(L.UNITS)}))\b', 1), lambda t: t))), '|') AS quantities FROM conversations""",
}
