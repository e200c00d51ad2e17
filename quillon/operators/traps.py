"""Quality gates of item banks: each returns accusations as rows, none of them raises.

A bank is a table of items with a ``run_id``, so that several banks (and the rows that a positive
control plants) go through one plan and never meet in an aggregate. A gate gives
``(run_id, item_id, clause, detail)``; :func:`run` adds the name of the trap and a status.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import text as X

ITEM = (
    "run_id string, item_id string, banco string, cluster_id string, paraphrase_idx int, prompt string, faceta_alvo string, "
    "forma_convocacao string, generator string, turnos array<string>, movimento_alvo string, direcao_f4 string, dominio_sensivel string, "
    "tipo_ataque string, persona_concorrente string, par_id string, construto string, lexico_do_usuario array<string>, familia_de_cenario string"
)
PAIR = "run_id string, item_id string, contexto string, op_consistente string, op_violadora string, intensificador_em string, invariante string, polo string"
BANK = "(banco)"
#: What joins the turns of an item into its prompt.
TURN_SEPARATOR = "\n\n"

# Closed domains of an item's labels.
FACETS = ("F1", "F2", "F4")
F4_DIRECTIONS = ("deve_recusar", "legitimo")
FORMS = ("pergunta_direta", "relato", "ordem")
ATTACKS = ("ordem_direta", "persona_concorrente", "escalada_socratica", "distrator_longo")
SHARED_BANKS = ("shared", "hijack")
SAME_IN_CLUSTER = (
    "banco", "faceta_alvo", "movimento_alvo", "direcao_f4", "dominio_sensivel", "tipo_ataque",
    "forma_convocacao", "par_id", "construto", "familia_de_cenario",
)


@dataclass
class Params:
    """What a bank is judged against."""

    movements: Mapping[str, Sequence[str]] = field(default_factory=dict)  #: of each persona bank
    names: Sequence[str] = ()  #: to be scrubbed
    terms: Mapping[str, Sequence[str]] = field(default_factory=dict)  #: forbidden, by origin
    sources: DataFrame | None = None  #: ``(owner, text)`` that items must not repeat
    others: DataFrame | None = None  #: items of other banks: ``(name, item_id, prompt)``
    pilots: DataFrame | None = None  #: ``(name, prompt)`` used before
    files: DataFrame | None = None  #: ``(run_id, name)`` of battery files
    size: Callable[[Column], Column] | None = None  #: tokens of a text; no words in their place
    stop: Sequence[str] = L.STOPWORDS

    def banks(self) -> tuple[str, ...]:
        return (*self.movements, *SHARED_BANKS)


def _given(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def _rows(df: DataFrame, clause: str | Column, detail: Column | str = "", item: str | Column = "item_id") -> DataFrame:
    c = F.lit(clause) if isinstance(clause, str) else clause
    i = F.col(item) if isinstance(item, str) else item
    d = F.lit(detail) if isinstance(detail, str) else detail
    return df.select("run_id", i.alias("item_id"), c.alias("clause"), d.cast("string").alias("detail"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _where(df: DataFrame, *tests: tuple[Column, str, Column | str]) -> DataFrame:
    """Accusations of many tests of a row in one pass: a row is exploded to those that hold."""
    made = F.array(*(
        F.when(test, F.struct(F.lit(clause).alias("clause"), (F.lit(d) if isinstance(d, str) else d).cast("string").alias("detail")))
        for test, clause, d in tests
    ))
    return df.select("run_id", "item_id", F.explode(F.array_compact(made)).alias("a")).select("run_id", "item_id", "a.clause", "a.detail")


def texts(bank: DataFrame) -> DataFrame:
    """``bank`` with a row for each text that is read: ``place`` (prompt, turnos[i]) and ``text``."""
    turns = F.transform(F.coalesce("turnos", F.array().cast("array<string>")), lambda t, i: F.struct(F.concat(F.lit("turnos["), i.cast("string"), F.lit("]")).alias("place"), t.alias("text")))
    each = F.concat(F.array(F.struct(F.lit("prompt").alias("place"), F.coalesce("prompt", F.lit("")).alias("text"))), turns)
    return bank.withColumn("__t", F.explode(each)).select("*", "__t.place", "__t.text").drop("__t")


def clusters(bank: DataFrame) -> DataFrame:
    """One row a cluster: its size, indices and first member."""
    first = F.min_by(F.struct(*SAME_IN_CLUSTER, "prompt", "turnos"), F.struct("paraphrase_idx", "item_id"))
    return bank.groupBy("run_id", "cluster_id").agg(
        F.count("*").alias("m"), F.array_sort(F.collect_list("paraphrase_idx")).alias("idx"), first.alias("ref"), F.min(F.struct("paraphrase_idx", "item_id"))["item_id"].alias("ref_id")
    )


def _term_hits(df: DataFrame, terms: Sequence[str], raw: bool = False) -> Column:
    """The distinct terms that ``text`` has, by whole words (stems by their start)."""
    keys = [t if t in L.STEMS or raw else X.normalize_python(t) for t in terms]
    subject = F.col("text") if raw else X.normalize("text")
    made = [F.when(subject.rlike(X.whole_word_pattern([k], L.STEMS)), F.lit(t)) for k, t in zip(keys, terms, strict=True) if k]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")


# --- banks of free production ----------------------------------------------------------------------


def schema(bank: DataFrame, p: Params) -> DataFrame:
    f4, hijack = F.col("faceta_alvo") == "F4", F.col("banco") == "hijack"
    persona = F.col("banco").isin(*p.movements) if p.movements else F.lit(False)
    out = lambda c, dom: ~F.coalesce(F.col(c), F.lit("")).isin(*dom)
    turns = F.size(F.coalesce("turnos", F.array().cast("array<string>"))) > 0
    known = F.lit(False)
    for b, ms in p.movements.items():
        known = known | ((F.col("banco") == b) & F.col("movimento_alvo").isin(*ms))
    tests = [
        (~F.coalesce(F.col("cluster_id"), F.lit("")).rlike("^[a-z0-9_]+$"), "schema:cluster_id", F.col("cluster_id")),
        (out("banco", p.banks()), "schema:banco", F.col("banco")),
        (out("faceta_alvo", FACETS), "schema:faceta_alvo", F.col("faceta_alvo")),
        (out("forma_convocacao", FORMS), "schema:forma_convocacao", F.col("forma_convocacao")),
        (_given("direcao_f4") & out("direcao_f4", F4_DIRECTIONS), "schema:direcao_f4", F.col("direcao_f4")),
        (_given("tipo_ataque") & out("tipo_ataque", ATTACKS), "schema:tipo_ataque", F.col("tipo_ataque")),
        (hijack & ~_given("tipo_ataque"), "schema:tipo_ataque_ausente_em_hijack", ""),
        (hijack & ~turns, "schema:turnos_ausentes_em_hijack", ""),
        (~hijack & _given("tipo_ataque"), "schema:tipo_ataque_fora_de_hijack", F.col("tipo_ataque")),
        (~hijack & turns, "schema:turnos_fora_de_hijack", ""),
        (persona & ~_given("movimento_alvo"), "schema:movimento_ausente", F.col("banco")),
        (persona & _given("movimento_alvo") & ~known, "schema:movimento_inexistente", F.col("movimento_alvo")),
        (~persona & _given("movimento_alvo"), "schema:movimento_fora_do_banco_de_persona", F.col("movimento_alvo")),
        (_given("persona_concorrente") & (F.coalesce("tipo_ataque", F.lit("")) != "persona_concorrente"), "schema:persona_concorrente_fora_do_tipo", F.col("tipo_ataque")),
    ]
    for c in ("direcao_f4", "dominio_sensivel"):
        tests += [(f4 & ~_given(c), f"schema:{c}_ausente_em_F4", ""), (~f4 & _given(c), f"schema:{c}_fora_de_F4", F.col(c))]
    n = F.size(X.content_tokens("text", p.stop))
    floor = _where(
        texts(bank), (F.trim("text") == "", "schema:texto_vazio", F.col("place")),
        ((F.trim("text") != "") & (n < L.CONTENT_FLOOR), "schema:piso_de_conteudo", F.concat_ws(": ", "place", n.cast("string"))),
    )
    again = bank.groupBy("run_id", "item_id").agg(F.count("*").alias("n")).where("n > 1")
    again = again.select("run_id", "item_id", F.explode(F.expr("sequence(2L, n)")))
    mixed = bank.groupBy("run_id").agg(F.array_sort(F.collect_set("banco")).alias("banco"), F.array_sort(F.collect_set("generator")).alias("generator"))
    mixes = [_rows(mixed.where(F.size(c) > 1), f"schema:{c}_misturado", F.array_join(c, ","), F.lit(BANK)) for c in ("banco", "generator")]
    return _all(_where(bank, *tests), floor, _rows(again, "schema:item_id_repetido", F.col("item_id")), *mixes)


def lexicon(bank: DataFrame, p: Params) -> DataFrame:
    parts = []
    for origin, terms in {**p.terms, "influencias_nao_citadas": L.UNCITED_INFLUENCES, "tecnico_congelado": L.FROZEN_TECHNICAL}.items():
        hits = texts(bank).select("run_id", "item_id", "place", F.explode(_term_hits(bank, terms)).alias("term"))
        parts.append(_rows(hits, f"lexico:{origin}", F.concat_ws(": ", "place", "term")))
    return _all(*parts)


def derived_terms(core: Mapping) -> list[str]:
    """Terms of a persona core: movements, ids and names of values, and the name."""
    found = [m.replace("_", " ") for m in core.get("movimentos", [])] + [core.get("nome", "")]
    for v in core.get("valores_tracos", []):
        found += [str(v.get("id", "")).replace("_", " "), str(v.get("nome", ""))]
    return sorted({t for t in map(X.normalize_python, found) if t})


def leak(bank: DataFrame, p: Params) -> DataFrame:
    """N-grams of three and four content words shared with a source, but those that the item declares;
    and declared expressions that the item hasn't."""
    from quillon.operators import leakage

    t = texts(bank).withColumn("w", X.content_tokens("text", p.stop))
    each = F.array(*(F.struct(F.lit(n).alias("n"), X.ngrams("w", n).alias("g")) for n in range(L.LEAK_FLOOR, L.LEAK_N + 1)))
    own = t.select("run_id", "item_id", "banco", "place", F.explode(each).alias("s")).select("run_id", "item_id", "banco", "place", "s.n", F.explode("s.g").alias("gram"))
    bad = leakage.forbidden_grams(p.sources, "owner", "text", stop=p.stop)
    hits = own.join(bad, ["n", "gram"])
    said = bank.select("run_id", "item_id", F.explode("lexico_do_usuario").alias("e"))
    words = said.select("run_id", "item_id", "e", X.content_tokens("e", p.stop).alias("w"))
    wide = F.array(*(F.struct(F.lit(n).alias("n"), X.ngrams("w", n).alias("g")) for n in range(L.LEAK_FLOOR, L.LEAK_N + 1)))
    free = words.select("run_id", "item_id", F.explode(wide).alias("s")).select("run_id", "item_id", "s.n", F.explode("s.g").alias("gram")).distinct()
    hits = hits.join(free, ["run_id", "item_id", "n", "gram"], "left_anti")
    rival = F.col("banco").isin(*p.movements) & (F.col("owner") != F.col("banco")) if p.movements else F.lit(False)
    clause = F.when(rival, "leak:persona_rival").otherwise(F.concat(F.lit("leak:aridade_"), F.col("n").cast("string")))
    whole = t.groupBy("run_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("all"))
    hay = F.array_join(F.flatten(F.transform("all", lambda x: x["w"])), " ")
    absent = words.join(whole, ["run_id", "item_id"]).where((F.size("w") > 0) & ~F.contains(hay, F.array_join("w", " ")))
    return _all(_rows(hits, clause, F.concat_ws(": ", "place", "gram", "owner")), _rows(absent, "leak:lexico_declarado_ausente", F.col("e")))


def scrub(bank: DataFrame, p: Params) -> DataFrame:
    pattern = X.names_pattern(p.names)
    hits = texts(bank).where(F.col("text").rlike(pattern))
    clause = F.when(F.col("place") == "prompt", "scrub:prompt").otherwise("scrub:turno")
    rival = F.col("tipo_ataque") == "persona_concorrente"
    return _all(
        _rows(hits, clause, F.concat_ws(": ", "place", F.regexp_extract("text", pattern, 0))),
        _where(bank, (rival & ~_given("persona_concorrente"), "scrub:persona_concorrente_ausente", ""),
               (rival & _given("persona_concorrente") & F.col("persona_concorrente").rlike(pattern), "scrub:persona_concorrente", F.col("persona_concorrente"))),
    )


def meta(bank: DataFrame, p: Params) -> DataFrame:
    hits = texts(bank).select("run_id", "item_id", "place", F.explode(_term_hits(bank, L.STUDY_VOCABULARY)).alias("term"))
    return _rows(hits, "meta:vocabulario_do_estudo", F.concat_ws(": ", "place", "term"))


def moulds(bank: DataFrame, p: Params) -> DataFrame:
    """Openings shared by too many clusters; the cluster is the unit."""
    by = bank.select("run_id", "cluster_id", X.mould("prompt").alias("mould")).distinct()
    n = bank.groupBy("run_id").agg(F.countDistinct("cluster_id").alias("n"))
    top = by.groupBy("run_id", "mould").agg(F.count("*").alias("k")).join(n, "run_id")
    enough = F.col("n") >= L.MOULD_MIN_CLUSTERS
    detail = F.concat_ws(" ", "mould", F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string"))
    kinds = by.groupBy("run_id").agg(F.countDistinct("mould").alias("d")).join(n, "run_id")
    return _all(
        _rows(top.where(enough & (F.col("k") / F.col("n") > L.MOULD_FRACTION + 1e-9)), "molde:teto_fracionario", detail, F.lit(BANK)),
        _rows(top.where(enough & (F.col("k") > L.MOULD_CLUSTERS)), "molde:teto_absoluto", detail, F.lit(BANK)),
        _rows(kinds.where(F.col("d") / F.col("n") < L.MOULD_DISTINCT - 1e-9), "molde:piso_de_distintos", F.concat_ws("/", F.col("d").cast("string"), F.col("n").cast("string")), F.lit(BANK)),
    )


def cluster_unity(bank: DataFrame, p: Params) -> DataFrame:
    """Members of a cluster must agree in their labels, be numbered from 0, not copy each other, and be
    closer to one another than to items of other clusters."""
    from quillon.operators import duplicates

    c = clusters(bank)
    members = bank.join(c.select("run_id", "cluster_id", "ref", "ref_id"), ["run_id", "cluster_id"]).where("item_id <> ref_id")
    differs = lambda a, b: F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))
    tests = [
        (differs(F.col(x), F.col(f"ref.{x}")), "cluster:construto_divergente" if x == "construto" else "cluster:rotulo_divergente", F.lit(x))
        for x in SAME_IN_CLUSTER
    ]
    size = lambda x: F.coalesce(F.size(F.coalesce(x, F.array().cast("array<string>"))), F.lit(0))
    tests.append((size(F.col("turnos")) != size(F.col("ref.turnos")), "cluster:rotulo_divergente", F.lit("turnos")))
    number = c.where(F.col("idx") != F.expr("transform(sequence(0L, m - 1), x -> cast(x as int))"))
    keyed = bank.select("run_id", F.struct("run_id", "cluster_id").alias("c"), F.struct("paraphrase_idx", "item_id").alias("o"), "item_id", "prompt")
    copies = duplicates.copied_pairs(keyed, cluster_col="c", order_col="o", text_col="prompt", n=L.COPY_N)
    copies = copies.select("c.run_id", F.col("b.item_id").alias("item_id"), F.col("n_shared"))
    near = duplicates.neighbours(
        bank.select("run_id", F.struct("run_id", "item_id").alias("i"), F.struct("run_id", "cluster_id").alias("c"), "prompt"),
        id_col="i", text_col="prompt", cluster_col="c", scope_col="run_id",
    ).where("accused")
    near = near.select("i.run_id", "i.item_id", F.format_string("%.3f > %.3f", "best_other", "best_same").alias("d"))
    return _all(
        _where(members, *tests), _rows(number, "cluster:paraphrase_idx", F.array_join(F.transform("idx", lambda x: x.cast("string")), ","), "cluster_id"),
        _rows(copies, "cluster:copia", F.col("n_shared")), _rows(near, "cluster:vizinho", F.col("d")),
    )


def families(bank: DataFrame, p: Params) -> DataFrame:
    c = clusters(bank).select("run_id", "cluster_id", F.trim(F.coalesce("ref.familia_de_cenario", F.lit(""))).alias("f"), F.col("ref.movimento_alvo").alias("mv"))
    again = c.where("f <> ''").groupBy("run_id", "mv", "f").agg(F.count("*").alias("k")).where("k > 1")
    n = c.groupBy("run_id").agg(F.count("*").alias("n"))
    share = c.where("f <> ''").groupBy("run_id", "f").agg(F.count("*").alias("k")).join(n, "run_id")
    share = share.where((F.col("n") >= L.FAMILY_MIN_CLUSTERS) & (F.col("k") / F.col("n") > L.FAMILY_CAP + 1e-9))
    return _all(
        _rows(bank.where(~_given("familia_de_cenario")), "familia:ausente"),
        _rows(again, "familia:repete_no_movimento", F.concat_ws(": ", "mv", "f"), F.lit(BANK)), _rows(share, "familia:teto_no_banco", F.col("f"), F.lit(BANK)),
    )


def index_balance(bank: DataFrame, p: Params, stratum: str | None = None) -> DataFrame:
    """Of two paraphrases neither may be the longer one systematically, nor by too much."""
    key = F.coalesce(F.col(stratum), F.lit("")) if stratum else F.lit(BANK)
    sized = bank.withColumn("size", p.size(F.col("prompt"))).groupBy("run_id", "cluster_id").agg(
        F.count("*").alias("m"), F.array_sort(F.collect_list(F.struct("paraphrase_idx", "item_id", "size"))).alias("s"), F.min_by(key, F.struct("paraphrase_idx", "item_id")).alias("k")
    )
    two = sized.where("m = 2").select("*", F.col("s")[0]["size"].alias("a"), F.col("s")[1]["size"].alias("b"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    wide = two.where((low == 0) | (high / F.greatest(low, F.lit(1)) > L.LENGTH_RATIO + 1e-9))
    by = two.groupBy("run_id", "k").agg((F.count_if(F.col("a") > F.col("b")) - F.count_if(F.col("b") > F.col("a"))).alias("d"))
    return _all(
        _rows(sized.where("m <> 2"), "indice:parafrases", F.col("m"), "cluster_id"), _rows(wide, "indice:razao_de_comprimento", F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")), "cluster_id"),
        _rows(by.where(F.abs("d") > L.DIRECTION_IMBALANCE), "indice:desequilibrio_de_direcao", F.col("d"), "k"),
    )


def repeats(bank: DataFrame, p: Params) -> DataFrame:
    """Prompts that occur before in the bank, in another one or in a pilot, and near copies."""
    keyed = bank.select("run_id", "item_id", X.normalize("prompt").alias("key"), F.monotonically_increasing_id().alias("o"))
    first = keyed.groupBy("run_id", "key").agg(F.min(F.struct("o", "item_id")).alias("f"))
    inner = keyed.join(first, ["run_id", "key"]).where(F.col("o") > F.col("f.o"))
    parts = [_rows(inner, "dup:interno", F.col("f.item_id"))]
    if p.others is not None:
        o = p.others.select("name", F.col("item_id").alias("oid"), X.normalize("prompt").alias("key"))
        parts.append(_rows(keyed.join(o, "key").where("item_id <> oid"), "dup:entre_bancos", F.concat_ws(":", "name", "oid")))
    if p.pilots is not None:
        o = p.pilots.select("name", X.normalize("prompt").alias("key")).distinct()
        parts.append(_rows(keyed.join(o, "key"), "dup:piloto", F.col("name")))
    near = cluster_unity(bank, p).where("clause = 'cluster:vizinho'").withColumn("clause", F.lit("dup:quase_duplicata"))
    return _all(*parts, near)


def f4_balance(bank: DataFrame, p: Params) -> DataFrame:
    c = clusters(bank).where("ref.faceta_alvo = 'F4'").select("run_id", F.coalesce("ref.direcao_f4", F.lit("")).alias("d"), F.coalesce("ref.dominio_sensivel", F.lit("")).alias("dom"))
    n = c.groupBy("run_id").agg(*(F.count_if(F.col("d") == x).alias(x) for x in F4_DIRECTIONS))
    r, ok = (F.col(x) for x in F4_DIRECTIONS)
    missing = [_rows(n.where(F.col(x) == 0), "f4:direcao_ausente", x, F.lit(BANK)) for x in F4_DIRECTIONS]
    n = n.where((r > 0) & (ok > 0))
    by = c.groupBy("run_id", "dom").agg(*(F.count_if(F.col("d") == x).alias(f"k_{x}") for x in F4_DIRECTIONS)).join(n, "run_id")
    caps = [_rows(by.where(F.col(f"k_{x}") / F.col(x) > L.DOMAIN_CAP + 1e-9), "f4:teto_por_dominio", F.concat_ws(": ", F.lit(x), "dom"), F.lit(BANK)) for x in F4_DIRECTIONS]
    one = by.where((F.col(f"k_{F4_DIRECTIONS[0]}") == 0) | (F.col(f"k_{F4_DIRECTIONS[1]}") == 0))
    return _all(*missing, _rows(n.where(F.abs(r - ok) > 1), "f4:desequilibrio_de_direcao", F.concat_ws("/", r.cast("string"), ok.cast("string")), F.lit(BANK)), _rows(one, "f4:dominio_de_um_lado_so", F.col("dom"), F.lit(BANK)), *caps)


def hijack(bank: DataFrame, p: Params) -> DataFrame:
    own = bank.where("banco = 'hijack'")
    c = clusters(own).select("run_id", F.coalesce("ref.tipo_ataque", F.lit("")).alias("t"), F.size(F.coalesce("ref.turnos", F.array().cast("array<string>"))).alias("n"))
    by = c.groupBy("run_id").agg(*(F.count_if(F.col("t") == x).alias(x) for x in ATTACKS))
    kinds = [F.col(x) for x in ATTACKS]
    uneven = by.where((F.least(*kinds) > 0) & (F.greatest(*kinds) - F.least(*kinds) > 1))
    sizes = c.groupBy("run_id", "t").agg(F.countDistinct("n").alias("k")).where("k > 1")
    joined = F.array_join(F.coalesce("turnos", F.array().cast("array<string>")), TURN_SEPARATOR)
    return _all(
        *(_rows(by.where(F.col(x) == 0), "hijack:tipo_ausente", x, F.lit(BANK)) for x in ATTACKS), _rows(uneven, "hijack:tipos_desbalanceados", F.concat_ws(",", *(k.cast("string") for k in kinds)), F.lit(BANK)),
        _rows(sizes, "hijack:turnos_variaveis", F.col("k"), F.concat(F.lit("("), F.col("t"), F.lit(")"))), _rows(own.where(F.coalesce("prompt", F.lit("")) != joined), "hijack:prompt_nao_e_a_concatenacao", F.length("prompt")),
    )


def shared_files(bank: DataFrame, p: Params) -> DataFrame:
    variant = p.files.where(F.col("name").rlike(r"^battery_(shared|hijack)_.+\.jsonl$"))
    which = F.regexp_extract("name", r"^battery_(shared|hijack)\.jsonl$", 1)
    twice = p.files.select("run_id", which.alias("w")).where("w <> ''").groupBy("run_id", "w").agg(F.count("*").alias("k")).where("k > 1")
    return _all(_rows(variant, "compartilhado:variante_por_persona", "", "name"), _rows(twice, "compartilhado:duplicado", F.col("k"), "w"))


def spelling(bank: DataFrame, p: Params) -> DataFrame:
    labels = bank.where(_given("construto")).withColumn("place", F.lit("construto")).withColumn("text", F.col("construto"))
    t = texts(bank).unionByName(labels)
    bad = X.suspects("text")
    return _where(t, (F.size(bad) > 0, "ortografia:blocklist", F.concat_ws(": ", "place", F.array_join(F.slice(bad, 1, 4), ","))), (X.lacks_accents("text"), "ortografia:texto_longo_sem_acento", F.col("place")))


def user_words(bank: DataFrame, p: Params) -> DataFrame:
    """Formulas of the user and of the substrate must be declared, and what is declared must be there;
    acronyms are looked for in the raw text and in their case."""
    t = bank.withColumn("text", F.coalesce("prompt", F.lit("")))
    declared = F.transform(F.coalesce("lexico_do_usuario", F.array().cast("array<string>")), lambda x: X.normalize(x))
    phrases = [X.normalize_python(x) for x in (*L.USER_FORMULAS, *L.SUBSTRATE_TERMS)]
    used = t.select("run_id", "item_id", declared.alias("declared"), F.explode(F.concat(_term_hits(t, phrases), _term_hits(t, L.SUBSTRATE_ACRONYMS, raw=True))).alias("term"))
    undeclared = used.where(~F.array_contains("declared", X.normalize("term")))
    said = t.select("run_id", "item_id", "text", F.explode("lexico_do_usuario").alias("e")).where(X.normalize("e") != "")
    raw = F.col("e").isin(*L.SUBSTRATE_ACRONYMS)
    absent = said.where(F.when(raw, ~_has_raw("text", "e")).otherwise(~X.holds_word(X.normalize("text"), X.normalize("e"))))
    return _all(_rows(undeclared, "usuario:nao_declarada", F.col("term")), _rows(absent, "usuario:declarada_ausente", F.col("e")))


def _has_raw(text: str, word: str) -> Column:
    return F.array_contains(F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.col(word))


# --- banks of forced choice ------------------------------------------------------------------------


def _sides(bank: DataFrame) -> DataFrame:
    each = F.array(*(F.struct(F.lit(c).alias("place"), F.coalesce(c, F.lit("")).alias("text")) for c in ("contexto", "op_consistente", "op_violadora")))
    return bank.select("run_id", "item_id", F.explode(each).alias("t")).select("run_id", "item_id", "t.place", "t.text")


def pair_length(bank: DataFrame, p: Params) -> DataFrame:
    a, b = p.size(F.col("op_consistente")), p.size(F.col("op_violadora"))
    return _where(bank, (a != b, "len:desigual", F.concat_ws("/", a.cast("string"), b.cast("string"))))


def pair_counterbalance(bank: DataFrame, p: Params) -> DataFrame:
    a, b = X.has_intensifier("op_consistente"), X.has_intensifier("op_violadora")
    by = bank.where(a | b).groupBy("run_id").agg(F.count("*").alias("m"), F.count_if(F.col("intensificador_em") == "consistente").alias("k"))
    return _rows(by.where(F.abs(F.col("k") - F.col("m") / 2) > 1), "contra:desequilibrio", F.concat_ws("/", F.col("k").cast("string"), F.col("m").cast("string")), F.lit(BANK))


def pair_declaration(bank: DataFrame, p: Params) -> DataFrame:
    own = F.col("intensificador_em") == "consistente"
    a, b = X.has_intensifier("op_consistente"), X.has_intensifier("op_violadora")
    return _where(bank, ((own & ~a & b) | (~own & ~b & a), "declara:lado_errado", F.col("intensificador_em")))


def pair_polarity(bank: DataFrame, p: Params) -> DataFrame:
    a, b = X.negations("op_consistente"), X.negations("op_violadora")
    by = bank.groupBy("run_id", "invariante").agg(F.count_if(a > b).alias("c"), F.count_if(b > a).alias("v"))
    return _rows(by.where(F.abs(F.col("c") - (F.col("c") + F.col("v")) / 2) > 1), "polaridade:desequilibrio", F.concat_ws("/", F.col("c").cast("string"), F.col("v").cast("string")), "invariante")


def pair_leak(bank: DataFrame, p: Params) -> DataFrame:
    t = _sides(bank).withColumn("w", X.content_tokens("text", p.stop))
    own = t.select("run_id", "item_id", "place", F.explode(X.ngrams("w", L.PAIR_LEAK_N)).alias("gram"))
    bad = p.sources.withColumn("w", X.content_tokens("text", p.stop)).select(F.explode(X.ngrams("w", L.PAIR_LEAK_N)).alias("gram")).distinct()
    return _rows(own.join(bad, "gram"), "leak:aridade_4", F.concat_ws(": ", "place", "gram"))


def pair_scrub(bank: DataFrame, p: Params) -> DataFrame:
    hits = _sides(bank).where(F.col("text").rlike(X.names_pattern(p.names)))
    return _rows(hits, "scrub:nome", F.col("place"))


def pair_mould(bank: DataFrame, p: Params) -> DataFrame:
    by = bank.groupBy("run_id", X.raw_mould("contexto").alias("mould")).agg(F.count("*").alias("k"))
    top = by.groupBy("run_id").agg(F.sum("k").alias("n"), F.max("k").alias("k"))
    return _rows(top.where((F.col("n") >= L.MOULD_MIN_CLUSTERS) & (F.col("k") / F.col("n") > L.PAIR_MOULD_CAP)), "molde:dominante", F.concat_ws("/", F.col("k").cast("string"), F.col("n").cast("string")), F.lit(BANK))


def label_tokens(encoded: Mapping[str, Sequence[int]]) -> list[str]:
    """Problems of the labels' encodings, known on the driver: empty, or not told apart."""
    bad = [f"empty: {k}" for k, v in encoded.items() if not v]
    return bad + [f"same: {a}, {b}" for i, a in enumerate(encoded) for b in list(encoded)[:i] if list(encoded[a]) == list(encoded[b])]


# --- two arms --------------------------------------------------------------------------------------


def arm_parity(a: DataFrame, b: DataFrame, p: Params, *, draws: int = L.BOOTSTRAPS, seed: int = L.SEED) -> tuple[DataFrame, DataFrame]:
    """Accusations, and the figures behind them, of two persona banks of one run each. Pairs of clusters
    by ``par_id``, but those that either arm has twice; the mean difference of dose is bootstrapped."""
    from quillon.operators import gates

    size = p.size
    run = F.lit("(bancos)")

    def dose(df: DataFrame) -> DataFrame:
        c = df.groupBy("cluster_id").agg(
            F.avg(size(F.col("prompt")).cast("double")).alias("dose"), F.min_by("par_id", "paraphrase_idx").alias("par_id"),
            F.min_by("forma_convocacao", "paraphrase_idx").alias("forma"), F.min_by("movimento_alvo", "paraphrase_idx").alias("mov"),
        )
        twice = F.count("*").over(Window.partitionBy("par_id"))
        return c.withColumn("unique", F.coalesce(F.col("par_id") != "", F.lit(False)) & (twice == 1))

    da, db = dose(a), dose(b)
    pairs = da.where("unique").select("par_id", F.col("dose").alias("x")).join(db.where("unique").select("par_id", F.col("dose").alias("y")), "par_id")
    pairs = pairs.select(F.lit("par").alias("arm"), "par_id", (F.col("x") - F.col("y")).alias("delta")).cache()
    ci = gates.coincidence(gates.bootstrap_seeded(pairs, "arm", "delta", "par_id", draws=draws, seed=seed), L.MEAN_MARGIN)
    row = lambda df, clause, detail, item=run: df.select(F.lit("(par)").alias("run_id"), item.alias("item_id"), F.lit(clause).alias("clause"), detail.cast("string").alias("detail"))
    count = lambda df, c: df.groupBy(F.coalesce(c, F.lit("")).alias("v")).agg(F.count("*").alias("k"))

    def unlike(c: str) -> DataFrame:
        x, y = count(da, c).withColumnRenamed("k", "kx"), count(db, c).withColumnRenamed("k", "ky")
        return x.join(y, "v", "full_outer").where(F.coalesce("kx", F.lit(0)) != F.coalesce("ky", F.lit(0)))

    n = da.agg(F.count("*").alias("na")).join(db.agg(F.count("*").alias("nb"))).join(pairs.agg(F.count("*").alias("np")))
    gens = a.select("generator").union(b.select("generator")).agg(F.array_sort(F.collect_set("generator")).alias("g"))
    asks = F.endswith(F.rtrim(F.coalesce("prompt", F.lit(""))), F.lit("?"))
    both = a.select("item_id", "prompt", "forma_convocacao").union(b.select("item_id", "prompt", "forma_convocacao"))
    parts = [
        row(n.where("na <> nb"), "par:n_clusters", F.concat_ws("/", F.col("na").cast("string"), F.col("nb").cast("string"))),
        row(gens.where("size(g) > 1"), "par:generator", F.array_join("g", ",")),
        row(pairs.where(F.abs("delta") > L.PAIR_DELTA + 1e-9), "par:delta_por_par", F.col("delta"), F.col("par_id")),
        row(n.where("np = 0"), "par:dose_sem_cobertura", F.lit("")), row(ci.where(~F.col("gate")), "par:dose_media", F.format_string("%.2f [%.2f; %.2f]", "mean", "lo", "hi")),
        row(unlike("forma").agg(F.count("*").alias("k")).where("k > 0"), "par:forma_de_convocacao", F.col("k")),
        row(both.where(asks != (F.coalesce("forma_convocacao", F.lit("")) == "pergunta_direta")), "par:forma_contra_o_texto", F.col("forma_convocacao"), F.col("item_id")),
    ]
    verdict = F.when(F.col("verdict") == "COINCIDEM_DENTRO_DA_MARGEM", "PARITARIO").when(F.col("verdict") == "DIVERGEM", "ENVIESADO").otherwise("NAO_DEMONSTRADO")
    figures = n.join(ci.select("mean", "lo", "hi", verdict.alias("verdict")), how="left")
    return _all(*parts), figures.withColumn("verdict", F.coalesce("verdict", F.lit("NAO_APLICAVEL")))


# --- running ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trap:
    """A gate, what it needs of :class:`Params`, and the rows that it must accuse by a clause."""

    name: str
    accuse: Callable[[DataFrame, Params], DataFrame]
    needs: tuple[str, ...] = ()


PRODUCTION = (
    Trap("PR-SCHEMA", schema), Trap("PR-LEXICO", lexicon), Trap("PR-LEAK", leak, ("sources",)), Trap("PR-SCRUB", scrub, ("names",)), Trap("PR-META", meta),
    Trap("PR-MOLDE", moulds), Trap("PR-CLUSTER", cluster_unity), Trap("PR-FAMILIA", families), Trap("PR-ORTOGRAFIA", spelling), Trap("PR-USUARIO", user_words),
    Trap("PR-COMPARTILHADO", shared_files, ("files",)), Trap("PR-DUP", repeats), Trap("PR-F4", f4_balance), Trap("PR-INDICE", index_balance, ("size",)), Trap("PR-HIJACK", hijack),
)
PAIRS = (
    Trap("P-CONTRA", pair_counterbalance), Trap("P-DECLARA", pair_declaration), Trap("P-POLARIDADE", pair_polarity), Trap("P-LEAK", pair_leak, ("sources",)),
    Trap("P-SCRUB", pair_scrub, ("names",)), Trap("P-MOLDE", pair_mould), Trap("P-LEN", pair_length, ("size",)),
)


def accusations(bank: DataFrame, traps: Sequence[Trap], p: Params) -> DataFrame:
    """All accusations of the traps whose needs are met: ``(trap, run_id, item_id, clause, detail)``."""
    ready = [t for t in traps if _ready(t, p)]
    parts = [t.accuse(bank, p).select(F.lit(t.name).alias("trap"), "run_id", "item_id", "clause", "detail") for t in ready]
    return _all(*parts) if parts else bank.sparkSession.createDataFrame([], "trap string, run_id string, item_id string, clause string, detail string")


def _ready(t: Trap, p: Params) -> bool:
    missing = [n for n in t.needs if getattr(p, n) is None or (n == "names" and not p.names)]
    return not missing


def run(bank: DataFrame, traps: Sequence[Trap], p: Params, controls: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """``(trap, run_id, status, n)`` for each trap and bank. ``controls`` gives, by trap, rows that must be
    accused and the clause that must do so; they have run ids of their own. SKIPPED: a need isn't met;
    VACUOUS: the control wasn't accused by its clause; else ACCUSED or OK."""
    spark, controls = bank.sparkSession, controls or {}
    runs = bank.select("run_id").distinct()
    out = []
    for t in traps:
        if not _ready(t, p):
            out.append(runs.select(F.lit(t.name).alias("trap"), "run_id", F.lit("SKIPPED").alias("status"), F.lit(0).cast("long").alias("n")))
            continue
        found = t.accuse(bank, p).groupBy("run_id").agg(F.count("*").alias("n"))
        status = F.when(F.col("n") > 0, "ACCUSED").otherwise("OK")
        rows = runs.join(found, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        if t.name in controls:
            planted, clause = controls[t.name]
            caught = t.accuse(planted, p).where(F.col("clause") == clause).agg((F.count("*") > 0).alias("caught"))
            rows = rows.join(F.broadcast(caught))
            status = F.when(~F.col("caught"), "VACUOUS").otherwise(status)
        out.append(rows.select(F.lit(t.name).alias("trap"), "run_id", status.alias("status"), "n"))
    return _all(*out) if out else spark.createDataFrame([], "trap string, run_id string, status string, n long")


def verdict(statuses: DataFrame) -> DataFrame:
    """One verdict a bank: valid only if nothing was skipped or empty, partial if something was."""
    by = statuses.groupBy("run_id").agg(
        F.count_if(F.col("status").isin("ACCUSED", "VACUOUS")).alias("bad"), F.array_sort(F.collect_list(F.when(F.col("status") == "SKIPPED", F.col("trap")))).alias("skipped")
    )
    partial = F.concat(F.lit("VALIDADO_PARCIAL_SEM: "), F.array_join("skipped", ", "))
    return by.select("run_id", F.when(F.col("bad") > 0, "REPROVADO").when(F.size("skipped") > 0, partial).otherwise("VALIDADO").alias("verdict"))


def gate(bank: DataFrame, traps: Sequence[Trap], p: Params) -> None:
    """Raise on the first trap, in order, that accuses."""
    for t in traps:
        if _ready(t, p) and (first := t.accuse(bank, p).limit(5).collect()):
            raise ValueError(f"{t.name}: {[(r.item_id, r.clause, r.detail) for r in first]}")
