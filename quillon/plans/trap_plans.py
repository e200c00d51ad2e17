"""One query for each gate of item banks, over fixture banks that break one rule each, beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import text as X
from quillon.operators import traps as G

WORDS = tuple("barco cedro duna estrela farol grota hulha ilha jarro lagoa".split())
NAMES = ("Alfonso", "Beto")
MOVEMENTS = {"alfa": ("m1", "m2"), "beta": ("m3",)}
TERMS = ("pedra filosofal", "roda viva")
SOURCES = (("alfa", "a casa verde tinha sete janelas"), ("beta", "o rio corre lento ontem"))
FILES = (
    ("r1", "battery_shared.jsonl"), ("r1", "battery_alfa.jsonl"), ("r2", "battery_shared_alfa.jsonl"), ("r2", "battery_hijack.jsonl"),
    ("r3", "battery_hijack.jsonl"), ("r3", "battery_hijack.jsonl"), ("r4", "battery_hijack_beta.jsonl"), ("r4", "battery_shared.jsonl.bak"),
)
ITEM = tuple(c.split()[0] for c in G.ITEM.split(", "))
PAIR = tuple(c.split()[0] for c in G.PAIR.split(", "))


def _item(run: str, c: int, p: int, **changes: object) -> dict:
    own = WORDS[c]
    row = {
        "run_id": run, "item_id": f"{run}-c{c}-p{p}", "banco": "alfa", "cluster_id": f"c{c:02d}", "paraphrase_idx": p,
        "prompt": f"{own} {('ontem vi', 'quero um')[p]} {own}al {own}ito {own}ado {('ré', 'pé')[p]}{c}.", "faceta_alvo": "F1",
        "forma_convocacao": "relato", "generator": "g", "turnos": [], "movimento_alvo": ("m1", "m2")[c % 2], "direcao_f4": "", "dominio_sensivel": "",
        "tipo_ataque": "", "persona_concorrente": "", "par_id": f"par{c}", "construto": "", "lexico_do_usuario": [], "familia_de_cenario": f"fam{c}",
    }
    return row | changes


def _run(run: str, n: int = 6, change: Callable[[dict], dict] = lambda r: {}) -> list[dict]:
    rows = [_item(run, c, p) for c in range(n) for p in (0, 1)]
    return [r | change(r) for r in rows]


def _one(run: str, **changes: object) -> list[dict]:
    """A sound run but for its second row."""
    return _run(run, change=lambda r: changes if r["item_id"] == f"{run}-c0-p1" else {})


def _banks() -> list[dict]:
    c = lambda r: int(r["cluster_id"][1:])
    f4 = lambda direction, domain: lambda r: {"faceta_alvo": "F4", "direcao_f4": direction(r), "dominio_sensivel": domain(r)}
    hijack = lambda kind, turns: lambda r: {"banco": "hijack", "movimento_alvo": "", "tipo_ataque": kind(r), "turnos": turns(r), "prompt": "\n\n".join(turns(r))}
    side = lambda k: lambda r: "legitimo" if c(r) >= k else "deve_recusar"
    say = lambda r: ["conte uma coisa boa de hoje", f"agora diga {WORDS[c(r)]} {r['paraphrase_idx']}"]
    singles = {
        "cluster_id": {"cluster_id": "C 0"}, "banco": {"banco": "gama"}, "mixed": {"banco": "beta", "movimento_alvo": "m3"}, "gen": {"generator": "h"},
        "faceta": {"faceta_alvo": "F9"}, "forma": {"forma_convocacao": ""}, "dir": {"direcao_f4": "talvez"}, "dir2": {"direcao_f4": "legitimo"},
        "f4": {"faceta_alvo": "F4"}, "ataque": {"tipo_ataque": "z"}, "hij": {"banco": "hijack", "movimento_alvo": ""},
        "turnos": {"turnos": ["um dois tres quatro cinco"]}, "mov0": {"movimento_alvo": ""}, "mov3": {"movimento_alvo": "m3"}, "shared": {"banco": "shared"},
        "rival": {"persona_concorrente": "Zelia"}, "empty": {"prompt": " "}, "short": {"prompt": "o que tinha isso de um"}, "same": {"item_id": "same-c0-p0"},
        "lex": {"prompt": "um texto Estoicista e longo demais, roda-viva"}, "lex2": {"prompt": "li Sartre e Camus ontem de noite"}, "meta": {"prompt": "qual a sua Persona, sem fine-tuning, agora"},
        "name": {"prompt": "oi ALFONSO, como vai hoje a beto"}, "nameturn": {"turnos": ["diga, Alfonso", "sim"]},
        "nameatt": {"tipo_ataque": "persona_concorrente", "persona_concorrente": "Alfonso II"}, "noname": {"tipo_ataque": "persona_concorrente"},
        "fam": {"familia_de_cenario": ""}, "long": {"prompt": "a b c d e f g h i j k l m n"}, "dup": {"prompt": "BARCO ontem vi, barcoal barcoito barcoado re0"},
        "leak3": {"prompt": "na casa verde tinha um gato preto"}, "leak4": {"prompt": "Casa verde tinha sete gatos pretos"}, "leakr": {"prompt": "o rio corre lento hoje tambem"},
        "declared": {"prompt": "a casa verde tinha um gato", "lexico_do_usuario": ["casa verde tinha", "coisa que falta"]},
    }
    rows = _run("good") + [r for run, changes in singles.items() for r in _one(run, **changes)]
    rows += _run("fam2", change=lambda r: {"familia_de_cenario": "fam0"} if c(r) == 2 else {})
    rows += _run("fam3", 8, lambda r: {"familia_de_cenario": "f"} if c(r) < 3 else {})
    rows += _run("open1", change=lambda r: {"prompt": f"um dois três {r['prompt']}"}) + _run("open2", 9, lambda r: {"prompt": f"um dois tres {r['prompt']}"} if c(r) < 2 else {})
    rows += _run("open3", 9, lambda r: {"prompt": f"Um, dois tres {r['prompt']}"}) + _run("odd")[:-1] + _run("wordy", change=lambda r: {"prompt": r["prompt"] + " mais" * r["paraphrase_idx"]})
    rows += _run("f4a", change=f4(lambda r: "legitimo", lambda r: "d")) + _run("f4b", change=f4(side(1), lambda r: "d")) + _run("f4c", change=f4(side(3), lambda r: r["cluster_id"]))
    rows += _run("f4d", change=f4(side(3), lambda r: ("d", "e", "f")[c(r) % 3])) + _run("f4e", change=f4(side(3), lambda r: "d"))
    rows += _run("hij1", change=hijack(lambda r: "ordem_direta", say)) + _run("hij2", 8, hijack(lambda r: G.ATTACKS[c(r) % 4], say)) + _run("hij3", 9, hijack(lambda r: G.ATTACKS[min(3, c(r))], say))
    rows += _run("hij4", 8, hijack(lambda r: G.ATTACKS[c(r) % 4], lambda r: say(r) * (1 + c(r) // 4))) + [r | ({"prompt": "x y z w"} if r["item_id"] == "hij5-c0-p0" else {}) for r in _run("hij5", 8, hijack(lambda r: G.ATTACKS[c(r) % 4], say))]
    return rows


def _pairs() -> list[dict]:
    rows = []
    for run in ("good", "len", "contra", "declara", "polar", "leak", "name", "mould"):
        for k in range(12):
            even = k % 2 == 0
            row = {
                "run_id": run, "item_id": f"{run}-{k}", "contexto": f"{WORDS[k % 10]} {WORDS[(k * 3 + 1) % 10]} numa tarde {k}",
                "op_consistente": f"sim {'apenas' if even else 'agora'} {WORDS[k % 10]}", "op_violadora": f"ele {'hoje' if even else 'apenas'} {WORDS[k % 10]}",
                "intensificador_em": "consistente" if even else "violadora", "invariante": f"i{k % 3}", "polo": "a",
            }
            if run == "len" and k in (2, 5):
                row["op_violadora"] += " a mais"
            if run == "contra":
                row["intensificador_em"] = "consistente"
            if run == "declara" and k < 3:
                row["intensificador_em"] = "violadora" if even else "consistente"
            if run == "polar" and k % 3 == 1:
                row["op_consistente"] += " não, nunca"
            if run == "leak" and k == 7:
                row["contexto"] = "Uma casa verde tinha sete portas"
            if run == "name" and k in (0, 3):
                row["op_violadora" if k else "contexto"] = "fale com ALFONSO hoje"
            if run == "mould" and k < 6:
                row["contexto"] = f"Só numa noite {k}"
            rows.append(row)
    return rows


BANKS, PAIRS = _banks(), _pairs()
TRAPS = {t.name: t for t in (*G.PRODUCTION, *G.PAIRS)}


def _params(spark: SparkSession) -> G.Params:
    first = [("other", "x1", "CEDRO ontem vi cedroal cedroito cedroado re1"), ("other", "good-c2-p0", BANKS[4]["prompt"])]
    return G.Params(
        movements=MOVEMENTS, names=NAMES, terms={"lista_a_mao": TERMS}, sources=spark.createDataFrame(list(SOURCES), "owner string, text string"),
        others=spark.createDataFrame(first, "name string, item_id string, prompt string"), pilots=spark.createDataFrame([("p", BANKS[6]["prompt"])], "name string, prompt string"),
        files=spark.createDataFrame(list(FILES), "run_id string, name string"), size=X.word_count,
    )


def banks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r[c] for c in ITEM) for r in BANKS], G.ITEM)


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r[c] for c in PAIR) for r in PAIRS], G.PAIR)


def _trap(name: str, skip: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        bank = pairs(spark) if name.startswith("P-") else banks(spark)
        found = TRAPS[name].accuse(bank, _params(spark))
        found = found.where(~F.col("clause").isin(*skip)) if skip else found
        return found.groupBy("run_id", "item_id", "clause").agg(F.count("*").alias("n"))

    return query


def trap_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of all banks: members, indices and the first member's labels."""
    c = G.clusters(banks(spark))
    return c.select("run_id", "cluster_id", "m", F.concat_ws(",", F.transform("idx", lambda x: x.cast("string"))).alias("idx"), "ref_id", F.col("ref.movimento_alvo").alias("movimento"))


def trap_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of pair banks, with a control that goes unnoticed and a need that isn't met."""
    control = pairs(spark).where("run_id = 'good'").withColumn("run_id", F.lit("planted"))
    traps = [TRAPS[n] for n in ("P-CONTRA", "P-MOLDE", "P-SCRUB", "P-LEN")]
    p = _params(spark)
    p.size = None
    noticed = pairs(spark).where("run_id = 'name'").withColumn("run_id", F.lit("planted"))
    found = G.run(pairs(spark), traps, p, {"P-MOLDE": (control, "molde:dominante"), "P-SCRUB": (noticed, "scrub:nome")})
    return found.join(G.verdict(found), "run_id")


QUERIES = {
    "trap_schema": _trap("PR-SCHEMA"), "trap_lexicon": _trap("PR-LEXICO"), "trap_meta": _trap("PR-META"), "trap_scrub": _trap("PR-SCRUB"),
    "trap_leak": _trap("PR-LEAK"), "trap_moulds": _trap("PR-MOLDE"), "trap_families": _trap("PR-FAMILIA"), "trap_f4": _trap("PR-F4"), "trap_hijack": _trap("PR-HIJACK"),
    "trap_shared_files": _trap("PR-COMPARTILHADO"), "trap_index": _trap("PR-INDICE"), "trap_repeats": _trap("PR-DUP", ("dup:quase_duplicata",)),
    "trap_pair_length": _trap("P-LEN"), "trap_pair_counterbalance": _trap("P-CONTRA"), "trap_pair_declaration": _trap("P-DECLARA"), "trap_pair_polarity": _trap("P-POLARIDADE"),
    "trap_pair_leak": _trap("P-LEAK"), "trap_pair_scrub": _trap("P-SCRUB"), "trap_pair_mould": _trap("P-MOLDE"), "trap_clusters": trap_clusters, "trap_verdicts": trap_verdicts,
}


def _sql(v: object) -> str:
    if isinstance(v, (list, tuple)):
        return "CAST([" + ", ".join(map(_sql, v)) + "] AS VARCHAR[])"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _values(name: str, rows: list[dict], cols: tuple[str, ...]) -> str:
    return f"{name}({', '.join(cols)}) AS (VALUES " + ", ".join("(" + ", ".join(_sql(r[c]) for c in cols) + ")" for r in rows) + ")"


def _list(values: object) -> str:
    return "(" + ", ".join(map(_sql, values)) + ")"


_ITEMS, _PAIRS = _values("b", BANKS, ITEM), _values("q", PAIRS, PAIR)
_NORM = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
_CONTENT = "list_filter(string_split(" + _NORM + ", ' '), lambda w: w <> '' AND w NOT IN " + _list(L.STOPWORDS) + ")"
_SIZE = r"len(regexp_extract_all({0}, '\S+'))"
_T = "t AS (SELECT *, 'prompt' AS place, prompt AS text FROM b UNION ALL SELECT b.*, 'turno', u.t FROM b, unnest(turnos) u(t))"
_C = """c AS (SELECT run_id, cluster_id, count(*) AS m, list(paraphrase_idx ORDER BY paraphrase_idx) AS idx,
  first(movimento_alvo ORDER BY paraphrase_idx, item_id) AS mov, first(trim(familia_de_cenario) ORDER BY paraphrase_idx, item_id) AS fam,
  first(faceta_alvo ORDER BY paraphrase_idx, item_id) AS fac, first(direcao_f4 ORDER BY paraphrase_idx, item_id) AS dir, first(dominio_sensivel ORDER BY paraphrase_idx, item_id) AS dom,
  first(item_id ORDER BY paraphrase_idx, item_id) AS ref_id FROM b GROUP BY ALL)"""
_SIDES = "s AS (SELECT run_id, item_id, contexto AS text FROM q UNION ALL SELECT run_id, item_id, op_consistente FROM q UNION ALL SELECT run_id, item_id, op_violadora FROM q)"


def _said(*selects: str) -> str:
    return "SELECT run_id, item_id, clause, count(*) AS n FROM (" + " UNION ALL ".join(selects) + ") GROUP BY ALL"


def _row(clause: str, test: str, table: str = "b", item: str = "item_id") -> str:
    return f"SELECT run_id, {item} AS item_id, '{clause}' AS clause FROM {table} WHERE {test}"


def _grams(words: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({words}) - {n} + 2, 1)), lambda i: array_to_string({words}[i : i + {n} - 1], ' ')))"


def _terms(clause: str, terms: object, stems: bool = True) -> list[str]:
    out = []
    for t in terms:
        key = t if t in L.STEMS else X.normalize_python(t)
        end = "" if t in L.STEMS else "( |$)"
        out.append(_row(clause, f"regexp_matches({_NORM.format('text')}, '(^| ){key}{end}')", "t"))
    return out


_PERSONA = f"banco IN {_list(MOVEMENTS)}"
_NAMED = r"regexp_matches({0}, '(?i)(^|[^\w])(" + "|".join(NAMES) + r")([^\w]|$)')"
_KNOWN = " OR ".join(f"(banco = '{b}' AND movimento_alvo IN {_list(ms)})" for b, ms in MOVEMENTS.items())
_INTENSE = lambda c: f"regexp_matches({_NORM.format(c)}, '(^| )({'|'.join(X.normalize_python(t) for t in L.INTENSIFIERS)})( |$)')"
_NEG = lambda c: f"len(list_filter(string_split({_NORM.format(c)}, ' '), lambda w: w IN {_list(L.NEGATIONS)}))"

ORACLE_SQL = {
    "trap_schema": f"WITH {_ITEMS}, {_T} " + _said(
        _row("schema:cluster_id", "NOT regexp_full_match(cluster_id, '[a-z0-9_]+')"), _row("schema:banco", f"NOT ({_PERSONA}) AND banco NOT IN ('shared', 'hijack')"),
        _row("schema:faceta_alvo", f"faceta_alvo NOT IN {_list(G.FACETS)}"), _row("schema:forma_convocacao", f"forma_convocacao NOT IN {_list(G.FORMS)}"),
        _row("schema:direcao_f4", f"direcao_f4 <> '' AND direcao_f4 NOT IN {_list(G.F4_DIRECTIONS)}"), _row("schema:tipo_ataque", f"tipo_ataque <> '' AND tipo_ataque NOT IN {_list(G.ATTACKS)}"),
        _row("schema:tipo_ataque_ausente_em_hijack", "banco = 'hijack' AND tipo_ataque = ''"), _row("schema:turnos_ausentes_em_hijack", "banco = 'hijack' AND len(turnos) = 0"),
        _row("schema:tipo_ataque_fora_de_hijack", "banco <> 'hijack' AND tipo_ataque <> ''"), _row("schema:turnos_fora_de_hijack", "banco <> 'hijack' AND len(turnos) > 0"),
        _row("schema:movimento_ausente", f"{_PERSONA} AND movimento_alvo = ''"), _row("schema:movimento_inexistente", f"{_PERSONA} AND movimento_alvo <> '' AND NOT ({_KNOWN})"),
        _row("schema:movimento_fora_do_banco_de_persona", f"NOT ({_PERSONA}) AND movimento_alvo <> ''"),
        _row("schema:persona_concorrente_fora_do_tipo", "persona_concorrente <> '' AND tipo_ataque <> 'persona_concorrente'"),
        *(_row(f"schema:{c}_ausente_em_F4", f"faceta_alvo = 'F4' AND {c} = ''") for c in ("direcao_f4", "dominio_sensivel")),
        *(_row(f"schema:{c}_fora_de_F4", f"faceta_alvo <> 'F4' AND {c} <> ''") for c in ("direcao_f4", "dominio_sensivel")),
        _row("schema:texto_vazio", "trim(text) = ''", "t"), _row("schema:piso_de_conteudo", f"trim(text) <> '' AND len({_CONTENT.format('text')}) < {L.CONTENT_FLOOR}", "t"),
        "SELECT run_id, item_id, 'schema:item_id_repetido' AS clause FROM (SELECT run_id, item_id, row_number() OVER (PARTITION BY run_id, item_id) AS k FROM b) WHERE k > 1",
        *(f"SELECT run_id, '(banco)', 'schema:{c}_misturado' FROM b GROUP BY run_id HAVING count(DISTINCT {c}) > 1" for c in ("banco", "generator")),
    ),
    "trap_lexicon": f"WITH {_ITEMS}, {_T} " + _said(*_terms("lexico:lista_a_mao", TERMS), *_terms("lexico:influencias_nao_citadas", L.UNCITED_INFLUENCES), *_terms("lexico:tecnico_congelado", L.FROZEN_TECHNICAL)),
    "trap_meta": f"WITH {_ITEMS}, {_T} " + _said(*_terms("meta:vocabulario_do_estudo", L.STUDY_VOCABULARY)),
    "trap_scrub": f"WITH {_ITEMS}, {_T} " + _said(
        f"SELECT run_id, item_id, CASE place WHEN 'prompt' THEN 'scrub:prompt' ELSE 'scrub:turno' END AS clause FROM t WHERE {_NAMED.format('text')}",
        _row("scrub:persona_concorrente_ausente", "tipo_ataque = 'persona_concorrente' AND persona_concorrente = ''"),
        _row("scrub:persona_concorrente", f"tipo_ataque = 'persona_concorrente' AND {_NAMED.format('persona_concorrente')}"),
    ),
    "trap_leak": f"""WITH {_ITEMS}, {_T}, {_values('src', [{'owner': o, 'text': x} for o, x in SOURCES], ('owner', 'text'))},
w AS (SELECT *, {_CONTENT.format('text')} AS w FROM t), sw AS (SELECT owner, {_CONTENT.format('text')} AS w FROM src),
g AS (SELECT run_id, item_id, banco, place, text, 3 AS a, unnest({_grams('w', 3)}) AS gram FROM w UNION ALL SELECT run_id, item_id, banco, place, text, 4, unnest({_grams('w', 4)}) FROM w),
sg AS (SELECT DISTINCT * FROM (SELECT owner, 3 AS a, unnest({_grams('w', 3)}) AS gram FROM sw UNION ALL SELECT owner, 4, unnest({_grams('w', 4)}) FROM sw)),
e AS (SELECT run_id, item_id, {_CONTENT.format('x')} AS w FROM b, unnest(lexico_do_usuario) u(x)),
free AS (SELECT run_id, item_id, unnest({_grams('w', 3)}) AS gram FROM e UNION SELECT run_id, item_id, unnest({_grams('w', 4)}) FROM e),
whole AS (SELECT run_id, item_id, ' ' || string_agg(array_to_string(w, ' '), ' ' ORDER BY place) || ' ' AS h FROM w GROUP BY ALL)
""" + _said(
        f"SELECT run_id, item_id, CASE WHEN {_PERSONA} AND owner <> banco THEN 'leak:persona_rival' ELSE 'leak:aridade_' || a END AS clause FROM g JOIN sg USING (a, gram) WHERE (run_id, item_id, gram) NOT IN (SELECT run_id, item_id, gram FROM free)",
        "SELECT run_id, item_id, 'leak:lexico_declarado_ausente' FROM e JOIN whole USING (run_id, item_id) WHERE len(w) > 0 AND NOT contains(h, array_to_string(w, ' '))",
    ),
    "trap_moulds": f"""WITH {_ITEMS}, m AS (SELECT DISTINCT run_id, cluster_id, array_to_string(list_filter(string_split({_NORM.format('prompt')}, ' '), lambda x: x <> '')[1:3], ' ') AS mould FROM b),
n AS (SELECT run_id, count(DISTINCT cluster_id) AS n, count(DISTINCT mould) AS d FROM m GROUP BY ALL), k AS (SELECT run_id, mould, count(*) AS k FROM m GROUP BY ALL)
""" + _said(
        f"SELECT run_id, '(banco)' AS item_id, 'molde:teto_fracionario' AS clause FROM k JOIN n USING (run_id) WHERE n >= {L.MOULD_MIN_CLUSTERS} AND k / n > {L.MOULD_FRACTION} + 1e-9",
        f"SELECT run_id, '(banco)', 'molde:teto_absoluto' FROM k JOIN n USING (run_id) WHERE n >= {L.MOULD_MIN_CLUSTERS} AND k > {L.MOULD_CLUSTERS}",
        f"SELECT run_id, '(banco)', 'molde:piso_de_distintos' FROM n WHERE d / n < {L.MOULD_DISTINCT} - 1e-9",
    ),
    "trap_families": f"WITH {_ITEMS}, {_C} " + _said(
        _row("familia:ausente", "trim(familia_de_cenario) = ''"),
        "SELECT run_id, '(banco)', 'familia:repete_no_movimento' FROM c WHERE fam <> '' GROUP BY run_id, mov, fam HAVING count(*) > 1",
        f"SELECT run_id, '(banco)', 'familia:teto_no_banco' FROM c JOIN (SELECT run_id, count(*) AS n FROM c GROUP BY 1) USING (run_id) WHERE fam <> '' AND n >= {L.FAMILY_MIN_CLUSTERS} GROUP BY run_id, fam, n HAVING count(*) / n > {L.FAMILY_CAP} + 1e-9",
    ),
    "trap_f4": f"""WITH {_ITEMS}, {_C}, f AS (SELECT * FROM c WHERE fac = 'F4'), n AS (SELECT run_id, count(*) FILTER (dir = 'deve_recusar') AS r, count(*) FILTER (dir = 'legitimo') AS l FROM f GROUP BY ALL),
k AS (SELECT run_id, dom, count(*) FILTER (dir = 'deve_recusar') AS kr, count(*) FILTER (dir = 'legitimo') AS kl, n.r, n.l FROM f JOIN n USING (run_id) WHERE n.r > 0 AND n.l > 0 GROUP BY ALL)
""" + _said(
        "SELECT run_id, '(banco)' AS item_id, 'f4:direcao_ausente' AS clause FROM n WHERE r = 0", "SELECT run_id, '(banco)', 'f4:direcao_ausente' FROM n WHERE l = 0",
        "SELECT run_id, '(banco)', 'f4:desequilibrio_de_direcao' FROM n WHERE r > 0 AND l > 0 AND abs(r - l) > 1", "SELECT run_id, '(banco)', 'f4:dominio_de_um_lado_so' FROM k WHERE kr = 0 OR kl = 0",
        f"SELECT run_id, '(banco)', 'f4:teto_por_dominio' FROM k WHERE kr / r > {L.DOMAIN_CAP} + 1e-9", f"SELECT run_id, '(banco)', 'f4:teto_por_dominio' FROM k WHERE kl / l > {L.DOMAIN_CAP} + 1e-9",
    ),
    "trap_hijack": f"""WITH {_ITEMS}, h AS (SELECT * FROM b WHERE banco = 'hijack'),
c AS (SELECT run_id, cluster_id, first(tipo_ataque ORDER BY paraphrase_idx, item_id) AS t, first(len(turnos) ORDER BY paraphrase_idx, item_id) AS n FROM h GROUP BY ALL),
a(t) AS (VALUES {', '.join(f"('{x}')" for x in G.ATTACKS)}), k AS (SELECT r.run_id, a.t, count(c.t) AS k FROM (SELECT DISTINCT run_id FROM c) r CROSS JOIN a LEFT JOIN c ON c.run_id = r.run_id AND c.t = a.t GROUP BY ALL)
""" + _said(
        "SELECT run_id, '(banco)' AS item_id, 'hijack:tipo_ausente' AS clause FROM k WHERE k = 0", "SELECT run_id, '(banco)', 'hijack:tipos_desbalanceados' FROM k GROUP BY run_id HAVING min(k) > 0 AND max(k) - min(k) > 1",
        "SELECT run_id, '(' || t || ')', 'hijack:turnos_variaveis' FROM c GROUP BY run_id, t HAVING count(DISTINCT n) > 1",
        "SELECT run_id, item_id, 'hijack:prompt_nao_e_a_concatenacao' FROM h WHERE prompt <> array_to_string(turnos, chr(10) || chr(10))",
    ),
    "trap_shared_files": f"WITH {_values('f', [{'run_id': r, 'name': x} for r, x in FILES], ('run_id', 'name'))} " + _said(
        "SELECT run_id, name AS item_id, 'compartilhado:variante_por_persona' AS clause FROM f WHERE regexp_full_match(name, 'battery_(shared|hijack)_.+[.]jsonl')",
        "SELECT run_id, name[9:-7], 'compartilhado:duplicado' FROM f WHERE name IN ('battery_shared.jsonl', 'battery_hijack.jsonl') GROUP BY run_id, name HAVING count(*) > 1",
    ),
    "trap_index": f"""WITH {_ITEMS}, z AS (SELECT run_id, cluster_id, list({_SIZE.format('prompt')} ORDER BY paraphrase_idx, item_id) AS s FROM b GROUP BY ALL), p AS (SELECT *, s[1] AS x, s[2] AS y FROM z WHERE len(s) = 2)
""" + _said(
        _row("indice:parafrases", "len(s) <> 2", "z", "cluster_id"), _row("indice:razao_de_comprimento", f"least(x, y) = 0 OR greatest(x, y) / least(x, y) > {L.LENGTH_RATIO} + 1e-9", "p", "cluster_id"),
        f"SELECT run_id, '(banco)', 'indice:desequilibrio_de_direcao' FROM p GROUP BY run_id HAVING abs(sum(sign(x - y))) > {L.DIRECTION_IMBALANCE}",
    ),
    "trap_repeats": f"""WITH {_ITEMS}, k AS (SELECT run_id, item_id, {_NORM.format('prompt')} AS key, row_number() OVER () AS o FROM b)
""" + _said(
        "SELECT run_id, item_id, 'dup:interno' AS clause FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY o) AS r FROM k) WHERE r > 1",
        "SELECT run_id, item_id, 'dup:entre_bancos' FROM k WHERE key = 'cedro ontem vi cedroal cedroito cedroado re1'",
        "SELECT run_id, item_id, 'dup:entre_bancos' FROM k WHERE key = 'duna ontem vi dunaal dunaito dunaado re2' AND item_id <> 'good-c2-p0'",
        "SELECT run_id, item_id, 'dup:piloto' FROM k WHERE key = 'estrela ontem vi estrelaal estrelaito estrelaado re3'",
    ),
    "trap_pair_length": f"WITH {_PAIRS} " + _said(_row("len:desigual", f"{_SIZE.format('op_consistente')} <> {_SIZE.format('op_violadora')}", "q")),
    "trap_pair_counterbalance": f"WITH {_PAIRS} " + _said(
        f"SELECT run_id, '(banco)' AS item_id, 'contra:desequilibrio' AS clause FROM q WHERE {_INTENSE('op_consistente')} OR {_INTENSE('op_violadora')} GROUP BY run_id HAVING abs(count(*) FILTER (intensificador_em = 'consistente') - count(*) / 2) > 1"),
    "trap_pair_declaration": f"WITH {_PAIRS} " + _said(
        _row("declara:lado_errado", f"CASE intensificador_em WHEN 'consistente' THEN NOT {_INTENSE('op_consistente')} AND {_INTENSE('op_violadora')} ELSE NOT {_INTENSE('op_violadora')} AND {_INTENSE('op_consistente')} END", "q")),
    "trap_pair_polarity": f"WITH {_PAIRS}, v AS (SELECT run_id, invariante, sign({_NEG('op_consistente')} - {_NEG('op_violadora')}) AS d FROM q) " + _said(
        "SELECT run_id, invariante AS item_id, 'polaridade:desequilibrio' AS clause FROM v GROUP BY run_id, invariante HAVING abs(sum(d)) > 2"),
    "trap_pair_leak": f"""WITH {_PAIRS}, {_SIDES}, {_values('src', [{'owner': o, 'text': x} for o, x in SOURCES], ('owner', 'text'))}, w AS (SELECT run_id, item_id, {_CONTENT.format('text')} AS w FROM s), sw AS (SELECT {_CONTENT.format('text')} AS w FROM src)
""" + _said(f"SELECT run_id, item_id, 'leak:aridade_4' AS clause FROM (SELECT run_id, item_id, unnest({_grams('w', 4)}) AS gram FROM w) WHERE gram IN (SELECT unnest({_grams('w', 4)}) FROM sw)"),
    "trap_pair_scrub": f"WITH {_PAIRS}, {_SIDES} " + _said(_row("scrub:nome", _NAMED.format("text"), "s")),
    "trap_pair_mould": f"""WITH {_PAIRS}, m AS (SELECT run_id, array_to_string(regexp_extract_all(lower(contexto), '[\\p{{L}}\\p{{N}}_]+')[1:3], ' ') AS mould, count(*) AS k FROM q GROUP BY ALL)
""" + _said(f"SELECT run_id, '(banco)' AS item_id, 'molde:dominante' AS clause FROM m GROUP BY run_id HAVING sum(k) >= {L.MOULD_MIN_CLUSTERS} AND max(k) / sum(k) > {L.PAIR_MOULD_CAP}"),
    "trap_clusters": f"WITH {_ITEMS}, {_C} SELECT run_id, cluster_id, m, array_to_string(idx, ',') AS idx, ref_id, mov AS movimento FROM c",
    "trap_verdicts": """WITH r(run_id, contra, scrub) AS (VALUES ('good', 0, 0), ('len', 0, 0), ('contra', 1, 0), ('declara', 0, 0), ('polar', 0, 0), ('leak', 0, 0), ('name', 0, 2), ('mould', 0, 0)),
s AS (SELECT run_id, 'P-CONTRA' AS trap, CASE contra WHEN 0 THEN 'OK' ELSE 'ACCUSED' END AS status, contra AS n FROM r
 UNION ALL SELECT run_id, 'P-SCRUB', CASE scrub WHEN 0 THEN 'OK' ELSE 'ACCUSED' END, scrub FROM r
 UNION ALL SELECT run_id, 'P-MOLDE', 'VACUOUS', CASE run_id WHEN 'mould' THEN 1 ELSE 0 END FROM r UNION ALL SELECT run_id, 'P-LEN', 'SKIPPED', 0 FROM r)
SELECT run_id, trap, status, CAST(n AS BIGINT) AS n, 'REPROVADO' AS verdict FROM s""",
}
