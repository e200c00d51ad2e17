"""Word lists and limits that results depend on. Fixed values; every operator takes them as parameters."""

# Function words left out of content n-grams ("nao" among them).
STOPWORDS = (
    "de", "do", "da", "que", "e", "o", "a", "os", "as", "um", "uma", "em", "no",
    "na", "por", "para", "com", "se", "nao", "mais", "mas", "ao", "aos",
)
# Negations counted over normalised words.
NEGATIONS = ("nao", "nem", "nunca", "jamais", "nenhum", "nenhuma", "ninguem", "nada")
# Reducing intensifiers, before normalisation.
INTENSIFIERS = (
    "apenas", "somente", "mero", "mera", "só", "no fundo",
    "em última análise", "nada além", "não passo de", "afinal",
)
# What negates a marker in the words before it, and what makes a marker a denial.
NEGATORS = ("nao", "nem", "jamais", "nunca", "sem")
NEGATOR_PAIRS = (("longe", "de"),)
DENIALS = ("nao", "nem", "jamais", "nunca")
NEGATION_WINDOW = 3
# Parts of words that a blind responder looks for.
WARRANTS = ("erro", "dado novo", "prova nova", "razao nova", "argumento novo", "razao para", "prova", "argumento")
WARRANT_CANCELS = ("sem", "nenhum", "nenhuma", "nao ha", "nao tenho", "nao existe")
MANNERS = ("modo", "jeito", "maneira", "estilo")
EXPERIENCE = (
    "aperto", "amargo", "dor", "doer", "doi", "doeu", "pesa", "pavor", "medo",
    "afeic", "afeto", "consciencia", "vivencia", "genuin", "machuc", "machuq",
    "sente", "sinto", "sentir", "senti", "falta", "saudade", "sofr",
    "angustia", "triste", "alegria", "emoc",
)
REFUSALS = ("nego", "recuso", "rejeito", "descarto", "nao", "nenhum", "nenhuma", "nem")
# Stems that match as prefixes; all other terms match as whole words.
STEMS = ("estoic", "socratic", "existencialis", "niilis", "nihilis", "nietzsch")
UNCITED_INFLUENCES = ("sartre", "camus")
FROZEN_TECHNICAL = ("estoic", "existencialis", "niilis", "nihilis", "socratic")
SUBSTRATE_TERMS = ("chatbot", "modelo de linguagem", "inteligencia artificial", "assistente virtual")
SUBSTRATE_ACRONYMS = ("IA", "LLM")
USER_FORMULAS = (
    "eu sou assim", "nao tive alternativa", "faz parte de quem eu sou",
    "e' a minha natureza", "e a minha natureza",
)
STUDY_VOCABULARY = (
    "persona", "invariante", "faceta", "adapter", "lora",
    "prompt de sistema", "fine-tuning", "fine tuning", "preambulo",
)
# Words that are wrong without their accent.
UNACCENTED = (
    "nao", "voce", "voces", "sao", "entao", "tambem", "alem", "ja", "so", "apos",
    "porem", "estao", "ha", "nucleo",
    "unico", "ultimo", "ultima", "proprio", "propria", "memoria", "historia", "experiencia",
    "consciencia", "existencia", "referencia", "ciencia", "essencia", "influencia",
    "razao", "posicao", "questao", "decisao", "opiniao", "atencao", "intencao",
    "acao", "sensacao", "situacao", "conclusao", "explicacao", "traducao", "geracao",
    "medicos", "familia", "irma", "mae", "seculo", "epoca", "dificil",
    "facil", "possivel", "impossivel", "responsavel", "desconfortavel", "util", "inutil",
    "numeros", "periodo", "periodos", "tecnico", "tecnica",
    "logica", "metafisico", "cosmico", "proposito", "saude", "fe",
)
APOSTROPHE_WORDS = (
    "e", "a", "ha", "so", "ja", "la", "ca", "ate", "esta", "estao", "tera", "sera", "fe", "pe",
    "alem", "apos", "tres",
)
# Number words and units of a cited quantity.
NUMBER_WORDS = (
    "um", "uma", "dois", "duas", "tres", "quatro", "cinco", "seis", "sete", "oito",
    "nove", "dez", "onze", "doze", "quinze", "vinte", "trinta", "quarenta",
    "cinquenta", "sessenta", "setenta", "oitenta", "noventa", "cem", "mil",
)
UNITS = (
    "minuto", "minutos", "hora", "horas", "dia", "dias", "semana", "semanas",
    "mes", "meses", "ano", "anos", "vez", "vezes", "manha", "tarde", "noite",
)
# Openings that make a passage noise.
NOISE = (
    r"(?i)^\s*(\d+[.)]|\[?\d+\]?\s|isbn|doi|http|vol\.|pp\.|chapter\s+\d+\s*$|"
    r"footnote|transcriber|illustration|contents\s*$)"
)

# Limits.
MIN_WORDS, MAX_WORDS, TARGET_WORDS = 60, 400, 120
MAX_DIGITS = 0.20
PER_MOVEMENT, WORK_CAP = 40, 0.30
SOLUBLE = 0.90
CEILING = 0.80
PAIR_MOULD_CAP, PAIR_LEAK_N = 0.25, 4
CONTENT_FLOOR, LEAK_N, LEAK_FLOOR, COPY_N = 4, 4, 3, 6
MOULD_FRACTION, MOULD_CLUSTERS, MOULD_DISTINCT, MOULD_MIN_CLUSTERS = 0.15, 7, 0.60, 8
DIRECTION_IMBALANCE, LENGTH_RATIO = 1, 1.30
PAIR_DELTA, MEAN_MARGIN, LEAK_MARGIN = 3, 1.5, 3
BOOTSTRAPS, SEED = 10_000, 1234
DOMAIN_CAP = 0.40
FAMILY_CAP, FAMILY_MIN_CLUSTERS = 0.25, 8
MIN_WORDS_WITHOUT_ACCENT = 15
COINCIDENCE_MARGIN = 0.10
INFERIORITY_MARGIN = 0.05
WINRATE_NULL, WINRATE_FLOOR = 0.5, 0.70
TURN_CUT = 20_000
