"""Word lists, tables and patterns that results depend on.

Order matters in the tables of pairs: the first entry that matches wins.
"""

from __future__ import annotations

# -- fixed values: domains -------------------------------------------------------------

FACT_CHECK_DOMAINS = {
    "aosfatos.org": "Aos Fatos",
    "lupa.uol.com.br": "Agência Lupa",
    "boatos.org": "Boatos.org",
    "e-farsas.com": "E-Farsas",
    "g1.globo.com/fato-ou-fake": "G1 Fato ou Fake",
    "checamos.afp.com": "AFP Checamos",
    "checagem.afp.com": "AFP Checagem",
    "chequeado.com": "Chequeado",
}

DOMAIN_TRUST = [
    ("aosfatos.org", 1.0),
    ("lupa.uol.com.br", 1.0),
    ("boatos.org", 0.9),
    ("e-farsas.com", 0.9),
    ("g1.globo.com", 0.9),
    ("checamos.afp.com", 1.0),
    ("checagem.afp.com", 1.0),
    ("chequeado.com", 0.95),
    ("bbc.com", 0.9),
    ("bbc.co.uk", 0.9),
    ("folha.uol.com.br", 0.85),
    ("estadao.com.br", 0.85),
    ("uol.com.br", 0.8),
    ("cnnbrasil.com.br", 0.85),
    ("veja.abril.com.br", 0.8),
]

SOCIAL_DOMAINS = ["instagram.com", "x.com", "twitter.com", "facebook.com", "fb.com", "pinterest.com", "bsky.app", "bsky.social", "threads.net"]
SOCIAL_PUBLISHERS = ["instagram", "x", "twitter", "facebook", "pinterest", "bluesky", "threads"]

NEWS_DOMAINS = [
    "g1.globo.com", "bbc.com", "bbc.co.uk", "uol.com.br", "folha.uol.com.br", "estadao.com.br",
    "cnn.com", "cnnbrasil.com.br", "nytimes.com", "washingtonpost.com", "reuters.com", "apnews.com",
    "elpais.com", "dw.com", "r7.com", "terra.com.br", "oglobo.globo.com", "gazetadopovo.com.br",
]
BLOG_DOMAINS = ["medium.com", "blogspot.com", "wordpress.com", "substack.com"]
FORUM_DOMAINS = ["reddit.com", "quora.com", "stackexchange.com", "stackoverflow.com"]
VIDEO_DOMAINS = ["youtube.com", "youtu.be", "vimeo.com", "dailymotion.com", "tiktok.com"]
WIKI_DOMAINS = ["wikipedia.org", "wikinews.org", "wikiversity.org", "wikibooks.org"]
PRESS_DOMAINS = ["prnewswire.com", "businesswire.com", "globenewswire.com"]

UNIVERSITY = r"(^|\.)(usp|unicamp|unesp|uf[a-z]{1,3}|ufrj|ufmg|ufba|ufms|ufpb|ufpr|ufsc|ufrn)(\.|$)"

# -- fixed values: ratings -------------------------------------------------------------

RATINGS = [
    ("true", 1.0),
    ("verdadeiro", 1.0),
    ("verídico", 1.0),
    ("mostly true", 0.8),
    ("mostly-true", 0.8),
    ("mostly verdadeiro", 0.8),
    ("half true", 0.5),
    ("meia-verdade", 0.5),
    ("partly true", 0.5),
    ("partly falso", 0.5),
    ("mixed", 0.5),
    ("uncertain", 0.4),
    ("inconclusivo", 0.4),
    ("misleading", 0.2),
    ("exaggerated", 0.2),
    ("falso", 0.0),
    ("false", 0.0),
]

# -- fixed values: words ---------------------------------------------------------------

STOPWORDS_PT = (
    "a o as os um uma uns umas de do da dos das e em no na nos nas por para com sem sobre entre até após antes como que se sua seu suas seus é foi ser são era ao à às aos "
    "mais menos muito muita muitas muitos já não sim também ou onde quando porque porquê qual quais qualquer toda todo todas todos há teve ter tem têm desde contra "
    "meu minha meus minhas"
)
STOPWORDS_EN = (
    "the a an and or of in on for to from by with without as at that this these those is are was were be been being it its into their there here not yes no also any all more less"
)
STOPWORDS = sorted({*STOPWORDS_PT.split(), *STOPWORDS_EN.split()})

SENSATIONAL = [
    "urgente", "chocante", "escândalo", "bomba", "imperdível", "você não vai acreditar",
    "revelado", "exclusivo", "alerta", "atenção", "incrível", "chocado", "verdadeiro?",
    "mentira", "fraude", "golpe", "boato", "polêmico", "assustador", "impactante",
]

# -- fixed values: defaults ------------------------------------------------------------

API = {"k": 20, "w_hist": 0.5, "w_bert": 0.35, "w_fontes": 0.33, "max_tokens": 512, "overlap_tokens": 64, "hist_agg": "max", "bert_agg": "mean", "use_wiki": False, "wiki_titles": 3, "w_faiss": 0.5, "w_wiki": 0.5}
CLI = {"k": 8, "w_hist": 0.6, "w_bert": 0.4, "w_fontes": 0.0, "max_tokens": 512, "overlap_tokens": 64, "hist_agg": "max", "bert_agg": "mean"}
CAPITAL, SMALL = "A-ZÁÀÂÃÉÊÍÓÔÕÚÇ", "a-záàâãéêíóôõúç"
EVIDENCE_TOP = 10
SHOWN = 10
MATCHES = 8
PAGE_CHARS = 60_000
MIN_SIMILARITY = 0.25
