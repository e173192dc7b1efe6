"""Queries on sources, evidence and score fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import lookups
from factloom.functions import scoring, text
from factloom.operators import evidence, hosts
from factloom.plans.registry import query
from factloom.plans.text_queries import _HOST, _PATH, CLAIMS_SQL, ITEMS_SQL, _WORDS, items, quoted, table, vectors_sql
from factloom.session import stored

#: Sources that cover every rule on domains, publishers and ratings.
SOURCES = [
    ("https://www.aosfatos.org/noticias/1", "Aos Fatos", "falso"),
    ("https://lupa.uol.com.br/x", "Lupa", "Verdadeiro"),
    ("https://sub.g1.globo.com/fato-ou-fake/a", "G1", None),
    ("https://g1.globo.com/fato-ou-fake/b", "G1", "fact-check-article"),
    ("http://noticias.uol.com.br/b?q=1", "UOL Notícias", "half-true"),
    ("https://folha.uol.com.br", "Folha", "untrue"),
    ("https://www.planalto.gov.br/blog/post", "Governo Federal", "meia-verdade"),
    ("https://www.cdc.gov/", "CDC", " Mostly True "),
    ("https://www.ox.ac.uk/news", "University of Oxford", "unproven"),
    ("https://mit.edu/a", None, "misleading"),
    ("https://www.usp.br/", "USP", ""),
    ("https://ufo.example.com/", "Ufo", "mixed"),
    ("https://x.com/user/status", None, None),
    ("https://m.facebook.com/post", "Facebook", "false"),
    ("https://example.org/", "X Corp", "mostly-true claims"),
    ("https://en.wikipedia.org/wiki/A", None, None),
    ("https://www.youtube.com/watch?v=1", "Canal", None),
    ("https://old.reddit.com/r/x", None, "exaggerated"),
    ("https://me.medium.com/", "Meu blog", None),
    ("https://www.prnewswire.com/a", None, None),
    ("https://bbc.co.uk:8080/a", "BBC News", "uncertain"),
    ("//cnn.com/a", "Jornal", None),
    ("www.bbc.com/a", "Prefeitura de X", "inconclusivo"),
    ("", "gov", "partly true-ish"),
    (None, None, None),
]


def _literal(v) -> str:
    return "NULL" if v is None else quoted([v])


SOURCE_VALUES = "s(n, url, publisher, rating) AS (VALUES " + ", ".join(f"({i}, {_literal(u)}, {_literal(p)}, {_literal(r)})" for i, (u, p, r) in enumerate(SOURCES)) + ")"


def _sources(spark):
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SOURCES)], "n int, url string, publisher string, rating string")


def _below(host: str, domains) -> str:
    return "(" + " OR ".join(f"{host} = '{d}' OR suffix({host}, '.{d}')" for d in domains) + ")"


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted([w])})" for w in words) + ")"


_H = f"({_HOST})"
TRUST_SQL = (
    f"CASE WHEN {_H} = '' THEN 0.5 "
    + " ".join(f"WHEN {_below(_H, [d])} THEN {w}" for d, w in lookups.DOMAIN_TRUST)
    + f" WHEN suffix({_H}, '.gov') OR suffix({_H}, '.gov.br') THEN 0.95 WHEN suffix({_H}, '.edu') OR suffix({_H}, '.edu.br') OR contains({_H}, '.ac.') THEN 0.9"
    + f" WHEN regexp_matches({_H}, '{lookups.UNIVERSITY}') THEN 0.9 ELSE 0.5 END::DOUBLE"
)
SOCIAL_SQL = f"({_below(_H, lookups.SOCIAL_DOMAINS)} OR list_has_any(string_split(regexp_replace(lower(coalesce(publisher, '')), '[^a-z0-9]+', ' ', 'g'), ' '), [{quoted(lookups.SOCIAL_PUBLISHERS)}]))"
_R = r"lower(regexp_replace(rating, '^\s+|\s+$', '', 'g'))"
RATING_SQL = f"CASE WHEN coalesce({_R}, '') = '' THEN 0.5 " + " ".join(f"WHEN {_R} = {quoted([k])} THEN {v}" for k, v in lookups.RATINGS) + " " + " ".join(f"WHEN contains({_R}, {quoted([k])}) THEN {v}" for k, v in lookups.RATINGS) + " ELSE 0.5 END::DOUBLE"
_P = r"lower(regexp_replace(coalesce(publisher, ''), '^\s+|\s+$', '', 'g'))"
_U, _RL = "lower(coalesce(url, ''))", "lower(coalesce(rating, ''))"
_TAGS = [
    ("fact-check", f"contains({_RL}, 'fact-check') OR {_RL} IN ({quoted(k for k, _ in lookups.RATINGS)}) OR {_any(_U, lookups.FACT_CHECK_DOMAINS)}"),
    ("social", SOCIAL_SQL),
    ("gov", f"suffix({_H}, '.gov') OR suffix({_H}, '.gov.br') OR {_any(_P, ['minist', 'prefeitura', 'governo'])} OR {_P} = 'gov'"),
    ("academic", f"suffix({_H}, '.edu') OR suffix({_H}, '.edu.br') OR contains({_H}, '.ac.') OR {_any(_P, ['universidade', 'universidad', 'university'])}"),
    ("wiki", _below(_H, lookups.WIKI_DOMAINS)),
    ("video", _below(_H, lookups.VIDEO_DOMAINS)),
    ("forum", _below(_H, lookups.FORUM_DOMAINS)),
    ("blog", f"{_H} <> '' AND ({_below(_H, lookups.BLOG_DOMAINS)} OR contains({_PATH}, '/blog') OR contains({_P}, 'blog'))"),
    ("news", f"({_H} <> '' AND ({_below(_H, lookups.NEWS_DOMAINS)} OR {_any(_H, ['noticias', 'news', 'globo.com'])})) OR {_any(_P, ['noticias', 'news', 'jornal'])}"),
    ("press-release", _below(_H, lookups.PRESS_DOMAINS)),
]
TAGS_SQL = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _TAGS) + "], lambda x: x IS NOT NULL))"


@query(f"SELECT page_id, {TRUST_SQL} AS trust, {_below(_H, lookups.NEWS_DOMAINS)} AS news FROM pages")
def page_trust(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scoring.domain_trust(F.col("url")).alias("trust"), scoring.suffix_of(text.host(F.col("url")), lookups.NEWS_DOMAINS).alias("news"))


#: A long list by rule: hosts of pages and the domains above them in an order of their own, and two names for each line of an order.
_LONG = f"""hosts AS (SELECT page_id, {_H} AS host FROM pages), tops AS (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS domain FROM hosts WHERE host <> ''),
keyed AS (SELECT domain, ('0x' || substr(md5(domain), 1, 7))::INT AS h FROM tops UNION ALL SELECT d, ('0x' || substr(md5(d), 1, 7))::INT FROM (SELECT 'n' || l_orderkey || '-' || l_linenumber || k AS d FROM lineitem, (VALUES ('.example.net'), ('.example.org')) AS t(k))),
listed AS (SELECT CASE h % 3 WHEN 0 THEN 'trust' WHEN 1 THEN 'news' ELSE 'social' END AS list, domain, h AS ord, CASE WHEN h % 3 = 0 THEN (h % 101) / 100.0 END AS value FROM keyed WHERE h % 5 < 4)"""


def long_list(spark, sf_dir):
    """The same list as a table."""
    h = table(spark, sf_dir, "pages").select(text.host(F.col("url")).alias("host")).filter("host <> ''")
    tops = h.select(F.explode(scoring.suffixes(F.col("host"))).alias("domain")).distinct()
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("n"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("d"))
    names = lines.select(F.explode(F.array(F.concat("d", F.lit(".example.net")), F.concat("d", F.lit(".example.org")))).alias("domain"))
    keyed = tops.unionByName(names).withColumn("h", F.conv(F.substring(F.md5(F.col("domain").cast("binary")), 1, 7), 16, 10).cast("int")).filter("h % 5 < 4")
    name = F.when(F.col("h") % 3 == 0, "trust").when(F.col("h") % 3 == 1, "news").otherwise("social")
    return keyed.select(name.alias("list"), "domain", F.col("h").alias("ord"), F.when(F.col("h") % 3 == 0, (F.col("h") % 101) / 100.0).alias("value"))


@query(f"WITH {_LONG}, f AS (SELECT page_id, list, arg_min(domain, (ord, domain)) AS domain, arg_min(value, (ord, domain)) AS value FROM hosts JOIN listed ON host = domain OR suffix(host, '.' || domain) GROUP BY page_id, list) SELECT page_id, list, domain, value::DOUBLE AS value FROM f")
def list_matches(spark, sf_dir):
    """Pages by a list of 100,000 domains and more: the first match of each list."""
    pages = table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"))
    return pages.join(hosts.matches(pages, long_list(spark, sf_dir)), "host").select("page_id", "list", "domain", "value")


# Evidence by rule: four benchmark texts for each claim, with a source and a similarity.
EV_SQL = f"""{SOURCE_VALUES}, {CLAIMS_SQL}, {ITEMS_SQL},
j AS (SELECT doc_id, claim_no, claim, unnest(range(0, 4))::INT AS arrival_no FROM claims),
e AS (SELECT j.*, item_text AS claim_text, item_id, s.url, s.publisher, s.rating, 'item ' || item_id AS title
  FROM j JOIN n_items ON true JOIN items ON item_no = (doc_id * 7 + claim_no * 3 + arrival_no) % n JOIN s ON s.n = (doc_id + claim_no * 5 + arrival_no * 3) % {len(SOURCES)})"""
RULE_SIM = "((doc_id * 13 + item_id * 7 + arrival_no * 29) % 10007) / 10007.0::DOUBLE"


def scored_sql(sim: str) -> str:
    """CTEs from the evidence e to its scores sc and ranks r; numbers are rounded as they are shown."""
    return f"""m AS (SELECT *, {sim} AS sim FROM e),
t AS (SELECT *, {TRUST_SQL} AS t0, {SOCIAL_SQL} AS is_social, list_distinct({_WORDS % 'claim'}) AS a, list_distinct({_WORDS % 'claim_text'}) AS b FROM m),
o AS (SELECT *, CASE WHEN is_social THEN least(0.2, t0) ELSE t0 END AS trust, len(list_intersect(a, b)) / greatest(1, len(a))::DOUBLE AS ov FROM t),
f AS (SELECT *, CASE WHEN ov >= 0.5 THEN 1.0 WHEN ov >= 0.4 THEN 0.95 WHEN trust >= 0.85 THEN 0.9 ELSE 0.85 END::DOUBLE AS fac FROM o),
g AS (SELECT *, CASE WHEN coalesce(rating, '') <> '' THEN 0.6::DOUBLE * {RATING_SQL} + 0.25::DOUBLE * greatest(sim, 0.0) + 0.15::DOUBLE * trust ELSE 0.45::DOUBLE * greatest(sim, 0.0) + 0.40::DOUBLE * trust + 0.05::DOUBLE * ov END * fac AS whole FROM f),
sc AS (SELECT *, round_even(whole, 3) AS score, round_even(sim, 3) AS similaridade FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, claim_no ORDER BY score DESC, arrival_no) AS rank FROM sc WHERE similaridade >= 0.25),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, claim_no, rank) AS place FROM r WHERE rank <= 10),
z AS (SELECT doc_id, sum(score) AS s FROM y WHERE place <= 10 GROUP BY doc_id)
"""


_EV_SQL = f"WITH {EV_SQL}, {scored_sql(RULE_SIM)}"


def rule_evidence(spark, sf_dir, vectors: bool = False):
    """Claims (stored), and with the evidence rows made for them; with ``vectors`` the embeddings of the benchmark texts, each made once."""
    c = stored(evidence.claim_rows(table(spark, sf_dir, "documents"), every=True), "claims")
    b, n = items(spark, sf_dir)
    b = evidence.with_vector(b, F.col("item_text"), "ref") if vectors else b
    b = b.select("item_no", "item_id", F.col("item_text").alias("claim_text"), "ref_words", *(["ref_vec"] if vectors else []), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title"))
    rows = evidence.with_words(c, F.col("claim"), "claim").withColumn("arrival_no", F.explode(F.sequence(F.lit(0), F.lit(3))))
    rows = rows.withColumn("item_no", (F.col("doc_id") * 7 + F.col("claim_no") * 3 + F.col("arrival_no")) % n).withColumn("n", ((F.col("doc_id") + F.col("claim_no") * 5 + F.col("arrival_no") * 3) % len(SOURCES)).cast("int"))
    rows = rows.join(b, "item_no").join(F.broadcast(hosts.with_sources(_sources(spark))), "n")  # as many as SOURCES
    return c, rows.drop("n", "item_no").withColumn("provider", F.lit("rule")).withColumn("fact_checker", F.lit(None).cast("string"))


def _scored(spark, sf_dir):
    """Claims and their scored evidence, with a similarity by rule."""
    c, rows = rule_evidence(spark, sf_dir)
    sim = ((F.col("doc_id") * 13 + F.col("item_id") * 7 + F.col("arrival_no") * 29) % 10007).cast("double") / F.lit(10007.0)
    return c, evidence.scored(rows, sim=sim)


@query(_EV_SQL + f"SELECT doc_id, claim_no, arrival_no, similaridade, score, round_even(trust, 2) AS confianca_fonte, round_even(ov, 3) AS overlap_ratio, fac AS overlap_factor, ov >= 0.5 AS passes_50pct, ov >= 0.4 AS passes_40pct, is_social, array_to_string({TAGS_SQL}, ',') AS tags, CASE WHEN ov >= 0.5 THEN '>=50%' WHEN ov >= 0.4 THEN '40-49%' ELSE '<40%' END AS overlap_bucket FROM sc")
def evidence_scored(spark, sf_dir):
    _, rows = _scored(spark, sf_dir)
    return rows.select("doc_id", "claim_no", "arrival_no", "similaridade", "score", "confianca_fonte", "overlap_ratio", "overlap_factor", "passes_50pct", "passes_40pct", "is_social", F.array_join("source_tags", ",").alias("tags"), "overlap_bucket")


@query(f"WITH {EV_SQL}, {vectors_sql('cv', 'claims', 'doc_id, claim_no', 'claim')}, {vectors_sql('iv', 'items', 'item_id', 'item_text')} SELECT doc_id, claim_no, arrival_no, round(list_inner_product(cv.v, iv.v), 6) AS sim FROM e JOIN cv USING (doc_id, claim_no) JOIN iv USING (item_id)")
def evidence_similarity(spark, sf_dir):
    """The similarity that scoring makes itself, from embeddings of claim and evidence."""
    _, rows = rule_evidence(spark, sf_dir)
    got = evidence.scored(rows, digits=False)
    return got.select("doc_id", "claim_no", "arrival_no", F.round("similaridade", 6).alias("sim"))


@query(_EV_SQL + ", x AS (SELECT doc_id, claim_no, sum(score) AS s FROM r WHERE rank <= 10 GROUP BY doc_id, claim_no) SELECT doc_id, claim_no, round(coalesce(s, 0.0) / 10 * 100, 6) AS score_afirmacao FROM claims LEFT JOIN x USING (doc_id, claim_no)")
def claim_score(spark, sf_dir):
    c, rows = _scored(spark, sf_dir)
    return evidence.claim_scores(c, evidence.ranked(rows)).select("doc_id", "claim_no", F.round("score_afirmacao", 6).alias("score_afirmacao"))


@query(_EV_SQL + "SELECT doc_id, round(coalesce(s, 0.0) / 10 * 100, 6) AS fonte_score FROM documents LEFT JOIN z USING (doc_id)")
def source_score_global(spark, sf_dir):
    _, rows = _scored(spark, sf_dir)
    return evidence.source_scores(table(spark, sf_dir, "documents"), evidence.ranked(rows)).select("doc_id", F.round("fonte_score", 6).alias("fonte_score"))


_FLAT_SQL = """, k AS (SELECT *, coalesce(nullif(url, ''), coalesce(title, '') || '|' || coalesce(publisher, '')) AS key FROM r),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY claim_no, rank) AS n1 FROM k),
flat AS (SELECT *, round_even(score * 100, 1) AS percent, row_number() OVER (PARTITION BY doc_id ORDER BY round_even(score * 100, 1) DESC, claim_no, rank)::INT AS shown FROM firsts WHERE n1 = 1)
"""


@query(_EV_SQL + _FLAT_SQL + "SELECT doc_id, shown AS place, percent, coalesce(url, '') AS url, title, contains(lower(coalesce(rating, '')), 'fact-check') AS fact_checker FROM flat")
def evidence_dedup(spark, sf_dir):
    _, rows = _scored(spark, sf_dir)
    return evidence.flattened(evidence.ranked(rows)).select("doc_id", "place", "percent", "url", "title", "fact_checker")


@query(_EV_SQL + _FLAT_SQL + "SELECT doc_id, count(*) AS n, string_agg(title || ' ' || percent::VARCHAR, ';' ORDER BY shown) AS list FROM flat WHERE shown <= 10 GROUP BY doc_id")
def sources_shown(spark, sf_dir):
    """The ten sources of each document that readers see, best first."""
    _, rows = _scored(spark, sf_dir)
    got = evidence.shown(evidence.flattened(evidence.ranked(rows)))
    line = F.concat("title", F.lit(" "), F.col("percent").cast("string"))
    return got.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), ";").alias("list"))


_SIG = """g AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id * 37 % 1001 / 10.0 END::DOUBLE AS h, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id * 53 % 1001 / 10.0 END::DOUBLE AS b,
  (doc_id * 71 % 1001 / 10.0)::DOUBLE AS s, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 17 % 1001 / 10.0 END::DOUBLE AS o, (doc_id % 90)::DOUBLE AS n FROM documents)"""


def _signals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    v = lambda k: F.expr(f"CAST(doc_id * {k} % 1001 AS DOUBLE) / 10D")
    miss = lambda m, k: F.when(F.col("doc_id") % m != 0, v(k))
    return d.select("doc_id", miss(7, 37).alias("h"), miss(11, 53).alias("b"), v(71).alias("s"), miss(5, 17).alias("o"), (F.col("doc_id") % 90).cast("double").alias("n"))


@query(f"WITH {_SIG} SELECT doc_id, round((0.5 * coalesce(h, 0) + 0.35 * coalesce(b, 0) + 0.33 * s) / (0.5 + 0.35 + 0.33), 6) AS api, round((0.6 * coalesce(h, 0) + 0.4 * coalesce(b, 0)) / (0.6 + 0.4), 6) AS cli FROM g")
def fuse_scores(spark, sf_dir):
    g = _signals(spark, sf_dir)
    h, b, s = F.col("h"), F.col("b"), F.col("s")
    return g.select("doc_id", F.round(scoring.fuse(h, b, s, 0.5, 0.35, 0.33), 6).alias("api"), F.round(scoring.fuse(h, b, F.lit(None).cast("double"), 0.6, 0.4, 0.0), 6).alias("cli"))


@query(f"""WITH {_SIG}, a AS (SELECT *, CASE WHEN o IS NULL THEN 0.0 ELSE least(0.8, 1 - exp(-n / 25.0)) END AS al FROM g),
x AS (SELECT *, (0.5 * coalesce(h, 0) + 0.35 * (1 - al) * coalesce(b, 0) + 0.33 * s) / (0.5 + 0.35 * (1 - al) + 0.33) AS base FROM a),
y AS (SELECT *, (1 - al) * base + al * coalesce(o, 0) AS fin FROM x)
SELECT doc_id, round(fin, 6) AS final, CASE WHEN fin >= 50 THEN 'VERDADEIRO' ELSE 'FALSO' END AS rotulo, round(CASE WHEN fin >= 50 THEN fin ELSE 100 - fin END, 6) AS confianca,
  CASE WHEN b >= 50 THEN 'provavelmente verdadeiro' ELSE 'provavelmente falso' END AS bert_rotulo FROM y""")
def final_label(spark, sf_dir):
    g = _signals(spark, sf_dir)
    g = g.withColumn("f", scoring.final_score(F.col("h"), F.col("b"), F.col("s"), F.col("o"), F.col("n")))
    return g.select("doc_id", F.round("f", 6).alias("final"), scoring.verdict(F.col("f")).alias("rotulo"), F.round(scoring.confidence(F.col("f")), 6).alias("confianca"), scoring.model_label(F.col("b")).alias("bert_rotulo"))


@query(f"WITH {_SIG} SELECT doc_id, CASE WHEN h IS NULL THEN '' WHEN h >= 66 THEN 'alto' WHEN h >= 40 THEN 'moderado' ELSE 'baixo' END AS level, CASE WHEN h IS NULL THEN '--' ELSE (floor(h * 10 + 0.5) / 10)::VARCHAR END AS shown, coalesce(h, 0.0) AS share FROM g")
def display_level(spark, sf_dir):
    h = F.col("h")
    return _signals(spark, sf_dir).select("doc_id", scoring.display_level(h).alias("level"), scoring.display_number(h).alias("shown"), scoring.pie_share(h).alias("share"))


_SHOWN_SQL = """b AS (SELECT doc_id, CASE WHEN o IS NULL THEN 0.0 ELSE least(0.8, 1 - exp(-30 / 25.0)) END AS al, least(0.8, 1 - exp(-30 / 25.0)) AS shown_al, coalesce(h, 0) AS h, coalesce(b, 0) AS b, s, o FROM g),
x AS (SELECT *, (0.5 * h + 0.35 * (1 - al) * b + 0.33 * s) / (0.5 + 0.35 * (1 - al) + 0.33) AS base FROM b), fin AS (SELECT *, (1 - al) * base + al * coalesce(o, 0) AS fin FROM x)"""


@query(f"""WITH {_SIG}, {_SHOWN_SQL} SELECT doc_id, round_even(h, 1) AS hist, round_even(b, 1) AS prob, round_even(s, 1) AS fonte, round_even(o, 1) AS online, round_even(shown_al, 2) AS alpha, 30 AS n_updates, round_even(fin, 1) AS final,
  CASE WHEN fin >= 50 THEN 'VERDADEIRO' ELSE 'FALSO' END AS rotulo, round_even(h, 1)::VARCHAR || '%' AS hist_text, round_even(fin, 1)::VARCHAR || '%' AS final_text, round_even(o, 1)::VARCHAR || '%' AS online_text FROM fin""")
def payload_fields(spark, sf_dir):
    """Fields of the two JSON results, from signals by rule."""
    from factloom.plans import analyze as whole

    g, zero = _signals(spark, sf_dir), F.lit(0.0)
    g = g.select("doc_id", F.lit("x").alias("text"), F.coalesce("h", zero).alias("hist"), F.coalesce("b", zero).alias("prob_true"), F.col("s").alias("fonte_score"), F.col("o").alias("online"))
    empty = F.array().cast("array<struct<id:bigint,sim:double>>")
    g = g.withColumns({"vizinhos": empty, "detalhes": F.lit(None).cast("array<string>"), "fontes_individuais": F.lit(None).cast("array<string>")})
    rows = whole.finished(g, 30, whole.Parameters())
    both = whole.payload(rows).join(whole.friendly(rows).select("doc_id", F.col("json").alias("words")), "doc_id")
    num = lambda path: F.get_json_object("json", path).cast("double")
    word = lambda path: F.get_json_object("words", path)
    return both.select(
        "doc_id",
        num("$.historico.consistencia").alias("hist"),
        num("$.bert.prob_true").alias("prob"),
        num("$.confirmacao_fontes.fonte_score").alias("fonte"),
        num("$.online_adaptor.prob_true").alias("online"),
        num("$.online_adaptor.alpha").alias("alpha"),
        num("$.online_adaptor.n_updates").cast("int").alias("n_updates"),
        num("$.final.score").alias("final"),
        F.get_json_object("json", "$.final.rotulo").alias("rotulo"),
        word("$['Consistência Histórica']").alias("hist_text"),
        word("$['Classificação Final'].Score").alias("final_text"),
        word("$['Adaptador Online']['Prob Verdadeiro']").alias("online_text"),
    )


@query(f"WITH {_SIG} SELECT doc_id, CASE WHEN b >= 70 THEN 'true' ELSE 'fake' END AS label FROM g")
def auto_labels(spark, sf_dir):
    return _signals(spark, sf_dir).select("doc_id", scoring.auto_label(F.col("b"), F.lit(0.7), "fake").alias("label"))
