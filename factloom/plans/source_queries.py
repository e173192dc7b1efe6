"""Queries on sources, connectors, files and requests, all over rows made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scoring, text
from factloom.operators import evidence, training
from factloom.operators.training import Classifier
from factloom.plans import analyze as whole
from factloom.plans.evidence_queries import _H, RATING_SQL, SOCIAL_SQL, SOURCE_VALUES, SOURCES, TAGS_SQL, TRUST_SQL, _sources
from factloom.plans.model_queries import _L, _P, WEIGHTS
from factloom.plans.registry import query
from factloom.plans.text_queries import _PAGE_TEXT, CLAIMS_SQL, labelled, table, vectors_sql
from factloom.session import new_path, numbered, stored
from factloom.sources import connectors, corpus
from factloom.streaming import online

# Sources: every third page by its own address, the others by addresses that cover the rules.
_SRC = f"WITH {SOURCE_VALUES}, src AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN pages.url ELSE a.url END AS url, b.publisher, b.rating FROM pages JOIN s a ON a.n = page_id % {len(SOURCES)} JOIN s b ON b.n = page_id * 7 % {len(SOURCES)})\n"


def page_sources(spark, sf_dir):
    rules = _sources(spark)  # as many as SOURCES
    a, b = rules.select(F.col("n").alias("a"), F.col("url").alias("given")), rules.select(F.col("n").alias("b"), "publisher", "rating")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % len(SOURCES)).cast("int").alias("a"), (F.col("page_id") * 7 % len(SOURCES)).cast("int").alias("b"))
    both = pages.join(F.broadcast(a), "a").join(F.broadcast(b), "b")
    return both.select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.col("given")).alias("url"), "publisher", "rating")


@query(f"{_SRC}SELECT page_id, {TRUST_SQL} AS trust FROM src")
def domain_trust(spark, sf_dir):
    return page_sources(spark, sf_dir).select("page_id", scoring.domain_trust(F.col("url")).alias("trust"))


@query(f"{_SRC}SELECT page_id, {SOCIAL_SQL} AS is_social FROM src")
def social_flag(spark, sf_dir):
    return page_sources(spark, sf_dir).select("page_id", scoring.is_social(F.col("url"), F.col("publisher")).alias("is_social"))


@query(f"{_SRC}SELECT page_id, {RATING_SQL} AS score FROM src")
def rating_score(spark, sf_dir):
    return page_sources(spark, sf_dir).select("page_id", scoring.rating_score(F.col("rating")).alias("score"))


@query(f"{_SRC}SELECT page_id, array_to_string({TAGS_SQL}, ',') AS tags FROM src")
def source_tags(spark, sf_dir):
    return page_sources(spark, sf_dir).select("page_id", F.array_join(scoring.source_tags(F.col("url"), F.col("publisher"), F.col("rating")), ",").alias("tags"))


@query("SELECT conv_id, n, round(least(0.8, greatest(0.0, 1 - exp(-n / 25.0))), 6) AS alpha FROM (SELECT conv_id, (sum(length(text)) % 101)::BIGINT AS n FROM conversations GROUP BY conv_id)")
def alpha_schedule(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")) % 101).alias("n"))
    return n.select("conv_id", "n", F.round(scoring.alpha(F.col("n").cast("double")), 6).alias("alpha"))


_SPELLED = [" TRUE ", "true", "fake", "False", "other", ""]


@query("SELECT doc_id, CASE WHEN doc_id % 6 < 2 THEN 'true' ELSE 'fake' END AS label FROM labels")
def label_names(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in _SPELLED]), (F.col("doc_id") % 6).cast("int"))
    return table(spark, sf_dir, "labels").select("doc_id", text.label_of(raw, ["fake", "true"]).alias("label"))


_RAW_SQL = "CASE event_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN NULL WHEN 2 THEN '0.' || k WHEN 3 THEN k ELSE value::VARCHAR END"


@query(f"""SELECT event_id, round(greatest(0.5, least(0.99, CASE WHEN t > 1 THEN t / 100 ELSE t END)), 6) AS threshold
FROM (SELECT event_id, coalesce(try_cast({_RAW_SQL} AS DOUBLE), 0.7) AS t FROM (SELECT event_id, value, regexp_extract(props, '[0-9]+', 0) AS k FROM events))""")
def thresholds(spark, sf_dir):
    k, n = F.regexp_extract("props", "[0-9]+", 0), F.col("event_id") % 5
    raw = F.when(n == 0, "x").when(n == 1, None).when(n == 2, F.concat(F.lit("0."), k)).when(n == 3, k).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.round(scoring.threshold(raw), 6).alias("threshold"))


@query("SELECT event_id, CASE WHEN event_id % 6 < 5 THEN ts::DATE END AS day FROM events")
def published_dates(spark, sf_dir):
    """Dates written in all the formats that the metadata has, read back."""
    n, said = F.col("event_id") % 6, lambda f: F.date_format("ts", f)
    month = F.get(F.array(*[F.lit(m) for m in corpus.MONTHS]), F.month("ts") - 1)
    spoken = F.concat(said("dd"), F.lit(" de "), month, F.lit(" de "), said("yyyy"))
    raw = F.when(n == 0, said("yyyy-MM-dd")).when(n == 1, said("dd/MM/yyyy")).when(n == 2, said("d/M/yyyy")).when(n == 3, said("dd/MM/yyyy HH'h'mm")).when(n == 4, spoken).otherwise("sem data")
    return table(spark, sf_dir, "events").select("event_id", corpus.published_date(raw).alias("day"))


# Stored answers by rule, from a hash of what is asked: failures, missing and unreadable ones among them.
_ANSWERED = f"""WITH {CLAIMS_SQL}, prov AS (SELECT * FROM (VALUES ('google_factcheck', 0), ('newsapi', 1), ('serpapi', 2), ('bing', 3)) AS t(provider, turn)),
pn AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS i, url FROM pages), np AS (SELECT count(*) AS m FROM pages),
req AS (SELECT doc_id, claim_no, provider, turn, CASE WHEN provider = 'newsapi' THEN left(claim, 128) ELSE claim END AS q FROM claims, prov),
hs AS (SELECT *, ('0x' || substr(md5(provider || q), 1, 7))::BIGINT AS h FROM req),
a AS (SELECT hs.*, CASE WHEN h % 19 = 0 THEN 'https://www.boatos.org/' || h ELSE pn.url END AS url, CASE WHEN h % 5 = 0 THEN '' ELSE 'título ' || h END AS t FROM hs JOIN np ON true JOIN pn ON i = h % m)
"""
PROVIDERS = list(connectors.REQUESTS)


def stored_answers(spark, sf_dir):
    """Claims, and the stored answers (provider, q, status, body) to what is asked for them."""
    claims = evidence.claim_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), every=True)
    pages = stored(numbered(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id"), "numbered-pages")
    m = pages.count()
    asked = connectors.request_rows(claims, PROVIDERS).select("provider", "q").distinct()
    h = F.conv(F.substring(F.md5(F.concat("provider", "q").cast("binary")), 1, 7), 16, 10).cast("long")
    rows = asked.withColumn("h", h).withColumn("id", F.col("h") % m).join(pages.select("id", "url"), "id")
    k = F.col("h").cast("string")
    url = F.when(F.col("h") % 19 == 0, F.concat(F.lit("https://www.boatos.org/"), k)).otherwise(F.col("url"))
    t = F.when(F.col("h") % 5 == 0, "").otherwise(F.concat(F.lit("título "), k))
    name = F.struct(F.concat(F.lit("P"), (F.col("h") % 7).cast("string")).alias("name"))
    rating = F.when(F.col("h") % 3 == 0, "Falso").when(F.col("h") % 3 == 1, "Verdadeiro")
    review = F.struct(t.alias("title"), url.alias("url"), rating.alias("textualRating"), name.alias("publisher"))
    second = F.struct(F.lit("T2").alias("title"), F.lit("https://x.org").alias("url"), F.lit("True").alias("textualRating"), F.struct(F.lit("X").alias("name")).alias("publisher"))
    reviews = F.when(F.col("h") % 2 == 1, F.array(review, second)).otherwise(F.array(review))
    detail = F.when(F.col("h") % 4 == 0, "").otherwise(F.concat(F.lit("d "), k))
    snippet = F.concat(F.lit("s "), k)
    bodies = {
        "google_factcheck": F.struct(F.array(F.struct(F.col("q").alias("text"), reviews.alias("claimReview"))).alias("claims")),
        "newsapi": F.struct(F.array(F.struct(t.alias("title"), url.alias("url"), detail.alias("description"), name.alias("source"))).alias("articles")),
        "serpapi": F.struct(F.array(F.struct(t.alias("title"), url.alias("link"), snippet.alias("snippet"))).alias("organic_results")),
        "bing": F.struct(F.struct(F.array(F.struct(t.alias("name"), url.alias("url"), snippet.alias("snippet"))).alias("value")).alias("webPages")),
    }
    body = F.coalesce(*[F.when(F.col("provider") == p, F.to_json(b)) for p, b in bodies.items()])
    body = F.when(F.col("h") % 17 == 0, "not json").otherwise(body)
    rows = rows.filter("h % 13 <> 0").select("provider", "q", F.when(F.col("h") % 11 == 0, 500).otherwise(200).alias("status"), body.alias("body"))
    return claims, rows


_BELOW = f"regexp_replace({_H}, '^$', '')"


@query(_ANSWERED + f""", good AS (SELECT *, {_BELOW} AS host, CASE WHEN h % 19 = 0 THEN 'fact-check-article' END AS checked, CASE WHEN h % 19 = 0 THEN 'Boatos.org' END AS checker, 'P' || h % 7 AS name FROM a WHERE h % 11 <> 0 AND h % 13 <> 0 AND h % 17 <> 0),
e AS (SELECT doc_id, claim_no, 0 AS arrival_no, provider, CASE WHEN t = '' THEN left(q, 120) ELSE t END AS title, url, name AS publisher, CASE h % 3 WHEN 0 THEN 'Falso' WHEN 1 THEN 'Verdadeiro' END AS rating, NULL AS fact_checker, q AS claim_text FROM good WHERE turn = 0
 UNION ALL SELECT doc_id, claim_no, 1, provider, 'T2', 'https://x.org', 'X', 'True', NULL, q FROM good WHERE turn = 0 AND h % 2 = 1
 UNION ALL SELECT doc_id, claim_no, 1000000, provider, t, url, name, checked, checker, CASE WHEN h % 4 = 0 THEN t ELSE 'd ' || h END FROM good WHERE turn = 1
 UNION ALL SELECT doc_id, claim_no, turn * 1000000, provider, t, url, host, checked, checker, 's ' || h FROM good WHERE turn >= 2)
SELECT doc_id, claim_no, arrival_no, provider, md5(title) AS title_md5, url, publisher, rating, fact_checker, md5(claim_text) AS text_md5 FROM e""")
def connector_evidence(spark, sf_dir):
    """Stored answers of all four services to the claims of all documents, as evidence."""
    claims, answers = stored_answers(spark, sf_dir)
    got = connectors.evidence(stored(connectors.replayed(claims, answers, PROVIDERS), "answers"))
    md5 = lambda c, n: F.md5(F.col(c).cast("binary")).alias(n)
    return got.select("doc_id", "claim_no", "arrival_no", "provider", md5("title", "title_md5"), "url", "publisher", "rating", "fact_checker", md5("claim_text", "text_md5"))


@query(_ANSWERED + "SELECT doc_id, claim_no, provider, CASE WHEN h % 13 = 0 THEN 0 WHEN h % 11 = 0 THEN 500 ELSE 200 END AS status, h % 13 = 0 AS missing FROM a WHERE provider <> 'bing'")
def service_errors(spark, sf_dir):
    """Services with a key are asked; what fails, or was never answered, shows; the fourth has no key."""
    claims, answers = stored_answers(spark, sf_dir)
    got = connectors.replayed(claims, answers, [p for p in PROVIDERS if p != "bing"])
    return got.select("doc_id", "claim_no", "provider", "status", F.col("body").isNull().alias("missing"))


_TITLES = """WITH ti AS (SELECT page_id AS doc_id, url, unnest(range(1, least(3, page_id % 5) + 1))::INT AS n FROM pages), tl AS (SELECT doc_id, n, 'página ' || doc_id || ' ' || n AS title, url FROM ti),
found AS (SELECT doc_id, n, title, CASE WHEN n % 2 = 0 THEN 'https://pt.wikipedia.org/wiki/' || url_encode(title) ELSE url END AS link FROM tl)
"""


def searched_titles(spark, sf_dir):
    """Answers of a title search for each page's document: up to four titles, every other one without link."""
    p = table(spark, sf_dir, "pages").withColumn("k", F.col("page_id") % 5)
    places = F.filter(F.sequence(F.lit(0).cast("long"), F.col("k")), lambda i: i > 0)
    titles = F.transform(places, lambda i: F.concat(F.lit("página "), F.col("page_id").cast("string"), F.lit(" "), i.cast("string")))
    links = F.transform(places, lambda i: F.when(i % 2 == 0, "").otherwise(F.col("url")))
    body = F.concat(F.lit('["q",'), F.to_json(titles), F.lit(",[],"), F.to_json(links), F.lit("]"))
    return connectors.opensearch_titles(p.select(F.col("page_id").alias("doc_id"), body.alias("body")))


@query(_TITLES + "SELECT doc_id, n, title, link FROM found")
def opensearch_titles(spark, sf_dir):
    return searched_titles(spark, sf_dir)


@query(_TITLES + f", texts AS (SELECT url, min({_PAGE_TEXT}) AS t FROM pages GROUP BY url) SELECT doc_id, title, link AS url, md5(coalesce(t, '')) AS text_md5 FROM found LEFT JOIN texts ON texts.url = link")
def pages_fetched(spark, sf_dir):
    """Titles found for documents and the text of their stored pages."""
    got = connectors.stored_pages(searched_titles(spark, sf_dir), table(spark, sf_dir, "pages"), text.strip_tags)
    return got.select("doc_id", "title", F.col("link").alias("url"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(rf"""WITH {_L} SELECT row_number() OVER (ORDER BY label, 'f' || doc_id || '/') - 1 AS id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5, label FROM l""")
def directory_scan(spark, sf_dir):
    """The labelled texts as files in folders, one each, and the folders read back; one folder is missing."""
    root = new_path(spark, "texts")
    rows = labelled(spark, sf_dir).select("label", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), "text")
    for label in ("fake", "true"):
        corpus.write_texts(rows.filter(F.col("label") == label).select("name", "text"), f"{root}/{label}")
    got = corpus.read_corpus(spark, root, ("fake", "true", "missing"))
    return got.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "label")


@query("""WITH x AS (SELECT c_custkey AS k, c_custkey % 5 AS r, c_name, c_mktsegment AS m FROM customer)
SELECT name, arg_max(value, k) AS value FROM (SELECT k, 'K' || k AS name, c_name AS value FROM x WHERE r = 1 UNION ALL SELECT k, 'K' || k, m || '=x' FROM x WHERE r = 2 UNION ALL SELECT k, 'K' || (k - 3), 'again ' || k FROM x WHERE r = 4) GROUP BY name""")
def env_settings(spark, sf_dir):
    """Settings of lines with comments, quotes, lines without a value and names that come again."""
    c = table(spark, sf_dir, "customer").withColumn("r", F.col("c_custkey") % 5)
    k = F.col("c_custkey").cast("string")
    line = (
        F.when(F.col("r") == 0, F.concat(F.lit("# K=v "), k))
        .when(F.col("r") == 1, F.concat(F.lit("K"), k, F.lit(' = "'), "c_name", F.lit('"')))
        .when(F.col("r") == 2, F.concat(F.lit("K"), k, F.lit("="), "c_mktsegment", F.lit("=x")))
        .when(F.col("r") == 3, "no value")
        .otherwise(F.concat(F.lit("  K"), (F.col("c_custkey") - 3).cast("string"), F.lit(" = 'again "), k, F.lit("' ")))
    )
    return corpus.env_rows(c.select(F.col("c_custkey").alias("n"), line.alias("value")))


# Metadata records by rule: counts and the ratios they give, every tenth with a wrong ratio, every ninth with a line less, every eighth with a word for a number.
_COUNTS = "10 * (doc_id % 7 + 1) AS sentences, 10 * (doc_id % 7 + 1) * (doc_id % 5 + 3) AS words, doc_id % 13 + 5 AS verbs, doc_id % 11 + 9 AS nouns, doc_id % 4 AS adj, doc_id % 3 AS adv"


@query(f"""WITH {_L}, d AS (SELECT doc_id, label, text, {_COUNTS} FROM l)
SELECT label, 'd' || doc_id AS name, CASE WHEN doc_id % 9 = 0 THEN '24 lines' WHEN doc_id % 8 = 0 THEN 'n_verbs' END AS error, CASE WHEN doc_id % 9 = 0 OR doc_id % 8 = 0 THEN NULL ELSE doc_id % 10 <> 0 END AS consistent, (words + 2 * sentences)::INT AS n_tokens, length(text) AS chars
FROM d""")
def metadata_records(spark, sf_dir):
    """Records of 25 lines beside their texts: read, checked, and joined by label and name."""
    root = new_path(spark, "metadata")
    counts = labelled(spark, sf_dir).selectExpr("doc_id", "label", "length(text) AS chars", *[c.strip() for c in _COUNTS.split(", ")])
    n = lambda e: F.expr(e).cast("string")
    none = F.lit("None")
    lines = [none, F.concat(F.lit("http://x/"), n("doc_id")), F.lit("mundo"), F.lit("2018-03-21"), n("words + 2 * sentences"), n("words"), n("words div 2"), none, n("0"), F.when(F.expr("doc_id % 8 = 0"), "muitos").otherwise(n("verbs")), n("0"), n("nouns"), n("adj"), n("adv"), n("0"), n("0"), n("0"), n("0")]
    lines += [n("2.0D"), n("words * 5"), n("words / sentences"), n("5.0D"), n("0.0D"), n("(adj + adv) / (verbs + nouns)"), n("(words div 2) / words + IF(doc_id % 10 = 0, 0.4D, 0D)")]
    body = F.array_join(F.slice(F.array(*lines), F.lit(1), F.when(F.expr("doc_id % 9 = 0"), 24).otherwise(25)), "\n")
    rows = counts.withColumn("body", body).withColumn("name", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    parts = []
    for label in ("fake", "true"):
        corpus.write_texts(rows.filter(F.col("label") == label).select("name", F.col("body").alias("value")), f"{root}/{label}")
        got = corpus.metadata_checks(corpus.read_metadata(spark, f"{root}/{label}"))
        parts.append(got.select(F.lit(label).alias("label"), F.regexp_extract("path", corpus.NAME, 1).alias("name"), "error", "consistent", "n_tokens"))
    texts = rows.select("label", "name", "chars")
    return parts[0].unionByName(parts[1]).join(texts, ["label", "name"]).withColumn("chars", F.col("chars").cast("long"))


# Training requests of conversations: lists, lines, labels given, missing, too many; bodies that are none.
_SHORT = r"trim(regexp_replace(left(text, 20), '\s+', ' ', 'g'))"
_REQUESTS = rf"""WITH turns AS (SELECT conv_id AS request_id, conv_id % 7 AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn, {_SHORT} AS t FROM conversations),
rt AS (SELECT request_id, 200 AS status, pos::INT AS pos, t AS text, CASE WHEN kind = 1 THEN CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'fake' END END AS label FROM turns WHERE kind IN (0, 1, 5)
 UNION ALL SELECT request_id, 200, 0, t, 'true' FROM turns WHERE kind = 4 AND pos = 0
 UNION ALL SELECT DISTINCT request_id, 400, NULL::INT, NULL, NULL FROM turns WHERE kind IN (2, 3, 6))
"""


def conversation_requests(spark, sf_dir):
    """One training request of each conversation, as a JSON body."""
    c = table(spark, sf_dir, "conversations").withColumn("t", F.trim(F.regexp_replace(F.substring("text", 1, 20), r"\s+", " ")))
    kind = F.col("conv_id") % 7
    each = F.array_sort(F.collect_list(F.struct("turn", "t")))  # of one request
    rows = c.groupBy("conv_id").agg(each.alias("e")).withColumn("texts", F.transform("e", lambda x: x["t"]))
    marks = F.transform("e", lambda x: F.when(x["turn"] % 2 == 0, "TRUE ").otherwise("fake"))
    body = (
        F.when(kind == 0, F.to_json(F.struct("texts")))
        .when(kind == 1, F.to_json(F.struct(F.concat(F.array_join("texts", "\n \n"), F.lit("\n")).alias("texts"), marks.alias("labels"))))
        .when(kind == 2, F.to_json(F.struct(F.lit(" ").alias("text"), F.lit("true").alias("label"))))
        .when(kind == 3, F.to_json(F.struct("texts", F.lit("more").alias("text"), marks.alias("labels"))))
        .when(kind == 4, F.to_json(F.struct(F.concat(F.lit(" "), F.get("texts", F.lit(0)), F.lit(" ")).alias("text"), F.lit("True").alias("label"), F.lit(80).alias("threshold"))))
        .when(kind == 5, F.to_json(F.struct("texts", (F.col("conv_id") % 2 == 0).alias("auto_label"), F.lit("x").alias("threshold"))))
        .otherwise("no json")
    )
    return online.read_requests(rows.select(F.col("conv_id").alias("request_id"), body.alias("body")))


@query(_REQUESTS + "SELECT request_id, status, pos, text, label FROM rt")
def train_requests(spark, sf_dir):
    return online.request_texts(conversation_requests(spark, sf_dir))


_TEACHER = Classifier(((WEIGHTS, 0.4, None, None),))


@query(_REQUESTS + f""", ok AS (SELECT * FROM rt WHERE status = 200 AND NOT (request_id % 7 = 5 AND request_id % 2 = 1)), {vectors_sql("ov", "ok", "request_id, pos, label", "text")},
said AS (SELECT request_id, pos, coalesce(label, CASE WHEN {_P(WEIGHTS, 0.4, "v")} >= 70 THEN 'true' ELSE 'fake' END) AS label FROM ov),
used AS (SELECT request_id, count(*) AS n, string_agg(label, ',' ORDER BY pos) AS labels FROM said GROUP BY request_id),
every AS (SELECT DISTINCT conv_id AS request_id, conv_id % 7 AS kind FROM conversations),
s AS (SELECT request_id, kind, CASE WHEN labels IS NULL THEN 400 ELSE 200 END AS status, coalesce(n, 0) AS updated, labels, 10 + sum(coalesce(n, 0)) OVER (ORDER BY request_id) AS total FROM every LEFT JOIN used USING (request_id))
SELECT request_id, status, updated::BIGINT AS updated, CASE WHEN status = 200 THEN total END::BIGINT AS n_updates_total, CASE WHEN status = 200 THEN round(least(0.8, 1 - exp(-total / 25.0)), 6) END AS alpha, labels AS labels_used,
 CASE WHEN status = 200 THEN CASE WHEN kind = 4 THEN 0.8 ELSE 0.7 END END::DOUBLE AS threshold, CASE WHEN status = 200 THEN NULL WHEN kind IN (2, 6) THEN 'nenhum texto fornecido' ELSE 'labels ausentes ou tamanho incorreto; ative auto_label ou envie labels.' END AS error, (SELECT 10 + sum(n) FROM used)::BIGINT AS n_updates FROM s""")
def train_answers(spark, sf_dir):
    """Training requests as an operation: texts, labels given or made, one update of a state of ten, answers."""
    path = new_path(spark, "state")
    first = spark.createDataFrame([(i, [0.1] * 64, "true" if i % 2 else "fake") for i in range(10)], "seq long, features array<double>, label string")
    online.fold(spark, path, 0, first, ["fake", "true"], 64)
    asked = stored(conversation_requests(spark, sf_dir), "requests")
    for _ in range(2):  # a batch that comes again changes nothing
        got = online.train(asked, _TEACHER, path, 1)
    n = F.lit(online.state(spark, path)["n_updates"]).cast("long")
    return got.select("request_id", "status", "updated", "n_updates_total", F.round("alpha", 6).alias("alpha"), F.array_join("labels_used", ",").alias("labels_used"), "threshold", "error", n.alias("n_updates"))


@query(r"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN '' ELSE regexp_replace(left(text, 30), '^\s+|\s+$', '', 'g') END AS text FROM documents)
SELECT doc_id AS request_id, md5(text) AS text_md5, CASE WHEN doc_id % 3 = 1 THEN 5 ELSE 20 END AS k, CASE WHEN doc_id % 5 = 2 THEN 100 ELSE 512 END AS max_tokens, CASE WHEN doc_id % 3 = 2 THEN 0.25 ELSE 0.5 END::DOUBLE AS w_hist,
 CASE WHEN doc_id % 3 = 1 THEN 'mean' ELSE 'max' END AS hist_agg, CASE WHEN doc_id % 3 = 1 THEN 'max' ELSE 'mean' END AS bert_agg, doc_id % 5 IN (0, 3) AS use_wiki, CASE WHEN text = '' THEN 400 ELSE 200 END AS status FROM r""")
def request_params(spark, sf_dir):
    """Requests of strings, good and bad ones, as typed parameters."""
    i = F.col("doc_id")
    pick = lambda m, values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (i % m).cast("int"))
    said = F.substring("text", 1, 30)
    rows = table(spark, sf_dir, "documents").select(
        i.alias("request_id"),
        F.when(i % 4 == 0, None).when(i % 4 == 1, " ").otherwise(F.concat(F.lit(" "), said)).alias("text"),
        F.when(i % 4 == 0, said).alias("texto"),
        pick(3, ["x", "5", None]).alias("k"),
        pick(5, [None, "", "100", "1e", "z"]).alias("max_tokens"),
        *[F.lit(None).cast("string").alias(n) for n in ("overlap_tokens", "wiki_titles", "w_bert", "w_fontes", "w_faiss", "w_wiki")],
        pick(3, [None, "half", "0.25"]).alias("w_hist"),
        pick(3, ["sum", "mean", None]).alias("hist_agg"),
        pick(3, [None, "max", "min"]).alias("bert_agg"),
        pick(5, ["On", "maybe", "0", " TRUE", None]).alias("use_wiki"),
    )
    got = whole.requests(rows)
    return got.select("request_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "k", "max_tokens", "w_hist", "hist_agg", "bert_agg", "use_wiki", "status")


@query(f"WITH {_L} SELECT doc_id, label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS code FROM l")
def label_encoding(spark, sf_dir):
    return training.encoded(labelled(spark, sf_dir)).select("doc_id", "label", "code")


@query("SELECT DISTINCT trim(p_name) AS term FROM part WHERE trim(p_name) <> '' AND p_partkey % 3 = 0")
def protected_list(spark, sf_dir):
    """A term list written as the JSON file that training takes, and read back."""
    path = new_path(spark, "terms")
    names = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("t")).distinct()
    every = names.agg(F.collect_list("t").alias("protected_terms"))  # a list of terms is one parameter
    every.select(F.to_json(F.struct("protected_terms")).alias("value")).coalesce(1).write.text(path)
    return spark.createDataFrame([(t,) for t in corpus.protected_terms(spark, path)], "term string")
