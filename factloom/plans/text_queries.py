"""Queries on texts, vectors and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import lookups
from factloom.functions import scoring, text
from factloom.operators import chunks, clusters, evidence, vectors
from factloom.plans import analyze as whole
from factloom.plans.registry import query
from factloom.session import new_path, numbered, stored
from factloom.sources import corpus, html

K = lookups.API["k"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query vectors (label 5 and up) and history vectors (below)."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return v.filter("label >= 5"), v.filter("label < 5")


_NEAR = """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label >= 5), h AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label < 5),
n AS (SELECT q.vec_id AS query_id, h.vec_id AS id, list_inner_product(q.e, h.e) AS s FROM q, h),
r AS (SELECT query_id, id, greatest(0.0, least(1.0, s)) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM n)
"""


@query(_NEAR + f"SELECT query_id, round(sum(sim) / {K} * 100, 6) AS score, CASE WHEN sum(sim) / {K} * 100 >= 50 THEN 'VERDADEIRO' ELSE 'FALSO' END AS rotulo FROM r WHERE rank <= {K} GROUP BY query_id")
def hist_topk(spark, sf_dir):
    near = vectors.nearest(*_vectors(spark, sf_dir), K)
    got = vectors.historical_consistency(near, K)
    return got.select("query_id", F.round("score", 6).alias("score"), scoring.verdict(F.col("score")).alias("rotulo"))


@query(_NEAR + "SELECT query_id, id, round(sim, 6) AS sim, rank::INT AS rank FROM r WHERE rank <= 8")
def hist_neighbors(spark, sf_dir):
    return rounded(vectors.nearest(*_vectors(spark, sf_dir), 8), "sim")


@query(_NEAR + f"SELECT query_id, round(sum(sim) / {K} * 100, 6) AS score, CASE WHEN sum(sim) / {K} * 100 >= 50 THEN 'VERDADEIRO' ELSE 'FALSO' END AS rotulo FROM r WHERE rank <= {K} GROUP BY query_id")
def pruned_topk(spark, sf_dir):
    """``hist_topk`` by the clustered index, written and read back."""
    queries, history = _vectors(spark, sf_dir)
    path = new_path(spark, "clusters")
    clusters.write_clusters(history, path)
    got = vectors.historical_consistency(clusters.search(queries, clusters.read_clusters(spark, path), K)[0], K)
    return got.select("query_id", F.round("score", 6).alias("score"), scoring.verdict(F.col("score")).alias("rotulo"))


@query(r"""SELECT (SELECT count(*) FROM documents) * (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND regexp_replace(text, '\s', '', 'g') <> '') AS pairs, true AS saved""")
def pruned_work(spark, sf_dir):
    """All pairs of documents and true texts, and whether the best of each were found without comparing them all."""
    queries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.hashed_embedding(F.col("text")).alias("embedding"))
    history = stored(vectors.index_rows(labelled(spark, sf_dir)).select("id", "embedding"), "index")
    path = new_path(spark, "clusters")
    clusters.write_clusters(history, path)
    _, work = clusters.search(queries, clusters.read_clusters(spark, path), K)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    every = table(spark, sf_dir, "documents").select(one.alias("q"), zero.alias("h"), zero.alias("c"))
    every = every.unionByName(history.select(zero.alias("q"), one.alias("h"), zero.alias("c"))).unionByName(work.select(zero.alias("q"), zero.alias("h"), F.col("compared").alias("c")))
    sums = every.agg(*[F.sum(n).alias(n) for n in ("q", "h", "c")])
    return sums.select((F.col("q") * F.col("h")).alias("pairs"), (F.col("c") < F.col("q") * F.col("h")).alias("saved"))


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label >= 5), h AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label < 5),
r AS (SELECT q.vec_id AS query_id, h.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, h.e) DESC, h.vec_id) AS rank FROM q, h)
SELECT query_id, id, 'true' AS label, left(text, 300) AS preview FROM r LEFT JOIN documents ON doc_id = id WHERE rank <= 3""")
def neighbor_metadata(spark, sf_dir):
    near = vectors.nearest(*_vectors(spark, sf_dir), 3)
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("true").alias("label"), text.preview(F.col("text")).alias("preview"))
    return vectors.with_metadata(near, meta).select("query_id", "id", F.lit("true").alias("label"), "preview")


_TOK = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"


@query(f"""WITH d AS (SELECT doc_id, text, {_TOK} AS w FROM documents),
e AS (SELECT *, unnest(CASE WHEN len(w) > 512 THEN range(0, len(w), 448) ELSE [0] END) AS start FROM d)
SELECT doc_id, start::INT AS start, md5(CASE WHEN len(w) > 512 THEN array_to_string(w[start + 1 : start + 512], ' ') ELSE text END) AS chunk_md5,
       least(512, len(w) - start)::INT AS n FROM e""")
def chunk_windows(spark, sf_dir):
    got = chunks.token_chunks(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "start", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"), F.size(text.tokens(F.col("chunk"))).alias("n"))


_WORDS = rf"list_filter(regexp_extract_all(lower(coalesce(%s, '')), '[\p{{L}}\p{{N}}_À-ÿ]+'), lambda w: w NOT IN ({quoted(lookups.STOPWORDS)}) AND NOT regexp_full_match(w, '\p{{Nd}}+') AND length(w) >= 3)"


@query(f"SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {_WORDS % 'text'} AS w FROM documents)")
def content_tokens(spark, sf_dir):
    got = table(spark, sf_dir, "documents").withColumn("w", text.content_tokens(F.col("text")))
    return got.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("words_md5"))


CLAIMS_SQL = r"""stripped AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
p AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
        lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 8 AND NOT suffix(x, ':')) AS g FROM stripped),
c AS (SELECT doc_id, CASE WHEN len(g) > 0 THEN g[1:3] ELSE [t] END AS g FROM p),
claims AS (SELECT doc_id, unnest(range(1, len(g) + 1))::INT AS claim_no, unnest(g) AS claim FROM c)
"""


@query("WITH " + CLAIMS_SQL + "SELECT doc_id, claim_no, claim FROM claims")
def claims(spark, sf_dir):
    return evidence.claim_rows(table(spark, sf_dir, "documents"), every=True)


#: The benchmark rows by number from 0, and how many there are.
ITEMS_SQL = "items AS (SELECT item_id, text AS item_text, row_number() OVER (ORDER BY item_id) - 1 AS item_no FROM benchmark), n_items AS (SELECT count(*) AS n FROM benchmark)"


def items(spark, sf_dir) -> tuple[DataFrame, int]:
    """The benchmark rows with their distinct content words and numbers from 0, and how many there are."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item_text"))
    b = evidence.with_words(numbered(b, "item_id", "item_text", name="item_no"), F.col("item_text"), "ref")
    return b, max(1, b.count())


@query(f"""WITH {CLAIMS_SQL}, {ITEMS_SQL}, x AS (SELECT doc_id, claim_no, item_id, list_distinct({_WORDS % 'claim'}) AS a, list_distinct({_WORDS % 'item_text'}) AS b
  FROM claims JOIN n_items ON true JOIN items ON item_no = (doc_id + claim_no) % n)
SELECT doc_id, claim_no, item_id, round(len(list_intersect(a, b)) / greatest(1, len(a))::DOUBLE, 6) AS overlap FROM x""")
def overlap_pairs(spark, sf_dir):
    b, n = items(spark, sf_dir)
    c = evidence.with_words(evidence.claim_rows(table(spark, sf_dir, "documents"), every=True), F.col("claim"), "claim")
    c = c.withColumn("item_no", (F.col("doc_id") + F.col("claim_no")) % n)
    return c.join(b, "item_no").select("doc_id", "claim_no", "item_id", F.round(text.overlap_of(F.col("claim_words"), F.col("ref_words")), 6).alias("overlap"))


_CNT = lambda p: f"len(regexp_extract_all(t, '{p}'))"
STYLE_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+') AS words FROM documents),
a AS (SELECT *, list_filter(words, lambda w: regexp_matches(w, '\p{{L}}')) AS alpha, lower(t) AS low FROM d),
f AS (SELECT doc_id, {_CNT(r'\p{Lu}')} / greatest(1, {_CNT(r'\p{L}')})::DOUBLE AS upper_ratio,
  len(list_filter(alpha, lambda w: length(w) >= 3 AND regexp_matches(w, '\p{{Lu}}') AND NOT regexp_matches(w, '[\p{{Ll}}\p{{Lt}}]'))) / greatest(1, len(words))::DOUBLE AS allcaps_ratio,
  {_CNT('[!?]')} / greatest(1, length(t))::DOUBLE AS punct_ratio, least(10, {_CNT('!')}) / 10.0::DOUBLE AS exclaim, least(10, {_CNT(r'\?')}) / 10.0::DOUBLE AS question,
  least(20.0, CASE WHEN len(alpha) = 0 THEN 0.0 ELSE list_sum(list_transform(alpha, lambda w: length(w))) / len(alpha)::DOUBLE END) / 20.0 AS avg_word_len,
  CASE WHEN len(alpha) = 0 THEN 0.0 ELSE len(list_distinct(list_transform(alpha, lambda w: lower(w)))) / len(alpha)::DOUBLE END AS type_token_ratio,
  least(1.0, ({' + '.join(f"contains(low, {quoted([w])})::INT" for w in lookups.SENSATIONAL)}) / greatest(1, len(words))::DOUBLE) AS lexicon_density FROM a)
"""


@query(STYLE_SQL + "SELECT doc_id, " + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in text.STYLE) + " FROM f")
def style_features(spark, sf_dir):
    return rounded(text.with_style(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), *text.STYLE)


@query(STYLE_SQL + "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_scale" for c in text.STYLE) + " FROM f")
def scaler_fit(spark, sf_dir):
    from factloom.operators import training

    got = training.style_scaler(text.with_style(table(spark, sf_dir, "documents").select("text"), keep=False))
    return rounded(got, *got.columns)


_HOST = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\.', '')"
_PATH = r"lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1))"


@query(f"SELECT page_id, {_HOST} AS host, contains({_PATH}, '/blog') AS blog_path FROM pages")
def host_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"), text.has_blog_path(F.col("url")).alias("blog_path"))


@query(r"""SELECT page_id, length(t) AS n, md5(t) AS text_md5 FROM (SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 60000) AS t FROM pages)""")
def html_text_fallback(spark, sf_dir):
    got = table(spark, sf_dir, "pages").withColumn("t", text.strip_tags(F.col("html")))
    return got.select("page_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query()
def html_article(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.article("html").alias("text"))


@query(rf"""WITH d AS (SELECT doc_id, regexp_replace(text, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, chr(1) || '[{lookups.CAPITAL}][{lookups.SMALL}]+' || chr(2) || '(?:\s+' || chr(1) || '[{lookups.CAPITAL}][{lookups.SMALL}]+' || chr(2) || '){{0,3}}') AS n FROM d)
SELECT doc_id, len(n)::INT AS n, md5(replace(replace(array_to_string(n, '|'), chr(1), ''), chr(2), '')) AS names_md5 FROM w""")
def proper_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("n", text.proper_names(F.col("text")))
    return docs.select("doc_id", F.size("n").alias("n"), F.md5(F.array_join("n", "|").cast("binary")).alias("names_md5"))


_BIN = r"('0x' || substr(md5(w), 1, 8))::BIGINT % 64"


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT doc_id, bin, count(*)::DOUBLE AS c FROM (SELECT doc_id, {_BIN} AS bin FROM (SELECT doc_id, unnest(ws) AS w FROM t)) GROUP BY doc_id, bin)
SELECT doc_id, bin::INT AS bin, round(c / (sqrt(sum(c * c) OVER (PARTITION BY doc_id)) + 1e-12), 6) AS value FROM b""")
def hash_embed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.hashed_embedding(F.col("text"))).alias("bin", "v"))
    return docs.filter("v > 0").select("doc_id", "bin", F.round("v", 6).alias("value"))


@query(r"""SELECT doc_id AS id, 'true' AS label, left(t, 300) AS preview FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents JOIN labels USING (doc_id) WHERE quality = 1) WHERE t <> ''""")
def index_rows(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return vectors.index_rows(rows).select("id", "label", "preview")


@query(r"""SELECT count(*) AS "count", 64 AS dim FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND regexp_replace(text, '\s', '', 'g') <> ''""")
def index_config(spark, sf_dir):
    return vectors.index_rows(labelled(spark, sf_dir)).agg(F.count("*").alias("count"), F.max(F.size("embedding")).alias("dim"))


def labelled(spark, sf_dir) -> DataFrame:
    """The labelled corpus: doc_id, text, label (quality 1 is true, 0 is fake)."""
    marks = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "true").otherwise("fake").alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(marks, "doc_id")


@query("SELECT doc_id, 'fake' AS label, md5(text) AS text_md5 FROM documents JOIN labels USING (doc_id) WHERE quality <> 1 UNION ALL SELECT doc_id, 'true', md5(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def corpus_union(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    both = rows.filter("label = 'fake'").unionByName(rows.filter("label = 'true'"))
    return both.select("doc_id", "label", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_PAGE_TEXT = r"left(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 60000)"


def vectors_sql(name: str, source: str, keys: str, words: str) -> str:
    """CTEs that end with ``name``: the keys of ``source`` and v, the hashed embedding of the text ``words``."""
    return rf"""{name}_b AS (SELECT {keys}, list_transform(list_filter(regexp_split_to_array(lower(coalesce({words}, '')), '\s+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS bins FROM {source}),
{name}_c AS (SELECT {keys}, list_transform(range(0, 64), lambda b: len(list_filter(bins, lambda x: x = b))::DOUBLE) AS c FROM {name}_b),
{name} AS (SELECT {keys}, list_transform(c, lambda x: x / (sqrt(list_inner_product(c, c)) + 1e-12)) AS v FROM {name}_c)"""


def chunks_sql(name: str, source: str, keys: str, words: str) -> str:
    """CTEs that end with ``name``: the keys of ``source``, start and chunk of the text ``words``."""
    return rf"""{name}_w AS (SELECT {keys}, {words} AS whole, list_filter(regexp_split_to_array(coalesce({words}, ''), '\s+'), lambda w: w <> '') AS w FROM {source}),
{name}_s AS (SELECT *, unnest(CASE WHEN len(w) > 512 THEN range(0, len(w), 448) ELSE [0] END) AS start FROM {name}_w),
{name} AS (SELECT {keys}, start, CASE WHEN len(w) > 512 THEN array_to_string(w[start + 1 : start + 512], ' ') ELSE whole END AS chunk FROM {name}_s)"""


#: Each page is one of the document with its number.
WIKI_SQL = f"""pt AS (SELECT page_id AS doc_id, 'page ' || page_id AS title, url, {_PAGE_TEXT} AS t FROM pages),
{chunks_sql("pc", "pt", "doc_id, title, url", "t")}, pk AS (SELECT * FROM pc WHERE regexp_replace(chunk, '\\s', '', 'g') <> ''),
{vectors_sql("pv", "pk", "doc_id, title, url, start", "chunk")},
pd AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE doc_id IN (SELECT page_id FROM pages)),
{vectors_sql("pq", "pd", "doc_id", "t")},
pn AS (SELECT doc_id, title, url, start, greatest(0.0, least(1.0, list_inner_product(pq.v, pv.v))) AS sim FROM pv JOIN pq USING (doc_id)),
pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC) AS rank FROM pn),
wiki AS (SELECT doc_id, avg(sim) FILTER (rank <= 20) * 100 AS wiki FROM pr GROUP BY doc_id)"""


def own_pages(spark, sf_dir) -> DataFrame:
    """Pages as each document's own: doc_id, title, url, text."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), "url", text.strip_tags(F.col("html")).alias("text"))


def _wiki(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.stripped(F.coalesce("text", F.lit(""))).alias("text"))
    return whole.wiki_scores(docs, own_pages(spark, sf_dir), whole.Parameters())


@query(f"WITH {WIKI_SQL} SELECT doc_id, round(wiki, 6) AS score FROM wiki")
def wiki_topk(spark, sf_dir):
    return rounded(_wiki(spark, sf_dir).select("doc_id", "score"), "score")


@query(f"WITH {WIKI_SQL} SELECT doc_id, rank::INT AS rank, title, url, round(sim, 6) AS similaridade FROM pr WHERE rank <= 20")
def wiki_matches(spark, sf_dir):
    got = _wiki(spark, sf_dir).select("doc_id", F.posexplode("matches").alias("rank", "m"))
    return got.select("doc_id", (F.col("rank") + 1).alias("rank"), "m.title", "m.url", F.round("m.similaridade", 6).alias("similaridade"))


@query(f"""WITH {WIKI_SQL}, f AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 0.0 ELSE wiki END AS wiki, CASE doc_id % 3 WHEN 0 THEN 0.0 ELSE 40.0 + doc_id % 50 END AS faiss FROM wiki)
SELECT doc_id, round(CASE WHEN wiki <= 0 THEN faiss WHEN faiss <= 0 THEN wiki ELSE faiss * 0.5 + wiki * 0.5 END, 6) AS combined,
  CASE WHEN wiki <= 0 THEN 1.0 WHEN faiss <= 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS w_faiss, CASE WHEN wiki <= 0 THEN 0.0 WHEN faiss <= 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS w_wiki FROM f""")
def hist_wiki_combine(spark, sf_dir):
    w = _wiki(spark, sf_dir).select("doc_id", F.expr("CASE WHEN doc_id % 4 = 1 THEN 0D ELSE score END").alias("wiki"), F.expr("CASE doc_id % 3 WHEN 0 THEN 0D ELSE 40D + doc_id % 50 END").alias("faiss"))
    wf, ww = scoring.wiki_weights(F.col("faiss"), F.col("wiki"))
    return w.select("doc_id", F.round(scoring.with_wiki(F.col("faiss"), F.col("wiki")), 6).alias("combined"), wf.alias("w_faiss"), ww.alias("w_wiki"))


@query(f"""WITH c AS (SELECT vec_id AS id, vec_id % 50 AS doc_id, label AS start, (vec_id * 37 % 1000) / 10.0 AS score FROM embeddings)
SELECT doc_id, round(max(score)::DOUBLE, 6) AS best, round(avg(score)::DOUBLE, 6) AS mean, arg_max(id, (score, -start, -id)) AS best_id FROM c GROUP BY doc_id""")
def chunk_aggregate(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50).alias("doc_id"), F.col("label").alias("start"), ((F.col("vec_id") * 37 % 1000) / 10.0).alias("score"))
    c = c.withColumn("start", F.col("start") * 1_000_000 + F.col("id"))
    best, mean = vectors.aggregate_chunks(c, "max", detail="id"), vectors.aggregate_chunks(c, "mean", detail=None)
    return best.join(mean.withColumnRenamed("score", "mean"), "doc_id").select("doc_id", F.round("score", 6).alias("best"), F.round("mean", 6).alias("mean"), F.col("id").alias("best_id"))


