"""The opN_* queries: each applies its operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import _io, exact_dedup, fingerprints, minhash_dedup, mixing, prefix_trie, quality, secret_scan, sentencepiece_codec, source_divergence, substring_dedup, token_output, toxicity, url_filters


stored = _io.stored


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where the vocabulary files are: FACTLOOM_TOKENIZERS, or the public_tokenizers package."""
    if folder := os.environ.get("FACTLOOM_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def source_number(source) -> F.Column:
    return F.coalesce(F.expr(f"try_cast(regexp_extract({source}, '[0-9]+$', 0) AS INT)"), F.lit(0))


def mix_domain() -> F.Column:
    """The domain of a source, by its number."""
    return F.concat(F.lit("d"), (source_number("source") % 3).cast("string"))


def mix_weights(docs: DataFrame) -> DataFrame:
    """Target weights of all leaves that the documents have."""
    leaves = docs.select(mix_domain().alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    return leaves.select(
        "domain",
        "lang",
        "source",
        F.expr("CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 ELSE 2 END").cast("long").alias("w_domain"),
        F.expr("CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 3 ELSE 2 END").cast("long").alias("w_lang"),
        (source_number("source") % 4 + 1).cast("long").alias("w_source"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return mixing.mix_sources(docs, mix_weights(docs), mix_domain(), budget_share=(3, 4), max_epochs=2, seed=1)


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '[0-9]+$') AS INT), 0) % 3) AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
rows AS (SELECT * FROM d WHERE n_tokens > 0),
leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS cap,
         CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 ELSE 2 END AS wd, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 3 ELSE 2 END AS wl,
         coalesce(try_cast(regexp_extract(source, '[0-9]+$') AS INT), 0) % 4 + 1 AS ws
  FROM rows GROUP BY ALL),
t1 AS (SELECT domain, sum(cap)::BIGINT AS cap, max(wd) AS w, (SELECT sum(tokens)::BIGINT * 3 // 4 FROM leaves) AS budget FROM leaves GROUP BY domain),
f1 AS (SELECT *, cap * sum(w) OVER (ORDER BY cap::DOUBLE / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (budget - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM t1),
g1 AS (SELECT *, budget - coalesce(sum(cap) FILTER (filled) OVER (), 0) AS rest, sum(w) FILTER (NOT filled) OVER () AS open FROM f1),
h1 AS (SELECT *, w * rest // open AS share FROM g1),
q1 AS (SELECT domain, CASE WHEN filled THEN cap ELSE share + CASE WHEN row_number() OVER (ORDER BY filled, domain) <= rest - sum(share) FILTER (NOT filled) OVER () THEN 1 ELSE 0 END END AS budget FROM h1),
t2 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, max(wl) AS w, any_value(budget) AS budget FROM leaves JOIN q1 USING (domain) GROUP BY domain, lang),
f2 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM t2),
g2 AS (SELECT *, budget - coalesce(sum(cap) FILTER (filled) OVER (PARTITION BY domain), 0) AS rest, sum(w) FILTER (NOT filled) OVER (PARTITION BY domain) AS open FROM f2),
h2 AS (SELECT *, w * rest // open AS share FROM g2),
q2 AS (SELECT domain, lang, CASE WHEN filled THEN cap ELSE share + CASE WHEN row_number() OVER (PARTITION BY domain ORDER BY filled, lang) <= rest - sum(share) FILTER (NOT filled) OVER (PARTITION BY domain) THEN 1 ELSE 0 END END AS budget FROM h2),
t3 AS (SELECT domain, lang, source, tokens, cap, ws AS w, budget FROM leaves JOIN q2 USING (domain, lang)),
f3 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain, lang ORDER BY cap::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM t3),
g3 AS (SELECT *, budget - coalesce(sum(cap) FILTER (filled) OVER (PARTITION BY domain, lang), 0) AS rest, sum(w) FILTER (NOT filled) OVER (PARTITION BY domain, lang) AS open FROM f3),
h3 AS (SELECT *, w * rest // open AS share FROM g3),
q3 AS (SELECT domain, lang, source, tokens, (CASE WHEN filled THEN cap ELSE share + CASE WHEN row_number() OVER (PARTITION BY domain, lang ORDER BY filled, source) <= rest - sum(share) FILTER (NOT filled) OVER (PARTITION BY domain, lang) THEN 1 ELSE 0 END END)::BIGINT AS quota FROM h3),
near AS (SELECT rows.*, quota // tokens AS whole, quota % tokens AS part FROM rows JOIN q3 USING (domain, lang, source)),
ranked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('1:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS ahead FROM near WHERE part > 0)
SELECT doc_id, domain, lang, source, unnest(range(0, whole)) AS epoch, n_tokens, n_tokens AS take_tokens FROM near WHERE whole > 0
UNION ALL
SELECT doc_id, domain, lang, source, whole AS epoch, n_tokens, least(n_tokens, part - ahead)::BIGINT AS take_tokens FROM ranked WHERE ahead < part"""


def url_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures, one a day through a year by page_id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched_on"))


def url_entries(captures: DataFrame) -> DataFrame:
    """A dated list over the hosts of the captures, by a rule, and three entries on domains."""
    host = url_filters.host_of(F.col("url"))
    hosts = captures.select(host.alias("host")).filter("host <> ''").distinct()
    h = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 6), 16, 10).cast("long")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    rows = hosts.withColumn("h", h).select(
        F.explode(
            F.array(
                F.struct(F.col("host").alias("pattern"), F.when(F.col("h") % 3 == 0, "allow").otherwise("block").alias("action"), day(F.col("h") % 300).alias("listed_on")),
                F.struct(F.col("host").alias("pattern"), F.lit("none").alias("action"), day(F.col("h") % 300 + 30 + F.col("h") % 97).alias("listed_on")),
                F.struct(F.concat("host", F.lit("/en")).alias("pattern"), F.lit("review").alias("action"), day(F.col("h") % 211).alias("listed_on")),
            )
        ).alias("e")
    )
    fixed = captures.sparkSession.sql("SELECT * FROM VALUES ('example.com', 'allow', DATE'2024-03-01'), ('example.net', 'block', DATE'2024-06-15'), ('example.org', 'review', DATE'2023-12-01') AS t(pattern, action, listed_on)")
    return rows.select("e.*").unionByName(fixed)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_captures(spark, sf_dir)
    return url_filters.judge_captures(captures, url_entries(captures))


URL_FILTERS_SQL = r"""
WITH c AS (
  SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), '(:[0-9]*)$|^www\.', '', 'g') AS host,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1)) AS path, DATE '2024-01-01' + (page_id % 366)::INT AS fetched_on
  FROM pages),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS h FROM c WHERE host <> ''),
entries AS (
  SELECT host AS pattern, CASE WHEN h % 3 = 0 THEN 'allow' ELSE 'block' END AS action, DATE '2024-01-01' + (h % 300)::INT AS listed_on FROM hosts
  UNION ALL SELECT host, 'none', DATE '2024-01-01' + (h % 300 + 30 + h % 97)::INT FROM hosts
  UNION ALL SELECT host || '/en', 'review', DATE '2024-01-01' + (h % 211)::INT FROM hosts
  UNION ALL VALUES ('example.com', 'allow', DATE '2024-03-01'), ('example.net', 'block', DATE '2024-06-15'), ('example.org', 'review', DATE '2023-12-01')),
one AS (SELECT pattern, listed_on, max(action) AS action FROM entries GROUP BY pattern, listed_on),
spans AS (SELECT * FROM (SELECT pattern, action, listed_on AS valid_from, coalesce(lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on), DATE '9999-12-31') AS valid_to FROM one) WHERE action <> 'none'),
split AS (SELECT page_id, fetched_on, string_split(host, '.') AS labels, CASE WHEN path = '' THEN [] ELSE string_split(path, '/') END AS segments FROM c WHERE host <> ''),
tops AS (SELECT page_id, fetched_on, segments, unnest(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.'))) AS domain FROM split),
keys AS (SELECT DISTINCT page_id, fetched_on, unnest(list_concat([domain], list_transform(range(1, len(segments) + 1), lambda k: domain || '/' || array_to_string(segments[:k], '/')))) AS pattern FROM tops),
best AS (SELECT page_id, pattern, action, valid_from, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern) AS r
  FROM keys JOIN spans USING (pattern) WHERE fetched_on >= valid_from AND fetched_on < valid_to)
SELECT c.page_id, host, fetched_on, coalesce(action, 'none') AS verdict, pattern, valid_from AS listed_on
FROM c LEFT JOIN best ON c.page_id = best.page_id AND r = 1"""


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_output.write_tokens(_documents(spark, sf_dir), _io.new_path(spark, "tokens"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_output.read_tokens(index)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(_documents(spark, sf_dir), threshold="0.85")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeated_passages(_documents(spark, sf_dir), window=35).drop("kept_text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~toxicity.held_out())
    scored = toxicity.score_toxicity(_documents(spark, sf_dir), labels)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_passages", "p_value")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(_documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir), keep="max")


EXACT_DEDUP_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), head=prefix_trie.contract_head)


_CRC32 = "xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"
PREFIX_TRIE_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, left(sha256(length(role) || ':' || role || text), 32)) AS seq FROM t GROUP BY conv_id),
c AS (SELECT conv_id, seq, {_CRC32} % 4 AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(b.seq, [])[1:h], c.seq[h + 1:]) AS seq FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM r),
n AS (SELECT depth, seq[1:depth] AS pre, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY ALL),
k AS (SELECT depth - 1 AS depth, pre[1:depth - 1] AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.pre[n.depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM n LEFT JOIN k ON n.depth = k.depth AND n.pre = k.pre),
up AS (SELECT depth AS own, pre, n_children, saved, unnest(range(0, depth + 1)) AS top FROM m),
s AS (SELECT top AS depth, pre[1:top] AS pre, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY ALL),
e AS (SELECT seq AS pre, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM r GROUP BY seq)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM m JOIN s ON m.depth = s.depth AND m.pre = s.pre LEFT JOIN n q ON m.depth > 0 AND q.depth = m.depth - 1 AND q.pre = m.pre[1:m.depth - 1] LEFT JOIN e ON e.pre = m.pre"""


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(~quality.held_out())
    scored = quality.score_quality(_documents(spark, sf_dir), labels)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted", "strength")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit_sources(_documents(spark, sf_dir))


SOURCE_DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{exact_dedup.UPPER}', '{exact_dedup.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
own AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM own JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM own GROUP BY lang, term) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_sentencepiece, op3_mixing, op4_token_output, op5_minhash_dedup, op6_substring_dedup, op7_toxicity, op8_fingerprints, op9_url_filters, op10_exact_dedup, op11_prefix_trie, op12_quality, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": MIXING_SQL, "op9_url_filters": URL_FILTERS_SQL, "op10_exact_dedup": EXACT_DEDUP_SQL, "op11_prefix_trie": PREFIX_TRIE_SQL, "op13_source_divergence": SOURCE_DIVERGENCE_SQL}
