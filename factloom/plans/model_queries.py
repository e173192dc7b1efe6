"""Queries on training, incremental learning and the whole analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import terms, text
from factloom.operators import chunks, isotonic, training, vectors
from factloom.plans import analyze as whole
from factloom.plans.evidence_queries import EV_SQL, rule_evidence, scored_sql
from factloom.plans.registry import query
from factloom.plans.text_queries import WIKI_SQL, chunks_sql, labelled, own_pages, table, vectors_sql
from factloom.session import new_path, stored
from factloom.sources import corpus
from factloom.streaming import keyed, online

_L = "l AS (SELECT doc_id, text, CASE WHEN quality = 1 THEN 'true' ELSE 'fake' END AS label FROM documents JOIN labels USING (doc_id))"
TERMS = ["the", "License", "das", "pour"]


@query(f"WITH {_L} SELECT label, count(*) AS n FROM l GROUP BY label")
def label_counts(spark, sf_dir):
    return training.label_counts(labelled(spark, sf_dir))


@query(f"WITH {_L} SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 6) AS weight FROM (SELECT label, count(*) AS n FROM l GROUP BY label)")
def class_weight(spark, sf_dir):
    return training.balanced_weights(labelled(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


_SPLIT = f"WITH {_L}, s AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) <= floor((count(*) OVER (PARTITION BY label) * 2 + 5) / 10.0) AS is_test FROM l)"


@query(_SPLIT + " SELECT doc_id, label, is_test FROM s")
def split_assign(spark, sf_dir):
    return training.split_assignment(labelled(spark, sf_dir)).select("doc_id", "label", "is_test")


_HAS = " OR ".join(f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){t.lower()}($|[^\\p{{L}}\\p{{N}}_])')" for t in TERMS)


@query(f"""WITH {_L}, s AS (SELECT doc_id, label, ({_HAS}) AS in_subset FROM l), c AS (SELECT label, count(*) AS n FROM s WHERE in_subset GROUP BY label)
SELECT doc_id, label, in_subset, round(CASE WHEN in_subset THEN (SELECT sum(n) FROM c) / (2.0 * n) ELSE 1.0 END::DOUBLE, 6) AS weight FROM s LEFT JOIN c USING (label)""")
def debias_weight(spark, sf_dir):
    got = training.debias_weights(labelled(spark, sf_dir), TERMS, "list")
    return got.select("doc_id", "label", "in_subset", F.round("weight", 6).alias("weight"))


def masked_sql(text: str, word: str) -> str:
    """A whole word masked in any case; twice, as neighbours share the character between them."""
    once = lambda x: f"regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:' || {word} || ')($|[^\\p{{L}}\\p{{N}}_])', '\\1[ENT]\\2', 'g')"
    return once(once(text))


_MASKED = "text"
for _term in sorted(TERMS, key=lambda t: (-len(t), t)):
    _MASKED = masked_sql(_MASKED, f"'{_term}'")


@query(f"WITH {_L} SELECT doc_id, label, 1.0::DOUBLE AS weight, false AS is_copy, md5(text) AS text_md5 FROM l UNION ALL SELECT doc_id, label, 0.5::DOUBLE, true, md5({_MASKED}) FROM l WHERE {_HAS}")
def mask_copies(spark, sf_dir):
    got = training.with_masked_copies(labelled(spark, sf_dir), TERMS, "list")
    return got.select("doc_id", "label", "weight", "is_copy", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_MANY = r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents), names AS (SELECT w FROM w WHERE length(w) >= 3 AND w <> 'ent' ORDER BY md5(w) LIMIT 10000),
parts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS p, row_number() OVER () AS n FROM documents),
each AS (SELECT doc_id, n, i, p[i] AS x FROM (SELECT doc_id, n, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
said AS (SELECT doc_id, n, i, x, w FROM each LEFT JOIN names ON lower(x) = w)
"""


@query(_MANY + "SELECT doc_id, count(DISTINCT w)::INT AS found, md5(string_agg(CASE WHEN w IS NULL THEN x ELSE '[ENT]' END, '' ORDER BY i)) AS text_md5 FROM said GROUP BY doc_id, n")
def many_terms(spark, sf_dir):
    """Ten thousand protected terms in one pass: how many each document has, and its text with them masked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w")).filter("length(w) >= 3 and w <> 'ent'").distinct()
    names = [r["w"] for r in words.orderBy(F.md5(F.col("w").cast("binary"))).limit(10_000).collect()]  # a list of terms is a parameter, held by the driver
    rows = docs.withColumn("m", terms.listed_and(F.col("text"), names, F.array().cast("array<string>")))
    return rows.select("doc_id", F.size("m").alias("found"), F.md5(terms.mask_mentions("text", "m").cast("binary")).alias("text_md5"))


@query()
def masked_names(spark, sf_dir):
    rows = training.with_masked_copies(labelled(spark, sf_dir), None, "auto").filter("is_copy")
    return rows.select("doc_id", "label", "text", "weight")


@query(_SPLIT + """, p AS (SELECT label AS y, CASE WHEN doc_id % 7 = 0 THEN 'fake' ELSE label END AS yhat FROM s),
c AS (SELECT y AS c, count(*) AS support, count(*) FILTER (y = yhat) AS hit FROM p GROUP BY y), d AS (SELECT yhat AS c, count(*) AS said FROM p GROUP BY yhat),
r AS (SELECT c, support, hit, hit / said::DOUBLE AS precision, hit / support::DOUBLE AS recall FROM c JOIN d USING (c)), f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM r),
u AS (SELECT c AS class, precision, recall, f1, support::BIGINT AS support FROM f UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support)::BIGINT FROM f
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM f
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM u""")
def classification_report(spark, sf_dir):
    p = labelled(spark, sf_dir).select(F.col("label").alias("y"), F.when(F.col("doc_id") % 7 == 0, "fake").otherwise(F.col("label")).alias("yhat"))
    got = training.classification_report(p)
    return got.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def _training_rows(spark, sf_dir):
    """Features of the split corpus, stored, and the scaler of its style numbers."""
    rows = training.split_assignment(labelled(spark, sf_dir)).withColumn("embedding", text.hashed_embedding(F.col("text")))
    weights = training.balanced_weights(rows.filter("not is_test")).select("label", "weight")
    rows = rows.join(F.broadcast(weights), "label").withColumn("y", (F.col("label") == "true").cast("double"))
    scaler = training.style_scaler(text.with_style(rows.filter("not is_test").select("text"), keep=False)).first().asDict()
    return stored(training.features(rows, scaler), "features"), scaler


@query()
def train_classifier(spark, sf_dir):
    rows, _ = _training_rows(spark, sf_dir)
    model = training.fit_classifier(rows.filter("not is_test"))
    got = training.predict(model, rows.filter("is_test"))
    return got.select("doc_id", "label", "p_true", F.when(F.col("p_true") >= 0.5, "true").otherwise("fake").alias("predicted"))


@query()
def train_calibrated(spark, sf_dir):
    rows, _ = _training_rows(spark, sf_dir)
    models = training.fit_calibrated(rows.filter("not is_test"))
    return training.predict_calibrated(models, rows.filter("is_test")).select("doc_id", "label", "p_true")


_FOLDS = f"WITH {_L}, f AS (SELECT doc_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('7:' || doc_id), doc_id) - 1) % 5 AS fold FROM l)"


@query(_FOLDS + " SELECT doc_id, label, fold::INT AS fold FROM f")
def fold_assign(spark, sf_dir):
    return training.stratified_folds(labelled(spark, sf_dir), by="label").select("doc_id", "label", "fold")


_PLACE = "(('0x' || substr(md5('x' || doc_id), 1, 6))::BIGINT % 997 + CASE WHEN label = 'true' THEN 150 ELSE 0 END)"


@query(_FOLDS + f""", p AS (SELECT fold, {_PLACE} / 100.0::DOUBLE AS x, sum(CASE WHEN label = 'true' THEN 1.0 ELSE 0.0 END) AS s, sum(CASE WHEN label = 'true' THEN 1.0 ELSE 2.0 END) AS w FROM f GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY x) AS i, sum(s) OVER (PARTITION BY fold ORDER BY x) AS cs, sum(w) OVER (PARTITION BY fold ORDER BY x) AS cw FROM p),
m AS (SELECT a.fold, a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS mean FROM n a JOIN n b ON a.fold = b.fold AND a.i <= b.i),
low AS (SELECT fold, j, k, min(mean) OVER (PARTITION BY fold, j ORDER BY k DESC) AS least FROM m),
fit AS (SELECT n.fold, n.x, max(least) AS value FROM n JOIN low ON low.fold = n.fold AND low.j <= n.i AND low.k = n.i GROUP BY n.fold, n.x)
SELECT f.doc_id, f.fold::INT AS fold, round(value::DOUBLE, 6) AS value FROM f JOIN fit ON f.fold = fit.fold AND {_PLACE} / 100.0::DOUBLE = fit.x""")
def isotonic_curves(spark, sf_dir):
    """A rising curve for each stratified fold through margins by rule, read at every document (in SQL: the largest of smallest means)."""
    rows = training.stratified_folds(labelled(spark, sf_dir), by="label")
    place = F.conv(F.substring(F.md5(F.concat(F.lit("x"), F.col("doc_id").cast("string")).cast("binary")), 1, 6), 16, 10).cast("long") % 997 + F.when(F.col("label") == "true", 150).otherwise(0)
    points = stored(rows.select("doc_id", "fold", (place / 100.0).alias("x"), (F.col("label") == "true").cast("double").alias("y"), F.when(F.col("label") == "true", 1.0).otherwise(2.0).alias("weight")), "points")
    lines = isotonic.curves(points)
    value = F.coalesce(*[F.when(F.col("fold") == k, c.at(F.col("x"))) for k, c in sorted(lines.items())])
    return points.select("doc_id", "fold", F.round(value, 6).alias("value"))


@query(_SPLIT + " SELECT doc_id, kind, true AS same FROM s, (VALUES ('plain'), ('calibrated')) AS k(kind) WHERE is_test")
def model_roundtrip(spark, sf_dir):
    """Classifiers with style features, plain and calibrated: saved, found, loaded and served give what was fitted."""
    rows, scaler = _training_rows(spark, sf_dir)
    fit, test = rows.filter("not is_test"), rows.filter("is_test")
    out = None
    for kind, model, predict in (("plain", training.fit_classifier(fit), training.predict), ("calibrated", training.fit_calibrated(fit), training.predict_calibrated)):
        path = new_path(spark, "model")
        corpus.save_model(spark, training.Classifier.of(model, ["fake", "true"], scaler, 0.2), path, {"calibrated": kind == "calibrated"})
        loaded, config = corpus.load_model(spark, corpus.model_dir(spark, f"{path}-none", path))
        served = loaded.p_true(test.select("doc_id", "text", "embedding"), "text", "served")
        both = predict(model, test).select("doc_id", "p_true").join(served, "doc_id")
        same = (F.abs(F.col("served") - 100 * F.col("p_true")) < 1e-6) & F.lit(config["calibrated"] == (kind == "calibrated"))
        part = both.select("doc_id", F.lit(kind).alias("kind"), same.alias("same"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_L} SELECT md5(text) AS text_md5, label, training FROM l, (VALUES (false), (true)) AS k(training) UNION ALL SELECT md5('  '), 'Fake', false")
def json_scan(spark, sf_dir):
    """The corpus written as JSON lines with rows that no scan takes, read for the index and for training."""
    path = new_path(spark, "corpus") + ".jsonl"
    rows = labelled(spark, sf_dir).select("text", "label")
    odd = spark.createDataFrame([("", "true"), (None, "true"), ("x", ""), ("y", None), ("  ", "Fake")], "text string, label string")
    corpus.write_json(rows.unionByName(odd), path)
    parts = [corpus.read_json_corpus(spark, path, t).select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "label", F.lit(t).alias("training")) for t in (False, True)]
    return parts[0].unionByName(parts[1])


@query(r"""SELECT doc_id AS id, 'true' AS label, md5(left(t, 300)) AS preview_md5, 64 AS dim, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND regexp_replace(text, '\s', '', 'g') <> '') AS "count"
FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents JOIN labels USING (doc_id) WHERE quality = 1) WHERE t <> ''""")
def index_roundtrip(spark, sf_dir):
    """The vector index written and read back, with its configuration."""
    path = new_path(spark, "index")
    corpus.write_index(vectors.index_rows(labelled(spark, sf_dir)), path)
    rows, config = corpus.read_index(spark, path)
    return rows.crossJoin(F.broadcast(config)).select("id", "label", F.md5(F.col("preview").cast("binary")).alias("preview_md5"), F.col("dim").cast("int").alias("dim"), "count")  # one row


def _feedback(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text", F.when(F.col("role") == "user", "true").otherwise("fake").alias("label"))
    return turns


@query(rf"""WITH RECURSIVE c AS (SELECT conv_id * 1000 + turn AS seq, text, role FROM conversations WHERE regexp_replace(coalesce(text, ''), '\s', '', 'g') <> ''),
{vectors_sql("cv", "c", "seq, role", "text")}, rows AS (SELECT row_number() OVER (ORDER BY seq) AS n, CASE WHEN role = 'user' THEN 1.0 ELSE -1.0 END::DOUBLE AS y, v FROM cv),
s AS (SELECT 0::BIGINT AS n, list_transform(range(0, 64), lambda i: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS b
  UNION ALL SELECT k.n, list_transform(list_zip(k.w, k.v), lambda z: z[1] * greatest(0.0, 1.0 - rate * {online.PENALTY}) + rate * pull * z[2]), k.b + rate * pull
  FROM (SELECT rows.n, s.w, s.b, rows.v, 1.0 / ({online.PENALTY} * ({float(online._start(online.PENALTY))!r} + rows.n)) AS rate, y / (1.0 + exp(y * (list_inner_product(s.w, rows.v) + s.b))) AS pull FROM s JOIN rows ON rows.n = s.n + 1) AS k),
l AS (SELECT * FROM s ORDER BY n DESC LIMIT 1)
SELECT n AS n_updates, n + 1 AS t, place, round(value, 6) AS value FROM (SELECT n, unnest(list_prepend(b, w)) AS value, unnest(range(0, 65))::INT AS place FROM l)""")
def online_replay(spark, sf_dir):
    """The feedback stream learned in the state store, from its source to the latest version: intercept, then coefficients."""
    root = new_path(spark, "online")
    _feedback(spark, sf_dir).withColumn("model", F.lit("all")).write.mode("overwrite").parquet(f"{root}/feedback")
    stream = keyed.feedback_stream(spark, f"{root}/feedback", max_files=1_000)
    keyed.learn(stream, f"{root}/versions", f"{root}/checkpoint", ["fake", "true"]).awaitTermination()
    each = keyed.models(spark, f"{root}/versions").select("n_updates", "t", F.posexplode(F.concat(F.array("intercept"), "coefficients")).alias("place", "value"))
    return each.withColumn("value", F.round("value", 6))


def keyed_feedback(spark, sf_dir):
    """Feedback of several models: on turns of conversations, and on events by user."""
    turns = _feedback(spark, sf_dir).withColumn("model", F.concat(F.lit("turns-"), (F.floor(F.col("seq") / 1000) % 4).cast("string")))
    e = table(spark, sf_dir, "events")
    said = F.concat_ws(" ", F.col("event_type"), F.concat(F.lit("k"), F.regexp_extract("props", "[0-9]+", 0)))
    events = e.select(F.concat(F.lit("events-"), (F.col("user_id") % 16).cast("string")).alias("model"), F.col("event_id").alias("seq"), said.alias("text"), F.when(F.col("value") >= 15, "true").otherwise("fake").alias("label"))
    return turns.select("model", "seq", "text", "label"), events


_KEYED = rf"""WITH RECURSIVE c AS (SELECT 'turns-' || (conv_id % 4) AS model, conv_id * 1000 + turn AS seq, text, role = 'user' AS good FROM conversations WHERE regexp_replace(coalesce(text, ''), '\s', '', 'g') <> ''
  UNION ALL SELECT 'events-' || (user_id % 16), event_id, event_type || ' k' || regexp_extract(props, '[0-9]+', 0), coalesce(value >= 15, false) FROM events),
{vectors_sql("cv", "c", "model, seq, good", "text")}, rows AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY seq) AS n, CASE WHEN good THEN 1.0 ELSE -1.0 END::DOUBLE AS y, v FROM cv),
s AS (SELECT DISTINCT model, 0::BIGINT AS n, list_transform(range(0, 64), lambda i: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS b FROM rows
  UNION ALL SELECT k.model, k.n, list_transform(list_zip(k.w, k.v), lambda z: z[1] * greatest(0.0, 1.0 - rate * {online.PENALTY}) + rate * pull * z[2]), k.b + rate * pull
  FROM (SELECT rows.model, rows.n, s.w, s.b, rows.v, 1.0 / ({online.PENALTY} * ({float(online._start(online.PENALTY))!r} + rows.n)) AS rate, y / (1.0 + exp(y * (list_inner_product(s.w, rows.v) + s.b))) AS pull FROM s JOIN rows ON rows.model = s.model AND rows.n = s.n + 1) AS k),
l AS (SELECT model, max(n) AS n, arg_max(w, n) AS w, arg_max(b, n) AS b FROM s GROUP BY model)
"""


@query(_KEYED + "SELECT model, n AS n_updates, n + 1 AS t, place, round(value, 6) AS value FROM (SELECT model, n, unnest(list_prepend(b, w)) AS value, unnest(range(0, 65))::INT AS place FROM l)")
def keyed_replay(spark, sf_dir):
    """Many models learned from two streams in parallel, in three arrivals with a restart after the first:
    one more micro-batch from the checkpoint, the last from the written versions alone."""
    root = new_path(spark, "keyed")
    sources = [(name, rows, rows.selectExpr("percentile_approx(seq, array(0.4D, 0.7D))").first()[0]) for name, rows in zip(("turns", "events"), keyed_feedback(spark, sf_dir), strict=True)]
    for k in range(3):
        for name, rows, cuts in sources:  # each arrival is a few files of one range of seq
            low, high = [None, *(cuts or [0, 0])][k], [*(cuts or [0, 0]), None][k]
            some = rows if low is None else rows.filter(F.col("seq") > low)
            (some if high is None else some.filter(F.col("seq") <= high)).write.mode("append").parquet(f"{root}/{name}" if k < 2 else f"{root}/late/{name}")
        if k < 2:
            both = [keyed.feedback_stream(spark, f"{root}/{name}", max_files=1_000) for name, *_ in sources]
            keyed.learn(both[0].unionByName(both[1]), f"{root}/versions", f"{root}/checkpoint", ["fake", "true"]).awaitTermination()
    before = stored(keyed.models(spark, f"{root}/versions"), "models")
    both = [keyed.feedback_stream(spark, f"{root}/late/{name}", max_files=1_000) for name, *_ in sources]
    keyed.learn(both[0].unionByName(both[1]), f"{root}/late/versions", f"{root}/late/checkpoint", ["fake", "true"], start=before).awaitTermination()
    after = keyed.models(spark, f"{root}/late/versions")
    now = after.unionByName(before.join(after.select("model"), "model", "left_anti"))
    each = now.select("model", "n_updates", "t", F.posexplode(F.concat(F.array("intercept"), "coefficients")).alias("place", "value"))
    return each.withColumn("value", F.round("value", 6))


WEIGHTS = [((i * 37) % 11 - 5) / 10 for i in range(64)]
ONLINE = [((i * 53) % 13 - 6) / 10 for i in range(64)]
_P = lambda w, b, v: f"100.0 / (1 + exp(-(list_inner_product({w}::DOUBLE[], {v}) + {b})))"
_STRIPPED = r"stripped_docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS whole_text FROM documents)"
_CHUNKS = f"{_STRIPPED}, {chunks_sql('ch', 'stripped_docs', 'doc_id', 'whole_text')}, {vectors_sql('chv', 'ch', 'doc_id, start', 'chunk')}"


@query(f"WITH {_CHUNKS} SELECT doc_id, round(avg({_P(ONLINE, 0.2, 'v')}), 6) AS mean, round(max({_P(ONLINE, 0.2, 'v')}), 6) AS best FROM chv JOIN stripped_docs USING (doc_id) WHERE whole_text <> '' GROUP BY doc_id")
def online_scores(spark, sf_dir):
    """The incremental classifier's score of each text, mean and best chunk; none from an untrained one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.stripped(F.coalesce("text", F.lit(""))).alias("text")).filter("text <> ''")
    parts = stored(chunks.token_chunks(docs), "chunks")
    now = {"coefficients": ONLINE, "intercept": 0.2}
    mean, best = (online.online_scores(parts, now, how).withColumnRenamed("online", how) for how in ("mean", "max"))
    none = online.online_scores(parts, None).withColumnRenamed("online", "none")
    both = mean.join(best, "doc_id").join(none, "doc_id").filter("none is null")
    return both.select("doc_id", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("best"))


def analyze_sql(k: str = "20", w_hist: str = "0.5", mean_hist: str = "false", best_model: str = "false", use_wiki: str = "true") -> str:
    """The analysis in SQL; the parameters are expressions of doc_id."""
    return f"""WITH {EV_SQL}, {_CHUNKS}, {WIKI_SQL.replace("rank <= 20", f"rank <= {k}")},
{vectors_sql("cv", "claims", "doc_id, claim_no", "claim")}, {vectors_sql("iv", "items", "item_id", "item_text")},
sims AS (SELECT doc_id, claim_no, arrival_no, list_inner_product(cv.v, iv.v) AS sim FROM e JOIN cv USING (doc_id, claim_no) JOIN iv USING (item_id)),
m AS (SELECT e.*, sim FROM e JOIN sims USING (doc_id, claim_no, arrival_no)), {scored_sql("sim").partition(",\n")[2].strip()},
true_texts AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS whole_text FROM documents JOIN labels USING (doc_id) WHERE quality = 1), index_texts AS (SELECT * FROM true_texts WHERE whole_text <> ''),
{vectors_sql("ix", "index_texts", "doc_id", "whole_text")},
near AS (SELECT chv.doc_id, chv.start, greatest(0.0, least(1.0, list_inner_product(chv.v, ix.v))) AS sim FROM chv, ix),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY sim DESC) AS rank FROM near),
parts AS (SELECT doc_id, start, sum(sim) / {k} * 100 AS score FROM best WHERE rank <= {k} GROUP BY doc_id, start),
hist AS (SELECT doc_id, CASE WHEN {mean_hist} THEN avg(score) ELSE max(score) END AS faiss FROM parts GROUP BY doc_id),
model AS (SELECT doc_id, CASE WHEN {best_model} THEN max({_P(WEIGHTS, 0.1, "v")}) ELSE avg({_P(WEIGHTS, 0.1, "v")}) END AS prob, CASE WHEN {best_model} THEN max({_P(ONLINE, 0.2, "v")}) ELSE avg({_P(ONLINE, 0.2, "v")}) END AS online FROM chv GROUP BY doc_id),
sig AS (SELECT doc_id, faiss, CASE WHEN {use_wiki} THEN coalesce(wiki, 0.0) END AS wiki, prob, online, coalesce(s, 0.0) / 10 * 100 AS fonte, least(0.8, 1 - exp(-30 / 25.0)) AS al FROM stripped_docs JOIN hist USING (doc_id) JOIN model USING (doc_id) LEFT JOIN wiki USING (doc_id) LEFT JOIN z USING (doc_id) WHERE whole_text <> ''),
h AS (SELECT *, CASE WHEN wiki IS NULL OR wiki <= 0 THEN faiss WHEN faiss <= 0 THEN wiki ELSE faiss * 0.5 + wiki * 0.5 END AS hist FROM sig),
fin AS (SELECT *, (1 - al) * ({w_hist} * hist + 0.35 * (1 - al) * prob + 0.33 * fonte) / ({w_hist} + 0.35 * (1 - al) + 0.33) + al * online AS final FROM h)
SELECT doc_id, round(faiss, 6) AS faiss, round(wiki, 6) AS wiki, round(hist, 6) AS hist, round(prob, 6) AS prob_true, round(fonte, 6) AS fonte_score, round(online, 6) AS online, round(al, 6) AS alpha, round(final, 6) AS final,
  CASE WHEN final >= 50 THEN 'VERDADEIRO' ELSE 'FALSO' END AS rotulo, round(CASE WHEN final >= 50 THEN final ELSE 100 - final END, 6) AS confianca, CASE WHEN prob >= 50 THEN 'provavelmente verdadeiro' ELSE 'provavelmente falso' END AS bert_rotulo, 200 AS status FROM fin"""


@query(analyze_sql())
def analyze(spark, sf_dir):
    """The whole analysis of all documents, with all signals: the index of the labelled true ones, pages,
    a classifier and an incremental one by rule, and evidence by rule with similarities of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = vectors.index_rows(labelled(spark, sf_dir)).select("id", "embedding")
    claims, found = rule_evidence(spark, sf_dir, vectors=True)
    now = {"coefficients": ONLINE, "intercept": 0.2, "n_updates": 30}
    got = whole.analyze(docs, index, (WEIGHTS, 0.1), found.drop("claim", "claim_words"), now, own_pages(spark, sf_dir), whole.Parameters(use_wiki=True), lists=False, claims=claims)
    numbers = ("faiss", "wiki", "hist", "prob_true", "fonte_score", "online", "alpha", "final", "confianca")
    return got.select("doc_id", *[F.round(n, 6).alias(n) for n in numbers], "rotulo", "bert_rotulo", "status")


_OWN = {"k": "(CASE WHEN doc_id % 3 = 1 THEN 5 ELSE 20 END)", "w_hist": "(CASE WHEN doc_id % 3 = 2 THEN 0.25 ELSE 0.5 END)", "mean_hist": "doc_id % 3 = 1", "best_model": "doc_id % 4 = 2", "use_wiki": "doc_id % 5 IN (0, 3)"}


@query(analyze_sql(**_OWN))
def analyze_requests(spark, sf_dir):
    """The whole analysis of requests, each with parameters of its own: neighbours, weights, aggregates, encyclopedia or not."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    given = {
        "texto": none,
        "k": F.when(i % 3 == 1, "5"),
        "w_hist": F.when(i % 3 == 2, "0.25"),
        "hist_agg": F.when(i % 3 == 1, "mean"),
        "bert_agg": F.when(i % 4 == 2, "max"),
        "use_wiki": F.when((i % 5).isin(0, 3), "yes"),
    } | {n: none for n in ("max_tokens", "overlap_tokens", "wiki_titles", "w_bert", "w_fontes", "w_faiss", "w_wiki")}
    asked = whole.requests(table(spark, sf_dir, "documents").select(i.alias("request_id"), "text", *[c.alias(n) for n, c in given.items()]))
    index = vectors.index_rows(labelled(spark, sf_dir)).select("id", "embedding")
    claims, found = rule_evidence(spark, sf_dir, vectors=True)
    now = {"coefficients": ONLINE, "intercept": 0.2, "n_updates": 30}
    got = whole.analyze(asked.withColumnRenamed("request_id", "doc_id").drop("status"), index, (WEIGHTS, 0.1), found.drop("claim", "claim_words"), now, own_pages(spark, sf_dir), None, lists=False, claims=claims)
    numbers = ("faiss", "wiki", "hist", "prob_true", "fonte_score", "online", "alpha", "final", "confianca")
    return got.select("doc_id", *[F.round(n, 6).alias(n) for n in numbers], "rotulo", "bert_rotulo", "status")
