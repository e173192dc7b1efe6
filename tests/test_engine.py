"""Rules of the text veracity engine: golden values, quirks, properties."""

import json
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import lookups
from factloom.functions import scoring, terms, text
from factloom.operators import chunks, evidence, training, vectors
from factloom.plans import analyze as whole
from factloom.plans import registry
from factloom.sources import corpus, html
from factloom.streaming import online

SF = "/root/testdata/sf0.001"


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return row.asDict(True)


def test_scores(spark):
    lit = F.lit
    got = one(
        spark,
        plain=scoring.combined_score(lit(None).cast("string"), lit(0.8), lit(0.9), lit(0.5)),
        rated=scoring.combined_score(lit("falso"), lit(0.8), lit(0.5), lit(0.5)),
        fuse=scoring.fuse(lit(60.0), lit(80.0), lit(0.0), 0.5, 0.35, 0.33),
        a0=scoring.alpha(lit(0.0)),
        a10=scoring.alpha(lit(10.0)),
        a50=scoring.alpha(lit(50.0)),
        untrained=scoring.final_score(lit(60.0), lit(80.0), lit(0.0), lit(None).cast("double"), lit(90.0)),
        low=scoring.overlap_factor(lit(0.3999), lit(0.9)),
        mid=scoring.overlap_factor(lit(0.4), lit(0.1)),
        high=scoring.overlap_bucket(lit(0.4999)),
        top=scoring.overlap_bucket(lit(0.5)),
    )
    assert got["plain"] == pytest.approx(0.745)
    assert got["rated"] == pytest.approx(0.275)
    assert got["fuse"] == pytest.approx(58 / 1.18)
    assert got["untrained"] == pytest.approx(58 / 1.18)
    assert (got["a0"], round(got["a10"], 4), got["a50"]) == (0.0, 0.3297, 0.8)
    assert (got["low"], got["mid"], got["high"], got["top"]) == (0.9, 0.95, "40-49%", ">=50%")


@pytest.mark.parametrize(("n", "starts"), [(0, [0]), (1, [0]), (512, [0]), (513, [0, 448]), (960, [0, 448, 896]), (1000, [0, 448, 896])])
def test_chunk_starts(spark, n, starts):
    df = spark.createDataFrame([(1, " ".join(["w"] * n))], "doc_id int, text string")
    assert sorted(r["start"] for r in chunks.token_chunks(df).collect()) == starts


def test_claims(spark):
    long = "Um dois três quatro cinco seis sete oito."
    rows = [(1, f"{long} Curto. {long}"), (2, "Só isto. E aquilo."), (3, ""), (4, None), (5, long[:-1] + ":")]
    got = {r["doc_id"]: r["c"] for r in spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", text.claims(F.col("text")).alias("c")).collect()}
    assert got[1] == [long, long]
    assert got[2] == ["Só isto. E aquilo."]
    assert got[3] == [] and got[4] == []
    assert got[5] == [long[:-1] + ":"]


def test_style_of_empty_text(spark):
    rows = text.with_style(spark.createDataFrame([(0, None), (1, ""), (2, "URGENTE! É FALSO? sim")], "n int, text string")).orderBy("n").collect()
    assert all({r[c] for c in text.STYLE} == {0.0} for r in rows[:2])
    got = rows[2].asDict()
    assert got["allcaps_ratio"] == pytest.approx(2 / 4) and got["exclaim"] == 0.1 and got["lexicon_density"] == pytest.approx(1 / 4)


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    got = vectors.nearest(df.filter("id < 40"), df.filter("id >= 40"), 5).collect()
    sims = v[:40] @ v[40:].T
    for r in got:
        order = np.lexsort((np.arange(260), -sims[r["query_id"]]))
        assert r["id"] == 40 + order[r["rank"] - 1]


def test_large_history_is_not_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, (120, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    q, h = df.filter("id < 20"), df.filter("id >= 20")
    want = vectors.nearest(q, h, 4).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert vectors.nearest(q, h, 4).orderBy("query_id", "rank").collect() == want
    sims = v[:20] @ v[20:].T
    assert [r["id"] - 20 for r in want] == [i for s in sims for i in np.lexsort((np.arange(100), -s))[:4]]
    assert vectors.nearest(q, h, 0).count() == 0


def test_split_has_no_hot_label(spark):
    rows = [(i, "a" if i % 10 else "b") for i in range(3000)] + [(None, "c"), (3, None)]
    got = training.split_assignment(spark.createDataFrame(rows, "doc_id long, label string")).groupBy("label").agg(F.sum(F.col("is_test").cast("int")).alias("n")).collect()
    assert {r["label"]: r["n"] for r in got} == {"a": 540, "b": 60, "c": 0, None: 0}


def test_numbers_follow_the_order(spark):
    from factloom.session import numbered

    df = spark.createDataFrame([(f"f{i:03d}",) for i in range(500)], "name string").repartition(7)
    assert [(r["id"], r["name"]) for r in numbered(df, "name").orderBy("name").collect()] == [(i, f"f{i:03d}") for i in range(500)]


def test_calibration_curve(spark):
    x, y = [-1.0, 0.0, 2.0], [0.1, 0.4, 0.8]
    rows = spark.createDataFrame([(v,) for v in (-5.0, -1.0, -0.5, 0.0, 1.0, 2.0, 9.0)], "m double")
    got = [r["p"] for r in rows.select("m", scoring.curve(F.col("m"), x, y).alias("p")).orderBy("m").collect()]
    assert got == pytest.approx(np.interp([-5, -1, -0.5, 0, 1, 2, 9], x, y))


def test_masked_names_are_plain_replacement(spark):
    import re

    texts = ["Ana Maria viu Ana e ana maria. Bob", "É Íris? ÍRIS e Maria\nRita Souza", "sem nomes", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in training.with_masked_copies(rows).filter("is_copy").collect()}
    cap, low = lookups.CAPITAL, lookups.SMALL
    for i, t in enumerate(texts):
        names = dict.fromkeys(re.findall(rf"\b([{cap}][{low}]+(?:\s+[{cap}][{low}]+){{0,3}})\b", t))
        first = {}
        for n in names:
            first.setdefault(n.lower(), n)
        want = t
        for n in sorted(first.values(), key=lambda n: (-len(n), n)):
            want = re.sub(rf"\b{re.escape(n)}\b", "[ENT]", want, flags=re.IGNORECASE)
        assert got.get(i, t) == want


def test_missing_neighbours_count_as_zero(spark):
    near = spark.createDataFrame([(1, 7, 0.5, 1)], "query_id long, id long, sim double, rank int")
    assert vectors.historical_consistency(near, 2).first()["score"] == 25.0


def test_evidence_limits(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, 1, i, 0.9, 1.0) for i in range(12)] + [(1, 1, 20, 0.24, 1.0)], "doc_id long, claim_no int, arrival_no int, similaridade double, score double")
    ranks = evidence.ranked(rows)
    assert ranks.count() == 12
    got = {r["doc_id"]: r["fonte_score"] for r in evidence.source_scores(docs, ranks).collect()}
    assert got == {1: 100.0, 2: 0.0}


def test_masking(spark):
    df = spark.createDataFrame([(1, "Ana Maria viu ana maria e Bob."), (2, None)], "doc_id int, text string")
    got = df.select("doc_id", terms.mask_mentions("text", training.protected_mentions(F.col("text"))).alias("t")).collect()
    assert got[0]["t"] == "[ENT] viu [ENT] e [ENT]."
    assert got[1]["t"] is None
    term = spark.createDataFrame([("c++ e C.",)], "text string").select(terms.listed_mentions(F.col("text"), ["e", "zz"]).alias("m")).first()
    assert term["m"] == ["e"]


def test_regression_is_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=200) > 0).astype(float)
    w = np.where(y == 1, 1.5, 0.7)
    df = spark.createDataFrame([(i, a.tolist(), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))], "doc_id long, features array<double>, y double, weight double")
    model = training.fit_classifier(df)
    beta = np.append(model.coefficients.toArray(), model.intercept)
    xx = np.column_stack([x, np.ones(200)])
    p = 1 / (1 + np.exp(-xx @ beta))
    gradient = 0.1 * xx.T @ (w * (p - y)) + np.append(beta[:4], 0)
    assert np.abs(gradient).max() < 1e-4


def test_online_replay_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 2), 1.0], "true" if i % 2 else "fake") for i in range(20)], "seq long, features array<double>, label string")
    path = f"file://{tmp_path}/state"
    for batch in (0, 0, 1, 1):
        online.fold(spark, path, batch, rows, ["fake", "true"], 2)
    now = online.state(spark, path)
    assert (now["n_updates"], now["batch_id"], now["t"]) == (40, 1, 41)
    w, b, t = np.zeros(2), 0.0, 1
    x, y = np.array([[i % 2, 1.0] for i in range(20)]), np.arange(20) % 2 == 1
    for _ in range(2):
        w, b, t = online.sgd(w, b, t, x, y)
    assert np.allclose(now["coefficients"], w) and now["intercept"] == pytest.approx(b)


def test_html():
    page = "<html><h2>T</h2><p>a <b>b</b><sup>1</sup></p><ul><li><p>c</p></li></ul><table><p>no</p></table></html>"
    assert html.article_text(page) == "T\na b\nc\nc"
    assert html.article_text(None) == ""
    assert len(html.article_text("<p>" + "x" * 70_000 + "</p>")) == 60_000


def test_sources(spark, tmp_path):
    (tmp_path / "fake").mkdir()
    (tmp_path / "true").mkdir()
    (tmp_path / "fake" / "1.txt").write_bytes(b" caf\xc3\xa9\xff ")
    (tmp_path / "true" / "2.txt").write_text("ok")
    got = {(r["text"], r["label"]) for r in corpus.read_corpus(spark, f"file://{tmp_path}").collect()}
    assert got == {("café", "fake"), ("ok", "true")}
    assert corpus.read_texts(spark, f"file://{tmp_path}/none", "x").count() == 0
    (tmp_path / ".env").write_text("# c\nA='1=2'\nbad\n")
    assert corpus.read_env(str(tmp_path / ".env")) == {"A": "1=2"}
    (tmp_path / "t.json").write_text(json.dumps({"protected_terms": [" a ", 3, ""]}))
    assert corpus.protected_terms(spark, str(tmp_path / "t.json")) == ["a"]
    (tmp_path / "u.json").write_text("[1")
    assert corpus.protected_terms(spark, str(tmp_path / "u.json")) == corpus.protected_terms(spark, str(tmp_path / "none.json")) == []
    index = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    corpus.write_index(index, f"file://{tmp_path}/index")
    table, config = corpus.read_index(spark, f"file://{tmp_path}/index")
    assert table.count() == 1 and config.first()["dim"] == 2
    with pytest.raises(FileNotFoundError):
        corpus.read_index(spark, f"file://{tmp_path}/none")


def test_analysis(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, " "), (3, None)], "doc_id long, text string")
    index = spark.createDataFrame([(7, "a b c")], "id long, text string").select("id", text.hashed_embedding(F.col("text")).alias("embedding"))
    rows = whole.analyze(docs, index, ([0.0] * 64, 0.0), p=whole.Parameters(k=1))
    got = {r["doc_id"]: r for r in rows.collect()}
    assert got[1]["hist"] == pytest.approx(100.0) and got[1]["prob_true"] == 50.0
    assert got[2]["status"] == got[3]["status"] == 400 and got[2]["final"] is None
    said = {r["doc_id"]: json.loads(r["json"]) for r in whole.payload(rows).collect()}
    assert said[1]["historico"]["consistencia"] == 100.0 and said[2] == {"error": "texto vazio"}


def test_analysis_shuffles_no_texts(spark):
    """Where only numbers are read, the texts of documents and pages stay where they are, however large the tables."""
    docs = spark.createDataFrame([(1, "a b c"), (2, " "), (3, "b d")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, "t", "u", "a b"), (9, "t", "u", "b")], "doc_id long, title string, url string, text string")
    index = docs.filter("doc_id = 1").select(F.col("doc_id").alias("id"), text.hashed_embedding(F.col("text")).alias("embedding"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = whole.analyze(docs, index, ([0.0] * 64, 0.0), pages=pages, p=whole.Parameters(k=1, use_wiki=True), lists=False).select("doc_id", "faiss", "wiki", "final", "status")
        said = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
        got = {r["doc_id"]: r for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"\(\d+\) Exchange\n.*", said)
    assert dealt and not [x for x in dealt if re.search(r"\b(text|chunk)#", x)]
    assert got[1]["faiss"] == pytest.approx(100.0) and got[1]["wiki"] == pytest.approx(100 * (2 / 3) ** 0.5) and got[3]["wiki"] == 0.0 and got[2]["status"] == 400


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in sorted(f.stem for f in Path(SF).glob("*.parquet")):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    mine = registry.queries()[name](spark, SF).toArrow()
    theirs = con.sql(registry.oracle_sql()[name]).to_arrow_table()
    names = sorted(mine.column_names)
    assert names == sorted(theirs.column_names)

    def rows(t):
        value = lambda v: round(float(v), 9) if isinstance(v, float) else v
        return sorted(map(repr, zip(*[[value(v) for v in t.column(c).to_pylist()] for c in names], strict=True)))

    assert rows(mine) == rows(theirs)


def test_vectors_without_value_or_identifier_are_left_out(spark):
    schema = "id long, embedding array<double>"
    history = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (None, [1.0, 0.0])], schema)
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, None)], schema)
    assert sorted(map(tuple, vectors.nearest(asked, history, 5).collect())) == [(10, 1, 1.0, 1), (10, 3, 0.0, 2)]
    assert vectors.nearest(asked, history.filter("id = 2"), 5).isEmpty()
    made = spark.createDataFrame([(1, "um")], "id long, text string").select("id", text.hashed_embedding("text").alias("v"))
    plan = vectors._packed(made, "id", "v", 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # embeddings are made once


def test_files_are_listed_without_their_folders(spark, tmp_path):
    """Texts in folders of their own and in one folder are read alike; tasks put the files in place, so the driver moves none."""
    from factloom.session import empty_files
    from factloom.sources import corpus

    rows = spark.createDataFrame([("a", "x"), ("b", " y "), ("c", "")], "name string, value string")
    corpus.write_texts(rows, f"file://{tmp_path}/fake")
    (tmp_path / "fake" / "plain.txt").write_text("z")
    (tmp_path / "fake" / "none.txt").write_text("")
    assert [p.rsplit("/", 1)[1] for p in empty_files(spark, f"file://{tmp_path}/fake")] == ["none.txt"]
    got = corpus.read_texts(spark, f"file://{tmp_path}/fake", "fake").collect()
    assert sorted(r["text"] for r in got) == ["", "", "x", "y", "z"]
    assert corpus.read_metadata(spark, f"file://{tmp_path}/fake").count() == 4


def test_stripping_looks_at_the_ends_only(spark):
    """All white space is taken off, as the pattern has it, without a search through the text; sentences of a claim are found once."""
    odd = [chr(i) for i in (*range(1, 0x180), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF)]
    rows = spark.createDataFrame([(f"{c}a {c} b{c} ",) for c in odd] + [(None,), (" ",)], "t string")
    assert rows.filter(~text.stripped(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).isEmpty()
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan(text.stripped(F.col("t"))) and plan(text.claims(F.col("t"))).count("split(") == 1
