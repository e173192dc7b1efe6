"""Prefix tries, pairwise ranking and source divergence against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import prefix_trie, quality, queries, source_divergence

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, path string, depth string, k1 string, pos string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_trie(rows, rebuild):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), sha(f"{len(role)}:{role}{text}")[:32], (role, text)))
    convs = {c: [t[2] for t in sorted(ts)] for c, ts in convs.items()}
    if rebuild:
        base = lambda c: c - (c % 20 if c >= 0 else -(-c % 20))
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
        convs = {c: convs.get(base(c), [])[: h[c]] + ts[h[c] :] for c, ts in convs.items()}
    members, kids = defaultdict(list), defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                kids[tuple(ts[: d - 1])].add(tuple(ts[:d]))
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0d]+", n[-1][1])) if n else 0
        leaves[n] = sum(leaves[k] for k in kids[n]) if kids[n] else 1
        saved[n] = (len(members[n]) - 1) * words + sum(saved[k] for k in kids[n])
    out = []
    for n, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(n))
        out.append((min(own), len(n), min(members[n[:-1]]) if n else None, len(own), len(kids[n]), leaves[n], saved[n], sha(ends)))
    return sorted(out, key=repr)


def trie_rows(seed):
    rng = random.Random(seed)
    said = ["", None, "one", "two words", " a\tb\nc ", "ünï ç", "x" * 5000]
    rows = []
    for c in [*range(-25, 70), 100, 119, 121, 10**15]:
        n = rng.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(said)) for t in range(n)]
    rows += [(c, t, "user", f"step {t}") for c in (200, 201, 202, 211, 260) for t in range(60 + c % 3)]  # deep, alike
    rows += [(300 + k, t, "user", f"step {t}" if t <= k else f"other {k} {t}") for k in range(40) for t in range(k + 3)]  # each leaves the last one turn later
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "assistant", "tie"), (None, 0, "user", "lost")]
    rng.shuffle(rows)
    return rows


def trie_table(spark, rows):
    return spark.createDataFrame([(*r, "p", "d", "k", "o") for r in rows], TURNS)


@pytest.mark.parametrize(("seed", "rebuild"), [(1, True), (2, False)])
def test_prefix_trie(spark, seed, rebuild):
    rows = trie_rows(seed)
    got = prefix_trie.prefix_trie(trie_table(spark, rows), head=prefix_trie.contract_head if rebuild else None)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows, rebuild)


def test_prefix_trie_of_one_long_conversation(spark):
    """A conversation with most rows and copies of it: many ranges, one path."""
    rows = [(c, t, "user", f"turn {t % 7}") for c in (1, 2, 41) for t in range(700)] + [(5, 0, "user", "turn 0")]
    got = prefix_trie.prefix_trie(trie_table(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows, False)


def test_prefix_trie_edges(spark):
    none = trie_table(spark, trie_rows(1)).filter("false")
    assert prefix_trie.prefix_trie(none, head=prefix_trie.contract_head).count() == 0
    rows = [(3, None, None, None)]  # h = crc32('3') % 4
    got = prefix_trie.prefix_trie(trie_table(spark, rows), head=prefix_trie.contract_head).collect()
    assert [tuple(r) for r in got] == brute_trie(rows, True)


def test_prefix_trie_of_turnless_conversations(spark):
    rows = [(c, t, "user", "a b") for c in range(20, 45) if c not in (20, 40) for t in range(2)]
    assert any(zlib.crc32(str(c).encode()) % 4 >= 2 for c, *_ in rows)
    got = prefix_trie.prefix_trie(trie_table(spark, rows), head=prefix_trie.contract_head).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows, True)


def test_running_sums_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.randint(-5, 9)) for i in range(3000)]
    rows += [(4, 9000, 1)]
    got = {(r["g"], r["o"]): r["total"] for r in prefix_trie.running_sums(spark.createDataFrame(rows, "g long, o long, v long").repartition(7), "g", ["o"], {"total": "v"}).collect()}
    now = Counter()
    for g, o, v in sorted(rows):
        now[g] += v
        assert got[g, o] == now[g]


def brute_divergence(rows, min_docs, top):
    fold = {c: c + 32 for c in range(65, 91)}
    terms = [(a or "", b or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(fold))) for a, b, t in rows]
    out = []
    for lang in {a for a, _, _ in terms}:
        docs, counts = Counter(), defaultdict(Counter)
        for a, b, ws in terms:
            if a == lang:
                docs.update(set(ws))
                counts[b].update(ws)
        kept = [w for w, n in docs.items() if n >= min_docs]
        total = Counter()
        for c in counts.values():
            total.update(c)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}  # noqa: B023,E731
        p, q = {b: share(c) for b, c in counts.items()}, share(total)
        for b in counts:
            pair = [(-sum(abs(p[b][w] - p[o][w]) for w in kept), o.encode(), o) for o in counts if o != b]
            term = [(q[w] - p[b][w], w.encode(), w) for w in kept if counts[b][w] and p[b][w] > q[w]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out += [(lang, b, part, w, -v, i) for i, (v, _, w) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def divergence_rows():
    rng = random.Random(11)
    words = ["Der", "der", "é", "É", "a_b", "x1y", "naïve", "ZZ", "\U0001f600", "don't", "[q]", "`", "a\x00b", "漢字"]
    rows = [(rng.choice(["en", "en", "en", "de", None]), rng.choice(["s1", "s2", "s10", "é", "", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    rows += [("en", "only marks", "... 123"), ("en", "none", None), ("en", "none", ""), ("rare", "u", "one"), ("rare", "v", "two"), ("rare", "w", None), ("alone", "z", "a b c")]
    return rows + [("en", "long", "word " * 20_000)] + [("hot", "h", "same text here")] * 200 + [("hot", f"h{k}", "same other") for k in range(30)]


@pytest.mark.parametrize(("min_docs", "top"), [(30, 50), (2, 3), (10**6, 50)])
def test_source_divergence(spark, min_docs, top):
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, "t", "v", 1) for r in rows], "lang string, source string, text string, term string, value string, n int").repartition(5)
    got = source_divergence.audit_sources(docs, min_docs=min_docs, top=top)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows, min_docs, top)


def test_source_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert source_divergence.audit_sources(docs).count() == 0


def test_vectors_of_texts():
    texts = ["", "Aa BB! cc#", "w w w w", "l one\nl one\nl two", "é É"]
    raw = [t.encode() for t in texts]
    x = quality.vectors_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    at = {n: x[:, i] for i, n in enumerate(quality.NAMES)}
    assert x.shape == (5, len(quality.NAMES)) and np.isfinite(x).all() and not x[0].any()
    assert at["upper"][1] == pytest.approx((3 / 10) ** 0.5) and at["mark_#"][1] == pytest.approx((1 / 10) ** 0.5)
    assert at["length"][1] == pytest.approx(np.log1p(8 / 3)) and at["shout"][1] == pytest.approx(1 / 3) and at["tail"][1] == pytest.approx(1 / 3)
    assert at["top"][2] == 1 and at["twice"][2] == pytest.approx(0.75**0.5) and at["triples"][2] == pytest.approx(0.5**0.5)
    assert at["lines"][3] == pytest.approx((1 / 3) ** 0.5) and at["line_words"][3] == pytest.approx(np.log(3))
    assert at["wide"][4] == pytest.approx((2 / 3) ** 0.5) and at["length"][4] == pytest.approx(np.log(2)) and at["bare"][4] == 0


def test_preference_pairs(spark):
    rows = [(i, 1 if i % 5 else 0, [float(i)]) for i in range(50)]
    pairs = quality.preference_pairs(spark.createDataFrame(rows, "id long, y int, x array<double>"), partners=4)
    got = [(r["d"][0], r["y"]) for r in pairs.collect()]
    assert len(got) == 160 and {y for _, y in got} == {0.0, 1.0}
    # turned back, each pair is a document of label 1 less one of label 0; the ten of label 0 meet equally often
    assert sum(d if y else -d for d, y in got) == pytest.approx(4 * sum(i for i, y, _ in rows if y) - 16 * sum(i for i, y, _ in rows if not y))


def quality_rows():
    rng = random.Random(2)
    words = ["good", "words", "in", "order", "made", "of", "letters", "é"]
    rows, labels = [], []
    for i in range(240):
        some = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        bad = i % 6 == 0
        rows.append((i, " ".join(w + "###" for w in some) if bad else " ".join(some) + ".", 1.0, "s"))
        labels.append((i, int(not bad)))
    return rows + [(None, "no name at all ### ###", 0.0, "s"), (None, None, 0.0, "s"), (500, "", 0.0, "s"), (500, "x" * 50_000, 0.0, "s"), (3, rows[3][1], 0.0, "s")], labels


QUALITY = "doc_id long, text string, score double, strength string"


def test_quality(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows, QUALITY)
    taught = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score_quality(docs, taught.filter(~quality.held_out())).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    want = dict(labels)
    assert all(r["predicted"] == want[r["doc_id"]] for r in got if r["doc_id"] in want)
    share = quality.score_quality(docs, taught, keep_share=0.5).agg(F.avg("predicted")).first()[0]
    assert share == pytest.approx(0.5, abs=0.02)


def test_quality_edges(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows[:9], QUALITY)
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert {(r["score"], r["predicted"], r["strength"]) for r in quality.score_quality(docs, one).collect()} == {(1.0, 1, None)}
    assert {(r["score"], r["predicted"]) for r in quality.score_quality(docs, one.filter("false")).collect()} == {(0.0, 0)}
    taught = spark.createDataFrame(labels, "doc_id long, quality int")
    assert quality.score_quality(docs.filter("false"), taught).count() == 0
    sample = quality._sample(taught.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")), 7)
    assert sample.count() == 7


def test_quality_learns_from_all_labels(spark, monkeypatch):
    """Ranks, quantile and labels are whole: no row is left out, as a sample would."""
    rows = spark.range(30_000).select("id", (F.col("id") % 3 > 0).cast("int").alias("y"))
    assert quality._sample(rows, None).count() == 30_000
    got = quality._ranked(rows).groupBy("y").agg(F.count_distinct("r").alias("n"), F.min("r").alias("a"), F.max("r").alias("b")).collect()
    assert {r["y"]: (r["n"], r["a"], r["b"]) for r in got} == {0: (10_000, 0, 9_999), 1: (20_000, 0, 19_999)}
    monkeypatch.setattr(quality, "ACCURACY", 100)
    values = spark.range(5_000).select(F.sin(F.col("id").cast("double")).alias("s")).unionByName(spark.createDataFrame([(0.5,)] * 700, "s double"))
    for share in (0.0, 0.123, 0.5, 0.77, 1.0):
        assert quality.quantile(values, "s", share) == values.agg(F.percentile("s", F.lit(share))).first()[0]
    seen = []
    monkeypatch.setattr(quality, "fit", lambda labelled, partners: seen.append(labelled.count()))
    texts = spark.range(21_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    quality.score_quality(texts, texts.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    assert seen == [21_000]


def test_quality_of_held_out_documents(spark):
    """On the driver's documents the labels that were not learned are met."""
    at = "/root/testdata/sf0.01"
    got = queries.op12_quality(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").filter("held_out")
    hit, n = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert hit >= 0.95 * n
