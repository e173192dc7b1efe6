"""Brute force for scores and sketches; repeated rows, missing identifiers, clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import _order, exact_dedup, fingerprints, minhash_dedup, mixing, queries, secret_scan, sentencepiece_codec, substring_dedup, token_output, toxicity
from tests.llm.test_operators import by_id, grams, odd_texts, table


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact_dedup_of_repeated_identifiers(spark):
    rows = [(5, "a"), (5, "b"), (3, "a"), (2, "b"), (None, "b"), (None, "z"), (None, "Z"), (5, "A")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(2, 5, 3, False), (3, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (5, 5, 3, True), (None, 5, 3, False), (None, None, 2, True), (None, None, 2, True)]
    for width in (32, 1):
        assert rows_of(exact_dedup.exact_groups(docs, digest_bytes=width), "doc_id", "keep_id", "group_size", "kept") == sorted(want, key=repr)


def test_drop_exact_copies(spark):
    rows = [(5, "a", 1), (5, "a", 2), (3, "A", 3), (None, "z", 4), (None, "Z", 5), (None, "a", 6), (9, None, 7), (9, "", 8), (7, "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _at int").withColumnRenamed("_at", "_AT")
    got = exact_dedup.drop_exact_copies(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in got.collect()) == [("5", "a"), ("7", "b"), ("9", ""), ("None", "z")]
    kept = exact_dedup.drop_exact_copies(docs, keep="min").collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in kept) == [("3", "a"), ("7", "b"), ("9", ""), ("None", "z")]
    assert exact_dedup.drop_exact_copies(docs.filter("false")).count() == 0


def test_drop_near_copies(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:-1], "other"])
    text, alone = " ".join(words), " ".join(f"v{i}" for i in range(50))
    rows = [(4, text, 1), (4, text, 2), (6, near, 3), (None, near, 4), (None, alone, 5), (None, alone, 6), (4, alone + " x", 7), (1, "", 8), (1, "", 9), (None, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _own int")
    got = minhash_dedup.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[-5:]) for r in got.collect()) == [("1", ""), ("1", ""), ("4", text[-5:]), ("4", (alone + " x")[-5:]), ("None", "")]
    assert minhash_dedup.drop_near_copies(docs.filter("false")).count() == 0


def test_near_groups_without_identifier(spark):
    docs = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (1, "A b c"), (1, "x")], "doc_id long, text string")
    assert rows_of(minhash_dedup.near_groups(docs), "doc_id", "n_shingles", "component_id", "kept") == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, None, True)]


def toxic_table(noise=23):
    rng = random.Random(7)
    clean = [f"w{i}" for i in range(120)]
    rows, labels = [(1, None), (2, "")], []
    for i in range(3, 300):
        words = [rng.choice(clean) for _ in range(rng.randint(3, 60))]
        if i % 5 == 0 or i % noise == 1:
            words[rng.randrange(len(words))] = rng.choice(["vile", "nasty", "villainous"])
        rows.append((i, rng.choice([" ", ", "]).join(words)))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels


def dense_scores(rows, labels, learn, drift=0.5):
    """The operator's score and p_value of each text, by plain counting without hashes."""
    text = {i: (t or "").lower() for i, t in rows}
    words = {i: re.findall(r"[a-z0-9]+", t) for i, t in text.items()}
    features = lambda w: [(0, w), *((k, w[:k]) for k in (4, 5, 6, 7, 8))]
    bad = dict(labels)
    t, c, corpus = {}, {}, {}
    for i in learn:
        for f in {f for w in words[i] for f in features(w)}:
            d = t if bad[i] else c
            d[f] = d.get(f, 0) + 1
    for ws in words.values():
        for w in ws:
            for f in features(w):
                corpus[f] = corpus.get(f, 0) + 1
    n_t, n_c = sum(bad[i] for i in learn), sum(1 - bad[i] for i in learn)
    ratio, scores = max(1.0, n_c / n_t), {}
    for f in {*t, *c}:
        prior = 2.0 * (min(1.0, corpus[f] / len(rows)) + 0.125)
        a, b = t.get(f, 0) + prior, c.get(f, 0) + prior * ratio
        odds = math.log(a / max(n_t + 4.0 - a, 0.5)) - math.log(b / max(n_c + 4.0 * ratio - b, 0.5))
        error = math.sqrt(1 / a + 1 / b)
        bound = math.copysign(max(0.0, abs(odds) - 2.0 * error), odds)
        if bound:
            scores[f] = (float(np.float32(np.clip(bound, -8, 8))), odds / error)

    def word(w):
        known = [scores[f] for f in features(w) if f in scores]
        return (max(known, key=lambda s: abs(s[1]))[0] if known else 0.0) - drift

    value = {i: [word(w) for w in ws] for i, ws in words.items()}
    rest = [i for i in bad if i not in learn]
    clean = [round(v * 100) / 100 for i in rest if not bad[i] for v in value[i]]
    assert max(clean) > 0
    low, high = 0.0, 64.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.mean(np.exp(mid * np.array(clean))) < 1 else (low, mid)
    lam, best, total = high, {}, {}
    for i, v in value.items():
        found = toxicity.segments(np.array(v))  # held against all segments in test_segments_are_maximal
        best[i], total[i] = max([0.0, *(s for _, _, s in found)]), sum(s for _, _, s in found)
    size = sum(len(value[i]) * math.exp(-lam * best[i]) for i in rest if not bad[i])
    k = min(max(sum(1 - bad[i] for i in rest) / size, 1e-6), 1.0)
    x = {i: (max(0.0, lam * best[i] - math.log(max(1.0, k * len(value[i])))), math.log1p(lam * total[i]), 1.0) for i in value}
    a, y, w = np.array([x[i] for i in rest]), np.array([bad[i] for i in rest]), np.zeros(3)
    ridge = np.diag([0.05, 0.05, 1e-9])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
    return {i: (1 / (1 + math.exp(-np.dot(w, x[i]))), 1 - math.exp(-k * max(1, len(value[i])) * math.exp(-lam * best[i]))) for i in value}


def test_toxicity_is_dense_counting(spark):
    rows, labels = toxic_table()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = toxicity._sample(marks.withColumnRenamed("doc_id", "id"), 10_000)
    learn = {r["id"] for r in sample.collect() if r["learn"]}
    got, want = by_id(toxicity.score_toxicity(docs, marks)), dense_scores(rows, labels, learn)
    for i, (score, p) in want.items():
        assert got[i]["score"] == pytest.approx(score, abs=2e-3) and got[i]["p_value"] == pytest.approx(p, abs=2e-3)
    assert sum(r["predicted"] for r in got.values()) > 40


def test_drop_toxic_by_row(spark):
    rows, labels = toxic_table(noise=10_000)
    more = [(None, "vile nasty vile", 1), (None, "w1 w2", 2), (5, "w1 w2 w3", 3), (7, "nasty vile nasty", 4)]
    docs = spark.createDataFrame([(*r, 0) for r in rows] + more, "doc_id long, text string, _mark int")
    marks = spark.createDataFrame([*labels, (5, 0), (10, 1), (10, 0)], "doc_id long, toxic int")  # 5 and 10 are labelled both ways
    got = toxicity.drop_toxic(docs, marks)
    assert got.columns == docs.columns
    assert {r["_mark"] for r in got.collect()} == {0, 2, 3}
    assert toxicity.drop_toxic(docs.filter("false"), marks).count() == 0
    again = [rows_of(toxicity._sample(marks.repartition(n).withColumnRenamed("doc_id", "id"), 10_000), "id", "toxic") for n in (1, 3)]
    assert again[0] == again[1] and (10, 1) in again[0]


def test_toxicity_of_odd_rows(spark):
    rows, labels = toxic_table()
    docs = spark.createDataFrame([*rows, (5, rows[4][1]), (500, "vile " * 50_000), (501, "x" * 300_000)], "doc_id long, text string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] == 500)["predicted"] == 1


def brute_links(text, reach=300):
    base, weak = secret_scan.base_spans(text), set(secret_scan.weak_spans(text))
    free = [w for w in weak if not any(b[0] < w[1] and b[1] > w[0] for b in base)]
    parts = [p for p in base + free if secret_scan.role(text, p)]
    scope = lambda p: sum(m.end() <= p[0] for m in re.finditer(r"\n[ \t\r]*\n", text))
    one_secret = lambda p, q: (secret_scan.role(text, p) == "secret") != (secret_scan.role(text, q) == "secret")
    meet = lambda p, q: scope(p) == scope(q) and one_secret(p, q) and (0 <= p[0] - q[1] <= reach or 0 <= q[0] - p[1] <= reach)
    return sorted(p for p in free if any(meet(p, q) for q in parts))


def test_secret_links_are_all_pairs():
    rng = random.Random(1)
    some = ["user: bob", "https://h.example/x", "10.0.0.1:22", "a@b.cz", "aB3" * 10, "password=abcdef123456", "AKIA" + "Q" * 16, "0af" * 8, "1234567890123456", "client_id: abcdef password=" + "a" * 16, "\n\n", "\n \t\n", "word " * 30, "z", "token: " + "aB3" * 8]
    for _ in range(2000):
        text = " ".join(rng.choice(some) for _ in range(rng.randint(0, 14)))
        assert sorted(secret_scan.linked(text, secret_scan.base_spans(text), secret_scan.weak_spans(text))) == brute_links(text)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
NUMBERS = "0123456789"


def run_end(text, at, chars):
    while at < len(text) and text[at] in chars:
        at += 1
    return at


def assigned(text, at, names, value):
    """Where the value of a name at this place begins and ends, by reading one character after another."""
    for name in names:
        if all(at + i < len(text) and text[at + i] in (c, c.upper()) for i, c in enumerate(name)):
            j = at + len(name)
            j += j < len(text) and text[j] in "\"'"
            j = run_end(text, j, " ")
            if j < len(text) and text[j] in ":=":
                j = run_end(text, j + 1, " ")
                j += j < len(text) and text[j] in "\"'"
                if run_end(text, j, value) > j:
                    return j, run_end(text, j, value)
    return None


def read_base(text):
    out, value = [], LETTERS + NUMBERS + "+/_.=-"
    for kind in ("assign", "access", "hex"):
        i = 0
        while i < len(text):
            end = None
            if kind == "assign":
                got = assigned(text, i, ("password", "passwd", "secret", "token", "apikey", "api_key"), value)
                end, ok = (got[1], got[1] - got[0] >= 12) if got else (None, False)
            elif kind == "access" and text[i : i + 4] == "AKIA" and run_end(text, i + 4, LETTERS[:26] + NUMBERS) > i + 4:
                end = run_end(text, i + 4, LETTERS[:26] + NUMBERS)
                ok = end - i >= 18
            elif kind == "hex" and text[i] in NUMBERS + "abcdef":
                end = run_end(text, i, NUMBERS + "abcdef")
                ok = end - i >= 16
            if end is None:
                i += 1
                continue
            if ok:
                out.append((i, end, kind))
            i = end
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def read_weak(text):
    """Accounts by name, opaque tokens and endpoints by scheme, by reading one character after another."""
    out, word = set(), LETTERS + NUMBERS + "_"
    free = lambda i: not i or text[i - 1] not in word
    i = 0
    while i < len(text):
        got = assigned(text, i, ("username", "user", "login", "account", "clientid", "client_id"), LETTERS + NUMBERS + "_.@+-") if free(i) else None
        if got and got[1] - got[0] >= 3:
            out.add((i, got[1], "account"))
            i = got[1]
            continue
        i += 1
    token = LETTERS + NUMBERS + "+/_-"
    i = 0
    while i < len(text):
        end = run_end(text, i, token)
        own = text[i:end]
        if len(own) >= 20 and all(any(c in kind for c in own) for kind in (NUMBERS, LETTERS[:26], LETTERS[26:])):
            out.add((i, end, "opaque"))
        i = max(end, i + 1)
    i = 0
    while i < len(text):
        for scheme in ("https://", "http://", "ftp://", "redis://"):
            end = i + len(scheme)
            if free(i) and text.startswith(scheme, i):
                while end < len(text) and not text[end].isspace() and text[end] not in "\"'<>":
                    end += 1
                if end - i - len(scheme) >= 4:
                    out.add((i, end, "endpoint"))
                    i = end - 1
                break
        i += 1
    return out


def test_secret_patterns_by_reading():
    rng = random.Random(8)
    some = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "user", "username", "Login", "client_id", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "AKIA" + "Q" * 14, "Q7", "abcdef012345", "0123456789abcdef", "aB3xY9", "-_+/.", "https://", "http://", "redis://", "h.example/x", "é", "\u212a", "\n", "<", "z" * 15, "ſecret", "_"]
    for _ in range(6000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 16)))
        assert secret_scan.base_spans(text) == read_base(text), text
        weak = {s for s in secret_scan.weak_spans(text) if s[2] != "account" or "@" not in text}
        assert weak == read_weak(text), text


def test_no_finding_without_a_secret():
    for text in ("Contact: mail info@shop.example, see https://shop.example/help", "user: bob at 10.1.2.3", "login: alice\nhttps://a.example/login AKIAQQQQ"):
        assert secret_scan.find(text) == ([], [])
    base, spans = secret_scan.find("user: bob, password=abcdefabcdef12 at https://a.example/login")
    assert [s[2] for s in base] == ["assign"] and [s[2] for s in spans] == ["account", "assign", "endpoint"]
    far = "user: bob " + "w " * 200 + "password=abcdefabcdef12"
    assert [s[2] for s in secret_scan.find(far)[1]] == ["assign"]


def test_secrets_edges(spark):
    inside = "client_id: abcdef password=" + "a" * 16 + "." + "b" * 16 + ".Xy9" * 6
    rows = [(1, inside), (1, inside), (None, "user: bob " + "aB3" * 7 + " at 10.1.2.3"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = secret_scan.scan_secrets(docs).collect()
    assert [r["spans"] for r in got if r["doc_id"] == 1] == ["account:0:17,assign:18:84,hex:27:43,hex:44:60"] * 2
    assert sorted(r["spans"] for r in got if r["doc_id"] is None) == ["", "account:0:9,opaque:10:31,endpoint:35:43"]
    assert secret_scan.scan_secrets(docs.filter("false")).count() == 0
    found = rows_of(secret_scan.secret_spans(docs), "doc_id", "kind", "linked", "excerpt")
    assert found.count((1, "account", True, "client_id: abcdef")) == 2 and (None, "endpoint", True, "10.1.2.3") in found
    assert secret_scan.secret_spans(docs.filter("false")).count() == 0


def shingle_hashes(text):
    return next(iter(fingerprints.shingle_sets(fingerprints.pa.array([text]))))


def test_sketches_are_the_k_smallest(spark):
    texts = [*odd_texts(), *(" ".join(f"v{i % n}{i // n}" for i in range(700)) for n in (3, 5))]
    got = by_id(fingerprints.compare_neighbours(table(spark, texts), part_rows=5))
    sets = [{int(h) >> 16 for h in shingle_hashes(t or "")} for t in texts]
    assert [len(s) for s in sets] == [len(grams(t)) for t in texts]
    k = fingerprints.K
    for i, s in enumerate(sets):
        after, t = sets[(i + 1) % len(sets)], texts[i] or ""
        assert fingerprints.unpack(got[i]["fingerprint"]).tolist() == sorted(s)[:k]
        edited = t[: len(t) - len(t) // 2] + (texts[(i + 1) % len(texts)] or "")[: len(t) // 2]
        e = {int(h) >> 16 for h in shingle_hashes(edited)}
        assert fingerprints.unpack(got[i]["edited_fingerprint"]).tolist() == sorted(e)[:k]
        for other, name in ((after, "near_next"), (e, "near_edited")):
            union = sorted(s | other)[:k]
            assert got[i][name] == pytest.approx(len(set(union) & s & other) / len(union) if union else 1.0)
        assert abs(got[i]["n_distinct"] - len(s)) <= 0.35 * len(s)


def test_neighbours_of_repeated_identifiers(spark):
    rows = [(None, "a b"), (None, "c d"), (3, "x y"), (3, "z"), (3, "z"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.compare_neighbours(docs, part_rows=1).collect()
    assert len(got) == 6
    follow = {hashlib.sha256(fingerprints.edited_texts(a or "", b or "").encode()).hexdigest() for _, a in rows for _, b in rows}
    assert all(r["edited_sha256"] in follow for r in got)
    assert sorted(str(r["next_id"]) for r in got) == ["3", "3", "3", "9", "None", "None"]
    one = fingerprints.compare_neighbours(docs.filter("doc_id = 9")).collect()
    assert [(r["doc_id"], r["next_id"], r["near_next"]) for r in one] == [(9, 9, 1.0)]


def test_merged_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "HELD_KEYS", 2)
    texts = [" ".join(f"w{i}" for i in range(a, a + 90)) for a in range(0, 900, 30)]
    docs = spark.createDataFrame([(i, t, i % 3 if i % 7 else None) for i, t in enumerate(texts)], "doc_id long, text string, part int")
    marks = fingerprints.fingerprint_documents(docs).join(docs.select("doc_id", "part"), "doc_id")
    got = {r["part"]: fingerprints.unpack(r["fingerprint"]).tolist() for r in fingerprints.merge_fingerprints(marks.repartition(5), ["part"]).collect()}
    for part in (0, 1, 2, None):
        own = [t for i, t in enumerate(texts) if (i % 3 if i % 7 else None) == part]
        union = {int(h) >> 16 for t in own for h in shingle_hashes(t)}
        assert got[part] == sorted(union)[: fingerprints.K]
    assert fingerprints.merge_fingerprints(marks.filter("false"), ["part"]).count() == 0


def test_tokens_of_repeated_identifiers(spark):
    rows = [(None, f"t{i}") for i in range(40)] + [(7, "same"), (7, "same"), (7, "other"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = queries.tokenizer_path("word_bpe_49k.json")
    index = token_output.write_tokens(docs, token_output._io.new_path(spark, "tokens"), path, part_rows=4)
    assert index.select("part").distinct().count() > 5  # rows without identifier are split too
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in token_output.read_tokens(index).collect())
    assert [r[2] for r in got] == [None] * 40 + [1, 7, 7, 7]
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_borders(spark):
    rng = np.random.default_rng(1)
    at, h = rng.integers(0, 6, 500), rng.integers(-50, 50, 500)
    edges = sorted(zip(at[:20].tolist(), h[:20].tolist(), strict=True))
    b = _order.Borders(*(np.array(x) for x in zip(*edges, strict=True)))
    part = b.part(at, h)
    for i, key in enumerate(zip(at.tolist(), h.tolist(), strict=True)):
        assert part[i] == sum(e <= key for e in edges)
    assert (b.first(part, at, h) == [k in edges for k in zip(at.tolist(), h.tolist(), strict=True)]).all()


def test_running_sum(spark):
    rows = spark.createDataFrame([(i, i * i % 17) for i in range(2000)], "k int, v long")
    before = 0
    for r in sorted(_order.running_sum(rows, "k", "v").collect()):
        assert r["before"] == before
        before += r["v"]


def test_decoded_documents(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a b é 中"), (1, "a b é 中"), (None, "x"), (2, None), (3, "▁ w" * 40_000)], "doc_id long, text string")
    encoded = sentencepiece_codec.encode_documents(docs, path)
    assert rows_of(sentencepiece_codec.decode_documents(encoded, path), "doc_id", "text") == sorted([(1, "a b é 中")] * 2 + [(None, "x"), (2, ""), (3, "  w" * 40_000)], key=repr)
    assert sentencepiece_codec.decode_documents(encoded.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), path).filter("text is not null").count() == 0
    assert sentencepiece_codec.encode_documents(docs.filter("false"), path).count() == 0


def test_mixed_documents_with_clashing_columns(spark):
    rows = [(i, f"a{i} b c", "en", "src1", "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _id string").withColumn("_take", F.lit(1)).withColumn("_own", F.lit(2)).withColumn("epoch", F.lit(3))
    chosen = mixing.mix_sources(docs, queries.mix_weights(docs), queries.mix_domain(), (1, 2), 1)
    mixed = mixing.mixed_documents(docs, chosen)
    assert mixed.columns == docs.columns and mixed.filter("_id = 'x' and _own = 2 and epoch = 3").count() == chosen.count()


def test_repeated_passages_of_repeated_identifiers(spark):
    """Rows that share an identifier, or have none, are documents of their own."""
    passage = " ".join(f"p{i}" for i in range(60))
    other = " ".join(f"q{i}" for i in range(50))
    own = " ".join(f"o{i}" for i in range(45))
    rows = [(1, passage), (1, "short text"), (2, passage), (2, f"x {other} y"), (None, f"{other} z"), (None, None), (3, own), (3, own), (None, own[:-4]), (4, ""), (5, " ".join(f"u{i}" for i in range(40))), (-(1 << 63), "p0 p1")]
    got = substring_dedup.drop_repeated_passages(spark.createDataFrame([(*r, "a", "h", 1) for r in rows], "doc_id long, text string, at string, h string, first int").repartition(4))
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    starts = {}
    for w in words:
        for k in range(len(w) - 34):
            starts[tuple(w[k : k + 35])] = starts.get(tuple(w[k : k + 35]), 0) + 1
    want = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {i for k in range(len(w) - 34) if starts[tuple(w[k : k + 35])] > 1 for i in range(k, k + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substring_dedup.drop_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_of_pieces_are_read_by_chunks_of_text():
    """A batch of long texts gives its pieces in parts, each of about a chunk of texts."""
    one = "palavra " * 300_000
    spots = [[{"anchor": k, "piece": i, "times": 1, "first": 1000 * i, "windows": 66} for i in range(200)] for k in range(3)]
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("piece", pa.int64()), ("times", pa.int64()), ("first", pa.int32()), ("windows", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([one] * 3), pa.array(spots, kind)], names=["at", "text", "spots"])
    got = list(substring_dedup._read_words(iter([batch]), 35))
    assert [b.num_rows for b in got] == [200] * 3
    assert [(r["anchor"], r["piece"], len(r["words"])) for b in got for r in b.to_pylist()] == [(k, i, 8 * 100) for k in range(3) for i in range(200)]
