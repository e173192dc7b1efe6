"""Many terms in one pass, against term by term."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import terms
from factloom.operators import training


def one_by_one(text, found):
    for m in sorted(dict.fromkeys(found), key=lambda m: (-len(m), m)):
        text = re.sub(rf"\b{re.escape(m)}\b", "[ENT]", text, flags=re.IGNORECASE)
    return text


def occurs(text, term):
    return re.search(rf"\b{re.escape(term)}\b", text, re.IGNORECASE) is not None


WORDS = ["a", "b", "A", "ab", "Ab", "c", "é", "É", "ção", "x1", "_", "ß", "İ", "i", "ı", "K", "k", "ſ", "s", "ent", "Ent", "漢", "\U0001d400", "á"]
GAPS = [" ", "  ", "-", ", ", "\n", ".", "[", "] ", " ", "'"]


def some_text(rng, most=14):
    return "".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randint(0, most)))


def some_term(rng):
    n = rng.choice([1, 1, 1, 2, 2, 3])
    term = "".join(rng.choice(WORDS) + rng.choice(GAPS[:3]) for _ in range(n - 1)) + rng.choice(WORDS)
    return rng.choice([term, term, term, term + "+", "." + term])


@pytest.mark.parametrize("size", [1 << 18, 40])
def test_terms_are_those_of_term_by_term(size, monkeypatch):
    monkeypatch.setattr(terms, "CHUNK", size)
    rng = random.Random(size)
    for _ in range(150):
        texts = [some_text(rng) for _ in range(20)] + ["", "a" * 500]
        names = [some_term(rng) for _ in range(rng.randint(1, 25))]
        assert terms.occurring(texts, names) == [[n for n in names if occurs(t, n)] for t in texts]
        mentions = [rng.choice([None, [], rng.sample(names, rng.randint(1, len(names)))]) for _ in texts]
        assert terms.masked([*texts, None], [*mentions, names]) == [*(t if not m else one_by_one(t, m) for t, m in zip(texts, mentions, strict=True)), None]


def test_letters_match_as_in_patterns():
    """Two letters share a stand-in exactly if the one as a pattern matches the other in any case."""
    fold, word = terms._tables()
    letters = [c for c in range(0x2200) if chr(c).isalpha()]
    groups = {}
    for c in letters:
        groups.setdefault(chr(c).upper(), set()).add(c)
        groups.setdefault(chr(c).lower(), set()).add(c)
    for own in groups.values():
        for a in own:
            for b in own:
                assert (fold[a] == fold[b]) == bool(re.fullmatch(re.escape(chr(a)), chr(b), re.IGNORECASE)), (chr(a), chr(b))
    assert all(word[c] == bool(re.match(r"\w", chr(c))) for c in range(0x3000))


def test_mentions_in_spark(spark):
    rows = spark.createDataFrame([(1, "Ana Lima e ana foram a Lima"), (2, None), (3, ""), (4, "sem")], "id int, text string")
    names = ["ana", "Ana Lima", "", "LIMA", "zz", "foram a"]
    got = {r["id"]: r["m"] for r in rows.select("id", terms.listed_mentions(F.col("text"), names).alias("m")).collect()}
    assert got == {1: ["ana", "Ana Lima", "LIMA", "foram a"], 2: [], 3: [], 4: []}
    assert rows.select(terms.listed_mentions(F.col("text"), []).alias("m")).first()["m"] == []
    masked = rows.withColumn("m", training.protected_mentions(F.col("text"), names, "list")).select("id", terms.mask_mentions("text", "m").alias("t")).collect()
    assert {r["id"]: r["t"] for r in masked} == {1: "[ENT] e [ENT] [ENT] [ENT]", 2: None, 3: "", 4: "sem"}


def test_ten_thousand_terms_do_not_grow_the_plan(spark):
    many = [f"w{i}" for i in range(10_000)]
    rows = spark.createDataFrame([(f"x w{i} W{i + 1}, w{i}x",) for i in range(50)], "text string")
    got = rows.select("text", terms.listed_mentions(F.col("text"), many).alias("m"))
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 2_000
    assert all(r["m"] == [w for w in re.findall(r"w\d+\b", r["text"].lower()) if f"{w}x" not in w] for r in got.collect())


def test_batches_are_python_objects_in_slices(monkeypatch):
    """A batch of any number of rows is never turned into Python objects as a whole."""
    import pyarrow as pa

    from factloom.functions import text

    most = []
    monkeypatch.setattr(terms, "masked", lambda texts, found, f=terms.masked: most.append(len(texts)) or f(texts, found))
    monkeypatch.setattr(terms, "occurring", lambda texts, *more, f=terms.occurring: most.append(len(texts)) or f(texts, *more))
    texts = pa.array([*["Ana viu", None, "", "sem ana"] * 300])
    lists = pa.array([*[["ana"], ["x"], None, []] * 300], pa.list_(pa.string()))
    assert terms.mask_mentions.func(texts, lists).to_pylist() == ["[ENT] viu", None, "", "sem ana"] * 300
    assert terms._finder(["ana"], True).func(texts, lists).to_pylist() == [["ana"], ["x"], [], ["ana"]] * 300
    assert max(most) <= text.SLICE < len(texts)
    got = text._embedder(4).func(texts).to_pylist()
    assert len(got) == 1200 and got[1] == got[2] == [0.0] * 4 and abs(sum(x * x for x in got[0]) - 1) < 1e-9


def test_first_spellings_of_many_names(spark):
    """Names are found once a text, not once for each name."""
    rows = spark.createDataFrame([(1, "Ana viu. Bia e ANA. Ana, Bia"), (2, None), (3, "sem")], "id int, text string")
    got = rows.withColumn("m", training.protected_mentions(F.col("text")))
    assert {r["id"]: r["m"] for r in got.select("id", "m").collect()} == {1: ["Ana", "Bia"], 2: None, 3: []}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
