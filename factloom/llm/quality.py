"""Quality of documents by Bradley-Terry pairwise ranking.

1. Each text becomes a vector of shares: of characters by class, of words by shape, of what is
   repeated among its words, word triples and lines.  Identifier, language and source are no
   part of it.
2. Preference pairs are a document of label 1 and one of label 0.  Each document of the larger
   class meets ``partners`` of the smaller one, in turn, so all of these meet equally often.
3. The strength of a document is linear in its vector; a pair's first is preferred with the
   logistic probability of the difference of strengths.  The weights are those of a logistic
   regression without intercept on the differences of the vectors.
4. The threshold is a quantile of strengths: among the labelled rows, that of the share of
   label 0; or, with ``keep_share``, among all documents, that of the share to be dropped.
   A document's score is the probability that it is preferred to one at the threshold.

All labelled rows are learned from: they are ranked by the hash of the identifier in spans of
it, and the threshold is an exact quantile.  Vectors and scores are made of all whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm import _io
from factloom.llm._text import as_strings, chunks, gram_hashes, span_hashes, word_bounds

PARTNERS = 8
ACCURACY = 100_000
PENALTY = 1e-3
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASSES = ("control", "upper", "lower", "digit", "space", "line", "wide", "more")  # more: bytes of a character but the first
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[9, 32]], _CLASS[10] = 1, 2, 3, 4, 5
_CLASS[192:], _CLASS[128:192] = 6, 7
_CLASS[_MARKS] = len(_CLASSES) + np.arange(len(_MARKS))
_KINDS = len(_CLASSES) + len(_MARKS)
_LINE = np.zeros(256, dtype=bool)
_LINE[10] = True
_TAIL = np.zeros(256, dtype=bool)  # marks that seldom end a word
_TAIL[[ord(c) for c in "#$%&*+/<=>@[\\^_`{|~"]] = True
_SHARES = ("control", "upper", "digit", "line", "wide")
WORD = ("length", "spread", "capital", "shout", "short", "bare", "tail", "words", "variety", "top", "twice", "triples", "lines", "line_words")
NAMES = [*_SHARES, *[f"mark_{chr(c)}" for c in _MARKS], *WORD]


def _repeats(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row (by the offsets ``rows``) the number of distinct hashes and that of the most frequent one."""
    n = len(rows) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, r[at], np.diff(np.append(at, len(h))))
    return np.bincount(r[at], minlength=n), most


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def vectors_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The vectors of some rows of UTF-8 bytes: one line each, columns as in ``NAMES``."""
    n, size = len(off) - 1, np.diff(off)
    kinds = np.bincount(np.repeat(np.arange(n) * _KINDS, size) + _CLASS[data], minlength=n * _KINDS).reshape(n, _KINDS)
    chars = size - kinds[:, _CLASSES.index("more")]
    shares = [np.sqrt(_share(kinds[:, _CLASSES.index(c)], chars)) for c in _SHARES] + [np.sqrt(_share(kinds[:, len(_CLASSES) + k], chars)) for k in range(len(_MARKS))]
    starts, ends, rows = word_bounds(data, off)
    words = np.diff(rows)
    added = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[rows])  # noqa: E731  by row
    inside = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.stack([starts, ends])], axis=0)[0]  # noqa: E731  by word
    upper, lower, wide = (inside(_CLASS[data] == k) for k in (1, 2, 6))
    length = (ends - starts - inside(_CLASS[data] == 7)).astype(float)
    mean = _share(added(length), words)
    spread = np.sqrt(np.maximum(0, _share(added(length * length), words) - mean * mean))
    hashes = span_hashes(data, starts, ends, True)
    distinct, most = _repeats(hashes, rows)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[rows[:-1][rows[:-1] < rows[1:]]] = False
    triples = gram_hashes(hashes, 3)
    edge = np.concatenate(([0], np.cumsum(np.maximum(0, words - 2))))
    own = np.arange(edge[-1]) + np.repeat(rows[:-1] - edge[:-1], np.maximum(0, words - 2))
    new, _ = _repeats(triples[own], edge)
    first, last, lines = word_bounds(data, off, _LINE)
    other, _ = _repeats(span_hashes(data, first, last, False), lines)
    shapes = [
        np.log1p(mean),
        np.log1p(spread),
        _share(added((_CLASS[data[starts]] == 1) if len(starts) else np.zeros(0)), words),
        _share(added((upper > 1) & (lower == 0)), words),
        _share(added(length == 1), words),
        _share(added(upper + lower + wide == 0), words),
        _share(added(_TAIL[data[ends - 1]] if len(ends) else np.zeros(0)), words),
        np.log1p(words),
        np.log1p(distinct) / np.maximum(1, np.log1p(words)),
        np.sqrt(_share(most, words)),
        np.sqrt(_share(added(again), words)),
        np.sqrt(1 - _share(new, np.diff(edge)) * (np.diff(edge) > 0) - (np.diff(edge) == 0)),
        np.sqrt(1 - _share(other, np.diff(lines)) * (np.diff(lines) > 0) - (np.diff(lines) == 0)),
        np.log1p(_share(words, np.diff(lines))),
    ]
    return np.column_stack(shares + shapes)


def _vectors(texts: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and x, the vector, of rows with a text."""
    schema = ", ".join([*[f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep], "x array<double>"])

    def make(batches):
        for b in batches:
            for i, j, data, off in chunks(as_strings(b.column(0))):
                x = vectors_of(data, off)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(k + 1).slice(i, j - i) for k in range(len(keep))], lists], names=[*keep, "x"])

    return texts.select("text", *keep).mapInArrow(make, schema)


def _sample(labels: DataFrame, size: int | None) -> DataFrame:
    """Labelled rows (id, y), all or the ``size`` smallest by hash; an identifier that is labelled both ways counts as label 0."""
    rows = labels.filter("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    return rows if size is None else rows.orderBy(F.xxhash64("id"), "id").limit(size)


def _ranked(labelled: DataFrame) -> DataFrame:
    """Adds r: the place of a row (id, y) among those of its y, by hash of the identifier, from 0.

    Rows are ranked within 4,096 spans of the hash, to which the sizes of the spans before are added.
    """
    h = F.xxhash64("id")
    rows = labelled.withColumn("_span", F.shiftright(h, 52).cast("int"))
    sizes = rows.groupBy("y", "_span").agg(F.count("*").alias("_n"))  # at most 4,096 rows a class
    up = Window.partitionBy("y").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("y", "_span", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("y", "_span").orderBy(h, "id"))
    return rows.withColumn("_in", within).join(F.broadcast(sizes), ["y", "_span"]).withColumn("r", F.col("_before") + F.col("_in") - 1).drop("_span", "_in", "_before")


def quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile of a column, between the two values next to it as ``percentile`` has it.

    Only values that an approximation over all rows leaves in doubt, some 6 of 100,000, are counted one by one.
    """
    rows = rows.filter(F.col(column).isNotNull())
    n = rows.count()
    if not n:
        return None
    near = 3 / ACCURACY + 2 / n
    low, high = rows.agg(F.percentile_approx(column, [max(0.0, share - near), min(1.0, share + near)], ACCURACY)).first()[0]
    below = rows.filter(F.col(column) < low).count()
    some = rows.filter(F.col(column).between(low, high)).groupBy(column).agg(F.count("*").alias("n")).orderBy(column).collect()
    values, ends = np.array([r[0] for r in some]), below + np.cumsum([r["n"] for r in some])
    at = share * (n - 1)
    a, b = values[np.searchsorted(ends, [np.floor(at), np.ceil(at)], "right")]
    return float(a if a == b else (np.ceil(at) - at) * a + (at - np.floor(at)) * b)


def preference_pairs(labelled: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """d, y of pairs of labelled vectors (id, x, y 0/1): the difference of a document of label 1 and one of label 0.

    Half of the pairs are turned round, with y 0.  At most ``partners`` pairs a labelled row.
    """
    ranked = _ranked(labelled.select("id", "x", "y"))
    sizes = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    large = 1 if sizes.get(1, 0) >= sizes.get(0, 0) else 0
    small = max(1, sizes.get(1 - large, 0))
    a = ranked.filter(F.col("y") == large).select(F.col("x").alias("xa"), "r", F.explode(F.sequence(F.lit(0), F.lit(min(partners, small) - 1))).alias("t"))
    a = a.withColumn("other", (F.col("r") * min(partners, small) + F.col("t")) % small)
    b = ranked.filter(F.col("y") == 1 - large).select(F.col("x").alias("xb"), F.col("r").alias("other"))
    flip = (F.col("r") + F.col("t")) % 2
    sign = F.when(flip == 0, 1.0).otherwise(-1.0) * (1.0 if large else -1.0)
    return a.join(b, "other").withColumn("s", sign).select(F.zip_with("xa", "xb", lambda u, v: (u - v)).alias("d"), "s", flip.alias("f")).select(F.transform("d", lambda v: v * F.col("s")).alias("d"), (1.0 - F.col("f")).alias("y"))


def fit(labelled: DataFrame, partners: int = PARTNERS, penalty: float = PENALTY) -> np.ndarray | None:
    """The weights of the strengths; None without labels of both kinds."""
    if labelled.select("y").distinct().count() < 2:
        return None
    pairs = preference_pairs(labelled, partners).select("d", "y")
    tool = LogisticRegression(featuresCol="v", labelCol="y", fitIntercept=False, regParam=penalty, maxIter=100, tol=1e-7)
    return tool.fit(pairs.select(array_to_vector("d").alias("v"), "y")).coefficients.toArray()


def _strengths(texts: DataFrame, weights: np.ndarray, *keep: str) -> DataFrame:
    """The columns ``keep`` and strength of all whole texts."""
    schema = ", ".join([*[f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep], "strength double"])

    def rate(batches):
        for b in batches:
            column = as_strings(b.column(0))
            s = [vectors_of(data, off) @ weights for _, _, data, off in chunks(column)]
            yield pa.RecordBatch.from_arrays([*[b.column(k + 1) for k in range(len(keep))], pa.array(np.concatenate(s) if s else np.zeros(0))], names=[*keep, "strength"])

    return texts.select("text", *keep).mapInArrow(rate, schema)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int | None = None, keep_share: float | None = None, partners: int = PARTNERS) -> DataFrame:
    """One row per input row: doc_id, score, predicted, strength.

    labels: the rows to learn from (id_col, label_col 0/1), all of them unless ``sample`` says
    how many; an identifier that is labelled both ways counts as label 0.  strength: of the Bradley-Terry model; score: the
    probability that the document is preferred to one at the threshold; predicted: 1 if that is
    at least 0.5.  The threshold is the strengths' quantile of the share of label 0 among the labelled rows, or with
    ``keep_share`` the one that leaves this share of all documents.

    Null and empty texts have the vector of an empty text.  Without labels of both kinds
    every score is the share of label 1 (0 without any) and strength is null.  A labelled
    identifier with several texts teaches its smallest text; rows without identifier are
    scored too; rows with equal texts are scored alike; other columns are not read; an empty
    table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = _io.stored(_sample(marks, sample), "quality-labels")
    near = _io.IdFilter(chosen, "id")  # so that texts without a label are not shuffled

    def marked(batches):
        for b in batches:
            yield b.filter(pa.array(near.test(b.column(2).to_numpy()))).select(range(2))

    some = texts.withColumn("_h", F.xxhash64("id")).mapInArrow(marked, "id long, text string")
    taught = some.join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    labelled = _io.stored(_vectors(taught, "id", "y"), "quality-vectors")
    weights = fit(labelled, partners)
    if weights is None:
        share = float(labelled.agg(F.avg("y")).first()[0] or 0.0)
        return texts.select(F.col("id").alias("doc_id"), F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"), F.lit(None).cast("double").alias("strength"))
    rated = _io.stored(_strengths(texts, weights, "id"), "strengths")
    if keep_share is None:
        x = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in weights]), lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
        low = labelled.agg(F.avg(1 - F.col("y"))).first()[0]
        cut = quantile(labelled.select(x.alias("s")), "s", low)
    else:
        cut = rated.agg(F.percentile_approx("strength", F.lit(1.0 - keep_share), 100_000)).first()[0]
    score = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.lit(float(cut or 0.0)) - F.col("strength")))))
    out = rated.select(F.col("id").alias("doc_id"), score.alias("score"), "strength")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "strength")


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the identifier as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
