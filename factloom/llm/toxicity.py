"""Toxic passages: maximum-scoring segments of token log-odds.

1. Words and their first 4 to 8 bytes are features.  Their numbers of toxic and
   clean labelled texts, with a Dirichlet prior in proportion to their counts in all
   documents (and to the sizes of the two classes), give log-odds with standard errors.  A word scores the bound of its best supported
   feature's log-odds nearest to zero, less a drift that makes a clean text's sum fall.
2. A linear-time scan finds all maximal-scoring segments of each whole text.
3. Their scores follow an extreme-value law: with lambda from the words of clean texts and
   K from the best segments of clean texts, a segment of score S in a text of n words has
   expectation K n exp(-lambda S).
4. A logistic curve over the best segment's and the summed normalised scores gives the
   probability that the text is labelled toxic.

Labels are learned from a bounded sample (``SAMPLE`` labelled rows, the smallest by hash of
the identifier): two thirds give the log-odds, the rest lambda, K and the curve.  Corpus counts and scores cover all documents.
Every feature with a bound other than 0 is kept; only the sample bounds their number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import _io
from factloom.llm._text import as_strings, chunks, span_hashes, word_bounds

SAMPLE = 20_000
HEADS = (4, 5, 6, 7, 8)
SURE = 2.0
PRIOR = 2.0
CUT = 0.3
_SLOTS = 1 << 20  # of a first test; what passes it is compared in full
_KINDS = np.arange(1, 2 + len(HEADS), dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
_BREAK = np.ones(256, dtype=bool)
_BREAK[128:] = _BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = False


def words_of(column: pa.Array):
    """First row, feature hashes (features x words) and the rows' word offsets of each chunk."""
    for i, _, data, off in chunks(column):
        data = data.copy()
        up = np.flatnonzero(data[:-1] == 0xC3) + 1  # capital Latin letters of two bytes
        up = up[(data[up] >= 0x80) & (data[up] <= 0x9E) & (data[up] != 0x97)]
        data[up] += 0x20
        starts, ends, rows = word_bounds(data, off, _BREAK)
        yield i, span_hashes(data, starts, ends, True, HEADS) ^ _KINDS, rows


@dataclass
class Scores:
    """Feature scores in an open table of at least four slots a feature; key 0 is an empty slot."""

    key: np.ndarray
    weight: np.ndarray
    support: np.ndarray
    steps: int = 0
    drift: float = 0.0

    @classmethod
    def of(cls, features: np.ndarray, weight: np.ndarray, support: np.ndarray) -> Scores:
        h, size = features.view(np.uint64), 1 << (4 * len(features)).bit_length()
        out = cls(np.zeros(size, np.uint64), np.zeros(size, np.float32), np.zeros(size, np.float32))
        left = np.arange(len(h))
        while len(left):  # of features that meet in a free slot one takes it, the others try the next slot
            slot = (h[left] + np.uint64(out.steps)) & np.uint64(size - 1)
            free = out.key[slot] == 0
            out.key[slot[free]] = h[left[free]]
            won = out.key[slot] == h[left]
            out.weight[slot[won]], out.support[slot[won]] = weight[left[won]], support[left[won]]
            left = left[~won]
            out.steps += 1
        return out

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """The score of each word."""
        h = hashes.reshape(-1)
        slot = (h & np.uint64(len(self.key) - 1)).astype(np.int64)
        got = self.key[slot]
        known = got == h
        on = np.flatnonzero(~known & (got != 0))
        for _ in range(1, self.steps):
            slot[on] = (slot[on] + 1) & (len(self.key) - 1)
            got = self.key[slot[on]]
            known[on] = got == h[on]
            on = on[(got != h[on]) & (got != 0)]
        slot, known = slot.reshape(hashes.shape), known.reshape(hashes.shape)
        support = np.where(known, np.abs(self.support[slot]), 0)
        best = support.argmax(axis=0)
        column = np.arange(hashes.shape[1])
        return np.where(known[best, column], self.weight[slot[best, column]], 0).astype(np.float64) - self.drift


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time.

    Only positive scores open segments, so the scan steps from one to the next; each
    segment keeps the cumulative sums before and after it, and joins with the last
    earlier one that starts lower and ends lower.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, last one with a lower sum before
    for i in up.tolist():
        start, end, low, high = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, end, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def _sample(labels: DataFrame, size: int) -> DataFrame:
    """At most ``size`` labelled rows (id, toxic, learn), the smallest by hash.

    An identifier that is labelled both ways counts as toxic.  Two thirds teach the feature
    scores, the others (learn false) the calibration.
    """
    rows = labels.filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(size).withColumn("learn", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) > 0)


def _label_counts(texts: DataFrame) -> DataFrame:
    """feature, number of toxic and of clean labelled texts that have it; feature 0 counts all texts."""

    def count(batches):
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False)
            for i, h, rows in words_of(as_strings(b.column(0))):
                own = [np.unique(h[:, x:y]) for x, y in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
                own = [np.concatenate(([np.uint64(0)], x)) for x in own]
                bad = np.repeat(toxic[i : i + len(own)], [len(x) for x in own])
                got, at = np.unique(np.concatenate(own), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(np.bincount(at, bad, len(got)).astype(np.int64)), pa.array(np.bincount(at, ~bad, len(got)).astype(np.int64))], names=["f", "t", "c"])

    return texts.mapInArrow(count, "f long, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _corpus_counts(texts: DataFrame, features: np.ndarray) -> np.ndarray:
    """How often each feature and any word occurs in all documents; the total is the last."""
    table = np.sort(features.view(np.uint64))
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def count(batches):
        known = shared.value
        quick = np.zeros(_SLOTS, dtype=bool)
        quick[(known & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        total = np.zeros(len(known) + 1, dtype=np.int64)
        for b in batches:
            for _, h, _ in words_of(as_strings(b.column(0))):
                total[-1] += h.shape[1]
                h = h.ravel()
                h = h[quick[(h & np.uint64(_SLOTS - 1)).astype(np.int64)]]
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                total[:-1] += np.bincount(at[known[at] == h], minlength=len(known))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["k", "n"])

    got = texts.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # at most one row a feature of the bounded sample, and one
    out = np.zeros(len(table) + 1)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    order = np.argsort(features.view(np.uint64))
    back = np.empty(len(features) + 1)
    back[order], back[-1] = out[:-1], out[-1]
    return back


def _odds(t: np.ndarray, c: np.ndarray, n_t: int, n_c: int, prior_t, prior_c) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of features with given priors of the two classes, and their standard errors."""
    a, b = t + prior_t, c + prior_c
    size_t, size_c = n_t + 2 * PRIOR, n_c + 2 * PRIOR * max(1.0, n_c / max(1, n_t))
    return np.log(a / np.maximum(size_t - a, 0.5)) - np.log(b / np.maximum(size_c - b, 0.5)), np.sqrt(1 / a + 1 / b)


def _hopeful(t: np.ndarray, c: np.ndarray, n_t: int, n_c: int) -> np.ndarray:
    """False only for features whose bound is 0 whatever their corpus counts.

    The range of the prior is cut into short intervals; in each, the odds are furthest
    from zero with the one class at its upper and the other at its lower end.
    """
    ratio = max(1.0, n_c / max(1, n_t))
    out = np.zeros(len(t), dtype=bool)
    ends = np.linspace(0.125, 1.125, 17) * PRIOR
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        up, _ = _odds(t, c, n_t, n_c, high, low * ratio)
        down, _ = _odds(t, c, n_t, n_c, low, high * ratio)
        _, error = _odds(t, c, n_t, n_c, high, high * ratio)
        out |= np.maximum(up, -down) > SURE * error - 1e-9
    return out


def _learned(texts: DataFrame, labelled: DataFrame) -> Scores:
    """Feature scores from the labelled sample and the counts of the whole corpus."""
    seen = _io.stored(_label_counts(labelled), "label-counts")
    sums = seen.filter("f = 0").select("t", "c").first()
    n_t, n_c = (sums["t"], sums["c"]) if sums else (0, 0)

    def hopeful(batches):
        for b in batches:
            yield b.filter(pa.array(_hopeful(b.column(1).to_numpy(), b.column(2).to_numpy(), n_t, n_c)))

    kept = seen.filter("f <> 0").mapInArrow(hopeful, "f long, t long, c long").toArrow()  # bounded by the sample's texts
    f, t, c = (kept.column(i).to_numpy() for i in range(3))
    if not len(f):
        return Scores.of(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    corpus, n_docs = _corpus_counts(texts, f), max(1, texts.count())
    prior = PRIOR * (np.minimum(1.0, corpus[:-1] / n_docs) + 0.125)
    odds, error = _odds(t, c, n_t, n_c, prior, prior * max(1.0, n_c / max(1, n_t)))
    bound = np.sign(odds) * np.maximum(0, np.abs(odds) - SURE * error)
    use = bound != 0
    return Scores.of(f[use], np.clip(bound, -8, 8)[use], (odds / error)[use])


def _word_scores(labelled: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """Histogram of word scores (in hundredths) in clean labelled texts."""

    def tally(batches):
        for b in batches:
            clean = ~b.column(1).to_numpy(zero_copy_only=False)
            for i, h, rows in words_of(as_strings(b.column(0))):
                own = np.repeat(clean[i : i + len(rows) - 1], np.diff(rows))
                got, n = np.unique(np.round(shared.value.words(h[:, own]) * 100).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(n)], names=["s", "n"])

    got = labelled.mapInArrow(tally, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).toArrow()  # at most 1601 rows
    return got.column(0).to_numpy() / 100, got.column(1).to_numpy().astype(float)


def _lambda(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    if not len(scores) or scores.max() <= 0:
        return 1.0
    p = counts / counts.sum()
    low, high = 0.0, 1.0
    while (p * np.exp(high * scores)).sum() < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return max(high, 1e-3)


def _scanned(texts: DataFrame, shared, lam: float, k: float = 0.0) -> DataFrame:
    """Best and summed segment scores of each whole text, and its significant segments (none without ``k``)."""

    def scan(batches):
        for b in batches:
            n, best, total, spots = [], [], [], []
            for _, h, rows in words_of(as_strings(b.column(1))):
                s = shared.value.words(h)
                for x, y in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                    found = segments(s[x:y])
                    n.append(y - x)
                    best.append(max((g[2] for g in found), default=0.0))
                    total.append(sum(g[2] for g in found))
                    spots.append([{"first": u, "last": v - 1, "score": float(w)} for u, v, w in found if k > 0 and k * max(y - x, 1) * np.exp(-lam * w) < 0.01])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(total, pa.float64()), pa.array(spots, kind)], names=["id", "h", "n", "best", "total", "segments"])

    return texts.select("id", "text", F.xxhash64("text").alias("h")).mapInArrow(scan, "id long, h long, n long, best double, total double, segments array<struct<first:int,last:int,score:double>>")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, drift: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, score, predicted, n_passages, p_value, passages.

    labels: the rows to learn from (id_col, label_col 0/1); at most ``sample`` of them are
    used.  score: probability of label 1; predicted: 1 if it is at least 0.3.  passages:
    the significant segments (expected number in a clean text below 0.01) as word places
    first..last and score; p_value: extreme-value probability of the best one.  Words are
    runs of ASCII letters and digits or non-ASCII bytes, case folded.  Null and empty texts
    have no segment and get the base score.  Without labels of both kinds every score is
    the share of label 1 (0 without any).  Rows without identifier are scored too; rows
    that repeat are scored alike; other columns are not read; an empty table gives an empty
    result.
    """
    return _scored(docs, labels, id_col, text_col, label_col, sample, drift).drop("h")


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "toxic", sample: int = SAMPLE, drift: float = 0.5) -> DataFrame:
    """``score_toxicity`` with h, Spark's hash of the text."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = _io.stored(_sample(labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")), sample), "label-sample")
    # bounded: at most ``sample`` rows of 12 bytes
    labelled = texts.join(F.broadcast(chosen), "id").select("text", (F.col("toxic") == 1).alias("toxic"), "learn")
    scores = _learned(texts, labelled.filter("learn"))
    scores.drift = drift
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    lam = _lambda(*_word_scores(labelled.filter("not learn"), shared))
    known = _scanned(labelled.filter("not learn").select(F.col("toxic").cast("long").alias("id"), "text"), shared, lam).select("n", "best", "total", "id").toArrow()  # at most ``sample`` rows and their repeats
    n, best, total, toxic = (known.column(i).to_numpy().astype(float) for i in range(4))
    clean = toxic != 1
    k = clean.sum() / max(1e-9, (n[clean] * np.exp(-lam * best[clean])).sum()) if clean.any() else 1.0
    k = float(min(max(k, 1e-6), 1.0))
    scan = _io.stored(_scanned(texts, shared, lam, k), "segments")
    expected = F.lit(k) * F.greatest("n", F.lit(1)) * F.exp(F.lit(-lam) * F.col("best"))
    # what the best segment has beyond chance; none for texts without one, however short
    x1 = F.greatest(F.lit(0.0), F.lit(lam) * F.col("best") - F.log(F.greatest(F.lit(1.0), F.lit(k) * F.col("n"))))
    x2 = F.log1p(F.lit(lam) * F.col("total"))
    if clean.any() and not clean.all():
        a1, a2 = np.maximum(0, lam * best - np.log(np.maximum(1, k * n))), np.log1p(lam * total)
        w1, w2, w0 = (float(v) for v in _logistic(np.column_stack([a1, a2]), toxic))
        score = 1 / (1 + F.exp(-(F.lit(w1) * x1 + F.lit(w2) * x2 + F.lit(w0))))
    else:
        score = F.lit(float(toxic.mean()) if len(toxic) else 0.0)
    out = scan.select(F.col("id").alias("doc_id"), "h", score.alias("score"), F.col("segments").alias("passages"), (1 - F.exp(-expected)).alias("p_value"))
    return out.select("doc_id", "h", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("passages").alias("n_passages"), "p_value", "passages")


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the identifier as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` not predicted toxic, with all their columns.

    Each row is judged by its own text, also where it has no identifier or repeats one.
    """
    own, mark = _io.fresh(docs, "_own", "_mark")
    none = F.lit(-(1 << 63))
    bad = _scored(docs, labels.filter(~held_out(id_col)), id_col, text_col).filter("predicted = 1")
    bad = bad.select(F.coalesce("doc_id", none).alias(own), F.col("h").alias(mark)).distinct()
    rows = docs.withColumns({own: F.coalesce(F.col(id_col).cast("long"), none), mark: F.xxhash64(F.col(text_col).cast("string"))})
    return rows.join(bad, [own, mark], "left_anti").select(*docs.columns)
