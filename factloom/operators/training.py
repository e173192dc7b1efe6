"""Training of the text classifier: split, debiasing, weights, fit, calibration, report."""

from __future__ import annotations

import functools
import importlib.util
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from factloom.functions import scoring, text
from factloom.functions.terms import listed_and, mask_mentions, spelled_once
from factloom.operators import isotonic
from factloom.session import numbered, stored


def label_classes(corpus: DataFrame) -> list[str]:
    """The sorted labels (as few as a classifier has classes)."""
    return [r["label"] for r in corpus.select("label").distinct().orderBy("label").collect()]


def encoded(corpus: DataFrame) -> DataFrame:
    """Adds code: the place of a row's label among the sorted labels, from 0; null for null."""
    order = Window.orderBy("label")  # as many rows as labels
    codes = corpus.select("label").filter("label is not null").distinct().withColumn("code", F.row_number().over(order) - 1)
    return corpus.join(F.broadcast(codes), "label", "left")


def split_assignment(corpus: DataFrame, test_share: tuple[int, int] = (1, 5), seed: int = 42) -> DataFrame:
    """Adds is_test: within each label the rows smallest by md5 of seed:doc_id, a fixed share.

    Counts by ranges of the hash find the range in which the share of a label ends; only
    that range is ranked, so a label with most rows is no hot group.  Each label's last test
    row (as few as there are classes) is then compared with all rows.
    """
    num, den = test_share
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    keys = corpus.select("label", "doc_id", key.alias("_key")).withColumn("_span", F.substring("_key", 1, 3))
    sums = keys.groupBy("label", "_span").agg(F.count("*").alias("_own"))  # at most 4,096 rows a label
    each = Window.partitionBy("label")
    size, up_to = F.sum("_own").over(each), F.sum("_own").over(each.orderBy("_span").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumns({"_limit": F.floor((size * num * 2 + den) / (2 * den)), "_before": up_to - F.col("_own")})
    edge = keys.join(sums.filter("_before < _limit and _limit <= _before + _own"), ["label", "_span"])
    rank = F.row_number().over(Window.partitionBy("label", "_span").orderBy("_key", "doc_id"))
    cut = edge.withColumn("_rank", rank).filter("_rank = _limit - _before").select("label", F.col("_key").alias("_cut"), F.col("doc_id").alias("_last"))
    rows = corpus.withColumn("_key", key).join(F.broadcast(cut), "label", "left")
    inside = (F.col("_key") < F.col("_cut")) | ((F.col("_key") == F.col("_cut")) & (F.col("doc_id") <= F.col("_last")))
    return rows.withColumn("is_test", F.coalesce(inside, F.lit(False))).drop("_key", "_cut", "_last")


def label_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("label").agg(F.count("*").alias("n"))


def balanced_weights(corpus: DataFrame) -> DataFrame:
    """label, weight = rows / (classes * rows of the label)."""
    counts = label_counts(corpus)
    every = Window.partitionBy(F.lit(0))  # as many rows as labels
    return counts.select("label", "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def protected_mentions(c: Column, terms: list[str] | None = None, mode: str = "auto", entities: Column | None = None) -> Column:
    """Mentions by list and/or by entities (names by pattern without any), first spelling of each kept."""
    none = F.array().cast("array<string>")
    names = text.proper_names(c)
    by_text = (names if entities is None else F.when(F.size(entities) > 0, entities).otherwise(names)) if mode in ("auto", "both") else none
    found = F.filter(F.transform(by_text, text.stripped), lambda m: m != "")
    if terms and mode in ("list", "both"):
        return listed_and(c, terms, found)
    return spelled_once(found)  # a column expression would find all names again for each of them


@functools.lru_cache(maxsize=1)
def _language_model():
    """This worker's language model, loaded once; None if there is none."""
    try:
        import spacy

        return spacy.load("pt_core_news_sm")
    except Exception:  # optional, as any failure means no entities
        return None


ENTITY_TYPES = ("PERSON", "ORG", "GPE")


def named_entities(c: Column, kinds: tuple[str, ...] = ENTITY_TYPES) -> Column:
    """Entities of these types by a language model if one is installed, else none: callers fall back to the pattern."""

    @F.pandas_udf(ArrayType(StringType()))
    def find(texts: pd.Series) -> pd.Series:
        tool = _language_model()
        return pd.Series([[e.text for e in tool(t or "").ents if e.label_ in kinds] if tool else [] for t in texts])

    return find(c)


def entities(c: Column, kinds: tuple[str, ...] = ENTITY_TYPES) -> Column | None:
    """Entities of a text where a language model can be had, else None: the pattern decides alone."""
    return named_entities(c, kinds) if importlib.util.find_spec("spacy") else None


def with_masked_copies(corpus: DataFrame, terms: list[str] | None = None, mode: str = "auto", alpha: float = 0.5, kinds: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """The texts with weight 1, and a masked copy of each that has mentions with weight alpha."""
    masked = corpus.withColumn("masked", mask_mentions("text", protected_mentions(F.col("text"), terms, mode, entities(F.col("text"), kinds))))
    copies = masked.filter("masked <> text").withColumn("text", F.col("masked")).drop("masked")
    return corpus.withColumn("weight", F.lit(1.0)).withColumn("is_copy", F.lit(False)).unionByName(copies.withColumn("weight", F.lit(float(alpha))).withColumn("is_copy", F.lit(True)))


def debias_weights(corpus: DataFrame, terms: list[str] | None = None, mode: str = "auto", kinds: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """Adds in_subset (has mentions) and weight: subset rows / (2 * those of the label), 1 outside.

    Sizes come from one small aggregate, not from windows over the subset.
    """
    rows = corpus.withColumn("in_subset", F.size(protected_mentions(F.col("text"), terms, mode, entities(F.col("text"), kinds))) > 0)
    counts = rows.filter("in_subset").groupBy("label").agg(F.count("*").alias("n_label"))
    every = Window.partitionBy(F.lit(0))
    sizes = counts.select("label", (F.sum("n_label").over(every) / (2.0 * F.col("n_label"))).alias("w"))
    return rows.join(F.broadcast(sizes), "label", "left").withColumn("weight", F.when(F.col("in_subset"), F.col("w")).otherwise(F.lit(1.0))).drop("w")


def positive_label(classes: list[str]) -> str:
    """The label whose probability counts: true, or the last one where there is no such label."""
    return "true" if "true" in classes else classes[-1]


def style_scaler(rows: DataFrame, columns: list[str] = text.STYLE) -> DataFrame:
    """One row: mean and population deviation of each style column (0 counts as 1 when scaling)."""
    return rows.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_scale") for c in columns])


def features(rows: DataFrame, scaler: dict | None = None, style_scale: float = 0.2, text_col: str = "text") -> DataFrame:
    """Adds ``features``: the embedding, followed by scaled style numbers of the text if a scaler is given."""
    emb = F.transform("embedding", lambda x: x.cast("double"))
    if scaler is None:
        return rows.withColumn("features", emb)
    part = [(F.col(k) - scaler[f"{k}_mean"]) / (scaler[f"{k}_scale"] or 1.0) * style_scale for k in text.STYLE]
    return text.with_style(rows, text_col).withColumn("features", F.concat(emb, F.array(*part))).drop(*text.STYLE)


@dataclass(frozen=True)
class Classifier:
    """A fitted classifier as numbers: what serving needs, as JSON.

    parts: weights and intercept of each logistic model, with the boundaries and values of
    its calibration curve (none: not calibrated); the probability is the mean over the parts.
    """

    parts: tuple[tuple, ...]
    classes: tuple[str, ...] = ("fake", "true")
    scaler: dict | None = None
    style_scale: float = 1.0

    @classmethod
    def of(cls, models, classes: list[str], scaler: dict | None = None, style_scale: float = 1.0) -> Classifier:
        """From a fitted model, or from the folds of ``fit_calibrated``."""
        folds = models if isinstance(models, list) else [(models, None)]
        curve = lambda c: ([float(x) for x in c.boundaries], [float(x) for x in c.predictions]) if c is not None else (None, None)
        parts = tuple((m.coefficients.toArray().tolist(), float(m.intercept), *curve(c)) for m, c in folds)
        return cls(parts, tuple(classes), scaler, float(style_scale))

    def to_json(self) -> str:
        return json.dumps({"parts": self.parts, "classes": self.classes, "scaler": self.scaler, "style_scale": self.style_scale}, ensure_ascii=False)

    @classmethod
    def from_json(cls, said: str) -> Classifier:
        d = json.loads(said)
        return cls(tuple(tuple(p) for p in d["parts"]), tuple(d["classes"]), d["scaler"], d["style_scale"])

    def p_true(self, rows: DataFrame, text_col: str, name: str) -> DataFrame:
        """Adds P(true) of rows with embedding and text, in per cent."""
        rows = features(rows, self.scaler, self.style_scale, text_col)
        each = [scoring.margin(F.array(*[F.lit(float(x)) for x in w]), F.lit(float(b)), F.col("features")) for w, b, _, _ in self.parts]
        each = [scoring.sigmoid(m) if x is None else scoring.curve(m, x, y) for m, (_, _, x, y) in zip(each, self.parts, strict=True)]
        return rows.withColumn(name, sum(each[1:], each[0]) * (100.0 / len(each))).drop("features")


def fit_classifier(rows: DataFrame, weight_col: str = "weight", c: float = 0.1, max_iter: int = 2000) -> LogisticRegressionModel:
    """L2 logistic regression with loss weight C on rows (features, y 0/1, weight)."""
    total = rows.agg(F.sum(weight_col)).first()[0] or 1.0
    tool = LogisticRegression(featuresCol="vec", labelCol="y", weightCol=weight_col, regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-10)
    return tool.fit(rows.withColumn("vec", array_to_vector("features")))


def predict(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """Adds p_true (P of y = 1) and margin."""
    out = model.transform(rows.withColumn("vec", array_to_vector("features")))
    return out.withColumn("p_true", vector_to_array("probability")[1]).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("vec", "probability", "rawPrediction", "prediction")


def stratified_folds(rows: DataFrame, folds: int = 5, by: str = "y", seed: int = 7) -> DataFrame:
    """Adds fold: the rows of each label dealt in turn, in the order of md5 of seed:doc_id.

    So the folds of a label differ by one row at most.  No more folds than the rarest label
    has rows; a label with one row cannot be in both parts and is an error.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    ranked = numbered(rows.withColumn("_key", key), by, "_key", "doc_id", name="_place")
    sizes = ranked.groupBy(by).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))  # one row a label
    least = sizes.agg(F.min("_n")).first()[0] or 0
    if least < 2:
        raise ValueError("each label needs two rows at least")
    place = F.col("_place") - F.col("_first")
    return ranked.join(F.broadcast(sizes), by).withColumn("fold", (place % min(folds, least)).cast("int")).drop("_key", "_place", "_first", "_n")


def fit_calibrated(rows: DataFrame, folds: int = 5) -> list[tuple]:
    """For each stratified fold a classifier of the other rows, and the isotonic curve of the fold's margins."""
    rows = stored(stratified_folds(rows, folds), "folds")
    models, held = [], None
    for k in sorted(r["fold"] for r in rows.select("fold").distinct().collect()):  # a few folds
        models.append((k, fit_classifier(rows.filter(F.col("fold") != k))))
        part = predict(models[-1][1], rows.filter(F.col("fold") == k)).select("fold", F.col("margin").alias("x"), "y", "weight")
        held = part if held is None else held.unionByName(part)
    lines = isotonic.curves(held)
    return [(model, lines[k]) for k, model in models]


def predict_calibrated(models: list[tuple], rows: DataFrame) -> DataFrame:
    """Adds p_true, the mean of the folds' calibrated probabilities."""
    names = []
    for k, (model, curve) in enumerate(models):
        rows = predict(model, rows).drop("p_true").withColumn(f"_p{k}", curve.at(F.col("margin"))).drop("margin")
        names.append(f"_p{k}")
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return rows.withColumn("p_true", total / len(names)).drop(*names)


def classification_report(pairs: DataFrame) -> DataFrame:
    """Per class, accuracy, macro and weighted rows of (y, yhat): precision, recall, f1, support."""
    cells = pairs.groupBy("y", "yhat").agg(F.count("*").alias("n"))
    by_true = cells.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)).alias("hit"))
    by_said = cells.groupBy(F.col("yhat").alias("c")).agg(F.sum("n").alias("said"))
    zero = F.lit(0)
    rows = by_true.join(by_said, "c", "full").select("c", F.coalesce("support", zero).alias("support"), F.coalesce("hit", zero).alias("hit"), F.coalesce("said", zero).alias("said"))
    div = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)
    rows = rows.withColumn("precision", div(F.col("hit"), F.col("said"))).withColumn("recall", div(F.col("hit"), F.col("support")))
    rows = rows.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    each = rows.select(F.col("c").cast("string").alias("class"), "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    n = F.sum("support")
    mean = lambda name, f: rows.agg(*[f(F.col(m)).alias(m) for m in ("precision", "recall", "f1")], n.cast("long").alias("support")).select(F.lit(name).alias("class"), "precision", "recall", "f1", "support")
    macro = mean("macro avg", F.avg)
    weighted = mean("weighted avg", lambda m: F.sum(m * F.col("support")) / F.sum("support"))
    accuracy = rows.agg((F.sum("hit") / F.sum("support")).alias("a"), n.cast("long").alias("support")).select(F.lit("accuracy").alias("class"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), "support")
    return each.unionByName(accuracy).unionByName(macro).unionByName(weighted)
