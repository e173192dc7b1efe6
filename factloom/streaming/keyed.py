"""Incremental classifiers, one for each key, learned from a stream in the state store.

Feedback rows go to the state of their model: coefficients, intercept, step and update
counters.  Models are learned in parallel, as many as there are keys; the rows of one model in
a micro-batch are taken in order of ``seq``, as its steps depend on it: features wait in a
temporary file of the task, and only their places (some tens of bytes a row) are in memory.  The state store and the stream's checkpoint move
on together, so each row counts once, also after a restart.  After each micro-batch the models
that changed are written as that batch's version; a batch that is run again writes the same
version again.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.functions import text
from factloom.session import exists
from factloom.streaming.online import PENALTY, sgd

FEEDBACK = "model string, seq long, text string, label string"
VERSION = "model string, coefficients array<double>, intercept double, t long, n_updates long, learned long"
BLOCK = 4096  # rows whose features are in memory at a time
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Learner(StatefulProcessor):
    """The state of one model: coefficients, intercept, t (the next step), n (updates)."""

    def __init__(self, dim: int, penalty: float = PENALTY) -> None:
        self.dim, self.penalty = dim, penalty

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("model", "w array<double>, b double, t long, n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            self.state.update(([float(x) for x in r.coefficients], float(r.intercept), int(r.t), int(r.n_updates)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        w, b, t, n = self.state.get() if self.state.exists() else ([0.0] * self.dim, 0.0, 1, 0)
        seq, good = [], []
        with tempfile.TemporaryFile() as held:  # the features of one model and micro-batch, as they come
            for pdf in rows:
                for i in range(0, len(pdf), BLOCK):
                    some = pdf.iloc[i : i + BLOCK]
                    held.write(np.stack(some["features"]).astype(np.float64).tobytes())
                    seq.append(some["seq"].to_numpy())
                    good.append((some["label"] == "true").to_numpy())
            learned = sum(map(len, seq))
            if not learned:
                return
            held.flush()
            order, y = np.argsort(np.concatenate(seq), kind="stable"), np.concatenate(good)
            x, w = np.memmap(held, np.float64, "r", shape=(learned, self.dim)), np.array(w)
            for i in range(0, learned, BLOCK):
                own = order[i : i + BLOCK]
                w, b, t = sgd(w, b, t, x[own], y[own], self.penalty)
            del x
        self.state.update(([float(v) for v in w], float(b), int(t), int(n + learned)))
        yield pd.DataFrame({"model": [key[0]], "coefficients": [list(map(float, w))], "intercept": [float(b)], "t": [int(t)], "n_updates": [int(n + learned)], "learned": [learned]})

    def close(self) -> None:
        pass


def feedback_stream(spark: SparkSession, path: str, schema: str = FEEDBACK, max_files: int = 16) -> DataFrame:
    """Feedback files (Parquet) as a stream, oldest first, at most ``max_files`` a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def learn(feedback: DataFrame, state_path: str, checkpoint: str, classes: list[str], dim: int = 64, start: DataFrame | None = None):
    """Start a query that learns each model's classifier from a stream of rows (model, seq, text, label).

    Blank texts and rows without a model are left out; labels are brought to the classifier's
    (``text.label_of``), a missing one counts as not true.  ``start`` gives models (as ``models``
    returns them) their state where there is no checkpoint yet.  Versions are in
    ``state_path``, a folder for each micro-batch.
    """
    spark = feedback.sparkSession
    rows = feedback.filter(F.col("model").isNotNull() & ~text.is_blank(F.col("text")))
    rows = rows.select("model", "seq", text.hashed_embedding(F.col("text"), dim).alias("features"), F.coalesce(text.label_of(F.col("label"), classes), F.lit(text.negative_label(classes))).alias("label"))
    first = start.select("model", "coefficients", "intercept", "t", "n_updates").groupBy("model") if start is not None else None
    learned = rows.groupBy("model").transformWithStateInPandas(Learner(dim), VERSION, "Update", "None", first)

    def version(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}")

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # the store that such a state needs; a query keeps it
    try:
        return learned.writeStream.outputMode("update").foreachBatch(version).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def versions(spark: SparkSession, state_path: str) -> DataFrame:
    """All versions of all models, with their batch_id; none before the first micro-batch."""
    schema = f"{VERSION}, batch_id long"
    if not exists(spark, state_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", state_path).parquet(state_path)


def models(spark: SparkSession, state_path: str) -> DataFrame:
    """The latest version of each model."""
    latest = F.max_by(F.struct("coefficients", "intercept", "t", "n_updates", "batch_id"), "batch_id")
    return versions(spark, state_path).groupBy("model").agg(latest.alias("s")).select("model", "s.*")
