"""Classifiers learned from streams in the state store, against plain steps."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from factloom.functions import text
from factloom.session import new_path
from factloom.streaming import keyed, online

DIM = 8


def feedback(spark, models, first, n):
    words = ["um", "dois", "tres", "quatro", "cinco"]
    rows = [(m, first + i, f"{words[(i + k) % 5]} {words[(i * 3 + k) % 5]}", ["true", "fake", "TRUE ", None][(i + k) % 4]) for k, m in enumerate(models) for i in range(n)]
    rows += [(models[0], first + n, " ", "true"), (None, first, "um", "true")]  # blank, no model
    return spark.createDataFrame(rows, keyed.FEEDBACK)


def plain(spark, frames):
    """Each model's steps over all its rows in order."""
    out = {}
    for df in frames:
        rows = df.filter("model is not null").filter(~text.is_blank(df["text"])).select("model", "seq", text.hashed_embedding(df["text"], DIM).alias("x"), "label").orderBy("model", "seq").collect()
        for m in sorted({r["model"] for r in rows}):
            own = [r for r in rows if r["model"] == m]
            w, b, t, n = out.get(m, (np.zeros(DIM), 0.0, 1, 0))
            w, b, t = online.sgd(w, b, t, np.array([r["x"] for r in own]), np.array([(r["label"] or "").strip().lower() == "true" for r in own]))
            out[m] = (w, b, t, n + len(own))
    return out


def run(spark, root, start=None):
    query = keyed.learn(keyed.feedback_stream(spark, f"{root}/in", max_files=1000), f"{root}/out", f"{root}/checkpoint", ["fake", "true"], DIM, start)
    query.awaitTermination()
    return keyed.models(spark, f"{root}/out")


def check(got, want):
    got = {r["model"]: r for r in got.collect()}
    assert set(got) == set(want)
    for m, (w, b, t, n) in want.items():
        assert got[m]["coefficients"] == pytest.approx(w.tolist(), abs=1e-12) and got[m]["intercept"] == pytest.approx(b, abs=1e-12)
        assert (got[m]["t"], got[m]["n_updates"]) == (t, n)


def test_models_restart_and_count_once(spark):
    before = spark.conf.get(keyed._STORE, None)
    root, parts = new_path(spark, "keyed"), [feedback(spark, ["a", "b", "c"], 0, 11), feedback(spark, ["b", "d"], 100, 7)]
    parts[0].write.parquet(f"{root}/in")
    check(run(spark, root), plain(spark, parts[:1]))
    check(run(spark, root), plain(spark, parts[:1]))  # nothing new: nothing counts again
    parts[1].write.mode("append").parquet(f"{root}/in")
    check(run(spark, root), plain(spark, parts))
    told = keyed.versions(spark, f"{root}/out").groupBy("model").count().collect()
    assert {r["model"]: r["count"] for r in told} == {"a": 1, "b": 2, "c": 1, "d": 1}  # only models that changed
    assert spark.conf.get(keyed._STORE, None) == before


def test_models_start_from_saved_versions(spark):
    root, parts = new_path(spark, "keyed"), [feedback(spark, ["a", "b"], 0, 9), feedback(spark, ["b", "c"], 50, 5)]
    parts[0].write.parquet(f"{root}/one/in")
    parts[1].write.parquet(f"{root}/two/in")
    saved = run(spark, f"{root}/one")
    want = plain(spark, parts)
    check(run(spark, f"{root}/two", saved), {m: want[m] for m in ("b", "c")})  # a has no new rows


def test_no_models_yet(spark):
    assert keyed.models(spark, new_path(spark, "none")).count() == 0


class State:
    """A value state that has nothing yet."""

    def exists(self):
        return False

    def update(self, value):
        self.value = value


def test_rows_of_a_micro_batch_are_not_held():
    """Many rows of one model in one micro-batch, in any order: the same steps, with few of them in memory."""
    rng = np.random.default_rng(1)
    n, dim = 40_000, 64
    seq, y = rng.permutation(n) // 3, rng.random(n) < 0.5  # places repeat: the first to come is the first
    row = lambda i: np.random.default_rng(i).random((1000, dim))
    parts = (pd.DataFrame({"seq": seq[i : i + 1000], "features": list(row(i)), "label": np.where(y[i : i + 1000], "true", "fake")}) for i in range(0, n, 1000))
    tool = keyed.Learner(dim)
    tool.state = State()
    tracemalloc.start()
    (got,) = tool.handleInputRows(("a",), parts, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    order = np.argsort(seq, kind="stable")
    w, b, t = online.sgd(np.zeros(dim), 0.0, 1, np.concatenate([row(i) for i in range(0, n, 1000)])[order], y[order])
    assert tool.state.value == (w.tolist(), b, t, n) and got["learned"][0] == n
    assert peak < 0.6 * n * dim * 8
    assert not list(tool.handleInputRows(("a",), iter([]), None))
