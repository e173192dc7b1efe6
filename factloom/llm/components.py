"""Connected components of an undirected graph, wholly on executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import _io


def _forest(batches):
    """Union-find over one partition's edges, batch by batch: each vertex with its root."""
    for b in batches:
        parent: dict[int, int] = {}

        def root(x):
            top = x
            while (p := parent.get(top, top)) != top:
                top = p
            while (p := parent.get(x, x)) != top:
                parent[x], x = top, p
            return top

        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        pairs = np.array([(x, root(x)) for x in parent], dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Each vertex of ``edges`` (u long, v long) with the smallest vertex it reaches.

    Returns (u, label) for every vertex but the smallest of each component.  Edges
    are contracted within tasks, then by alternating large and small stars: every
    vertex moves to the smallest neighbour until only stars remain.  Only minima are
    aggregated by vertex; they are stored before edges join them, so that both sides of the
    join are shuffled for it and Spark splits a vertex with very many edges.
    """
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_forest, "u long, v long")
    now, before = _io.stored(pairs.distinct(), "edges"), None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _io.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = _io.stored(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), "edges")
        least = _io.stored(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v")
        now = _io.stored(small.distinct(), "edges")
        state = tuple(now.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("label"))
