"""Isotonic curves by pooling adjacent violators, for many groups at once and over partitions.

Points of one place are added up first.  Each range of places is pooled by itself, as a stream:
a stack of blocks whose means rise.  The blocks of all ranges then meet, in order, in one task
a group and are pooled again, which gives the same blocks as pooling the points.  With labels
of 0 and 1 and one weight a label, rising means are distinct fractions of counts, of which N
points allow at most about N to the power 2/3, so what meets is a small part of the points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from factloom.functions import scoring

_BLOCK = "fold int, low double, high double, s double, w double"
_LITERALS = 256


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (fold, low, high, sum, weight) in order, pooled until the means of a fold rise."""
    fold, stack = None, []
    for b in batches:
        for f, low, high, s, w in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if f != fold and stack:
                yield _blocks(fold, stack)
                stack = []
            fold = f
            while stack and stack[-1][2] * w >= s * stack[-1][3]:
                low, s, w = stack[-1][0], stack[-1][2] + s, stack[-1][3] + w
                stack.pop()
            stack.append((low, high, s, w))
    if stack:
        yield _blocks(fold, stack)


def _blocks(fold: int, stack: list[tuple]) -> pa.RecordBatch:
    low, high, s, w = (pa.array(c, pa.float64()) for c in zip(*stack, strict=True))
    return pa.RecordBatch.from_arrays([pa.array([fold] * len(stack), pa.int32()), low, high, s, w], names=["fold", "low", "high", "s", "w"])


def pooled(points: DataFrame) -> DataFrame:
    """fold, low, high, mean, weight: the blocks of each fold's rising curve through points (fold, x, y, weight).

    Points without fold, place, value or weight, and those of weight 0 or less, are left out.
    """
    good = points.filter("fold is not null and x is not null and y is not null and weight > 0 and not isnan(x)")
    each = good.groupBy(F.col("fold").cast("int").alias("fold"), F.col("x").cast("double").alias("low")).agg(F.sum(F.col("weight") * F.col("y")).alias("s"), F.sum("weight").alias("w"))
    each = each.select("fold", "low", F.col("low").alias("high"), "s", "w")
    near = each.repartitionByRange("fold", "low").sortWithinPartitions("fold", "low").mapInArrow(_pool, _BLOCK)
    whole = near.repartition("fold").sortWithinPartitions("fold", "low").mapInArrow(_pool, _BLOCK)
    return whole.select("fold", "low", "high", (F.col("s") / F.col("w")).alias("mean"), F.col("w").alias("weight"))


@dataclass(frozen=True)
class Curve:
    """A rising curve: straight between its boundaries, level outside."""

    boundaries: list[float]
    predictions: list[float]

    def at(self, x: Column) -> Column:
        if len(self.boundaries) <= _LITERALS:
            return scoring.curve(x, self.boundaries, self.predictions)
        places, values = np.array(self.boundaries), np.array(self.predictions)

        @F.pandas_udf(DoubleType())
        def read(v: pd.Series) -> pd.Series:
            return pd.Series(np.interp(v.to_numpy(), places, values))

        return read(x)


def curves(points: DataFrame) -> dict[int, Curve]:
    """The curve of each fold."""
    out: dict[int, list[tuple[float, float]]] = {}
    for r in pooled(points).orderBy("fold", "low").collect():  # of the folds' blocks, see above
        ends = (r["low"],) if r["low"] == r["high"] else (r["low"], r["high"])
        out.setdefault(r["fold"], []).extend((x, r["mean"]) for x in ends)
    return {k: Curve([x for x, _ in own], [y for _, y in own]) for k, own in out.items()}
